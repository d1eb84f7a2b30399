"""All queries of the core, and their SQL."""

from __future__ import annotations

from tidewell.plans import blocks, common_units, comparisons, contrasts, effects, event_stream, implausible, known_at, models, periods, person_splits, records, roundtrips, streams, timelines, trailing

_MODULES = (event_stream, timelines, effects, contrasts, comparisons, models, blocks, records, roundtrips, streams, periods, person_splits, implausible, known_at, common_units, trailing)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
