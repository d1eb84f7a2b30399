from __future__ import annotations

import numpy as np
import pytest

from tidewell.operators.spikes import Rules, forest_scores, score_readings
from tidewell.operators.units import EDGES, compose, to_common

HOUR = 3_600_000_000


def test_compositions_and_cycles():
    ways = compose(EDGES)
    assert ways["mass", "oz", "kg"][0] == pytest.approx(0.45359237 / 16)
    s, o = ways["temperature", "F", "K"]
    assert s * 212 + o == pytest.approx(373.15)
    with pytest.raises(ValueError):
        compose([*EDGES, ("volume", "mL", "cL", 0.2, 0.0)])


ITEMS = [("223762", "C", 25.0, 45.0), ("223835", "fraction", 0.2, 1.0), ("50912", "mg/dL", 0.05, 45.0), ("224639", "kg", 20.0, 320.0), ("226559", "mL", 0.0, 6000.0)]
CASES = [
    ("223762", 98.6, None, "C", "F", 37.0), ("223762", 37.0, None, "°C", "C", 37.0), ("223762", None, "98,6 Deg. F (verified)", None, "F", 37.0),
    ("223762", 9999.0, None, "C", "C", 9999.0), ("223762", None, "unable to obtain", "C", None, None), ("223835", 40.0, None, None, "%", 0.4),
    ("223835", 1.0, None, "fraction", "fraction", 1.0), ("223835", None, "vol% 21", None, "%", 0.21), ("50912", 106.0, None, "mg/dL", "umol/L", 106 / 88.42),
    ("50912", 1.1, None, "MG/DL", "mg/dL", 1.1), ("50912", 88.42, "88.42 μmol/L", "mg/dL", "umol/L", 1.0), ("224639", 100.0, None, "LB", "lb", 45.359237),
    ("224639", 0.0, None, "kg", "kg", 0.0), ("226559", 0.5, None, "L", "L", 500.0), ("226559", -3.0, None, None, "mL", -3.0),
    ("999", 5.0, None, "C", None, None), (None, 5.0, None, None, None, None), ("50912", None, None, None, None, None), ("50912", 2.0, "x" * 100_000, "furlong", "mg/dL", 2.0),
]


def test_units_by_text_by_column_and_by_size(spark):
    rows = spark.createDataFrame([(k, *c[:4], "clash", 1) for k, c in enumerate(CASES)], "id int, type string, value_num double, value_txt string, uom string, lo string, value int")
    items = spark.createDataFrame(ITEMS, "type string, common_uom string, lo double, hi double")
    for r in to_common(rows, items).collect():
        unit, value = CASES[r.id][4:]
        if unit is None:
            assert r.common_value is None
        else:
            assert (r.recorded_unit, r.common_value) == (unit, pytest.approx(value))
        assert r.lo == "clash"
    assert to_common(rows.limit(0), items).count() == 0


def test_forest_isolates_what_is_rare():
    rng = np.random.default_rng(0)
    source = np.repeat(np.arange(30), 40)
    features = rng.normal(size=(1200, 4))
    odd = np.arange(0, 1200, 40) + 7
    features[odd] += 12
    grows = np.ones(1200, dtype=bool)
    scores = forest_scores(source, features, grows, Rules())
    assert scores[odd].min() > np.delete(scores, odd).max() + 0.1
    assert np.array_equal(scores, forest_scores(source, features, grows, Rules()))
    # A source has the same scores whatever its size, and rows that didn't grow the trees are scored too.
    many = np.concatenate([features] * 30)
    for size in (64, 256):
        large = forest_scores(np.zeros(len(many), dtype=int), many, np.arange(len(many)) % 3 > 0, Rules(sample=size))
        flagged = large >= Rules().unusual
        assert flagged[np.add.outer(np.arange(30) * 1200, odd).ravel()].mean() > 0.95 and flagged.mean() < 0.04
    calm = np.delete(features, odd, axis=0) / 4
    assert set(forest_scores(np.zeros(len(calm), dtype=int), calm, np.ones(len(calm), dtype=bool), Rules())) == {0.5}


def _series(values, source="x", start=0):
    return [(start + k, source, (start + k) * HOUR, (start + k) * HOUR, float(v), True, 1.0) for k, v in enumerate(values)]


SCHEMA = "row_id bigint, source string, at_us bigint, stored_us bigint, value double, possible boolean, floor double"


def _reasons(spark, rows, **kw):
    return {r.row_id: r.reason for r in score_readings(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_spikes_stuck_runs_and_what_is_neither(spark):
    rng = np.random.default_rng(1)
    calm = lambda n: (80 + rng.integers(-4, 5, n)).tolist()
    spikes = calm(20) + [140] + calm(20) + [30, 31] + calm(20)
    stuck = calm(20) + [83] * 14 + calm(20)
    shift = calm(25) + [v + 45 for v in calm(25)]
    slow = [80 + k + int(rng.integers(-1, 2)) for k in range(25)] + [105 - k + int(rng.integers(-1, 2)) for k in range(25)]
    rows = _series(spikes, "a") + _series(stuck, "b", 1000) + _series(shift, "c", 2000) + _series(slow, "d", 3000)
    got = _reasons(spark, rows)
    assert {k for k, v in got.items() if v == "spike"} == {20, 41, 42}
    assert {k for k, v in got.items() if v == "stuck"} >= set(range(1020, 1034))
    assert {k for k, v in got.items() if v == "stuck"} <= set(range(1018, 1036))
    assert all(got[k] is None for k in got if k >= 2000)


@pytest.mark.parametrize("score", [0.0, 0.5, 1.0])
def test_the_forest_decides(score):
    """With flat scores the shapes alone either flag nothing or a large part of what is normal."""
    from tidewell.operators import spikes as K

    rng = np.random.default_rng(4)
    value = np.concatenate([np.r_[80 + rng.integers(-4, 5, 30), 150, 80 + rng.integers(-4, 5, 30), [83] * 14, 80 + rng.integers(-4, 5, 25)] for _ in range(20)]).astype(float)
    source, at = np.repeat(np.arange(20), 100), np.tile(np.arange(100) * HOUR, 20)
    args = (source, at, value, np.ones(2000), np.ones(2000, dtype=bool), Rules())
    _, spike, stuck = K.judge(*args)
    true_spike, place = value == 150, np.arange(2000) % 100
    true_stuck = (place >= 61) & (place < 75)
    assert np.array_equal(spike, true_spike) and stuck[true_stuck].all() and stuck.sum() <= 290
    with pytest.MonkeyPatch.context() as m:
        m.setattr(K, "forest_scores", lambda source, *_: np.full(len(source), score))
        _, spike, stuck = K.judge(*args)
    flagged = spike | stuck
    assert not flagged.any() or flagged.mean() > 0.4


def test_every_reading_is_scored(spark):
    rows = _series([80, 81, 79, 80, 82, 81, 80, 79, 81, 80, 82, 79])
    rows[4], rows[7] = (4, "x", 4 * HOUR, 4 * HOUR, 9999.0, False, 1.0), (7, "x", 7 * HOUR, 7 * HOUR, -40.0, False, 1.0)
    got = {r.row_id: (r.score, r.reason) for r in score_readings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 12 and all(0 < s <= 1 for s, _ in got.values())
    assert min(got[4][0], got[7][0]) > 0.7 and got[4][1] == got[7][1] == "limit" and all(got[k] == (0.5, None) for k in got if k not in (4, 7))


def test_limits_copies_nulls_and_tiny_sources(spark):
    rows = _series([80, 81, 79, 80, 82, 81, 80, 79, 81, 80])
    rows[4] = (4, "x", 4 * HOUR, 4 * HOUR, 9999.0, False, 1.0)
    late = (5, "x", 5 * HOUR, 99 * HOUR, 9999.0, False, 1.0)
    odd = [(None, "x", 1, 1, 1.0, True, 1.0), (50, "x", 1, 1, None, True, 1.0), (51, None, 1, 1, 5.0, False, 1.0), (52, "x", None, 1, 5.0, True, 1.0), (53, "y", 1, None, 5.0, True, 1.0)]
    got = _reasons(spark, rows + [late, late, *odd])
    assert got[4] == "limit" and got[51] == "limit" and got[5] is None and got[52] is None and got[53] is None
    assert set(got) == {*range(10), 51, 52, 53}
    assert _reasons(spark, []) == {}


def test_long_source_in_stretches_is_judged_like_in_one(spark):
    rng = np.random.default_rng(3)
    values = (80 + rng.integers(-4, 5, 2000)).astype(float)
    values[[100, 777, 1444, 1999 - 30]] = 150
    rows = _series(values)
    cut = _reasons(spark, rows, stretch_days=20, overlap_days=3)
    assert {k for k, v in cut.items() if v == "spike"} == {100, 777, 1444, 1969} and len(cut) == 2000


def test_a_series_longer_than_a_block_is_judged_in_pieces(spark, monkeypatch):
    import pandas as pd

    from tidewell.operators import spikes as K

    rng = np.random.default_rng(5)
    values = (80 + rng.integers(-4, 5, 3000)).astype(float)
    at = [3, 499, 500, 501, 1111, 2990]
    values[at] = 150
    frame = pd.DataFrame({"series": np.r_[np.zeros(3000), np.ones(40)].astype(int), "series_too": 0, "row_id": np.arange(3040), "at_us": np.arange(3040) * HOUR, "stored_us": 0, "value": np.r_[values, np.full(40, 70.0)],
                          "floor": 1.0, "possible": True, "own": True})
    frame = pd.concat([frame, frame.iloc[[499, 700]]]).sort_values(["series", "at_us", "row_id"], ignore_index=True)

    def verdicts(batch):
        got = pd.concat(K._judge_sorted((frame.iloc[k : k + batch] for k in range(0, len(frame), batch)), Rules()))
        return {r.row_id: (r.score, r.reason) for r in got.itertuples()}, len(got)

    monkeypatch.setattr(K, "WINDOW", 400)
    monkeypatch.setattr(K, "CONTEXT", 64)
    first, n = verdicts(130)
    assert n == len(first) == 3040 and {k for k, (_, r) in first.items() if r == "spike"} == set(at)
    # Blocks and batches decide nothing.
    for block, batch in ((100, 130), (700, 37), (10_000, 5000)):
        monkeypatch.setattr(K, "BLOCK", block)
        assert verdicts(batch)[0] == first
    monkeypatch.setattr(K, "WINDOW", 100_000)
    assert {k for k, (_, r) in verdicts(130)[0].items() if r == "spike"} == set(at)


def test_a_source_is_judged_alike_whatever_else_there_is():
    from tidewell.operators import spikes as K

    rng = np.random.default_rng(12)
    value = (80 + rng.integers(-4, 5, 4000)).astype(float)
    value[rng.integers(0, 4000, 60)] += 40
    source, at = np.repeat(np.arange(80) * 977 - 5000, 50), np.tile(np.arange(50) * HOUR, 80)
    possible = rng.random(4000) > 0.02
    args = [source, at, value, np.ones(4000), possible]
    whole = K.judge(*args, Rules(), source)
    alone = [K.judge(*[a[k : k + 50] for a in args], Rules(), source[k : k + 50]) for k in range(0, 4000, 50)]
    for i in range(3):
        assert np.array_equal(whole[i], np.concatenate([a[i] for a in alone]))
