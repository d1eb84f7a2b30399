"""Implausible readings: spikes, stuck values and impossible values, relative to their source.

A source is one (entity, type) series. An isolation forest for each source scores every
reading: trees that split on random thresholds, in which unusual readings end up alone after
few splits. The unit of the forest is a run of equal readings, with four features: how far its level
is from what comes before and after, the smaller of its differences to its neighbours, its
distance from the level at its time of day, and how surprising its length is. The first three
are measured in typical steps of the source, the last by how often the source repeats a reading.

A node is only split on a feature whose range exceeds what is ordinary, and the feature is drawn
in proportion to its range (robust random cuts, Guha et al., 2016). So calm sources aren't cut at all
and have the neutral score 0.5, whatever their size, and a score says the same in every source.
The forest decides what is unusual; the rules after it only tell the kinds apart, by shape: a spike leaves
the level on both sides at once and returns, in a stuck run the length is what stands out
most, and lasting changes are neither. Physical limits are applied to every reading besides.

Forests of many sources are grown together, level by level, as array operations over all of
them; a task never works on them one by one. Series are cut into stretches of time that
overlap, so that a long source is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewell.functions.times import DAY
from tidewell.session import ship


@dataclass(frozen=True)
class Rules:
    """Parameters of the forest and of the shapes."""

    trees: int = 16
    sample: int = 256
    depth: int = 6
    #: Range of a feature that is ordinary, in typical steps; nats of surprise of a run that count as much; the largest value of a feature.
    ordinary: float = 6.5
    surprise: float = 12.0
    clip: float = 25.0
    #: How often a reading repeats where nothing is known, and the number of pairs of readings that this counts as.
    repeats: float = 0.2
    pairs: float = 40.0
    #: Score from which a reading is unusual.
    unusual: float = 0.58
    #: A spike enters and leaves with this part of its height at once, and lasts at most so many runs and readings.
    abrupt: float = 0.6
    longest: int = 3
    readings: int = 4
    #: Neighbours on each side that make up the level.
    near: int = 4


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth at which a random search tree over n points ends."""
    n = np.maximum(n.astype(float), 1.0)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _uniform(key: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the key and the parts alone (splitmix64)."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64)
        for p in parts:
            z = (z ^ np.asarray(p).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)) * 2.0**-53


def forest_scores(source: np.ndarray, features: np.ndarray, grows: np.ndarray, rules: Rules, keys: np.ndarray | None = None) -> np.ndarray:
    """Isolation scores in (0, 1] of all rows; `source` numbers the sources 0, 1, ... in order.

    What is drawn depends on the source's key (its number if none is given), the tree and the node, so
    a source's scores don't depend on what else is scored with it. One forest for each source, grown on at most about `sample` of its rows with `grows`. All sources' trees
    grow together: a node is (source, position in the tree). A row that lies outside the box of its
    leaf by more than what is ordinary counts as cut off there.
    """
    n, wide = features.shape
    count = np.bincount(source, weights=grows).astype(np.int64)
    low, high = np.full((len(count), wide), np.inf), np.full((len(count), wide), -np.inf)
    for f in range(wide):
        np.minimum.at(low[:, f], source[grows], features[grows, f])
        np.maximum.at(high[:, f], source[grows], features[grows, f])
    normal = np.maximum(_mean_path(np.minimum(count, rules.sample)), 1e-9)
    outside = ((features < low[source] - rules.ordinary) | (features > high[source] + rules.ordinary)).any(axis=1)
    score = np.where(outside, 2.0 ** (-1.0 / normal[source]), 0.5)
    # A source within what is ordinary has no node to split, in any tree.
    active = (high - low > rules.ordinary).any(axis=1) & (count > 2)
    score[count[source] <= 2] = 0.5
    live = np.flatnonzero(active[source])
    if len(live):
        part = np.cumsum(active) - 1
        named = np.arange(len(count)) if keys is None else keys
        score[live] = _grown_scores(part[source[live]], features[live], grows[live], normal[active], count[active], rules, named[active])
    return score


def _grown_scores(source: np.ndarray, features: np.ndarray, grows: np.ndarray, normal: np.ndarray, count: np.ndarray, rules: Rules, keys: np.ndarray) -> np.ndarray:
    n, wide = features.shape
    index = np.arange(n) - np.searchsorted(source, np.arange(len(count)))[source]
    drawn = np.minimum(1.0, rules.sample / count)[source]
    slots = 1 << (rules.depth + 1)
    base = source.astype(np.int64) * slots
    total = np.zeros(n)
    for tree in range(rules.trees):
        feature = np.full(len(count) * slots, -1, dtype=np.int8)
        border = np.zeros(len(count) * slots)
        size = np.zeros(len(count) * slots, dtype=np.int32)
        least, most = np.full((len(count) * slots, wide), np.inf), np.full((len(count) * slots, wide), -np.inf)
        rows = np.flatnonzero(grows & (_uniform(keys[source], tree, 1, index) < drawn))
        node = base[rows] + 1
        for level in range(rules.depth + 1):
            if not len(rows):
                break
            if level:
                order = np.argsort(node, kind="stable")
                rows, node = rows[order], node[order]
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            length = np.diff(np.r_[first, len(node)])
            at = node[first]
            values = features[rows]
            low, high = np.minimum.reduceat(values, first, axis=0), np.maximum.reduceat(values, first, axis=0)
            size[at], least[at], most[at] = length, low, high
            if level == rules.depth:
                break
            extent = np.where(high - low > rules.ordinary, high - low, 0.0)
            upto = np.cumsum(extent, axis=1)
            split = upto[:, -1] > 0
            named, local = keys[source[rows[first]]], at % slots
            pick = np.minimum((upto <= (_uniform(named, tree, 2, local) * upto[:, -1])[:, None]).sum(axis=1), wide - 1)
            here = np.arange(len(first))
            cut = low[here, pick] + _uniform(named, tree, 3, local) * (high - low)[here, pick]
            feature[at[split]], border[at[split]] = pick[split], cut[split]
            goes = np.repeat(split, length)
            right = values[np.arange(len(rows)), np.repeat(pick, length)] > np.repeat(cut, length)
            rows, node = rows[goes], (node + node % slots + right)[goes]
        place = np.ones(n, dtype=np.int64)
        live = np.arange(n)
        depth = np.zeros(n)
        for _level in range(rules.depth):
            spot = base[live] + place[live]
            inner = feature[spot] >= 0
            live, spot = live[inner], spot[inner]
            place[live] = 2 * place[live] + (features[live, feature[spot]] > border[spot])
            depth[live] += 1
        leaf = base + place
        beyond = ((features < least[leaf] - rules.ordinary) | (features > most[leaf] + rules.ordinary)).any(axis=1)
        total += depth + np.where(beyond, 1.0, _mean_path(size[leaf]))
    return 2.0 ** (-(total / rules.trees) / normal[source])


def _shifted(values: np.ndarray, source: np.ndarray, k: int) -> np.ndarray:
    """The value k places on (back, if negative) in the same source, else NaN."""
    out = np.full(len(values), np.nan)
    if abs(k) >= len(values):
        return out
    a, b = (slice(0, len(values) - k), slice(k, None)) if k > 0 else (slice(-k, None), slice(0, len(values) + k))
    out[a] = np.where(source[a] == source[b], values[b], np.nan)
    return out


def _median(columns: list[np.ndarray]) -> np.ndarray:
    """Row-wise median that leaves out NaN; NaN if there is nothing."""
    m = np.sort(np.stack(columns, axis=1), axis=1)
    have = np.sum(~np.isnan(m), axis=1)
    row = np.arange(len(m))
    mid = (m[row, np.maximum(have - 1, 0) // 2] + m[row, have // 2 - (have == m.shape[1]) * (have // 2 >= m.shape[1])]) / 2
    return np.where(have > 0, mid, np.nan)


def _momentary(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The smaller of two differences if both have one sign, else 0; a missing side counts like the other."""
    before, after = np.where(np.isnan(before), after, before), np.where(np.isnan(after), before, after)
    return np.nan_to_num(np.where(before * after > 0, np.where(np.abs(before) < np.abs(after), before, after), 0.0))


def judge(source: np.ndarray, at_us: np.ndarray, value: np.ndarray, floor: np.ndarray, possible: np.ndarray, rules: Rules, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, spike, stuck) of readings sorted by (source, time); `floor` is the least step of the reading's type.

    Impossible readings are scored in the forest of their source, but are nobody's neighbours. `keys` names
    the source of each reading for what its forest draws.
    """
    named = source if keys is None else keys
    source = np.cumsum(np.r_[True, source[1:] != source[:-1]]) - 1
    score, spike, stuck = np.full(len(value), 0.5), np.zeros(len(value), dtype=bool), np.zeros(len(value), dtype=bool)
    take = np.flatnonzero(possible)
    if not len(take):
        return score, spike, stuck
    n_source = source[-1] + 1
    p_source, p_value = source[take], value[take]
    fresh = np.r_[True, (p_source[1:] != p_source[:-1]) | (p_value[1:] != p_value[:-1])]
    unit = np.cumsum(fresh) - 1
    first = take[fresh]
    run = np.diff(np.r_[np.flatnonzero(fresh), len(take)])
    u_source, u_value = source[first], value[first]
    # The typical step of a source: mean of the lower three fifths of its steps, which spikes don't reach.
    step = np.abs(_shifted(u_value, u_source, -1) - u_value)
    has = np.flatnonzero(~np.isnan(step))
    order = has[np.lexsort((step[has], u_source[has]))]
    steps = np.bincount(u_source[has], minlength=n_source)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(steps) - steps, steps)
    low = rank < np.ceil(0.6 * steps[u_source[order]])
    typical = np.bincount(u_source[order][low], weights=step[order][low], minlength=n_source) / np.maximum(np.bincount(u_source[order][low], minlength=n_source), 1)
    # Impossible readings stand beside the units, each after the last possible unit before it.
    odd = np.flatnonzero(~possible)
    behind = np.cumsum(possible)[odd] - 1
    behind = np.where(behind >= 0, unit[np.maximum(behind, 0)], -1)
    a_source, a_value, a_at = np.r_[u_source, source[odd]], np.r_[u_value, value[odd]], np.r_[at_us[first], at_us[odd]]
    scale = np.maximum(typical[a_source] * 1.98, np.r_[floor[first], floor[odd]])

    def neighbour(k: int) -> np.ndarray:
        """The value k units on, or back if k is negative; NaN beyond the source."""
        at = behind + (k + 1 if k < 0 else k)
        fits = (at >= 0) & (at < len(u_value))
        at = np.clip(at, 0, len(u_value) - 1)
        return np.r_[_shifted(u_value, u_source, k), np.where(fits & (u_source[at] == source[odd]), u_value[at], np.nan)]

    before, after = _median([neighbour(-k) for k in range(1, rules.near + 1)]), _median([neighbour(k) for k in range(1, rules.near + 1)])
    previous, following = neighbour(-1), neighbour(1)
    level = _momentary(a_value - before, a_value - after)
    jump = _momentary(a_value - previous, a_value - following)
    # What the time of day adds to the level, from the possible readings.
    grows = np.arange(len(a_value)) < len(u_value)
    quarter = a_source * 4 + (a_at // (DAY // 4)) % 4
    daily = np.bincount(quarter[grows], weights=np.clip(level / scale, -rules.ordinary, rules.ordinary)[grows], minlength=4 * n_source) / np.maximum(np.bincount(quarter[grows], minlength=4 * n_source), 1)
    # How surprising a run is: the source repeats a reading with chance q, judged without the run itself.
    repeats, pairs = np.bincount(u_source, weights=run - 1, minlength=n_source), np.bincount(u_source, weights=run, minlength=n_source) - 1
    q = (repeats[u_source] - (run - 1) + rules.pairs * rules.repeats) / (pairs[u_source] - (run - 1) + rules.pairs)
    unlikely = np.r_[-(run - 1) * np.log(q) * (rules.ordinary / rules.surprise), np.zeros(len(odd))]
    features = np.clip(np.stack([level / scale, jump / scale, level / scale - daily[quarter], unlikely], axis=1), -rules.clip, rules.clip)
    if len(odd):
        order = np.lexsort((np.r_[np.arange(len(u_value)) * 2, behind * 2 + 1], a_source))
    else:
        order = np.arange(len(u_value))
    present, start, numbered = np.unique(a_source[order], return_index=True, return_inverse=True)
    named = np.r_[named[first], named[odd]][order][start]
    scores = np.empty(len(a_value))
    scores[order] = forest_scores(numbered, features[order], grows[order], rules, named)
    score[take], score[odd] = scores[: len(u_value)][unit], scores[len(u_value) :]
    # From here on units only. The kinds by shape: runs that leave both levels to one side, at once, and return.
    m = len(u_value)
    unusual = scores[:m] >= rules.unusual
    before, after, previous, following = before[:m], after[:m], previous[:m], following[:m]
    by_length = unlikely[:m] >= np.abs(features[:m, :3]).max(axis=1)
    is_spike = np.zeros(m, dtype=bool)
    for long in range(1, rules.longest + 1):
        if m < long:
            break
        head = np.flatnonzero(unusual[: m - long + 1])
        tail = head + long - 1
        held, least, most, all_ = run[head], u_value[head], u_value[head], u_source[head] == u_source[tail]
        for k in range(1, long):
            held, least, most = held + run[head + k], np.minimum(least, u_value[head + k]), np.maximum(most, u_value[head + k])
            all_ = all_ & unusual[head + k]
        with np.errstate(invalid="ignore"):
            height = np.maximum(least - np.maximum(after[tail], before[head]), np.minimum(after[tail], before[head]) - most)
            hit = all_ & (held <= rules.readings) & (height > 0)
            hit &= (np.abs(u_value[head] - previous[head]) >= rules.abrupt * height) & (np.abs(u_value[tail] - following[tail]) >= rules.abrupt * height)
        for k in range(long):
            is_spike[head[hit] + k] = True
    is_stuck = unusual & by_length & (run > 2)
    spike[take], stuck[take] = (is_spike & ~by_length)[unit], is_stuck[unit]
    return score, spike, stuck


#: Rows whose readings are judged at once, about: it decides nothing but the size of arrays.
BLOCK = 100_000
#: Fixed rows of a longer series that make up what is normal together, and those before and after them that are looked at besides.
WINDOW, CONTEXT = 100_000, 1_000


def _numbered(pdf: pd.DataFrame) -> np.ndarray:
    """The number of the series of each row of a sorted block."""
    a, b = pdf["series"].to_numpy(), pdf["series_too"].to_numpy()
    return np.cumsum(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def _verdicts(pdf: pd.DataFrame, rules: Rules) -> pd.DataFrame:
    """(row_id, score, reason) of the rows to report among readings sorted by (series, time, row_id, storing time)."""
    pdf = pdf[pdf["value"].notna()]
    if pdf.empty:
        return pd.DataFrame({"row_id": pdf["row_id"], "score": pdf["value"], "reason": pd.Series([], dtype=object)})
    row, series = pdf["row_id"].to_numpy(), _numbered(pdf)
    first = np.r_[True, (row[1:] != row[:-1]) | (series[1:] != series[:-1])]
    pdf, series = pdf[first], series[first]
    possible = pdf["possible"].to_numpy()
    # Without a source or time a reading has no neighbours: it is a series of its own.
    score, spike, stuck = judge(series, pdf["at_us"].to_numpy(), pdf["value"].to_numpy(), pdf["floor"].to_numpy(), possible, rules, pdf["series"].to_numpy())
    reason = np.where(~possible, "limit", np.where(stuck, "stuck", np.where(spike, "spike", None))).astype(object)
    return pd.DataFrame({"row_id": pdf["row_id"], "score": score, "reason": reason})[pdf["own"].to_numpy()]


def _judge_sorted(batches: Iterator[pd.DataFrame], rules: Rules) -> Iterator[pd.DataFrame]:
    """Verdicts of one partition: whole series together, in blocks.

    A series of more than WINDOW rows is judged window by window, counted from its first row, each with CONTEXT
    rows on both sides. So a verdict depends on the series alone, not on the blocks or on other series.
    """
    ready: list[pd.DataFrame] = []
    waiting, size, lead = None, 0, 0
    for batch in batches:
        block = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        if not len(block):
            continue
        series = _numbered(block)
        starts = np.flatnonzero(np.r_[True, series[1:] != series[:-1]])
        ends = np.r_[starts[1:], len(block)]
        long = ends - starts >= WINDOW
        # Of the rows that waited `lead` are context. All series but the last are complete; short ones go on together.
        low = 0
        for k in [*np.flatnonzero(long[:-1]), len(starts) - 1]:
            if starts[k] > low:
                ready.append(_context(block.iloc[low : starts[k]], lead))
                size, lead = size + starts[k] - low, 0
            pieces, rest, lead = _windows(block.iloc[starts[k] : ends[k]], lead)
            yield from (_verdicts(p, rules) for p in pieces)
            low = ends[k]
            if k < len(starts) - 1:
                ready.append(_context(rest, lead))
                size, lead = size + len(rest), 0
            else:
                waiting = rest
        if size >= BLOCK:
            yield _verdicts(pd.concat(ready, ignore_index=True), rules)
            ready, size = [], 0
    if waiting is not None:
        ready.append(_context(waiting, lead))
    if ready:
        yield _verdicts(pd.concat(ready, ignore_index=True), rules)


def _windows(rows: pd.DataFrame, lead: int) -> tuple[list[pd.DataFrame], pd.DataFrame, int]:
    """The full windows of one series' rows, the rows that are left, and how many of these are context."""
    pieces = []
    while len(rows) >= lead + WINDOW + CONTEXT:
        piece = rows.iloc[: lead + WINDOW + CONTEXT]
        own = piece["own"].to_numpy().copy()
        own[lead + WINDOW :] = False
        pieces.append(_context(piece.assign(own=own), lead))
        rows, lead = rows.iloc[lead + WINDOW - CONTEXT :], CONTEXT
    return pieces, rows, lead


def _context(rows: pd.DataFrame, lead: int) -> pd.DataFrame:
    """`rows` with the first `lead` as context only."""
    if not lead:
        return rows
    own = rows["own"].to_numpy().copy()
    own[:lead] = False
    return rows.assign(own=own)


def score_readings(readings: DataFrame, stretch_days: int = 60, overlap_days: int = 6, rules: Rules = Rules()) -> DataFrame:
    """(row_id, score, reason) of each reading; reason is `limit`, `spike`, `stuck` or null.

    `readings` has (row_id, source, at_us, stored_us, value, possible, floor): possible says whether
    the value is within its physical limits, floor is the least step that counts as typical. Of rows
    with one row_id that with the least stored_us counts. Impossible readings (`limit`) are scored like
    others, but don't count as their neighbours. Rows with a null row_id or value are left out; with a null source
    or time only the limits are applied. Readings at one time are taken in the order of row_id.
    Sources of one or two readings get the neutral score 0.5 and no flag. Copies of a row must agree
    in source and time, so that they meet.

    What is normal is that of a stretch of `stretch_days` around a reading, with `overlap_days` on both sides, and
    within a stretch of more than WINDOW rows that of WINDOW rows. A task goes through its sorted series as a
    stream and holds one block and one window, however long a series is. Verdicts depend on the data alone,
    not on partitions, blocks or batches.
    """
    ship(readings.sparkSession)
    length, margin = stretch_days * DAY, overlap_days * DAY
    # Null values are dropped in the tasks: a filter here would be pushed below the expressions that
    # compute the value, and compute them twice.
    rows = readings.where("row_id is not null").withColumn("known", F.expr("source is not null and at_us is not null"))
    rows = rows.withColumn("at_us", F.coalesce("at_us", F.lit(0)))
    own = F.expr(f"at_us div {length}")
    # A reading near a border also stands in the next stretch, where it is context only.
    spans = F.array_distinct(F.array(own, F.expr(f"(at_us - {margin}) div {length}"), F.expr(f"(at_us + {margin}) div {length}")))
    rows = rows.withColumn("own", own).withColumn("stretch", F.explode(spans)).withColumn("own", F.col("own") == F.col("stretch"))
    # Without a source a row is a series of its own. Two hashes make a key of 128 bits, so that no two sources share one.
    part = lambda salt: F.when(F.col("known"), F.xxhash64(F.lit(salt), "source", "stretch")).otherwise(F.xxhash64(F.lit(salt), "row_id"))
    rows = rows.select(part(0).alias("series"), part(1).alias("series_too"), "row_id", "at_us", "stored_us", "value", "floor", "possible", "own")
    order = ["series", "series_too", "at_us", "row_id", F.asc_nulls_last("stored_us")]
    kind = dict(readings.dtypes)["row_id"]
    return rows.repartition("series", "series_too").sortWithinPartitions(*order).mapInPandas(
        lambda batches: _judge_sorted(batches, rules), f"row_id {kind}, score double, reason string")
