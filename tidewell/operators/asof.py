"""Attributes as known at event time, by dyadic time nodes.

Each attribute row is valid over a half-open interval of event time. Time is cut into
granules of 2**grain microseconds; the granules of an interval are covered by few nodes of
a binary tree over time (level, index). An event looks up the node of its own granule on
every level, so "is inside the interval" becomes an equi-join on (entity, level, index)
that hashes and spreads like any other: no range join, and a hot entity is spread over its
nodes and, on top, over `salts` parts of each node. The nodes at an interval's ends
cover a little too much; the exact half-open test after the join removes that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.operators.membership import bits_for, may_contain
from tidewell.session import cut


def dyadic_cover(start_us: Column, end_us: Column, grain: int, levels: int) -> Column:
    """array<bigint>: nodes that cover [start, end). Node index i of level k is written
    i * 64 + k. `levels` must satisfy 2**levels >= granules of the longest interval."""
    first, after = F.shiftright(start_us, grain), F.shiftright(end_us - 1, grain) + 1
    nodes = []
    for k in range(levels + 1):
        low, high = F.shiftright(first + ((1 << k) - 1), k), F.shiftright(after, k)
        # The root level takes whatever is left, so that nothing is lost above it.
        odd_low = (low < high) & (low.bitwiseAND(1) == 1) if k < levels else low < high
        odd_high = (low < high) & (high.bitwiseAND(1) == 1) if k < levels else F.lit(False)
        nodes += [F.when(odd_low, low * 64 + k), F.when(odd_high, (high - 1) * 64 + k)]
    return F.filter(F.array_distinct(F.array(*nodes)), lambda x: x.isNotNull())


def enclosing_nodes(at_us: Column, grain: int, levels: int) -> Column:
    """array<bigint>: the node of every level that holds the instant."""
    return F.array(*[F.shiftright(at_us, grain + k) * 64 + k for k in range(levels + 1)])


def valid_at(
    events: DataFrame, attributes: DataFrame, entity: str, at_us: str, valid_from: Column, valid_to: Column,
    longest_us: int, grain: int = 36, salts: int = 4, salt_by: str | None = None, prefilter_bits: int | None = None,
) -> DataFrame:
    """Pairs of an event and an attribute row that is valid at its time: all columns of
    `attributes` and the event's `at_us`.

    `events` has (entity, at_us), distinct; `attributes` holds the columns named in
    `valid_from` and `valid_to` (microseconds, half-open) and an `entity` column. Intervals
    are at most `longest_us` long. Null entities, times and bounds and empty intervals match
    nothing. Repeated attribute rows match repeatedly; those with one `salt_by` value fall into
    one part. A column of `attributes` named like `at_us` is dropped, names that begin with `_va_`
    are reserved. Empty inputs give an empty result.
    """
    attributes = attributes.drop(at_us)
    levels = max(1, ((longest_us >> grain) + 1).bit_length())
    span = attributes.withColumn("_va_from", valid_from).withColumn("_va_to", valid_to).where("_va_from < _va_to").where(F.col(entity).isNotNull())
    asks = cut(events.where(F.col(entity).isNotNull() & F.col(at_us).isNotNull()))
    # Rows of entities and times without any event needn't be shuffled. Time is cut into quarters of the longest
    # interval, so an event can only be met by intervals that begin in its quarter or the four before.
    quarter = max(1, longest_us // 4)
    begins = F.array(*[F.expr(f"{at_us} div {quarter}") - k for k in range(-(-longest_us // quarter) + 1)])
    # The table has room for the events there are; beyond its largest size nothing is dropped here.
    bits = prefilter_bits or bits_for(asks.count() * (-(-longest_us // quarter) + 1))
    if bits:
        near = asks.select(F.col(entity), F.explode(begins).alias("_va_begin"))
        span = may_contain(span, [F.col(entity), F.expr(f"_va_from div {quarter}")], near, bits)
    part = F.pmod(F.xxhash64(salt_by), F.lit(salts)) if salt_by else F.pmod(F.xxhash64(*attributes.columns), F.lit(salts))
    nodes = span.withColumn("_va_part", part.cast("int")).withColumn("_va_node", F.explode(dyadic_cover(F.col("_va_from"), F.col("_va_to"), grain, levels)))
    asked = asks.select(F.col(entity), F.col(at_us), F.explode(enclosing_nodes(F.col(at_us), grain, levels)).alias("_va_node")).withColumn(
        "_va_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # The bounds are computed again after the join: two columns less to shuffle.
    joined = nodes.drop("_va_from", "_va_to").join(asked, [entity, "_va_node", "_va_part"])
    return joined.where(F.col(at_us).between(valid_from, valid_to - 1)).drop("_va_node", "_va_part")
