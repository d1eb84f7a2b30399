"""Filling containers of fixed capacity by best-fit decreasing, over the whole corpus.

Sizes are whole numbers up to the capacity, so all that best fit needs to know is how many
items there are of each size: a histogram of at most `capacity` rows, however large the
corpus is. `plan_bins` runs best-fit decreasing on it. Bins with the same remaining
capacity are alike, so it moves ranges of bins at once; a segment tree over the remaining
capacities finds the tightest that fits. The plan says which ranks of each size go to which
bins. The items get their ranks in parallel, with each size split into salted parts, and
look up their bin: no size, however common, is gathered in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidewell.session import ship

#: Items ranked in one task, about, even if all have one size, and parts of each size at least.
PART, SALTS = 1_000_000, 32


class Remaining:
    """Segment tree over remaining capacities 0..capacity: the least one that is present and large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        k = remaining + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def tightest(self, size: int) -> int:
        """Least present remaining capacity >= size, or -1."""
        k = size + self.leaves
        if self.count[k]:
            return size
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1


def plan_bins(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on a histogram (size, n) with 0 < size <= capacity.

    Returns (size, first_rank, n, first_bin, each): the n items of the size from first_rank on
    go to consecutive bins from first_bin, `each` to a bin (the last may get fewer). Among
    equally tight bins those opened first are taken.
    """
    tree, open_bins, bins, plan = Remaining(capacity), {}, 0, []

    def leave(remaining: int, low: int, high: int) -> None:
        if high > low:
            open_bins.setdefault(remaining, []).append((low, high))
            tree.add(remaining, high - low)

    for size, n in sorted(sizes, reverse=True):
        rank = 0
        while n:
            room = tree.tightest(size)
            if room < 0:
                room, low = capacity, bins
                each = capacity // size
                high = low + -(-n // each)
                bins = high
            else:
                ranges = open_bins[room]
                at = min(range(len(ranges)), key=ranges.__getitem__)
                low, high = ranges.pop(at)
                tree.add(room, low - high)
                each = room // size
                used = min(high - low, -(-n // each))
                leave(room, low + used, high)
                high = low + used
            placed = min(n, (high - low) * each)
            plan.append((size, rank, placed, low, each))
            whole = placed // each
            leave(room - each * size, low, low + whole)
            if placed % each:
                leave(room - placed % each * size, low + whole, low + whole + 1)
            rank += placed
            n -= placed
    return plan


def pack(items: DataFrame, capacities: DataFrame, key: str, size: str, salts: int | None = None) -> DataFrame:
    """(pack_name, key, piece, start, length, container) for each piece of each item and pack.

    `items` (key, size) with one row for each key, read twice: give it as a written table if it
    is costly. `capacities` (pack_name, capacity_tokens). An item longer than the capacity is
    cut: every full piece has a container of its own, named after the item, and what is left
    is packed like any other item; all other items are one piece. Items of size 0 or null
    and null keys need no place and have no row. Equal sizes are ranked by key, so the result
    depends on the data alone. Capacities that are null or below 1, and repeated ones, are left out.
    """
    ship(items.sparkSession)
    packs = capacities.select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).where("pack_name is not null and capacity > 0").distinct()
    rows = items.where(F.col(key).isNotNull() & (F.col(size) > 0)).select(F.col(key).alias("_key"), F.col(size).cast("long").alias("_size"))
    salts = salts or max(SALTS, -(-rows.count() // PART))
    # The packs are a handful of names by nature; each item is written out once for each of them.
    choices = F.array(*[F.struct(F.lit(r.pack_name).alias("pack_name"), F.lit(r.capacity).alias("capacity")) for r in sorted(packs.collect())]).cast("array<struct<pack_name: string, capacity: bigint>>")
    each = rows.select("_key", "_size", F.inline(choices))
    cut = each.withColumn("_full", F.when(F.col("_size") > F.col("capacity"), F.expr("_size div capacity")).otherwise(0)).withColumn("_rest", F.col("_size") - F.col("_full") * F.col("capacity"))
    full = cut.where("_full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1))).select(
        "pack_name", F.col("_key").alias(key), "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("length"),
        F.concat_ws("-", F.lit("own"), F.col("_key").cast("string"), F.col("piece").cast("string")).alias("container"))
    rest = cut.where("_rest > 0").withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int"))

    parts = rest.groupBy("pack_name", "capacity", "_rest", "_salt").agg(F.count(F.lit(1)).alias("n"))
    offset = F.sum("n").over(Window.partitionBy("pack_name", "_rest").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.withColumn("_before", F.coalesce(offset, F.lit(0)))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        got = plan_bins(list(zip(pdf["_rest"].tolist(), pdf["n"].tolist())), int(pdf["capacity"].iloc[0]))
        out = pd.DataFrame(got, columns=["_rest", "at", "n", "low", "each"])
        out.insert(0, "pack_name", pdf["pack_name"].iloc[0])
        return out

    # One group for each pack; its rows are sizes, so there are at most `capacity` of them.
    histogram = parts.groupBy("pack_name", "capacity", "_rest").agg(F.sum("n").alias("n"))
    steps = histogram.groupBy("pack_name").applyInPandas(plan, "pack_name string, _rest long, at long, n long, low long, each long")
    of_size = steps.groupBy("pack_name", "_rest").agg(F.array_sort(F.collect_list(F.struct("at", "n", "low", "each"))).alias("steps"))
    places = offsets.select("pack_name", "_rest", "_salt", "_before").join(of_size, ["pack_name", "_rest"])
    rank = F.row_number().over(Window.partitionBy("pack_name", "_rest", "_salt").orderBy("_key")) - 1
    ranked = rest.withColumn("_r", rank).join(places, ["pack_name", "_rest", "_salt"]).withColumn("_r", F.col("_r") + F.col("_before"))
    step = F.element_at(F.filter("steps", lambda s: (s["at"] <= F.col("_r")) & (F.col("_r") < s["at"] + s["n"])), 1)
    packed = ranked.withColumn("_s", step).select(
        "pack_name", F.col("_key").alias(key), F.col("_full").alias("piece"), (F.col("_full") * F.col("capacity")).alias("start"), F.col("_rest").alias("length"),
        F.concat_ws("-", F.lit("bin"), F.expr("_s.low + (_r - _s.at) div _s.each").cast("string")).alias("container"))
    return full.unionByName(packed)
