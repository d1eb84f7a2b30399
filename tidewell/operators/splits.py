"""Splits that keep the records of a group together, with given shares.

Groups are combined into bins of nearly equal weight by largest differencing: the extreme
weights (one that is far above and one that is far below) are put together again and
again. First the heavy groups, which are few by definition, are combined into `bins` sums. Then blocks
of light groups are combined by many tasks: each block starts from its part of those sums, and its
groups fill them up, so the bins of a block are even whatever the heavy groups left. The same bins
of all blocks are one bin, which is relatively as even as a block's. Whole bins go to the splits by
how far each is from its target.
"""

from __future__ import annotations

import heapq
import random

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewell.session import cut, ship


def difference(weights: list[float], bins: int, start: list[float] | None = None) -> list[int]:
    """Bin of each weight, by largest differencing into `bins` bins, which may hold `start` before.

    Every weight starts as a tuple with itself in one bin. The two tuples with the largest
    spread are combined, largest sums with smallest, until one tuple is left.
    """
    heap: list[tuple] = []
    for i, w in enumerate(weights):
        heap.append((-float(w), i, [(float(w), [i])]))
    if start is not None:
        # What is there already is a tuple too; bin k is marked by the id -1 - k.
        first = sorted(((float(w), [-1 - k]) for k, w in enumerate(start)), key=lambda p: -p[0])
        heap.append((first[-1][0] - first[0][0], len(weights), first))
    heapq.heapify(heap)
    serial = len(weights) + 1
    while len(heap) > 1:
        _, _, x = heapq.heappop(heap)
        _, _, y = heapq.heappop(heap)
        # Tuples are kept without their empty bins, heaviest first: heavy bins of one meet light bins of the other.
        free = bins - len(x)
        merged = x + y[:free] if free else list(x)
        rest = y[free:] if free else y
        merged.sort(key=lambda p: p[0])
        for k, (w, ids) in enumerate(rest):
            v, have = merged[k]
            merged[k] = (v + w, have + ids)
        merged.sort(key=lambda p: -p[0])
        low = merged[-1][0] if len(merged) == bins else 0.0
        heapq.heappush(heap, (-(merged[0][0] - low), serial, merged))
        serial += 1
    out = [0] * len(weights)
    for b, (_, ids) in enumerate(heap[0][2] if heap else []):
        marked = -1 - min(ids) if start is not None else b
        for i in ids:
            if i >= 0:
                out[i] = marked
    return out


def _allocate(bins: list[tuple[str, float]], targets: list[tuple[str, float]]) -> dict[str, str]:
    """Whole bins to splits: heaviest first, each to the split that lacks the largest part of its target."""
    total = sum(w for _, w in bins)
    want = {s: share * total for s, share in targets if s is not None and share}
    have = dict.fromkeys(want, 0.0)
    chosen = {}
    for b, w in sorted(bins, key=lambda p: (-p[1], p[0])):
        s = max(want, key=lambda k: ((want[k] - have[k] - max(0.0, have[k] + w - want[k]) * 2), k))
        have[s] += w
        chosen[b] = s
    return chosen


def balanced_splits(groups: DataFrame, targets: list[tuple[str, float]], bins: int = 200, block: int = 20_000) -> DataFrame:
    """`groups` (group_id, weight) with the column split added.

    Heavy are the groups above a `block`-th of the whole weight: fewer than `block`, one task. Light groups
    are combined in blocks of about `block`. Equal weights are taken in the order of a hash of group_id, so
    the result depends on the data alone. A null weight counts as zero, a null group_id is
    left out. Repeated group_ids must be summed before. Shares are relative; a split with
    share zero or null gets nothing. Without groups the result is empty.
    """
    ship(groups.sparkSession)
    rows = groups.where("group_id is not null").select("group_id", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    rows = cut(rows.withColumn("tie", F.xxhash64("group_id")))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).first()
    blocks, limit = max(1, -(-whole.n // block)), (whole.weight or 0.0) / block
    kind = dict(rows.dtypes)["group_id"]

    def combine(light: bool, start: list[float]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["weight", "tie", "group_id"], ascending=[False, True, True], ignore_index=True)
            # Bins that hold the same are taken in another order in each block, so that no bin is always first.
            order = list(range(bins))
            random.Random(int(pdf["block"].iloc[0])).shuffle(order)
            pdf["bin"] = [order[b] for b in difference(pdf["weight"].tolist(), bins, [start[k] for k in order])]
            return pdf[["group_id", "weight", "bin"]]

        part = rows.where(F.col("weight") <= limit if light else F.col("weight") > limit)
        part = part.withColumn("block", F.pmod("tie", F.lit(blocks)).cast("int") if light else F.lit(-1))
        return part.groupBy("block").applyInPandas(run, f"group_id {kind}, weight double, bin int")

    heavy = cut(combine(False, [0.0] * bins))
    # At most `bins` rows here and below, whatever the input: the only things the driver sees.
    sums = {r.bin: r.weight for r in heavy.groupBy("bin").agg(F.sum("weight").alias("weight")).collect()}
    placed = cut(heavy.unionByName(combine(True, [sums.get(k, 0.0) / blocks for k in range(bins)])))
    slots = placed.groupBy("bin").agg(F.sum("weight").alias("weight")).collect()
    chosen = _allocate([(str(r.bin), r.weight) for r in slots], targets)
    split_of = groups.sparkSession.createDataFrame([(int(k), v) for k, v in chosen.items()], "bin int, split string")
    return placed.join(F.broadcast(split_of), "bin").select("group_id", "weight", "split")
