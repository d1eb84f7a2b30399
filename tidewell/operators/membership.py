"""A filter of bounded size in front of a join.

`may_contain` keeps the rows whose key may occur among `keys` and drops most others
before they are shuffled. The keys are hashed into a bit table of 2**bits bits, kept as
rows of 64 bits; whatever the number of keys, it never has more than 2**bits / 64 rows,
so it can be broadcast. A row is dropped only if its key surely isn't among the keys;
the join that follows decides about the rest. If the keys fill the table, nothing is
dropped and the join still gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bits_for(keys: int, most: int = 25) -> int | None:
    """Size of the bit table for so many keys: 32 bits and more for each, at most 2**most; None if the keys would fill that, so that it filters too little."""
    return None if keys * 4 > 1 << most else max(10, min(most, (keys * 32).bit_length()))


def may_contain(df: DataFrame, key: list[Column], keys: DataFrame, bits: int = 24) -> DataFrame:
    """The rows of `df` whose `key` may be among the rows of `keys` (same column types, in order).

    A null in the key counts as a value. With no keys the result is empty. Names that begin
    with `_mc_` are reserved.
    """
    spot = lambda cols: F.xxhash64(*cols).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        keys.select(spot([F.col(c) for c in keys.columns]).alias("_mc_p")).distinct()
        .groupBy(F.shiftright("_mc_p", 6).alias("_mc_w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(_mc_p & 63 as int)))").alias("_mc_word"))
    )
    marked = df.withColumn("_mc_p", spot(key)).withColumn("_mc_w", F.shiftright("_mc_p", 6))
    hit = marked.join(F.broadcast(words), "_mc_w")
    return hit.where(F.expr("(shiftrightunsigned(_mc_word, cast(_mc_p & 63 as int)) & 1) = 1")).drop("_mc_p", "_mc_w", "_mc_word")
