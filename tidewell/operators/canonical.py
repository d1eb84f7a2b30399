"""One long form for events of any source, range cleaning and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.sources import first_deliveries

#: Column -> SQL expression over the source table; what a source lacks is null.
SOURCES = {
    "features": {"subject_id": "subject_id", "hadm_id": "hadm_id", "stay_id": "stay_id", "time": "time", "modality": "modality", "type": "type",
                 "value_num": "value_num", "value_txt": "value_txt", "uom": "uom", "is_intervention": "is_intervention", "_once": "event_id", "_stored": "storetime"},
    "events": {"subject_id": "user_id", "time": "ts", "modality": "'web'", "type": "event_type", "value_num": "value", "value_txt": "props", "is_intervention": "event_type = 'purchase'"},
    "lineitem": {"subject_id": "o_custkey", "time": "l_shipdate", "modality": "'trade'", "type": "l_returnflag", "value_num": "l_quantity", "is_intervention": "false"},
}

# Form of the event stream.
_COLUMNS = {"subject_id": "bigint", "hadm_id": "bigint", "stay_id": "bigint", "time": "timestamp_ntz", "modality": "string", "type": "string",
            "value_num": "double", "value_txt": "string", "uom": "string", "is_intervention": "boolean"}

# Possible range of each ranged type (type: low, high).
RANGES = {
    "220045": (0, 300), "220210": (0, 80), "224690": (0, 80), "220277": (0, 100),
    "220179": (0, 300), "220180": (0, 200), "220181": (0, 250), "220050": (0, 300), "220051": (0, 200), "220052": (0, 250),
    "223761": (70, 115), "223762": (20, 45),
    "50912": (0, 50), "50983": (50, 200), "50971": (0, 15), "50902": (50, 200), "50882": (0, 60), "50868": (0, 50), "51006": (0, 300),
    "50931": (0, 2000), "50813": (0, 40), "51222": (0, 30), "51221": (0, 100), "51301": (0, 200), "51265": (0, 2000), "50960": (0, 10),
    "50970": (0, 30), "50893": (0, 30), "51237": (0, 30), "50885": (0, 100),
}
#: Largest magnitude of a type without a range, and the modalities that are cleaned.
GLOBAL_CAP = 1e6
CLEANED = ("chart", "lab")


def shard(subject: Column) -> Column:
    """`p` and the first two digits of the subject."""
    return F.concat(F.lit("p"), F.substring(subject.cast("string"), 1, 2))


def canonical(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """`df` in the form of the event stream, with its shard.

    NaN becomes null, and a value that can't be cast becomes null. A spec with `_once` names the id
    of an event, with `_stored` the time a row was stored and plain columns otherwise; of rows with one id the
    first delivery counts (ties by their values), and rows without an id aren't counted.
    """
    if "_once" in spec:
        plain = {c for k, c in spec.items() if not k.startswith("_")}
        df = first_deliveries(df, [c for c in df.columns if c in plain], spec["_once"], spec["_stored"])
    out = df.select(*[F.expr(f"try_cast({spec[c]} as {kind})").alias(c) if c in spec else F.lit(None).cast(kind).alias(c) for c, kind in _COLUMNS.items()])
    return out.withColumn("value_num", F.nanvl("value_num", F.lit(None).cast("double"))).withColumn("shard", shard(F.col("subject_id")))


def clean(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None, cap: float = GLOBAL_CAP, modalities: tuple[str, ...] = CLEANED) -> DataFrame:
    """`df` with the column keep.

    A ranged type is kept if its value is there and in range; another type if its value is
    missing or not beyond the cap; modalities that aren't cleaned are kept. NaN counts as missing.
    """
    dim = df.sparkSession.createDataFrame([(t, float(a), float(b)) for t, (a, b) in (ranges or RANGES).items()], "_type string, _lo double, _hi double")
    value = F.nanvl("value_num", F.lit(None).cast("double"))
    rows = df.join(F.broadcast(dim), df["type"] == F.col("_type"), "left")
    ranged = F.coalesce(value.between(F.col("_lo"), F.col("_hi")), F.lit(False))
    other = value.isNull() | (F.abs(value) <= cap)
    keep = F.when(~F.col("modality").isin(*modalities), True).when(F.col("_type").isNotNull(), ranged).otherwise(other)
    return rows.withColumn("keep", F.coalesce(keep, F.lit(True))).drop("_type", "_lo", "_hi")


def profile(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts, filled shares, value range and distinct counts of each group, in one pass.

    Distinct shards, flags and types are few by nature (of two digits, two values, the types of an item
    table), so their sets are aggregated as they are instead of expanding every row for each.
    """
    share = lambda c: F.round(F.count(c) / F.count(F.lit(1)), 9)
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share("value_num").alias("filled_num"), share("value_txt").alias("filled_txt"), share("uom").alias("filled_uom"),
        F.min("value_num").alias("low"), F.max("value_num").alias("high"), F.round(F.avg("value_num"), 6).alias("mean"),
        F.size(F.collect_set("shard")).alias("shards"), F.size(F.collect_set("is_intervention")).alias("flags"), F.size(F.collect_set("type")).alias("types"),
        at(F.min("time")).alias("first_at"), at(F.max("time")).alias("last_at"))


def plausibility(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Verdict for each expected (type, label, lo, hi): NOT FOUND, OUT OF RANGE or OK."""
    seen = df.groupBy("type").agg(F.count("value_num").alias("n"), F.min("value_num").alias("low"), F.max("value_num").alias("high"))
    joined = expected.join(seen, "type", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = (F.col("low") < F.col("lo")) | (F.col("high") > F.col("hi"))
    return joined.select("type", "label", "n", "low", "high", F.when(F.col("n") == 0, "NOT FOUND").when(out, "OUT OF RANGE").otherwise("OK").alias("verdict"))
