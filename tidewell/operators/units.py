"""Values recorded in different units, brought to one unit for each quantity.

Conversions are edges of a graph: `to = scale * from + offset`. `compose` finds the
shortest composition of edges between each pair of units of a quantity and checks every
edge that closes a cycle against it, so that the table can't contradict itself. The
compositions are a fixed small table; rows reach it by an equi-join on quantity and unit.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Conversion factors. (quantity, from, to, scale, offset)
EDGES = [
    ("temperature", "F", "C", 5 / 9, -160 / 9), ("temperature", "K", "C", 1.0, -273.15), ("temperature", "C", "K", 1.0, 273.15),
    ("share", "%", "fraction", 0.01, 0.0),
    ("mass", "lb", "kg", 0.45359237, 0.0), ("mass", "g", "kg", 0.001, 0.0), ("mass", "oz", "lb", 1 / 16, 0.0),
    ("glucose", "mmol/L", "mg/dL", 18.016, 0.0),
    ("creatinine", "umol/L", "mg/dL", 1 / 88.42, 0.0),
    ("lactate", "mg/dL", "mmol/L", 1 / 9.008, 0.0),
    ("hemoglobin", "g/L", "g/dL", 0.1, 0.0),
    ("volume", "L", "mL", 1000.0, 0.0), ("volume", "cL", "mL", 10.0, 0.0), ("volume", "L", "cL", 100.0, 0.0),
    ("pressure", "kPa", "mmHg", 7.50062, 0.0),
    ("rate", "Hz", "1/min", 60.0, 0.0),
]

# Spellings, lower case and without spaces; mu and micro sign are written u.
SPELLINGS = {
    "C": ["c", "degc", "deg.c", "°c", "celsius"], "F": ["f", "degf", "deg.f", "°f", "fahrenheit"], "K": ["k", "kelvin"],
    "fraction": ["fraction", "frac", "fio2"], "%": ["%", "pct", "percent", "vol%"],
    "kg": ["kg", "kilograms", "kilogram", "kgs"], "lb": ["lb", "lbs", "pounds", "pound"], "g": ["g", "grams"], "oz": ["oz", "ounces"],
    "mmol/L": ["mmol/l", "mm"], "mg/dL": ["mg/dl"], "umol/L": ["umol/l", "mcmol/l", "micromol/l"],
    "g/dL": ["g/dl", "gm/dl"], "g/L": ["g/l", "gm/l"],
    "mL": ["ml", "cc", "milliliters"], "L": ["l", "liters", "litres"], "cL": ["cl"],
    "mmHg": ["mmhg"], "kPa": ["kpa"], "1/min": ["bpm", "insp/min", "/min", "1/min"], "Hz": ["hz"],
}

# The quantity of each item type.
QUANTITY = {
    "220045": "rate", "220052": "pressure", "220050": "pressure", "220210": "rate", "220277": "share", "223762": "temperature",
    "223835": "share", "224639": "mass", "50931": "glucose", "50912": "creatinine", "50813": "lactate", "51222": "hemoglobin",
    "226559": "volume", "226560": "volume", "225158": "volume", "225828": "volume",
}

# Types in which a foreign unit without a mark occurs and can be told by the size of the value.
BY_SIZE = {"223762": ["F"], "223835": ["%"], "224639": ["lb"], "50931": ["mmol/L"], "50912": ["umol/L"], "50813": ["mg/dL"], "51222": ["g/L"]}


def compose(edges: list[tuple[str, str, str, float, float]], tolerance: float = 1e-6) -> dict[tuple[str, str, str], tuple[float, float]]:
    """(quantity, from, to) -> (scale, offset) over the fewest edges, both directions.

    Raises ValueError where two ways between the same units differ by more than `tolerance`.
    """
    out: dict = defaultdict(list)
    for q, a, b, s, o in edges:
        out[q, a].append((b, s, o))
        out[q, b].append((a, 1 / s, -o / s))
    found = {}
    for q, a in list(out):
        found[q, a, a] = (1.0, 0.0)
        queue = deque([a])
        while queue:
            b = queue.popleft()
            s0, o0 = found[q, a, b]
            for c, s, o in out[q, b]:
                way = (s * s0, s * o0 + o)
                if (q, a, c) not in found:
                    found[q, a, c] = way
                    queue.append(c)
                elif any(not math.isclose(x, y, rel_tol=tolerance, abs_tol=tolerance) for x, y in zip(found[q, a, c], way)):
                    raise ValueError(f"units of {q}: the ways from {a} to {c} differ: {found[q, a, c]} and {way}")
    return found


def spelling(c: Column) -> Column:
    """A unit's text in the form of SPELLINGS: lower case, without white space, mu as u."""
    return F.translate(F.lower(c), "µμ \t\n\r\u00a0", "uu")


def text_number(c: Column) -> Column:
    """The first number in a text, with a point or a comma; null if there is none."""
    return F.regexp_replace(F.regexp_extract(c, r"-?\d+(?:[.,]\d+)?", 0), ",", ".").try_cast("double")


def text_unit(c: Column) -> Column:
    """What is left of a text without its number and remarks, as a spelling."""
    rest = F.regexp_replace(F.lower(c), r"\([^)]*\)|approx\.?|about|~|=|-?\d+(?:[.,]\d+)?", "")
    return spelling(rest)


def _tables(spark: SparkSession, items: DataFrame, edges: list) -> tuple[DataFrame, DataFrame]:
    """The item types with their common and other unit, and all (type, spelling) with their conversion.

    Both come from `items`, of which there is one row for each type, and from the fixed values above.
    """
    ways = compose(edges)
    units = sorted({(q, u) for q, a, b, _, _ in edges for u in (a, b)})
    plain = lambda u: "".join(u.lower().replace("µ", "u").replace("μ", "u").split())
    dim, known = [], []
    for r in items.where("type is not null and common_uom is not null").dropDuplicates(["type"]).select("type", "common_uom", "lo", "hi").collect():
        q = QUANTITY.get(r.type)
        common = next((u for k, u in units if k == q and plain(r.common_uom) in SPELLINGS[u]), None)
        if common is None:
            continue
        other = next((u for u in BY_SIZE.get(r.type, []) if u != common), None)
        dim.append((r.type, common, r.lo, r.hi, other, *(ways[q, other, common] if other else (None, None))))
        known += [(r.type, s, u, *ways[q, u, common]) for k, u in units if k == q and (q, u, common) in ways for s in SPELLINGS[u]]
    return (
        spark.createDataFrame(dim, "_u_type string, common_unit string, _u_lo double, _u_hi double, _u_other string, _u_oscale double, _u_ooffset double"),
        spark.createDataFrame(known, "_u_type string, spelling string, unit string, scale double, offset double"),
    )


def to_common(df: DataFrame, items: DataFrame) -> DataFrame:
    """`df` (type, value_num, value_txt, uom) with the columns value, recorded_unit,
    common_unit and common_value added.

    The unit is the one in value_txt, else that of uom, else the common one. Where value_txt
    names none, a unit of BY_SIZE replaces it if only that fits the size of the value: for
    units at least tenfold apart, if it brings the value nearer (as a ratio) to the middle of
    the item's possible range and into it; for closer units, if the value is impossible as
    written and possible in the other unit. Missing values, unknown types and unknown units
    give null; value is value_num or, where that is null, the number in value_txt. Other
    columns stay; columns with one of the new names are replaced, names that begin with `_u_` are reserved.
    `items` (type, common_uom, lo, hi) has one row for each type and is small by nature; its
    conversions are looked up on the driver and joined as small tables.
    """
    df = df.drop("value", "recorded_unit", "common_unit", "common_value")
    dim, known = _tables(df.sparkSession, items, EDGES)
    rows = df.withColumn("value", F.coalesce("value_num", text_number(F.col("value_txt"))))
    rows = rows.withColumn("_u_in_text", F.when(F.col("value_txt").rlike(r"\d"), text_unit(F.col("value_txt")))).withColumn("_u_in_uom", spelling(F.col("uom")))
    lookup = lambda k: known.select(*[F.col(c).alias(f"_u_{n}{k}") for c, n in (("_u_type", "t"), ("spelling", "s"), ("unit", "u"), ("scale", "a"), ("offset", "b"))])
    rows = (
        rows.join(F.broadcast(dim), F.col("type") == F.col("_u_type"), "left")
        .join(F.broadcast(lookup(1)), (F.col("type") == F.col("_u_t1")) & (F.col("_u_in_text") == F.col("_u_s1")), "left")
        .join(F.broadcast(lookup(2)), (F.col("type") == F.col("_u_t2")) & (F.col("_u_in_uom") == F.col("_u_s2")), "left")
    )
    # Each step is a column of its own, so that it is computed once.
    rows = rows.withColumns({"_u_said": F.coalesce("_u_u1", "_u_u2", "common_unit"), "_u_scale": F.coalesce("_u_a1", "_u_a2", F.lit(1.0)), "_u_offset": F.coalesce("_u_b1", "_u_b2", F.lit(0.0))})
    rows = rows.withColumns({"_u_as_said": F.col("value") * F.col("_u_scale") + F.col("_u_offset"), "_u_as_other": F.col("value") * F.col("_u_oscale") + F.col("_u_ooffset")})
    as_said, as_other, low, high = F.col("_u_as_said"), F.col("_u_as_other"), F.col("_u_lo"), F.col("_u_hi")
    possible = lambda v: v.between(low, high)
    far = F.greatest(F.try_divide("_u_oscale", "_u_scale"), F.try_divide("_u_scale", "_u_oscale")) > 9.99
    apart = (F.col("_u_ooffset") == 0) & (F.col("_u_offset") == 0) & far
    # As ratios to the geometric mean of the possible range, whichever way.
    middle = F.sqrt(F.greatest(low * high, F.lit(0.0)))
    off = lambda v: F.greatest(F.try_divide(v, middle), F.try_divide(middle, v))
    nearer = (F.col("value") > 0) & (off(as_other) < off(as_said)) & possible(as_other)
    closer = ~possible(as_said) & possible(as_other)
    by_size = F.col("_u_u1").isNull() & F.col("_u_other").isNotNull() & (F.col("_u_said") != F.col("_u_other")) & F.when(apart, nearer).otherwise(closer)
    rows = rows.withColumn("_u_by_size", F.coalesce(by_size, F.lit(False)))
    rows = rows.withColumn("recorded_unit", F.when(F.col("_u_by_size"), F.col("_u_other")).otherwise(F.col("_u_said"))).withColumn(
        "common_value", F.when(F.col("_u_by_size"), as_other).when(F.col("common_unit").isNotNull(), as_said))
    return rows.drop(*[c for c in rows.columns if c.startswith("_u_")])
