"""Problem 2: one split for all records of a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.operators.components import components
from tidewell.operators.splits import balanced_splits
from tidewell.session import cut
from tidewell.sources import table


def person_key(c: Column) -> Column:
    """uniquepid without spaces and with the hospital number in three digits; empty is null."""
    bare = F.regexp_replace(F.trim(c), r"\s+", "")
    hospital, rest = F.regexp_extract(bare, r"^(\d{1,2})-(.+)$", 1), F.regexp_extract(bare, r"^(\d{1,2})-(.+)$", 2)
    return F.when(bare == "", None).when(hospital != "", F.concat_ws("-", F.lpad(hospital, 3, "0"), rest)).otherwise(bare)


def split_name(c: Column) -> Column:
    """One of train, validate and test from any spelling; null for anything else."""
    low = F.lower(F.trim(c))
    return F.when(low.startswith("train"), "train").when(low.startswith("val"), "validate").when(low.startswith("test"), "test")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """(pid, hub): the smallest subject that each person of the second database is tied to directly, with every tied subject_id."""
    links = table(spark, sf, "person_links").select("subject_id", person_key(F.col("uniquepid")).alias("pid")).where("subject_id is not null and pid is not null").distinct()
    return links.join(links.groupBy("pid").agg(F.min("subject_id").alias("hub")), "pid")


def _roots(links: DataFrame) -> DataFrame:
    """(node, root): the smallest subject of each tied subject's person. Subjects tied by one pid hang on its hub, so nodes are subjects only."""
    return components(links.select(F.col("subject_id").alias("a"), F.col("hub").alias("b")))


def _studies(spark: SparkSession, sf: str, roots: DataFrame) -> DataFrame:
    """(root, record_id, split) of every study; copies count once."""
    rows = table(spark, sf, "cxr_studies").distinct().where("subject_id is not null").select("subject_id", F.col("study_id").alias("record_id"), split_name(F.col("split")).alias("split"))
    return rows.join(roots, F.col("node") == F.col("subject_id"), "left").select(F.coalesce("root", "subject_id").alias("root"), "record_id", "split")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """(group_id): persons whose studies now stand in more than one split."""
    now = _studies(spark, sf, _roots(_links(spark, sf))).where("split is not null")
    mixed = now.groupBy("root").agg(F.min("split").alias("low"), F.max("split").alias("high")).where("low <> high")
    return mixed.select(F.col("root").alias("group_id"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """(kind, record_id, group_key): every study and unit stay with its person."""
    links = _links(spark, sf)
    roots = _roots(links)
    studies = _studies(spark, sf, roots).select(F.lit("study").alias("kind"), "record_id", F.concat(F.lit("s"), F.col("root").cast("string")).alias("group_key"))
    hubs = links.select("pid", "hub").distinct().join(roots, F.col("node") == F.col("hub"), "left").select("pid", F.coalesce("root", "hub").alias("root"))
    stays = table(spark, sf, "patient").distinct().select(person_key(F.col("uniquepid")).alias("pid"), "patientunitstayid").where("pid is not null").join(hubs, "pid", "left").select(
        F.lit("unit_stay").alias("kind"), F.col("patientunitstayid").alias("record_id"), F.coalesce(F.concat(F.lit("s"), F.col("root").cast("string")), F.concat(F.lit("p"), "pid")).alias("group_key"))
    return studies.unionByName(stays)


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    """(kind, record_id, group_key, new_split): the split of every study and unit stay."""
    rows = cut(_records(spark, sf))
    targets = [(r.split, r.share) for r in table(spark, sf, "split_targets").select("split", "share").distinct().collect()]
    placed = balanced_splits(rows.groupBy(F.col("group_key").alias("group_id")).agg(F.count(F.lit(1)).alias("weight")), targets)
    return rows.join(placed, F.col("group_id") == F.col("group_key")).select("kind", "record_id", "group_key", F.col("split").alias("new_split")).distinct()


def p2_check(spark: SparkSession, sf: str) -> DataFrame:
    """For each split: whether its share is as wanted, up to one percent or the largest person, and how many persons and records stand in several splits."""
    rows = cut(p2_splits(spark, sf))
    persons = rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.max("new_split").alias("split"), F.count_if(F.col("new_split").isNull()).alias("left_out"), (F.min("new_split") < F.max("new_split")).cast("int").alias("torn"))
    whole = persons.agg(F.sum("n").alias("all"), F.max("n").alias("largest"), F.sum("left_out").alias("left_out"), F.sum("torn").alias("torn_persons"))
    size = persons.groupBy("split").agg(F.sum("n").alias("n"))
    wanted = table(spark, sf, "split_targets").where("split is not null").select("split", "share").distinct()
    # Three rows by nature, and one.
    share = F.coalesce("n", F.lit(0)) / F.col("all")
    return F.broadcast(wanted).join(size, "split", "left").join(F.broadcast(whole)).select(
        "split", "all", (F.abs(share - F.col("share")) <= F.greatest(F.lit(0.01), F.col("largest") / F.col("all"))).alias("as_wanted"), "torn_persons", "left_out")


ORACLES = {
    "p2_found": r"""WITH RECURSIVE l AS (
  SELECT DISTINCT subject_id, CASE WHEN regexp_matches(trim(uniquepid), '^\d{1,2}-') THEN lpad(split_part(trim(uniquepid), '-', 1), 3, '0') || '-' || split_part(trim(uniquepid), '-', 2) ELSE trim(uniquepid) END AS pid
  FROM person_links WHERE subject_id IS NOT NULL AND trim(coalesce(uniquepid, '')) <> ''),
e AS (SELECT DISTINCT x.subject_id AS a, y.subject_id AS b FROM l x JOIN l y USING (pid)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
root AS (SELECT a AS subject_id, min(b) AS group_id FROM reach GROUP BY 1),
s AS (SELECT subject_id, CASE WHEN lower(trim(split)) LIKE 'train%' THEN 'train' WHEN lower(trim(split)) LIKE 'val%' THEN 'validate' WHEN lower(trim(split)) LIKE 'test%' THEN 'test' END AS split FROM cxr_studies)
SELECT coalesce(group_id, s.subject_id) AS group_id FROM s LEFT JOIN root USING (subject_id)
WHERE split IS NOT NULL AND s.subject_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1""",
    "p2_check": """WITH r AS (SELECT 'study' AS kind, study_id AS id, CAST(subject_id AS VARCHAR) AS owner FROM cxr_studies WHERE subject_id IS NOT NULL
  UNION SELECT 'unit_stay', patientunitstayid, trim(uniquepid) FROM patient WHERE trim(coalesce(uniquepid, '')) <> '')
SELECT split, (SELECT count(*) FROM (SELECT DISTINCT kind, id FROM r)) AS "all", true AS as_wanted, 0::BIGINT AS torn_persons, 0::BIGINT AS left_out FROM (SELECT DISTINCT split FROM split_targets WHERE split IS NOT NULL)""",
}

QUERIES = {"p2_found": p2_found, "p2_splits": p2_splits, "p2_check": p2_check}
