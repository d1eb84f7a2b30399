from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from tidewell.session import local_session

    session = local_session(cores=4, shuffle_partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small() -> str:
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def variants(spark, small, tmp_path_factory):
    """The smallest tables empty, and with repeated rows, rows of nulls and extra columns of awkward names."""
    empty, dirty = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("dirty")
    extra = ["value", "lo", "hi", "bucket", "entity", "s", "e", "_part", "members", "start_us", "at_us", "n", "node", "rank", "words", "weight", "unit", "row_id"]
    from pyspark.sql import functions as F

    for file in sorted(Path(small).glob("*.parquet")):
        df = spark.read.parquet(str(file))
        df.limit(0).write.parquet(str(empty / file.name))
        nothing = spark.range(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        more = df.unionByName(df).unionByName(nothing)
        keyed = more if file.stem != "documents" else df.unionByName(nothing)
        for c in extra:
            if c not in df.columns:
                keyed = keyed.withColumn(c, F.lit("x"))
        keyed.write.parquet(str(dirty / file.name))
    return str(empty), str(dirty)
