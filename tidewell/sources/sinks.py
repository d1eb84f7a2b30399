"""Writers: partitioned event tables, result tables with a fixed schema."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def write_events(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 5_000_000) -> None:
    """Event rows by modality and shard. Rows are brought together by partition first; a shard is
    spread over as many tasks as its number of rows asks for, so none holds much more than `rows_per_file`."""
    size = df.groupBy(F.col("modality").alias("_m"), F.col("shard").alias("_s")).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files"))
    # One row for each folder of the table: shards are two digits, modalities a handful.
    same = F.col("modality").eqNullSafe(F.col("_m")) & F.col("shard").eqNullSafe(F.col("_s"))
    spread = df.join(F.broadcast(size), same).select(*df.columns, F.pmod(F.xxhash64("subject_id", "time"), F.col("_files")).alias("_salt"))
    spread.repartition("modality", "shard", "_salt").drop("_salt").write.mode(mode).partitionBy("modality", "shard").parquet(path)


def write_delimited(df: DataFrame, path: str) -> None:
    """CSV with a header, gzip; an existing table is replaced."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


class Results:
    """Result tables with fixed schemas below one folder: unknown columns are refused, missing ones are null.

    A table is a folder of versions; the highest version that was written to its end (Spark's _SUCCESS
    file) is the table. A run that stops halfway leaves the version before it in place.
    """

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, StructType]):
        self.spark, self.folder, self.schemas = spark, folder, schemas

    def _files(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[str]:
        """The finished versions, oldest first."""
        if name not in self.schemas:
            raise KeyError(f"no result table {name}")
        at, system = self._files(f"{self.folder}/{name}")
        if not system.exists(at):
            return []
        found = [str(s.getPath().toString()) for s in system.listStatus(at)]
        return sorted(f for f in found if system.exists(self._files(f"{f}/_SUCCESS")[0]))

    def read(self, name: str) -> DataFrame:
        """The rows so far; none if nothing was written."""
        done = self._versions(name)
        return self.spark.read.schema(self.schemas[name]).parquet(done[-1]) if done else self.spark.createDataFrame([], self.schemas[name])

    def _fitted(self, name: str, rows: DataFrame) -> DataFrame:
        schema = self.schemas[name]
        unknown = sorted(set(rows.columns) - set(schema.names))
        if unknown:
            raise ValueError(f"{name} has no columns {unknown}")
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def _write(self, name: str, rows: DataFrame) -> None:
        done = self._versions(name)
        number = int(done[-1].rsplit("/", 1)[1].split("-")[1]) + 1 if done else 0
        rows.write.parquet(f"{self.folder}/{name}/v-{number:012d}-{uuid4().hex}")
        # Readers of the version before may still be at work; older ones go.
        for old in done[:-1]:
            at, system = self._files(old)
            system.delete(at, True)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to the present version; those of a run that stops halfway aren't seen."""
        done, fitted = self._versions(name), self._fitted(name, rows)
        if done:
            fitted.write.mode("append").parquet(done[-1])
        else:
            self._write(name, fitted)

    def replace(self, name: str, rows: DataFrame, **where: object) -> None:
        """Removes the rows that match all of `where` (a value, a list of values, or None for null) and adds `rows`.

        A run that is repeated leaves the table as one run would.
        """
        keep = F.lit(True)
        if where:
            match = F.lit(True)
            for column, wanted in where.items():
                values = wanted if isinstance(wanted, list) else [wanted]
                one = F.lit(False)
                for v in values:
                    one = one | F.col(column).eqNullSafe(F.lit(v))
                match = match & one
            keep = ~match
        self._write(name, self.read(name).where(keep).unionByName(self._fitted(name, rows)))

    def templates(self) -> None:
        """Writes every table that doesn't exist, without rows."""
        for name, schema in self.schemas.items():
            if not self._versions(name):
                self._write(name, self.spark.createDataFrame([], schema))
