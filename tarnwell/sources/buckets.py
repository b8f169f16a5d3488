"""Tables whose rows are replaced by key, in folders by a hash of the key: only the folders that a change touches are written again.

All reading and writing is Spark's, so that a table may be at any URI that Spark
knows. A change is read, made and put aside in the checkpoint folder before its
folders are overwritten; one that is repeated after a failure gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.plans.checkpoints import checkpointed

#: Folders of a table.
BUCKETS = 256


@dataclass(frozen=True)
class Buckets:
    """A table at ``uri`` with a schema (DDL) and the keys by which rows are replaced."""

    spark: SparkSession
    uri: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self) -> DataFrame:
        schema = f"{self.schema}, _bucket int"
        return self.spark.read.schema(schema).parquet(self.uri) if self._there() else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._read().drop("_bucket")

    def _named(self, rows: DataFrame) -> DataFrame:
        """The table's columns by name, whatever else ``rows`` has."""
        empty = self.spark.createDataFrame([], self.schema)
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema]).withColumn("_bucket", self._bucket())

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select("_bucket").distinct().collect()]  # as many as there are folders, at most

    def _write(self, rows: DataFrame) -> None:
        held = checkpointed(rows)
        if held.limit(1).count():
            held.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.uri)

    def replace(self, rows: DataFrame) -> None:
        """All rows of the keys in ``rows`` go, ``rows`` come."""
        rows = checkpointed(self._named(rows))
        old = self._read().where(F.col("_bucket").isin(self._touched(rows)))
        same = F.lit(True)
        keys = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).distinct()
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        self._write(old.join(keys, same, "left_anti").unionByName(rows))

    def merge(self, rows: DataFrame, order: Sequence[str]) -> None:
        """Of each key the last row by ``order`` stays, of the table's and of ``rows``; ties go to the largest values of the other columns."""
        rows = checkpointed(self._named(rows))
        both = self._read().where(F.col("_bucket").isin(self._touched(rows))).unionByName(rows)
        rest = [c for c in both.columns if c not in {*self.keys, *order, "_bucket"}]
        w = Window.partitionBy(*self.keys).orderBy(*[F.desc_nulls_last(c) for c in (*order, *rest)])
        self._write(both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))
