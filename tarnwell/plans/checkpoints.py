"""Cutting lineage in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Sets the checkpoint folder that the session names; one of our own only on a single machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not context.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all machines see")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the checkpoint folder."""
    ready(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Frames written as tables to the checkpoint folder and read again, for loops of many rounds.

    Unlike a checkpoint's, the plan of what is read knows nothing of how it was made,
    so that the optimizer's statistics and constraints don't grow from round to round.
    """

    def __init__(self, spark: SparkSession):
        ready(spark)
        self.spark, self.place, self.n = spark, f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}", 0
        self.live: list[str] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.place}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        self.live.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def mark(self) -> int:
        return len(self.live)

    def forget(self, first: int, *but: DataFrame) -> None:
        """Deletes what was written since a mark, other than the tables that ``but`` read."""
        kept = {f.rsplit("/", 1)[0] for df in but for f in df.inputFiles()}
        for path in self.live[first:]:
            if not any(k.endswith(path.removeprefix("file:")) or k == path for k in kept):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.live[first:] = [p for p in self.live[first:] if any(k.endswith(p.removeprefix("file:")) or k == p for k in kept)]
