"""A corpus pipeline of five stages, each of which calls one operator on all that the stage before it kept.

Quality rules, near duplicates, repeated passages, benchmark passages, mixing.
Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``,
the last one the mix. Other columns of the input are dropped. The quality stage
judges each row by its own text; in the others rows that share a doc_id are decided
together, in the benchmark stage also those without one. A null text passes the
stages as an empty one. Near duplicates share 80 % of their sets of five words.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import decontam, minhash, mixing, quality_rules, rlz_dedup
from tarnwell.llm.flat import ready
from tarnwell.llm.text import pick

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids up to which a removal list is broadcast (16 MB).
MAX_BROADCAST_IDS = 1_000_000
#: SQL can't express the learned rules.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = ids.select(F.col("doc_id").alias("_id")).distinct()
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules reject go."""
    docs = pick(docs, *COLUMNS)
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), base=False)
    return quality_rules.keep(docs, rules, base=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates stays."""
    docs = pick(docs, *COLUMNS)
    found = minhash.checkpointed(minhash.near_duplicates(docs).where("not kept"))
    return _without(docs, found).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut; documents with no word left go."""
    out = rlz_dedup.remove_repeats(docs, carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    out = out.where(~changed | (F.col("n_removed") < F.col("n_words")))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    docs = pick(docs, *COLUMNS)
    found = minhash.checkpointed(decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct())
    return _without(docs, found).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the folder that the cluster shares."""
    ready(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
