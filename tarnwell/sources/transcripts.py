"""Readers of transcript files: newline-delimited JSON with a fixed schema, ids from paths."""

from __future__ import annotations

import glob as globs
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell import schemas

#: Part files as sessions or Spark's writers leave them; a folder's name may be a partition's, like ``session=7``.
PART = r"/(?:[^/=]+=)?([^/]+)/part-[^/]*\.(?:jsonl|json|txt)$"
FLAT = r"([^/]+)\.jsonl$"
SUBAGENT = r"/(?:[^/=]+=)?([0-9a-f-]{36})/(?:[^/=]+=)?subagents/(?:[^/=]+=)?agent-([a-f0-9]+)(?:\.(?:jsonl|meta\.json)|/part-[^/]*)$"
REMOTE = ("s3://", "s3a://", "gs://", "abfs://", "hdfs://", "viewfs://")


def local(path: str) -> bool:
    return not path.startswith(REMOTE)


def check_glob(pattern: str) -> str:
    """The pattern, if it has at most one ``**``."""
    if pattern.count("**") > 1:
        raise ValueError(f"a pattern may hold ** once: {pattern}")
    return pattern


def corpus_globs(root: str) -> dict[str, str]:
    """The three patterns below a corpus's root."""
    root = root.rstrip("/")
    return {"events": f"{root}/*/*.jsonl", "subagents": f"{root}/*/*/subagents/agent-*.jsonl", "meta": f"{root}/*/*/subagents/agent-*.meta.json"}


def expand(pattern: str | Iterable[str]) -> list[str]:
    """Files of a local pattern; other places are left to Spark to list."""
    patterns = [pattern] if isinstance(pattern, str) else list(pattern)
    out: list[str] = []
    for p in (re.sub(r"^file:/+", "/", check_glob(p)) for p in patterns):
        out += sorted(x for x in globs.glob(p, recursive=True) if os.path.isfile(x)) if local(p) else [p]
    return out


def _path() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")


def _read(spark: SparkSession, schema: str, files: list[str], **options: str) -> DataFrame:
    """Rows with ``source_file``; of no file, no rows."""
    if not files:
        return spark.createDataFrame([], schema).withColumn("source_file", F.lit(None).cast("string"))
    df = spark.read.schema(schema).options(mode="PERMISSIVE", **options).json(files)
    return df.select("*", _path().alias("source_file"))


def raw_events(spark: SparkSession, pattern: str | Iterable[str]) -> DataFrame:
    """Events of a pattern or list of files. A broken line is a row of nulls, which every view drops."""
    df = _read(spark, schemas.RAW_EVENT, expand(pattern))
    part = F.regexp_extract("source_file", PART, 1)
    return df.withColumn("session_id_file", F.when(part != "", part).otherwise(F.regexp_extract("source_file", FLAT, 1)))


def with_parts(events: DataFrame, root: str) -> DataFrame:
    """``events`` and those of sessions kept as part files below ``root``; unchanged if there are none."""
    files = expand(f"{root.rstrip('/')}/*/part-*.jsonl")
    return events.unionByName(raw_events(events.sparkSession, files), allowMissingColumns=True) if files else events


def session_events(spark: SparkSession, root: str, session_id: str, pattern: str) -> DataFrame:
    """One session's events: its own file, else its part files, else all of the pattern, filtered."""
    for own in (f"{root}/{session_id}.jsonl", f"{root}/{session_id}/part-*.jsonl"):
        if files := expand(own):
            return raw_events(spark, files)
    return raw_events(spark, pattern).where(F.col("sessionId") == session_id)


def envelopes(spark: SparkSession, pattern: str | Iterable[str]) -> DataFrame:
    """Messages as they stand: time and message as texts."""
    return _read(spark, schemas.ENVELOPE, expand(pattern)).where("type is not null")


def raw_subagents(spark: SparkSession, pattern: str | Iterable[str]) -> DataFrame:
    df = _read(spark, schemas.RAW_SUBAGENT, expand(pattern))
    return df.withColumns({"parent_session_id": F.regexp_extract("source_file", SUBAGENT, 1), "agent_hex": F.regexp_extract("source_file", SUBAGENT, 2)})


def raw_subagent_meta(spark: SparkSession, pattern: str | Iterable[str]) -> DataFrame:
    df = _read(spark, schemas.RAW_META, expand(pattern), multiLine="true")
    return df.select("agentType", "description", F.regexp_extract("source_file", SUBAGENT, 1).alias("parent_session_id"), F.regexp_extract("source_file", SUBAGENT, 2).alias("agent_hex"))


def modified(pattern: str | Iterable[str]) -> dict[str, int] | None:
    """Path and time of change in nanoseconds of each regular file; None where that can't be told."""
    patterns = [pattern] if isinstance(pattern, str) else list(pattern)
    if not all(map(local, patterns)):
        return None
    out = {}
    for path in expand(patterns):
        try:
            out[path] = os.stat(path).st_mtime_ns
        except OSError:
            continue
    return out


def session_mtimes(spark: SparkSession, pattern: str, names: str = "*.jsonl") -> DataFrame:
    """Time of change of each session's newest file with such a name, as Spark lists it."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", names).load(expand(pattern))
    path = F.regexp_replace("path", r"^file:/+", "/")
    part = F.regexp_extract(path, PART, 1)
    sid = F.when(part != "", part).otherwise(F.regexp_extract(path, FLAT, 1))
    return df.groupBy(sid.alias("session_id")).agg(F.max("modificationTime").alias("mtime"))


def s3_settings(endpoint: str | None = None, path_style: bool = False, ssl: bool = True) -> dict[str, str]:
    """Session settings for s3a:// with the default credentials."""
    out = {"spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(), "spark.hadoop.fs.s3a.connection.ssl.enabled": str(ssl).lower()}
    return out | ({"spark.hadoop.fs.s3a.endpoint": endpoint} if endpoint else {})
