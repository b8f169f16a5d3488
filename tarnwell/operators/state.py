"""What a pipeline has done and has to try again: small keyed tables, never changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes of the longest wait, tries, characters of an error.
MOST_MINUTES, MOST_TRIES, ERROR_CHARS = 60, 5, 2000


def pending_sessions(bounds: DataFrame, checkpoint: DataFrame, pipeline: str) -> DataFrame:
    """Sessions (session_id, last_ts, mtime) that grew since the checkpoint; what is unknown on either side is pending."""
    done = checkpoint.where(F.col("pipeline") == pipeline).select("session_id", "last_ts_processed", "last_mtime_processed")
    rows = bounds.join(done, "session_id", "left")
    same = (F.col("last_ts").cast("timestamp") <= F.col("last_ts_processed")) & (F.col("mtime").cast("timestamp") <= F.col("last_mtime_processed"))
    return rows.where(~F.coalesce(same, F.lit(False))).select(*bounds.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those with the same keys."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def mark_completed(checkpoint: DataFrame, sessions: DataFrame, pipeline: str, now: Column | None = None) -> DataFrame:
    rows = sessions.select("session_id", F.lit(pipeline).alias("pipeline"), F.col("last_ts").cast("timestamp").alias("last_ts_processed"), F.col("mtime").cast("timestamp").alias("last_mtime_processed"), (now if now is not None else F.current_timestamp()).alias("completed_at"))
    return upsert(checkpoint, rows, ["session_id", "pipeline"])


def wait_minutes(attempts: Column) -> Column:
    """Minutes to wait after so many tries: doubling, an hour at most."""
    return F.least(F.pow(F.lit(2.0), F.least(attempts, F.lit(30))), F.lit(float(MOST_MINUTES)))


def enqueue(queue: DataFrame, failed: DataFrame, pipeline: str, now: Column) -> DataFrame:
    """``failed`` (unit_id, error) again later; a known one has one more try behind it."""
    old = queue.where(F.col("pipeline") == pipeline).select("unit_id", F.col("attempts").alias("before"), F.col("created_at").alias("since"))
    rows = failed.join(old, "unit_id", "left").withColumn("attempts", F.coalesce("before", F.lit(0)) + 1)
    later = F.timestamp_seconds(F.unix_seconds(now) + (wait_minutes(F.col("attempts")) * 60).cast("long"))
    rows = rows.select(F.lit(pipeline).alias("pipeline"), "unit_id", F.substring("error", 1, ERROR_CHARS).alias("error"), F.col("attempts").cast("int").alias("attempts"), later.alias("next_attempt_at"), F.coalesce("since", now).alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    return upsert(queue, rows, ["pipeline", "unit_id"])


def due(queue: DataFrame, pipeline: str, now: Column, most: int = MOST_TRIES, limit: int | None = None) -> DataFrame:
    rows = queue.where((F.col("pipeline") == pipeline) & F.col("completed_at").isNull() & (F.col("attempts") < most) & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "unit_id")
    return rows.limit(limit) if limit is not None else rows


def mark_done(queue: DataFrame, done: DataFrame, pipeline: str, now: Column) -> DataFrame:
    hit = done.select("unit_id", F.lit(pipeline).alias("pipeline"), F.lit(True).alias("hit"))
    out = queue.join(hit, ["unit_id", "pipeline"], "left").withColumn("completed_at", F.when(F.col("hit"), now).otherwise(F.col("completed_at")))
    return out.select(*queue.columns)


def pending_count(queue: DataFrame, pipeline: str, most: int = MOST_TRIES) -> DataFrame:
    return queue.where((F.col("pipeline") == pipeline) & F.col("completed_at").isNull() & (F.col("attempts") < most)).agg(F.count(F.lit(1)).alias("n"))
