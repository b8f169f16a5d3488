"""Column helpers that hide where Spark and other SQL engines differ."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyspark.sql
from pyspark.sql import Column, functions as F


def any_val(column: str | Column) -> Column:
    """Some value that is not null, else null."""
    return F.any_value(column, True)


def asc_nl(column: str | Column) -> Column:
    """Ascending, nulls last."""
    return (F.col(column) if isinstance(column, str) else column).asc_nulls_last()


def ntz(column: str | Column) -> Column:
    """A timestamp without zone that reads as the session's (UTC) clock."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp_ntz")


def millis(ts: Column) -> Column:
    """Milliseconds since the epoch, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))


def gap_ms(before: Column, after: Column) -> Column:
    """Millisecond boundaries between two times."""
    return millis(after) - millis(before)


def now_or(now: str | Column | None) -> Column:
    """The given time, or the current one, as a timestamp without zone."""
    if now is None:
        return ntz(F.current_timestamp())
    return ntz(F.lit(now)) if isinstance(now, str) else ntz(now)


def since(ts: Column, days: float | None, now: str | Column | None = None) -> Column:
    """Whether ``ts`` lies within the last ``days``; any time if ``days`` is None."""
    if days is None:
        return F.lit(True)
    return ts >= now_or(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(days) * 86400).cast("decimal(18,6)"))


def json_items(body: Column) -> Column:
    """Elements of a JSON array as JSON texts; null of anything else."""
    return F.when(F.ltrim(body).startswith("["), F.from_json(body, "array<string>"))


def json_str(body: Column, path: str) -> Column:
    return F.get_json_object(body, path)


def unquoted(body: Column) -> Column:
    """The value of a JSON string; other text unchanged."""
    return F.when(body.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), body, F.lit("}")), "$.v")).otherwise(body)


def verbose(pattern: str) -> str:
    """A readable pattern without its white space, for engines that lack the verbose flag."""
    return re.sub(r"\s+", "", pattern)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null where one is all zeros."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def pick(df: pyspark.sql.DataFrame, *names: str) -> pyspark.sql.DataFrame:
    return df.select(*[df[n] for n in names])


Maker = Callable[..., pyspark.sql.DataFrame]


def spread(df: pyspark.sql.DataFrame) -> pyspark.sql.DataFrame:
    """``df``, dealt anew if it has fewer parts than there are cores: for heavy work on a table that is one file. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
