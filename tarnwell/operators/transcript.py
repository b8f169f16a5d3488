"""Sessions as text: timelines, collapsed turns, bounds and a first look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import asc_nl, ntz

#: Order of kinds at one time, and caps.
KINDS = {"text": 0, "tool_use": 1, "tool_result": 2}
TYPES = {"user": 0, "assistant": 1, "tool": 2, "system": 3}
INPUT_CHARS, RESULT_CHARS, SESSION_CHARS = 400, 2000, 200_000
TURN_CHARS, TOTAL_CHARS = 8000, 200_000


def iso(ts: Column) -> Column:
    """ISO 8601, the fraction left out at whole seconds."""
    whole = F.date_trunc("second", ts) == ts.cast("timestamp")
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def timeline(text: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """session_id, ts_iso, role, kind, body, aux and uuid of all events."""
    none = F.lit(None).cast("string")
    at = iso(F.col("ts")).alias("ts_iso")
    a = text.select("session_id", at, "role", F.lit("text").alias("kind"), F.col("text_content").alias("body"), none.alias("aux"), "uuid")
    b = calls.select("session_id", at, F.lit("assistant").alias("role"), F.lit("tool_use").alias("kind"), F.col("tool_input").alias("body"), F.col("tool_name").alias("aux"), none.alias("uuid"))
    c = results.select("session_id", at, F.lit("user").alias("role"), F.lit("tool_result").alias("kind"), F.col("content").alias("body"), F.col("tool_use_id").alias("aux"), none.alias("uuid"))
    return a.unionByName(b).unionByName(c)


def _rank(column: str, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in ranks.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def assemble(events: DataFrame, *, uuids: bool = False, result_chars: int = RESULT_CHARS, total_chars: int = SESSION_CHARS) -> DataFrame:
    """session_id and transcript: a line an event, in order, up to the cap, where a notice ends it."""
    size = F.length("body")
    mark = F.concat(F.lit("uuid="), F.col("uuid"), F.lit(" ")) if uuids else F.lit("")
    head = F.concat(F.lit("["), F.coalesce(mark, F.lit("")), F.col("role"), F.lit(" "), F.col("ts_iso"), F.lit("] "), F.col("body"))
    call = F.concat(F.lit("[tool_use:"), F.coalesce("aux", F.lit("tool")), F.lit(" "), F.col("ts_iso"), F.lit("] "), F.when(size > INPUT_CHARS, F.concat(F.substring("body", 1, INPUT_CHARS), F.lit("…(truncated)"))).otherwise(F.col("body")))
    cut = F.concat(F.substring("body", 1, result_chars), F.lit("\n…(truncated, "), (size - result_chars).cast("string"), F.lit(" chars dropped)"))
    result = F.concat(F.lit("[tool_result "), F.coalesce("aux", F.lit("?")), F.lit(" "), F.col("ts_iso"), F.lit("] "), F.when(size > result_chars, cut).otherwise(F.col("body")))
    line = F.when(F.col("kind") == "text", head).when(F.col("kind") == "tool_use", call).otherwise(result)
    order = Window.partitionBy("session_id").orderBy("ts_iso", _rank("kind", KINDS, 9), F.coalesce("body", F.lit("")), F.coalesce("aux", F.lit("")), asc_nl("uuid"))
    whole = Window.partitionBy("session_id")
    rows = events.withColumn("line", F.when(F.col("body").isNotNull(), line)).withColumns({"nr": F.row_number().over(order), "upto": F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n": F.count(F.lit(1)).over(whole), "all": F.sum(F.length("line") + 1).over(whole)})
    kept = rows.where(F.col("line").isNotNull() & (F.col("upto") <= total_chars)).groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nr", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    about = rows.groupBy("session_id").agg(F.max("n").alias("n"), F.max("all").alias("all"))
    notice = F.concat(F.lit(f"…(session truncated at {total_chars} chars, "), F.col("n").cast("string"), F.lit(" events total)"))
    text = F.when(F.col("all") > total_chars, F.concat_ws("\n", "lines", notice)).otherwise(F.coalesce("lines", F.lit("")))
    return about.join(kept, "session_id", "left").select("session_id", text.alias("transcript"))


def collapse(rows: DataFrame, *, turn_chars: int = TURN_CHARS, total_chars: int = TOTAL_CHARS, notice: bool = False) -> DataFrame:
    """session_id and transcript of raw messages (session_id, uuid, type, timestamp, message): one line each, tools as marks."""
    content = F.get_json_object("message", "$.content")
    items = F.when(content.startswith("["), F.from_json(content, "array<struct<type:string,text:string,name:string>>"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    mark = lambda b: F.when(b["type"] == "text", F.nullif(strip(b["text"]), F.lit(""))).when(b["type"] == "tool_use", F.concat(F.lit("[tool_use:"), F.coalesce(b["name"], F.lit("")), F.lit("]"))).when(b["type"] == "tool_result", F.lit("[tool_result]"))
    joined = F.array_join(F.filter(F.transform(items, mark), lambda x: x.isNotNull()), " ")
    body = F.coalesce(joined, strip(content))
    body = F.when(F.length(body) > turn_chars, F.concat(F.substring(body, 1, turn_chars), F.lit(" …"))).otherwise(body)
    role = F.coalesce(F.nullif(F.get_json_object("message", "$.role"), F.lit("")), F.col("type"), F.lit("unknown"))
    ts = F.coalesce("timestamp", F.lit(""))
    out = rows.select("session_id", ts.alias("ts"), _rank("type", TYPES, 99).alias("rank"), F.coalesce("uuid", F.lit("")).alias("uuid"), role.alias("role"), body.alias("body")).where("body is not null and body <> ''")
    line = F.concat(F.lit("["), F.col("role"), F.lit(" "), F.col("ts"), F.lit("] "), F.col("body"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "rank", "uuid", line.alias("line")))), lambda x: x["line"]), "\n")
    end = f"\n…(transcript truncated at {total_chars} chars)" if notice else ""
    done = out.groupBy("session_id").agg(text.alias("t"))
    cut = F.concat(F.substring("t", 1, max(0, total_chars - len(end))), F.lit(end))
    return done.select("session_id", F.when(F.length("t") > total_chars, cut).otherwise(F.col("t")).alias("transcript"))


def session_bounds(messages: DataFrame, mtimes: DataFrame | None = None, days: float | None = None, limit: int | None = None, now=None) -> DataFrame:
    """session_id, last_ts and mtime, newest first."""
    from tarnwell.functions import since

    rows = messages.groupBy("session_id").agg(F.max("ts").alias("last_ts")).where(since(F.col("last_ts"), days, now))
    rows = rows.join(mtimes, "session_id", "left") if mtimes is not None else rows.withColumn("mtime", F.lit(None).cast("timestamp"))
    rows = rows.orderBy(F.desc_nulls_last("last_ts"), "session_id")
    return rows.limit(limit) if limit is not None else rows


def peek(messages: DataFrame, text: DataFrame, calls: DataFrame, session_id: str, sample_chars: int = 200, top_tools: int = 5) -> dict | None:
    """What one session is about, None if there is no such one. Filtered first, so little is read."""
    one = lambda df: df.where(F.col("session_id") == session_id)
    head = one(messages).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.min("source_file").alias("file")).first()
    if not head["n"]:
        return None
    roles = one(messages).groupBy("role").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), asc_nl("role")).collect()
    tools = one(calls).where("tool_name is not null").groupBy("tool_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tool_name").limit(top_tools).collect()
    body = F.when(F.length("text_content") > sample_chars, F.concat(F.substring("text_content", 1, sample_chars), F.lit("…"))).otherwise(F.col("text_content"))
    sample, at = F.struct(F.col("ts").cast("string").alias("ts"), body.alias("text")), F.struct("ts", "uuid")
    said = {r["role"]: r for r in one(text).groupBy("role").agg(F.min_by(sample, at).alias("first"), F.max_by(sample, at).alias("last")).collect()}
    pick = lambda role, which: said[role][which].asDict() if role in said else None
    as_text = lambda x: None if x is None else str(x)
    return {
        "session_id": session_id,
        "source_file": head["file"],
        "total_lines": head["n"],
        "first_ts": as_text(head["first"]),
        "last_ts": as_text(head["last"]),
        "roles": {str(r["role"]): r["n"] for r in roles},
        "top_tools": [{"name": r["tool_name"], "count": r["n"]} for r in tools],
        "samples": {"first_user": pick("user", "first"), "last_user": pick("user", "last"), "first_assistant_text": pick("assistant", "first")},
    }


def to_ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: ntz(c) for c in columns})
