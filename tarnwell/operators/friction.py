"""User friction: patterns, rules over the conversation, and a model for the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import asc_nl, json_items, since, verbose

#: Labels in order of precedence and what each matches in the first 512 characters.
PATTERNS = (
    (
        "status_ping",
        r"""
        \bhow(?:'s|\s+is|\s+are|\s+it)?\s+(?:it|we|things|progress)\s+(?:going|coming|doing|looking|progressing|holding\s+up)\b
        |\bhow'?s?\s+progress\b(?=\s*[?.!]?\s*$)
        |\bany\s+update(?:s)?\b(?=\s*[?.!]?\s*$)
        |\bstatus\s+update\b
        |\bwhere\s+(?:are\s+we|we['’]re)\s+(?:at|with)\b
        |\b(?:are\s+you\s+)?still\s+(?:working|going|running|on\s+it)\b
        |\bwhat'?s?\s+(?:the|your)\s+eta\b
        |\bhow\s+(?:much\s+)?long\s+(?:until|till|more|left)\b
        """,
    ),
    (
        "interruption",
        r"""
        ^\s*(?:wait(?:\s*[.,!]|\s+a\s+(?:sec|second|moment|minute)|[\s$])
        |stop(?:\s*[.,!]|\s+(?:right\s+)?there|[\s$])
        |hold\s+on|hold\s+up|hang\s+on|actually[,\s]|before\s+you\s+(?:do|go)|pause\b|nvm\b|never\s*mind\b)
        """,
    ),
    (
        "correction",
        r"""
        ^\s*(?:no[,\s.!]|nope[,\s.!]?|nah[,\s.!]?|that'?s\s+(?:wrong|not\s+(?:right|it|what)|incorrect)
        |not\s+(?:that|what\s+i)|try\s+again|wrong\b|that'?s\s+not\s+)
        """,
    ),
)
#: What starts a short demand to go back, and confidences.
IMPERATIVES = ("stop", "redo", "revert", "rollback", "undo", "restart")
BY_PATTERN, BY_REPEAT, BY_IMPERATIVE, BY_ERROR = 0.9, 0.85, 0.9, 0.85
#: Whole messages that the system writes in the user's name. Fixed values.
SYSTEM_MARKS = ("Continue from where you left off.", "[Request interrupted by user for tool use]")


def pattern_label(text: Column) -> Column:
    """The first label whose pattern matches, else null."""
    head = F.substring(text, 1, 512)
    out = None
    for label, pattern in PATTERNS:
        test = head.rlike("(?iU)" + verbose(pattern))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def candidates(text: DataFrame, days: float | None = None, now=None, most: int = 300) -> DataFrame:
    """Short messages by the user that the system did not write."""
    rows = text.where("role = 'user'").where(F.length("text_content").between(1, most)).where(since(F.col("ts"), days, now))
    return rows.where(~F.trim("text_content").isin(*SYSTEM_MARKS))


def repeated(text: DataFrame, within: int = 10) -> DataFrame:
    """uuids of user messages that say again what one of the last ``within`` of the session said."""
    order = Window.partitionBy("session_id").orderBy(asc_nl("ts"), asc_nl("uuid"))
    said = F.lower(F.regexp_replace("text_content", r"\s+", " "))
    rows = text.where("role = 'user'").select("uuid", "session_id", said.alias("said"), F.row_number().over(order).alias("nr"))
    before = F.lag("nr").over(Window.partitionBy("session_id", "said").orderBy("nr"))
    return rows.withColumn("gap", F.col("nr") - before).where(F.col("gap") <= within).select("uuid")


def imperative(text: DataFrame, most: int = 30, words: tuple[str, ...] = IMPERATIVES) -> DataFrame:
    first = F.lower(F.rtrim(F.split_part(F.trim("text_content"), F.lit(" "), F.lit(1)), F.lit(".,!?")))
    return text.where("role = 'user'").where(F.length("text_content") <= most).where(first.isin(*words)).select("uuid")


def error_times(messages: DataFrame) -> DataFrame:
    """session_id and ts of tool results that report an error."""
    rows = messages.select("session_id", "ts", F.explode(json_items(F.col("content_json"))).alias("block"))
    return rows.where((F.get_json_object("block", "$.type") == "tool_result") & (F.get_json_object("block", "$.is_error") == "true")).select("session_id", "ts")


def question_after_error(text: DataFrame, errors: DataFrame) -> DataFrame:
    """uuids of user messages that end in ? with an error before them and no text message strictly between.

    By one sort a session instead of a join by range: an error fits if the last
    text message strictly before this one is not after it.
    """
    both = text.select("session_id", "ts", "uuid", "role", "text_content", F.lit(False).alias("error")).unionByName(errors.select("session_id", "ts", F.lit(True).alias("error")), allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    rows = both.withColumns({"last_error": F.max(F.when(F.col("error"), F.col("ts"))).over(w), "last_text": F.max(F.when(~F.col("error"), F.col("ts"))).over(w)})
    hit = (F.col("role") == "user") & F.col("text_content").endswith("?") & F.col("last_error").isNotNull() & (F.col("last_text").isNull() | (F.col("last_text") <= F.col("last_error")))
    return rows.where(~F.col("error") & hit).select("uuid")


def stamps(wanted: DataFrame, text: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """uuid, label, confidence and source of the rules that fire; the higher confidence, then the earlier rule."""
    fired = [(1, "unmet_expectation", BY_REPEAT, repeated(text)), (2, "correction", BY_IMPERATIVE, imperative(text))]
    if messages is not None:
        fired.append((3, "confusion", BY_ERROR, question_after_error(text, error_times(messages))))
    rows = None
    for nr, label, confidence, uuids in fired:
        one = uuids.select("uuid", F.lit(nr).alias("nr"), F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("uuid").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "nr", "label", "confidence")).alias("b"))
    return best.join(wanted.select("uuid"), "uuid", "left_semi").select("uuid", "b.label", "b.confidence", F.lit("sql").alias("source"))


Model = Callable[[list[str]], list[tuple[str, str, float] | None]]


def friction(text: DataFrame, messages: DataFrame | None = None, model: Model | None = None, days: float | None = None, now=None, at: Column | None = None) -> DataFrame:
    """The table of friction: patterns first, then rules, then the model, whose refusals (None) are kept as 'none'."""
    wanted = candidates(text, days, now).withColumn("pattern", pattern_label(F.col("text_content")))
    by_rule = stamps(wanted, text, messages).withColumnsRenamed({"label": "rule_label", "confidence": "rule_confidence"}).drop("source")
    rows = wanted.join(by_rule, "uuid", "left")
    label = F.coalesce("pattern", "rule_label")
    source = F.when(F.col("pattern").isNotNull(), "regex").when(F.col("rule_label").isNotNull(), "sql")
    confidence = F.when(F.col("pattern").isNotNull(), F.lit(BY_PATTERN)).otherwise(F.col("rule_confidence"))
    keep = ["uuid", "session_id", "ts", F.substring("text_content", 1, 300).alias("text_snippet")]
    known = rows.where(label.isNotNull()).select(*keep, label.alias("label"), F.lit(None).cast("string").alias("rationale"), source.alias("source"), confidence.cast("float").alias("confidence"))
    if model is not None:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                got = [x or ("none", "refused", 0.0) for x in model(frame["text_content"].tolist())]
                source = ["refused" if x[1] == "refused" else "llm" for x in got]
                yield frame.assign(text_snippet=frame["text_content"].str[:300], label=[x[0] for x in got], rationale=[x[1] for x in got], confidence=[x[2] for x in got], source=source)[["uuid", "session_id", "ts", "text_snippet", "label", "rationale", "source", "confidence"]]

        schema = "uuid string, session_id string, ts timestamp_ntz, text_snippet string, label string, rationale string, source string, confidence float"
        known = known.unionByName(rows.where(label.isNull()).select("uuid", "session_id", "ts", "text_content").mapInPandas(run, schema))
    return known.withColumns({"ts": F.col("ts").cast("timestamp"), "classified_at": at if at is not None else F.current_timestamp()})
