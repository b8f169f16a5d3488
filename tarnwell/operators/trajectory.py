"""Sentiment between neighbouring turns: windows, prompts, rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
CHUNK, CLIP = 16, 2000
SENTIMENTS = {"negative": -1, "neutral": 0, "positive": 1}
KINDS = ("frustration_spike", "resolution", "reset", "drift", "clarification", "none")
#: A model's answer; the change as it wrote it.
ANSWER = "session_id string, prev_uuid string, curr_uuid string, prev_sentiment string, curr_sentiment string, delta string, is_transition boolean, transition_kind string, confidence float"


def windows(turns: DataFrame, text: DataFrame, session_ids: DataFrame | None = None) -> DataFrame:
    """Windows with both texts and the chunk each falls in."""
    rows = turns if session_ids is None else turns.join(session_ids, "session_id", "left_semi")
    body = text.select("uuid", "text_content")
    rows = rows.join(body.withColumnsRenamed({"uuid": "prev_uuid", "text_content": "prev_text"}), "prev_uuid", "left")
    rows = rows.join(body.withColumnsRenamed({"uuid": "curr_uuid", "text_content": "curr_text"}), "curr_uuid", "left")
    chunk = F.floor((F.col("window_idx") - 1) / CHUNK).cast("long")
    return rows.select("session_id", "window_idx", chunk.alias("chunk"), "prev_uuid", "curr_uuid", "prev_role", "curr_role", "prev_text", F.coalesce("curr_text", F.lit("")).alias("curr_text"))


def _escaped(text: Column, quotes: bool = False) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    if quotes:
        out = F.replace(out, F.lit('"'), F.lit("&quot;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…(truncated)"))).otherwise(text)


def prompts(rows: DataFrame, most: int = CLIP) -> DataFrame:
    """session_id, chunk and the XML of its windows, made by expressions alone."""

    def side(tag: str) -> Column:
        head = F.concat(F.lit(f'<{tag} role="'), _escaped(F.col(f"{tag}_role"), True), F.lit('" uuid="'), _escaped(F.col(f"{tag}_uuid"), True), F.lit('">'))
        return F.concat(head, _escaped(_clipped(F.col(f"{tag}_text"), most)), F.lit(f"</{tag}>"))

    number = ((F.col("window_idx") - 1) % CHUNK).cast("string")
    one = F.concat(F.lit("<window idx="), number, F.lit(">\n"), side("prev"), F.lit("\n"), side("curr"), F.lit("\n</window>"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("window_idx", one.alias("x")))), lambda w: w["x"])
    return rows.groupBy("session_id", "chunk").agg(F.array_join(parts, "\n").alias("prompt"))


def delta(before: Column, after: Column) -> Column:
    value = lambda c: F.coalesce(*[F.when(c == k, F.lit(float(v))) for k, v in SENTIMENTS.items()], F.lit(0.0))
    return F.when(before.isNotNull() & after.isNotNull(), value(after) - value(before))


def rows_of(answers: DataFrame) -> DataFrame:
    """Table rows of a model's answers: its number for the change if it is one, else recomputed; unknown kinds are none."""
    after = F.coalesce("curr_sentiment", F.lit("neutral"))
    given = F.col("delta").cast("string").try_cast("double")
    change = F.when(F.col("prev_sentiment").isNotNull(), F.coalesce(given, delta(F.col("prev_sentiment"), after)))
    kind = F.when(F.col("transition_kind").isin(*KINDS), F.col("transition_kind")).otherwise("none")
    return answers.select("session_id", "prev_uuid", "curr_uuid", "prev_sentiment", after.alias("curr_sentiment"), change.alias("delta"), F.coalesce("is_transition", F.lit(False)).alias("is_transition"), kind.alias("transition_kind"), F.coalesce("confidence", F.lit(0.0)).cast("float").alias("confidence"))


def placeholders(missing: DataFrame) -> DataFrame:
    """Neutral rows of windows that a model did not answer."""
    first = F.col("prev_uuid").isNull()
    return missing.select("session_id", "prev_uuid", "curr_uuid", F.when(~first, F.lit("neutral")).alias("prev_sentiment"), F.lit("neutral").alias("curr_sentiment"), F.when(~first, F.lit(0.0)).alias("delta"), F.lit(False).alias("is_transition"), F.lit("none").alias("transition_kind"), F.lit(0.0).cast("float").alias("confidence"))


Model = Callable[[str], list[dict]]


def trajectory(rows: DataFrame, model: Model, tries: int = 2, at: Column | None = None) -> DataFrame:
    """A row for each window: the model's answer, asked again once for what it left out, else a placeholder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = [f.split()[0] for f in ANSWER.split(", ")]
        for frame in frames:
            out = []
            for sid, prompt, wanted in zip(frame["session_id"], frame["prompt"], frame["pairs"], strict=True):
                open_ = {(p["prev_uuid"], p["curr_uuid"]) for p in wanted}
                for _ in range(tries):
                    for answer in model(prompt) if open_ else ():
                        key = (answer.get("prev_uuid"), answer.get("curr_uuid"))
                        if key in open_:
                            open_.discard(key)
                            out.append([sid, *[str(answer[f]) if f == "delta" and answer.get(f) is not None else answer.get(f) for f in fields[1:]]])
            yield pd.DataFrame(out, columns=fields)

    chunks = prompts(rows).join(rows.groupBy("session_id", "chunk").agg(F.collect_list(F.struct("prev_uuid", "curr_uuid")).alias("pairs")), ["session_id", "chunk"])
    from tarnwell.plans.checkpoints import checkpointed

    got = checkpointed(rows_of(chunks.select("session_id", "prompt", "pairs").mapInPandas(run, ANSWER)))
    keys = got.select("session_id", "curr_uuid")
    missing = rows.join(keys, ["session_id", "curr_uuid"], "left_anti").select("session_id", "prev_uuid", "curr_uuid")
    return got.unionByName(placeholders(missing)).withColumn("classified_at", at if at is not None else F.current_timestamp())


def planned(rows: DataFrame, tokens_in: int, tokens_out: int, rate_in: float, rate_out: float, per_call: int = 1) -> DataFrame:
    """What a run over ``rows`` would ask and cost."""
    n = F.ceil(F.count(F.lit(1)) / per_call)
    return rows.agg(F.count(F.lit(1)).alias("candidates"), n.alias("calls"), (n * tokens_in).alias("tokens_in"), (n * tokens_out).alias("tokens_out"), (n * (tokens_in * rate_in + tokens_out * rate_out) / 1e6).alias("usd"))
