"""What language models label: sessions, conflicts; and the shape of their questions and answers.

A model is any function from text to an answer; it runs on the executors, one
partition a caller, so that ``callers`` bounds how many ask at once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords of JSON schemas that models' answers can't be held to, by type. Fixed values.
UNSUPPORTED = {
    "number": ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"),
    "integer": ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"),
    "string": ("minLength", "maxLength", "pattern", "format"),
    "array": ("minItems", "maxItems", "uniqueItems"),
}
#: Fixed values of the labels.
TIERS = ("manual", "assisted", "autonomous")
CATEGORIES = ("sde", "admin", "strategy_business", "events", "thought_leadership", "other")
OUTCOMES = ("success", "partial", "failure", "unknown")
CONFLICTS = ("disagreement", "correction", "reversal", "impasse")
SEVERITIES = ("low", "medium", "high")


class Refused(Exception):
    """A model won't answer; asking again is no use."""


def plain_schema(schema: Any, shared: dict | None = None) -> Any:
    """A JSON schema without references and unsupported keywords, its objects closed."""
    if isinstance(schema, list):
        return [plain_schema(x, shared) for x in schema]
    if not isinstance(schema, dict):
        return schema
    if shared is None:
        shared = {**schema.get("definitions", {}), **schema.get("$defs", {})}
    if "$ref" in schema:
        return plain_schema(shared.get(schema["$ref"].split("/")[-1], {}), shared)
    kind = schema.get("type")
    drop = {"$defs", "definitions", *(UNSUPPORTED.get(kind, ()) if isinstance(kind, str) else ())}
    out = {k: plain_schema(v, shared) for k, v in schema.items() if k not in drop}
    return {"additionalProperties": False} | out if kind == "object" else out


def _object(value: Any) -> dict | None:
    """A JSON object, as one or as text, perhaps fenced."""
    if isinstance(value, dict):
        return value
    if not isinstance(value, str):
        return None
    body = value.strip()
    if body.startswith("```"):
        body = body.strip("`").removeprefix("json").strip()
    try:
        found = json.loads(body)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def answer_of(reply: dict) -> dict:
    """The object in a reply: its output, a block of output, or a block of text."""
    if reply.get("stop_reason") == "refusal":
        raise Refused("the model refused")
    blocks = [b for b in reply.get("content") or () if isinstance(b, dict)] if isinstance(reply.get("content"), list) else []
    told = [reply.get("output")] + [b.get(k) for b in blocks if b.get("type") == "output" for k in ("output", "json", "content")] + [b.get("text") for b in blocks if b.get("type") == "text"]
    for value in told:
        if (found := _object(value)) is not None:
            return found
    raise ValueError(f"no object in a reply of {sorted(reply)}")


Model = Callable[[str], dict]
ASKED = "session_id string, answer string, error string, refused boolean"


#: Tries of one question, and seconds of the first and the longest wait between two.
TRIES, FIRST_WAIT, LONGEST_WAIT = 10, 2.0, 60.0


class Unavailable(Exception):
    """A provider can't be used here; what needs it is left out, and the rest goes on."""


def patient(model: Model, tries: int = TRIES, first: float = FIRST_WAIT, longest: float = LONGEST_WAIT, sleep: Callable[[float], None] = time.sleep, final: tuple[type[Exception], ...] = (Refused, Unavailable)) -> Model:
    """``model`` asked again after doubling waits, up to ``tries`` times; what is in ``final`` is raised at once."""

    def run(text: str) -> dict:
        wait = first
        for left in reversed(range(tries)):
            try:
                return model(text)
            except final:
                raise
            except Exception:  # noqa: BLE001  any other failure may pass
                if not left:
                    raise
                sleep(wait)
                wait = min(2 * wait, longest)
        raise ValueError("no tries")

    return run


#: Makers of models by name; a maker imports what it needs when it is called.
PROVIDERS: dict[str, Callable[..., Model]] = {}


def provider(name: str):
    """Registers a maker of models."""

    def add(make: Callable[..., Model]) -> Callable[..., Model]:
        PROVIDERS[name] = make
        return make

    return add


@provider("echo")
def _echo(answer: dict | None = None) -> Model:
    """A model that gives one answer to everything; stands in where there is none."""
    return lambda text: dict(answer or {})


@provider("replies")
def _replies(call: Callable[[str], dict] | None = None, **options: Any) -> Model:
    """A model from a call that returns whole replies: the object in each, asked for patiently."""
    if call is None:
        raise Unavailable("this provider needs a call")
    return patient(lambda text: answer_of(call(text)), **options)


def model_of(name: str, **options: Any) -> Model:
    """The model of a provider by its name."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](**options)


def model_or_none(name: str, **options: Any) -> Model | None:
    """The same, or None where the provider can't be used here, so that a run goes on without it."""
    try:
        return model_of(name, **options)
    except (Unavailable, ImportError):
        return None


#: Tokens in and out of one question of each pipeline, the share of candidates that reach the model, and dollars for a million tokens. Fixed values.
QUESTIONS = {"classify": (8000, 300, 1.0), "conflicts": (6000, 400, 1.0), "friction": (200, 60, 0.5)}
PRICE = (3.0, 15.0)


def estimate(pipeline: str, candidates: int, price: tuple[float, float] = PRICE) -> dict:
    """What a run over so many candidates would ask and cost."""
    into, out, share = QUESTIONS[pipeline]
    calls = int(candidates * share)
    return {"pending": candidates, "calls": calls, "tokens_in": into, "tokens_out": out, "usd": round(calls * (into * price[0] + out * price[1]) / 1e6, 4)}


def ask(texts: DataFrame, model: Model, callers: int = 8) -> DataFrame:
    """session_id and the answer to each transcript, or its error; a refusal is one that is final."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for sid, text in zip(frame["session_id"], frame["transcript"], strict=True):
                try:
                    out.append((sid, json.dumps(model(text)), None, False))
                except Refused as e:
                    out.append((sid, None, str(e), True))
                except Exception as e:  # noqa: BLE001  any failure of a model is tried again later
                    out.append((sid, None, str(e)[:2000], False))
            yield pd.DataFrame(out, columns=["session_id", "answer", "error", "refused"])

    return texts.select("session_id", "transcript").repartition(callers).mapInPandas(run, ASKED)


def failures(asked: DataFrame, parity: bool = False) -> DataFrame:
    """unit_id and error of what to try again; refusals are not, unless ``parity``."""
    again = F.col("answer").isNull() & (F.lit(parity) | ~F.col("refused"))
    return asked.where(again).select(F.col("session_id").alias("unit_id"), "error")


def _told(path: str, allowed: tuple[str, ...] | None = None) -> Column:
    value = F.get_json_object("answer", f"$.{path}")
    return (F.when(value.isin(*allowed), value) if allowed else value).alias(path)


def classifications(asked: DataFrame, at: Column | None = None) -> DataFrame:
    """A row for each answered session; labels that are not known are null."""
    return asked.where("answer is not null").select(
        "session_id",
        _told("autonomy_tier", TIERS),
        _told("work_category", CATEGORIES),
        _told("success", OUTCOMES),
        _told("goal"),
        F.coalesce(F.get_json_object("answer", "$.confidence").try_cast("float"), F.lit(0.0).cast("float")).alias("confidence"),
        (at if at is not None else F.current_timestamp()).alias("classified_at"),
    )


def conflicts(asked: DataFrame, messages: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """A row for each conflict told of two different turns, both of the session where its turns are known."""
    fields = "array<struct<turn_a_uuid:string,turn_b_uuid:string,conflict_kind:string,severity:string,agent_position:string,user_position:string,confidence:string>>"
    rows = asked.where("answer is not null").select("session_id", F.explode(F.from_json(F.get_json_object("answer", "$.conflicts"), fields)).alias("c")).select("session_id", "c.*")
    rows = rows.where("turn_a_uuid <> '' and turn_b_uuid <> '' and turn_a_uuid <> turn_b_uuid")
    if messages is not None:
        turns = messages.select("session_id", "uuid").distinct()
        known = turns.select("session_id").distinct().withColumn("known", F.lit(True))
        a, b = (turns.select("session_id", F.col("uuid").alias(f"turn_{x}_uuid"), F.lit(True).alias(x)) for x in "ab")
        rows = rows.join(known, "session_id", "left").join(a, ["session_id", "turn_a_uuid"], "left").join(b, ["session_id", "turn_b_uuid"], "left")
        rows = rows.where(F.col("known").isNull() | (F.col("a") & F.col("b")))
    kind = lambda c, allowed: F.when(F.col(c).isin(*allowed), F.col(c)).alias(c)
    return rows.select(
        "session_id",
        "turn_a_uuid",
        "turn_b_uuid",
        kind("conflict_kind", CONFLICTS),
        kind("severity", SEVERITIES),
        "agent_position",
        "user_position",
        F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        (at if at is not None else F.current_timestamp()).alias("detected_at"),
    )
