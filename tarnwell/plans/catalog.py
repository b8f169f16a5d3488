"""All views of a corpus under one roof, as frames and as names for SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell import schemas
from tarnwell.operators import analytics, macros, stamps, vectors, views
from tarnwell.sources import store, transcripts

#: Exit codes. Fixed values.
NO_EMBEDDINGS, INVALID, CATALOG, RUNTIME, MISSING = 2, 64, 65, 70, 127


def exit_code(error: BaseException) -> int:
    if isinstance(error, ParseException | ValueError):
        return INVALID
    if isinstance(error, AnalysisException | KeyError):
        return CATALOG
    if isinstance(error, FileNotFoundError):
        return MISSING
    return RUNTIME


@dataclass
class Corpus:
    """Frames of a corpus: raw files below ``root`` (or the globs given) and tables below ``tables``. All lazy."""

    spark: SparkSession
    root: str | None = None
    globs: dict[str, str] = field(default_factory=dict)
    tables: str | Path | None = None
    min_chars: int = 32

    def _glob(self, kind: str) -> str:
        if kind in self.globs:
            return self.globs[kind]
        if self.root is None:
            raise KeyError(f"no pattern of {kind}")
        return transcripts.corpus_globs(self.root)[kind]

    @cached_property
    def events(self) -> DataFrame:
        events = transcripts.raw_events(self.spark, self._glob("events"))
        return transcripts.with_parts(events, f"{self.root}/*") if self.root else events

    @cached_property
    def raw_subagents(self) -> DataFrame:
        return transcripts.raw_subagents(self.spark, self._glob("subagents"))

    @cached_property
    def raw_meta(self) -> DataFrame:
        return transcripts.raw_subagent_meta(self.spark, self._glob("meta"))

    @cached_property
    def views(self) -> dict[str, DataFrame]:
        v: dict[str, DataFrame] = {"sessions": views.sessions(self.events), "messages": views.messages(self.events)}
        v["content_blocks"] = views.content_blocks(v["messages"])
        v["messages_text"] = views.messages_text(v["content_blocks"], self.min_chars)
        v["turn_window"] = views.turn_window(v["messages_text"])
        v["tool_calls"], v["tool_results"] = views.tool_calls(v["content_blocks"]), views.tool_results(v["content_blocks"])
        v["todo_events"] = views.todo_events(v["tool_calls"])
        v["todo_state_current"] = views.todo_state_current(v["todo_events"])
        v["subagent_spawns"], v["task_creations"], v["task_updates"] = (f(v["tool_calls"]) for f in (views.subagent_spawns, views.task_creations, views.task_updates))
        v["tasks_state_current"] = views.tasks_state_current(v["task_creations"], v["task_updates"], v["tool_results"])
        v["skill_invocations"] = views.skill_invocations(v["tool_calls"], v["content_blocks"], v["messages"], v["messages_text"])
        v["subagent_sessions"] = views.subagent_sessions(self.raw_subagents, self.raw_meta)
        v["subagent_messages"] = views.subagent_messages(self.raw_subagents)
        return v

    def ready(self, name: str) -> bool:
        return self.tables is not None and store.ready(Path(self.tables) / name)

    @cached_property
    def analytics(self) -> dict[str, DataFrame]:
        """Views of the tables that hold something; the others do not exist."""
        shape: dict[str, Callable[[DataFrame], DataFrame]] = {"session_classifications": analytics.session_classifications, "message_trajectory": analytics.message_trajectory}
        names = [n for n in schemas.TABLES if n not in ("session_checkpoint", "retry_queue") and self.ready(n)]
        out = {n: shape.get(n, lambda df: df)(store.read(self.spark, Path(self.tables) / n)) for n in names}
        if "session_classifications" in out:
            out["session_goals"] = analytics.session_goals(out["session_classifications"])
        if "session_conflicts" in out:
            out["conflicts_summary"] = analytics.conflicts_summary(out["session_conflicts"])
        out["skill_usage"] = analytics.skill_usage(self.views["skill_invocations"], out.get("skills_catalog"))
        return out

    def table(self, name: str) -> DataFrame:
        if name in self.views:
            return self.views[name]
        return self.analytics[name]

    def register(self) -> list[str]:
        """Temp views of everything that exists, and the macros that SQL can express; their names."""
        found = self.views | self.analytics
        for name, df in found.items():
            df.createOrReplaceTempView(name)
        return sorted([*found, *self._functions(found)])

    def _functions(self, found: dict[str, DataFrame]) -> list[str]:
        rates = ", ".join(f"('{m}', {a}D, {b}D)" for m, (a, b) in macros.RATES.items())
        recent = "current_timestamp() - make_dt_interval(days)"
        ddl = {
            "ago": ("what string", "timestamp", (), "current_timestamp() - cast(what as interval day to second)"),
            "model_used": ("sid string", "string", ("messages",), "(select any_value(model, true) from messages where session_id = sid)"),
            "cost_estimate": ("sid string", "double", ("messages",), f"(select sum(((coalesce(input_tokens, 0) + coalesce(cache_write, 0)) * r.i + coalesce(output_tokens, 0) * r.o) / 1e6D) from messages m join values {rates} as r(model, i, o) on r.model = regexp_replace(m.model, '-\\\\d{{8}}$', '') where m.session_id = sid)"),
            "todo_velocity": ("sid string", "double", ("todo_events",), "(select count_if(status = 'completed') / nullif(count(distinct subject), 0) from todo_events where session_id = sid)"),
            "subagent_fanout": ("sid string", "bigint", ("subagent_sessions",), "(select count(*) from subagent_sessions where parent_session_id = sid)"),
            "tool_rank": ("days int", "table(tool_name string, n bigint)", ("tool_calls",), f"select tool_name, count(*) as n from tool_calls where ts >= {recent} group by tool_name"),
            "work_mix": ("days int", "table(work_category string, n bigint)", ("session_classifications",), f"select work_category, count(*) as n from session_classifications where classified_at >= {recent} group by work_category"),
            "friction_counts": ("days int", "table(label string, n bigint, sessions bigint, avg_confidence double)", ("user_friction",), f"select label, count(*), count(distinct session_id), avg(confidence) from user_friction where label <> 'none' and (days is null or ts >= {recent}) group by label"),
            "cluster_top_terms": ("cid int, most int", "table(term string, weight float, rank int)", ("cluster_terms",), "select term, weight, rank from (select *, row_number() over (order by rank, term) as nr from cluster_terms where cluster_id = cid) where nr <= most"),
        }
        made = []
        for name, (args, kind, needs, body) in ddl.items():
            if all(n in found for n in needs):
                self.spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")
                made.append(name)
        return made

    def sql(self, text: str) -> DataFrame:
        """A query; views are bound only where it names one."""
        if uses_catalog(text):
            self.register()
        return self.spark.sql(text)

    def explain(self, text: str, mode: str = "formatted") -> str:
        return self.spark._jvm.PythonSQLUtils.explainString(self.sql(text)._jdf.queryExecution(), mode)

    def search(self, text: str, k: int = 10, session_id: str | None = None, embedder: vectors.Embedder | None = None) -> DataFrame | None:
        """The k messages nearest to a text; None where there are no vectors. Without ``embedder`` the hashing one of their size."""
        table = store.read(self.spark, Path(self.tables) / "message_embeddings", name="message_embeddings")
        known = store.identity(table)
        if known is None:
            return None
        embedder = embedder or vectors.HashingEmbedder(known[1])
        store.guard(known, embedder.model, embedder.dim)
        return vectors.search(table, self.views["messages_text"], embedder.query(text), k, session_id)

    def skills(self, kind: str | None = None, plugin: str | None = None) -> DataFrame:
        """The skills catalog, of one kind or plugin if given."""
        if not self.ready("skills_catalog"):
            raise FileNotFoundError("there is no skills catalog; run the skills stage first")
        rows = store.read(self.spark, Path(self.tables) / "skills_catalog")
        for column, value in (("source_kind", kind), ("plugin", plugin)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        return rows.orderBy("skill_id", "source_kind")

    def canonical(self, mode: str = "earliest") -> DataFrame:
        return stamps.canonical(self.table("ingest_stamps"), mode)


def uses_catalog(text: str) -> bool:
    """Whether a query names one of our views, tables or macros."""
    words = set(re.findall(r"[a-z_]\w*", text.lower()))
    return bool(words & {*schemas.VIEWS, *schemas.TABLES, *macros.SIGNATURES, "skill_usage", "session_goals", "conflicts_summary"})


def schema() -> dict[str, list[tuple[str, str]]]:
    """Columns of the views, without reading anything."""
    return {name: [tuple(c.split(" ", 1)) for c in re.split(r", (?=\w+ \w)", ddl)] for name, ddl in schemas.VIEWS.items()}


def list_macros() -> list[tuple[str, str]]:
    return sorted(macros.SIGNATURES.items())


def list_cache(tables: str | Path) -> list[dict]:
    out = []
    for name in sorted(schemas.TABLES):
        path = Path(tables) / name
        found = store.parts(path)
        if found:
            out.append({"table": name, "parts": len(found), "bytes": sum(p.stat().st_size for p in found), "rows": store.footer_rows(path)})
    return out
