"""The chain of pipelines; each reads and writes tables below one folder. By default it only says what it would do."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import functions as F

from tarnwell import schemas
from tarnwell.operators import clusters, friction, graph, models, stamps, state, terms, trajectory, transcript, vectors
from tarnwell.plans.catalog import Corpus
from tarnwell.plans.checkpoints import checkpointed
from tarnwell.sources import skills, store

STAGES = ("skills", "ingest", "embed", "cluster", "terms", "community", "classify", "trajectory", "conflicts", "friction")


def run_analyze(corpus: Corpus, *, embedder: vectors.Embedder | None = None, friction_model: friction.Model | None = None, session_models: dict[str, models.Model] | None = None, trajectory_model: trajectory.Model | None = None, skip: tuple[str, ...] = (), dry_run: bool = True, days: float | None = 30, limit: int | None = None, force: bool = False, min_cluster: int = 20) -> dict[str, dict]:
    """Stages in order with what each did. Views are bound anew after each write, so the next one reads its rows."""
    spark, base = corpus.spark, Path(corpus.tables)
    embedder = embedder or vectors.HashingEmbedder()
    at = lambda name: base / name
    text = corpus.views["messages_text"]
    read = lambda name: store.read(spark, at(name), name=name).select(*[c.split()[0] for c in schemas.TABLES[name].split(", ")])

    def ingest() -> dict:
        todo = stamps.pending(text, read("ingest_stamps"), days, limit)
        if dry_run:
            return {"pending": todo.count()}
        if todo.limit(1).count():  # an empty shard would make everything downstream stale
            store.append(stamps.stamp(todo), at("ingest_stamps"))
            store.overwrite(stamps.resolve(read("ingest_stamps")), at("ingest_stamps"))
        return {"stamped": store.footer_rows(at("ingest_stamps"))}

    def embed() -> dict:
        old = read("message_embeddings")
        store.guard(store.identity(old), embedder.model, embedder.dim)
        todo = vectors.unembedded(text, old, read("ingest_stamps"), days, limit)
        if dry_run:
            return {"pending": todo.count()}
        if todo.limit(1).count():
            store.append(vectors.embed(todo, embedder), at("message_embeddings"))
        return {"vectors": store.footer_rows(at("message_embeddings"))}

    def derived(name: str, source: str, make: Callable) -> dict:
        mtime = store.table_mtime(at(source))
        sidecar = base / f".{name}.json"
        if mtime is None:
            return {"skipped": f"no {source}"}
        if not force and store.is_fresh(at(name), mtime, sidecar):
            return {"fresh": True}
        if dry_run:
            return {"rows": store.footer_rows(at(source))}
        store.overwrite(make(), at(name))
        store.stamp(sidecar, mtime)
        return {"rows": store.footer_rows(at(name))}

    def community() -> dict:
        def make():
            table, profile = graph.session_communities(vectors.centroids(read("message_embeddings"), corpus.views["messages"]))
            if profile:
                rows = [(float(r["gamma"]), int(r["n_communities"]), float(r["quality"]), int(r["plateau_length"])) for r in profile]
                store.overwrite(spark.createDataFrame(rows, schemas.TABLES["community_profile"]), at("community_profile"))
            return table

        return derived("session_communities", "message_embeddings", make)

    def waiting(pipeline: str):
        bounds = transcript.session_bounds(corpus.views["messages"], days=days, limit=limit).withColumn("mtime", F.col("last_ts").cast("timestamp"))
        return state.pending_sessions(bounds, read("session_checkpoint"), pipeline)

    def finish(pipeline: str, name: str, rows, sessions, failed=None) -> dict:
        """Rows replace those of their sessions; sessions are checked off; failures wait for another try."""
        sessions = checkpointed(sessions)
        rows = checkpointed(rows.select(*[c.split()[0] for c in schemas.TABLES[name].split(", ")]))
        store.replace_by_key(spark, at(name), "session_id", sessions)
        store.append(rows, at(name))
        store.overwrite(state.mark_completed(read("session_checkpoint"), sessions, pipeline), at("session_checkpoint"))
        if failed is not None and failed.limit(1).count():
            store.overwrite(state.enqueue(read("retry_queue"), failed, pipeline, F.current_timestamp()), at("retry_queue"))
        return {"sessions": sessions.count(), "rows": rows.count()}

    def by_session(pipeline: str, name: str, shape: Callable) -> dict:
        todo = waiting(pipeline)
        model = (session_models or {}).get(pipeline)
        if dry_run or model is None:
            return models.estimate(pipeline, todo.count())
        events = transcript.timeline(text, corpus.views["tool_calls"], corpus.views["tool_results"]).join(todo, "session_id", "left_semi")
        asked = checkpointed(models.ask(transcript.assemble(events, uuids=pipeline == "conflicts"), model))
        answered = todo.join(asked.where("answer is not null or refused").select("session_id"), "session_id", "left_semi")
        return finish(pipeline, name, shape(asked), answered, models.failures(asked))

    def arcs() -> dict:
        todo = waiting("trajectory")
        if dry_run or trajectory_model is None:
            return {"pending": todo.count()}
        rows = checkpointed(trajectory.windows(corpus.views["turn_window"], text, todo))
        return finish("trajectory", "message_trajectory", trajectory.trajectory(rows, trajectory_model), todo)

    def label() -> dict:
        full = corpus.views["content_blocks"]
        from tarnwell.operators import views

        short = views.messages_text(full, min_chars=1)
        done = read("user_friction").select("uuid")
        todo = short.join(done, "uuid", "left_anti")
        if dry_run:
            return models.estimate("friction", friction.candidates(todo, days).count())
        # Rules look at whole conversations; only new messages are written.
        found = friction.friction(short, corpus.views["messages"], friction_model, days).join(done, "uuid", "left_anti")
        store.append(found.select(*[c.split()[0] for c in schemas.TABLES["user_friction"].split(", ")]), at("user_friction"))
        return {"rows": store.footer_rows(at("user_friction"))}

    def sync() -> dict:
        if dry_run:
            return {"rows": sum(1 for _ in skills.walk(corpus.globs.get("skills"), corpus.globs.get("plugins")))}
        store.overwrite(skills.catalog(spark, corpus.globs.get("skills"), corpus.globs.get("plugins")), at("skills_catalog"))
        return {"rows": store.footer_rows(at("skills_catalog"))}

    todo: dict[str, Callable[[], dict]] = {
        "skills": sync,
        "ingest": ingest,
        "embed": embed,
        "cluster": lambda: derived("message_clusters", "message_embeddings", lambda: clusters.message_clusters(read("message_embeddings"), min_size=min_cluster)),
        "terms": lambda: derived("cluster_terms", "message_clusters", lambda: terms.cluster_terms(read("message_clusters"), text)),
        "community": community,
        "classify": lambda: by_session("classify", "session_classifications", models.classifications),
        "trajectory": arcs,
        "conflicts": lambda: by_session("conflicts", "session_conflicts", lambda asked: models.conflicts(asked, corpus.views["messages"])),
        "friction": label,
    }
    out = {}
    for name in STAGES:
        if name not in skip:
            out[name] = todo[name]()
            corpus.__dict__.pop("analytics", None)
    return out


def counts(corpus: Corpus) -> dict[str, int]:
    return {n: df.agg(F.count(F.lit(1)).alias("n")).first()["n"] for n, df in corpus.views.items()}
