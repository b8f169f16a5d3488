import datetime
import math
import random
import re
import unicodedata
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.operators import clusters, friction, graph, macros, stamps, state, terms, trajectory, vectors
from tarnwell.plans import analyze, catalog
from tarnwell.sources import skills, store
from tarnwell.streaming import watch
from tests.transcripts import write


@given(st.text(max_size=80), st.text(max_size=80))
@settings(max_examples=60, deadline=None)
def test_simhash_is_a_signed_word(a, b):
    x, y = stamps.simhash64(a), stamps.simhash64(b)
    assert -(2**63) <= x < 2**63 and stamps.simhash64(a) == x
    assert bin((x ^ y) & (2**64 - 1)).count("1") <= 64


def test_simhash_near_and_far():
    base = "the quick brown fox jumps over the lazy dog and runs far away from the noisy town " * 3
    apart = lambda a, b: bin((stamps.simhash64(a) ^ stamps.simhash64(b)) & (2**64 - 1)).count("1")
    assert stamps.simhash64("") == 0 == stamps.simhash64(None) and stamps.simhash64("one two") != 0
    assert apart(base, base.replace("lazy dog and", "lazy cat and", 1)) <= 20 < apart(base, "entirely other words stand here today with no relation whatsoever")


@given(st.integers(0, 5_000_000), st.integers(0, 5_000_000))
def test_budgets_are_monotone(a, b):
    names = [n for _, n in stamps.BUDGETS] + ["xl"]
    at = lambda n: next((i for i, (most, _) in enumerate(stamps.BUDGETS) if n <= most), 4)
    assert (at(a) <= at(b)) or a > b
    assert names[at(0)] == "xs"


@pytest.mark.parametrize("exact", [False, True])
def test_canonical_modes(spark, exact):
    draw = random.Random(3)
    base = [draw.getrandbits(63) for _ in range(5)]
    rows = []
    for k in range(60):
        sig = draw.choice(base)
        for _ in range(draw.randint(0, 3)):
            sig ^= 1 << draw.randint(0, 62)
        rows.append((f"m{k:02d}", sig, datetime.datetime(2024, 1, 1, 0, 0, draw.randint(0, 20))))
    df = spark.createDataFrame(rows, "uuid string, simhash64 long, first_seen_ts timestamp")

    def near(a, b):
        return bin(a ^ b).count("1") <= 3 and (exact or a >> 48 == b >> 48)

    for mode in ("macro", "worker", "earliest"):
        got = {r[0]: r[1] for r in stamps.canonical(df, mode, exact=exact).collect()}
        for u, s, t in rows:
            around = [(u2, t2) for u2, s2, t2 in rows if near(s, s2)]
            want = {"macro": min(x for x, t2 in around if t2 <= t), "worker": min([x for x, t2 in around if t2 < t], default=u), "earliest": min(around, key=lambda x: (x[1], x[0]))[0]}[mode]
            assert got[u] == want, (mode, u)


def points(seed=1):
    draw = np.random.default_rng(seed)
    return [(f"s{k:02d}", (np.eye(8)[k % 3] + draw.normal(0, 0.05, 8)).tolist()) for k in range(30)]


def test_graph(spark):
    df = spark.createDataFrame(points(), "session_id string, centroid array<double>")
    x = np.array([p for _, p in points()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    top = np.argsort(-sim, axis=1)[:, :4]
    want = {(i, j) for i in range(30) for j in top[i] if i < j and i in top[j]}
    for blocks in (1, 3):
        got = vectors.knn(df, "session_id", "centroid", 4, blocks=blocks)
        assert {(r["src"], r["dst"]) for r in got.collect()} == {(f"s{i:02d}", f"s{j:02d}") for i in range(30) for j in top[i]}
    assert {(int(r["src"][1:]), int(r["dst"][1:])) for r in graph.mutual_knn(df, "session_id", "centroid", 4).collect()} == want
    table, none = graph.session_communities(df, k=9, floor=0.5, gamma=0.3)
    found = {r["session_id"]: r["community_id"] for r in table.collect()}
    assert all(len({found[f"s{k:02d}"] for k in range(g, 30, 3)}) == 1 for g in range(3)) and len(set(found.values())) == 3
    assert none == [] and table.where("is_medoid").count() == 3
    again, _ = graph.session_communities(df, k=9, floor=0.5, gamma=0.3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, table.collect()))


def test_profile_ends_in_a_table(spark):
    df = spark.createDataFrame(points(), "session_id string, centroid array<double>")
    table, profile = graph.session_communities(df, k=6, floor=0.5)
    assert table.count() == 30 and profile[0]["gamma"] == pytest.approx(0.05) and sum(r["plateau_length"] for r in profile) == 9000


def test_medoids_against_numpy(spark):
    df = spark.createDataFrame([(n, p, int(n[1:]) % 3) for n, p in points()], "id string, v array<double>, community int")
    got = {r["community"]: r for r in graph.medoids(df.withColumnRenamed("id", "k"), df, "k", "v").collect()}
    for c in range(3):
        x = np.array([p for n, p in points() if int(n[1:]) % 3 == c])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sim = x @ x.T
        mean = (sim.sum(1) - 1) / (len(x) - 1)
        assert got[c]["medoid"] == f"s{3 * int(np.argmax(mean)) + c:02d}" and got[c]["coherence"] == pytest.approx(mean.mean())


def test_zoom_and_relabel(spark):
    profile = [{"gamma": 0.1, "n_communities": 1, "plateau_length": 10}, {"gamma": 0.2, "n_communities": 3, "plateau_length": 40}, {"gamma": 0.6, "n_communities": 9, "plateau_length": 40}]
    assert [graph.pick_zoom(profile, z) for z in ("medium", "coarse", "fine")] == [0.2, 0.2, 0.6]
    df = spark.createDataFrame([(i, c) for i, c in enumerate("bbaacccd")], "id int, community string")
    assert {tuple(r) for r in graph.relabel(df).collect()} == {(0, 1, 2), (1, 1, 2), (2, 2, 2), (3, 2, 2), (4, 0, 3), (5, 0, 3), (6, 0, 3), (7, -1, 0)}
    edges = spark.createDataFrame([(0, 2), (1, 3)], "src int, dst int")
    assert {r["component"] for r in graph.connected(edges, df.select("id")).collect()} == {0, 1, 4, 5, 6, 7}


def ctfidf_reference(docs: dict, top: int = 10, min_df: int = 2, max_df: float = 0.95) -> list[tuple]:
    """Term weights in plain Python."""
    strip = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    counts = {}
    for k, body in docs.items():
        words = re.findall(r"\b\w\w+\b", strip(body.lower()))
        counts[k] = Counter(words) + Counter(" ".join(p) for p in zip(words, words[1:], strict=False))
    spread, f = Counter(t for c in counts.values() for t in c), Counter()
    for c in counts.values():
        f.update(c)
    keep = {t for t, n in spread.items() if min_df <= n <= max_df * len(docs)}
    out = []
    for k, c in counts.items():
        total = sum(n for t, n in c.items() if t in keep)
        ranked = sorted(((n / total * math.log(1 + 1 / f[t]), t) for t, n in c.items() if t in keep), key=lambda x: (-round(x[0], 12), x[1]))
        out += [(k, t, w, i) for i, (w, t) in enumerate(ranked[:top], 1) if w > 0]
    return out


def test_terms_against_plain_python(spark):
    draw = random.Random(2)
    words = "alpha beta gamma delta épée naïve words over there is".split()
    docs = {k: " ".join(draw.choice(words[: 4 + k]) for _ in range(80)) for k in range(5)}
    df = spark.createDataFrame(list(docs.items()), "c int, body string")
    got = {(r["c"], r["term"]): (r["weight"], r["rank"]) for r in terms.ctfidf(df, "c", "body").collect()}
    want = {(k, t): (w, i) for k, t, w, i in ctfidf_reference(docs)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_hdbscan_finds_blobs():
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(c, 0.1, (40, 3)) for c in (0, 5, 10)] + [draw.uniform(-20, 30, (6, 3))])
    labels = clusters.hdbscan(x, 20, 5)
    assert [len(set(labels[k * 40 : k * 40 + 40]) - {-1}) for k in range(3)] == [1, 1, 1] and len(set(labels) - {-1}) == 3
    assert (clusters.hdbscan(x[:5], 20, 5) == -1).all()


def test_message_clusters(spark):
    rows = [(f"u{k:03d}", (np.eye(6)[k % 2] + np.random.default_rng(k).normal(0, 0.02, 6)).tolist()) for k in range(80)]
    df = spark.createDataFrame(rows, "uuid string, embedding array<double>")
    got = {r["uuid"]: r["cluster_id"] for r in clusters.message_clusters(df, dims=3, min_size=10, components=True).collect()}
    assert len(got) == 80 and len({got[f"u{k:03d}"] for k in range(0, 80, 2)} - {-1}) == 1
    many = clusters.message_clusters(df, dims=3, min_size=10, components=True, band=25, block=16, plane=True).cache()
    assert {r["uuid"]: r["cluster_id"] for r in many.collect()} == got and many.where("x is not null").count() == 80
    laid = {r["uuid"]: r["cluster_id"] for r in clusters.message_clusters(df, dims=2, min_size=10, neighbours=15, rounds=3).collect()}
    of = [{laid[f"u{k:03d}"] for k in range(g, 80, 2)} - {-1} for g in (0, 1)]
    assert len(laid) == 80 and all(of) and not of[0] & of[1]  # groups don't mix


def test_spanning_tree_on_executors(spark):
    draw = np.random.default_rng(9)
    x = np.round(draw.normal(0, 1, (70, 2)), 1)
    x[60:] = x[:10]  # equal points and equal distances
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 3]
    want = sorted(w for w, _, _ in clusters.spanning_tree(x, core))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "nr long, point array<double>")
    got = clusters.reachability_tree(df, 3, block=20).collect()
    assert sorted(r["weight"] for r in got) == pytest.approx(want) and len({n for r in got for n in (r["low"], r["high"])}) == 70


def text_rows(spark, rows):
    return spark.createDataFrame([(u, s, datetime.datetime(2024, 1, 1, 0, m), r, t) for u, s, m, r, t in rows], "uuid string, session_id string, ts timestamp_ntz, role string, text_content string")


def test_friction_rules(spark):
    rows = [("q0", "s", 0, "user", "Please fix  the test"), ("q1", "s", 5, "user", "please FIX the test"), ("q2", "s", 6, "user", "Undo! that"), ("q3", "s", 8, "user", "why is that?")]
    rows += [(f"f{k:02d}", "t", k, "user", "again and again" if k in (0, 12) else f"filler {k}") for k in range(13)]
    df = text_rows(spark, rows)
    assert {r[0] for r in friction.repeated(df).collect()} == {"q1"}
    assert {r[0] for r in friction.imperative(df).collect()} == {"q2"}
    at = lambda s, m: (s, datetime.datetime(2024, 1, 1, 0, m))
    for errors, want in (([at("s", 7)], {"q3"}), ([at("s", 5)], set()), ([at("s", 8)], set()), ([at("s", 6)], {"q3"})):
        frame = spark.createDataFrame(errors, "session_id string, ts timestamp_ntz")
        assert {r[0] for r in friction.question_after_error(df, frame).collect()} == want, errors


def test_friction_patterns_and_model(spark):
    said = {"any update?": "status_ping", "How's it going": "status_ping", "what's the status column called": None, "hold on": "interruption", "No, wrong": "correction", "nothing to see": None, "wait a moment": "interruption", "where are we at with it": "status_ping"}
    df = text_rows(spark, [(f"m{i}", "s", i, "user", t) for i, t in enumerate(said)] + [("z", "s", 40, "user", "[Request interrupted by user for tool use]")])
    got = {r[0]: r[1] for r in df.select("text_content", friction.pattern_label(F.col("text_content"))).collect()}
    assert all(got[t] == v for t, v in said.items())
    out = friction.friction(df, model=lambda texts: [None if "column" in t else ("confusion", "so it seems", 0.6) for t in texts])
    found = {r["uuid"]: (r["label"], r["source"]) for r in out.collect()}
    assert found["m2"] == ("none", "refused") and found["m5"] == ("confusion", "llm") and found["m0"] == ("status_ping", "regex") and "z" not in found


def test_trajectory(spark):
    df = text_rows(spark, [(f"m{i:02d}", "s", i, "user" if i % 2 else "assistant", f"text <{i}> & more") for i in range(20)])
    from tarnwell.operators import views

    rows = trajectory.windows(views.turn_window(df), df)
    asked = {r["chunk"]: r["prompt"] for r in trajectory.prompts(rows).collect()}
    assert len(asked) == 2 and asked[0].count("<window") == 16 and asked[1].startswith("<window idx=0>") and "&lt;3&gt; &amp; more" in asked[0]

    def model(prompt):
        return [{"prev_uuid": "m01", "curr_uuid": "m02", "prev_sentiment": "negative", "curr_sentiment": "positive", "delta": "x", "transition_kind": "odd"}, {"prev_uuid": "no", "curr_uuid": "no"}]

    got = {r["curr_uuid"]: r for r in trajectory.trajectory(rows, model).collect()}
    assert len(got) == 20 and got["m02"]["delta"] == 2.0 and got["m02"]["transition_kind"] == "none"
    assert got["m00"]["delta"] is None and got["m05"]["confidence"] == 0 and got["m05"]["delta"] == 0


def test_state(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    queue = spark.createDataFrame([], "pipeline string, unit_id string, error string, attempts int, next_attempt_at timestamp, created_at timestamp, completed_at timestamp")
    failed = spark.createDataFrame([("a", "e" * 3000), ("b", "x")], "unit_id string, error string")
    for _ in range(3):
        queue = state.enqueue(queue, failed, "p", now)
    got = {r["unit_id"]: r for r in queue.collect()}
    assert got["a"]["attempts"] == 3 and len(got["a"]["error"]) == 2000 and got["a"]["next_attempt_at"] == datetime.datetime(2024, 1, 1, 0, 8)
    later = F.lit("2024-01-01 01:00:00").cast("timestamp")
    assert state.due(queue, "p", now).count() == 0 and state.due(queue, "p", later).count() == 2 and state.due(queue, "other", later).count() == 0
    queue = state.mark_done(queue, failed.where("unit_id = 'a'"), "p", later)
    assert state.pending_count(queue, "p").first()["n"] == 1


def test_refresh_of_files_that_grow(spark, tmp_path):
    root = write(tmp_path / "c")
    table = watch.RawTable(spark, f"{root}/project/*.jsonl")
    n = table.register().where("uuid is not null").count()
    path = root / "project" / "s2.jsonl"
    line = path.read_text().splitlines()[0].replace('"v1"', '"v9"')
    path.write_text(path.read_text() + line + "\n")
    assert table.refresh().modified == (str(path),) and table.frame.where("uuid is not null").count() == n + 1
    assert table.refresh() == watch.Diff()
    path.unlink()
    assert table.refresh().removed == (str(path),) and table.frame.where("uuid is not null").count() == 8
    assert table.snapshot.refreshes == 3 and table.snapshot.files == 1


def test_streaming_source(spark, tmp_path):
    root = write(tmp_path / "c")
    table = watch.RawTable(spark, f"{root}/project/*.jsonl")
    table.register()
    path = root / "project" / "s1.jsonl"
    path.write_text(path.read_text() + path.read_text().splitlines()[0].replace('"u1"', '"u9"') + "\n")
    query = watch.stream_raw(spark, table.pattern, table, str(tmp_path / "state"))
    query.awaitTermination(60)
    query.stop()
    assert table.frame.where("uuid = 'u9'").count() == 1


def test_windows(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, m // 60, m % 60), "a") for m in (0, 5, 61)], "ts timestamp_ntz, k string")
    assert [r["n"] for r in watch.windowed(df, "ts", "1 hour", keys=("k",)).orderBy("window_start").collect()] == [2, 1]
    assert [r["n"] for r in watch.sessionized(df, "ts", "10 minutes", ("k",)).orderBy("session_start").collect()] == [2, 1]


def test_store(spark, tmp_path):
    path = tmp_path / "t"
    assert not store.ready(path) and store.read(spark, path, name="retry_queue").count() == 0
    with pytest.raises(FileNotFoundError):
        store.read(spark, path)
    for k in range(3):
        store.append(spark.createDataFrame([(f"k{k}", k)], "key string, n int").coalesce(1), path)
    assert store.footer_rows(path) == 3 and store.compact(spark, path)["compacted"] is False
    assert store.compact(spark, path, dry_run=False)["compacted"] and len(store.parts(path)) == 1
    assert store.replace_by_key(spark, path, "key", store.ids_frame(spark, "key", ["k1", "zz"])) == 1 and store.footer_rows(path) == 2
    stamp = store.table_mtime(path)
    store.stamp(tmp_path / "side.json", stamp)
    assert store.is_fresh(path, stamp, tmp_path / "side.json") and not store.is_fresh(path, stamp + 1, tmp_path / "side.json")
    with pytest.raises(ValueError):
        store.guard(("m", 3), "m", 4)
    store.guard(None, "m", 4)


def test_skills_catalog(spark, tmp_path):
    user, plugins = tmp_path / "skills", tmp_path / "plugins"
    (user / "one").mkdir(parents=True)
    (user / "one" / "SKILL.md").write_text("---\nname: first\ndescription: 'does it'\n---\nbody")
    for version in ("1.2.0", "1.10.0"):
        base = plugins / "owner" / "tool" / version
        (base / "commands").mkdir(parents=True)
        (base / "commands" / "go.md").write_text(f"---\ndescription: {version}\n---\n")
    got = {(r["skill_id"], r["source_kind"]): r for r in skills.catalog(spark, user, plugins).collect()}
    assert got["first", "user-skill"]["description"] == "does it" and got["tool:go", "plugin-command"]["plugin_version"] == "1.10.0" and ("go", "plugin-command") in got
    assert ("help", "builtin") in got
    used = spark.createDataFrame([("go", datetime.datetime(2024, 1, 1))], "skill_id string, ts timestamp_ntz")
    assert {r["skill_id"] for r in macros.unused_skills(skills.catalog(spark, user, plugins), used, None).collect()} == {"first", "tool:go"}


def test_analyze(spark, tmp_path):
    root = write(tmp_path / "c")
    corpus = catalog.Corpus(spark, str(root), tables=str(tmp_path / "tables"))
    plan = analyze.run_analyze(corpus, days=None)
    assert plan["ingest"]["pending"] > 0 and not Path(corpus.tables).exists()
    done = analyze.run_analyze(corpus, days=None, dry_run=False, min_cluster=2)
    assert done["ingest"]["stamped"] >= done["embed"]["vectors"] > 0 and done["friction"]["rows"] > 0
    again = analyze.run_analyze(corpus, days=None, dry_run=False, min_cluster=2)
    assert again["cluster"] == {"fresh": True} and again["embed"] == done["embed"]
    assert "user_friction" in corpus.analytics and corpus.ready("session_communities")
    assert {x["table"] for x in catalog.list_cache(corpus.tables)} >= {"ingest_stamps", "message_embeddings"}


def test_search(spark):
    embedder = vectors.HashingEmbedder(32)
    df = text_rows(spark, [("a", "s", 0, "user", "cats and dogs"), ("b", "s", 1, "user", "stocks and bonds"), ("c", "t", 2, "user", "cats and birds")])
    table = vectors.embed(df, embedder)
    got = [r["uuid"] for r in vectors.search(table, df, embedder.query("cats and dogs"), 2).collect()]
    assert got[0] == "a" and [r["uuid"] for r in vectors.search(table, df, embedder.query("cats"), 5, "t").collect()] == ["c"]
    assert vectors.unembedded(df, table.where("uuid <> 'b'")).select("uuid").collect()[0][0] == "b"
    assert vectors.neighbours(table, "a", 2).count() == 2
    with pytest.raises(ValueError):
        vectors.neighbours_of_session(vectors.centroids(table, df), "none")
