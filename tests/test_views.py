import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from tarnwell import schemas
from tarnwell.operators import analytics, macros, transcript, views
from tarnwell.plans import catalog
from tarnwell.sources import transcripts as readers
from tests.transcripts import LONG, PARENT, write


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    return catalog.Corpus(spark, str(write(tmp_path_factory.mktemp("corpus"))))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_schemas_are_as_stated(spark, corpus):
    for name, ddl in schemas.VIEWS.items():
        want = spark.createDataFrame([], ddl).schema
        got = corpus.views[name].schema
        assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in want], name
    assert dict(catalog.schema()["turn_window"])["gap_ms"] == "bigint"


def test_sessions_and_part_files(corpus):
    got = {r["session_id"]: r for r in corpus.views["sessions"].collect()}
    assert set(got) == {"s1", "s2", "s3"}
    assert (got["s1"]["record_count"], got["s1"]["assistant_messages"], got["s1"]["cwd"]) == (8, 3, "/w")
    assert got["s1"]["started_at"] == datetime.datetime(2024, 3, 1, 10) and got["s3"]["transcript_path"].endswith("/s3/part-1.jsonl")


def test_messages(corpus):
    got = {r["uuid"]: r for r in corpus.views["messages"].collect()}
    assert "x1" not in got and len(got) == 16
    assert got["a1"]["parent_uuid"] == "u1" and (got["a1"]["input_tokens"], got["a1"]["cache_write"]) == (1000, 4000)
    assert json.loads(got["u3"]["content_json"]) == "why did that fail?" and json.loads(got["a1"]["content_json"])[0]["type"] == "text"


def test_blocks_keep_order_and_bytes(corpus):
    got = rows(corpus.views["content_blocks"].where("message_uuid = 'a1'").select("pos", "block_type", "text", "tool_name"), "pos")
    assert got == [(0, "text", LONG, None), (1, "text", "second block", None), (2, "tool_use", None, "Read")]
    assert corpus.views["content_blocks"].where("message_uuid in ('u3', 'v1')").count() == 0
    assert corpus.views["task_creations"].where("subject = 'first'").first()["metadata"].replace(" ", "") == '{"b":1,"a":2}'


def test_messages_text_floor(corpus):
    got = {r["uuid"]: r["text_content"] for r in corpus.views["messages_text"].collect()}
    assert got["a1"] == f"{LONG}\n\nsecond block" and "u2" not in got
    short = views.messages_text(corpus.views["content_blocks"], 1)
    assert short.count() >= len(got)


def test_turn_window(corpus):
    got = rows(corpus.views["turn_window"].where("session_id = 's1'").select("window_idx", "prev_uuid", "curr_uuid", "gap_ms"), "window_idx")
    assert got == [(1, None, "u1", None), (2, "u1", "a1", 1500), (3, "a1", "u4", 4500)]


def test_todos_and_tasks(corpus):
    assert rows(corpus.views["todo_state_current"].select("subject", "status"), "subject") == [("A", "completed"), ("B", "in_progress")]
    assert [r["snapshot_ix"] for r in corpus.views["todo_events"].orderBy("snapshot_ix").collect()] == [1, 2, 3, 4]
    assert rows(corpus.views["tasks_state_current"].select("task_id", "subject", "status"), "subject") == [("7", "first", "completed"), ("2", "second", "pending")]
    old = views.tasks_state_current(corpus.views["task_creations"], corpus.views["task_updates"], corpus.views["tool_results"], parity=True)
    assert rows(old.select("task_id", "subject"), "subject") == [("7", "first"), ("", "second")]


def test_skills(corpus):
    got = rows(corpus.views["skill_invocations"].select("skill_id", "source", "args", "context_uuid"), "skill_id")
    assert got == [("deploy", "tool", "fast", "v2"), ("plan", "slash_command", None, "v4"), ("review", "slash_command", "now", "v1")]
    usage = analytics.skill_usage(corpus.views["skill_invocations"])
    assert usage.where("is_builtin").count() == 0


def test_as_of_takes_ties(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([("s", at(5), "x"), ("s", at(1), "y"), ("t", at(9), "z")], "session_id string, ts timestamp_ntz, name string")
    right = spark.createDataFrame([("s", at(5), "b"), ("s", at(5), "a"), ("s", at(7), "c")], "session_id string, ts timestamp_ntz, uuid string")
    got = {r["name"]: r["context_uuid"] for r in views.prior_in_session(left, right).collect()}
    assert got == {"x": "b", "y": None, "z": None}


def test_subagents(corpus):
    got = corpus.views["subagent_sessions"].first()
    assert (got["parent_session_id"], got["agent_hex"], got["agent_type"], got["message_count"]) == (PARENT, "ab12", "scout", 2)
    assert macros.subagent_fanout(corpus.views["subagent_sessions"], PARENT).first()["fanout"] == 1
    assert corpus.views["subagent_spawns"].first()["run_in_background"] == "true"


def test_costs(corpus):
    got = {r["session_id"]: r["usd"] for r in macros.cost_estimate(corpus.views["messages"]).collect()}
    assert got["s1"] == pytest.approx((5000 * 15 + 2000 * 75) / 1e6) and got["s2"] == 0 and got["s3"] is None


def test_velocity_and_ranks(corpus):
    assert macros.todo_velocity(corpus.views["todo_events"], "s1").first()["velocity"] == 0.5
    got = rows(macros.tool_rank(corpus.views["tool_calls"], 30, "2024-03-03"), "tool_name")
    assert ("TodoWrite", 2) in got and macros.tool_rank(corpus.views["tool_calls"], 1, "2024-03-03").where("tool_name = 'Read'").count() == 0


def test_thread_walk(corpus):
    got = {r["uuid"]: (r["root_uuid"], r["depth"]) for r in views.thread_walk(corpus.views["messages"]).collect()}
    assert got["u4"] == ("u1", 6) and got["c1"] == ("c1", 0)
    below = {r["uuid"]: r["depth"] for r in views.thread_walk(corpus.views["messages"], "u3").collect()}
    assert below == {"u3": 0, "a2": 1, "a3": 2, "u4": 3}


def test_deep_threads(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("uuid"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_uuid"))
    got = views.thread_walk(df).agg(F.max("depth"), F.min("root_uuid"), F.count("*")).first()
    assert tuple(got) == (499, "0", 500)


def test_sql_and_macros(corpus):
    assert "messages" in corpus.register()
    got = corpus.sql("select session_id, model_used(session_id) m, cost_estimate(session_id) c from sessions order by session_id").collect()
    assert got[0]["m"].startswith("claude-opus") and got[0]["c"] == pytest.approx(0.225)
    assert not catalog.uses_catalog("select 1 as one") and catalog.uses_catalog("SELECT * FROM Messages")
    assert "Scan" in corpus.explain("select uuid from messages where session_id = 's1'")
    assert len(catalog.list_macros()) == 21


def test_errors_have_codes(corpus):
    for text, code in (("selec 1 as one", catalog.INVALID), ("select * from no_such_table", catalog.CATALOG)):
        with pytest.raises(Exception) as caught:
            corpus.sql(text)
        assert catalog.exit_code(caught.value) == code
    assert catalog.exit_code(RuntimeError()) == catalog.RUNTIME


def test_transcripts(corpus):
    events = transcript.timeline(corpus.views["messages_text"], corpus.views["tool_calls"], corpus.views["tool_results"])
    got = {r["session_id"]: r["transcript"] for r in transcript.assemble(events).collect()}
    lines = got["s1"].split("\n")
    assert lines[0] == f"[user 2024-03-01T10:00:00] {LONG} one" and any(x.startswith("[tool_use:Read 2024-03-01T10:00:01.500000]") for x in lines)
    assert any(x.startswith("[tool_result t1 2024-03-01T10:00:02]") for x in lines)
    cut = {r["session_id"]: r["transcript"] for r in transcript.assemble(events, total_chars=120, uuids=True).collect()}
    assert cut["s1"].startswith("[uuid=u1 user") and "session truncated at 120 chars" in cut["s1"].split("\n")[-1]


def test_collapse(spark, corpus):
    raw = readers.envelopes(spark, [r["transcript_path"] for r in corpus.views["sessions"].collect()]).withColumnRenamed("sessionId", "session_id")
    got = {r["session_id"]: r["transcript"].split("\n") for r in transcript.collapse(raw).collect()}
    assert f"[assistant 2024-03-01T10:00:01.500Z] {LONG} second block [tool_use:Read]" in got["s1"]
    assert "[user 2024-03-01T10:00:02.000Z] [tool_result]" in got["s1"] and "[user 2024-03-01T10:00:03.000Z] why did that fail?" in got["s1"]
    again = transcript.collapse(raw.repartition(7)).collect()
    assert {r["session_id"]: r["transcript"].split("\n") for r in again} == got
    short = transcript.collapse(raw, total_chars=60, notice=True).where("session_id = 's1'").first()["transcript"]
    assert len(short) == 60 and short.endswith("(transcript truncated at 60 chars)")


def test_peek(corpus):
    v = corpus.views
    got = transcript.peek(v["messages"], v["messages_text"], v["tool_calls"], "s1", sample_chars=20)
    assert got["total_lines"] == 8 and got["roles"] == {"user": 5, "assistant": 3} and got["top_tools"][0] == {"name": "TodoWrite", "count": 2}
    assert got["samples"]["first_user"]["text"] == LONG[:20] + "…"
    assert transcript.peek(v["messages"], v["messages_text"], v["tool_calls"], "none") is None


def test_readers(spark, corpus, tmp_path):
    assert readers.session_events(spark, f"{corpus.root}/project", "s3", f"{corpus.root}/project/*.jsonl").count() == 1
    assert readers.session_events(spark, f"{corpus.root}/nowhere", "s2", f"{corpus.root}/project/*.jsonl").count() == 8
    assert readers.raw_events(spark, f"{tmp_path}/*.jsonl").count() == 0
    with pytest.raises(ValueError):
        readers.check_glob("/a/**/b/**/c")
    assert readers.modified("s3://x/*.jsonl") is None and len(readers.modified(f"{corpus.root}/project/*.jsonl")) == 2
    assert readers.session_mtimes(spark, f"{corpus.root}/project/*.jsonl").count() == 2


def test_cli(corpus, capsys):
    from tarnwell import cli

    assert cli.main(["schema"]) == 0 and "messages" in capsys.readouterr().out
    assert cli.main(["query", "select count(*) as n from messages", "--root", corpus.root, "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out) == [{"n": 16}]
    assert cli.main(["query", "select count(*) n from messages where session_id = 's1'", "--root", corpus.root, "--format", "csv"]) == 0
    assert capsys.readouterr().out.split() == ["n", "8"]
    assert cli.main(["query", "select nothing from nowhere", "--root", corpus.root]) == catalog.CATALOG
    assert cli.main(["search", "x", "--root", corpus.root, "--tables", os.path.join(corpus.root, "none")]) == catalog.NO_EMBEDDINGS
    assert cli.main(["peek", "s2", "--root", corpus.root]) == 0
