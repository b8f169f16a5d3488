"""The library's readers and views over transcripts made of the driver's conversations, each with SQL over the conversations.

A conversation is a session: a turn an event, a minute after the one before it.
Assistants' turns hold a text and a tool call, whose kind goes round with the turn;
users' turns hold a text and the result of the call before, or are a plain string;
some begin with a command. ``raw`` makes these events as the reader would give them;
the queries named ``scan_*`` write them as lines of JSON and read the files.
"""

from __future__ import annotations

import uuid as uuids

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell import schemas
from tarnwell.operators import analytics, friction, graph, macros, models, stamps, state, terms, trajectory, transcript, vectors, views
from tarnwell.plans.checkpoints import checkpointed, ready
from tarnwell.plans.queries import NOW, micros, query, table, vecs
from tarnwell.sources import transcripts
from tarnwell.sources.buckets import Buckets
from tarnwell.streaming import watch

TOOLS = ("TodoWrite", "Agent", "TaskCreate", "TaskUpdate", "Skill", "Bash")
STATES = ("pending", "in_progress", "completed")
SQL_TEXT = "CASE WHEN role = 'user' AND (turn % 4 = 0 AND conv_id % 5 = 0 OR turn % 4 = 2 AND conv_id % 7 = 0) THEN '<command-name>/cmd-' || turn || '</command-name><command-args>z</command-args>' ELSE '' END || text"
#: The events on the SQL side.
EVENTS = f"""e AS (SELECT conv_id, turn, conv_id || '-' || turn AS uuid, CAST(conv_id AS VARCHAR) AS session_id, role, text, {SQL_TEXT} AS body,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS ts, (conv_id + turn // 2) % 6 AS kind, role = 'user' AND turn % 4 = 2 AS plain, turn = 6 AS compact FROM conversations),
m AS (SELECT * FROM e WHERE role IN ('user', 'assistant')), c AS (SELECT *, 'call-' || uuid AS call_id, ['{"', '".join(TOOLS)}'][kind + 1] AS tool FROM m WHERE role = 'assistant'),
t AS (SELECT uuid, session_id, ts, role, compact, body FROM m WHERE NOT plain AND length(body) >= 32)"""


def raw(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    role, turn, conv = F.col("role"), F.col("turn"), F.col("conv_id")
    uuid = F.concat_ws("-", "conv_id", "turn")
    command = (role == "user") & (((turn % 4 == 0) & (conv % 5 == 0)) | ((turn % 4 == 2) & (conv % 7 == 0)))
    body = F.concat(F.when(command, F.concat(F.lit("<command-name>/cmd-"), turn.cast("string"), F.lit("</command-name><command-args>z</command-args>"))).otherwise(F.lit("")), "text")
    said = F.to_json(F.struct(F.lit("text").alias("type"), body.alias("text")))
    t = turn.cast("string")
    states = F.array(*map(F.lit, STATES))
    todo = lambda subject, n: F.struct(subject.alias("content"), F.get(states, n.cast("int")).alias("status"), F.lit("doing").alias("activeForm"))
    inputs = (
        F.to_json(F.struct(F.array(todo(F.concat(F.lit("Task "), (turn % 2).cast("string")), conv % 3), todo(F.lit("Common"), turn % 3)).alias("todos"))),
        F.to_json(F.struct(F.concat(F.lit("kind"), t).alias("subagent_type"), F.lit("d").alias("description"), F.col("text").alias("prompt"))),
        F.to_json(F.struct(F.concat(F.lit("S"), t).alias("subject"), F.lit("doing").alias("activeForm"))),
        F.to_json(F.struct((turn - 1).cast("string").alias("taskId"), F.lit("completed").alias("status"), F.lit("me").alias("owner"))),
        F.to_json(F.struct(F.concat(F.lit("skill-"), (turn % 2).cast("string")).alias("skill"), F.lit("a").alias("args"))),
        F.lit('{"command":"ls"}'),
    )
    kind = ((conv + F.floor(turn / 2)) % 6).cast("int")
    call = F.concat(F.lit('{"type":"tool_use","id":"call-'), uuid, F.lit('","name":"'), F.get(F.array(*map(F.lit, TOOLS)), kind), F.lit('","input":'), F.get(F.array(*inputs), kind), F.lit("}"))
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("call-"), conv.cast("string"), F.lit("-"), (turn - 1).cast("string")).alias("tool_use_id"), F.concat(F.lit("Task #"), t, F.lit(" created")).alias("content"), F.when((conv + turn) % 4 == 0, F.lit(True)).alias("is_error")))
    several = F.concat(F.lit("["), said, F.lit(","), F.when(role == "assistant", call).otherwise(result), F.lit("]"))
    usage = F.struct((turn * 10).alias("input_tokens"), F.length("text").cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("cache_read_input_tokens"), F.lit(1).cast("long").alias("cache_creation_input_tokens"))
    model = F.when(role == "assistant", F.when(conv % 2 == 0, "claude-opus-4-20250514").otherwise("claude-haiku-4-5-20251001"))
    message = F.struct(role.alias("role"), F.when((role == "user") & (turn % 4 == 2), body).otherwise(several).alias("content"), model.alias("model"), F.lit("end_turn").alias("stop_reason"), usage.alias("usage"))
    return rows.select(
        uuid.alias("uuid"),
        F.when(turn > 0, F.concat_ws("-", conv, turn - 1)).alias("parentUuid"),
        conv.cast("string").alias("sessionId"),
        F.when(role.isin("user", "assistant"), role).otherwise("system").alias("type"),
        F.timestamp_seconds(F.lit(1704067200) + conv * 3600 + turn * 60).alias("timestamp"),
        F.lit(False).alias("isSidechain"),
        (turn == 6).alias("isCompactSummary"),
        F.concat(F.lit("/w/"), (conv % 5).cast("string")).alias("cwd"),
        F.lit("main").alias("gitBranch"),
        message.alias("message"),
        F.concat(F.lit("/corpus/p/"), conv.cast("string"), F.lit(".jsonl")).alias("source_file"),
        conv.cast("string").alias("session_id_file"),
    )


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One of the views, from raw events on."""
    events = raw(spark, d)
    if name == "sessions":
        return views.sessions(events)
    messages = views.messages(events)
    if name == "messages":
        return messages
    blocks = views.content_blocks(messages)
    if name == "content_blocks":
        return blocks
    if name == "messages_text":
        return views.messages_text(blocks)
    calls = views.tool_calls(blocks)
    if name == "tool_calls":
        return calls
    if name == "skill_invocations":
        return views.skill_invocations(calls, blocks, messages, views.messages_text(blocks))
    return getattr(views, name)(blocks if name == "tool_results" else calls)


@query(
    f"""WITH {EVENTS} SELECT session_id, '/w/' || any_value(conv_id % 5) AS cwd, 'main' AS git_branch, epoch_us(min(ts)) AS started_at, epoch_us(max(ts)) AS ended_at,
  count(*) FILTER (WHERE role = 'assistant') AS assistant_messages, count(*) AS record_count FROM e GROUP BY session_id"""
)
def sessions_rollup(spark, d):
    return view(spark, d, "sessions").select("session_id", "cwd", "git_branch", micros("started_at").alias("started_at"), micros("ended_at").alias("ended_at"), "assistant_messages", "record_count")


@query(
    f"""WITH {EVENTS} SELECT uuid, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_uuid, session_id, epoch_us(ts) AS ts, role AS type, false AS is_sidechain, compact AS is_compact_summary, role,
  CASE WHEN role = 'assistant' THEN CASE WHEN conv_id % 2 = 0 THEN 'claude-opus-4-20250514' ELSE 'claude-haiku-4-5-20251001' END END AS model, turn * 10 AS input_tokens, CAST(length(text) AS BIGINT) AS output_tokens, NOT plain AS blocks FROM m"""
)
def messages_view(spark, d):
    out = view(spark, d, "messages").withColumn("ts", micros("ts"))
    return out.select("uuid", "parent_uuid", "session_id", "ts", "type", "is_sidechain", "is_compact_summary", "role", "model", "input_tokens", "output_tokens", F.col("content_json").startswith("[").alias("blocks"))


@query(
    f"""WITH {EVENTS} SELECT session_id, uuid AS message_uuid, 0 AS pos, 'text' AS block_type, md5(body) AS digest, NULL AS tool_name, NULL AS tool_use_id FROM m WHERE NOT plain
UNION ALL SELECT session_id, uuid, 1, 'tool_use', NULL, tool, call_id FROM c
UNION ALL SELECT session_id, uuid, 1, 'tool_result', NULL, NULL, 'call-' || conv_id || '-' || (turn - 1) FROM m WHERE role = 'user' AND NOT plain"""
)
def content_explode(spark, d):
    return view(spark, d, "content_blocks").select("session_id", "message_uuid", "pos", "block_type", F.md5("text").alias("digest"), "tool_name", F.coalesce("tool_use_id_field", "tool_use_id").alias("tool_use_id"))


@query(f"WITH {EVENTS} SELECT uuid, session_id, epoch_us(ts) AS ts, role, compact AS is_compact_summary, md5(body) AS digest FROM t")
def messages_text_floor(spark, d):
    return view(spark, d, "messages_text").select("uuid", "session_id", micros("ts").alias("ts"), "role", "is_compact_summary", F.md5("text_content").alias("digest"))


@query(f"WITH {EVENTS} SELECT session_id, lag(uuid) OVER w AS prev_uuid, uuid AS curr_uuid, row_number() OVER w AS window_idx FROM t WHERE NOT compact WINDOW w AS (PARTITION BY session_id ORDER BY ts, uuid)")
def turn_window_of_events(spark, d):
    return views.turn_window(view(spark, d, "messages_text")).select("session_id", "prev_uuid", "curr_uuid", "window_idx")


@query(f"WITH {EVENTS} SELECT uuid AS message_uuid, session_id, epoch_us(ts) AS ts, tool AS tool_name, call_id AS tool_use_id FROM c")
def tool_calls_view(spark, d):
    return view(spark, d, "tool_calls").select("message_uuid", "session_id", micros("ts").alias("ts"), "tool_name", "tool_use_id")


@query(f"WITH {EVENTS} SELECT uuid AS message_uuid, session_id, 'call-' || conv_id || '-' || (turn - 1) AS tool_use_id, 'Task #' || turn || ' created' AS content FROM m WHERE role = 'user' AND NOT plain")
def tool_results_view(spark, d):
    return view(spark, d, "tool_results").select("message_uuid", "session_id", "tool_use_id", "content")


TODOS = f"""{EVENTS}, d AS (SELECT session_id, ts, uuid, k, CASE k WHEN 0 THEN 'Task ' || turn % 2 ELSE 'Common' END AS subject, ['{"', '".join(STATES)}'][CASE k WHEN 0 THEN conv_id % 3 ELSE turn % 3 END + 1] AS status FROM c, (VALUES (0), (1)) AS v(k) WHERE kind = 0),
x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, uuid, k) AS snapshot_ix FROM d)"""


@query(f"WITH {TODOS} SELECT session_id, epoch_us(ts) AS written_at, uuid AS message_uuid, subject, status, 'doing' AS active_form, snapshot_ix FROM x")
def todo_events_view(spark, d):
    return view(spark, d, "todo_events").withColumn("written_at", micros("written_at"))


@query(f"WITH {TODOS} SELECT session_id, subject, status, 'doing' AS active_form, epoch_us(ts) AS written_at FROM x QUALIFY row_number() OVER (PARTITION BY session_id, subject ORDER BY snapshot_ix DESC) = 1")
def state_current_last_wins(spark, d):
    return views.todo_state_current(view(spark, d, "todo_events")).withColumn("written_at", micros("written_at"))


@query(f"WITH {EVENTS} SELECT session_id, uuid AS message_uuid, call_id AS tool_use_id, tool AS spawn_tool, 'kind' || turn AS subagent_type, 'd' AS description, md5(text) AS prompt FROM c WHERE kind = 1")
def subagent_spawns_view(spark, d):
    return view(spark, d, "subagent_spawns").select("session_id", "message_uuid", "tool_use_id", "spawn_tool", "subagent_type", "description", F.md5("prompt").alias("prompt"))


@query(f"WITH {EVENTS} SELECT session_id, epoch_us(ts) AS created_at, uuid AS message_uuid, call_id AS tool_use_id, 'S' || turn AS subject, 'doing' AS active_form FROM c WHERE kind = 2")
def task_creations_view(spark, d):
    return view(spark, d, "task_creations").select("session_id", micros("created_at").alias("created_at"), "message_uuid", "tool_use_id", "subject", "active_form")


@query(f"WITH {EVENTS} SELECT session_id, epoch_us(ts) AS updated_at, uuid AS message_uuid, CAST(turn - 1 AS VARCHAR) AS task_id, 'completed' AS status, 'me' AS owner FROM c WHERE kind = 3")
def task_updates_view(spark, d):
    return view(spark, d, "task_updates").select("session_id", micros("updated_at").alias("updated_at"), "message_uuid", "task_id", "status", "owner")


@query(
    f"""WITH {EVENTS}, n AS (SELECT c.session_id, turn, ts, 'S' || turn AS subject, row_number() OVER (PARTITION BY c.session_id ORDER BY ts, call_id) AS nr FROM c WHERE kind = 2),
r AS (SELECT session_id, turn - 1 AS turn, turn AS task FROM m WHERE role = 'user' AND NOT plain), k AS (SELECT n.session_id, CAST(coalesce(task, nr) AS VARCHAR) AS task_id, subject, ts FROM n LEFT JOIN r USING (session_id, turn)),
u AS (SELECT session_id, CAST(turn - 1 AS VARCHAR) AS task_id, max(ts) AS ts FROM c WHERE kind = 3 GROUP BY ALL)
SELECT session_id, task_id, subject, 'doing' AS active_form, CASE WHEN u.ts IS NULL THEN 'pending' ELSE 'completed' END AS status, epoch_us(k.ts) AS created_at, epoch_us(u.ts) AS last_updated_at FROM k LEFT JOIN u USING (session_id, task_id)"""
)
def latest_status_join(spark, d):
    out = views.tasks_state_current(view(spark, d, "task_creations"), view(spark, d, "task_updates"), view(spark, d, "tool_results"))
    return out.withColumns({"created_at": micros("created_at"), "last_updated_at": micros("last_updated_at")})


SKILLS = f"""{EVENTS}, k AS (SELECT session_id, uuid AS message_uuid, 'tool' AS source, 'skill-' || turn % 2 AS skill_id, 'a' AS args, call_id AS tool_use_id,
  (SELECT t.uuid FROM t WHERE t.session_id = c.session_id AND t.role = 'user' AND t.ts <= c.ts ORDER BY t.ts DESC, t.uuid DESC LIMIT 1) AS context_uuid, ts FROM c WHERE kind = 4
UNION ALL SELECT session_id, uuid, 'slash_command', 'cmd-' || turn, 'z', NULL, uuid, ts FROM m WHERE body LIKE '<command-name>%')"""


@query(f"WITH {SKILLS} SELECT session_id, epoch_us(ts) AS ts, message_uuid, source, skill_id, args, tool_use_id, context_uuid FROM k")
def skill_invocations_view(spark, d):
    return view(spark, d, "skill_invocations").withColumn("ts", micros("ts"))


CATALOG = (("skill-0", "Zero", None, "user-skill"), ("skill-0", "Null", "p", "plugin-skill"), ("cmd-0", "Command", None, "builtin"), ("skill-9", "Never", None, "user-skill"))


def catalog(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([*CATALOG], "skill_id string, name string, plugin string, source_kind string")
    return rows.select("skill_id", "name", "plugin", F.lit(None).cast("string").alias("plugin_version"), F.lit("text").alias("description"), "source_kind")


@query(
    f"""WITH {SKILLS}, g(skill_id, name, source_kind) AS (VALUES ('skill-0', 'Zero', 'user-skill'), ('cmd-0', 'Command', 'builtin'))
SELECT session_id, message_uuid, skill_id, coalesce(name, skill_id) AS skill_name, source_kind, coalesce(source_kind = 'builtin', false) AS is_builtin FROM k LEFT JOIN g USING (skill_id)"""
)
def usage_enriched_left_join(spark, d):
    return analytics.skill_usage(view(spark, d, "skill_invocations"), catalog(spark)).select("session_id", "message_uuid", "skill_id", "skill_name", "source_kind", "is_builtin")


@query(f"WITH {SKILLS} SELECT DISTINCT skill_id FROM (VALUES ('skill-0'), ('cmd-0'), ('skill-9')) AS g(skill_id) WHERE skill_id NOT IN (SELECT skill_id FROM k) AND skill_id <> 'cmd-0'")
def unused_skills_view(spark, d):
    return macros.unused_skills(catalog(spark), view(spark, d, "skill_invocations"), None).select("skill_id").distinct()


def subagents(spark: SparkSession, d: str) -> DataFrame:
    """Events of odd conversations as those of an agent of the conversation before."""
    rows = raw(spark, d).where(F.col("sessionId").cast("long") % 2 == 1)
    return rows.select("uuid", "parentUuid", "sessionId", "type", "timestamp", "isSidechain", "message", "source_file", (F.col("sessionId").cast("long") - 1).cast("string").alias("parent_session_id"), F.concat(F.lit("a"), "sessionId").alias("agent_hex"))


@query(
    f"""WITH {EVENTS} SELECT CAST(conv_id - 1 AS VARCHAR) AS parent_session_id, 'a' || session_id AS agent_hex, CASE WHEN conv_id % 3 = 0 THEN 'kind' END AS agent_type, epoch_us(min(ts)) AS started_at, epoch_us(max(ts)) AS ended_at, count(*) AS message_count
FROM e WHERE conv_id % 2 = 1 GROUP BY conv_id, session_id"""
)
def subagent_sessions_view(spark, d):
    rows = subagents(spark, d)
    meta = rows.where(F.col("sessionId").cast("long") % 3 == 0).select("parent_session_id", "agent_hex", F.lit("kind").alias("agentType"), F.lit("d").alias("description")).distinct()
    out = views.subagent_sessions(rows, meta)
    return out.select("parent_session_id", "agent_hex", "agent_type", micros("started_at").alias("started_at"), micros("ended_at").alias("ended_at"), "message_count")


@query(f"WITH {EVENTS} SELECT uuid, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_uuid, session_id, CAST(conv_id - 1 AS VARCHAR) AS parent_session_id, 'a' || session_id AS agent_hex, epoch_us(ts) AS ts, role, turn * 10 AS input_tokens FROM m WHERE conv_id % 2 = 1")
def subagent_messages_view(spark, d):
    return views.subagent_messages(subagents(spark, d)).select("uuid", "parent_uuid", "session_id", "parent_session_id", "agent_hex", micros("ts").alias("ts"), "role", "input_tokens")


@query(f"WITH {EVENTS} SELECT session_id, CASE WHEN conv_id % 2 = 0 THEN 'claude-opus-4-20250514' ELSE 'claude-haiku-4-5-20251001' END AS model FROM c GROUP BY ALL")
def model_used_of_sessions(spark, d):
    return macros.model_used(view(spark, d, "messages")).where("model is not null").select("session_id", "model")


@query(f"WITH {EVENTS} SELECT session_id, count(*) AS conflict_count FROM c GROUP BY session_id")
def conflicts_per_session(spark, d):
    return analytics.conflicts_summary(view(spark, d, "tool_calls"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("label").cast("string")
    return vecs(spark, d).select(F.col("uuid").alias("session_id"), F.concat(F.lit("tier"), kind).alias("autonomy_tier"), kind.alias("work_category"), F.lit("success").alias("success"), F.concat(F.lit("goal "), kind).alias("goal"), F.lit(0.5).cast("float").alias("confidence"), F.lit(NOW).cast("timestamp").alias("classified_at"))


@query("SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS session_id, 'tier' || label AS autonomy, 'success' AS success_outcome, CAST(label AS VARCHAR) AS category, 'goal ' || label AS goal FROM embeddings")
def classifications_and_goals(spark, d):
    rows = labelled(spark, d)
    goals = analytics.session_goals(rows).select("session_id", "goal")
    return analytics.session_classifications(rows).select("session_id", "autonomy", "success_outcome", "category").join(goals, "session_id")


@query(f"WITH {EVENTS} SELECT session_id, max(ts)::VARCHAR AS last_ts, count(*) AS total, max_by(uuid, ts) AS last_uuid FROM m GROUP BY session_id ORDER BY max(ts) DESC, session_id LIMIT 3")
def peek_session(spark, d):
    """A first look at the three newest sessions."""
    messages, text, calls = (view(spark, d, n) for n in ("messages", "messages_text", "tool_calls"))
    newest = [r["session_id"] for r in transcript.session_bounds(messages, limit=3).collect()]
    found = [transcript.peek(messages, text, calls, s) for s in newest]
    last = messages.groupBy("session_id").agg(F.max_by("uuid", "ts").alias("last_uuid"))
    rows = spark.createDataFrame([(x["session_id"], x["last_ts"], x["total_lines"]) for x in found], "session_id string, last_ts string, total long")
    return rows.join(last, "session_id")


@query(f"WITH {EVENTS} SELECT session_id, 'text' AS kind, md5(body) AS digest, NULL AS aux, uuid, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_iso FROM t UNION ALL SELECT session_id, 'tool_use', NULL, tool, NULL, strftime(ts, '%Y-%m-%dT%H:%M:%S') FROM c UNION ALL SELECT session_id, 'tool_result', md5('Task #' || turn || ' created'), 'call-' || conv_id || '-' || (turn - 1), NULL, strftime(ts, '%Y-%m-%dT%H:%M:%S') FROM m WHERE role = 'user' AND NOT plain")
def session_timeline(spark, d):
    out = transcript.timeline(view(spark, d, "messages_text"), view(spark, d, "tool_calls"), view(spark, d, "tool_results"))
    return out.select("session_id", "kind", F.when(F.col("kind") != "tool_use", F.md5("body")).alias("digest"), "aux", "uuid", "ts_iso")


@query(
    f"""WITH {EVENTS} SELECT session_id, md5(string_agg('[' || role || ' ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ' || body, chr(10) ORDER BY ts)) AS digest FROM t GROUP BY session_id"""
)
def session_assembled(spark, d):
    none = view(spark, d, "tool_calls").where("false"), view(spark, d, "tool_results").where("false")
    out = transcript.assemble(transcript.timeline(view(spark, d, "messages_text"), *none), total_chars=10_000_000)
    return out.select("session_id", F.md5("transcript").alias("digest"))


@query(f"WITH {EVENTS} SELECT session_id, epoch_us(ts) AS ts FROM m WHERE role = 'user' AND NOT plain AND (conv_id + turn) % 4 = 0")
def tool_error_times(spark, d):
    return friction.error_times(view(spark, d, "messages")).withColumn("ts", micros("ts"))


@query(f"WITH {EVENTS} SELECT uuid FROM t WHERE role = 'user' AND length(body) <= 300 AND trim(body) NOT IN ('Continue from where you left off.', '[Request interrupted by user for tool use]')")
def friction_candidates(spark, d):
    return friction.candidates(view(spark, d, "messages_text")).select("uuid")


@query(f"WITH {EVENTS} SELECT uuid, session_id, CASE WHEN length(body) <= 256 THEN 'xs' ELSE 'sm' END AS token_budget_bucket, epoch_us(ts) AS first_seen_ts FROM t WHERE uuid NOT IN (SELECT uuid FROM t WHERE conv_id_of(uuid) % 2 = 0)".replace("conv_id_of(uuid)", "CAST(split_part(uuid, '-', 1) AS BIGINT)"))
def stamps_of_pending(spark, d):
    """Stamps of the messages that have none; the token counter is the text's length here, which SQL has too."""
    text = view(spark, d, "messages_text")
    done = text.where(F.col("session_id").cast("long") % 2 == 0).select("uuid")
    found = stamps.stamp(stamps.pending(text, done), counter=lambda t: len(t) / stamps.RATIO if len(t) <= 256 else 300 / stamps.RATIO, stamped_at=F.lit(NOW).cast("timestamp"))
    return found.select("uuid", "session_id", "token_budget_bucket", micros("first_seen_ts").alias("first_seen_ts"))


@query(f"WITH {EVENTS} SELECT uuid FROM t WHERE CAST(session_id AS BIGINT) % 3 <> 0 AND CAST(session_id AS BIGINT) % 2 = 0")
def unembedded_messages(spark, d):
    text = view(spark, d, "messages_text")
    sid = F.col("session_id").cast("long")
    known = text.where(sid % 3 == 0).select("uuid")
    stamped = text.select("uuid", F.when(sid % 2 == 0, F.col("uuid")).otherwise("other").alias("canonical_uuid"))
    return vectors.unembedded(text, known, stamped).select("uuid")


@query(f"WITH {EVENTS} SELECT count(*) AS n, count(DISTINCT uuid) AS messages, 16 AS dim FROM t")
def embedded_messages(spark, d):
    out = vectors.embed(view(spark, d, "messages_text"), vectors.HashingEmbedder(16))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uuid").alias("messages"), F.min(F.size("embedding")).alias("dim"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of two numbers: of a text, its length and its turn."""
    return view(spark, d, "messages_text").select("uuid", F.array(F.length("text_content").cast("double"), F.element_at(F.split("uuid", "-"), -1).cast("double") * 100).alias("embedding"))


@query(
    f"""WITH {EVENTS}, v AS (SELECT uuid, session_id, left(body, 200) AS snippet, (3.0 * length(body) + 4.0 * 100 * CAST(split_part(uuid, '-', 2) AS INTEGER)) / (5.0 * sqrt(power(length(body), 2) + power(100.0 * CAST(split_part(uuid, '-', 2) AS INTEGER), 2))) AS s FROM t)
SELECT uuid, session_id, md5(snippet) AS snippet, round(s, 6) AS similarity FROM v ORDER BY s DESC, uuid LIMIT 10"""
)
def search_messages(spark, d):
    out = vectors.search(_words(spark, d), view(spark, d, "messages_text"), [3.0, 4.0], 10)
    return out.select("uuid", "session_id", F.md5("snippet").alias("snippet"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {EVENTS} SELECT count(DISTINCT session_id) AS n FROM t")
def sessions_with_vectors(spark, d):
    return vectors.candidate_sessions(_words(spark, d), view(spark, d, "messages"))


@query(f"WITH {EVENTS} SELECT CAST(CAST(session_id AS BIGINT) % 7 AS INTEGER) AS cluster_id, md5(string_agg(body, chr(10) ORDER BY uuid)) AS digest FROM t WHERE CAST(session_id AS BIGINT) % 7 > 0 GROUP BY 1")
def cluster_pseudo_docs(spark, d):
    text = view(spark, d, "messages_text")
    sid = (F.col("session_id").cast("long") % 7).cast("int")
    out = terms.pseudo_docs(text.select("uuid", F.when(sid > 0, sid).otherwise(-1).alias("cluster_id")), text)
    return out.select("cluster_id", F.md5("body").alias("digest"))


@query(f"WITH {EVENTS}, w AS (SELECT session_id, uuid, lag(uuid) OVER o AS p, lag(body) OVER o AS pb, body, row_number() OVER o AS i FROM t WHERE NOT compact WINDOW o AS (PARTITION BY session_id ORDER BY ts, uuid)) SELECT session_id, i AS window_idx, (i - 1) // 16 AS chunk, p AS prev_uuid, uuid AS curr_uuid, md5(pb) AS prev_text, md5(body) AS curr_text FROM w")
def trajectory_windows(spark, d):
    text = view(spark, d, "messages_text")
    out = trajectory.windows(views.turn_window(text), text)
    return out.select("session_id", "window_idx", "chunk", "prev_uuid", "curr_uuid", F.md5("prev_text").alias("prev_text"), F.md5("curr_text").alias("curr_text"))


XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
CLIPPED = "CASE WHEN length({0}) > 2000 THEN left({0}, 2000) || '…(truncated)' ELSE {0} END"


@query(
    f"""WITH {EVENTS}, w AS (SELECT session_id, uuid, role, lag(uuid) OVER o AS p, lag(role) OVER o AS pr, lag(body) OVER o AS pb, body, row_number() OVER o AS i FROM t WHERE NOT compact WINDOW o AS (PARTITION BY session_id ORDER BY ts, uuid))
SELECT session_id, (i - 1) // 16 AS chunk, md5(string_agg('<window idx=' || (i - 1) % 16 || '>' || chr(10) || '<prev role="' || coalesce(pr, '') || '" uuid="' || coalesce(p, '') || '">' || {XML.format(CLIPPED.format("coalesce(pb, '')"))} || '</prev>' || chr(10)
  || '<curr role="' || role || '" uuid="' || uuid || '">' || {XML.format(CLIPPED.format("body"))} || '</curr>' || chr(10) || '</window>', chr(10) ORDER BY i)) AS digest FROM w GROUP BY ALL"""
)
def trajectory_prompts(spark, d):
    text = view(spark, d, "messages_text")
    return trajectory.prompts(trajectory.windows(views.turn_window(text), text)).select("session_id", "chunk", F.md5("prompt").alias("digest"))


@query(f"WITH {EVENTS}, w AS (SELECT session_id, uuid, lag(uuid) OVER o AS p FROM t WHERE NOT compact WINDOW o AS (PARTITION BY session_id ORDER BY ts, uuid)) SELECT session_id, uuid AS curr_uuid, CASE WHEN p IS NOT NULL THEN 'neutral' END AS prev_sentiment, CASE WHEN p IS NOT NULL THEN 0.0::DOUBLE END AS delta FROM w")
def trajectory_placeholders(spark, d):
    """A model that answers nothing leaves a neutral row for each window."""
    text = view(spark, d, "messages_text")
    out = trajectory.trajectory(trajectory.windows(views.turn_window(text), text), lambda prompt: [], at=F.lit(NOW).cast("timestamp"))
    return out.select("session_id", "curr_uuid", "prev_sentiment", "delta")


@query("SELECT label AS community, CAST(2 AS BIGINT) AS pieces FROM embeddings GROUP BY label HAVING count(*) > 2")
def disconnected_communities(spark, d):
    """Chains of each label's vectors, cut before the last one."""
    rows = vecs(spark, d).select(F.col("uuid").alias("id"), F.col("label").alias("community"))
    from pyspark.sql import Window

    w = Window.partitionBy("community").orderBy("id")
    chain = rows.select("community", F.col("id").alias("src"), F.lead("id").over(w).alias("dst"), F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("community")).alias("n"))
    edges = chain.where("dst is not null and k < n - 1").select("src", "dst")
    return graph.disconnected(edges, rows).where("pieces > 1").join(rows.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where("n > 2"), "community").select("community", "pieces")


@query(f"WITH {EVENTS}, n AS (SELECT session_id AS unit_id, count(*) AS k FROM c GROUP BY 1) SELECT unit_id, CAST(k AS INTEGER) AS attempts, least(power(2.0, least(k, 30)), 60.0) AS minutes FROM n WHERE k < 5")
def retry_backoff(spark, d):
    """Sessions that failed as often as they have calls: queued by one failure after another, due an hour and more later."""
    calls = view(spark, d, "tool_calls")
    queue = spark.createDataFrame([], schemas.TABLES["retry_queue"])
    from pyspark.sql import Window

    nth = checkpointed(calls.select(F.col("session_id").alias("unit_id"), F.row_number().over(Window.partitionBy("session_id").orderBy("ts")).alias("nr")))
    now = F.lit(NOW).cast("timestamp")
    for k in range(1, (nth.agg(F.max("nr")).first()[0] or 0) + 1):
        queue = checkpointed(state.enqueue(queue, nth.where(F.col("nr") == k).select("unit_id", F.lit("failed").alias("error")), "classify", now))
    later = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return state.due(queue, "classify", later).select("unit_id", "attempts", state.wait_minutes(F.col("attempts")).alias("minutes"))


def written(spark: SparkSession, d: str, lines: DataFrame) -> str:
    """A folder of part files of JSON lines, one folder for each tenth of the sessions, where all executors see it."""
    ready(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/transcripts-{uuids.uuid4().hex}"
    lines.repartition("bucket").write.partitionBy("bucket").text(place)
    return place


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    """The events as lines of a transcript: content is an array or a string, as its kind is."""
    rows = raw(spark, d)
    content = F.col("message.content")
    quoted = F.when(content.startswith("["), content).otherwise(F.regexp_extract(F.to_json(F.struct(content.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
    rest = F.to_json(F.struct("message.role", "message.model", "message.stop_reason", "message.usage"))
    message = F.concat(F.lit('{"content":'), quoted, F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    head = F.to_json(F.struct("uuid", "parentUuid", "sessionId", "type", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "isSidechain", "isCompactSummary", "cwd", "gitBranch"))
    line = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"message":'), message, F.lit("}"))
    return rows.select(line.alias("value"), (F.col("sessionId").cast("long") % 10).cast("string").alias("bucket"))


@query(f"WITH {EVENTS} SELECT CAST(conv_id % 10 AS VARCHAR) AS session_id, count(*) AS record_count, count(*) FILTER (WHERE role = 'assistant') AS assistant_messages, epoch_us(min(ts)) AS started_at FROM e GROUP BY 1")
def scan_events(spark, d):
    """Files written and read again; a session's id is that of its folder of parts."""
    events = transcripts.raw_events(spark, written(spark, d, lines_of(spark, d)) + "/*/part-*")
    return views.sessions(events).select("session_id", "record_count", "assistant_messages", micros("started_at").alias("started_at"))


@query(f"WITH {EVENTS} SELECT uuid, session_id, epoch_us(ts) AS ts, md5(body) AS digest FROM t")
def scan_messages_text(spark, d):
    events = transcripts.raw_events(spark, written(spark, d, lines_of(spark, d)) + "/*/part-*")
    out = views.messages_text(views.content_blocks(views.messages(events)))
    return out.select("uuid", "session_id", micros("ts").alias("ts"), F.md5("text_content").alias("digest"))


@query(f"WITH {EVENTS} SELECT uuid, session_id FROM e WHERE conv_id = 7")
def scan_one_session(spark, d):
    place = written(spark, d, lines_of(spark, d))
    return transcripts.session_events(spark, place, "7", f"{place}/*/part-*").select("uuid", F.col("sessionId").alias("session_id"))


@query(f"WITH {EVENTS} SELECT uuid, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'system' END AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS timestamp FROM e")
def scan_envelopes(spark, d):
    place = written(spark, d, lines_of(spark, d))
    return transcripts.envelopes(spark, f"{place}/*/part-*").select("uuid", "type", "timestamp")


@query(f"WITH {EVENTS} SELECT CAST(conv_id % 10 AS VARCHAR) AS path, 'added' AS change FROM e GROUP BY ALL")
def scan_changed_files(spark, d):
    """Every part file is new to a watcher that knows none."""
    place = written(spark, d, lines_of(spark, d))
    mtimes = transcripts.session_mtimes(spark, f"{place}/*/part-*", names="part-*")
    known = spark.createDataFrame([], "path string, mtime timestamp")
    return watch.diff_frames(known, mtimes.withColumnRenamed("session_id", "path")).select("path", "change")


#: A parent's name in files of subagents: there are ten.
PARENT = "'00000000-0000-0000-0000-00000000000' || conv_id % 10"


def _agents(spark: SparkSession, d: str, lines: DataFrame) -> str:
    """Lines (value, k) as files below parents' folders, as Spark writes them."""
    ready(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/subagents-{uuids.uuid4().hex}"
    named = lines.select("value", F.concat(F.lit("00000000-0000-0000-0000-00000000000"), "k").alias("parent"), F.lit("subagents").alias("kind"), F.concat(F.lit("agent-a"), "k").alias("agent"))
    named.repartition("parent").write.partitionBy("parent", "kind", "agent").text(place)
    return f"{place}/*/*/*/part-*"


@query(f"WITH {EVENTS} SELECT {PARENT} AS parent_session_id, 'a' || conv_id % 10 AS agent_hex, count(*) AS n, epoch_us(min(ts)) AS first_us, count(*) FILTER (WHERE role = 'assistant') AS answers FROM e WHERE conv_id % 2 = 1 GROUP BY conv_id % 10")
def scan_subagents(spark, d):
    """Files of subagents, whose parents and names are those of their folders."""
    lines = lines_of(spark, d).where(F.col("bucket").cast("int") % 2 == 1).select("value", F.col("bucket").alias("k"))
    rows = transcripts.raw_subagents(spark, _agents(spark, d, lines))
    return rows.groupBy("parent_session_id", "agent_hex").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("timestamp")).alias("first_us"), F.count_if(F.col("type") == "assistant").alias("answers"))


@query(f"SELECT DISTINCT {PARENT} AS parent_session_id, 'a' || conv_id % 10 AS agent_hex, 'kind' || conv_id % 10 AS agent_type, 'line' || chr(10) || 'two' AS description FROM conversations")
def scan_subagent_meta(spark, d):
    """The side files of subagents, objects over several lines."""
    k = (F.col("conv_id") % 10).cast("string")
    rows = table(spark, d, "conversations").select(k.alias("k")).distinct()
    lines = rows.select("k", F.concat(F.lit('{\n  "agentType": "kind'), "k", F.lit('",\n  "description": "line\\ntwo"\n}')).alias("value"))
    meta = transcripts.raw_subagent_meta(spark, _agents(spark, d, lines))
    return meta.select("parent_session_id", "agent_hex", F.col("agentType").alias("agent_type"), "description")


def told_texts(spark: SparkSession, d: str) -> DataFrame:
    """session_id and transcript: each session's texts in order."""
    rows = view(spark, d, "messages_text").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ts", "uuid", "text_content"))).alias("all"))
    return rows.select("session_id", F.array_join(F.transform("all", lambda x: F.concat(x["uuid"], F.lit(" "), x["text_content"])), "\n").alias("transcript"))


TOLD = "x AS (SELECT session_id, string_agg(uuid || ' ' || body, chr(10) ORDER BY ts, uuid) AS transcript FROM t GROUP BY session_id), n AS (SELECT *, length(transcript) AS n FROM x)"


def fixed_model(text: str) -> dict:
    """Stands for a model: what it says follows from the length of what it is asked."""
    n = len(text)
    if n % 7 == 0:
        raise models.Refused("no")
    if n % 5 == 0:
        raise ValueError("busy")
    first = [line.split(" ")[0] for line in text.split("\n") if "-" in line.split(" ")[0]]
    clash = {"turn_a_uuid": first[0], "turn_b_uuid": first[-1] if n % 3 else "unknown", "conflict_kind": ("reversal", "odd")[n % 2], "severity": "low", "agent_position": "a", "user_position": "b", "confidence": "0.5"}
    return {"autonomy_tier": (*models.TIERS, "odd")[n % 4], "work_category": models.CATEGORIES[n % 6], "success": models.OUTCOMES[n % 4], "goal": f"goal {n}", "confidence": 0.25 * (n % 4), "conflicts": [clash]}


@query(
    f"""WITH {EVENTS}, {TOLD} SELECT session_id, ['manual', 'assisted', 'autonomous', NULL][n % 4 + 1] AS autonomy_tier, ['sde', 'admin', 'strategy_business', 'events', 'thought_leadership', 'other'][n % 6 + 1] AS work_category,
  ['success', 'partial', 'failure', 'unknown'][n % 4 + 1] AS success, 'goal ' || n AS goal, round(0.25 * (n % 4), 4)::DOUBLE AS confidence FROM n WHERE n % 7 <> 0 AND n % 5 <> 0"""
)
def classified_sessions(spark, d):
    """Sessions classified by a fixed model, asked on executors."""
    return models.classifications(models.ask(told_texts(spark, d), fixed_model)).drop("classified_at").withColumn("confidence", F.round(F.col("confidence").cast("double"), 4))


@query(f"WITH {EVENTS}, {TOLD} SELECT session_id AS unit_id, 'busy' AS error FROM n WHERE n % 7 <> 0 AND n % 5 = 0")
def classify_failures(spark, d):
    """What to ask again: failures that are not refusals."""
    return models.failures(models.ask(told_texts(spark, d), fixed_model))


@query(
    f"""WITH {EVENTS}, {TOLD}, l AS (SELECT session_id, n, arg_min(uuid, (ts, uuid)) AS a, arg_max(uuid, (ts, uuid)) AS b FROM t JOIN n USING (session_id) GROUP BY ALL)
SELECT session_id, a AS turn_a_uuid, b AS turn_b_uuid, CASE WHEN n % 2 = 0 THEN 'reversal' END AS conflict_kind, 'low' AS severity, 0.5 AS confidence FROM l WHERE n % 7 <> 0 AND n % 5 <> 0 AND n % 3 <> 0 AND a <> b"""
)
def conflicts_found(spark, d):
    """Conflicts that a fixed model tells of two turns, both of which the session has."""
    found = models.conflicts(models.ask(told_texts(spark, d), fixed_model), view(spark, d, "messages"))
    return found.select("session_id", "turn_a_uuid", "turn_b_uuid", "conflict_kind", "severity", "confidence")


@query(
    f"""WITH {EVENTS}, r AS (SELECT t.uuid, t.session_id, md5(t.body) AS digest, e.turn, e.conv_id % 3 = 0 AND bool_or(e.turn % 2 = 0) OVER (PARTITION BY t.session_id) AS again FROM t JOIN e ON e.uuid = t.uuid)
SELECT uuid, session_id, digest, again FROM r WHERE NOT again OR turn % 2 = 0"""
)
def replaced_by_session(spark, d):
    """A table of messages in buckets; a third of its sessions is replaced by half of their messages."""
    ready(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/replaced-{uuids.uuid4().hex}"
    kept = Buckets(spark, place, "uuid string, session_id string, digest string, again boolean", ("session_id",), 16)
    rows = checkpointed(view(spark, d, "messages_text").select("uuid", "session_id", F.md5("text_content").alias("digest"), F.lit(False).alias("again")))
    kept.replace(rows)
    turn = F.split_part("uuid", F.lit("-"), F.lit(2)).cast("int")
    kept.replace(rows.where((F.col("session_id").cast("long") % 3 == 0) & (turn % 2 == 0)).withColumn("again", F.lit(True)))
    return kept.read()
