"""The sixteen views over raw events, each a function from frames to a frame; none runs an action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import any_val, asc_nl, gap_ms, json_items, ntz, unquoted

COMMAND = r"<command-name>/([A-Za-z0-9_:.-]+)</command-name>"
ARGUMENTS = r"<command-args>([^<]*)</command-args>"


def _is_list(content: Column) -> Column:
    """Whether content, read as text, was an array of blocks: it parses as one, and its elements are objects."""
    return F.coalesce(content.startswith("[") & F.from_json(content, "array<struct<type:string>>").isNotNull(), F.lit(False))


def _content(content: Column) -> Column:
    """Content as JSON: an array as it stands, a string quoted."""
    quoted = F.to_json(F.struct(content.alias("v")))
    return F.when(_is_list(content), content).when(content.isNotNull(), F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def sessions(events: DataFrame) -> DataFrame:
    rows = events.where("sessionId is not null")
    return rows.groupBy(F.col("session_id_file").alias("session_id")).agg(
        any_val("cwd").alias("cwd"),
        any_val("gitBranch").alias("git_branch"),
        ntz(F.min("timestamp")).alias("started_at"),
        ntz(F.max("timestamp")).alias("ended_at"),
        F.count_if(F.col("type") == "assistant").alias("assistant_messages"),
        F.count(F.lit(1)).alias("record_count"),
        any_val("source_file").alias("transcript_path"),
    )


def messages(events: DataFrame) -> DataFrame:
    usage = "message.usage"
    return events.where(F.col("type").isin("user", "assistant")).select(
        "uuid",
        unquoted(F.col("parentUuid")).alias("parent_uuid"),
        F.col("sessionId").alias("session_id"),
        ntz("timestamp").alias("ts"),
        "type",
        F.col("isSidechain").alias("is_sidechain"),
        F.coalesce("isCompactSummary", F.lit(False)).alias("is_compact_summary"),
        F.col("message.role").alias("role"),
        F.col("message.model").alias("model"),
        F.col("message.stop_reason").alias("stop_reason"),
        F.col(f"{usage}.input_tokens").alias("input_tokens"),
        F.col(f"{usage}.output_tokens").alias("output_tokens"),
        F.col(f"{usage}.cache_read_input_tokens").alias("cache_read"),
        F.col(f"{usage}.cache_creation_input_tokens").alias("cache_write"),
        _content(F.col("message.content")).alias("content_json"),
        "source_file",
    )


def content_blocks(messages: DataFrame) -> DataFrame:
    """A row for each block, with its place; messages whose content is a plain string have none."""
    rows = messages.select("session_id", F.col("uuid").alias("message_uuid"), "ts", "role", F.col("type").alias("message_type"), "is_compact_summary", F.posexplode(json_items(F.col("content_json"))).alias("pos", "block"))
    get = lambda path, name: F.get_json_object("block", path).alias(name)
    return rows.select(
        "session_id",
        "message_uuid",
        "ts",
        "role",
        "message_type",
        "is_compact_summary",
        "pos",
        get("$.type", "block_type"),
        get("$.text", "text"),
        get("$.id", "tool_use_id_field"),
        get("$.name", "tool_name"),
        get("$.input", "tool_input"),
        get("$.tool_use_id", "tool_use_id"),
        get("$.content", "tool_result_content"),
        get("$.thinking", "thinking"),
    )


def messages_text(blocks: DataFrame, min_chars: int = 32) -> DataFrame:
    """A message's text blocks in order, a blank line between; only of ``min_chars`` characters or more."""
    rows = blocks.where("block_type = 'text' and text is not null and length(text) > 0 and message_type <> 'attachment'")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    out = rows.groupBy(F.col("message_uuid").alias("uuid")).agg(any_val("session_id").alias("session_id"), any_val("ts").alias("ts"), any_val("role").alias("role"), any_val("is_compact_summary").alias("is_compact_summary"), joined.alias("text_content"))
    return out.where(F.length("text_content") >= min_chars)


def turn_window(text: DataFrame) -> DataFrame:
    """Each text message of a session with the one before it."""
    w = Window.partitionBy("session_id").orderBy(asc_nl("ts"), asc_nl("uuid"))
    rows = text.where("is_compact_summary = false") if "is_compact_summary" in text.columns else text
    before = lambda c: F.lag(c).over(w)
    return rows.select(
        "session_id",
        before("uuid").alias("prev_uuid"),
        before("role").alias("prev_role"),
        before("ts").alias("prev_ts"),
        F.col("uuid").alias("curr_uuid"),
        F.col("role").alias("curr_role"),
        F.col("ts").alias("curr_ts"),
        gap_ms(before("ts"), F.col("ts")).alias("gap_ms"),
        F.row_number().over(w).cast("long").alias("window_idx"),
    )


def tool_calls(blocks: DataFrame) -> DataFrame:
    return blocks.where("block_type = 'tool_use'").select("message_uuid", "session_id", "ts", "tool_name", F.col("tool_use_id_field").alias("tool_use_id"), "tool_input")


def tool_results(blocks: DataFrame) -> DataFrame:
    return blocks.where("block_type = 'tool_result'").select("message_uuid", "session_id", "ts", "tool_use_id", F.col("tool_result_content").alias("content"))


def _input(path: str, name: str, column: str = "tool_input") -> Column:
    return F.get_json_object(column, path).alias(name)


def todo_events(calls: DataFrame) -> DataFrame:
    rows = calls.where("tool_name = 'TodoWrite'").select("session_id", "ts", "message_uuid", F.posexplode(json_items(F.get_json_object("tool_input", "$.todos"))).alias("pos", "todo"))
    w = Window.partitionBy("session_id").orderBy(asc_nl("ts"), asc_nl("message_uuid"), "pos")
    return rows.select("session_id", F.col("ts").alias("written_at"), "message_uuid", _input("$.content", "subject", "todo"), _input("$.status", "status", "todo"), _input("$.activeForm", "active_form", "todo"), F.row_number().over(w).cast("long").alias("snapshot_ix"))


def todo_state_current(events: DataFrame) -> DataFrame:
    """Of each subject of a session, the last state written."""
    last = F.max_by(F.struct("status", "active_form", "written_at"), "snapshot_ix").alias("last")
    return events.groupBy("session_id", "subject").agg(last).select("session_id", "subject", "last.status", "last.active_form", "last.written_at")


def subagent_spawns(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("tool_name").isin("Task", "Agent")).select(
        "session_id", F.col("ts").alias("spawned_at"), "message_uuid", "tool_use_id", F.col("tool_name").alias("spawn_tool"), _input("$.subagent_type", "subagent_type"), _input("$.description", "description"), _input("$.prompt", "prompt"), _input("$.run_in_background", "run_in_background")
    )


def task_creations(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("tool_name").isin("TaskCreate", "mcp__tasks__task_create")).select(
        "session_id", F.col("ts").alias("created_at"), "message_uuid", "tool_use_id", F.col("tool_name").alias("create_tool"), _input("$.subject", "subject"), _input("$.description", "description"), _input("$.activeForm", "active_form"), _input("$.metadata", "metadata")
    )


def task_updates(calls: DataFrame) -> DataFrame:
    task = F.coalesce(_input("$.taskId", "x"), _input("$.id", "x")).alias("task_id")
    return calls.where(F.col("tool_name").isin("TaskUpdate", "mcp__tasks__task_update")).select(
        "session_id", F.col("ts").alias("updated_at"), "message_uuid", "tool_use_id", F.col("tool_name").alias("update_tool"), task, _input("$.status", "status"), _input("$.addBlockedBy", "add_blocked_by"), _input("$.owner", "owner")
    )


def tasks_state_current(creations: DataFrame, updates: DataFrame, results: DataFrame, parity: bool = False) -> DataFrame:
    """Tasks with their latest status. ``parity``: an id is taken to be found even where the result's text has none."""
    named = F.regexp_extract("content", r"Task #(\d+)", 1)
    order = Window.partitionBy("session_id").orderBy(asc_nl("created_at"), asc_nl("tool_use_id"))
    number = F.row_number().over(order).cast("string")
    task = F.coalesce(named if parity else F.nullif(named, F.lit("")), F.get_json_object("content", "$.taskId"), number)
    made = creations.join(results.select("tool_use_id", "content"), "tool_use_id", "left").select("session_id", task.alias("task_id"), "subject", "active_form", "created_at")
    last = updates.where("task_id is not null").groupBy("session_id", "task_id").agg(F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "message_uuid", "tool_use_id")).alias("last"))
    out = made.join(last, ["session_id", "task_id"], "left")
    return out.select("session_id", "task_id", "subject", "active_form", F.coalesce("last.status", F.lit("pending")).alias("status"), "created_at", F.col("last.updated_at").alias("last_updated_at"))


def prior_in_session(rows: DataFrame, texts: DataFrame, name: str = "context_uuid") -> DataFrame:
    """``rows`` (session_id, ts, ...) with the uuid of the last of ``texts`` at or before each: an as-of join by one sort."""
    own = rows.columns
    marked = rows.withColumns({"_side": F.lit(1), "_uuid": F.lit(None).cast("string"), "_nr": F.monotonically_increasing_id()})
    other = texts.select("session_id", "ts", F.lit(0).alias("_side"), F.col("uuid").alias("_uuid"))
    w = Window.partitionBy("session_id").orderBy(asc_nl("ts"), "_side", asc_nl("_uuid"), asc_nl("_nr")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marked.unionByName(other, allowMissingColumns=True)
    return both.withColumn(name, F.last("_uuid", True).over(w)).where("_side = 1").select(*own, name)


def skill_invocations(calls: DataFrame, blocks: DataFrame, messages: DataFrame, text: DataFrame) -> DataFrame:
    """Skills called as tools, and slash commands in text blocks and in plain contents."""
    fields = ["session_id", "ts", "message_uuid", "source", "skill_id", "args", "tool_use_id", "context_uuid"]
    by_tool = calls.where(F.col("tool_name") == "Skill").select("session_id", "ts", "message_uuid", F.lit("tool").alias("source"), _input("$.skill", "skill_id"), _input("$.args", "args"), "tool_use_id").where("skill_id is not null")
    by_tool = prior_in_session(by_tool, text.where("role = 'user'"))

    def slash(df: DataFrame, body: str) -> DataFrame:
        found = df.where(F.contains(F.col(body), F.lit("<command-name>/")))
        return found.select(
            "session_id", "ts", "message_uuid", F.lit("slash_command").alias("source"), F.regexp_extract(body, COMMAND, 1).alias("skill_id"), F.nullif(F.regexp_extract(body, ARGUMENTS, 1), F.lit("")).alias("args"), F.lit(None).cast("string").alias("tool_use_id"), F.col("message_uuid").alias("context_uuid")
        ).where("skill_id <> ''")

    plain = messages.where("role = 'user'").where(F.col("content_json").startswith('"')).select("session_id", "ts", F.col("uuid").alias("message_uuid"), unquoted(F.col("content_json")).alias("body"))
    return by_tool.select(*fields).unionByName(slash(blocks.where("role = 'user' and block_type = 'text'"), "text").select(*fields)).unionByName(slash(plain, "body").select(*fields))


def subagent_sessions(subagents: DataFrame, meta: DataFrame) -> DataFrame:
    one = meta.groupBy("parent_session_id", "agent_hex").agg(any_val("agentType").alias("agent_type"), any_val("description").alias("description"))
    rows = subagents.groupBy("parent_session_id", "agent_hex").agg(ntz(F.min("timestamp")).alias("started_at"), ntz(F.max("timestamp")).alias("ended_at"), F.count(F.lit(1)).alias("message_count"), any_val("source_file").alias("transcript_path"))
    return rows.join(one, ["parent_session_id", "agent_hex"], "left").select("parent_session_id", "agent_hex", "agent_type", "description", "started_at", "ended_at", "message_count", "transcript_path")


def subagent_messages(subagents: DataFrame) -> DataFrame:
    return subagents.where(F.col("type").isin("user", "assistant")).select(
        "uuid",
        unquoted(F.col("parentUuid")).alias("parent_uuid"),
        F.col("sessionId").alias("session_id"),
        "parent_session_id",
        "agent_hex",
        ntz("timestamp").alias("ts"),
        "type",
        F.col("message.role").alias("role"),
        F.col("message.model").alias("model"),
        F.col("message.usage.input_tokens").alias("input_tokens"),
        F.col("message.usage.output_tokens").alias("output_tokens"),
        _content(F.col("message.content")).alias("content_json"),
        "source_file",
    )


def thread_walk(messages: DataFrame, root: str | None = None) -> DataFrame:
    """uuid, root_uuid and depth of each message, by pointer doubling: as many joins as the depth's logarithm.

    ``root``: only this message's descendants. A parent that is missing makes a root.
    Messages that are their own ancestors, and those below them, have no root and are left out.
    """
    from tarnwell.plans.checkpoints import checkpointed

    ids = messages.select("uuid", "parent_uuid")
    known = ids.select(F.col("uuid").alias("parent_uuid"), F.lit(True).alias("known"))
    up = ids.join(known, "parent_uuid", "left").select("uuid", F.when(F.col("known"), F.col("parent_uuid")).alias("up"))
    if root is not None:
        up = up.withColumn("up", F.when(F.col("uuid") != root, F.col("up")))
    state = checkpointed(up.select("uuid", F.coalesce("up", "uuid").alias("top"), F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth"), F.col("up").isNull().alias("done")))
    most, step = state.count(), 1  # no walk to a root is longer than there are messages
    while step < 2 * most and state.where("not done").limit(1).count():
        to = state.select(F.col("uuid").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), F.col("done").alias("over"))
        state = checkpointed(state.join(to, "top").select("uuid", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("done") | F.col("over")).alias("done")))
        step *= 2
    out = state.where("done").select("uuid", F.col("top").alias("root_uuid"), F.col("depth").cast("int").alias("depth"))
    return out.where(F.col("root_uuid") == root) if root is not None else out
