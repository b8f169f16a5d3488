"""The macros as functions of frames. Those that take a session also have a form for all sessions (``None``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import any_val, asc_nl, cosine, l2, now_or, ratio, since

#: Dollars for a million tokens in and out, by model.
RATES = {
    "claude-opus-4-7": (15.0, 75.0),
    "claude-opus-4-6": (15.0, 75.0),
    "claude-sonnet-4-6": (3.0, 15.0),
    "claude-sonnet-4-5": (3.0, 15.0),
    "claude-haiku-4-5": (0.80, 4.0),
}


def ago(interval: str, now: str | Column | None = None) -> Column:
    """The time an interval such as '14 days' ago."""
    return now_or(now) - F.expr(f"interval '{interval}'")


def _of(df: DataFrame, sid: str | None) -> DataFrame:
    return df if sid is None else df.where(F.col("session_id") == sid)


def model_used(messages: DataFrame, sid: str | None = None) -> DataFrame:
    return _of(messages, sid).groupBy("session_id").agg(any_val("model").alias("model"))


def cost_estimate(messages: DataFrame, sid: str | None = None, rates: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """session_id and usd. Reads from the cache cost nothing; sessions without a known model have null."""
    spark = messages.sparkSession
    table = spark.createDataFrame([(m, a, b) for m, (a, b) in (rates or RATES).items()], "rate_model string, in_rate double, out_rate double")
    rows = _of(messages, sid).withColumn("rate_model", F.regexp_replace("model", r"-\d{8}$", ""))
    rows = rows.join(F.broadcast(table), "rate_model", "left")  # a handful of rows
    into = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("cache_write", F.lit(0))
    usd = (into * F.col("in_rate") + F.coalesce("output_tokens", F.lit(0)) * F.col("out_rate")) / 1e6
    return rows.groupBy("session_id").agg(F.sum(usd).alias("usd"))


def tool_rank(calls: DataFrame, days: float | None, now=None) -> DataFrame:
    return calls.where(since(F.col("ts"), days, now)).groupBy("tool_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), asc_nl("tool_name"))


def todo_velocity(todo_events: DataFrame, sid: str | None = None) -> DataFrame:
    return _of(todo_events, sid).groupBy("session_id").agg(ratio(F.count_if(F.col("status") == "completed"), F.count_distinct("subject")).alias("velocity"))


def subagent_fanout(subagent_sessions: DataFrame, sid: str | None = None) -> DataFrame:
    rows = subagent_sessions.withColumnRenamed("parent_session_id", "session_id")
    return _of(rows, sid).groupBy("session_id").agg(F.count(F.lit(1)).alias("fanout"))


def semantic_search(embeddings: DataFrame, query: list[float], k: int, order: str = "cosine") -> DataFrame:
    """The k nearest vectors: by cosine, or by distance as ``order='l2'``. Each task sends k rows at most."""
    q = F.lit([float(x) for x in query])
    rows = embeddings.where(F.size("embedding") == len(query)).select("uuid", cosine(F.col("embedding"), q).alias("similarity"), l2(F.col("embedding"), q).alias("distance"))
    first = F.desc_nulls_last("similarity") if order == "cosine" else F.asc_nulls_last("distance")
    return rows.orderBy(first, "uuid").limit(k)


def skill_rank(usage: DataFrame, days: float | None, now=None) -> DataFrame:
    keys = ["skill_id", "skill_name", "plugin", "is_builtin"]
    return usage.where(since(F.col("ts"), days, now)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions")).orderBy(F.desc("n"), *map(asc_nl, keys))


def skill_source_mix(usage: DataFrame, days: float | None, now=None) -> DataFrame:
    rows = usage.where(since(F.col("ts"), days, now)).where("not is_builtin")
    return rows.groupBy("skill_id", "skill_name").agg(F.count_if(F.col("source") == "tool").alias("n_tool"), F.count_if(F.col("source") == "slash_command").alias("n_slash"), F.count(F.lit(1)).alias("n_total")).orderBy(F.desc("n_total"), asc_nl("skill_id"))


def autonomy_trend(classifications: DataFrame, sessions: DataFrame, days: float | None, now=None) -> DataFrame:
    rows = sessions.where(since(F.col("started_at"), days, now)).join(classifications, "session_id")
    week = F.date_trunc("week", "started_at").cast("timestamp_ntz").alias("week")
    return rows.groupBy(week, "autonomy_tier").agg(F.count(F.lit(1)).alias("n")).orderBy("week", asc_nl("autonomy_tier"))


def work_mix(classifications: DataFrame, days: float | None, now=None) -> DataFrame:
    rows = classifications.where(since(F.col("classified_at").cast("timestamp_ntz"), days, now))
    return rows.groupBy("work_category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), asc_nl("work_category"))


def success_rates(rows: DataFrame, by: str) -> DataFrame:
    is_ = lambda x: F.count_if(F.col("success") == x)
    known = F.count_if(F.col("success") != "unknown")
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("sessions"),
        known.alias("known_sessions"),
        ratio(is_("unknown"), F.count(F.lit(1))).alias("unknown_fraction"),
        ratio(is_("success"), known).alias("success_rate"),
        ratio(is_("failure"), known).alias("failure_rate"),
        ratio(is_("partial"), known).alias("partial_rate"),
    )


def success_rate_by_work(classifications: DataFrame, days: float | None, now=None) -> DataFrame:
    rows = classifications.where(since(F.col("classified_at").cast("timestamp_ntz"), days, now))
    return success_rates(rows, "work_category").orderBy(F.desc("sessions"), asc_nl("work_category"))


def top_per_key(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def cluster_top_terms(terms: DataFrame, cluster: int, n: int) -> DataFrame:
    return terms.where(F.col("cluster_id") == cluster).orderBy("rank", "term").limit(n).select("term", "weight", "rank")


def community_top_topics(messages: DataFrame, communities: DataFrame, clusters: DataFrame, terms: DataFrame, community: int, n: int) -> DataFrame:
    members = communities.where(F.col("community_id") == community).select("session_id")
    ours = messages.join(members, "session_id", "left_semi").select("uuid")
    counts = clusters.where("cluster_id >= 0").join(ours, "uuid").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_msgs"))
    return counts.join(top_term_lists(terms), "cluster_id", "left").orderBy(F.desc("n_msgs"), "cluster_id").limit(n)


def top_term_lists(terms: DataFrame, most: int = 5) -> DataFrame:
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    return terms.where(F.col("rank") <= most).groupBy("cluster_id").agg(F.array_join(ranked, ", ").alias("top_terms"))


def sentiment_arc(messages: DataFrame, trajectory: DataFrame, sid: str) -> DataFrame:
    rows = _of(messages, sid).select(F.col("uuid").alias("curr_uuid"), "ts", "role")
    out = rows.join(trajectory.drop("session_id", "ts", "role"), "curr_uuid")
    return out.select("ts", "role", "curr_sentiment", "delta", "transition_kind", "is_transition", "confidence").orderBy(asc_nl("ts"))


def friction_counts(friction: DataFrame, days: float | None = None, now=None) -> DataFrame:
    rows = friction.where("label <> 'none'").where(since(F.col("ts").cast("timestamp_ntz"), days, now))
    from_ = lambda x: F.count_if(F.col("source") == x)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions"), F.avg("confidence").alias("avg_confidence"), from_("regex").alias("n_regex"), from_("llm").alias("n_llm")).orderBy(F.desc("n"), "label")


#: Labels of user friction and the short names of their counts. Fixed values.
FRICTION = {"status_ping": "n_status", "unmet_expectation": "n_unmet", "confusion": "n_confusion", "interruption": "n_interruption", "correction": "n_correction", "frustration": "n_frustration"}


def friction_rate(friction: DataFrame, text: DataFrame, days: float | None = None, now=None) -> DataFrame:
    hits = friction.where(since(F.col("ts").cast("timestamp_ntz"), days, now)).groupBy("session_id").agg(F.count_if(F.col("label") != "none").alias("n_friction"), *[F.count_if(F.col("label") == k).alias(v) for k, v in FRICTION.items()])
    users = text.where("role = 'user'").where(since(F.col("ts"), days, now)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    out = hits.where("n_friction > 0").join(users, "session_id", "left")
    return out.select("session_id", "n_friction", *FRICTION.values(), F.coalesce("n", F.lit(0)).alias("n_user_msgs"), ratio(F.col("n_friction"), F.col("n")).alias("rate")).orderBy(F.desc("n_friction"), "session_id")


def friction_examples(friction: DataFrame, label: str, n: int) -> DataFrame:
    return friction.where(F.col("label") == label).orderBy(F.desc("confidence"), F.desc("ts"), "uuid").limit(n).select("session_id", "ts", "text_snippet", "rationale", "source", "confidence")


def conflicts_over_time(conflicts: DataFrame, messages: DataFrame, subagent_messages: DataFrame, days: float | None = None, now=None) -> DataFrame:
    turns = messages.where(since(F.col("ts"), days, now)).select(F.col("uuid").alias("turn_b_uuid"), F.col("ts").alias("conversation_ts"))
    roots = subagent_messages.groupBy("session_id").agg(any_val("parent_session_id").alias("root"))
    out = conflicts.join(turns, "turn_b_uuid").join(roots, "session_id", "left")
    return out.select("conversation_ts", "session_id", F.coalesce("root", "session_id").alias("root_session_id"), "turn_a_uuid", "turn_b_uuid", "conflict_kind", "severity", "agent_position", "user_position", "confidence", "detected_at").orderBy(F.desc("conversation_ts"), "turn_b_uuid")


def unused_skills(catalog: DataFrame, invocations: DataFrame, days: float | None, now=None) -> DataFrame:
    used = invocations.where(since(F.col("ts"), days, now)).select("skill_id").distinct()
    rows = catalog.where(F.col("source_kind").isin("user-skill", "plugin-skill", "plugin-command")).join(used, "skill_id", "left_anti")
    return rows.select("skill_id", "name", "plugin", "plugin_version", "source_kind", "description").orderBy(F.asc_nulls_first("plugin"), "name")


#: Names of the macros and what they take. Fixed values.
SIGNATURES = {
    "ago": "interval",
    "model_used": "sid",
    "cost_estimate": "sid",
    "tool_rank": "days",
    "todo_velocity": "sid",
    "subagent_fanout": "sid",
    "semantic_search": "query, k",
    "skill_rank": "days",
    "skill_source_mix": "days",
    "autonomy_trend": "days",
    "work_mix": "days",
    "success_rate_by_work": "days",
    "cluster_top_terms": "cluster, n",
    "community_top_topics": "community, n",
    "sentiment_arc": "sid",
    "friction_counts": "days",
    "friction_rate": "days",
    "friction_examples": "label, n",
    "conflicts_over_time": "days",
    "unused_skills": "days",
    "canonical_uuid_resolve": "",
}
