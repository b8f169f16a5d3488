"""The library's operators over the driver's tables, each with SQL that gives the same rows.

Conversations stand for messages (a message an hour into the year for each
conversation, a minute for each turn), events for tool calls, documents for
texts with stamps and labels, embeddings for vectors with their clusters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.functions import gap_ms, json_items, ratio, spread
from tarnwell.operators import analytics, friction, graph, leiden, macros, stamps, state, terms, trajectory, transcript, vector_table, vectors, views
from tarnwell.plans import checkpoints
from tarnwell.sources.buckets import Buckets
from tarnwell.streaming import watch

NOW = "2024-01-31 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the SQL side.
MESSAGES = """m AS (SELECT conv_id || '-' || turn AS uuid, CAST(conv_id AS VARCHAR) AS session_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS ts, role, text AS text_content, turn FROM conversations)"""
CALLS = "c AS (SELECT CAST(event_id AS VARCHAR) AS uuid, CAST(user_id AS VARCHAR) AS session_id, ts, event_type AS tool_name, value, props FROM events)"


def query(sql: str | None = None):
    """Register a query under its name, with SQL for the same rows if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("timestamp_ntz")
    return table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.col("conv_id").cast("string").alias("session_id"), ts.alias("ts"), "role", F.col("text").alias("text_content"), "turn")


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("uuid"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("tool_name"), "value", "props")


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("uuid"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def micros(ts) -> F.Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def seed(spark: SparkSession, d: str) -> list[float]:
    return list(vecs(spark, d).orderBy("vec_id").select("embedding").first()[0])


@query(
    f"""WITH {MESSAGES}, t AS (SELECT * FROM m WHERE length(text_content) >= 32)
SELECT session_id, lag(uuid) OVER w AS prev_uuid, uuid AS curr_uuid, lag(role) OVER w AS prev_role, role AS curr_role,
  date_diff('millisecond', lag(ts) OVER w, ts) AS gap_ms, row_number() OVER w AS window_idx FROM t WINDOW w AS (PARTITION BY session_id ORDER BY ts, uuid)"""
)
def turn_window(spark, d):
    rows = messages(spark, d).where(F.length("text_content") >= 32)
    return views.turn_window(rows).select("session_id", "prev_uuid", "curr_uuid", "prev_role", "curr_role", "gap_ms", "window_idx")


@query(
    """WITH g AS (SELECT user_id, date_diff('millisecond', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(gap) AS gaps, round(avg(gap), 3) AS avg_gap_ms, max(gap) AS max_gap_ms FROM g GROUP BY user_id"""
)
def turn_gap_stats(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", gap_ms(F.lag("ts").over(w), F.col("ts")).alias("gap"))
    return rows.groupBy("user_id").agg(F.count("gap").alias("gaps"), F.round(F.avg("gap"), 3).alias("avg_gap_ms"), F.max("gap").alias("max_gap_ms"))


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type")
def json_extract_props(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {MESSAGES} SELECT a.uuid, (SELECT u.uuid FROM m u WHERE u.session_id = a.session_id AND u.role = 'user' AND u.ts <= a.ts ORDER BY u.ts DESC, u.uuid DESC LIMIT 1) AS context_uuid
FROM m a WHERE a.role = 'assistant'"""
)
def asof_prior_message(spark, d):
    rows = messages(spark, d)
    found = views.prior_in_session(rows.where("role = 'assistant'").select("uuid", "session_id", "ts"), rows.where("role = 'user'").select("uuid", "session_id", "ts"))
    return found.select("uuid", "context_uuid")


@query(f"WITH {MESSAGES}, {CALLS} SELECT source, kind, count(*) AS n FROM (SELECT 'tool' AS source, tool_name AS kind FROM c UNION ALL SELECT 'message', role FROM m) GROUP BY source, kind")
def union_all_sources(spark, d):
    a = calls(spark, d).select(F.lit("tool").alias("source"), F.col("tool_name").alias("kind"))
    b = messages(spark, d).select(F.lit("message").alias("source"), F.col("role").alias("kind"))
    return a.unionByName(b).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) = 1")
def dedup_latest_qualify(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return analytics.latest(rows, ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query(f"WITH {CALLS} SELECT tool_name, count(*) AS n FROM c WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY GROUP BY tool_name")
def tool_rank(spark, d):
    return macros.tool_rank(calls(spark, d), 14, NOW)


@query(
    f"""WITH {CALLS}, n AS (SELECT session_id, tool_name, count(*) AS n FROM c GROUP BY ALL)
SELECT session_id, tool_name, n FROM n QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, tool_name) = 1"""
)
def modal_tool_per_session(spark, d):
    counts = calls(spark, d).groupBy("session_id", "tool_name").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("session_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "tool_name")).alias("b"))
    return best.select("session_id", "b.tool_name", (-F.col("b.k")).alias("n"))


RATES = {"click": (15.0, 75.0), "view": (3.0, 15.0), "purchase": (0.8, 4.0)}


@query(
    f"""WITH {CALLS}, x AS (SELECT session_id, regexp_replace(tool_name || '-20240101', '-\\d{{8}}$', '') AS model, CAST(floor(abs(value)) AS BIGINT) AS i, CAST(length(props) AS BIGINT) AS o FROM c),
r(model, a, b) AS (VALUES {", ".join(f"('{k}', {a}, {b})" for k, (a, b) in RATES.items())})
SELECT session_id, round(sum((i * a + o * b) / 1e6), 6) AS usd FROM x LEFT JOIN r USING (model) GROUP BY session_id"""
)
def cost_estimate(spark, d):
    rows = calls(spark, d).select("session_id", F.concat("tool_name", F.lit("-20240101")).alias("model"), F.floor(F.abs("value")).cast("long").alias("input_tokens"), F.length("props").cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("cache_write"))
    return macros.cost_estimate(rows, rates=RATES).select("session_id", F.round("usd", 6).alias("usd"))


@query(f"WITH {CALLS} SELECT session_id, round(count(*) FILTER (WHERE tool_name = 'purchase')::DOUBLE / nullif(count(DISTINCT tool_name), 0), 6) AS velocity FROM c GROUP BY session_id")
def velocity_ratio(spark, d):
    rows = calls(spark, d).select("session_id", F.col("tool_name").alias("subject"), F.when(F.col("tool_name") == "purchase", "completed").otherwise("pending").alias("status"))
    return macros.todo_velocity(rows).select("session_id", F.round("velocity", 6).alias("velocity"))


@query("SELECT o_custkey AS session_id, count(*) AS fanout FROM orders GROUP BY o_custkey")
def fanout_per_parent(spark, d):
    return macros.subagent_fanout(table(spark, d, "orders").select(F.col("o_custkey").alias("parent_session_id")))


def _usage(spark, d) -> DataFrame:
    source = F.when(F.col("session_id").cast("long") % 2 == 0, "tool").otherwise("slash_command")
    return calls(spark, d).select("session_id", "ts", source.alias("source"), F.col("tool_name").alias("skill_id"), F.col("tool_name").alias("skill_name"), F.lit(None).cast("string").alias("plugin"), (F.col("tool_name") == "view").alias("is_builtin"))


@query(
    f"""WITH {CALLS} SELECT tool_name AS skill_id, tool_name AS skill_name, count(*) FILTER (WHERE CAST(session_id AS BIGINT) % 2 = 0) AS n_tool,
  count(*) FILTER (WHERE CAST(session_id AS BIGINT) % 2 <> 0) AS n_slash, count(*) AS n_total FROM c WHERE tool_name <> 'view' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY GROUP BY ALL"""
)
def source_mix(spark, d):
    return macros.skill_source_mix(_usage(spark, d), 20, NOW)


@query(f"WITH {CALLS} SELECT tool_name AS skill_id, tool_name = 'view' AS is_builtin, count(*) AS n, count(DISTINCT session_id) AS sessions FROM c WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY GROUP BY ALL")
def skill_rank(spark, d):
    return macros.skill_rank(_usage(spark, d), 20, NOW).select("skill_id", "is_builtin", "n", "sessions")


LABELS = list(macros.FRICTION)
FRICTION_SQL = f"""f AS (SELECT uuid, session_id, ts, CASE CAST(split_part(uuid, '-', 2) AS BIGINT) % 7 {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS))} ELSE 'none' END AS label,
  CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN 'regex' ELSE 'llm' END AS source, 0.5 + (CAST(session_id AS BIGINT) % 5) / 10.0 AS confidence FROM m WHERE role = 'user')"""


def _friction(spark, d) -> DataFrame:
    rows = messages(spark, d).where("role = 'user'")
    label = F.coalesce(F.get(F.array(*map(F.lit, LABELS)), (F.col("turn") % 7).cast("int")), F.lit("none"))
    sid = F.col("session_id").cast("long")
    return rows.select("uuid", "session_id", "ts", label.alias("label"), F.when(sid % 3 == 0, "regex").otherwise("llm").alias("source"), (F.lit(0.5) + (sid % 5) / 10).alias("confidence"), F.col("text_content").alias("text_snippet"), F.lit(None).cast("string").alias("rationale"))


@query(
    f"""WITH {MESSAGES}, {FRICTION_SQL}, h AS (SELECT session_id, count(*) FILTER (WHERE label <> 'none') AS n_friction,
{", ".join(f"count(*) FILTER (WHERE label = '{k}') AS {v}" for k, v in macros.FRICTION.items())} FROM f GROUP BY session_id),
u AS (SELECT session_id, count(*) AS n FROM m WHERE role = 'user' GROUP BY session_id)
SELECT session_id, n_friction, {", ".join(macros.FRICTION.values())}, coalesce(n, 0) AS n_user_msgs, round(n_friction::DOUBLE / nullif(n, 0), 6) AS rate FROM h LEFT JOIN u USING (session_id) WHERE n_friction > 0"""
)
def friction_rate_filters(spark, d):
    return macros.friction_rate(_friction(spark, d), messages(spark, d)).withColumn("rate", F.round("rate", 6))


@query(
    f"""WITH {MESSAGES}, {FRICTION_SQL} SELECT label, count(*) AS n, count(DISTINCT session_id) AS sessions, round(avg(confidence), 6) AS avg_confidence,
  count(*) FILTER (WHERE source = 'regex') AS n_regex, count(*) FILTER (WHERE source = 'llm') AS n_llm FROM f WHERE label <> 'none' GROUP BY label"""
)
def friction_counts(spark, d):
    return macros.friction_counts(_friction(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(f"WITH {MESSAGES}, {FRICTION_SQL} SELECT uuid, round(confidence, 4) AS confidence FROM f WHERE label = 'confusion' ORDER BY f.confidence DESC, ts DESC, uuid LIMIT 20")
def friction_examples(spark, d):
    rows = _friction(spark, d).withColumn("session_id", F.col("uuid"))
    return macros.friction_examples(rows, "confusion", 20).select(F.col("session_id").alias("uuid"), F.round("confidence", 4).alias("confidence"))


@query("SELECT epoch_us(date_trunc('week', ts)) AS week, event_type, count(*) AS n FROM events GROUP BY ALL")
def weekly_trend(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("session_id"), F.col("ts").alias("started_at"), F.col("event_type").alias("autonomy_tier"))
    out = macros.autonomy_trend(rows.select("session_id", "autonomy_tier"), rows.select("session_id", "started_at"), None)
    return out.select(micros("week").alias("week"), F.col("autonomy_tier").alias("event_type"), "n")


@query(
    """SELECT lang, count(*) AS sessions, count(quality) AS known_sessions, round(count(*) FILTER (WHERE quality IS NULL)::DOUBLE / nullif(count(*), 0), 6) AS unknown_fraction,
  round(count(*) FILTER (WHERE quality = 1 AND toxic = 0)::DOUBLE / nullif(count(quality), 0), 6) AS success_rate, round(count(*) FILTER (WHERE quality = 0)::DOUBLE / nullif(count(quality), 0), 6) AS failure_rate,
  round(count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE / nullif(count(quality), 0), 6) AS partial_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"""
)
def success_rate_known(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    success = F.when(F.col("quality") == 0, "failure").when((F.col("quality") == 1) & (F.col("toxic") == 0), "success").when(F.col("quality") == 1, "partial").otherwise("unknown")
    out = macros.success_rates(rows.withColumn("success", success), "lang")
    return out.select("lang", "sessions", "known_sessions", *[F.round(c, 6).alias(c) for c in ("unknown_fraction", "success_rate", "failure_rate", "partial_rate")])


@query("SELECT label AS work_category, count(*) AS n FROM embeddings GROUP BY label")
def work_mix(spark, d):
    rows = vecs(spark, d).select(F.col("label").alias("work_category"), F.lit(NOW).cast("timestamp").alias("classified_at"))
    return macros.work_mix(rows, 30, NOW)


TERM_COUNTS = """t AS (SELECT source, unnest(regexp_extract_all(translate(lower(text), '{a}', '{b}'), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents WHERE text IS NOT NULL),
n AS (SELECT source, term, count(*) AS tf FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tf DESC, term) AS rank FROM n)""".format(a=terms.MARKED, b=terms.PLAIN)


def _term_ranks(spark, d) -> DataFrame:
    counts = terms.ngrams(table(spark, d, "documents"), "source", "text", 1).groupBy("source", "term").agg(F.count(F.lit(1)).alias("tf"))
    w = Window.partitionBy("source").orderBy(F.desc("tf"), "term")
    return counts.withColumn("rank", F.row_number().over(w).cast("long"))


@query(f"WITH {TERM_COUNTS} SELECT source, term, tf, rank FROM r WHERE rank <= 10")
def top_terms_rank(spark, d):
    return _term_ranks(spark, d).where("rank <= 10")


@query(f"WITH {TERM_COUNTS}, c AS (SELECT source, count(*) AS n_msgs FROM documents GROUP BY source) SELECT source, n_msgs, (SELECT string_agg(term, ', ' ORDER BY rank) FROM r WHERE r.source = c.source AND rank <= 5) AS top_terms FROM c")
def community_topics(spark, d):
    lists = macros.top_term_lists(_term_ranks(spark, d).withColumnRenamed("source", "cluster_id"))
    counts = table(spark, d, "documents").groupBy(F.col("source").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n_msgs"))
    return counts.join(lists, "cluster_id", "left").select(F.col("cluster_id").alias("source"), "n_msgs", "top_terms")


@query("SELECT c_custkey AS skill_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00')")
def unused_left_anti(spark, d):
    catalog = table(spark, d, "customer").select(F.col("c_custkey").alias("skill_id"), F.col("c_name").alias("name"), F.lit("user-skill").alias("source_kind"), *[F.lit(None).cast("string").alias(c) for c in ("plugin", "plugin_version", "description")])
    used = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("skill_id"), F.lit(NOW).cast("timestamp_ntz").alias("ts"))
    return macros.unused_skills(catalog, used, None).select("skill_id")


@query(f"SELECT 'all' AS span, event_type, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'recent', event_type, count(*) FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY ALL")
def recent_or_null_window(spark, d):
    rows = calls(spark, d)
    both = [macros.tool_rank(rows, days, NOW).select(F.lit(name).alias("span"), F.col("tool_name").alias("event_type"), "n") for name, days in (("all", None), ("recent", 7))]
    return both[0].unionByName(both[1])


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents")
def exact_dup_canonical(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("canonical"))
    return docs.join(first, "h").select("doc_id", "canonical")


STAMPS = "s AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS uuid, CAST('0x' || substr(md5(coalesce(text, '')), 1, 5) AS BIGINT) * 1099511627776 AS sig, hash_ts AS ts FROM (SELECT *, (doc_id * 7919) % 10007 AS hash_ts FROM documents))"
NEAR = "a.sig >> 48 = b.sig >> 48 AND bit_count(xor(a.sig, b.sig)) <= 3"


def _stamps(spark, d) -> DataFrame:
    sig = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 5), 16, 10).cast("long") * 1099511627776
    return table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("uuid"), sig.alias("simhash64"), ((F.col("doc_id") * 7919) % 10007).alias("first_seen_ts"))


@query(f"WITH {STAMPS} SELECT a.uuid, min(b.uuid) AS canonical_uuid FROM s a JOIN s b ON {NEAR} AND b.ts <= a.ts GROUP BY a.uuid")
def near_dup_macro(spark, d):
    return stamps.canonical(_stamps(spark, d), "macro")


@query(f"WITH {STAMPS} SELECT a.uuid, coalesce(min(b.uuid), a.uuid) AS canonical_uuid FROM s a LEFT JOIN s b ON {NEAR} AND b.ts < a.ts GROUP BY a.uuid")
def near_dup_worker(spark, d):
    return stamps.canonical(_stamps(spark, d), "worker")


@query(f"WITH {STAMPS} SELECT a.uuid, min_by(b.uuid, b.ts * 1000000000000 + CAST(b.uuid AS BIGINT)) AS canonical_uuid FROM s a JOIN s b ON {NEAR} GROUP BY a.uuid")
def near_dup_earliest(spark, d):
    return stamps.canonical(_stamps(spark, d), "earliest")


@query("""SELECT CASE WHEN n <= 256 THEN 'xs' WHEN n <= 2048 THEN 'sm' WHEN n <= 8192 THEN 'md' WHEN n <= 32768 THEN 'lg' ELSE 'xl' END AS bucket, count(*) AS n_docs, sum(n)::BIGINT AS tokens FROM (SELECT n_chars // 4 AS n FROM documents) GROUP BY 1""")
def token_budget_hist(spark, d):
    rows = table(spark, d, "documents").select(F.floor(F.col("n_chars") / 4).cast("long").alias("n"))
    return rows.groupBy(stamps.token_budget(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("tokens"))


VECS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT e AS s FROM v ORDER BY vec_id LIMIT 1)"


@query(f"WITH {VECS}, x AS (SELECT vec_id, list_cosine_similarity(e, s) AS sim FROM v, q) SELECT vec_id, round(sim, 4) AS similarity FROM x ORDER BY sim DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    best = macros.semantic_search(vecs(spark, d), seed(spark, d), 10)
    return best.select(F.col("uuid").cast("long").alias("vec_id"), F.round("similarity", 4).alias("similarity"))


@query(f"WITH {VECS}, x AS (SELECT vec_id, list_distance(e, s) AS dist FROM v, q) SELECT vec_id, round(dist, 4) AS distance FROM x ORDER BY dist, vec_id LIMIT 10")
def l2_topk(spark, d):
    best = macros.semantic_search(vecs(spark, d), seed(spark, d), 10, order="l2")
    return best.select(F.col("uuid").cast("long").alias("vec_id"), F.round("distance", 4).alias("distance"))


@query(f"WITH {VECS}, x AS (SELECT vec_id, 1 - list_cosine_similarity(e, s) AS dist FROM v, q WHERE vec_id <> (SELECT min(vec_id) FROM v)) SELECT vec_id, round(dist, 4) AS distance FROM x ORDER BY dist, vec_id LIMIT 15")
def neighbors_of_seed(spark, d):
    rows = vecs(spark, d)
    first = rows.agg(F.min("uuid")).first()[0]
    return vectors.neighbours(rows, first, 15).select(F.col("uuid").cast("long").alias("vec_id"), F.round("distance", 4).alias("distance"))


CENTRES = f"{VECS}, p AS (SELECT label, i, avg(e[i]) AS x FROM v, generate_series(1, 64) AS g(i) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM p GROUP BY label)"


def _centres(spark, d) -> DataFrame:
    rows = vecs(spark, d)
    return vectors.centroids(rows, rows.select("uuid", F.col("label").cast("string").alias("session_id")))


@query(f"WITH {CENTRES}, z AS (SELECT c AS s FROM c WHERE label = (SELECT min(label) FROM c)) SELECT label, round(list_cosine_similarity(c, s), 4) AS similarity FROM c, z WHERE label <> (SELECT min(label) FROM c)")
def centroid_topk(spark, d):
    centres = _centres(spark, d)
    first = str(vecs(spark, d).agg(F.min("label")).first()[0])
    return vectors.neighbours_of_session(centres, first, None, 1_000_000).select(F.col("session_id").cast("int").alias("label"), F.round("similarity", 4).alias("similarity"))


@query(
    f"""WITH {VECS}, x AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 12) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM x), t AS (SELECT a, b, sim FROM k WHERE n <= 5)
SELECT t.a AS src, t.b AS dst, round(t.sim, 4) AS weight FROM t JOIN t u ON u.a = t.b AND u.b = t.a WHERE t.a < t.b"""
)
def mutual_knn_edges(spark, d):
    edges = graph.mutual_knn(vecs(spark, d), "uuid", "embedding", 5, -1.0)
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("weight", 4).alias("weight"))


@query(
    f"""WITH {VECS}, x AS (SELECT a.label, a.vec_id, avg(list_cosine_similarity(a.e, b.e)) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 12) DESC, vec_id) AS n FROM x)
SELECT label, max(vec_id) FILTER (WHERE n = 1) AS medoid, round(avg(s), 4) AS coherence FROM r GROUP BY label"""
)
def medoid_coherence(spark, d):
    rows = vecs(spark, d)
    found = graph.medoids(rows, rows.select(F.col("uuid").alias("id"), F.col("label").alias("community")), "uuid", "embedding")
    return found.select(F.col("community").alias("label"), F.col("medoid").cast("long").alias("medoid"), F.round("coherence", 4).alias("coherence"))


@query("SELECT label AS cluster_id, count(*) AS n, min(vec_id) AS first_id, round(count(*)::DOUBLE / (SELECT count(*) FROM embeddings), 6) AS share FROM embeddings GROUP BY label")
def cluster_overview(spark, d):
    rows = vecs(spark, d)
    sizes = rows.groupBy(F.col("label").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
    whole = sizes.agg(F.sum("n").alias("all"))
    return sizes.crossJoin(F.broadcast(whole)).select("cluster_id", "n", "first_id", F.round(ratio(F.col("n"), F.col("all")), 6).alias("share"))  # one row


@query(
    """WITH s AS (SELECT label, count(*) AS n, min(vec_id) AS f FROM embeddings GROUP BY label), r AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, f) - 1 AS k FROM s WHERE n >= 45)
SELECT vec_id, CAST(coalesce(k, -1) AS INTEGER) AS community_id, CAST(coalesce(n, 0) AS INTEGER) AS size FROM embeddings LEFT JOIN r USING (label)"""
)
def relabel_by_size(spark, d):
    rows = vecs(spark, d).select(F.col("uuid").alias("id"), F.col("label").alias("community"))
    return graph.relabel(rows, 45).select(F.col("id").cast("long").alias("vec_id"), "community_id", "size")


@query(
    """WITH w AS (SELECT lang, regexp_extract_all(translate(lower(text), '{a}', '{b}'), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT lang, unnest(w) AS term FROM w UNION ALL SELECT lang, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1),
n AS (SELECT lang, term, count(*) AS tf FROM t GROUP BY ALL), f AS (SELECT term, count(*) AS df, sum(tf) AS f FROM n GROUP BY term),
k AS (SELECT n.*, f.f FROM n JOIN f USING (term) WHERE df >= 2 AND df <= 0.95 * (SELECT count(DISTINCT lang) FROM documents)),
x AS (SELECT lang, term, tf / sum(tf) OVER (PARTITION BY lang) * ln(1 + 1 / f) AS weight FROM k)
SELECT lang, term, round(weight, 8) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(weight, 12) DESC, term) AS rank FROM x) WHERE rank <= 10""".format(a=terms.MARKED, b=terms.PLAIN)
)
def ctfidf_terms(spark, d):
    out = terms.ctfidf(table(spark, d, "documents").where("text is not null"), "lang", "text")
    return out.select("lang", "term", F.round("weight", 8).alias("weight"), F.col("rank").cast("long").alias("rank"))


def _noisy(spark, d) -> DataFrame:
    """Messages of which every third is cut to its first two words, so that repeats occur."""
    short = F.array_join(F.slice(F.split("text_content", " "), 1, 1), " ")
    return messages(spark, d).withColumn("text_content", F.when(F.col("turn") % 3 == 0, F.concat(short, F.lit("?"))).otherwise(F.col("text_content")))


NOISY = f"{MESSAGES}, y AS (SELECT * REPLACE (CASE WHEN turn % 3 = 0 THEN split_part(text_content, ' ', 1) || '?' ELSE text_content END AS text_content) FROM m)"


@query(
    f"""WITH {NOISY}, s AS (SELECT uuid, user_id, said, row_number() OVER (PARTITION BY user_id ORDER BY ts, uuid) AS rn FROM (SELECT uuid, CAST(CAST(session_id AS BIGINT) // 50 AS VARCHAR) AS user_id, ts,
  lower(regexp_replace(text_content, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS said FROM y WHERE role = 'user'))
SELECT DISTINCT a.uuid FROM s a JOIN s b ON a.user_id = b.user_id AND a.said = b.said AND b.rn < a.rn AND a.rn - b.rn <= 10"""
)
def repeated_within_10(spark, d):
    rows = _noisy(spark, d).withColumn("session_id", F.floor(F.col("session_id").cast("long") / 50).cast("string"))
    return friction.repeated(rows)


@query(f"WITH {NOISY} SELECT uuid FROM y WHERE role = 'user' AND length(text_content) <= 30 AND lower(rtrim(split_part(trim(text_content), ' ', 1), '.,!?')) IN ('the', 'and', 'is', 'a', 'le', 'de')")
def short_imperative(spark, d):
    return friction.imperative(_noisy(spark, d), words=("the", "and", "is", "a", "le", "de"))


@query(
    f"""WITH {NOISY}, e AS (SELECT session_id, ts + INTERVAL 1 SECOND AS ts FROM m WHERE role = 'assistant' AND turn % 2 = 1)
SELECT DISTINCT t.uuid FROM y t JOIN e ON e.session_id = t.session_id AND e.ts < t.ts WHERE t.role = 'user' AND t.text_content LIKE '%?'
  AND NOT EXISTS (SELECT 1 FROM y z WHERE z.session_id = t.session_id AND z.ts > e.ts AND z.ts < t.ts)"""
)
def error_then_question(spark, d):
    rows = _noisy(spark, d)
    errors = rows.where("role = 'assistant' and turn % 2 = 1").select("session_id", (F.col("ts") + F.expr("interval 1 second")).alias("ts"))
    return friction.question_after_error(rows, errors)


PHRASES = ("any update?", "how is it going", "wait, no", "stop.", "no, that is wrong", "that's not it", "try again", "what's the eta", "hold on", "plain words")


@query(
    f"""WITH {MESSAGES}, p(k, x, label) AS (VALUES {", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}', {chr(39) + y + chr(39) if y else 'NULL'})" for i, (x, y) in enumerate(zip(PHRASES, ("status_ping", "status_ping", "interruption", "interruption", "correction", "correction", "correction", "status_ping", "interruption", None), strict=True)))})
SELECT uuid, label FROM m JOIN p ON k = turn % {len(PHRASES)} WHERE label IS NOT NULL"""
)
def regex_fast_path(spark, d):
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("turn") % len(PHRASES)).cast("int"))
    return messages(spark, d).select("uuid", friction.pattern_label(phrase).alias("label")).where("label is not null")


@query(
    f"""WITH RECURSIVE {MESSAGES}, p AS (SELECT uuid, session_id || '-' || (turn - 1) AS parent FROM m), w AS (SELECT uuid, uuid AS root_uuid, 0 AS depth FROM p WHERE parent NOT IN (SELECT uuid FROM m)
UNION ALL SELECT p.uuid, w.root_uuid, w.depth + 1 FROM w JOIN p ON p.parent = w.uuid) SELECT uuid, root_uuid, CAST(depth AS BIGINT) AS depth FROM w"""
)
def thread_walk(spark, d):
    rows = messages(spark, d).withColumn("parent_uuid", F.concat("session_id", F.lit("-"), (F.col("turn") - 1).cast("string")))
    return views.thread_walk(rows).withColumn("depth", F.col("depth").cast("long"))


@query(
    f"""WITH {MESSAGES}, x AS (SELECT session_id, uuid, role, lpad(CAST(turn AS VARCHAR), 4, '0') AS t, regexp_replace(text_content, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g') AS b,
  CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'tool' THEN 2 WHEN 'system' THEN 3 ELSE 99 END AS k FROM m)
SELECT session_id, md5(left(string_agg('[' || role || ' ' || t || '] ' || CASE WHEN length(b) > 8000 THEN left(b, 8000) || ' …' ELSE b END, chr(10) ORDER BY t, k, uuid), 200000)) AS digest FROM x WHERE b <> '' GROUP BY session_id"""
)
def transcript_render(spark, d):
    rows = messages(spark, d).select("session_id", "uuid", F.col("role").alias("type"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("timestamp"), F.to_json(F.struct("role", F.col("text_content").alias("content"))).alias("message"))
    return transcript.collapse(rows).select("session_id", F.md5("transcript").alias("digest"))


@query(
    """WITH r AS (SELECT user_id, event_type, epoch_us(ts) AS t, lead(event_type) OVER w AS n, lead(epoch_us(ts)) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS pairs, sum(nt - t)::BIGINT AS total_us FROM r WHERE event_type = 'view' AND n = 'click' GROUP BY user_id"""
)
def latency_pairing(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "event_type", micros("ts").alias("t"), F.lead("event_type").over(w).alias("n"), F.lead(micros("ts")).over(w).alias("nt"))
    return rows.where("event_type = 'view' and n = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("nt") - F.col("t")).alias("total_us"))


@query(
    """SELECT CASE WHEN l_quantity < 10 THEN '1: under 10' WHEN l_quantity < 25 THEN '2: under 25' ELSE '3: more' END AS bucket, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL"""
)
def bucket_histogram(spark, d):
    q = F.col("l_quantity")
    bucket = F.when(q < 10, "1: under 10").when(q < 25, "2: under 25").otherwise("3: more")
    return table(spark, d, "lineitem").groupBy(bucket.alias("bucket"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus <> 'F') AS kinds FROM orders GROUP BY o_custkey HAVING n >= 10")
def having_alias(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))).alias("kinds"))
    return rows.where("n >= 10")


@query("SELECT quality - toxic AS delta, count(*) AS n, row_number() OVER (ORDER BY quality - toxic NULLS FIRST) AS place FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality - toxic")
def nulls_first_histogram(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").groupBy((F.col("quality") - F.col("toxic")).alias("delta")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_first("delta"))).cast("long"))


@query(
    """WITH a AS (SELECT user_id, max(epoch_us(ts)) AS t FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' GROUP BY user_id), b AS (SELECT user_id, max(epoch_us(ts)) AS t FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS path, CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (user_id) WHERE a.t IS DISTINCT FROM b.t"""
)
def incremental_diff(spark, d):
    rows = table(spark, d, "events")

    def listing(where: str) -> DataFrame:
        return rows.where(where).groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max(micros("ts")).alias("mtime"))

    return watch.diff_frames(listing("ts < timestamp_ntz'2024-01-10'"), listing("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-12'"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_extension(spark, d):
    out = watch.windowed(table(spark, d, "events"), "ts", "1 hour", keys=("event_type",))
    return out.select(micros("window_start").alias("window_start"), "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_extension(spark, d):
    out = watch.sessionized(table(spark, d, "events"), "ts", "6 hours", ("user_id",))
    return out.select("user_id", micros("session_start").alias("session_start"), "n")


TRAJECTORY = f"""{MESSAGES}, x AS (SELECT session_id, uuid, ts, lag(uuid) OVER w AS prev_uuid, CASE turn % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS cs,
  lag(CASE turn % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END) OVER w AS ps FROM m WINDOW w AS (PARTITION BY session_id ORDER BY ts, uuid))"""
VALUE = "CASE {} WHEN 'negative' THEN -1 WHEN 'positive' THEN 1 ELSE 0 END"


@query(f"WITH {TRAJECTORY} SELECT session_id, uuid AS curr_uuid, ps AS prev_sentiment, cs AS curr_sentiment, CASE WHEN ps IS NOT NULL THEN ({VALUE.format('cs')} - {VALUE.format('ps')})::DOUBLE END AS delta FROM x")
def sentiment_arc(spark, d):
    rows = messages(spark, d)
    feel = F.get(F.array(*map(F.lit, ("negative", "neutral", "positive"))), (F.col("turn") % 3).cast("int"))
    w = Window.partitionBy("session_id").orderBy("ts", "uuid")
    answers = rows.select("session_id", F.lag("uuid").over(w).alias("prev_uuid"), F.col("uuid").alias("curr_uuid"), F.lag(feel).over(w).alias("prev_sentiment"), feel.alias("curr_sentiment"), F.lit(None).cast("string").alias("delta"), F.lit(None).cast("boolean").alias("is_transition"), F.lit("none").alias("transition_kind"), F.lit(1.0).alias("confidence"))
    return trajectory.rows_of(answers).select("session_id", "curr_uuid", "prev_sentiment", "curr_sentiment", "delta")


@query(
    f"""WITH {MESSAGES}, k AS (SELECT session_id, min(uuid) AS a, max(uuid) AS b FROM m GROUP BY session_id HAVING count(*) > 1), r AS (SELECT CAST(o_orderkey AS VARCHAR) AS s, min(CAST(o_custkey AS VARCHAR)) AS root FROM orders GROUP BY 1)
SELECT k.session_id, coalesce(root, k.session_id) AS root_session_id, b AS turn_b_uuid, epoch_us(m.ts) AS conversation_ts FROM k JOIN m ON m.uuid = b LEFT JOIN r ON s = k.session_id"""
)
def conflicts_over_time(spark, d):
    rows = messages(spark, d)
    pairs = rows.groupBy("session_id").agg(F.min("uuid").alias("turn_a_uuid"), F.max("uuid").alias("turn_b_uuid"), F.count(F.lit(1)).alias("n")).where("n > 1")
    none = F.lit(None).cast("string")
    conflicts = pairs.select("session_id", "turn_a_uuid", "turn_b_uuid", *[none.alias(c) for c in ("conflict_kind", "severity", "agent_position", "user_position")], F.lit(0.5).alias("confidence"), F.lit(NOW).cast("timestamp").alias("detected_at"))
    children = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_custkey").cast("string").alias("parent_session_id"))
    out = macros.conflicts_over_time(conflicts, rows, children)
    return out.select("session_id", "root_session_id", "turn_b_uuid", micros("conversation_ts").alias("conversation_ts"))


@query(f"WITH {MESSAGES} SELECT session_id, epoch_us(max(ts)) AS last_ts FROM m GROUP BY session_id HAVING max(ts) >= TIMESTAMP '{NOW}' - INTERVAL 29 DAY")
def session_bounds(spark, d):
    return transcript.session_bounds(messages(spark, d), days=29, now=NOW).select("session_id", micros("last_ts").alias("last_ts"))


@query(
    f"""WITH {MESSAGES}, b AS (SELECT session_id, max(ts) AS t FROM m GROUP BY session_id), k AS (SELECT session_id, max(ts) AS t FROM m WHERE turn < 4 GROUP BY session_id)
SELECT session_id FROM b LEFT JOIN k USING (session_id) WHERE k.t IS NULL OR b.t > k.t"""
)
def checkpoint_pending(spark, d):
    rows = messages(spark, d)
    mtime = F.lit(NOW).cast("timestamp").alias("mtime")
    bounds = rows.groupBy("session_id").agg(F.max("ts").alias("last_ts")).select("session_id", "last_ts", mtime)
    old = rows.where("turn < 4").groupBy("session_id").agg(F.max("ts").alias("last_ts")).select("session_id", "last_ts", mtime)
    none = spark.createDataFrame([], "session_id string, pipeline string, last_ts_processed timestamp, last_mtime_processed timestamp, completed_at timestamp")
    return state.pending_sessions(bounds, state.mark_completed(none, old, "classify"), "classify").select("session_id")


@query("SELECT r_name, n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def inner_join_chain(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("SELECT p_brand, p_type, round(p_retailprice, 2) AS price, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def top_k_per_group(spark, d):
    rows = macros.top_per_key(table(spark, d, "part"), "p_brand", [F.desc("p_retailprice"), "p_partkey"], 3)
    return rows.select("p_brand", "p_type", F.round("p_retailprice", 2).alias("price"), "p_partkey")


@query()
def simhash_stamps(spark, d):
    """Stamps of all documents; hashing has no SQL."""
    rows = spread(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("uuid"), "source", F.coalesce("text", F.lit("")).alias("text_content")))
    return rows.select("uuid", stamps.simhash("text_content").alias("simhash64"), stamps.approx_tokens("text_content").alias("approx_tokens"))


@query()
def sessions_in_communities(spark, d):
    """Communities of the vectors by label and tenth; the partition is found by seeded moves."""
    rows = vecs(spark, d)
    sids = rows.select("uuid", F.concat_ws("-", "label", (F.col("vec_id") % 10)).alias("session_id"))
    return graph.session_communities(vectors.centroids(rows, sids), gamma=0.3, k=8)[0]




@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL")
def index_recall(spark, d):
    """A table of quantized vectors, made, added to, and asked: whether it gives 95 % of the ten nearest that comparing all gives."""
    checkpoints.ready(spark)
    rows = vecs(spark, d)
    made = vector_table.VectorTable(spark, f"{spark.sparkContext.getCheckpointDir()}/vectors-{uuid.uuid4().hex}").create(rows.where("vec_id % 4 <> 1"))
    made.append(rows)
    asked = rows.where("vec_id % 20 = 0").select(F.col("uuid").alias("query"), F.col("embedding").alias("vector"))
    return made.recall(asked).agg(F.count(F.lit(1)).alias("queries"), (F.avg("share") >= 0.95).alias("enough"))


@query("SELECT count(DISTINCT label || '-' || vec_id % 10) AS sessions, 0 AS split, true AS positive FROM embeddings WHERE embedding IS NOT NULL")
def communities_hold(spark, d):
    """Every session is in one community, no community falls apart, and they are worth more than none: what any right partition has."""
    rows = vecs(spark, d)
    sids = rows.select("uuid", F.concat_ws("-", "label", (F.col("vec_id") % 10)).alias("session_id"))
    centroids = checkpoints.checkpointed(vectors.centroids(rows, sids))
    nodes = centroids.select(F.col("session_id").alias("id"))
    edges = checkpoints.checkpointed(graph.mutual_knn(centroids, "session_id", "centroid", 8))
    found = checkpoints.checkpointed(leiden.communities(edges, nodes, [0.3]))
    split = graph.disconnected(edges, found).agg(F.count(F.lit(1)).cast("int").alias("split"))
    worth = leiden.quality(edges, found).select((F.col("quality") > 0).alias("positive"))
    return found.agg(F.count_distinct("id").alias("sessions")).crossJoin(split).crossJoin(worth)  # a row each


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table of events, a file or a folder, as a stream (of a pattern, as streams take no single file)."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


#: Bursts of events of a user that end when it was quiet for an hour, as far as the table's last event has shown that.
BURSTS = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(ts) // 1000 AS t FROM events),
g AS (SELECT *, CAST(t - lag(t) OVER (PARTITION BY path ORDER BY t) >= 3600000 AS INT) AS fresh FROM e),
b AS (SELECT *, sum(coalesce(fresh, 0)) OVER (PARTITION BY path ORDER BY t ROWS UNBOUNDED PRECEDING) AS nr FROM g)
SELECT path, min(t) AS first_ms, max(t) AS latest_ms, count(*) AS n, max(t) + 3600000 AS due_ms FROM b GROUP BY path, nr HAVING max(t) + 3600000 <= (SELECT max(t) FROM e)"""


@query(BURSTS)
def debounced_events(spark, d):
    """A stream of events by user, debounced by keyed state with timers."""
    checkpoints.ready(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/debounced-{uuid.uuid4().hex}"
    rows = event_stream(spark, d)
    changes = rows.select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", "0 seconds")
    out = watch.debounced(changes, 3600, 0, at="at")
    out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, first_ms long, latest_ms long, n long, due_ms long").parquet(f"{place}/out")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest_wins(spark, d):
    """Events as a stream, and half of them once more, into a table in buckets where the last one of each user stays."""
    checkpoints.ready(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/latest-{uuid.uuid4().hex}"
    last = Buckets(spark, f"{place}/table", "user_id long, ts timestamp, event_id long, event_type string", ("user_id",), 16)
    rows = event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    again = rows.where("event_id % 2 = 0")
    watch.keep_latest(rows.unionByName(again), last, ("ts", "event_id"), f"{place}/state").awaitTermination()
    return last.read().select("user_id", "event_id", "event_type")


#: A bit is set where more than half of the distinct 3-grams' hashes have it.
SIMHASHES = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
h AS (SELECT doc_id, ('0x' || substr(md5(gram), 1, 16))::UBIGINT AS h FROM g),
c AS (SELECT doc_id, count(*) AS n, list_transform(range(64), lambda b: 0) AS none FROM h GROUP BY doc_id),
s AS (SELECT doc_id, b, sum(((h >> b) & 1)::BIGINT) AS ones FROM h, (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY ALL),
v AS (SELECT doc_id, sum(CASE WHEN 2 * ones > n THEN (1::HUGEINT) << b::HUGEINT ELSE 0 END)::HUGEINT AS v FROM s JOIN c USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE coalesce(v, 0) END)::BIGINT AS simhash64 FROM documents d LEFT JOIN v USING (doc_id)"""


@query(SIMHASHES)
def simhash_without_python(spark, d):
    """SimHash of whole documents in Spark's own expressions."""
    return stamps.simhashes_of(table(spark, d, "documents"), "doc_id", "text")
