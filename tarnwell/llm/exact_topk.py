"""Exact top-k search by inner product: the threshold algorithm over sorted lists, one list a dimension.

Vectors are dealt to blocks. A block's task sorts it once by each dimension. A query
reads all lists in step, the largest contribution first (from the other end where
its weight is negative), twice as many entries each time, looks up the whole vector
of every new one, and keeps its k best. What no list has shown yet scores at most the sum of the contributions the
lists stand at; the query stops when that bound is below its kth result or below
``floor``, a score that k vectors of the first block are known to reach. A bound
equal to the kth score goes on, as a tie may have a smaller id.

Every query meets every block, in blocks of queries; a block hands on k rows a query
at most, and only such as reach the floor; a window ranks them.

Components become whole numbers, so scores are exact: products are summed as doubles
where they stay below 2^53, else as Python's integers; a score must fit a long.

Defined results: vectors that are null, or hold a null or a number that isn't finite,
take no part; vectors of another length than the query's are no candidates; an empty
vector is like others (its score is 0); a row without an id is a candidate, behind
all others with its score, and never a query; rows that share an id are queries of
their own, and none is a candidate of the others; rows that are equal but for the id
tie; fewer candidates than k are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.flat import checkpointed
from tarnwell.llm.text import pick

#: Rows and queries of a task's blocks.
BLOCK, QUERIES = 4096, 1024
#: Stands for a missing id, behind all others; for no bound, below all scores.
NO_ID, NO_FLOOR = 2**63 - 1, -(2**63)
#: Whole numbers below are exact as doubles.
SAFE = 2.0**53


class Lists:
    """A block's vectors by id, and for each dimension its rows by rising value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.most = float(np.abs(self.vectors).max(initial=0))

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places in ``queries``, ids, scores) of each one's k best rows with another id than its own, ties to the smaller id; and how many entries of each list it read.

        Queries read on together: a row that one end of a list shows is looked up for
        all that have not stopped. A query's bound takes the upper end of a dimension
        where its weight is positive, else the lower one. A score and a row are one
        whole number, so that the largest are the best and ties are settled.
        """
        n, m = len(self.ids), len(queries)
        wide = self.most * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) * n >= SAFE
        vectors, queries = (x.astype(np.int64).astype(object) if wide else x for x in (self.vectors, queries))
        kind, none = (object, -(1 << 200)) if wide else (np.int64, -(1 << 62))
        floors = np.full(m, NO_FLOOR) if floors is None else floors
        best, read = np.full((m, k), none, kind), np.full(m, n)
        up, down = np.where(queries > 0, queries, 0), np.where(queries < 0, queries, 0)
        seen, live, depth, step = np.zeros(n, bool), np.arange(m), 0, 1
        while depth < n and len(live):
            end = min(n, depth + step)
            shown = np.zeros(n, bool)
            shown[self.order[depth:end]] = shown[self.order[n - end : n - depth]] = True
            if not queries.shape[1]:
                shown[depth:end] = True
            new = np.flatnonzero(shown & ~seen)
            seen |= shown
            keys = (queries[live] @ vectors[new].T).astype(kind) * n + (n - 1 - new)
            keys[own[live][:, None] == self.ids[new][None, :]] = none
            keys = np.concatenate([best[live], keys], axis=1)
            best[live] = np.sort(keys, axis=1)[:, -k:] if wide else np.partition(keys, -k, axis=1)[:, -k:]
            dims = np.arange(queries.shape[1])
            bound = up[live] @ vectors[self.order[n - end], dims] + down[live] @ vectors[self.order[end - 1], dims]
            kth = best[live].min(axis=1) // n
            stops = (bound < floors[live]) | (bound < kth)
            read[live[stops]] = end
            live, depth, step = live[~stops], end, step * 2
        best = np.sort(best, axis=1)[:, ::-1]
        score = best // n
        place, at = np.nonzero((best != none) & (score >= floors[:, None]))
        return place, self.ids[(n - 1 - best[place, at] % n).astype(int)], score[place, at], read


def whole(vector: Column, scale: float = 256) -> Column:
    """Components times ``scale``, rounded down; null where one is missing or not finite."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(numbers, lambda x: F.floor(x * scale).cast("double")))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in values])


def _met(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query, id and score of the k best of each block for each query that meets it; both are dealt to ``dim``, ``i`` and ``j``."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})
        lists = Lists(held["id"].to_numpy(), _matrix(held["v"]))
        place, ids, scores, _ = lists.top(_matrix(asked["v"]), asked["id"].to_numpy(), k, asked["floor"].to_numpy())
        return pd.DataFrame({"query": asked["query"].to_numpy()[place], "query_id": asked["id"].to_numpy()[place], "vec_id": ids, "score": scores.astype(np.int64)})

    rows = rows.select(*[F.col(c).alias(c) for c in ("dim", "i", "j", "id", "v")])  # columns of their own, as both sides come from one frame
    return queries.groupBy("dim", "i", "j").cogroup(rows.groupBy("dim", "i", "j")).applyInPandas(run, "query long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: Column, k: int = 5, *, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, asked: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of ``vectors`` for each row where ``queries`` (an expression of ``key``) holds."""
    valid = pick(vectors, key, vector).select(F.col(key).alias(key), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), whole(F.col(vector)).alias("v")).where("v is not null")
    rows = checkpointed(valid.select("id", "v", F.size("v").alias("dim"), F.coalesce(queries, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("nr")))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("i_all"), F.ceil(F.count_if("asks") / asked).cast("int").alias("j_all"))
    sizes = F.broadcast(checkpointed(sizes.where("j_all > 0")))  # a row for each length of vectors
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("nr"), F.col(n)).cast("int")
    dealt = rows.join(sizes, "dim")
    held = dealt.select("dim", "id", "v", part("i_all").alias("i"), "j_all")
    wanted = dealt.where("asks").select("dim", F.col("nr").alias("query"), "id", "v", part("j_all").alias("j"), "i_all")
    # The first block tells each query a score that k others reach.
    first = _met(wanted.withColumn("i", F.lit(0)).withColumn("floor", F.lit(NO_FLOOR)), held.where("i = 0").select("dim", "id", "v", "i", every("j_all").alias("j")), k)
    first = checkpointed(first)
    floors = first.groupBy("query").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    wanted = wanted.join(floors.select("query", "floor"), "query", "left").select("dim", "query", "id", "v", "j", "i_all", F.coalesce("floor", F.lit(NO_FLOOR)).alias("floor"))
    others = _met(wanted.where("i_all > 1").select("dim", "query", "id", "v", "j", F.explode(F.sequence(F.lit(1), F.col("i_all") - 1)).alias("i"), "floor"), held.where("i > 0").select("dim", "id", "v", "i", every("j_all").alias("j")), k)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = first.unionByName(others).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op11_exact_topk(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM met)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
