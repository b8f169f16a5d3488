"""An index of vectors by lists: near neighbours without comparing all pairs.

Centres are learned by k-means from a bounded sample; every vector is kept in the
list of its nearest centre. A query reads the ``probes`` lists whose centres are
nearest to it. Neighbours are by cosine, as in ``vectors.knn``, which is the exact
way and what recall is measured against; with all lists probed both are the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import cosine
from tarnwell.operators.vectors import unit
from tarnwell.plans.checkpoints import checkpointed

#: Vectors that centres are learned from at most, and rows of a task's block of a list.
SAMPLE, BLOCK = 20_000, 2048


@dataclass(frozen=True)
class Index:
    """``rows``: id, v (unit vector) and list of every vector; ``centres``: one row a list."""

    rows: DataFrame
    centres: np.ndarray

    def nearest(self, vector, probes: int) -> list[int]:
        q = np.asarray(vector, float)
        return np.argsort(-(self.centres @ (q / max(np.linalg.norm(q), 1e-300))), kind="stable")[:probes].tolist()


def _lists(centres: np.ndarray, probes: int):
    """The nearest lists of each vector, a batch at a time."""

    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        near = np.stack([np.asarray(v, float) for v in vectors]) @ centres.T
        return pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return run


def build(vectors: DataFrame, key: str = "uuid", vector: str = "embedding", *, lists: int | None = None, sample: int = SAMPLE, seed: int = 42) -> Index:
    """An index of all rows of ``vectors``; by default about as many lists as the root of their number."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(F.col(key).alias("id"), unit(F.col(vector).cast("array<double>")).alias("v"))
    n = rows.count()
    if not n:
        return Index(checkpointed(rows.withColumn("list", F.lit(0))), np.zeros((1, 1)))
    chosen = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select(array_to_vector("v").alias("features"))
    k = max(1, min(lists or math.isqrt(n), n, sample))
    centres = np.array(KMeans(k=k, seed=seed, maxIter=10).fit(chosen).clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return Index(checkpointed(rows.withColumn("list", F.get(_lists(centres, 1)("v"), F.lit(0)))), centres)


def probes_for(index: Index, k: int, recall: float = 0.95, queries: int = 200, seed: int = 7) -> int:
    """The fewest lists to read for so much recall, measured: for some rows, compared with all others, how far down in the
    order of their lists the true neighbours are."""
    asked = index.rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(queries).select("id", "v").toPandas()
    if len(asked) < 2:
        return 1
    ids, matrix = asked["id"].to_numpy(), np.stack([np.asarray(v, float) for v in asked["v"]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                sim = np.round(matrix @ np.stack([np.asarray(v, float) for v in frame["v"]]).T, 12)
                sim[ids[:, None] == frame["id"].to_numpy()[None, :]] = -np.inf
                best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"q": np.repeat(np.arange(len(ids)), best.shape[1]), "sim": np.take_along_axis(sim, best, 1).ravel(), "list": frame["list"].to_numpy()[best.ravel()]})

    w = Window.partitionBy("q").orderBy(F.desc("sim"), "list")
    true = index.rows.mapInPandas(run, "q int, sim double, list int").withColumn("n", F.row_number().over(w)).where((F.col("n") <= k) & (F.col("sim") > -2)).toPandas()
    order = np.argsort(-(matrix @ index.centres.T), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)[true["q"].to_numpy(), true["list"].to_numpy()]
    return int(np.sort(rank)[min(len(rank) - 1, math.ceil(recall * len(rank)) - 1)]) + 1 if len(rank) else 1


def search(index: Index, query: list[float], k: int = 10, probes: int = 8) -> DataFrame:
    """id and similarity of the k nearest in the lists that are read."""
    held = index.rows.where(F.col("list").isin(index.nearest(query, probes)))
    return held.select("id", cosine(F.col("v"), F.lit([float(x) for x in query])).alias("similarity")).orderBy(F.desc_nulls_last("similarity"), "id").limit(k)


def knn(index: Index, k: int, probes: int | None = None) -> DataFrame:
    """src, dst, sim of each row's k nearest in the lists that it reads (without ``probes``: as many as ``probes_for`` says), ties to the smaller id.

    A list is dealt to blocks of rows and of queries, so that one that holds a
    third of all vectors is many tasks.
    """
    kind = dict(index.rows.dtypes)["id"]
    probes = probes or probes_for(index, k, 0.97)
    asked = index.rows.select("id", "v", F.explode(_lists(index.centres, probes)("v")).alias("list"))
    size = index.rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("i_all"))
    size = size.join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("j_all")), "list")
    size = F.broadcast(checkpointed(size)) if len(index.centres) <= 1_000_000 else size
    part = lambda own, other: (F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    mine, every = part("i_all", "j_all")
    rows = index.rows.join(size, "list").select(F.col("id").alias("id"), F.col("v").alias("v"), F.col("list").alias("list"), mine.alias("i"), every.alias("j"))  # columns of their own, as both sides come from one frame
    mine, every = part("j_all", "i_all")
    queries = asked.join(size, "list").select("id", "v", "list", mine.alias("j"), every.alias("i"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"src": [], "dst": [], "sim": []})
        b = b.sort_values("id", kind="stable")
        ids = b["id"].to_numpy()
        sim = np.round(np.stack([np.asarray(v, float) for v in a["v"]]) @ np.stack([np.asarray(v, float) for v in b["v"]]).T, 12)
        sim[a["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(sim, best, 1).ravel()
        out = pd.DataFrame({"src": np.repeat(a["id"].to_numpy(), best.shape[1]), "dst": ids[best.ravel()], "sim": value})
        return out[np.isfinite(value)]

    found = queries.groupBy("list", "i", "j").cogroup(rows.groupBy("list", "i", "j")).applyInPandas(run, f"src {kind}, dst {kind}, sim double")
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
