"""Vectors laid out in fewer dimensions so that near ones stay near: a fuzzy graph of neighbours, and descent with negative samples.

Each vector has its ``neighbours`` nearest by cosine from the index of vectors. Its
distances become weights: the nearest one counts fully, the others fall off by a
width of its own, found by bisection so that all weights add up to log2 of their
number. A pair's weight is the fuzzy union of both directions. From principal
components, pairs are drawn together and random others pushed apart.

Descent is in blocks: in each round vectors are dealt to blocks anew; a task holds
the places of its block's vectors, their edges (``neighbours`` a vector at most) and
the places of those edges' other ends, moves its own vectors for some epochs, and
samples negatives from its block. No task holds more than ``BLOCK`` vectors or so.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.operators import index
from tarnwell.plans.checkpoints import Scratch

#: Vectors of a block, pushes for each pull, and how far one step may go.
BLOCK, PUSHES, CLIP = 8192, 5, 4.0


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b for which 1 / (1 + a x^2b) is nearest to: 1 up to ``min_dist``, falling exponentially beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x <= min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    error = lambda a, b: float(((1 / (1 + a * x ** (2 * b)) - y) ** 2).sum())
    a, b, step = 1.5, 0.9, 0.5
    while step > 1e-5:
        a, b, better = min(((p, q, error(p, q)) for p in (a - step, a, a + step) for q in (b - step, b, b + step) if p > 0 and q > 0), key=lambda t: t[2])
        if better >= error(a, b) - 1e-15:
            step /= 2
    return a, b


def fuzzy_edges(near: DataFrame, neighbours: int) -> DataFrame:
    """src, dst and weight (both directions of each pair that has one) from src, dst and sim of nearest neighbours."""
    rows = near.select("src", "dst", F.greatest(1 - F.col("sim"), F.lit(0.0)).alias("d"))
    lists = rows.groupBy("src").agg(F.sort_array(F.collect_list("d")).alias("ds"))  # ``neighbours`` values at most

    @F.pandas_udf("double")
    def width(ds: pd.Series) -> pd.Series:
        aim = math.log2(max(neighbours, 2))
        out = []
        for d in ds:
            d = np.asarray(d, float)
            over = np.maximum(d - d[0], 0)
            low, high = 0.0, max(1.0, float(d.max()) * 64)
            for _ in range(64):
                middle = (low + high) / 2
                low, high = (middle, high) if np.exp(-over / max(middle, 1e-12)).sum() < aim else (low, middle)
            out.append(max((low + high) / 2, 1e-3 * max(float(d.mean()), 1e-12)))
        return pd.Series(out, dtype=float)

    scale = lists.select("src", F.get("ds", F.lit(0)).alias("least"), width("ds").alias("width"))
    one = rows.join(scale, "src").select("src", "dst", F.exp(-F.greatest(F.col("d") - F.col("least"), F.lit(0.0)) / F.col("width")).alias("w"))
    both = one.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "w").groupBy("u", "v").agg(F.sum("w").alias("total"), F.product("w").alias("both"), F.count(F.lit(1)).alias("n"))
    pair = both.select("u", "v", F.when(F.col("n") == 2, F.col("total") - F.col("both")).otherwise(F.col("total")).alias("weight"))
    return pair.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight").unionByName(pair.select(F.col("v").alias("src"), F.col("u").alias("dst"), "weight"))


def _descend(own: pd.DataFrame, edges: pd.DataFrame, a: float, b: float, epochs: int, rate: tuple[float, float], seed: int) -> np.ndarray:
    """New places of a block's vectors."""
    place = np.stack([np.asarray(p, float) for p in own["point"]])
    draw = np.random.default_rng(seed)
    if not len(edges):
        return place
    row = {x: k for k, x in enumerate(own["id"])}
    src = edges["src"].map(row).to_numpy()
    there = edges["dst"].map(row)
    inside = there.notna().to_numpy()
    dst = there.fillna(0).to_numpy(int)
    far = np.stack([np.asarray(p, float) for p in edges["other"]])
    weight = edges["weight"].to_numpy(float)
    chance = weight / weight.max()
    for epoch in range(epochs):
        step = rate[0] + (rate[1] - rate[0]) * epoch / max(1, epochs)
        live = np.flatnonzero(draw.random(len(src)) < chance)
        s = src[live]
        other = np.where(inside[live, None], place[dst[live]], far[live])
        gap = place[s] - other
        square = (gap**2).sum(1)
        pull = np.where(square > 0, -2 * a * b * np.maximum(square, 1e-12) ** (b - 1) / (1 + a * square**b), 0)
        move = np.zeros_like(place)
        np.add.at(move, s, np.clip(pull[:, None] * gap, -CLIP, CLIP))
        for _ in range(PUSHES):
            random = draw.integers(0, len(place), len(s))
            gap = place[s] - place[random]
            square = (gap**2).sum(1)
            push = np.where(random == s, 0, 2 * b / ((0.001 + square) * (1 + a * square**b)))
            np.add.at(move, s, np.clip(push[:, None] * gap, -CLIP, CLIP))
        place += step * move / np.maximum(1, np.bincount(s, minlength=len(place)))[:, None] ** 0.5
    return place


def _block(a: float, b: float, epochs: int, rate: tuple[float, float], seed: int):
    def run(key, own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        own, edges = own.sort_values("id", kind="stable"), edges.sort_values(["src", "dst"], kind="stable")
        return pd.DataFrame({"id": own["id"].to_numpy(), "point": list(_descend(own, edges, a, b, epochs, rate, seed + int(key[0])))})

    return run


def layout(vectors: DataFrame, key: str = "uuid", vector: str = "embedding", *, dims: int = 50, neighbours: int = 30, min_dist: float = 0.0, rounds: int = 10, epochs: int = 20, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """``key`` and point: where each vector lies."""
    from tarnwell.operators.clusters import reduce_dimensions

    keep = Scratch(vectors.sparkSession)
    start = keep(reduce_dimensions(vectors, key, vector, dims).select(F.col(key).alias("id"), "point"))
    n = start.count()
    if n < 3:
        return start.select(F.col("id").alias(key), "point")
    most = start.agg(F.max(F.array_max(F.transform("point", F.abs)))).first()[0] or 1.0
    at = keep(start.select("id", F.transform("point", lambda x, i: x * (10 / most) + (F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(2001)) - 1000) / 1e7).alias("point")))
    k = min(neighbours, n - 1)
    made = index.build(vectors, key, vector)
    edges = fuzzy_edges(index.knn(made, k), k)
    # A vector takes its k strongest edges: none is left out by both of its ends but for pairs that are weak for both.
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    edges = keep(edges.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n"))
    a, b = curve(min_dist)
    kind, blocks = dict(at.dtypes)["id"], max(1, -(-n // block))
    for r in range(rounds):
        rate = (1 - r / rounds, 1 - (r + 1) / rounds)
        deal = lambda column, r=r: F.pmod(F.xxhash64(column, F.lit(r), F.lit(seed)), F.lit(blocks)).cast("int")
        lines = edges.join(at.select(F.col("id").alias("dst"), F.col("point").alias("other")), "dst").select("src", "dst", "weight", "other", deal("src").alias("block"))

        own = at.select(F.col("id").alias("id"), F.col("point").alias("point"), deal("id").alias("block"))
        new = own.groupBy("block").cogroup(lines.groupBy("block")).applyInPandas(_block(a, b, epochs, rate, seed + 1000 * r), f"id {kind}, point array<double>")
        before, at = keep.mark() - 1 if r else keep.mark(), keep(new)
        if r:
            keep.forget(before, at)
    return at.select(F.col("id").alias(key), "point")


def trustworthiness(before: np.ndarray, after: np.ndarray, k: int = 10) -> float:
    """How far the neighbours in ``after`` are neighbours in ``before`` (cosine): 1 if all are. For small checks, on the driver."""
    unit = before / np.maximum(np.linalg.norm(before, axis=1, keepdims=True), 1e-300)
    first = -(unit @ unit.T)
    second = ((after[:, None] - after[None]) ** 2).sum(2)
    n = len(before)
    np.fill_diagonal(first, -np.inf)
    np.fill_diagonal(second, np.inf)
    rank = np.argsort(np.argsort(first, axis=1, kind="stable"), axis=1)
    near = np.argsort(second, axis=1, kind="stable")[:, :k]
    over = np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()
    return float(1 - 2 * over / (n * k * (2 * n - 3 * k - 1)))
