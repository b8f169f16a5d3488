"""Density clusters of vectors: fewer dimensions, mutual reachability, a spanning tree, stable clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.operators import umap
from tarnwell.operators.graph import connected, numbered
from tarnwell.plans.checkpoints import Scratch, checkpointed

def reduce_dimensions(vectors: DataFrame, key: str = "uuid", vector: str = "embedding", dims: int = 50) -> DataFrame:
    """``key`` and the first principal components of the unit vectors, computed by Spark."""
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    rows = Normalizer(inputCol="raw", outputCol="unit").transform(rows)
    some = rows.select("unit").take(2)
    if len(some) < 2:  # no components of one
        return vectors.select(key, F.slice(F.col(vector).cast("array<double>"), 1, dims).alias("point"))
    model = PCA(k=min(dims, len(some[0]["unit"])), inputCol="unit", outputCol="pc").fit(rows)
    return model.transform(rows).select(key, vector_to_array("pc").alias("point"))


def spanning_tree(points: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of the least spanning tree under mutual reachability, by growing one tree; a row of distances at a time."""
    n = len(points)
    best, source, open_ = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    here, out = 0, []
    for _ in range(n - 1):
        open_[here] = False
        reach = np.maximum(np.maximum(np.sqrt(((points - points[here]) ** 2).sum(1)), core), core[here])
        closer = open_ & (reach < best)
        best[closer], source[closer] = reach[closer], here
        here = int(np.argmin(np.where(open_, best, np.inf)))
        out.append((float(best[here]), int(source[here]), here))
    return sorted(out)


def labels_of_tree(n: int, edges: list[tuple[float, int, int]], min_size: int) -> np.ndarray:
    """Labels of places 0 to n - 1 from the edges (weight, place, place) of their least spanning tree, by weight: stable clusters
    by their smallest member, -1 is noise. Time and memory grow with n alone."""
    if n < max(2, min_size):
        return np.full(n, -1)
    # The single-linkage tree: node n + k joins two at the k-th edge.
    parent, low = list(range(2 * n - 1)), [*range(n), *[0] * (n - 1)]
    size, left, right, height = [1] * n + [0] * (n - 1), {}, {}, {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (d, a, b) in enumerate(edges):
        a, b, new = find(a), find(b), n + k
        parent[a] = parent[b] = new
        left[new], right[new], height[new], size[new], low[new] = a, b, d, size[a] + size[b], min(low[a], low[b])

    def leaves(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += [left[x], right[x]]
        return out

    # Condensed: a cluster lives until it splits into two of min_size or more.
    clusters: list[dict] = []
    todo = [(2 * n - 2, 0.0, None)]
    while todo:
        node, birth, above = todo.pop()
        me = len(clusters)
        clusters.append({"node": node, "stability": 0.0, "below": []})
        if above is not None:
            clusters[above]["below"].append(me)
        while node >= n:
            density = 1 / max(height[node], 1e-12)
            a, b = left[node], right[node]
            big = [x for x in (a, b) if size[x] >= min_size]
            if len(big) == 2:
                clusters[me]["stability"] += (density - birth) * size[node]
                todo += [(a, density, me), (b, density, me)]
                break
            lost = size[node] - (size[big[0]] if big else 0)
            clusters[me]["stability"] += (density - birth) * lost
            if not big:
                break
            node = big[0]
    value, better = {}, {}
    for k in reversed(range(len(clusters))):
        below = sum(value[x] for x in clusters[k]["below"])
        own = clusters[k]["stability"] if k else -1.0  # all points are no cluster
        better[k] = bool(clusters[k]["below"]) and below >= own
        value[k] = below if better[k] else max(own, 0.0)
    chosen, todo = [], [0]
    while todo:
        k = todo.pop()
        if better[k] or not k:
            todo += clusters[k]["below"]
        else:
            chosen.append(clusters[k]["node"])
    labels = np.full(n, -1)
    for label, node in enumerate(sorted(chosen, key=low.__getitem__)):
        labels[leaves(node)] = label
    return labels


def hdbscan(points: np.ndarray, min_size: int = 20, min_samples: int = 5) -> np.ndarray:
    """Labels from 0 by size of the smallest member; -1 is noise."""
    n = len(points)
    if n < max(2, min_size):
        return np.full(n, -1)
    core = np.array([np.partition(np.sqrt(((points - p) ** 2).sum(1)), min(min_samples, n - 1))[min(min_samples, n - 1)] for p in points])
    return labels_of_tree(n, spanning_tree(points, core), min_size)


def _beside(points: DataFrame, blocks: int, run, schema: str) -> DataFrame:
    """``run`` of each pair of blocks of ``points`` (nr, ...), each an executor's: no rows are made for pairs of points."""
    held = points.withColumn("i", F.pmod(F.xxhash64("nr"), F.lit(blocks)).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = held.withColumn("j", all_blocks)
    right = held.withColumnRenamed("i", "j").withColumn("i", all_blocks)
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, schema)


def _distances(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    x, y = (np.stack([np.asarray(p, float) for p in t["point"]]) for t in (a, b))
    return np.sqrt(np.maximum(np.stack([((y - p) ** 2).sum(1) for p in x]), 0))


def reachability_tree(points: DataFrame, min_samples: int = 5, block: int = 1024) -> DataFrame:
    """weight, low and high of the least spanning tree of ``points`` (nr, point) under mutual reachability: exact, on executors.

    Every round each component takes its least edge to another one (Boruvka),
    found by blocks of points beside blocks of points; equal edges are told apart
    by their ends, so that no circle closes. The work of a round is that of all
    pairs; what is kept is one edge a component, of which there are half as many
    each round at most.
    """
    n = points.count()
    if n < 2:
        return points.sparkSession.createDataFrame([], "weight double, low long, high long")
    blocks, near = max(1, -(-n // block)), min(min_samples, n - 1)

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"nr": [], "d": []})
        d = _distances(a, b)
        d[a["nr"].to_numpy()[:, None] == b["nr"].to_numpy()[None, :]] = np.inf
        k = min(near, d.shape[1])
        best = np.partition(d, k - 1, axis=1)[:, :k]
        out = pd.DataFrame({"nr": np.repeat(a["nr"].to_numpy(), k), "d": best.ravel()})
        return out[np.isfinite(out["d"])]

    told = _beside(points.select("nr", "point"), blocks, nearest, "nr long, d double")
    core = told.groupBy("nr").agg(F.get(F.sort_array(F.collect_list("d")), F.lit(near - 1)).alias("core"))  # a few values a block
    state = checkpointed(points.select("nr", "point").join(core, "nr").withColumn("component", F.col("nr")))

    def least(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"component": [], "weight": [], "low": [], "high": []})
        if not len(a) or not len(b):
            return none
        mine, other = a["component"].to_numpy(), b["component"].to_numpy()
        if mine.min() == mine.max() == other.min() == other.max():
            return none
        weight = np.maximum(np.maximum(_distances(a, b), a["core"].to_numpy()[:, None]), b["core"].to_numpy()[None, :])
        weight[mine[:, None] == other[None, :]] = np.inf
        u, v = a["nr"].to_numpy()[:, None], b["nr"].to_numpy()[None, :]
        low, high = np.minimum(u, v), np.maximum(u, v)
        least_of = weight.min(1)
        tied = weight == least_of[:, None]
        low_of = np.where(tied, low, np.iinfo(np.int64).max).min(1)
        high_of = np.where(tied & (low == low_of[:, None]), high, np.iinfo(np.int64).max).min(1)
        rows = pd.DataFrame({"component": mine, "weight": least_of, "low": low_of, "high": high_of})
        return rows[np.isfinite(least_of)].sort_values(["component", "weight", "low", "high"]).drop_duplicates("component")

    tree = None
    while True:
        found = _beside(state, blocks, least, "component long, weight double, low long, high long")
        best = found.groupBy("component").agg(F.min(F.struct("weight", "low", "high")).alias("e")).select("e.weight", "e.low", "e.high").distinct()
        best = checkpointed(best)
        if not best.limit(1).count():
            return tree if tree is not None else best
        tree = checkpointed(best if tree is None else tree.unionByName(best))
        of = state.select("nr", "component")
        joined = best.join(of.select(F.col("nr").alias("low"), F.col("component").alias("src")), "low").join(of.select(F.col("nr").alias("high"), F.col("component").alias("dst")), "high")
        merged = connected(joined.select("src", "dst"), of.select(F.col("component").alias("id")).distinct()).select(F.col("id").alias("component"), F.col("component").alias("to"))
        state = checkpointed(state.join(merged, "component").select("nr", "point", "core", F.col("to").alias("component")))


#: Edges of a band of the tree. A task holds a connected piece of one band at most.
BAND = 100_000
_JOINED = "kind string, a long, b long, size long, cluster long, mass double, below double, split boolean"


def _joined(min_size: int):
    """A piece of a band: its edges join components, in order. ``map`` rows say where a component (a) went (b) and which cluster its
    points joined there, ``comp`` rows what is left, ``node`` rows which clusters (a) ended in which other (b), and whether what is
    below them is worth more."""

    def run(edges: pd.DataFrame, comps: pd.DataFrame) -> pd.DataFrame:
        names = comps["comp"].tolist()
        at = {c: k for k, c in enumerate(names)}
        size, mass, below = comps["size"].tolist(), comps["mass"].tolist(), comps["below"].tolist()
        cluster = [None if pd.isna(c) else int(c) for c in comps["cluster"]]
        split, low, parent = comps["split"].tolist(), list(names), list(range(len(names)))
        loose: list[list[int]] = [[k] if cluster[k] is None else [] for k in range(len(names))]  # components that are in no cluster yet
        entered: dict[int, int] = {}
        nodes = []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for edge, u, v, weight in edges.sort_values("edge")[["edge", "u", "v", "weight"]].itertuples(index=False):
            x, y = find(at[u]), find(at[v])
            if len(loose[x]) < len(loose[y]):
                x, y = y, x
            density, both = 1 / max(weight, 1e-12), size[x] + size[y]
            inside = [z for z in (x, y) if cluster[z] is not None]
            loose[x] += loose[y]
            if len(inside) == 2:
                value = 0.0
                for z in inside:
                    own = mass[z] - density * size[z]
                    better = split[z] and below[z] >= own
                    value += below[z] if better else max(own, 0.0)
                    nodes.append((cluster[z], edge, better))
                cluster[x], mass[x], below[x], split[x] = edge, density * both, value, True
            elif inside:
                z, other = inside[0], y if inside[0] == x else x
                cluster[x], mass[x], below[x], split[x] = cluster[z], mass[z] + density * size[other], below[z], split[z]
            elif both >= min_size:
                cluster[x], mass[x], below[x], split[x] = edge, density * both, 0.0, False
            if cluster[x] is not None and loose[x]:
                entered |= dict.fromkeys(loose[x], cluster[x])
                loose[x] = []
            parent[y], size[x], low[x] = x, both, min(low[x], low[y])
        roots = {find(k) for k in range(len(names))}
        rows = [("map", names[k], low[find(k)], None, entered.get(k), None, None, None) for k in range(len(names))]
        rows += [("comp", low[r], None, size[r], cluster[r], mass[r], below[r], bool(split[r])) for r in roots]
        rows += [("node", a, b, None, None, None, None, better) for a, b, better in nodes]
        out = pd.DataFrame(rows, columns=["kind", "a", "b", "size", "cluster", "mass", "below", "split"])
        return out.astype({"b": "Int64", "size": "Int64", "cluster": "Int64", "split": "boolean"})

    return run


def tree_labels(tree: DataFrame, points: DataFrame, min_size: int, band: int = BAND) -> DataFrame:
    """nr and cluster_id, as ``labels_of_tree`` gives them, of ``points`` (nr) from the edges (weight, low, high) of their spanning tree.

    Edges are taken in bands of rising weight. What a band connects is a piece, and
    pieces are independent: each is joined edge by edge in a task of its own, upwards,
    so that a cluster's stability is known when it ends in another one. Between bands
    only components (size, cluster, sums) and each point's component are kept. Which
    clusters are chosen is then seen from above, twice as far in each round.
    """
    keep = Scratch(points.sparkSession)
    edges = keep(numbered(tree, F.asc("weight"), F.asc("low"), F.asc("high"), name="edge"))
    n = edges.count()
    place = keep(points.select("nr", F.col("nr").alias("comp"), F.lit(None).cast("long").alias("cluster")))
    fresh = (F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("cluster"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("below"), F.lit(False).alias("split"))
    comps = keep(points.select(F.col("nr").alias("comp"), *fresh))
    nodes = None
    for first in range(0, n, band):
        mark = keep.mark()
        at = lambda side, name: place.select(F.col("nr").alias(side), F.col("comp").alias(name))  # noqa: B023, E731
        here = keep(edges.where((F.col("edge") >= first) & (F.col("edge") < first + band)).join(at("low", "u"), "low").join(at("high", "v"), "high").select("edge", "u", "v", "weight"))
        ends = here.select(F.col("u").alias("id")).union(here.select(F.col("v").alias("id"))).distinct()
        pieces = keep(connected(here.select(F.col("u").alias("src"), F.col("v").alias("dst")), ends))
        lines = here.join(pieces.select(F.col("id").alias("u"), F.col("component").alias("piece")), "u").select("piece", "edge", "u", "v", "weight")
        held = comps.join(pieces.select(F.col("id").alias("comp"), F.col("component").alias("piece")), "comp").select("piece", "comp", "size", "cluster", "mass", "below", "split")
        made = keep(lines.groupBy("piece").cogroup(held.groupBy("piece")).applyInPandas(_joined(min_size), _JOINED))
        went = made.where("kind = 'map'").select(F.col("a").alias("comp"), F.col("b").alias("to"), F.col("cluster").alias("entered"))
        place = keep(place.join(went, "comp", "left").select("nr", F.coalesce("to", "comp").alias("comp"), F.coalesce("cluster", "entered").alias("cluster")))
        left = made.where("kind = 'comp'").select(F.col("a").alias("comp"), "size", "cluster", "mass", "below", "split")
        comps = keep(comps.join(went.select("comp"), "comp", "left_anti").unionByName(left))
        ended = made.where("kind = 'node'").select(F.col("a").alias("id"), F.col("b").alias("up"), F.col("split").alias("better"))
        nodes = keep(ended if nodes is None else nodes.unionByName(ended))
        keep.forget(mark, place, comps, nodes)
    if nodes is None:
        return points.select("nr", F.lit(-1).alias("cluster_id"))
    # The topmost cluster on the way up that is worth more than what is below it; the last one, of all points, is none.
    seen = keep(nodes.select("id", F.col("up").alias("to"), F.when(~F.col("better"), F.col("id")).alias("pick")))
    while True:
        up = seen.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("pick").alias("above"))
        seen = keep(seen.join(up, "to", "left").select("id", F.col("next").alias("to"), F.coalesce("above", "pick").alias("pick")))
        if not seen.where("to is not null").limit(1).count():
            break
    picked = keep(place.join(seen.select(F.col("id").alias("cluster"), "pick"), "cluster", "left").select("nr", "pick"))
    firsts = picked.where("pick is not null").groupBy("pick").agg(F.min("nr").alias("first"))
    named = numbered(firsts, F.asc("first"), name="cluster_id").select("pick", "cluster_id")
    return picked.join(named, "pick", "left").select("nr", F.coalesce("cluster_id", F.lit(-1)).cast("int").alias("cluster_id"))


def message_clusters(embeddings: DataFrame, *, dims: int = 50, min_size: int = 20, min_samples: int = 5, plane: bool = False, components: bool = False, neighbours: int = 30, rounds: int = 10, band: int = BAND, block: int = 1024) -> DataFrame:
    """uuid, cluster_id, x, y and is_noise, of all vectors: laid out so that neighbours stay near (or by principal ``components``),
    the spanning tree of all, and what ``tree_labels`` reads off it."""
    placed = reduce_dimensions(embeddings, dims=dims) if components else umap.layout(embeddings, dims=dims, neighbours=neighbours, rounds=rounds)
    points = checkpointed(numbered(placed, F.asc("uuid")))
    labels = tree_labels(reachability_tree(points, min_samples, block), points, min_size, band)
    at = lambda k: (F.get("point", F.lit(k)) if plane else F.lit(None)).cast("float")
    return points.join(labels, "nr").select("uuid", "cluster_id", at(0).alias("x"), at(1).alias("y"), (F.col("cluster_id") == -1).alias("is_noise"))
