"""Similarity graphs of sessions and their communities."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import dot
from tarnwell.operators.vectors import knn
from tarnwell.plans.checkpoints import checkpointed


def mutual_knn(vectors: DataFrame, key: str, vector: str, k: int = 15, floor: float = 0.0, indexed: bool = False) -> DataFrame:
    """src < dst and weight of the pairs that are among each other's k nearest, from ``floor`` up: exact, or by an index of measured recall."""
    if not indexed:
        near = knn(vectors, key, vector, k)
    else:
        from tarnwell.operators import index

        near = index.knn(index.build(vectors, key, vector), k)
    one = near.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "sim")
    both = one.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.max("sim").alias("weight"))
    return both.where((F.col("n") == 2) & (F.col("weight") >= floor)).select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight")


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and component (its smallest id) of each node."""
    both = checkpointed(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    state = checkpointed(nodes.select("id", F.col("id").alias("component")))
    while True:
        low = both.join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("low"))
        new = state.join(low, "id", "left").select("id", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("component").alias("was"))
        jump = state.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = checkpointed(new.join(jump, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component"), "was"))
        if not new.where("component <> was").limit(1).count():
            return new.select("id", "component")
        state = new.select("id", "component")


def _pieces(group: list[int], links: list[dict[int, float]]) -> list[int]:
    """Communities split into the pieces that their own edges connect, named by their first nodes: a piece on its own never has less quality."""
    out = [-1] * len(group)
    for start in range(len(group)):
        if out[start] < 0:
            out[start], todo = start, [start]
            while todo:
                i = todo.pop()
                for j in links[i]:
                    if out[j] < 0 and group[j] == group[i]:
                        out[j] = start
                        todo.append(j)
    return out


def _moved(links: list[dict[int, float]], size: list[int], group: list[int], gamma: float, draw: random.Random, passes: int) -> None:
    """Nodes go, one after another, to the community of the largest gain, or to one of their own; ``group`` is changed."""
    n = len(size)
    mass = [0] * n
    for i, c in enumerate(group):
        mass[c] += size[i]
    free = [c for c in range(n) if not mass[c]]
    for _ in range(passes):
        changed, order = False, list(range(n))
        draw.shuffle(order)
        for i in order:
            to: dict[int, float] = defaultdict(float)
            for j, w in links[i].items():
                to[group[j]] += w
            home = group[i]
            mass[home] -= size[i]
            best, top = home, to.get(home, 0.0) - gamma * size[i] * mass[home]
            for c in sorted(to):
                gain = to[c] - gamma * size[i] * mass[c]
                if gain > top + 1e-12:
                    best, top = c, gain
            if not mass[home]:
                free.append(home)
            if top < -1e-12:
                best = free[-1]
            if free and free[-1] == best:
                free.pop()
            group[i] = best
            mass[best] += size[i]
            changed |= best != home
        if not changed:
            return


def _merged(links: list[dict[int, float]], size: list[int], group: list[int], gamma: float, draw: random.Random) -> list[int]:
    """Refinement: inside each community single nodes merge anew, along gains and into well connected pieces alone."""
    n = len(size)
    whole: dict[int, int] = defaultdict(int)
    for i, c in enumerate(group):
        whole[c] += size[i]
    inner = [sum(w for j, w in links[i].items() if group[j] == group[i]) for i in range(n)]
    piece, mass, cut = list(range(n)), list(size), list(inner)  # cut: what a piece has to the rest of its community
    single = [True] * n
    order = list(range(n))
    draw.shuffle(order)
    for i in order:
        total = whole[group[i]]
        if not single[i] or inner[i] < gamma * size[i] * (total - size[i]):
            continue
        to: dict[int, float] = defaultdict(float)
        for j, w in links[i].items():
            if group[j] == group[i]:
                to[piece[j]] += w
        best, top = i, 0.0
        for c in sorted(to):
            gain = to[c] - gamma * size[i] * mass[c]
            if gain > top + 1e-12 and cut[c] >= gamma * mass[c] * (total - mass[c]):
                best, top = c, gain
        if best != i:
            single[best] = single[i] = False
            piece[i] = best
            mass[best] += size[i]
            cut[best] += inner[i] - 2 * to[best]
    return piece


def cpm(nodes: list, edges: list[tuple], gamma: float, seed: int = 42, passes: int = 20, sizes: list[int] | None = None, start: list | None = None) -> tuple[dict, float]:
    """Communities of a graph that one task holds, by the constant Potts model: moves, refinement, aggregation, seeded. Labels and quality.

    ``sizes``: how many nodes each one stands for; ``start``: the communities to begin with.
    """
    index = {x: i for i, x in enumerate(nodes)}
    size = list(sizes) if sizes else [1] * len(nodes)
    links: list[dict[int, float]] = [defaultdict(float) for _ in nodes]
    for a, b, w in edges:
        if a != b:
            links[index[a]][index[b]] += w
            links[index[b]][index[a]] += w
    all_links, all_size = links, size
    at, draw = list(range(len(nodes))), random.Random(seed)
    names = {c: i for i, c in reversed(list(enumerate(start)))} if start else {}
    group = [names[c] for c in start] if start else list(range(len(nodes)))
    while True:
        _moved(links, size, group, gamma, draw, passes)
        piece = _merged(links, size, group, gamma, draw)
        number = {c: k for k, c in enumerate(dict.fromkeys(piece))}
        if len(number) == len(size):
            break
        at = [number[piece[x]] for x in at]
        n = len(number)
        new_size, new_links, new_group = [0] * n, [defaultdict(float) for _ in range(n)], [-1] * n
        first: dict[int, int] = {}
        for i, c in enumerate(piece):
            k = number[c]
            new_size[k] += size[i]
            new_group[k] = first.setdefault(group[i], k)
            for j, w in links[i].items():
                if number[piece[j]] != k:
                    new_links[k][number[piece[j]]] += w
        size, links, group = new_size, new_links, new_group
    found = _pieces([group[x] for x in at], all_links)
    mass: dict[int, int] = defaultdict(int)
    for i, c in enumerate(found):
        mass[c] += all_size[i]
    inner = sum(w for i in range(len(nodes)) for j, w in all_links[i].items() if found[i] == found[j]) / 2
    return {x: found[i] for x, i in index.items()}, inner - gamma * sum(s * (s - 1) / 2 for s in mass.values())


def communities_by_component(edges: DataFrame, nodes: DataFrame, gamma: float, seed: int = 42) -> DataFrame:
    """id and community (its smallest id) of each node."""
    from tarnwell.operators import leiden

    return leiden.communities(edges, nodes, [gamma], seed).select("id", "community")


def resolution_profile(edges: DataFrame, nodes: DataFrame, low: float = 0.05, high: float = 0.95, steps: int = 19, halvings: int = 4, seed: int = 42) -> list[dict]:
    """Number of communities and quality by resolution, equal partitions merged; how long each lasts, in 10^-4.

    All resolutions of a round are found together; only two numbers of each reach
    the driver. Where the number changes between two resolutions, the interval is
    halved ``halvings`` times to find where.
    """
    from tarnwell.operators import leiden

    edges, nodes = checkpointed(edges), checkpointed(nodes.select("id"))

    def at(gammas: list[float]) -> dict[float, tuple[int, float]]:
        if not gammas:
            return {}
        found = leiden.quality(edges, leiden.communities(edges, nodes, gammas, seed)).collect()
        told = {float(r["g"]): (int(r["n"]), float(r["quality"])) for r in found}
        return {float(g): told.get(float(g), (0, 0.0)) for g in gammas}

    known = at([round(low + (high - low) * i / (steps - 1), 4) for i in range(steps)])
    for _ in range(halvings):
        grid = sorted(known)
        known |= at([round((a + b) / 2, 4) for a, b in zip(grid[:-1], grid[1:], strict=True) if known[a][0] != known[b][0]])
    runs: list[dict] = []
    for g in sorted(known):
        n, quality = known[g]
        if not runs or runs[-1]["n_communities"] != n:
            runs.append({"gamma": g, "n_communities": n, "quality": quality})
    ends = [r["gamma"] for r in runs[1:]] + [high]
    return [r | {"plateau_length": round((e - r["gamma"]) * 1e4)} for r, e in zip(runs, ends, strict=True)]


#: What each zoom puts first in an order of the profile: (what a resolution is worth, whether single communities count).
ZOOMS = {"medium": (lambda r: r["plateau_length"], True), "fine": (lambda r: r["n_communities"], True), "coarse": (lambda r: -r["n_communities"], False)}


def pick_zoom(profile: list[dict], zoom: str = "medium") -> float:
    """The resolution of the longest plateau (medium), of the most communities (fine), or of the fewest that are two or more
    (coarse; the middle one if there is none); ties to the smallest resolution."""
    if not profile or zoom not in ZOOMS:
        raise ValueError("an empty profile" if not profile else zoom)
    worth, single = ZOOMS[zoom]
    table = sorted((-worth(r), r["gamma"]) for r in profile if single or r["n_communities"] > 1)
    return table[0][1] if table else sorted(r["gamma"] for r in profile)[len(profile) // 2]


def disconnected(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Communities (id, community) whose members' own edges leave them in several pieces."""
    m = members.select("id", "community")
    inner = edges.join(m.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst").where("a = b")
    pieces = connected(inner.select("src", "dst"), m.select("id")).join(m, "id")
    return pieces.groupBy("community").agg(F.count_distinct("component").alias("pieces")).where("pieces > 1")


def medoids(vectors: DataFrame, members: DataFrame, key: str = "session_id", vector: str = "centroid") -> DataFrame:
    """community, medoid (most similar to the others on average, ties to the smallest) and coherence (mean similarity of pairs).

    For unit vectors the sum of similarities to all members is one product with
    the members' sum, so that no pairs are made; a single member has coherence 1.
    """
    from tarnwell.operators.vectors import mean_vector, unit

    rows = vectors.select(F.col(key).alias("id"), unit(F.col(vector).cast("array<double>")).alias("v")).join(members.select("id", "community"), "id")
    whole = rows.groupBy("community").agg(F.count(F.lit(1)).alias("n"), mean_vector("v").alias("mean"))
    scored = rows.join(whole, "community").select("community", "id", "n", (dot(F.col("v"), F.col("mean")) * F.col("n")).alias("all"), dot(F.col("v"), F.col("v")).alias("self"))
    others = F.round((F.col("all") - F.col("self")) / F.greatest(F.col("n") - 1, F.lit(1)), 12)
    scored = scored.withColumn("others", F.when(F.col("n") == 1, F.lit(1.0)).otherwise(others))
    return scored.groupBy("community").agg(F.min_by("id", F.struct(-F.col("others"), F.col("id"))).alias("medoid"), F.avg("others").alias("coherence"), F.max("n").alias("size"))


def numbered(rows: DataFrame, *order, name: str = "nr") -> DataFrame:
    """``rows`` with their place from 0 in an order of all, without one task that has to hold them: places within sorted parts, plus what is before each part."""
    held = checkpointed(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row for each part
    return held.join(F.broadcast(before), "_part").withColumn(name, within + F.col("_before")).drop("_part", "_before")


def relabel(members: DataFrame, min_size: int = 2) -> DataFrame:
    """id, community_id (0 for the largest, ties to the smallest member; -1 below ``min_size``) and size (0 below)."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    real = numbered(sizes.where(F.col("n") >= min_size), F.desc("n"), F.asc("first"), name="community_id")
    out = members.join(real.select("community", "n", "community_id"), "community", "left")
    return out.select("id", F.coalesce("community_id", F.lit(-1)).cast("int").alias("community_id"), F.coalesce("n", F.lit(0)).cast("int").alias("size"))


def session_communities(centroids: DataFrame, *, gamma: float | None = None, zoom: str = "medium", k: int = 15, floor: float = 0.0, min_size: int = 2, seed: int = 42, indexed: bool = False) -> tuple[DataFrame, list[dict]]:
    """The table of communities and the profile (empty where ``gamma`` is given). ``indexed``: neighbours by an index, for many sessions."""
    nodes = centroids.select(F.col("session_id").alias("id"))
    edges = checkpointed(mutual_knn(centroids, "session_id", "centroid", k, floor, indexed))
    profile: list[dict] = []
    if gamma is None:
        profile = resolution_profile(edges, nodes, seed=seed)
        gamma = pick_zoom(profile, zoom)
    members = checkpointed(communities_by_component(edges, nodes, gamma, seed))
    labelled = relabel(members, min_size)
    about = medoids(centroids, members)
    out = members.join(labelled, "id").join(about.drop("size"), "community")
    real = F.col("community_id") >= 0
    table = out.select(
        F.col("id").alias("session_id"), "community_id", "size", (real & (F.col("id") == F.col("medoid"))).alias("is_medoid"), F.when(real, F.col("coherence")).otherwise(0.0).cast("float").alias("coherence"), F.lit(gamma).cast("float").alias("gamma_used")
    )
    return table, profile
