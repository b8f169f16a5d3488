"""Communities by rounds of joins against the same phases in turn, and labels of a tree in bands against one pass over it."""

import random
from collections import Counter

import numpy as np
import pytest

from tarnwell.operators import clusters, graph, leiden, stamps


def planted(n, groups, seed=1):
    """One connected graph: groups that are dense inside, with weaker edges between them."""
    draw, weight = random.Random(seed), {}
    for c in range(groups):
        own = [i for i in range(n) if i % groups == c]
        for i in own:
            for j in draw.sample(own, 6):
                if i != j:
                    weight[min(i, j), max(i, j)] = round(draw.uniform(0.5, 1), 3)
    for i in range(n):
        j = draw.randrange(n)
        if i != j:
            weight.setdefault((min(i, j), max(i, j)), round(draw.uniform(0.1, 0.5), 3))
    return [(a, b, w) for (a, b), w in weight.items()]


def worth(edges, label, gamma):
    return sum(w for a, b, w in edges if label[a] == label[b]) - gamma * sum(n * (n - 1) / 2 for n in Counter(label.values()).values())


def test_in_turn():
    edges = planted(240, 8)
    for gamma in (0.02, 0.1, 0.5):
        label, quality = graph.cpm(list(range(240)), edges, gamma)
        assert quality == pytest.approx(worth(edges, label, gamma))
        start = [i % 8 for i in range(240)]
        assert graph.cpm(list(range(240)), edges, gamma, start=start)[1] >= worth(edges, dict(enumerate(start)), gamma) - 1e-9
    assert len(set(graph.cpm(list(range(240)), edges, 0.1)[0].values())) == 8
    # nodes that stand for several are worth as much as the several
    both, quality = graph.cpm([0, 1, 2], [(0, 1, 5.0), (1, 2, 1.0)], 1.0, sizes=[2, 2, 1])
    assert both[0] == both[1] != both[2]


@pytest.mark.parametrize("gammas", [[0.1]])
def test_one_component_in_rounds(spark, gammas):
    edges = planted(160, 8)
    frame = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}", w) for a, b, w in edges], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(160)] + [("alone",)], "id string")
    found = leiden.communities(frame, nodes, gammas, small=60).cache()
    rows = found.collect()
    told = {r["g"]: r for r in leiden.quality(frame, found).collect()}
    for gamma in gammas:
        label = {r["id"]: r["community"] for r in rows if r["g"] == gamma}
        assert len(label) == 161 and label["alone"] == "alone" and all(min(x for x in label if label[x] == c) == c for c in set(label.values()))
        mine = worth([(f"n{a:03d}", f"n{b:03d}", w) for a, b, w in edges], label, gamma)
        assert mine == pytest.approx(told[gamma]["quality"]) and told[gamma]["n"] == len(set(label.values()))
        assert mine >= 0.99 * graph.cpm(list(range(160)), edges, gamma)[1]


def test_moves_together_lose_nothing(spark):
    """A star, whose leaves all want into one community at once, though it is worth it for few of them."""
    n, gamma = 60, 0.3
    edges = [(0, i, 1.0) for i in range(1, n)]
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    found = leiden.communities(frame, spark.range(n), [gamma], small=5)
    label = {r["id"]: r["community"] for r in found.collect()}
    assert worth(edges, label, gamma) >= 0.9 * graph.cpm(list(range(n)), edges, gamma)[1] > 0


@pytest.mark.parametrize("n,min_size,band", [(90, 5, 1000), (90, 5, 17), (60, 12, 20), (8, 12, 100)])
def test_labels_in_bands(spark, n, min_size, band):
    draw = np.random.default_rng(n + band)
    x = np.concatenate([draw.normal(c, 0.4, (n // 4, 2)) for c in (0, 3, 5)] + [draw.uniform(-4, 9, (n - 3 * (n // 4), 2))])
    core = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, min(3, n - 1)]
    tree = [(w, min(a, b), max(a, b)) for w, a, b in clusters.spanning_tree(x, core)]
    tree.sort()
    want = clusters.labels_of_tree(n, tree, min_size)
    edges = spark.createDataFrame([(w, int(a), int(b)) for w, a, b in tree], "weight double, low long, high long")
    got = clusters.tree_labels(edges, spark.range(n).withColumnRenamed("id", "nr"), min_size, band).collect()
    assert [r["cluster_id"] for r in sorted(got)] == want.tolist()
    assert n < 60 or len(set(want)) > 2


def test_labels_without_edges(spark):
    edges = spark.createDataFrame([], "weight double, low long, high long")
    assert [tuple(r) for r in clusters.tree_labels(edges, spark.range(1).withColumnRenamed("id", "nr"), 2).collect()] == [(0, -1)]
    assert clusters.tree_labels(edges, spark.range(0).withColumnRenamed("id", "nr"), 2).count() == 0


@pytest.mark.parametrize("bits,gate", [(3, 16), (3, 0), (1, 16), (5, 8)])
def test_near_signatures_against_all_pairs(spark, bits, gate):
    draw = random.Random(bits + gate)
    base = [draw.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    values = {b for x in base for b in [x, *(x ^ sum(1 << k for k in draw.sample(range(64), draw.randint(1, 6))) for _ in range(12))]}
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    got = [(r["x"], r["y"]) for r in stamps.near_signatures(spark.createDataFrame([(x,) for x in signed] * 2, "simhash64 long"), bits, gate).collect()]
    full = (1 << 64) - 1
    want = {(x, y) for x in signed for y in signed if bin((x ^ y) & full).count("1") <= bits and not ((x ^ y) & full) >> (64 - gate)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(signed)


def test_keys_don_t_grow_with_the_data(spark):
    """Ten times the signatures share keys with ten times the partners at most, not a hundred times."""
    draw, met = random.Random(3), []
    for n in (2_000, 20_000):
        rows = spark.createDataFrame([(draw.getrandbits(46) - (1 << 45),) for _ in range(n)], "simhash64 long")  # few gates
        met.append(stamps.near_signatures(rows, 3, 16).count())
        keys = {t: Counter() for t in range(10)}
        for r in rows.distinct().collect():
            for t, m, _ in stamps._tables(3, 16):
                keys[t][r[0] & m] += 1
        met[-1] = sum(c * c for k in keys.values() for c in k.values()) / n
    assert met[1] < 2.5 * met[0]
