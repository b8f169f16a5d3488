"""Layouts in fewer dimensions: the graph by definition, and neighbours kept better than by principal components."""

import numpy as np
import pytest

from tarnwell.operators import clusters, umap


def test_curve_and_weights(spark):
    a, b = umap.curve(0.1)
    assert a == pytest.approx(1.577, abs=0.01) and b == pytest.approx(0.895, abs=0.01)  # as published for 0.1
    near = [(i, j, 1 - abs(i - j) / 10) for i in range(8) for j in range(8) if i != j and abs(i - j) <= 3]
    edges = {(r["src"], r["dst"]): r["weight"] for r in umap.fuzzy_edges(spark.createDataFrame(near, "src long, dst long, sim double"), 10).collect()}
    assert all(edges[i, j] == edges[j, i] for i, j in edges) and edges[3, 4] == pytest.approx(1)
    assert edges[3, 4] > edges[3, 5] > edges[3, 6] > 0


@pytest.mark.parametrize("block", [1000, 60])
def test_neighbours_are_kept(spark, block):
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(0, 1, 12) * 3 + draw.normal(0, 0.7, (20, 12)) for _ in range(9)])  # nine groups, which a plane can't hold apart
    df = spark.createDataFrame([(f"u{i:03d}", v.tolist()) for i, v in enumerate(x)], "uuid string, embedding array<double>")
    order = lambda rows: np.array([r["point"] for r in sorted(rows, key=lambda r: r["uuid"])])
    plane = order(umap.layout(df, dims=2, neighbours=12, rounds=6, block=block).collect())
    flat = order(clusters.reduce_dimensions(df, dims=2).collect())
    assert plane.shape == (180, 2) and np.isfinite(plane).all()
    mine, pca = umap.trustworthiness(x, plane, 8), umap.trustworthiness(x, flat, 8)
    assert mine > pca + 0.02, (mine, pca)


def test_small_layouts(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0])], "uuid string, embedding array<double>")
    assert umap.layout(df, dims=2).count() == 1 and umap.layout(df.limit(0)).count() == 0
