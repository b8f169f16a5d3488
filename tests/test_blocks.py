import math

import numpy as np
import pytest

from tarnwell.operators import vector_table, vectors


def some(n: int, copies: int) -> tuple[list[str], np.ndarray]:
    x = np.random.default_rng(3).normal(0, 1, (n, 16)).astype(np.float32).astype(float)
    return [f"v{i:05d}" for i in range(n * copies)], np.tile(x, (copies, 1))


def nearest(ids: list[str], x: np.ndarray, q: np.ndarray, k: int, own: list[str] | None = None) -> list[list[str]]:
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(np.einsum("ij,kj->ik", unit(q), unit(x)), 12)
    out = []
    for i, row in enumerate(sim):
        order = [j for j in np.lexsort((ids, -row)) if own is None or ids[j] != own[i]]
        out.append([ids[j] for j in order[:k]])
    return out


def test_neighbours_over_blocks_with_copies(spark):
    ids, x = some(200, 6)
    odd = [("null", None), ("none", [math.nan] * 16), ("wide", [math.inf] + [0.0] * 15)]
    df = spark.createDataFrame([*zip(ids, x.tolist(), strict=True), *odd], "id string, v array<double>")
    want = {(a, b) for a, near in zip(ids, nearest(ids, x, x, 7, ids), strict=True) for b in near}
    for blocks in (1, 7):
        found = vectors.knn(df, "id", "v", 7, blocks=blocks)
        assert {(r["src"], r["dst"]) for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan and "CoGroup" not in plan  # no vector is written for each block beside it
    assert vectors.knn(df.limit(0), "id", "v", 7).count() == 0


def test_recall_without_queries_on_the_driver(spark, tmp_path, monkeypatch):
    ids, x = some(150, 12)
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "uuid string, embedding array<double>")
    table = vector_table.VectorTable(spark, f"file://{tmp_path}/vectors").create(df, lists=6)
    asked = spark.createDataFrame([*zip(ids[::5], x[::5].tolist(), strict=True), ("null", None)], "query string, vector array<double>")
    want = dict(zip(ids[::5], nearest(ids, x, x[::5], 10), strict=True))
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("rows go to the driver"))
    all_read = {r["query"]: r["share"] for r in table.recall(asked, 10, probes=6, spare=30).collect()}
    assert all_read == dict.fromkeys(want, 1.0)  # equal vectors are equally near by codes too
    one = {r["query"]: r["share"] for r in table.recall(asked, 10, probes=1).collect()}
    for query in list(want)[:4]:
        got = {r["id"] for r in table.search(x[ids.index(query)].tolist(), 80, probes=1, spare=1).collect()}
        assert one[query] == pytest.approx(len(got & set(want[query])) / 10)
