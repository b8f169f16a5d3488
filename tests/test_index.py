"""The index of vectors against comparing all."""

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import graph, index, vector_table, vectors

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vecs(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    return rows.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("uuid"), F.col("embedding").cast("array<double>").alias("embedding")).cache()


def test_recall_of_the_index(vecs, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 64)
    exact = {(r["src"], r["dst"]) for r in vectors.knn(vecs, "uuid", "embedding", 5).collect()}
    made = index.build(vecs)
    got = {(r["src"], r["dst"]) for r in index.knn(made, 5).collect()}
    assert len(exact & got) >= 0.95 * len(exact) and index.probes_for(made, 5) < len(made.centres)
    whole = {(r["src"], r["dst"]) for r in index.knn(made, 5, probes=len(made.centres)).collect()}
    assert whole == exact


def test_search_and_graph_by_the_index(vecs):
    made = index.build(vecs)
    found, probes = [], index.probes_for(made, 10)
    for query in (r["embedding"] for r in vecs.orderBy("uuid").limit(6).collect()):
        want = {r["uuid"] for r in vecs.select("uuid", vectors.cosine(F.col("embedding"), F.lit(query)).alias("s")).orderBy(F.desc("s"), "uuid").limit(10).collect()}
        got = {r["id"] for r in index.search(made, query, 10, probes=probes).collect()}
        found.append(len(want & got) / 10)
    assert sum(found) / len(found) >= 0.9
    a, b = ({(r["src"], r["dst"]) for r in graph.mutual_knn(vecs, "uuid", "embedding", 5, -1.0, indexed=p).collect()} for p in (False, True))
    assert len(a & b) >= 0.9 * len(a)
    assert index.knn(index.build(vecs.limit(0)), 3).count() == 0


def test_table_of_vectors(spark, vecs, tmp_path):
    table = vector_table.VectorTable(spark, f"file://{tmp_path}/vectors").create(vecs.where("uuid < '000000000400'"), lists=8)
    table.append(vecs)  # the first 400 are known
    assert table._read("codes").count() == table._read("exact").count() == 500 and table.drift()["n_added"] == 100 and not table.drift()["stale"], table.drift()
    asked = vecs.where("uuid like '%0'").select(F.col("uuid").alias("query"), F.col("embedding").alias("vector"))
    shares = [r["share"] for r in table.recall(asked, 10).collect()]
    assert len(shares) == 50 and sum(shares) / 50 >= 0.95
    found = []
    for row in asked.orderBy("query").limit(3).collect():
        want = vecs.select("uuid", vectors.cosine(F.col("embedding"), F.lit(row["vector"])).alias("s")).orderBy(F.desc("s"), "uuid").limit(10).collect()
        got = table.search(row["vector"], 10).collect()
        true = {r["uuid"]: r["s"] for r in want}
        found.append(sum(r["id"] in true for r in got) / 10)
        assert all(r["similarity"] == pytest.approx(true[r["id"]]) for r in got if r["id"] in true)  # by exact vectors
    assert sum(found) / 3 >= 0.9
    plan = table.search(row["vector"], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [folder") == 2  # other folders are not read
    before = len(list(tmp_path.rglob("codes/*/*.parquet")))
    table.optimize()
    assert len(list(tmp_path.rglob("codes/*/*.parquet"))) < before and table._read("codes").count() == 500
    # vectors unlike those that the lists were learned from
    table.append(vecs.select(F.concat(F.lit("new"), "uuid").alias("uuid"), F.lit((-table.centres.mean(0)).tolist()).alias("embedding")))
    assert table.drift()["stale"], table.drift()
    edges = graph.mutual_knn(vecs, "uuid", "embedding", 5, -1.0)
    again = table.create(vecs)
    near = {(r["src"], r["dst"]) for r in index.knn(again.index(), 5, probes=again.probes).collect()}
    pairs = {(r["src"], r["dst"]) for r in edges.collect()}
    assert len([p for p in pairs if p in near]) >= 0.9 * len(pairs)
