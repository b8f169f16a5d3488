"""Vectors in a table that lasts: lists of near ones, one byte a component, exact values beside them.

The table is four parts below one URI, all read and written by Spark:

``centres``  one row a list, learned once from a bounded sample;
``codes``    id, list, the unit vector as bytes and their scale, of every vector;
``exact``    id, list and the vector itself;
``log``      one row for each addition: how many, how near to their centres, how many
             lists to read for the recall that was asked for (measured when made).

Codes and exact vectors lie in folders by list (``FOLDERS`` at most, each sorted by
list), so that a search reads the folders of its lists alone. It ranks by codes,
takes ``SPARE`` times as many as are wanted, and ranks those by their exact vectors.
Additions go to the lists that are there; ``drift`` says how much worse they fit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tarnwell.functions import cosine, dot
from tarnwell.operators import index
from tarnwell.operators.blocks import AT_ONCE, Best, beside, packed, pairs, units
from tarnwell.operators.vectors import finite, unit
from tarnwell.plans.checkpoints import checkpointed

FOLDERS, SPARE = 256, 8
#: How far the mean similarity to the centres may fall before lists should be learned anew.
DRIFT = 0.7


def coded(v) -> tuple:
    """The components of a unit vector as whole numbers from -127 to 127, and what one step is worth."""
    step = F.greatest(F.array_max(F.transform(v, F.abs)) / 127, F.lit(1e-12))
    return F.transform(v, lambda x: F.rint(x / step).cast("tinyint")), step


@dataclass(frozen=True)
class VectorTable:
    spark: SparkSession
    uri: str

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.uri}/{part}")

    @cached_property
    def centres(self) -> np.ndarray:
        rows = self._read("centres").orderBy("list").collect()  # index.SAMPLE rows at most
        return np.array([r["centre"] for r in rows])

    @property
    def probes(self) -> int:
        return self._read("log").where("probes is not null").first()["probes"]

    def _log(self, rows: DataFrame, probes: int | None, learned: bool) -> None:
        told = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("fit").alias("fit")).select("n", "fit", F.lit(probes).cast("int").alias("probes"), F.lit(learned).alias("learned"))
        told.coalesce(1).write.mode("append").parquet(f"{self.uri}/log")

    def _put(self, rows: DataFrame, mode: str) -> None:
        """``rows``: id, v (the vector), u (unit) and list."""
        rows = rows.withColumn("folder", F.col("list") % FOLDERS)
        code, step = coded(F.col("u"))
        for part, columns in (("codes", [code.alias("code"), step.cast("float").alias("step")]), ("exact", [F.col("v")])):
            rows.select("id", "list", "folder", *columns).repartition("folder").sortWithinPartitions("folder", "list").write.mode(mode).partitionBy("folder").parquet(f"{self.uri}/{part}")

    def _listed(self, vectors: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
        rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("u", unit(F.col("v")))
        rows = rows.withColumn("list", F.get(index._lists(centres, 1)("u"), F.lit(0)))

        @F.pandas_udf("double")
        def fit(v: pd.Series, list_: pd.Series) -> pd.Series:
            return pd.Series([float(np.dot(np.asarray(a, float), centres[b])) for a, b in zip(v, list_, strict=True)], dtype=float)

        return checkpointed(rows.withColumn("fit", fit("u", "list")))

    def create(self, vectors: DataFrame, key: str = "uuid", vector: str = "embedding", *, k: int = 10, recall: float = 0.97, lists: int | None = None, sample: int = index.SAMPLE, seed: int = 42) -> VectorTable:
        """Learns lists, measures how many to read for ``recall`` of the ``k`` nearest, and writes the table (over one that is there)."""
        made = index.build(vectors, key, vector, lists=lists, sample=sample, seed=seed)
        probes = index.probes_for(made, k, recall)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(made.centres)]
        self.spark.createDataFrame(rows, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.uri}/centres")
        held = self._listed(vectors, key, vector, made.centres)
        self._put(held, "overwrite")
        self.spark.createDataFrame([], "n long, fit double, probes int, learned boolean").write.mode("overwrite").parquet(f"{self.uri}/log")
        self._log(held, probes, True)
        return VectorTable(self.spark, self.uri)

    def append(self, vectors: DataFrame, key: str = "uuid", vector: str = "embedding") -> None:
        """Adds vectors to the lists there are; an id that the table has stays as it is."""
        known = self._read("codes").select(F.col("id").alias(key))
        held = self._listed(vectors.join(known, key, "left_anti"), key, vector, self.centres)
        self._put(held, "append")
        self._log(held, None, False)

    def drift(self) -> dict:
        """How near vectors are to their centres: those the lists were learned from, those added since, and whether to learn anew."""
        rows = self._read("log").groupBy("learned").agg(F.sum("n").alias("n"), (F.sum(F.col("fit") * F.col("n")) / F.sum("n")).alias("fit")).collect()
        told = {r["learned"]: r for r in rows}
        old, new = told[True]["fit"], told[False]["fit"] if False in told else None
        return {"learned": old, "added": new, "n_added": told[False]["n"] if False in told else 0, "stale": new is not None and old is not None and new < DRIFT * old}

    def optimize(self) -> None:
        """One file a folder again, after many additions."""
        for part in ("codes", "exact"):
            rows = checkpointed(self._read(part))
            rows.repartition("folder").sortWithinPartitions("folder", "list").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(f"{self.uri}/{part}")

    def index(self) -> index.Index:
        """The table as an index of unit vectors, for neighbours of all (``index.knn``)."""
        return index.Index(self._read("exact").select("id", unit(F.col("v")).alias("v"), "list"), self.centres)

    def _near(self, part: str, q: np.ndarray, probes: int | None) -> DataFrame:
        """The rows of the lists nearest to a unit vector; no other folders are read."""
        near = np.argsort(-(self.centres @ q), kind="stable")[: probes or self.probes].tolist()
        return self._read(part).where(F.col("folder").isin(sorted({x % FOLDERS for x in near})) & F.col("list").isin(near))

    def search(self, query: list[float], k: int = 10, probes: int | None = None, spare: int = SPARE) -> DataFrame:
        """id and similarity of the k nearest: by codes first, by exact vectors then."""
        q = np.asarray(query, float)
        q = q / max(np.linalg.norm(q), 1e-300)
        rough = dot(F.col("code"), F.lit(q.tolist())) * F.col("step")
        best = self._near("codes", q, probes).select("id", rough.alias("rough")).orderBy(F.desc("rough"), "id").limit(k * spare)
        found = self._near("exact", q, probes).join(F.broadcast(best.select("id")), "id")  # k times spare rows
        return found.select("id", cosine(F.col("v"), F.lit([float(x) for x in query])).alias("similarity")).orderBy(F.desc_nulls_last("similarity"), "id").limit(k)

    def recall(self, queries: DataFrame, k: int = 10, probes: int | None = None, spare: int = SPARE) -> DataFrame:
        """query and share, for each of ``queries`` (query, vector): how many of its k nearest, found exactly, ``search`` would give. All queries at once.

        Blocks of queries meet blocks of the table; a task keeps the best of its queries,
        by exact vectors and by the codes of the lists that a query reads. Queries and
        rows without a vector of finite components take no part.
        """
        take, centres, kind = probes or self.probes, self.centres, dict(queries.dtypes)["query"]
        asked = packed(queries.select(F.col("query").alias("id"), F.col("vector").cast("array<double>").alias("v")).where(finite(F.col("v"))))
        both = self._read("exact").join(self._read("codes").select("id", "code", "step"), "id").where(finite(F.col("v")))
        both = packed(both.select("id", "v", F.col("code").cast("array<double>").alias("code"), F.col("step").cast("double").alias("step"), F.col("list").cast("double").alias("list")))

        def run(batches):
            found: dict = {}
            for p in pairs(batches):
                if p["a_block"] not in found:
                    ids = p["a_ids"]
                    wanted = units(p["a_v"], len(ids))
                    opened = np.zeros((len(ids), len(centres)), bool)
                    for a in range(0, len(ids), AT_ONCE):
                        np.put_along_axis(opened[a : a + AT_ONCE], np.argsort(-(wanted[a : a + AT_ONCE] @ centres.T), axis=1, kind="stable")[:, :take], True, axis=1)
                    found[p["a_block"]] = ids, opened, Best(wanted, k), Best(wanted, k * spare)
                _, opened, exact, near = found[p["a_block"]]
                ids, lists = p["b_ids"], np.frombuffer(p["b_list"]).astype(int)
                exact.add(units(p["b_v"], len(ids)), ids)
                rough = np.frombuffer(p["b_code"]).reshape(len(ids), -1) * np.frombuffer(p["b_step"])[:, None]
                near.add(rough, ids, shut=lambda at, opened=opened, lists=lists: ~opened[at][:, lists])
            for block, (names, _, *best) in found.items():
                for which, b in zip(("exact", "near"), best, strict=True):
                    got = b.settle()
                    row = got["row"].to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), block, np.int64)), pa.array(row), pa.array(names[row], given.field("query").type), pa.array(np.full(len(got), which, object), pa.string()), pa.array(got["id"].to_numpy(), given.field("id").type), pa.array(got["score"].to_numpy())], schema=given)

        schema = f"block long, row long, query {kind}, kind string, id {dict(self._read('exact').dtypes)['id']}, score double"
        given = to_arrow_schema(self.spark.createDataFrame([], schema).schema)
        w = Window.partitionBy("block", "row", "query", "kind").orderBy(F.desc("score"), "id")
        found = beside(asked, both, run, schema).withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.when(F.col("kind") == "exact", k).otherwise(k * spare))
        hits = found.groupBy("block", "row", "query", "id").agg(F.max((F.col("kind") == "exact").cast("int")).alias("real"), F.max((F.col("kind") == "near").cast("int")).alias("near")).where("real = 1")
        return hits.groupBy("block", "row", "query").agg(F.avg("near").alias("share")).select("query", "share")
