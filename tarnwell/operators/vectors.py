"""Embeddings: what to embed, search, centroids and neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tarnwell.functions import cosine, norm, since
from tarnwell.operators.blocks import Best, beside, packed, pairs, units


class Embedder(Protocol):
    """What turns texts into vectors."""

    model: str
    dim: int

    def documents(self, texts: list[str]) -> list[list[float]]: ...

    def query(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """Signed hashing of words, unit length; needs no model and is the same everywhere."""

    def __init__(self, dim: int = 64):
        self.model, self.dim = f"hashing-{dim}", dim

    def query(self, text: str) -> list[float]:
        out = np.zeros(self.dim)
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[h % self.dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out)
        return (out / size if size else out).tolist()

    def documents(self, texts: list[str]) -> list[list[float]]:
        return [self.query(t) for t in texts]


def unembedded(text: DataFrame, embeddings: DataFrame, stamps: DataFrame | None = None, days: float | None = None, limit: int | None = None, now=None) -> DataFrame:
    """Canonical messages without a vector; the limit counts what is left."""
    rows = text.where(since(F.col("ts"), days, now)).select("uuid", "ts", "text_content")
    if stamps is not None:
        rows = rows.join(stamps.select("uuid", "canonical_uuid"), "uuid", "left").where("canonical_uuid is null or canonical_uuid = uuid").drop("canonical_uuid")
    rows = rows.join(embeddings.select("uuid"), "uuid", "left_anti")
    return rows.orderBy("ts", "uuid").limit(limit) if limit is not None else rows


def embed(rows: DataFrame, embedder: Embedder, batch: int = 96) -> DataFrame:
    """Vectors of uuid and text_content, a batch at a time on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                yield pd.DataFrame({"uuid": part["uuid"], "model": embedder.model, "dim": embedder.dim, "embedding": embedder.documents(part["text_content"].tolist())})

    out = rows.select("uuid", "text_content").mapInPandas(run, "uuid string, model string, dim int, embedding array<float>")
    return out.withColumn("embedded_at", F.current_timestamp())


def search(embeddings: DataFrame, text: DataFrame, query: list[float], k: int = 10, session_id: str | None = None) -> DataFrame:
    """The k nearest messages by cosine with the first 200 characters of each."""
    wanted = text if session_id is None else text.where(F.col("session_id") == session_id)
    rows = embeddings.where(F.size("embedding") == len(query)).select("uuid", cosine(F.col("embedding"), F.lit([float(x) for x in query])).alias("similarity"))
    if session_id is not None:
        rows = rows.join(wanted.select("uuid"), "uuid", "left_semi")
    elif text is not None:
        rows = rows.join(text.select("uuid"), "uuid", "left_semi")
    best = rows.orderBy(F.desc_nulls_last("similarity"), "uuid").limit(k)
    out = best.join(wanted, "uuid").select("uuid", "session_id", "ts", "role", F.substring("text_content", 1, 200).alias("snippet"), "similarity")
    return out.orderBy(F.desc_nulls_last("similarity"), "uuid")


def neighbours(embeddings: DataFrame, uuid: str, k: int) -> DataFrame:
    """The k nearest to one vector, without itself. The seed is one row."""
    seed = embeddings.where(F.col("uuid") == uuid).select(F.col("embedding").alias("seed")).limit(1)
    rows = embeddings.where(F.col("uuid") != uuid).join(F.broadcast(seed), F.lit(True))
    return rows.select("uuid", (1 - cosine(F.col("embedding"), F.col("seed"))).alias("distance")).orderBy(F.asc_nulls_last("distance"), "uuid").limit(k)


def finite(column: Column) -> Column:
    """Whether there is a vector, of finite components only."""
    return F.coalesce(F.forall(column, lambda x: F.abs(x) < float("inf")), F.lit(False))


def mean_vector(column: str | Column) -> Column:
    """The mean of arrays in a group, place by place, inside the aggregation: no row for each place is made."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vectors = array_to_vector((F.col(column) if isinstance(column, str) else column).cast("array<double>"))
    return vector_to_array(Summarizer.mean(vectors))


def unit(column: Column) -> Column:
    """An array scaled to length 1; zeros stay."""
    size = norm(column)
    return F.transform(column, lambda x: x / F.when(size == 0, F.lit(1.0)).otherwise(size))


def centroids(embeddings: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id and the unit mean of its messages' vectors."""
    rows = embeddings.select("uuid", "embedding").join(messages.select("uuid", "session_id"), "uuid")
    means = rows.groupBy("session_id").agg(mean_vector("embedding").alias("mean"))
    return means.select("session_id", unit(F.col("mean")).alias("centroid"))


def candidate_sessions(embeddings: DataFrame, messages: DataFrame) -> DataFrame:
    return messages.select("uuid", "session_id").join(embeddings.select("uuid"), "uuid", "left_semi").agg(F.count_distinct("session_id").alias("n"))


def neighbours_of_session(centroid_table: DataFrame, session_id: str, communities: DataFrame | None = None, k: int = 15) -> DataFrame:
    """The k sessions nearest to one; an unknown session is an error."""
    seed = centroid_table.where(F.col("session_id") == session_id).limit(1).collect()
    if not seed:
        raise ValueError(f"no vectors of session {session_id}")
    rows = centroid_table.where(F.col("session_id") != session_id).select("session_id", cosine(F.col("centroid"), F.lit(seed[0]["centroid"])).alias("similarity"))
    best = rows.orderBy(F.desc_nulls_last("similarity"), "session_id").limit(k)
    if communities is not None:
        best = best.join(communities.select("session_id", "community_id"), "session_id", "left")
    return best.orderBy(F.desc_nulls_last("similarity"), "session_id")


def knn(vectors: DataFrame, key: str, vector: str, k: int, blocks: int | None = None) -> DataFrame:
    """src, dst, sim of each row's k nearest by cosine, ties to the smaller key.

    Blocks of rows meet in a Cartesian product that shuffles nothing; a task keeps the
    k best of each of its rows, so that no row is made for the other pairs, and what
    is written doesn't grow with their number. Exact; the work is that of all pairs.
    Vectors that are null or have a component that isn't finite are no one's neighbours.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = dict(rows.dtypes)["id"]
    held = packed(rows.where(finite(F.col("v"))).select("id", "v"), blocks)

    def run(batches):
        found: dict = {}
        for p in pairs(batches):
            if p["a_block"] not in found:
                ids = p["a_ids"]
                found[p["a_block"]] = ids, Best(units(p["a_v"], len(ids)), k)
            own, best = found[p["a_block"]]
            best.add(units(p["b_v"], len(p["b_ids"])), p["b_ids"], own)
        for own, best in found.values():
            got = best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(x, given.field(0).type) for x in (own[got["row"].to_numpy()], got["id"].to_numpy())] + [pa.array(got["score"].to_numpy())], schema=given)

    schema = f"src {kind}, dst {kind}, sim double"
    given = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return beside(held, held, run, schema).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
