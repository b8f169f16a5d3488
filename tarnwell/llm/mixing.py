"""Mixing sources to target weights, by cube-method balanced sampling.

A source's target over its size says how often each of its documents is taken:
the whole part always, the fraction as an inclusion probability. The flight
moves the probabilities of three documents at a time along the null space of the
two constraints (words, documents), at random but with both totals kept, until
one of them is 0 or 1. Large sources fly in blocks; what a block leaves (two
documents at most) flies again with that of other blocks, until two documents a
source remain, which land on the side nearest to the totals.

Defined results: a null text has size 0; null is the last source; repeated rows
are each drawn; an empty table gives no rows; all is seeded by content, so that
reruns agree.
"""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.flat import checkpointed
from tarnwell.llm.text import n_words, pick

WEIGHTS = (5, 2, 1)
#: Documents of a block of the first flight, and blocks whose rests fly together.
BLOCK, FAN = 4_000, 500
#: Sources up to which their table is broadcast.
MAX_BROADCAST_SOURCES = 100_000
EDGE = 1e-9


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``most`` times its size and the excess is shared anew."""
    out, stopped = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(x for x, s in zip(out, stopped, strict=True) if s)
        weight = sum(w for w, s in zip(weights, stopped, strict=True) if not s)
        if not weight:
            return out
        over = False
        for i, w in enumerate(weights):
            if not stopped[i]:
                out[i] = rest * w / weight
        for i, size in enumerate(sizes):
            if not stopped[i] and out[i] > most * size:
                out[i], stopped[i], over = most * size, True, True
        if not over:
            return out


def fly(sizes: list[float], chances: list[float], seed: int) -> list[float]:
    """The flight: chances of which at most two stay between 0 and 1; both totals are kept."""
    draw = random.Random(seed).random
    out = list(chances)
    live: list[int] = []
    waiting = iter(range(len(out)))
    while True:
        while len(live) < 3:
            k = next(waiting, None)
            if k is None:
                return [0.0 if x < EDGE else 1.0 if x > 1 - EDGE else x for x in out]
            if EDGE < out[k] < 1 - EDGE:
                live.append(k)
        i, j, k = live
        a, b, c = sizes[i], sizes[j], sizes[k]
        way = (b - c, c - a, a - b)
        if a == b == c:
            way = (1.0, -1.0, 0.0)
        up = down = math.inf
        for x, u in zip(live, way, strict=True):
            if u > 0:
                up, down = min(up, (1 - out[x]) / u), min(down, out[x] / u)
            elif u < 0:
                up, down = min(up, out[x] / -u), min(down, (1 - out[x]) / -u)
        step = up if draw() * (up + down) < down else -down
        for x, u in zip(live, way, strict=True):
            out[x] += step * u
        live = [x for x in live if EDGE < out[x] < 1 - EDGE]


def land(sizes: list[float], chances: list[float]) -> list[float]:
    """Whole numbers for the few chances left: those with the totals nearest to what is expected."""
    rest = [k for k, x in enumerate(chances) if 0 < x < 1]
    aim = sum(sizes[k] * chances[k] for k in rest)
    count = sum(chances[k] for k in rest)
    best = min(range(1 << len(rest)), key=lambda m: (abs(sum(sizes[k] for t, k in enumerate(rest) if m >> t & 1) - aim), abs(bin(m).count("1") - count), m))
    out = list(chances)
    for t, k in enumerate(rest):
        out[k] = float(best >> t & 1)
    return out


def _flight(level: int, last: bool):
    def run(key, table):
        ids = np.asarray(table["doc_id"].fill_null(-(2**63)).to_numpy(), np.int64)
        size = np.asarray(table["size"].to_numpy(), np.int64)
        order = np.lexsort((ids, size))
        sizes, chances = size[order].astype(float).tolist(), table["chance"].to_numpy()[order].tolist()
        out = fly(sizes, chances, zlib.crc32(repr((level, *[k.as_py() for k in key])).encode()))
        if last:
            out = land(sizes, out)
        result = np.empty(len(out))
        result[order] = out
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(result))

    return run


def mix(docs: DataFrame, *, percent: int = 150, weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) of every row of ``docs``."""
    spark = docs.sparkSession
    sized = pick(docs, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("deal"))
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    each = [weights[i % len(weights)] for i in range(len(found))]
    aim = targets([r["size"] for r in found], each, percent * sum(r["size"] for r in found) / 100, most)
    rows = [(i, r["source"], r["size"], float(x), max(1, math.ceil(r["n"] / BLOCK))) for i, (r, x) in enumerate(zip(found, aim, strict=True))]
    table = spark.createDataFrame(rows, "source_no int, _source string, source_size long, target double, blocks int")
    table = F.broadcast(table) if len(rows) <= MAX_BROADCAST_SOURCES else table
    joined = sized.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    kept = joined.withColumn("rate", rate).select("doc_id", "source", "size", "source_size", "target", F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("chance"), "source_no", F.pmod(F.col("deal"), F.col("blocks")).cast("int").alias("block"))  # by text too, as many rows may share an id or have none
    schema, blocks, level, done = kept.schema, max([1, *(r[4] for r in rows)]), 0, None
    flying = kept
    while True:
        last = blocks == 1
        flown = flying.groupBy("source_no", "block").applyInArrow(_flight(level, last), schema)
        flown = checkpointed(flown)
        settled = flown.where("chance = 0 or chance = 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        blocks, level = math.ceil(blocks / FAN), level + 1
        flying = flown.where("chance > 0 and chance < 1").withColumn("block", F.expr(f"cast(block div {FAN} as int)"))
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("chance").cast("long"))).alias("taken"))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
