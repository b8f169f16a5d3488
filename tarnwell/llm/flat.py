"""Whole batches of texts as flat numpy arrays: word hashes, n-gram hashes, and storage shared by a cluster."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
#: Bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
TO_INSIDE = bytes(0 if x else 1 for x in SPACE)
STEP, POLY = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * STEP)
BYTE_OR_SPACE = np.where(SPACE, U(0), BYTE)


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of its rows in bytes) of runs of rows with about ``most`` bytes together; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(where, wide)[texts.offset : texts.offset + n + 1].astype(np.int64)  # the bytes are not copied
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b
    del texts, data, where
    pa.default_memory_pool().release_unused()


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, row of each word, first byte, end byte)."""
    raw = data.tobytes()
    if lower:
        raw = raw.translate(TO_LOWER)
        data = np.frombuffer(raw, np.uint8)
    inside = np.frombuffer(raw.translate(TO_INSIDE), bool)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = cuts[cuts > 0] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    if not len(starts):
        return np.zeros(0, U), rows, starts, stops
    lead = int(starts[0])
    reach = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data) - lead) - np.repeat(starts - lead, reach)
    longest = int((stops - starts).max())
    powers = np.ones(longest, U)
    if longest > 1:
        powers[1:] = np.cumprod(np.full(longest - 1, POLY, U))
    place[place >= longest] = 0  # only spaces, which count nothing
    values = np.take(BYTE_OR_SPACE, data[lead:])
    values *= np.take(powers, place)
    sums = np.add.reduceat(values, starts - lead)
    return mix(sums + (stops - starts).astype(U) * STEP), rows, starts, stops


def ngrams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``n`` values."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.full(m, U(seed), U)
    for j in range(n):
        out = out * POLY + hashes[j : j + m]
    return mix(out)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that the cluster names in spark.checkpoint.dir, its lineage cut."""
    ready(df.sparkSession)
    return df.checkpoint()


def ready(spark: SparkSession) -> None:
    """Sets the checkpoint folder that the session names; one of our own only on a single machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not context.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all machines see")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoint-"))
