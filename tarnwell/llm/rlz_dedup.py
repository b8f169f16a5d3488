"""Substring dedup of word sequences by hashes of blocks and windows.

This stands in for relative Lempel-Ziv parsing: no factor is extended or measured.
All documents are cut into blocks: around each anchor (of
the word pairs of a window the one with the longest words) lie the windows that
have it as theirs. Equal passages are cut into equal blocks wherever they stand,
so the index, from a block's hash to its smallest doc_id, is dealt by hash, and
a block that an earlier document has is a duplicate. Of the other blocks, those
whose anchor other documents have in another setting are checked window by
window. The duplicate spans are unions of such windows of ``window`` words.

Defined results: a null text has no words; texts of fewer than ``window`` words
lose nothing; of equal texts the smallest doc_id stays whole; repeated rows do
not count as smaller than one another; a null doc_id neither removes nor loses
words. A doc_id names one text: rows that share one and differ in text don't
fail, but what is found in one may be cut from the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.flat import POLY, U, checkpointed, mix, ngrams, slices, word_hashes
from tarnwell.llm.text import pick

#: Words of an anchor.
PAIR = 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(POLY), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate((np.ones(1, U), np.cumprod(np.full(max(n - 1, 0), x, U)))) for x in (POLY, inverse))


def blocks(h: np.ndarray, rows: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor, block hash) of each block, the anchor being 40 bits of its hash and 12 of each word beside it; ``h``, ``rows``, ``lengths``: of each word its hash, row and bytes."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, np.zeros(0, U), np.zeros(0, U)
    pair = ngrams(h, PAIR)
    span = window - PAIR + 1  # anchors of a window
    long = np.minimum(lengths[: len(pair)], 255).astype(U)
    rank = ((U(255) - long) << U(56)) | (pair >> U(8))
    best, width = np.arange(len(rank)), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(rank[b] < rank[a], b, a)
        width += step
    count = len(h) - window + 1
    whole = rows[:count] == rows[window - 1 :]
    best = best[:count]
    new = whole.copy()
    new[1:] &= ~((best[1:] == best[:-1]) & whole[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, np.zeros(0, U), np.zeros(0, U)
    index = np.cumsum(new) - 1
    n = np.bincount(index[whole], minlength=len(first))
    power, inverse = _powers(len(h) + 1)
    at, total = best[first], np.concatenate((np.zeros(1, U), np.cumsum(h * power[:-1])))
    content = (total[first + n + window - 1] - total[first]) * inverse[first]
    # A window that holds the anchor holds the word before or the word after it: 12 bits of each, 0 where the block has none.
    some = lambda x: (x >> U(40)) % U(4095) + U(1)
    left = np.where(at > first, some(h[at - 1]), U(0))
    right = np.where(at + PAIR < first + n + window - 1, some(h[np.minimum(at + PAIR, len(h) - 1)]), U(0))
    return first, n, (pair[at] >> U(24) << U(24)) | (left << U(12)) | right, mix(content ^ mix((at - first).astype(U) * U(4096) + n.astype(U)))


def _runs(window: int, shared: bool):
    """Rows of each document's blocks. ``shared``: only what the index needs, one row for each block of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_all = batch.column(0)
            keep = []
            for a, b, data, offsets in slices(batch.column(1)):
                h, rows, starts, stops = word_hashes(data, offsets)
                first, n, anchor, sig = blocks(h, rows, stops - starts, window)
                if not len(first):
                    continue
                row = rows[first]
                ids = ids_all.slice(a, b - a).to_numpy(zero_copy_only=False)[row]
                begin = first - np.searchsorted(rows, row)  # counted from the document's first word
                if shared:
                    keep.append((anchor.view(np.int64), sig.view(np.int64), ids))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids), pa.array((begin << 16) | n)], names=["sig", "doc_id", "place"])
            if keep:
                anchor, sig, ids = (np.concatenate(x) for x in zip(*keep, strict=True))
                order = np.lexsort((ids, sig))
                anchor, sig, ids = anchor[order], sig[order], ids[order]
                new = np.ones(len(sig), bool)
                new[1:] = sig[1:] != sig[:-1]
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(sig)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(sig[at]), pa.array(ids[at]), pa.array(ids[last] != ids[at])], names=["anchor", "sig", "low", "several"])

    return run


def _within(places: np.ndarray, window: int, size: int) -> np.ndarray:
    """The places that lie in a row of ``size`` words; others belong to another row of its doc_id."""
    return places[(places >> 16) + (places & 0xFFFF) + window - 1 <= size]


def _windows(window: int):
    """Hashes of the windows of blocks that the index did not settle; within a batch only a window's smallest document goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(2)), 0), False))
            keep = []
            for a, b, data, offsets in slices(batch.column(1)):
                h, rows, _, _ = word_hashes(data, offsets)
                grams, at = ngrams(h, window), np.searchsorted(rows, np.arange(b - a + 1))
                for i, places in enumerate(batch.column(2).slice(a, b - a).to_pylist()):
                    p = _within(np.array(places, np.int64), window, at[i + 1] - at[i])
                    n = p & 0xFFFF
                    begin = np.repeat(p >> 16, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    keep.append((grams[at[i] + begin], np.full(len(begin), batch.column(0)[a + i].as_py(), np.int64), begin))
            if keep:
                gram, ids, begin = (np.concatenate(x) for x in zip(*keep, strict=True))
                order = np.lexsort((ids, gram))
                gram, ids, begin = gram[order], ids[order], begin[order]
                new = np.ones(len(gram), bool)
                new[1:] = gram[1:] != gram[:-1]
                low = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(ids), pa.array(begin), pa.array(low < ids)], names=["gram", "doc_id", "begin", "sure"])

    return run


def _joined(data: np.ndarray, kept: np.ndarray, rows: np.ndarray, starts: np.ndarray, stops: np.ndarray, n_rows: int) -> list[bytes]:
    """Each row's kept words, joined by one space."""
    size = stops[kept] - starts[kept] + 1
    to = np.cumsum(size)
    source = np.repeat(starts[kept] - (to - size), size) + np.arange(to[-1] if len(to) else 0)
    out = np.append(data, np.uint8(32))[source]
    out[to - 1] = 32
    left = np.concatenate(([0], np.cumsum(np.bincount(rows[kept], weights=size, minlength=n_rows).astype(np.int64))))
    raw = out.tobytes()
    return [raw[left[i] : max(left[i], left[i + 1] - 1)] for i in range(n_rows)]


def _cut(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Each row's text without the words gone and the space after each."""
    edge = np.zeros(len(data) + 1, np.int64)
    after = np.append(starts[1:], len(data))
    after = np.minimum(after, offsets[rows + 1]) if len(rows) else after[:0]
    np.add.at(edge, starts[gone], 1)
    np.add.at(edge, after[gone], -1)
    stay = np.cumsum(edge[:-1]) == 0
    left = np.concatenate(([0], np.cumsum(stay)))[offsets]
    raw = data[stay].tobytes()
    return [raw[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]


def _cover(window: int, carry: tuple[str, ...] | None):
    """The result's rows. ``carry``: the columns that go along with the text that is left; None: its hash alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                _, rows, starts, stops = word_hashes(data, offsets)
                at = np.searchsorted(rows, np.arange(b - a + 1))
                ends = np.zeros(len(rows) + 1, np.int64)
                for i, (places, single) in enumerate(zip(batch.column(2).slice(a, b - a).to_pylist(), batch.column(3).slice(a, b - a).to_pylist(), strict=True)):
                    if places:
                        p = _within(np.array(places, np.int64), window, at[i + 1] - at[i])
                        np.add.at(ends, at[i] + (p >> 16), 1)
                        np.add.at(ends, at[i] + (p >> 16) + (p & 0xFFFF) + window - 1, -1)
                    if single:
                        p = np.array(single, np.int64)
                        p = p[p + window <= at[i + 1] - at[i]]
                        np.add.at(ends, at[i] + p, 1)
                        np.add.at(ends, at[i] + p + window, -1)
                gone = np.cumsum(ends[:-1]) > 0
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(np.bincount(rows[gone], minlength=b - a).astype(np.int64))]
                names = ["doc_id", "n_words", "n_removed"]
                if carry is None:
                    bodies = _joined(data, np.flatnonzero(~gone), rows, starts, stops, b - a)
                    columns, names = [*columns, pa.array([hashlib.sha256(x).hexdigest() for x in bodies])], [*names, "kept_sha256"]
                else:
                    bodies = _cut(data, offsets, gone, rows, starts)
                    columns, names = [*columns, pa.array([x.decode() for x in bodies], pa.string())], [*names, "kept_text"]
                    columns, names = [*columns, *(batch.column(4 + k).slice(a, b - a) for k in range(len(carry)))], [*names, *carry]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, *, window: int = 13, carry: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs`` (doc_id, text).

    With ``carry``, kept_text instead (the text without the words removed, its
    other space unchanged) and the columns of ``docs`` that are named in it.
    """
    docs = pick(docs, "doc_id", "text", *(carry or ()))
    keyed = docs.where("doc_id is not null").select("doc_id", "text")
    found = keyed.mapInArrow(_runs(window, True), "anchor long, sig long, low long, several boolean")
    place = F.shiftrightunsigned("anchor", 24)
    index = found.repartition(place).groupBy(place.alias("place"), "anchor", "sig").agg(F.min("low").alias("low"), (F.max("several") | (F.min("low") < F.max("low"))).alias("several"))
    before, after = F.shiftrightunsigned("anchor", 12).bitwiseAND(F.lit(4095).cast("long")), F.col("anchor").bitwiseAND(F.lit(4095).cast("long"))
    beside = lambda x: (F.count(F.lit(1)).over(Window.partitionBy("place", x)) > 1) & (x > 0)
    index = index.withColumn("more", beside(before) | beside(after)).where("several or more").select("sig", "low", "more")
    parsed = keyed.mapInArrow(_runs(window, False), "sig long, doc_id long, place long").join(index, "sig").where("doc_id > low or more")
    # Sets, so that rows that are equal don't hand each of them the places of all.
    sure = F.collect_set(F.when(F.col("doc_id") > F.col("low"), F.col("place"))).alias("sure")
    unsure = F.collect_set(F.when(F.col("doc_id") == F.col("low"), F.col("place"))).alias("unsure")
    parsed = checkpointed(parsed.groupBy("doc_id").agg(sure, unsure))
    # One join for both uses, without a filter that would make them differ, so that the texts are shuffled once.
    dealt = docs.repartition("doc_id").join(parsed, "doc_id", "left")
    # (Whatever columns one use alone would leave out would make it another shuffle.)
    dealt = dealt.select("doc_id", "text", "unsure", "sure", *(carry or ()))
    edges = dealt.mapInArrow(_windows(window), "gram long, doc_id long, begin long, sure boolean")
    low = F.min("doc_id").over(Window.partitionBy("gram"))
    single = edges.select("doc_id", "begin", (F.col("sure") | (low < F.col("doc_id"))).alias("gone")).where("gone").groupBy("doc_id").agg(F.collect_set("begin").alias("single"))
    whole = dealt.join(single, "doc_id", "left")
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry or ())
    schema = f"doc_id long, n_words long, n_removed long, {'kept_sha256' if carry is None else 'kept_text'} string{kinds}"
    return whole.select("doc_id", "text", "sure", "single", *(carry or ())).mapInArrow(_cover(window, carry), schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN m USING (h), generate_series(0, 12) AS t(k) WHERE doc_id > low),
r AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE
    array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda x: NOT list_contains(gone, x)), lambda x: w[x]), ' ') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
