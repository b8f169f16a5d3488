"""Substring dedup of bytes by merging Burrows-Wheeler transforms.

A string of ``window`` bytes that starts at two places is a repeat. Content
decides which places can matter: around each anchor (the window's least hash of
``ANCHOR`` bytes) lie the windows that have it as theirs, a block. Blocks that
are equal as a whole repeat as a whole. The other blocks of an anchor that
occurs again, one of each kind, go together to one task, where shards of them
are suffix-sorted, their transforms merged by refining the interleave a symbol
(8 bytes) at a time without sorting all suffixes again, and the intervals that
still hold two suffixes after ``window`` bytes' rounds are the repeats: their
common prefix is that long.

Defined results: a null text has no bytes; matches never cross texts; each row is
a text of its own, whatever its doc_id (also null, or shared with other rows), so
that all of repeated rows goes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.flat import BYTE, POLY, U, checkpointed, mix, slices
from tarnwell.llm.text import pick

#: Bytes of an anchor, and of the texts one merge is about; shards of a merge; bytes of a symbol.
ANCHOR, TOGETHER, SHARDS, WIDE = 24, 60_000, 2, 8
#: Bytes of text that are arrays at once.
SLICE = 1 << 18


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash and what makes a range's hash the same everywhere."""
    inverse = U(pow(int(POLY), -1, 1 << 64))
    power = np.ones(len(data) + 1, U)
    back = np.ones(len(data) + 1, U)
    if len(data):
        power[1:] = np.cumprod(np.full(len(data), POLY, U))
        back[1:] = np.cumprod(np.full(len(data), inverse, U))
    return np.concatenate((np.zeros(1, U), np.cumsum(np.take(BYTE, data) * power[:-1]))), back


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by running minima of blocks from both sides."""
    n = -(-len(x) // width) * width
    whole = np.concatenate((x, np.full(n - len(x), np.iinfo(np.uint64).max, U))).reshape(-1, width)
    left = np.minimum.accumulate(whole, axis=1).ravel()
    right = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - width + 1
    return np.minimum(right[:m], left[width - 1 : width - 1 + m])


def blocks(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, row, anchor, block hash) of each block of some texts end to end; the anchor is 40 bits
    of its hash and 12 of the bytes on either side (0 where the block has none)."""
    none = np.zeros(0, np.int64)
    empty = none, none, none, np.zeros(0, U), np.zeros(0, U)
    count = len(data) - window + 1
    if count <= 0:
        return empty
    sums, back = _sums(data)
    grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * back[: len(data) - ANCHOR + 1])
    bits = U(max(1, int(len(grams)).bit_length()))
    least = _sliding_min(((grams >> bits) << bits) | np.arange(len(grams), dtype=U), window - ANCHOR + 1)[:count]
    at_each = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[:count]
    whole = np.arange(window, count + window) <= np.repeat(offsets[1:], sizes)[:count]
    new = whole.copy()
    new[1:] &= ~((at_each[1:] == at_each[:-1]) & whole[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return empty
    n = np.bincount((np.cumsum(new) - 1)[whole], minlength=len(first))
    at, end = at_each[first], first + n + window - 1
    part = lambda a, b: mix((sums[b] - sums[a]) * back[a])
    some = lambda x: (x >> U(40)) % U(4095) + U(1)
    # A window that holds the anchor has half of the rest of it, at least, on one of its sides.
    beside = (window - ANCHOR + 1) // 2
    left = np.where(at - beside >= first, some(part(np.maximum(at - beside, 0), at)), U(0))
    after = np.minimum(at + ANCHOR + beside, len(data))
    right = np.where(at + ANCHOR + beside <= end, some(part(np.minimum(at + ANCHOR, len(data)), after)), U(0))
    anchor = (grams[at] >> U(24) << U(24)) | (left << U(12)) | right
    sig = mix(((sums[end] - sums[first]) * back[first]) ^ mix((at - first).astype(U) * U(4096) + n.astype(U)))
    return first, n, row[first], anchor, sig


def _found(window: int, index: bool):
    """Rows of the documents' blocks; ``index``: one for each kind of a batch, with how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, data, offsets in slices(batch.column(1), SLICE):
                first, n, row, anchor, sig = blocks(data, offsets, window)
                ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)[row]
                if index:
                    keep.append((anchor.view(np.int64), sig.view(np.int64), ids, ((first - offsets[row]) << 16) | n))
                elif len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(anchor.view(np.int64)), pa.array(ids.astype(np.int64)), pa.array(((first - offsets[row]) << 16) | n)], names=["sig", "anchor", "doc_id", "place"])
            if keep:
                anchor, sig, ids, place = (np.concatenate(x) for x in zip(*keep, strict=True))
                order = np.lexsort((place, ids, sig))
                anchor, sig, ids, place = anchor[order], sig[order], ids[order], place[order]
                at = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(sig[at]), pa.array(ids[at].astype(np.int64)), pa.array(place[at]), pa.array(np.diff(np.append(at, len(sig))))], names=["anchor", "sig", "low", "spot", "n"])

    return run


def _snippets(window: int):
    """anchor place, doc_id, begin, windows and bytes of the blocks that go to a merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(2)), 0), False))
            for a, b, data, offsets in slices(batch.column(1), SLICE):
                raw = data.tobytes()
                out: list[tuple] = []
                for i, items in enumerate(batch.column(2).slice(a, b - a).to_pylist()):
                    doc = batch.column(0)[a + i].as_py()
                    for x in items:
                        begin, n = x["place"] >> 16, x["place"] & 0xFFFF
                        if begin + n + window - 1 > offsets[i + 1] - offsets[i]:
                            continue  # another row of this doc_id
                        out.append((x["group"], doc, begin, n, raw[offsets[i] + begin : offsets[i] + begin + n + window - 1]))
                if out:
                    group, ids, begin, n, body = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(ids, pa.int64()), pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array(body, pa.binary())], names=["group", "doc_id", "begin", "n", "body"])

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of symbols from 1, each 0 ending a string; equal ends in order of place; by doubling."""
    n = len(text)
    rank = np.where(text == 0, np.cumsum(text == 0) - 1, text.astype(np.int64) + n)
    span = 1
    while True:
        _, rank = np.unique(rank, return_inverse=True)
        if len(rank) == 0 or rank.max() == n - 1:
            return np.argsort(rank)
        later = np.zeros(n, np.int64)
        later[: max(n - span, 0)] = rank[span:] + 1
        rank = rank * (n + 1) + later
        span *= 2


def transform(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """The symbol before each suffix; before a string's start, its end's 0."""
    return np.where(suffixes == 0, 0, text[suffixes - 1])


def _by_symbol(symbols: np.ndarray) -> np.ndarray:
    """Stable order of 32-bit symbols, by their low and then their high halves."""
    low = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if not len(symbols) or symbols.max() < 65536:
        return low
    return low[np.argsort((symbols[low] >> 16).astype(np.uint16), kind="stable")]


def merged(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard and position of each suffix in the order of all by ``depth`` symbols, and where a new prefix of that length begins.

    Each round sorts, stably, by the symbol before: what was in order by h
    symbols then is by h + 1 (Holt and McMillan), and two neighbours stay
    together only if their symbols and their former intervals are the same.
    """
    arrays = [suffix_array(x) for x in shards]
    before = [transform(x, s) for x, s in zip(shards, arrays, strict=True)]
    source = np.repeat(np.arange(len(shards), dtype=np.int8), [len(x) for x in shards])
    n = len(source)
    block = np.zeros(n, np.int32)
    symbols = np.empty(n, np.uint32)
    for _ in range(depth):
        for k, x in enumerate(before):
            symbols[source == k] = x
        order = _by_symbol(symbols)
        now, old = symbols[order], block[order]
        new = np.ones(n, bool)
        new[1:] = (now[1:] != now[:-1]) | (old[1:] != old[:-1]) | (now[1:] == 0)
        source, block = source[order], np.cumsum(new, dtype=np.int32)
    position = np.empty(n, np.int64)
    for k, s in enumerate(arrays):
        position[source == k] = s
    return source, position, np.diff(block, prepend=-1) != 0


def _symbols(bodies: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of ``wide`` bytes, the string of each and where it begins there.

    A string becomes one for each remainder of its places by ``wide``; each ends with 0.
    """
    sizes = np.array([len(x) for x in bodies], np.int64)
    data = np.frombuffer(b"".join(bodies) + bytes(wide), np.uint8)
    at = np.concatenate(([0], np.cumsum(sizes)))
    gram = np.zeros(len(data) - wide + 1, U)
    for j in range(wide):
        gram = (gram << U(8)) | data[j : j + len(gram)]
    owner = np.repeat(np.arange(len(bodies)), sizes)
    place = np.arange(at[-1]) - at[owner]
    full = place + wide <= sizes[owner]
    owner, place, gram = owner[full], place[full], gram[: at[-1]][full]
    # In order of string and remainder, an end after each.
    ends = np.repeat(np.arange(len(bodies)), wide), np.tile(np.arange(wide), len(bodies))
    who = np.concatenate((owner, ends[0]))
    phase = np.concatenate((place % wide, ends[1]))
    where = np.concatenate((place, np.full(len(ends[0]), np.iinfo(np.int64).max)))
    value = np.concatenate((gram, np.zeros(len(ends[0]), U)))
    is_end = np.concatenate((np.zeros(len(gram), bool), np.ones(len(ends[0]), bool)))
    order = np.lexsort((where, phase, who))
    return np.where(is_end, U(0), value)[order], who[order], np.where(is_end, -1, where)[order]


def repeats(bodies: list[bytes], depth: int) -> list[np.ndarray]:
    """Of each string, the places where ``depth`` bytes start that start elsewhere in the strings, too."""
    wide = WIDE if depth % WIDE == 0 else 1
    parts = [_symbols(bodies[k::SHARDS], wide) for k in range(SHARDS)]
    sizes = [len(p[0]) for p in parts]
    _, rank = np.unique(np.concatenate([np.where(p[2] < 0, U(0), p[0]) for p in parts]), return_inverse=True)
    every = np.where(np.concatenate([p[2] for p in parts]) < 0, 0, rank + 1)
    cuts = np.cumsum(sizes)[:-1]
    source, position, new = merged(np.split(every, cuts), depth // wide)
    many = np.zeros(len(new), bool)
    many[:-1] |= ~new[1:]
    many[1:] |= ~new[1:]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(bodies)
    for k, (_, owner, begin) in enumerate(parts):
        at = position[many & (source == k)]
        who, where = owner[at], begin[at]
        order = np.lexsort((where, who))
        who, where = who[order], where[order]
        edges = np.flatnonzero(np.diff(who, prepend=-1)) if len(who) else who
        for a, b in zip(edges, np.append(edges[1:], len(who)), strict=False):
            out[who[a] * SHARDS + k] = where[a:b]
    return out


def _merges(window: int):
    """doc_id, begin and number of repeated windows, of rows that come together by group."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        ids, begins, counts = [], [], []
        for (doc, begin, n, _), at in zip(rows, repeats([r[3] for r in rows], window), strict=True):
            at = at[at < n]
            if len(at):
                edge = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                size = np.diff(np.append(edge, len(at)))
                ids += [doc] * len(edge)
                begins += (begin + at[edge]).tolist()
                counts += size.tolist()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "begin", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for group, doc, begin, n, body in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if size >= TOGETHER and group != last:
                    yield solve(held)
                    held, size = [], 0
                held.append((doc, begin, n, body))
                size, last = size + len(body), group
        if held:
            yield solve(held)

    return run


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1), SLICE):
                edge = np.zeros(len(data) + 1, np.int64)
                for i in range(b - a):
                    for column in (2, 3):
                        places = batch.column(column)[a + i].as_py()
                        if places:
                            p = np.array(places, np.int64)
                            p = p[(p >> 16) + (p & 0xFFFF) + window - 1 <= offsets[i + 1] - offsets[i]]
                            np.add.at(edge, offsets[i] + (p >> 16), 1)
                            np.add.at(edge, offsets[i] + (p >> 16) + (p & 0xFFFF) + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                heads = offsets[:-1][offsets[:-1] < len(data)]
                first[heads] = gone[heads]
                total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])  # noqa: B023, E731
                left = np.concatenate(([0], np.cumsum(~gone)))[offsets]
                raw = data[~gone].tobytes()
                digests = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(total(gone)), pa.array(total(first)), pa.array(digests)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, *, window: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text)."""
    # A row is known by its id and text, so that rows without an id, or that share one, are texts of their own.
    docs = pick(docs, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    keyed = docs.select(F.col("key").alias("doc_id"), "text")
    place = F.shiftrightunsigned("anchor", 24)
    found = keyed.mapInArrow(_found(window, True), "anchor long, sig long, low long, spot long, n long")
    index = found.repartition(place).groupBy(place.alias("place"), "anchor", "sig").agg(F.min(F.struct("low", "spot")).alias("low"), F.sum("n").alias("n"))
    before, after = F.shiftrightunsigned("anchor", 12).bitwiseAND(F.lit(4095).cast("long")), F.col("anchor").bitwiseAND(F.lit(4095).cast("long"))
    beside = lambda x: (F.count(F.lit(1)).over(Window.partitionBy("place", x)) > 1) & (x > 0)
    index = index.withColumn("more", beside(before) | beside(after)).where("n > 1 or more").select("sig", "low.low", "low.spot", "n", "more")
    parsed = keyed.mapInArrow(_found(window, False), "sig long, anchor long, doc_id long, place long").join(index, "sig")
    # Sets, so that rows that are equal don't hand each of them the places of all.
    whole = F.collect_set(F.when(F.col("n") > 1, F.col("place"))).alias("whole")
    open_ = F.collect_set(F.when(F.col("more") & (F.col("doc_id") == F.col("low")) & (F.col("place") == F.col("spot")), F.struct(place.alias("group"), "place"))).alias("open")
    parsed = checkpointed(parsed.groupBy("doc_id").agg(whole, open_))
    dealt = docs.repartition("key").join(parsed.withColumnRenamed("doc_id", "key"), "key", "left").select("key", "text", "open", "whole", "doc_id")
    parts = dealt.mapInArrow(_snippets(window), "group long, doc_id long, begin long, n long, body binary")
    some = parts.repartition("group").sortWithinPartitions("group").mapInArrow(_merges(window), "doc_id long, begin long, n long")
    spans = some.groupBy("doc_id").agg(F.collect_set(F.shiftleft("begin", 16).bitwiseOR(F.col("n"))).alias("some"))
    out = dealt.join(spans.withColumnRenamed("doc_id", "key"), "key", "left").select("doc_id", "text", "whole", "some")
    return out.mapInArrow(_removed(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS MATERIALIZED (SELECT r, j, substr(x, 1000 * j + 1, 1398) AS part FROM d, generate_series(0, (len(x) - 400) // 1000) AS t(j) WHERE len(x) >= 400),
g AS MATERIALIZED (SELECT r, 500 * j + i AS i, hash(substr(part, 2 * i - 1, 400)) AS h FROM p, generate_series(1, least(500, len(part) // 2 - 199)) AS t(i)),
m AS (SELECT r, i FROM g SEMI JOIN (SELECT h FROM g GROUP BY h HAVING count(*) > 1) USING (h)),
z AS (SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) > 200 AS fresh FROM m),
s AS (SELECT r, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY r ORDER BY i) AS span FROM z),
v AS MATERIALIZED (SELECT r, span, min(i) AS a, max(i) + 200 AS b, row_number() OVER (PARTITION BY r ORDER BY min(i)) AS k FROM s GROUP BY r, span),
c AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM v GROUP BY r)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN x ELSE array_to_string(list_transform(generate_series(1, len(starts) + 1),
    lambda q: substr(x, CASE WHEN q = 1 THEN 1 ELSE 2 * ends[q - 1] - 1 END, CASE WHEN q > len(starts) THEN len(x) ELSE 2 * (starts[q] - 1) END - CASE WHEN q = 1 THEN 0 ELSE 2 * (ends[q - 1] - 1) END)), '') END)) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""
