"""MinHash near-duplicates, by a multi-index Hamming join.

A document's set of word shingles has a signature of 32 minima, each kept to 16
bits. The signature is split into 8 chunks of 4 minima. By the pigeonhole
principle a pair that differs in at most 15 minima has a chunk with at most one
error; the chunk's keys leave out each of its minima in turn, which enumerates
all values of the wrong one. So every pair within distance 15 shares a key. (Of
pairs with similarity 0.8, about one in 10^6 is farther apart in every chunk.)
Links are confirmed on the full sets.

Documents with equal sets form a class, of which only the smallest doc_id goes
on. A key's classes are first compared with its smallest; keys of three or more
that still hold several components are then compared in full, in blocks that
hold the sets, so that no rows are made for pairs that prove not to be links.
A pair is compared only under the first key that it shares.

Defined results: a null text, or one without words, has an empty set and is
linked with nothing; repeated rows share a component; a null doc_id is returned
with a null component and kept; other columns are ignored. A doc_id names one
text: of rows that share one and differ in text, each keeps the class of its own
text, and one text's set (the least) is compared for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.flat import STEP, U, checkpointed, mix, ngrams, slices, word_hashes
from tarnwell.llm.text import pick

MINIMA, CHUNKS = 32, 8
#: Rows and shingles of a block of the full comparison, on average.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 500_000
#: Rows up to which ids are broadcast (16 MB).
MAX_BROADCAST_IDS = 1_000_000
FACTORS = mix(np.arange(1, MINIMA + 1, dtype=U) * STEP) | U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of each row's distinct shingles, by row and hash."""
    h, rows, _, _ = word_hashes(data, offsets, lower=True)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    grams = ngrams(h, size)
    m = len(grams)
    whole = rows[:m] == rows[size - 1 : size - 1 + m] if m else np.zeros(0, bool)
    r, g = rows[:m][whole], grams[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        at = np.concatenate(([0], np.cumsum(count)))
        few = np.array([int(ngrams(h[at[i] : at[i + 1]], int(count[i]), seed=int(count[i]))[0]) for i in short], U)
        r, g = np.concatenate((r, short)), np.concatenate((g, few))
    order = np.argsort(g, kind="stable")
    order = order[np.argsort(r[order].astype(np.uint16) if n < 65536 else r[order], kind="stable")]
    r, g = r[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return r[new], g[new]


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                r, g = shingle_sets(data, offsets, size)
                n = np.bincount(r, minlength=b - a)
                held = np.flatnonzero(n)
                sums = np.zeros((b - a, 2), U)
                sig = np.zeros((b - a, MINIMA), np.uint16)
                if len(held):
                    at = np.concatenate(([0], np.cumsum(n)))[held]
                    sums[held, 0] = np.add.reduceat(mix(g), at)
                    sums[held, 1] = np.add.reduceat(mix(g ^ STEP), at)
                    for j, factor in enumerate(FACTORS):
                        sig[held, j] = mix(np.minimum.reduceat(g * factor, at)) & U(0xFFFF)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array([x.tobytes() for x in sums], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["doc_id", "n", "class", "sig"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                r, g = shingle_sets(data, offsets, size)
                at = np.searchsorted(r, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([g[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())], names=["id", "set"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    each = MINIMA // CHUNKS
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, each).astype(U)
        out = np.empty((len(sig), CHUNKS, each), U)
        for gap in range(each):
            rest = [j for j in range(each) if j != gap]
            value = (sig[:, :, rest[0]] << U(32)) | (sig[:, :, rest[1]] << U(16)) | sig[:, :, rest[2]]
            out[:, :, gap] = mix(value ^ mix((np.arange(CHUNKS, dtype=U) * U(each) + U(gap + 1)) * STEP))
        k = CHUNKS * each
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), k)
        slot = np.tile(np.arange(k, dtype=np.int8), len(sig))
        yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(slot), pa.array(ids)], names=["key", "slot", "id"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate((a, b))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(a) + len(b) - common):
                    keep.append(i)
            if keep:
                yield batch.select([0, 1]).take(pa.array(keep))

    return run


def common_shingles(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``, as products of 0-1 matrices over a few columns at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    a_row, b_row = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out
    place = lambda x: np.minimum(np.searchsorted(both, x), len(both) - 1)
    at_a, at_b = place(a), place(b)
    hit_a, hit_b = both[at_a] == a, both[at_b] == b
    at_a, a_row, at_b, b_row = at_a[hit_a], a_row[hit_a], at_b[hit_b], b_row[hit_b]
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    at_a, a_row, at_b, b_row = at_a[order_a], a_row[order_a], at_b[order_b], b_row[order_b]
    for low in range(0, len(both), columns):
        x = np.zeros((len(left), min(columns, len(both) - low)), np.float32)
        y = np.zeros((len(right), x.shape[1]), np.float32)
        s, t = np.searchsorted(at_a, (low, low + columns))
        x[a_row[s:t], at_a[s:t] - low] = 1
        s, t = np.searchsorted(at_b, (low, low + columns))
        y[b_row[s:t], at_b[s:t] - low] = 1
        out += x @ y.T
    return out


def block_links(slot: int, same: bool, left: dict, right: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (larger id, smaller id) of two blocks under one key, of different components, whose first shared key this is."""
    each = MINIMA // CHUNKS
    a, b = left["sig"], right["sig"]
    shape = len(a), len(b)
    first, gap = np.full(shape, CHUNKS, np.int8), np.zeros(shape, np.int8)
    for c in range(CHUNKS):
        wrong, where = np.zeros(shape, np.int16), np.zeros(shape, np.int8)
        for j in range(each):
            differ = a[:, c * each + j, None] != b[None, :, c * each + j]
            wrong += differ
            where[differ] = j
        new = (wrong <= 1) & (first == CHUNKS)
        first[new], gap[new] = c, np.where(wrong == 1, where, 0)[new]
    ok = (first == slot // each) & (gap == slot % each) & (left["comp"][:, None] != right["comp"][None, :])
    if same:
        ok = np.triu(ok, 1)
    n, m = np.array([len(x) for x in left["set"]]), np.array([len(x) for x in right["set"]])
    ok &= 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
    rows, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    common = np.zeros(ok.shape, np.float32)
    common[np.ix_(rows, cols)] = common_shingles([left["set"][i] for i in rows], [right["set"][i] for i in cols])
    ok &= 100 * common >= percent * (n[:, None] + m[None, :] - common)
    p, q = np.nonzero(ok)
    u, v = left["id"][p], right["id"][q]
    return np.maximum(u, v), np.minimum(u, v)


def _blocks(percent: int):
    """Links within each (key, i, j), whose rows come together; a group has two blocks at most."""

    def linked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        i, j, slot = (table[k][0].as_py() for k in ("i", "j", "slot"))
        block = table["block"].to_numpy()
        side = []
        for at in (i, j):
            part = table.filter(pa.array(block == at))
            side.append(
                {
                    "id": part["id"].to_numpy(),
                    "comp": part["comp"].to_numpy(),
                    "sig": np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint16).reshape(-1, MINIMA),
                    "set": [np.frombuffer(x.as_buffer(), U) for x in part["set"]],
                }
            )
        return block_links(slot, i == j, *side, percent) if len(side[0]["id"]) and len(side[1]["id"]) else (np.zeros(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None

        def out(tables: list[pa.Table]) -> pa.RecordBatch:
            u, v = linked(pa.concat_tables(tables))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.stack([table[k].to_numpy() for k in ("key", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, t in zip(cuts[:-1], cuts[1:], strict=True):
                if s == t:
                    continue
                if held and tuple(keys[s]) != now:
                    yield out(held)
                    held = []
                now = tuple(keys[s])
                held.append(table.slice(s, t - s))
        if held:
            yield out(held)

    return run


def components(links: DataFrame) -> DataFrame:
    """id and comp (the smallest id reachable) of every id in ``links`` (a, b), by propagation with pointer jumping."""
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    comp = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")))
    while True:
        near = both.join(comp.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("low"))
        step = comp.join(near, "id").select("id", F.least("comp", "low").alias("low"), F.col("comp").alias("was"))
        jump = step.join(comp.select(F.col("id").alias("low"), F.col("comp").alias("next")), "low", "left")
        new = checkpointed(jump.select("id", F.least("low", F.coalesce("next", "low")).alias("comp"), "was"))
        if not new.where("comp <> was").limit(1).count():
            return new.select("id", "comp")
        comp = new.select("id", "comp")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    docs = pick(docs, "doc_id", "text")
    base = checkpointed(docs.mapInArrow(_signatures(shingle), "doc_id long, n long, class binary, sig binary"))
    held = base.where("n > 0 and doc_id is not null")
    reps = held.groupBy("class").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = checkpointed(reps)
    keyed = reps.select("id", "sig").mapInArrow(_keys, "key long, slot byte, id long")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    keyed = checkpointed(keyed.join(shared.select("key"), "key"))
    wanted = keyed.select("id").distinct()
    few = wanted.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    source = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null").join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    sets = checkpointed(source.mapInArrow(_sets(shingle), "id long, set binary").groupBy("id").agg(F.min("set").alias("set")))
    size = reps.select("id", "n")
    pivot = keyed.groupBy("key").agg(F.min("id").alias("b"))
    pairs = keyed.join(pivot, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    pairs = pairs.join(size.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b")
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    links = checkpointed(rows.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"))
    comp = components(links)

    live = keyed.join(size, "id").join(comp, "id", "left").select("key", "slot", "id", "n", F.coalesce("comp", "id").alias("comp"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    open_keys = live.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("rows"), blocks.alias("blocks")).where("x <> y and rows > 2").select("key", "blocks")
    live = live.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    live = live.join(reps.select("id", "sig"), "id").join(sets, "id")
    dealt = live.select("key", "slot", "id", "comp", "sig", "set", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    more = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_blocks(percent), "a long, b long")
    comp = components(links.union(checkpointed(more)))
    grouped = reps.join(comp, "id", "left").select("class", F.coalesce("comp", "id").alias("_comp"))
    out = base.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class")).alias("class")).join(grouped, "class", "left")
    component = F.coalesce("_comp", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


OP7_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i+3], ' '))))
  WHEN len(w) > 0 THEN [hash(array_to_string(w, ' ') || ' short')] ELSE [] END AS g FROM w),
k AS MATERIALIZED (SELECT min(doc_id) AS rep, len(g) AS n, g FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
e AS MATERIALIZED (SELECT rep, n, unnest(g) AS h FROM k),
p AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, node) AS (SELECT rep, rep FROM k UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.node),
c AS (SELECT id, min(node) AS comp FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(c.comp, s.doc_id) AS component_id, coalesce(coalesce(c.comp, s.doc_id) = s.doc_id, true) AS kept
FROM s LEFT JOIN k ON list_sort(s.g) = k.g AND len(s.g) > 0 LEFT JOIN c ON c.id = k.rep
"""
