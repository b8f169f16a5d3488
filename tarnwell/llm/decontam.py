"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words; its hash leaves out the positions
marked 0, so that a replaced word there does not matter. Seeds of the benchmark
items and of the training texts are joined on their hash. Around each hit the
words of both sides are laid side by side; a stretch of ``length`` words that
holds the seed and has at least ``percent`` per cent equal words is a leak. With
the default ``length`` and ``percent`` every such stretch holds a seed.

Defined results: texts are compared in lower case (A-Z); a null text or item has
no words; items of fewer than ``length`` words can't leak; repeated items count
once by item_id; documents without leak are returned with an empty list; rows
that share a doc_id (null is one value) share the leaks found in any of them.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.text import ascii_lower, let, pick, words

#: Fixed masks; 0 marks a word that the hash ignores. Of 13 words, whichever two are replaced, some mask stays whole.
MASKS = ("1101110011", "1001111101", "11010010111")
#: Seeds of the benchmark up to which their filter and table are broadcast (about 40 MB).
MAX_BROADCAST_SEEDS = 200_000


def _hash(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(w, i + o) for o, c in enumerate(MASKS[k]) if c == "1"])


def _around(w: Column, i: Column, length: int) -> Column:
    """The words at offsets from the seed's start that any stretch holding the seed can have; null outside the text."""
    low = length - min(map(len, MASKS))
    return F.transform(F.sequence(F.lit(-low), F.lit(length - 1)), lambda o: F.get(w, i + o))


def _seeds(df: DataFrame, key: str, text: str, length: int, keep=None) -> DataFrame:
    """A row for each seed: key, hash, at, around. ``keep``: which hashes to go on with."""

    def found(w: Column) -> Column:
        parts = []
        for k, mask in enumerate(MASKS):
            at_each = lambda k: lambda i: F.struct(_hash(w, i, k).alias("hash"), i.alias("at"))
            one = F.transform(F.sequence(F.lit(0), F.size(w) - len(mask)), at_each(k))
            one = F.filter(one, lambda s: keep(s["hash"])) if keep else one
            parts.append(F.when(F.size(w) >= len(mask), one).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>")))
        return F.transform(F.concat(*parts), lambda s: F.struct(s["hash"].alias("hash"), s["at"].alias("at"), _around(w, s["at"], length).alias("around")))

    rows = df.select(df[key].alias(key), F.explode(let(words(ascii_lower(df[text])), found)).alias("s"))
    return rows.select(key, "s.hash", "s.at", "s.around")


def _bits(hashes: list[int]):
    """A test whether a hash may be among ``hashes``, from a bitmap with two probes each."""
    size = max(10, math.ceil(math.log2(16 * max(1, len(hashes)))))
    table = [0] * (1 << (size - 6))
    probes = lambda h: ((h & (2**64 - 1)) >> (64 - size), h & ((1 << size) - 1))
    for h in hashes:
        for p in probes(h):
            table[p >> 6] |= 1 << (p & 63)
    table = [x - 2**64 if x >= 2**63 else x for x in table]
    literal = F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<bigint>")

    def bit(p: Column) -> Column:
        return F.getbit(F.get(literal, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    return lambda h: bit(F.shiftrightunsigned(h, 64 - size)) & bit(h.bitwiseAND(F.lit((1 << size) - 1).cast("long")))


def leaks(docs: DataFrame, benchmark: DataFrame, *, length: int = 13, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, item_id, at (first word of the seed), matched (equal words in the best stretch) of each verified hit."""
    bench = pick(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    bench = bench.where(F.size(words(F.col("text"))) >= length).dropDuplicates()
    items = _seeds(bench, "item_id", "text", length).withColumnsRenamed({"at": "item_at", "around": "item_around"})
    hashes = [r[0] for r in items.select("hash").distinct().limit(MAX_BROADCAST_SEEDS + 1).collect()]
    small = len(hashes) <= MAX_BROADCAST_SEEDS and items.limit(4 * MAX_BROADCAST_SEEDS + 1).count() <= 4 * MAX_BROADCAST_SEEDS
    body = docs.select(docs["doc_id"].alias("doc_id"), docs[text].alias("_text"))
    seeds = _seeds(body, "doc_id", "_text", length, _bits(hashes) if small else None)
    pairs = seeds.join(F.broadcast(items) if small else items, "hash")
    equal = F.zip_with("around", "item_around", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    low = length - min(map(len, MASKS))
    best = let(equal, lambda e: F.array_max(F.transform(F.sequence(F.lit(1), F.lit(low + 1)), lambda s: F.aggregate(F.slice(e, s, length), F.lit(0), lambda a, x: a + x))))
    out = pairs.select("doc_id", "item_id", "at", best.alias("matched"))
    return out.where(100 * F.col("matched") >= percent * length)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with ``contaminated``, ``items`` (sorted item ids), ``n_hits`` and ``matched`` (of the best stretch)."""
    found = leaks(docs, benchmark, **options).groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.count(F.lit(1)).alias("n_hits"), F.max("matched").alias("matched"))
    out = docs.drop("items", "n_hits", "matched", "contaminated").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select(
        *[c for c in out.columns if c not in ("_id", "items", "n_hits", "matched")],
        F.col("n_hits").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"),
        F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
    )


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.count(F.lit(1)).alias("n_hits"), F.max("matched").alias("matched"))
    out = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.col("n_hits").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"))


OP3_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, w FROM (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) >= 13),
m(k, offsets, width) AS (VALUES (0, [0, 1, 3, 4, 5, 8, 9], 10), (1, [0, 3, 4, 5, 6, 7, 9], 10), (2, [0, 1, 3, 6, 8, 9, 10], 11)),
x AS MATERIALIZED (SELECT DISTINCT item_id, k, i, hash(array_to_string(list_transform(offsets, lambda o: w[i + o]), ' ')) AS h FROM b, m, generate_series(1, len(w) - width + 1) AS t(i)),
y AS MATERIALIZED (SELECT doc_id, k, i, hash(array_to_string(list_transform(offsets, lambda o: w[i + o]), ' ')) AS h FROM d, m, generate_series(1, len(w) - width + 1) AS t(i)),
j AS (SELECT y.doc_id, x.item_id, y.i AS pos, x.i AS item_pos FROM x JOIN y USING (k, h)),
q AS (SELECT j.doc_id, j.item_id, list_max(list_transform(generate_series(-3, 0), lambda s: list_sum(list_transform(generate_series(0, 12),
  lambda o: CASE WHEN pos + s + o >= 1 AND item_pos + s + o >= 1 AND d.w[pos + s + o] = b.w[item_pos + s + o] THEN 1 ELSE 0 END)))) AS matched
  FROM j JOIN d USING (doc_id) JOIN b USING (item_id)),
f AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items, count(*) AS n_hits, max(matched) AS matched FROM q WHERE 100 * matched >= 80 * 13 GROUP BY doc_id)
SELECT doc_id, n_hits IS NOT NULL AS contaminated, coalesce(items, []) AS items, CAST(coalesce(n_hits, 0) AS BIGINT) AS n_hits, CAST(coalesce(matched, 0) AS BIGINT) AS matched
FROM d LEFT JOIN f USING (doc_id)
"""
