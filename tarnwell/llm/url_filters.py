"""URL filters: hosts against a list, by a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 those unlisted keys of the corpus that
level 1 lets through, level 3 the listed keys that level 2 lets through, and so
on until a level lets nothing through. Over the keys it was built on the cascade
is exact, and it is applied as one expression without a join.

Defined results: a null url, or one without ``://``, has an empty host and path,
which no rule fits and the list does not hold; listed keys that the corpus lacks
change nothing; an empty list allows all; repeated rows are each judged.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.flat import checkpointed
from tarnwell.llm.text import ascii_lower, pick

#: Fixed rules: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Host labels whose hosts ``op6_url_filters`` takes as the list.
LISTED_LABELS = ("casino-win", "cheap-pills", "spam-farm")
#: Bits of one level up to which it is a literal of the expression (4 MB); more keys are dealt to several cascades.
MAX_LEVEL_BITS = 1 << 25


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _mix(key: Column, level: int, probe: int) -> Column:
    return F.xxhash64(key, F.lit(level), F.lit(probe))


@dataclass(frozen=True)
class Level:
    """A Bloom filter: bits by slice, to which keys are dealt by hash; ``probes`` bits a key."""

    slices: tuple[tuple[int, ...], ...]
    probes: int

    def holds(self, key: Column, number: int) -> Column:
        def test(words: tuple[int, ...]) -> Column:
            if not words:
                return F.lit(False)
            table = F.from_json(F.lit(json.dumps(words, separators=(",", ":"))), "array<bigint>")
            out = F.lit(True)
            for j in range(self.probes):
                at = F.pmod(_mix(key, number, j), F.lit(64 * len(words)).cast("long"))
                out = out & (F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
            return out

        if len(self.slices) == 1:
            return test(self.slices[0])
        slot = _slot(key, number, len(self.slices))
        out = F.when(slot == 0, test(self.slices[0]))
        for k in range(1, len(self.slices)):
            out = out.when(slot == k, test(self.slices[k]))
        return F.coalesce(out, F.lit(False))


def _slot(key: Column, number: int, slices: int) -> Column:
    return F.pmod(_mix(key, number, -1), F.lit(slices))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...] = ()

    def holds(self, key: Column) -> Column:
        """Whether the key is listed; exact for the keys that the cascade was built on."""
        out = F.lit(False) if len(self.levels) % 2 == 0 else None
        for number in reversed(range(len(self.levels))):
            hit = self.levels[number].holds(key, number)
            if out is None:
                out = hit
            else:
                out = hit & out if number % 2 == 0 else ~(hit & ~out)
        return F.lit(False) if out is None else out

    def passes(self, key: Column) -> Column:
        """Whether all levels so far let the key through."""
        out = F.lit(True)
        for number, level in enumerate(self.levels):
            out = out & level.holds(key, number)
        return out


def build(keys: DataFrame, key: str = "key", listed: str = "listed", *, bits_per_key: float | None = None, max_levels: int = 60) -> Cascade:
    """A cascade over ``keys``: the corpus's complete, distinct keys and whether each is listed.

    ``bits_per_key``: of each level, in place of what the numbers of keys ask for.
    """
    total = keys.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(listed).cast("long")).alias("listed")).first()
    n, others = total["listed"] or 0, total["n"] - (total["listed"] or 0)
    cascade = Cascade()
    for number in range(max_levels):
        # Of the unlisted keys the first level lets through a quarter as many as are listed; the others let an eighth through.
        rate = min(1 / 8, n / max(1, 4 * others)) if number == 0 else 1 / 8
        probes = max(1, round(-math.log2(max(rate, 1e-12)))) if bits_per_key is None else 3
        bits = probes / math.log(2) if bits_per_key is None else bits_per_key
        side = F.col(listed) if number % 2 == 0 else ~F.col(listed)
        todo = keys.where(side & cascade.passes(F.col(key))).select(F.col(key).alias("key"))
        count = todo.count()
        if not count:
            return cascade
        slices = max(1, math.ceil(count * bits / MAX_LEVEL_BITS))
        todo = todo.withColumn("slice", _slot(F.col("key"), number, slices))
        longs = {r["slice"]: max(1, math.ceil(r["n"] * bits / 64)) for r in todo.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()}
        width = F.lit(0)
        for k, w in longs.items():
            width = F.when(F.col("slice") == k, F.lit(64 * w)).otherwise(width)
        at = F.array(*[F.pmod(_mix(F.col("key"), number, j), F.col("width").cast("long")) for j in range(probes)])
        put = todo.withColumn("width", width).select("slice", F.explode(at).alias("at"))
        put = put.groupBy("slice", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("bits"))
        tables = {k: [0] * w for k, w in longs.items()}
        for r in put.toLocalIterator():
            tables[r["slice"]][r["word"]] = r["bits"]
        cascade = Cascade((*cascade.levels, Level(tuple(tuple(tables.get(k, ())) for k in range(slices)), probes)))
    raise RuntimeError(f"the cascade did not end in {max_levels} levels")


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url); ``listed`` (key): the hosts to block, any number of them."""
    host, path = split_url(F.col("url"))
    rows = pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    listed = listed.select(listed["key"].alias("_key")).where("_key is not null").distinct()
    # All hosts of the corpus, once: each level reads them.
    keys = checkpointed(rows.select(F.col("host").alias("key")).distinct().join(listed, F.col("key") == F.col("_key"), "left").select("key", F.col("_key").isNotNull().alias("listed")))
    cascade = build(keys)
    rule = _rule(F.col("host"), F.col("path"), lambda r: F.lit(r[1] + r[2]))
    verdict = F.coalesce(_rule(F.col("host"), F.col("path"), lambda r: F.lit(r[0])), F.when(cascade.holds(F.col("host")), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _rule(host: Column, path: Column, pick_rule) -> Column:
    """``pick_rule(rule)`` of the longest rule that fits, else null."""
    out = None
    for rule in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, pick_rule(rule)) if out is None else out.when(fits, pick_rule(rule))
    return out


def listed_host(host: Column) -> Column:
    return F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_LABELS)))


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    """The list: the hosts of ``pages`` with a label of LISTED_LABELS."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hosts = pages.select(split_url(F.col("url"))[0].alias("key")).where(listed_host(F.col("key")))
    return judge(pages, hosts)


OP6_SQL = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN list_has_any(string_split(host, '.'), ['casino-win', 'cheap-pills', 'spam-farm']) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
