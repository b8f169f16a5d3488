"""A Merkle manifest of a dataset: a tree of hashes for each group, a tree over the groups, and a proof for each row.

Every row is a leaf, the hash of some of its columns. Within a group leaves stand
in order; every two neighbours become their hash, a last one alone too, until one
node, the subroot, is left. Subroots in order of their groups give the root alike.

Leaves are cut into blocks of ``BLOCK`` places. A block is reduced by one task,
which also writes the way up from each leaf; what is left is a node a block. While
there are more than ``TOP`` of those they are nodes of the same reduction. The
driver builds the trees over the last ones, ``TOP`` at most, and their ways up are
broadcast; executors append them and fold every row.

Defined results: a null column is hashed as ``-``, an empty one as ``0:``; a null
group is the first, null ids stand before others; rows that are equal in every
hashed column have equal hashes, but places of their own, so their proofs may
differ; rows with one id and different columns stand in the order of their hashes;
an empty table gives no rows; columns that aren't named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.flat import checkpointed
from tarnwell.llm.text import pick
from tarnwell.operators.graph import numbered

#: Bits of a place in a block, and nodes that the driver takes at most (their ways, 14 hashes each, are 16 MB).
BITS, TOP = 10, 16_384
BLOCK = 1 << BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The nodes beside a row's way to the root: each one's hash (empty where it has none), and whether it stands to the left.
WAY = "array<struct<left: boolean, hash: string>>"


def H(*parts: str) -> str:  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon and itself; null is a minus."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def folded(hash_: Column, way: Column) -> Column:
    """The node that a leaf and its way up lead to."""
    return F.aggregate(way, hash_, lambda at, x: F.sha2(F.when(x["left"], F.concat(x["hash"], at)).otherwise(F.concat(at, x["hash"])), 256))


def proof(way: Column) -> Column:
    """The hash of the hashes beside the way, from the leaf up."""
    return F.sha2(F.concat_ws("", F.transform(way, lambda x: x["hash"])), 256)


def ways(hashes: Sequence[str], levels: int | None = None) -> tuple[list[list[dict]], str]:
    """The way up from each of some nodes, and the node they lead to; ``levels`` raises it further, as a part of a larger row of nodes."""
    out: list[list[dict]] = [[] for _ in hashes]
    row, level = list(hashes), 0
    while len(row) > 1 if levels is None else level < levels:
        for place, steps in enumerate(out):
            k = place >> level
            beside = k ^ 1
            steps.append({"left": bool(k & 1), "hash": row[beside] if beside < len(row) else ""})
        row = [H(*row[k : k + 2]) for k in range(0, len(row), 2)]
        level += 1
    return out, row[0]


def _reduced(nodes: DataFrame) -> DataFrame:
    """``nodes`` (grp, pos, n, hash) with block and the way to the block's node."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        rows["way"], _ = ways(rows["hash"].tolist(), None if rows["n"].iloc[0] <= BLOCK else BITS)
        return rows

    return nodes.select("grp", "pos", "n", "hash", F.shiftright("pos", BITS).alias("block")).groupBy("grp", "block").applyInPandas(run, f"grp string, pos long, n long, hash string, block long, way {WAY}")


def _tops(nodes: list) -> Iterator[tuple]:
    """(grp, pos, way, node it leads to) of a bounded number of nodes, by group and place."""
    groups: dict[str, list] = {}
    for r in nodes:
        groups.setdefault(r["grp"], []).append(r)
    for grp, rows in groups.items():
        rows.sort(key=lambda r: r["pos"])
        found, top = ways([r["hash"] for r in rows])
        for r, way in zip(rows, found, strict=True):
            yield grp, r["pos"], way, top


def trees(nodes: DataFrame, top: int = TOP) -> DataFrame:
    """grp, pos, hash, way and root of every node of every group's tree; ``nodes`` are grp, pos (from 0), n (of the group), hash."""
    below = checkpointed(_reduced(nodes))
    heads = below.where(F.col("pos") % BLOCK == 0).select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), folded(F.col("hash"), F.col("way")).alias("hash"))
    heads = checkpointed(heads)
    schema = f"grp string, block long, above {WAY}, root string"
    if heads.count() <= top:
        above = F.broadcast(nodes.sparkSession.createDataFrame(list(_tops(heads.collect())), schema))
    elif not heads.where("n > 1").limit(1).count():
        above = heads.select("grp", F.col("pos").alias("block"), F.lit(None).cast(WAY).alias("above"), F.col("hash").alias("root"))
    else:
        above = trees(heads, top).select("grp", F.col("pos").alias("block"), F.col("way").alias("above"), "root")
    return below.join(above, ["grp", "block"]).select("grp", "pos", "hash", F.concat("way", F.coalesce("above", F.array().cast(WAY))).alias("way"), "root")


def manifest(rows: DataFrame, *, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, top: int = TOP) -> DataFrame:
    """``order``, ``group``, leaf, subroot, root and way (to the root) of every row, and the columns ``carry`` makes of it."""
    carry = carry or {}
    made = rows.select(F.col(order).alias("_order"), F.col(group).alias("_group"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"), leaf([F.col(f) for f in fields]).alias("hash"), *[c.alias(f"_c{k}") for k, c in enumerate(carry.values())], F.monotonically_increasing_id().alias("_row"))
    made = checkpointed(made)  # texts are read once, and rows keep their numbers
    placed = numbered(made, F.col("grp"), F.col("_order").asc_nulls_first(), F.col("hash"), F.col("_row"), name="_nr")
    groups = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("_nr").alias("_first"))
    groups = checkpointed(groups)
    few = groups.count() <= top
    small = F.broadcast if few else (lambda df: df)
    placed = checkpointed(placed.join(small(groups), "grp").withColumn("pos", F.col("_nr") - F.col("_first")))
    within = trees(placed.select("grp", "pos", "n", "hash"), top)
    subroots = checkpointed(within.where("pos = 0").select("grp", F.col("root").alias("subroot")))
    named = numbered(subroots, F.col("grp"), name="pos")
    over = trees(named.select(F.lit("").alias("grp"), "pos", F.lit(groups.count()).alias("n"), F.col("subroot").alias("hash")), top)
    over = named.join(over.select("pos", F.col("way").alias("above"), F.col("root").alias("all")), "pos").select("grp", "subroot", "above", "all")
    out = placed.join(within.select("grp", "pos", "way"), ["grp", "pos"]).join(small(over), "grp")
    return out.select(F.col("_order").alias(order), F.col("_group").alias(group), F.col("hash").alias("leaf"), "subroot", F.col("all").alias("root"), F.concat("way", "above").alias("way"), *[F.col(f"_c{k}").alias(name) for k, name in enumerate(carry)])


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), *FIELDS)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(touched, leaf([F.try_add("n_chars", F.lit(1)) if f == "n_chars" else F.col(f) for f in FIELDS]))
    found = manifest(docs, carry={"tampered": tampered})
    out = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("way")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("way")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: A CRC of a short text of digits, byte by byte through the table that its polynomial gives.
CRC_SQL = """table_of AS (
  SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i))"""
OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
docs AS (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS grp,
    COALESCE(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || COALESCE(strlen(source) || ':' || source, '-') || COALESCE(strlen(lang) || ':' || lang, '-') AS front,
    COALESCE(strlen(text) || ':' || text, '-') AS back,
    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c // 256, table_of.t[xor(c % 256, b) + 1])), 4294967295) % 7 = 0 AS touched
  FROM documents, table_of),
leaves AS (SELECT doc_id, grp, sha256(front || COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || back) AS leaf,
    CASE WHEN touched THEN sha256(front || COALESCE(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || back) END AS tampered,
    row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n
  FROM docs),
inner_tree AS (
  SELECT grp, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT grp, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM inner_tree WHERE n > 1 GROUP BY grp, lvl, n, pos // 2),
subroots AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM inner_tree WHERE n = 1),
outer_tree AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM outer_tree WHERE n > 1 GROUP BY lvl, n, pos // 2),
steps AS (
  SELECT l.grp, l.pos, t.lvl, (l.pos >> t.lvl) % 2 = 1 AS on_right, s.h
  FROM leaves l JOIN (SELECT DISTINCT grp, lvl FROM inner_tree WHERE n > 1) t ON t.grp = l.grp
  LEFT JOIN inner_tree s ON s.grp = l.grp AND s.lvl = t.lvl AND s.pos = xor(l.pos >> t.lvl, 1::BIGINT)
  UNION ALL
  SELECT l.grp, l.pos, 1000 + t.lvl, (b.pos >> t.lvl) % 2 = 1, s.h
  FROM leaves l JOIN subroots b ON b.grp = l.grp, (SELECT DISTINCT lvl FROM outer_tree WHERE n > 1) t
  LEFT JOIN outer_tree s ON s.lvl = t.lvl AND s.pos = xor(b.pos >> t.lvl, 1::BIGINT)),
ways AS (SELECT grp, pos, list(CASE WHEN on_right THEN '1' ELSE '0' END || COALESCE(h, '') ORDER BY lvl) AS way FROM steps GROUP BY grp, pos),
whole AS (SELECT l.*, COALESCE(w.way, []) AS way, b.subroot, (SELECT h FROM outer_tree WHERE n = 1) AS root
  FROM leaves l LEFT JOIN ways w USING (grp, pos) JOIN subroots b USING (grp)),
fold AS (SELECT *, list_reduce([COALESCE(tampered, leaf)] || way, lambda a, x: sha256(CASE WHEN x[1] = '1' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(COALESCE(list_aggregate(list_transform(way, lambda x: x[2:]), 'string_agg', ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM fold
"""
