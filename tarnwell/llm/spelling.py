"""Spelling variants: words of a corpus that are one letter apart, and the commonest form of each.

The vocabulary is a trie, cut by prefix. A prefix with more than ``BLOCK`` words
below it is a node of the upper trie; its children are looked at next (chains of
nodes with one child are one step). Every other
prefix is a block: one task builds the trie of its words and walks it with sets of
active nodes, those at distance 0 or 1 from the node at hand, each child's set made
from its parent's. Two terminal nodes that meet at distance one are a pair.

Pairs that part in the upper trie cross blocks. At a node u of it the active nodes
at distance one are born from two children (one letter for another) or from u and a
child (one letter more). From there on both sides can only follow equal letters,
which for all further levels together is equality of the rest of the word: these
pairs meet under the key (u, rest), which has one word for each letter of the
alphabet at most, and one without.

In this way a pair is found exactly once: at the last node that both words share.

Defined results: a null or empty text has no words; rows that share an id, or have
none, are counted like others (without an id no letter is taken away); repeated rows
count again; texts are read whole; an empty table gives no rows; ties go to the
smaller word by code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.flat import checkpointed
from tarnwell.llm.merkle import CRC_SQL
from tarnwell.llm.text import LOWER, UPPER, pick

WORD = re.compile("[A-Za-zÀ-ÿ]+")
TO_LOWER = str.maketrans(UPPER, LOWER)
#: Words of a block at most; distinct words that a task keeps counts of before it hands them on.
BLOCK, HELD = 4096, 50_000
#: Levels of the trie that are counted at once.
DEPTH = 6
#: How often a form stands for each time its variant does; prefixes whose table is broadcast.
RATIO, FEW = 5, 200_000


def spelled(word: str, doc_id: int | None, slips: int = 199) -> str:
    """The word as the text has it, or, for one pair of a document and a word in ``slips``, without one letter."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    return word if h % slips else word[: h % len(word)] + word[h % len(word) + 1 :]


def vocabulary(docs: DataFrame, *, least_length: int = 6, least_count: int = 5, slips: int | None = 199) -> DataFrame:
    """word and n of all words of the whole texts of ``docs`` (doc_id, text); ``slips`` as in ``spelled``, None for words as they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k, text in enumerate(batch.column(1)):
                found = Counter(w for w in WORD.findall((text.as_py() or "").translate(TO_LOWER)) if len(w) >= least_length)
                for word, n in found.items():
                    form = word if slips is None else spelled(word, ids[k], slips)
                    if len(form) >= least_length:
                        total[form] += n
                if len(total) > HELD:
                    yield out()
        if total:
            yield out()

    words = pick(docs, "doc_id", "text").where("text <> ''").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """The words of a block. A node is a number: its letters' children, its parent's number before it."""

    def __init__(self, words: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for word in words:
            at = 0
            for letter in word:
                down = self.children[at].get(letter)
                if down is None:
                    down = self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                at = down
            self.word[at] = word

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Words at distance one, the smaller first.

        The active nodes of a node are those at distance one from it (itself, at
        distance 0, is understood). A child's are: what its parent's reach by the
        same letter; its parent; the parent's other children; its own children.
        """
        todo: list[tuple[int, frozenset[int] | set[int]]] = [(0, set(self.children[0].values()))]
        while todo:
            node, active = todo.pop()
            own = self.word[node]
            if own is not None:
                for other in active:
                    if (word := self.word[other]) is not None and own < word:
                        yield own, word
            for letter, child in self.children[node].items():
                reached = {down for x in active if (down := self.children[x].get(letter)) is not None}
                reached.add(node)
                reached.update(self.children[node].values())
                reached.update(self.children[child].values())
                reached.discard(child)
                todo.append((child, reached))


def _shared(a: Column, b: Column) -> Column:
    """How many letters two words begin with together."""
    most = F.least(F.length(a), F.length(b))
    return F.when(most > 0, F.size(F.filter(F.sequence(F.lit(1), most), lambda k: F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k)))).otherwise(0)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def _upper(words: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """(word, prefix of its block) and (word, depth) for each node of the upper trie that a word passes.

    The first ``DEPTH`` levels are counted at once. Below, all words of a prefix begin
    like its first and last one, so that a chain of nodes with one child, at which no
    pair is born, is one step.
    """
    levels = F.sequence(F.lit(0), F.least(F.length("word"), F.lit(DEPTH)))
    prefixes = words.select("word", F.explode(levels).alias("depth")).withColumn("prefix", F.substring("word", F.lit(1), F.col("depth")))
    large = checkpointed(prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block).select("prefix"))
    if not large.limit(1).count():
        return words.select("word", F.lit("").alias("prefix")), None
    passed = checkpointed(prefixes.join(_small(large), "prefix").select("word", "depth"))
    last = passed.groupBy("word").agg(F.max("depth").alias("depth"))
    below = checkpointed(last.where(F.length("word") > F.col("depth")).select("word", F.substring("word", F.lit(1), F.col("depth") + 1).alias("prefix"), (F.col("depth") == DEPTH).alias("deep")))
    # A word that ends at a node of the upper trie is a block of its own, which has no pairs.
    blocks, open_ = below.where("not deep").select("word", "prefix"), below.where("deep").select("word", "prefix")
    while open_.limit(1).count():
        sizes = open_.groupBy("prefix").agg(F.count(F.lit(1)).alias("size"), F.min("word").alias("low"), F.max("word").alias("high"))
        sized = open_.join(_small(checkpointed(sizes.select("prefix", "size", _shared(F.col("low"), F.col("high")).alias("depth")))), "prefix")
        blocks = blocks.unionByName(sized.where(F.col("size") <= block).select("word", "prefix"))
        here = checkpointed(sized.where(F.col("size") > block).select("word", "depth"))
        passed = passed.unionByName(here)
        open_ = here.where(F.length("word") > F.col("depth")).select("word", F.substring("word", F.lit(1), F.col("depth") + 1).alias("prefix"))
    return blocks, passed


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """a and b, a < b, of the distinct ``words`` (word) that differ by one letter inserted, deleted or replaced: all, once each."""
    words = checkpointed(words.select("word"))
    blocks, passed = _upper(words, block)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(Trie(rows["word"].tolist()).pairs()), columns=["a", "b"])

    found = blocks.groupBy("prefix").applyInPandas(run, "a string, b string")
    if passed is None:
        return found
    at = F.col("depth") + 1
    whole = passed.select(F.substring("word", F.lit(1), F.col("depth")).alias("node"), F.col("word").substr(at, F.length("word")).alias("rest"), F.lit(None).cast("string").alias("letter"), "word")
    # A word that ends at the node has no letter to follow, but may be the shorter one of a pair.
    less = passed.where(F.length("word") > F.col("depth")).select(F.substring("word", F.lit(1), F.col("depth")).alias("node"), F.col("word").substr(at + 1, F.length("word")).alias("rest"), F.col("word").substr(at, F.lit(1)).alias("letter"), "word")
    met = whole.unionByName(less).groupBy("node", "rest").agg(F.collect_list(F.struct("letter", "word")).alias("meet")).where(F.size("meet") > 1)
    one, two = met.select("rest", "meet", F.explode("meet").alias("x")), F.explode("meet").alias("y")
    both = one.select("rest", "x", two).where(F.col("x.word") < F.col("y.word"))
    # If one side goes on with the very letter that the other has more, they share that letter's node too, and part later.
    first = F.substring("rest", 1, 1)
    later = (F.col("x.letter").isNull() & (F.col("y.letter") == first)) | (F.col("y.letter").isNull() & (F.col("x.letter") == first))
    return found.unionByName(both.where(~F.coalesce(later, F.lit(False))).select(F.col("x.word").alias("a"), F.col("y.word").alias("b")))


def groups(vocabulary: DataFrame, *, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, n, n_near (words near it), form (the commonest near word, if ``ratio`` times as common), form_n and root (the last form) of each of ``vocabulary`` (word, n)."""
    words = checkpointed(vocabulary.select("word", "n"))
    near = checkpointed(near_words(words, block))
    ends = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = F.min_by(F.struct(F.col("b").alias("form"), F.col("m").alias("form_n")), F.struct(-F.col("m"), F.col("b")))
    about = ends.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b").groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    out = words.join(about, "word", "left")
    high = F.col("best.form_n") >= ratio * F.col("n")
    out = checkpointed(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(high, F.col("best.form")).alias("form"), F.when(high, F.col("best.form_n")).alias("form_n")))
    # Forms grow by the ratio, so a chain is short; each round doubles how far a word sees.
    chain = checkpointed(out.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = checkpointed(chain.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not joined.where("moved").limit(1).count():
            break
        chain = joined.select("word", "root")
    return out.join(chain, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return groups(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')), '{UPPER}', '{LOWER}') AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (SELECT w, n, length(w) AS len,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, (octet_length(encode(doc_id || ':' || w)) + 1)::BIGINT), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || w)), (2 * i - 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(c // 256, table_of.t[xor(c % 256, b) + 1])), 4294967295) AS h
  FROM counted, table_of),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % len)::BIGINT) || substr(w, (h % len + 2)::BIGINT) ELSE w END AS word, n FROM hashed) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
less AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS rest, i FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)
"""
