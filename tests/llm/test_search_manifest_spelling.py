"""Exact search, the manifest and spelling variants against loops, and on odd cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import exact_topk, merkle, spelling

VECTORS = "vec_id long, embedding array<float>, label int, id string, v int"  # names that the operator uses itself
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, pos int"


# Exact top-k search


def loop_top(rows, k=5):
    ok = [(i, [np.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q is not None and q % 50 == 0:
            found = [(-int(np.dot(a, b)), c is None, c or 0, c) for c, b in ok if c != q and len(b) == len(a)]
            out += [(q, n + 1, c, -s) for n, (s, _, _, c) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def found_top(spark, rows, **more):
    df = exact_topk.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, **more)
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("block,asked", [(1024, 1024), (40, 3), (7, 2)])
def test_search_against_a_loop(spark, block, asked):
    draw = random.Random(block)
    rows = [(i, [draw.choice((-1.0, -0.5, 0.0, 0.25, draw.gauss(0, 0.3))) for _ in range(6)], i % 3, "x", 1) for i in range(0, 420, 2)]
    rows += [(1000 + i, rows[3][1], 0, None, None) for i in range(30)]  # a vector that many rows have
    assert found_top(spark, rows, block=block, asked=asked) == loop_top(rows)


def test_search_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5], 0, "a", 1), (50, [0.0, 0.0], 0, "a", 1), (50, [1.0, 1.0], 0, "a", 1), (None, [9.0, 9.0], 0, "a", 1), (None, [1.0, 1.0], None, None, None), (1, None, 0, "a", 1), (2, [1.0, None], 0, "a", 1), (3, [inf, 0.0], 0, "a", 1), (4, [nan, 0.0], 0, "a", 1), (5, [1.0, 1.0, 1.0], 0, "a", 1), (6, [], 0, "a", 1), (100, [], 0, "a", 1), (7, [-0.001, 0.0], 0, "a", 1), (8, [1e6, -1e6], 0, "a", 1), (150, [1e6, 1e6], 0, "a", 1)]
    assert found_top(spark, rows) == loop_top(rows)
    assert found_top(spark, rows, block=2, asked=1) == loop_top(rows)
    assert found_top(spark, rows[:1]) == [] == found_top(spark, [])


def test_lists_stop_early_and_only_when_they_may():
    draw = np.random.default_rng(1)
    vectors = np.floor(draw.standard_normal((2000, 4)) * 256)
    lists = exact_topk.Lists(np.arange(2000), vectors)
    place, ids, scores, read = lists.top(vectors[:20], np.arange(20), 5)
    for q in range(20):
        all_ = vectors @ vectors[q]
        all_[q] = -np.inf
        best = np.lexsort((np.arange(2000), -all_))[:5]
        assert ids[place == q].tolist() == best.tolist() and scores[place == q].tolist() == all_[best].tolist()
    assert (read < 2000).all()  # the bound stopped all
    assert not len(lists.top(vectors[:20], np.arange(20), 5, scores[place.searchsorted(np.arange(20))] + 1)[0])
    # equal to the bound is not below it: the smaller id stands last in the list
    same = exact_topk.Lists(np.arange(100), np.ones((100, 3)))
    assert same.top(np.ones((1, 3)), np.array([0]), 5)[1].tolist() == [1, 2, 3, 4, 5]


# The manifest


def loop_manifest(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, add=0: h(enc(r[0]), enc(r[3]), enc(r[2]), enc(None if r[4] is None else r[4] + add), enc(r[1]))

    def up(nodes):
        ways, row = [[] for _ in nodes], [(x, [k]) for k, x in enumerate(nodes)]
        while len(row) > 1:
            after = []
            for k in range(0, len(row), 2):
                pair = row[k : k + 2]
                for side, (_, members) in enumerate(pair):
                    for m in members:
                        ways[m].append((side, pair[1 - side][0] if len(pair) == 2 else ""))
                after.append((h(*[x for x, _ in pair]), [m for _, members in pair for m in members]))
            row = after
        return ways, row[0][0]

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs]
    inner = [up([leaf(r) for r in g]) for g in groups]
    outer, root = up([s for _, s in inner])
    out = []
    for g, (ways, subroot), above in zip(groups, inner, outer, strict=True):
        for r, way in zip(g, ways, strict=True):
            at = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for side, x in way + above:
                at = h(x, at) if side else h(at, x)
            out.append((r[0], leaf(r), subroot, root, h(*[x for _, x in way + above]), at, at == root))
    return sorted(out, key=repr)


def found_manifest(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


def odd_docs(n):
    rows = [(i * 3, f"text é {i}", "en" if i % 3 else "de", "web", i, "x", 1) for i in range(n)]
    rows += [(None, "no id", "en", None, None, None, None), (None, None, None, None, None, None, None), (5, "", "", "", 0, "", 0), (7, "x" * 100_000, "zz", "s", 2**63 - 1, "", 0), (7, "x", "zz", "s", None, "", 0), (9, "漢字", "ÿ", "s", -1, "", 0)]
    return rows + [rows[4]] * 3  # repeated rows


@pytest.mark.parametrize("bits,top", [(10, 16_384), (2, 3), (1, 1)])
def test_manifest_against_a_loop(spark, tmp_path, monkeypatch, bits, top):
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "BLOCK", 1 << bits)
    monkeypatch.setattr(merkle.manifest, "__kwdefaults__", {**merkle.manifest.__kwdefaults__, "top": top})
    rows = odd_docs(45)
    assert found_manifest(spark, [r for r in rows if r[4] != 2**63 - 1], tmp_path) == loop_manifest([r for r in rows if r[4] != 2**63 - 1])


def test_manifest_of_one_and_none(spark, tmp_path):
    one = odd_docs(1)[:1]
    assert found_manifest(spark, one, tmp_path) == loop_manifest(one)
    assert found_manifest(spark, [], tmp_path) == []
    assert len(found_manifest(spark, odd_docs(1), tmp_path)) == len(odd_docs(1))


def test_manifest_other_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, g string")
    got = {r["k"]: r for r in merkle.manifest(df, fields=["k"], group="g", order="k").collect()}
    leaf = {k: merkle.H(f"1:{k}") for k in (1, 2, 3)}
    assert got[1]["subroot"] == merkle.H(leaf[1], leaf[3]) and got[2]["subroot"] == leaf[2]
    assert {r["root"] for r in got.values()} == {merkle.H(got[1]["subroot"], leaf[2])}


# Spelling variants


def loop_words(rows):
    count = Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
            if i is not None:
                h = zlib.crc32(f"{i}:{w}".encode())
                if h % 199 == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def beside(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def loop_variants(words):
    near = {w: [v for v in words if beside(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v if words[v] >= 5 * words[w] else None for w, v in best.items()}

    def root(w):
        while form.get(w):
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if form.get(w) else None) for w, n in words.items()), key=repr)


def spelling_docs(seed=3):
    draw = random.Random(seed)
    base = ["letters", "lettere", "aaaaaaa", "aaaaaa", "aaaaaaaa", "baaaaaa", "aabaaaa", "éèàüöß", "éèàüöñ", "straße×", "planet", "planets", "planète", "lanets", "x" * 5000, "x" * 5001]
    for w in base[:12]:
        k = draw.randrange(len(w))
        base += [w[:k] + w[k + 1 :], w[:k] + draw.choice("abeé") + w[k:], w[:k] + draw.choice("abeé") + w[k + 1 :]]
    text = lambda: " ".join(draw.choice(base).upper() if draw.random() < 0.05 else base[min(len(base) - 1, int(draw.expovariate(0.12)))] for _ in range(120))
    rows = [(i, text(), "en", "s", 1, "x", 1) for i in range(40)]
    return rows + [(None, rows[0][1], None, None, None, None, None), rows[1], rows[1], (99, None, None, None, None, None, None), (98, "", "", "", 0, "", 0), (97, "1234 -- ...", "", "", 0, "", 0)]


@pytest.mark.parametrize("block", [4096, 20])
def test_variants_against_a_loop(spark, block):
    rows = spelling_docs()
    words = loop_words(rows)
    vocabulary = spelling.vocabulary(spark.createDataFrame(rows, DOCS))
    assert dict(map(tuple, vocabulary.collect())) == words
    got = spelling.groups(vocabulary, block=block).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=repr) == loop_variants(words)


@pytest.mark.parametrize("block", [20, 5])
def test_near_words_once_each(spark, block):
    long = ["q" * 300 + x for x in "aeiouxyz"]
    words = ["".join(x) for n in (0, 1, 3, 4) for x in itertools.product("abé", repeat=n)] + long
    got = sorted(map(tuple, spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), block).collect()))
    assert got == sorted((a, b) for a in words for b in words if a < b and beside(a, b))


def test_variants_of_nothing(spark):
    assert spelling.groups(spelling.vocabulary(spark.createDataFrame([], DOCS))).collect() == []
    assert spelling.groups(spelling.vocabulary(spark.createDataFrame([(1, "short words only", "", "", 0, "", 0)], DOCS))).collect() == []
