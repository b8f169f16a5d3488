"""Each operator against a brute-force version on small fixtures, and on the cases that must not crash it."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import bwt_dedup, decontam, flat, html_extract, licenses, lm_scoring, minhash, mixing, quality_rules, rlz_dedup, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st".split()


def prose(draw, n):
    return " ".join("".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 4))) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repeats inside a text, and odd cases."""
    draw = random.Random(seed)
    texts = [prose(draw, draw.choice((3, 14, 80, 200))) for _ in range(n)]
    passage = prose(draw, 60)
    for i in range(0, n, 6):
        texts[i] = f"{prose(draw, 20)}\n{passage}\n{prose(draw, 15)}"
    texts += [texts[5], texts[5]]
    words = texts[6].split(" ")
    for k in range(4):
        near = list(words)
        near[10 + 7 * k] = "changed"
        texts.append(" ".join(near))
    texts += ["", " \t\n ", "one", "Two words", "line\nline\nother\nline", "aé ß漢字 " * 40, prose(draw, 30) + "\x0b" + "x" * 3000]
    loop = prose(draw, 40)
    texts.append(f"{loop} between {loop}")
    return list(enumerate(texts))


#: Columns whose names the operators use inside.
CLASHING = ("n", "sig", "class", "key", "block", "size", "rank", "items", "place", "group", "id", "file", "low", "sure", "whole", "kept", "_w", "_text")


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING]) if extra else df


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


ODD = [(1, None), (2, ""), (None, "a text without an id " * 20), (None, None), (3, "same words " * 30), (3, "same words " * 30), (4, "x" * 200_000), (5, "a longer text of the same id " * 60), (5, "short"), (6, "a longer text of the same id " * 60)]


def test_word_hashes_follow_words():
    texts = [t for _, t in corpus()]
    import pyarrow as pa

    for most in (1, 200, 1 << 20):
        got = defaultdict(list)
        for a, _, data, offsets in flat.slices(pa.array(texts), most):
            h, r, s, e = flat.word_hashes(data, offsets)
            for x, i, p, q in zip(h, r, s, e, strict=True):
                got[a + i].append((int(x), data[p:q].tobytes().decode()))
        seen = {}
        for i, t in enumerate(texts):
            assert [w for _, w in got[i]] == WORD.findall(t)
            for x, w in got[i]:
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_quality_statistics(docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.with_statistics(docs.select("doc_id", "text")).collect()}
    for i, t in rows:
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))


def test_quality_rules_learn_and_generalise(spark):
    draw = random.Random(3)
    rows = [(i, prose(draw, 120) if i % 3 else " | ".join(prose(draw, 1) for _ in range(90))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _ in rows] + [(999, None, None)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows, extra=False)
    rules = quality_rules.fit(df.where("doc_id < 200"), labels, base=False)
    assert rules.rules
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, rules, base=False).collect()}
    assert all(kept[i] == (i % 3 != 0) for i in range(200, 300))
    empty = quality_rules.fit(df.limit(0), labels.limit(0))
    assert empty.rules == () and quality_rules.judge(df, empty, base=False).where("kept").count() == 300


def test_decision_list_columns(spark):
    rules = quality_rules.DecisionList(((quality_rules.Literal("x", True, 5.0),), (quality_rules.Literal("x", False, 1.0), quality_rules.Literal("y", True, 0.0))))
    df = spark.createDataFrame([(6.0, 0.0), (1.0, 1.0), (1.0, 0.0), (3.0, 9.0)], "x double, y double")
    assert [r[0] for r in df.select(rules.rule_column()).collect()] == [1, 2, 0, 0]


def test_lm_scores_are_probabilities(spark, docs, rows):
    got = {r["doc_id"]: r for r in lm_scoring.score(docs).collect()}
    train = Counter()
    texts = 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(WORD.findall(t.translate(LOWER)))
            texts += 1
    train["\n"] = texts
    n, v = sum(train.values()), len(train)
    for i, t in rows:
        words = [*WORD.findall(t.translate(LOWER)), "\n"]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(train[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words))
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_decontamination(spark):
    draw = random.Random(5)
    items = [(k, prose(draw, 40)) for k in range(8)] + [(8, "too short to leak"), (9, None), (None, prose(draw, 30))]
    clean = [prose(draw, 100) for _ in range(20)]
    leaks = {}
    for k in range(8):
        words = items[k][1].upper().split(" ")
        for at in range(4, 40, 9):  # a word of each nine is replaced
            words[at] = "other"
        leaks[100 + k] = f"{prose(draw, 30)}\n{' '.join(words)} {prose(draw, 5)}"
    leaks[200] = " ".join(items[3][1].split(" ")[10:26])
    rows = [*enumerate(clean), *leaks.items(), (300, None), (301, ""), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(frame(spark, rows), bench).collect()}
    assert {k for k, r in got.items() if r["contaminated"]} == {*leaks, None}
    assert all(got[100 + k]["items"] == [k] for k in range(8)) and got[200]["items"] == [3]
    assert decontam.decontaminate(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    # The way for benchmarks that are too large to broadcast gives the same.
    most, decontam.MAX_BROADCAST_SEEDS = decontam.MAX_BROADCAST_SEEDS, 0
    try:
        again = decontam.decontaminate(frame(spark, rows), bench)
        assert {r["doc_id"] for r in again.where("contaminated").collect()} == {*leaks, None}
    finally:
        decontam.MAX_BROADCAST_SEEDS = most


def test_every_pair_of_substitutions_leaves_a_seed(spark):
    draw = random.Random(6)
    item = [f"{w}{k}" for k, w in enumerate(prose(draw, 13).split(" "))]
    rows = []
    for a in range(13):
        for b in range(a + 1, 13):
            words = list(item)
            words[a], words[b] = "other", "another"
            rows.append((13 * a + b, " ".join(words)))
    three = ["other" if k in (0, 6, 12) else w for k, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"] for r in decontam.leaks(frame(spark, [*rows, (999, " ".join(three))]), bench).collect()}
    assert len(rows) == 78 and got == {i for i, _ in rows}


def brute_words(rows, window=13):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t)
        gone = set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if seen.setdefault(g, i) < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_word_repeats_against_brute_force(docs, rows):
    want = brute_words(rows)
    got = {r[0]: tuple(r)[1:] for r in rlz_dedup.remove_repeats(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 400


def test_word_repeats_keep_texts(spark, rows):
    df = frame(spark, rows, extra=False).withColumn("lang", F.lit("en"))
    out = {r["doc_id"]: r for r in rlz_dedup.remove_repeats(df, carry=("lang",)).collect()}
    want = brute_words(rows)
    for i, t in rows:
        r = out[i]
        assert r["lang"] == "en" and hashlib.sha256(" ".join(WORD.findall(r["kept_text"])).encode()).hexdigest() == want[i][2]
        if not r["n_removed"]:
            assert r["kept_text"] == t


def brute_bytes(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + window] for _, b in texts for k in range(len(b) - window + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [200, 56])
def test_byte_repeats_against_brute_force(docs, rows, window):
    assert sorted(map(tuple, bwt_dedup.remove_repeats(docs, window=window).collect())) == sorted(brute_bytes(rows, window))


def test_byte_repeats_of_rows_that_share_an_id_or_have_none(spark):
    rows = [*ODD, (None, "the same six hundred bytes, " * 22), (7, "the same six hundred bytes, " * 22), (None, "z" * 150 + "a text of its own, unlike all others " * 4)]
    got = sorted(map(repr, map(tuple, bwt_dedup.remove_repeats(frame(spark, rows)).collect())))
    assert got == sorted(map(repr, brute_bytes(rows, 200)))


def test_merged_transforms_find_repeats():
    draw = random.Random(2)
    for depth in (1, 3, 8, 16):
        bodies = [bytes(draw.choice(b"ab\0") for _ in range(draw.randint(0, 60))) for _ in range(9)]
        count = Counter(b[k : k + depth] for b in bodies for k in range(len(b) - depth + 1))
        want = [[k for k in range(len(b) - depth + 1) if count[b[k : k + depth]] > 1] for b in bodies]
        assert [x.tolist() for x in bwt_dedup.repeats(bodies, depth)] == want
    text = np.array([3, 1, 3, 1, 0, 1, 3, 0])
    ends = lambda k: tuple(text[k : k + list(text[k:]).index(0) + 1])
    order = bwt_dedup.suffix_array(text).tolist()
    assert sorted(order) == list(range(8)) and [ends(k) for k in order] == sorted(ends(k) for k in range(8))


def test_url_filters(spark):
    urls = ["https://A.Example.net/en/x?y#z", "http://shop.example.com/de/", "x.net/no/scheme", None, "ftp://net", "http://net/", "http://a.org/fr/b", "https://www.casino-win.example.org/en/1", "https://spam-farm.example.net/q", "https://ok.example.org/#f", "http://notexample.net.org/", ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = url_filters.split_url(F.col("url"))
    got = [tuple(r) for r in df.select(host, path).orderBy("page_id").collect()]
    assert got[0] == ("a.example.net", "/en/x") and got[2] == ("", "") and got[3] == ("", "") and got[4] == ("net", "") and got[9] == ("ok.example.org", "/")
    keys = spark.range(4000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    cascade = url_filters.build(keys, bits_per_key=4)
    assert len(cascade.levels) > 1
    assert keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    exact = url_filters.build(keys)
    assert len(exact.levels) > 1 and keys.where(exact.holds(F.col("key")) != F.col("listed")).count() == 0
    assert url_filters.build(keys.where("not listed")).levels == ()
    most, url_filters.MAX_LEVEL_BITS = url_filters.MAX_LEVEL_BITS, 500
    try:
        dealt = url_filters.build(keys)
        assert len(dealt.levels[0].slices) > 1 and len(dealt.levels[1].slices) > 1 and keys.where(dealt.holds(F.col("key")) != F.col("listed")).count() == 0
    finally:
        url_filters.MAX_LEVEL_BITS = most


def test_url_filters_by_a_list(spark):
    draw = random.Random(9)
    hosts = [f"h{draw.randint(0, 400)}.org" for _ in range(900)] + ["", None]
    rows = [(i if i % 7 else None, h if h is None or not h else f"http://{h}/x") for i, h in enumerate(hosts)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit("clash").alias(c) for c in ("host", "key", "listed", "slice", "verdict")])
    bad = {f"h{k}.org" for k in range(0, 400, 3)} | {"absent.org"}
    listed = spark.createDataFrame([(h,) for h in bad] * 2 + [(None,)], "key string").withColumn("host", F.lit("clash"))
    got = sorted((r["page_id"] or -1, r["host"], r["verdict"]) for r in url_filters.judge(pages, listed).collect())
    assert got == sorted((i or -1, u[7:-2] if u else "", "block" if u and u[7:-2] in bad else "allow") for i, u in rows)
    assert {r["verdict"] for r in url_filters.judge(pages, listed.limit(0)).collect()} == {"allow"}
    assert url_filters.judge(pages.limit(0), listed).count() == 0


def brute_near(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t.translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates_against_brute_force(docs, rows):
    assert {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(docs, shingle=4).collect()} == brute_near(rows, 4)


def test_near_duplicate_groups_without_a_centre(spark):
    """Many texts about one base, some of them linked only through others: found in blocks, as no pivot links all."""
    draw = random.Random(8)
    base = prose(draw, 150).split(" ")
    rows = []
    for i in range(120):
        words = list(base)
        for at in draw.sample(range(150), draw.choice((1, 3, 5, 9))):
            words[at] = f"w{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    most, minhash.BLOCK_ROWS = minhash.BLOCK_ROWS, 16
    try:
        got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(frame(spark, rows), shingle=4).collect()}
    finally:
        minhash.BLOCK_ROWS = most
    want = brute_near(rows, 4)
    assert got == want and len({x[1] for x in want.values()}) > 1


def test_pairs_that_share_one_key_are_compared_however_far():
    draw = np.random.default_rng(3)
    sig = draw.integers(0, 1 << 16, (2, minhash.MINIMA)).astype(np.uint16)
    sig[1] = sig[0] + 1
    sig[1, :4] = sig[0, :4]
    common = np.sort(draw.integers(0, 1 << 62, 95).astype(np.uint64))
    side = {"id": np.array([4, 9]), "comp": np.array([4, 9]), "sig": sig, "set": [common[:90], common[5:]]}
    u, v = minhash.block_links(0, True, side, side, 80)
    assert (u.tolist(), v.tolist()) == ([9], [4])


def test_common_shingles_matches_sets():
    draw = np.random.default_rng(4)
    make = lambda: [np.unique(draw.integers(0, 60, draw.integers(1, 40))).astype(np.uint64) for _ in range(7)]
    a, b = make(), make()
    got = minhash.common_shingles(a, b, columns=8)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_licenses(spark):
    rows = [
        (1, "a/b/one.txt", "Text of its own.\nReleased under the MIT License."),
        (2, "a/b/c/two.txt", "no licence here"),
        (3, "a/three.txt", "nothing"),
        (4, "z/four.txt", "Before.\nLicensed under the Apache License, Version 2.0.\nAfter."),
        (5, "z/five.txt", "nothing"),
        (6, "a/b/six.txt", "This work is licensed under the GNU General Public License, version 3.\nMore."),
        (7, None, None),
        (8, "a/b/d/e/eight.txt", ""),
        (9, "q/nine.txt", "The licensed driver had a permission slip."),
    ]
    df = spark.createDataFrame(rows, "file long, path string, text string")
    got = {r["file"]: (r["license"], r["how"], r["from_dir"]) for r in licenses.scan(df).collect()}
    assert got[1] == ("MIT", "own", None) and got[4] == ("Apache-2.0", "own", None) and got[6] == ("GPL-3.0", "own", None)
    assert got[2][1:] == ("inherited", "a/b") and got[8][1:] == ("inherited", "a/b")
    assert got[3][1] == got[5][1] == got[7][1] == got[9][1] == "none"
    assert licenses.scan(df.limit(0)).count() == 0


def test_licence_files_and_odd_rows(spark):
    files = [
        (None, "a/LICENSE", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + licenses.MIT_GRANT.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE")),
        (1, "a/b/code.py", "code " * 5000),
        (2, "b/LICENSE", "\n\n".join((licenses.BSD_TERMS, licenses.BSD_THIRD, licenses.BSD_END))),
        (3, "b/x.c", None),
        (4, "c/x.c", f"{licenses.GPL_HEADER.format(v=3)}\ncode"),
        (4, "c/x.c", f"{licenses.GPL_HEADER.format(v=3)}\ncode"),
        (5, "d/x.c", "Released under the MIT License."),
        (5, "e/x.c", "no words of it"),
    ]
    df = spark.createDataFrame(files, "file long, path string, text string").select("*", *[F.lit("clash").alias(c) for c in ("license", "cosine", "edge", "unit", "term", "df", "_file", "body", "dir")])
    got = sorted((r["path"], r["license"], r["how"]) for r in licenses.scan(df).collect())
    assert got == [("a/LICENSE", "MIT", "own"), ("a/b/code.py", "MIT", "inherited"), ("b/LICENSE", "BSD-3-Clause", "own"), ("b/x.c", "BSD-3-Clause", "inherited"), ("c/x.c", "GPL-3.0", "own"), ("c/x.c", "GPL-3.0", "own"), ("d/x.c", "MIT", "own"), ("e/x.c", "MIT", "own")]


def test_every_line_that_reaches_the_cosine_is_found(spark):
    draw = random.Random(8)
    heads = ["Licensed under CC BY-SA 4.0.", "CC BY-SA 4.0", "CC_BY-NC 4.0", "Released under MIT.", "Apache 2.0", "Apache, Version 2.0", "LGPL version 3", "the person by the software", "charge of the files"]
    texts = [*heads, *(" ".join(draw.sample("the by under version of files software person charge 2 0 3 and".split(), 6)) for _ in range(60))]
    n = len(texts)
    terms = [licenses.TERM.findall(t.lower()) for t in texts]
    seen = Counter(t for x in terms for t in set(x))
    vector = lambda words: {t: c * (math.log((1 + n) / (1 + seen[t])) + 1) for t, c in Counter(words).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for i, words in enumerate(terms):
        v, best = vector(words), 0.0
        for _, body in licenses.ALL:
            w = vector(licenses.TERM.findall(body.lower()))
            best = max(best, sum(x * w.get(t, 0) for t, x in v.items()) / norm(v) / norm(w))
        if round(best, 6) >= 0.6:
            want[i] = best
    got = {r["file"]: r["cosine"] for r in licenses.own_licenses(spark.createDataFrame(list(enumerate(texts)), "file long, text string")).collect()}
    assert {1, 2} <= set(want) and got == pytest.approx(want, abs=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="top">Site name. Welcome here, friend.</header>
<nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav><div class="cookie-notice">We use cookies. Please accept them, thanks.</div>
<aside>Side words. They are here, too.</aside><main><article><h1>A  title &amp; more</h1><p>First <b>bold</b> words,
in two lines. Enough text stands here to be the article.<br><p>Second one.</p><ul><li>An item</li></ul><script>var x = "<p>no</p>";</script></article>
<section class="comments"><p>I like this a lot. Really, it is good, thanks!</p></section></main><form><label>Mail</label></form><footer>&copy; Someone. All rights.</footer></body></html>"""


def test_html_extraction(spark):
    assert html_extract.extract(PAGE) == "A title & more\nFirst bold words, in two lines. Enough text stands here to be the article.\nSecond one.\nAn item"
    assert [html_extract.extract(x) for x in (None, "", "<p></p>", "<nav>x</nav>")] == [""] * 4
    assert html_extract.extract("<div><p>Only a &lt; text, cut o") == "Only a < text, cut o"
    assert html_extract.extract("<p>A<!-- no --> b</p><div class=ad>Buy this, now. Good.</div>") == "A b"
    outside = ["header", "site-header", "sidebar", "notice", "ad", "ad-slot", "advertisement", "comments", "comment-list", "commentlist", "cookie-banner", "menu", "footer", "related"]
    for name in outside:
        for mark in (f'class="{name}"', f"id={name}"):
            assert html_extract.extract(f"<body><div {mark}><p>Words that stand outside, here. And more of them, too.</p></div><div class='post'><h2>Head</h2><p>Inner words, enough.</p></div></body>") == "Head\nInner words, enough.", mark
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", "<p>x &#233;</p>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["url"]: (r["page_id"], r["n_chars"]) for r in html_extract.extract_pages(df).collect()}
    assert got[None] == (2, 0) and got["v"] == (None, 3)


def test_short_blocks_follow_the_content():
    long = "Many words, of a text. " * 13
    wanted = ["The title of it", long.strip(), "A short heading", long.strip(), "One item of a list", "Another item", "A line", "bare words", "Wrapped heading", long.strip(), "Last item of the text"]
    page = f"""<body><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul><div class=top><h1>The title of it</h1></div><p>{long}</p><h2 id="discussion">A short heading</h2><p>{long}</p>
<ul><li>One item of a list</li><li>Another item</li></ul><div>A line</div>bare words<div class=w><h2>Wrapped heading</h2></div><p>{long}</p><ul><li>Last item of the text</li></ul><div>Copyright</div><ul><li><a href=/c>Contact</a></li></ul></body>"""
    assert html_extract.extract(page).split("\n") == wanted
    page = f'<body><article><p>{long}</p><section id="related-work"><h2 id="related">Related work</h2><p>{long}</p></section><section id="comments"><p>{long} No.</p></section></article></body>'
    assert html_extract.extract(page).split("\n") == [long.strip(), "Related work", long.strip()]


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == pytest.approx([200, 166.66666, 83.33333], abs=1e-3)
    assert sum(mixing.targets([10, 1000, 5], [5, 2, 1], 1500)) == pytest.approx(1500)
    assert mixing.targets([], [], 0) == []


def test_flight_keeps_both_totals():
    draw = random.Random(6)
    sizes = [float(draw.randint(1, 500)) for _ in range(400)] + [7.0] * 50
    out = mixing.fly(sizes, [0.37] * 450, 1)
    assert sum(0 < x < 1 for x in out) <= 2
    assert sum(s * x for s, x in zip(sizes, out, strict=True)) == pytest.approx(0.37 * sum(sizes), rel=1e-6)
    assert sum(out) == pytest.approx(0.37 * 450, rel=1e-6)
    done = mixing.land(sizes, out)
    assert set(done) <= {0.0, 1.0}


def test_mix(spark):
    draw = random.Random(7)
    rows = [(i, prose(draw, draw.randint(1, 60)), ("big" if i % 3 else f"s{i % 5}") if i % 50 else None) for i in range(900)] + [(None, "no id", "big"), (5000, None, "big"), (5000, None, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).repartition(3)
    block, fan = mixing.BLOCK, mixing.FAN
    mixing.BLOCK, mixing.FAN = 50, 4
    try:
        got = mixing.mix(df).collect()
        again = mixing.mix(df.repartition(5)).collect()
    finally:
        mixing.BLOCK, mixing.FAN = block, fan
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= max(70, 0.02 * t) for s, t in target.items())
    assert mixing.mix(df.limit(0)).count() == 0


def test_cases_that_must_not_crash(spark):
    df = frame(spark, ODD)
    none = df.limit(0)
    assert quality_rules.judge(df.select("doc_id", "text"), quality_rules.DecisionList()).count() == len(ODD)
    for run in (rlz_dedup.remove_repeats, bwt_dedup.remove_repeats, minhash.near_duplicates, lm_scoring.score):
        got = run(df).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ODD), run
        assert run(none).count() == 0
    near = minhash.near_duplicates(df).collect()
    assert all(r["kept"] == (r["doc_id"] != 6) for r in near) and {r["component_id"] for r in near} == {1, 2, 3, 4, 5, None}


def test_callers_columns_stay(spark):
    df = frame(spark, ODD)
    out = quality_rules.with_statistics(df.withColumns({"_l": F.lit("mine"), "n_words": F.lit(-1)}))
    assert out.where("_w = 'clash' and _l = 'mine' and kept = 'clash'").count() == len(ODD) and out.where("n_words = -1").count() == 0
    kept = quality_rules.keep(df, quality_rules.DecisionList(((quality_rules.Literal("n_words", False, 1.0),),)), base=False)
    assert set(kept.columns) == set(df.columns) and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "3", "5", "6", "None"]


def test_symbols_and_base_tests(spark):
    texts = ["#*$ % & | < > no more", "a b c " * 30, "a b c d e f g " * 3, " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_symbols"], r["base_failed"], r["kept"]) for r in quality_rules.judge(df, quality_rules.DecisionList()).collect()}
    assert got == {0: (8, True, False), 1: (0, True, False), 2: (0, True, False), 3: (0, False, True), 4: (0, True, False), 5: (0, True, False)}


def test_decontamination_of_long_and_repeated_rows(spark):
    item = " ".join(f"Item{i}" for i in range(20))
    long = prose(random.Random(1), 30_000)
    docs = spark.createDataFrame([(1, f"{long} {item} {long}"), (2, item), (2, item), (3, long), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "too short to leak"), (None, item)], "item_id long, text string")
    got = sorted((r["doc_id"], r["contaminated"], r["items"]) for r in decontam.decontaminate(docs.withColumn("hash", F.lit("clash")), bench.withColumn("at", F.lit("clash"))).collect())
    assert got == [(1, True, [7]), (2, True, [7]), (2, True, [7]), (3, False, []), (4, False, []), (5, False, [])]


def test_mix_of_rows_that_share_an_id(spark):
    draw = random.Random(3)
    rows = [(None if i % 2 else 7, prose(draw, draw.randint(1, 40)), "one" if i % 4 else None) for i in range(600)] + [(8, prose(draw, 20_000), "one"), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept, mixing.BLOCK = mixing.BLOCK, 40
    try:
        out = mixing.mix(df).collect()
        again = mixing.mix(df.repartition(7)).collect()
    finally:
        mixing.BLOCK = kept
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(rows)
    for source in ("one", None):
        own = [r for r in out if r["source"] == source]
        longest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= longest and all(0 <= r["taken"] <= 2 * r["size"] for r in own)


@pytest.mark.parametrize("module", [rlz_dedup, bwt_dedup])
def test_many_equal_rows_cost_as_much_as_many_rows(spark, module):
    """Two thousand rows with one id and one text, against as many with ids of their own: neither is slower by more than a few times."""
    text = prose(random.Random(8), 700)
    took = []
    for ids in (range(2000), [5] * 2000):
        rows = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").repartition(4)
        module.remove_repeats(rows.limit(50)).count()
        begin = time.perf_counter()
        got = module.remove_repeats(rows).select("n_removed").collect()
        took.append(time.perf_counter() - begin)
        assert len(got) == 2000
    # op4: a document has no repeats of its own id; op5: every byte also stands in another row
    assert (len({r["n_removed"] for r in got}) == 1) and (got[0]["n_removed"] > 0) == (module is bwt_dedup)
    assert took[1] < 3 * took[0] + 3
