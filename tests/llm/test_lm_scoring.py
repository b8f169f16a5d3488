"""The language model: probabilities, attention against a loop, training, and what the score loses without the attention."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tarnwell.llm import lm_scoring as lm

KINDS = ("th er on an re he in ed nd ha at en", "zu os ba li ko mi ta ru pe ga do fi", "sch ung ein ver ich ten lich heit bar aus", "oi eau ez ais ille que tre oux ain ette")


def prose(draw, n, kind):
    syllables, common = KINDS[kind].split(), [s * 2 for s in KINDS[kind].split()]
    return " ".join(draw.choice(common) if draw.random() < 0.5 else "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(2)
    return [(i, prose(draw, draw.choice((5, 40, 120)), i % 4)) for i in range(240)]


@pytest.fixture(scope="module")
def trained(spark, texts):
    docs = spark.createDataFrame(texts[:200], "doc_id long, text string").repartition(2).cache()
    model, words = lm.train(docs)
    model.lexicon = lm.Lexicon(words.toArrow())
    return model


def laid(model, texts):
    import pyarrow as pa

    (_, _, data, offsets), = lm.slices(pa.array(texts), 1 << 24)
    laid, tables, *_ = model.read(data, offsets, lm.TOKENIZER)
    return *laid, *tables


def per_token(model, texts):
    return float(model.score(*laid(model, texts)).mean()) / math.log(10)


def test_scores_against_a_loop(trained, texts):
    tokens, rows, says, part, top = laid(trained, [t for _, t in texts[200:206]] + ["", "one"])
    got = trained.score(tokens, rows, says, part, top)
    p = {k: v.astype(float) for k, v in trained.p.items()}
    seen = [-1, *tokens[:-1]]  # what stands before each token; -1 is a text's start
    for t in range(len(tokens)):
        low = max(0, t // lm.SCORED * lm.SCORED - lm.CONTEXT)
        places = [j for j in range(low, t + 1) if rows[j] == rows[t]]
        q = says[seen[t]] @ p["Q"] / math.sqrt(lm.EXPERTS)
        weight = np.exp([q @ (says[seen[j]] @ p["K"]) + p["R"][t - j] for j in places])
        got_values = sum(w * (says[seen[j]] @ p["V"]) for w, j in zip(weight / weight.sum(), places, strict=True))
        mix = np.exp(got_values @ p["W"] + p["B"])
        want = math.log((mix / mix.sum()) @ (part[tokens[t]] * math.exp(top[tokens[t]])))
        assert got[t] == pytest.approx(want, abs=2e-4)


def test_later_words_change_nothing_before_them(trained, texts):
    words = texts[201][1].split(" ") * 3
    other = [*words[:50], *("zzz" for _ in words[50:])]
    scores = []
    for w in (words, other):
        scores.append(trained.score(*laid(trained, [" ".join(w)])))
    assert scores[0][:50] == pytest.approx(scores[1][:50], abs=1e-4)


def test_probabilities_add_up(trained):
    known = np.maximum(trained.lexicon.times - lm.DISCOUNT, 0).sum(0) + np.maximum(trained.texts - lm.DISCOUNT, 0)
    assert known / trained.tokens + lm.DISCOUNT * trained.types / trained.tokens == pytest.approx(np.ones(lm.EXPERTS + 1), abs=1e-6)
    for u in (lm.START, 0, 500, 40_000):
        total = np.exp(trained.follows[trained.inputs[u], trained.classes] + trained.shares).sum(0)
        assert total == pytest.approx(np.ones(lm.EXPERTS + 1), abs=1e-3)


def test_without_attention_held_out_texts_score_worse(trained, texts):
    held = [t for _, t in texts[200:]]
    whole, weight = per_token(trained, held), trained.p["W"]
    trained.p["W"] = np.zeros_like(weight)
    blind = per_token(trained, held)
    trained.p["W"] = weight
    assert whole > blind + 0.2


def test_training_raises_the_score(trained, texts):
    tokens, rows, says, part, top = laid(trained, [t for _, t in texts[:100]])
    kept = trained.flat()
    trained.p["W"], trained.p["V"] = np.zeros_like(trained.p["W"]), np.eye(lm.EXPERTS, dtype=np.float32)
    was = trained.score(tokens, rows, says, part, top).mean()
    for _ in range(4):
        trained.learn(tokens, rows, says, part, 0.05, batch=8)
    now = trained.score(tokens, rows, says, part, top).mean()
    trained.unflat(kept)
    assert now > was + 0.2


def test_each_training_text_reaches_the_head(spark):
    draw = random.Random(5)
    few = [(i, prose(draw, 60, i)) for i in range(4)]
    docs = spark.createDataFrame(few, "doc_id long, text string").coalesce(1).cache()
    columns = ", ".join(f"{c} {{}}" for c in lm.TIMES)
    experts = lm.find_experts(docs)
    counts = docs.select("text").mapInArrow(lm._counted(experts), "word string, " + columns.replace("{}", "long")).where("word is not null").mapInArrow(lm._typed(lm.TOKENIZER), "kind byte, key long, " + columns.replace("{}", "double") + ", told binary").cache()
    ends = np.full(lm.EXPERTS + 1, 4.0)
    whole = lm.fit(docs, counts, ends).flat()
    for i, _ in few:
        assert not np.allclose(whole, lm.fit(docs.where(f"doc_id <> {i}"), counts, ends).flat(), atol=1e-6)


def test_experts_tell_kinds_of_text_apart(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    experts = lm.find_experts(docs)
    found = {}
    import pyarrow as pa

    long = [(i, t) for i, t in texts if len(t.split(" ")) >= 40]
    for a, b, data, offsets in lm.slices(pa.array([t for _, t in long]), 1 << 24):
        h, rows, _, _ = lm.word_hashes(data, offsets, lower=True)
        for (i, _), k in zip(long[a:b], experts.of(h, rows, b - a).argmax(1), strict=True):
            found.setdefault(int(k), []).append(i % 4)
    assert sum(max(map(x.count, set(x))) for x in found.values()) > 0.95 * len(long)


def test_pieces_of_many_words_are_those_of_each():
    words = ["the", "Anané,", "\u00a0abc", "abc\u00a0", "x\u2003y", "don't", "漢字", "12ab", "'s", "\u3000", "a\u0085b", "!?", "\ufffd", "é" * 50]
    ids, at = lm.pieces(words, lm.TOKENIZER)
    one = [lm._tokenizer(lm.TOKENIZER).encode_ordinary(" " + w) for w in words]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == one


def test_packed_words_come_back():
    import pyarrow as pa

    draw = np.random.default_rng(6)
    times = draw.integers(0, 3, (50, lm.EXPERTS)) * draw.integers(0, 1 << 40, (50, lm.EXPERTS))
    size = draw.integers(0, 6, 50)
    at = np.append(0, np.cumsum(size))
    ids = draw.integers(0, lm.IDS, at[-1])
    data, ends = lm.packed(times, ids, at)
    told = pa.array([data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    keys = draw.permutation(50) - 25
    words = lm.Lexicon(pa.table({"key": pa.array(keys), "told": told}))
    for k, key in enumerate(keys):
        i = int(np.searchsorted(words.keys, key))
        assert words.times[i].tolist() == [times[k].sum(), *times[k]] and words.ids[words.begin[i] : words.begin[i] + words.size[i]].tolist() == ids[at[k] : at[k + 1]].tolist()


def test_words_of_a_lexicon_are_looked_at_once(monkeypatch):
    n = 200
    ids, at = lm.pieces([f"word{i}" for i in range(n)], lm.TOKENIZER)
    counts = np.random.default_rng(5).integers(1, 50, (lm.IDS, lm.EXPERTS + 1)).astype(float)
    model = lm.Model(counts, np.concatenate(([[5, 7]], counts[:1]), 1), counts, counts.sum(0), counts[0], counts[1])
    data = " ".join(f"word{i}" for i in range(n + 5)).encode()
    flat, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    h = lm.word_hashes(flat, offsets, lower=True)[0]
    times = np.random.default_rng(6).integers(0, 9, (n, lm.EXPERTS)) + 1.0
    packed, ends = lm.packed(times, ids, at)
    told = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
    model.lexicon = lm.Lexicon(pa.table({"key": h[:n].view(np.int64), "told": told}))
    seen, words = [], model.words
    monkeypatch.setattr(model, "words", lambda ids, at, times: seen.append(len(at) - 1) or words(ids, at, times))
    (_, tables, often, *_), again = model.read(flat, offsets, lm.TOKENIZER), model.read(flat, offsets, lm.TOKENIZER)
    assert sum(seen) == n + 2 * 5  # a word that the lexicon has isn't looked at again
    every, where = lm.pieces([f"word{i}" for i in range(n + 5)], lm.TOKENIZER)
    whole = np.concatenate((np.concatenate((times.sum(1, keepdims=True), times), 1), np.zeros((5, lm.EXPERTS + 1))))
    for a, b, c in zip(tables, words(every, where, whole), again[1], strict=True):
        assert np.allclose(a, b, atol=1e-5) and np.array_equal(a, c)
    assert np.array_equal(often, whole[:, 0])
