"""Language-model scoring with a causal self-attention model over subword ids.

The model is a mixture of ``EXPERTS`` unigram models of the corpus and one of all
of it. Causal self-attention looks at the subword ids of the words before a place
and gives the shares of the mixture there. A word's probability under an expert is
its discounted share of the expert's training words plus what the discount leaves
times the probability of its subwords, one after another, END last.

What is learned: the experts, by rounds of expectation maximization over all
training texts, begun from ``SEEDS`` texts; counts of words and of pairs of subwords,
from all training texts; the weights of the attention (queries, keys, values,
distances, output), by Adam in numpy over all training texts, in as many places as
the input has parts, averaged by the words seen. Scoring lays the texts of a block
end to end and cuts them into windows that overlap by ``CONTEXT`` words; all windows
of a batch are one masked attention, and each token is scored once.

Defined results: a null text has only its end; a null doc_id counts as the empty
text for the fold; rows that share a doc_id are each scored; tables without
training texts give scores from uniform counts; tokens are words, then one end.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.flat import TO_LOWER, U, checkpointed, slices, word_hashes
from tarnwell.llm.text import pick

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer cuts a text before it merges bytes. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids of the vocabulary; its last is a word's end. START stands before a word's first id.
IDS, END, START = 50_257, 50_256, 50_257
#: Unigram models that the attention mixes, besides the one of all texts; kinds of words that they are found by.
EXPERTS, BINS = 8, 1024
#: Texts that expectation maximization begins with, and rounds of it over all training texts.
SEEDS, EM_ROUNDS = 2000, 1
#: Subwords that are told apart as what comes before, and classes of subwords that come after.
INPUTS, CLASSES = 1024, 128
#: Words that a window scores, words that it sees before them, words that training knows the experts' counts of.
SCORED, CONTEXT, FREQUENT = 16, 32, 65_536
#: Rounds of averaging, each over all training texts; bytes of text of a block.
ROUNDS, BLOCK_BYTES = 1, 16 << 20
#: Bytes of text that are arrays at once.
SLICE = 1 << 20
#: What each known word's count gives up for the subwords.
DISCOUNT = 0.75
#: Columns of counts: all texts, then each expert's.
TIMES = tuple(f"n{k}" for k in range(EXPERTS + 1))


def _kept(name: str) -> dict:
    """What a worker process keeps from task to task: held by a module that is not sent along with the functions."""
    import tiktoken

    return vars(tiktoken).setdefault(f"_kept_{name}", {})


def _tokenizer(path: str):
    """The tokenizer of a file of ranks, one a process."""
    found = _kept("tokenizers")
    if path not in found:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        found[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return found[path]


def pieces(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words end to end, where each one's begin and the last end).

    All words are one text for the tokenizer, which starts a new id at each space;
    words have none, so that an id that starts with one starts a word.
    """
    tokenizer, n = _tokenizer(path), len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    ids = np.array(tokenizer.encode_ordinary(" " + " ".join(words)), np.int64)
    at = np.flatnonzero(_starting(path)[ids])
    if len(at) != n:  # not with this vocabulary: a word at a time
        found = [tokenizer.encode_ordinary(" " + w) for w in words]
        at = np.concatenate(([0], np.cumsum([len(x) for x in found])))[:-1]
        ids = np.fromiter(chain.from_iterable(found), np.int64)
    return ids, np.append(at, len(ids)).astype(np.int64)


def _starting(path: str) -> np.ndarray:
    """Whether each id's bytes start with a space."""
    found = _kept("starting")
    if path not in found:
        found[path] = np.array([_tokenizer(path).decode_single_token_bytes(i)[:1] == b" " for i in range(END)] + [False])
    return found[path]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes as they come, which one each word is, where each comes first)."""
    import pandas as pd

    which, unique = pd.factorize(h.view(np.int64))
    first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1)) if len(which) else np.zeros(0, np.int64)
    return unique.view(U), which, first


def spelled(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[str]:
    """Words in lower case."""
    raw = data.tobytes().translate(TO_LOWER)
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def words_of(h: np.ndarray) -> np.ndarray:
    return (h % U(BINS)).astype(np.int64)


class Experts:
    """Which expert a text belongs to: a mixture of unigram models over ``BINS`` kinds of words."""

    def __init__(self, sums: np.ndarray, texts: np.ndarray):
        """``sums``: of each expert, how often each kind occurs in its texts; ``texts``: how many it has."""
        self.log = np.log((sums + 0.1) / (sums + 0.1).sum(1, keepdims=True)).astype(np.float32)
        self.prior = np.log((texts + 1) / (texts + 1).sum()).astype(np.float32)

    def shares(self, counts_log: np.ndarray) -> np.ndarray:
        x = counts_log + self.prior
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def of(self, h: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        """The share of each expert in each row."""
        kinds = words_of(h)
        fit = np.stack([np.bincount(rows, weights=self.log[k][kinds], minlength=n_rows) for k in range(len(self.log))], 1)
        return self.shares(fit)


def begin(kinds: np.ndarray, restarts: int = 5, rounds: int = 25) -> Experts:
    """Experts from a few texts, of each of which ``kinds`` has how often each kind occurs; the likeliest of some restarts."""
    sums = np.zeros((EXPERTS, BINS))
    kinds = kinds[kinds.sum(1) > 0].astype(np.float64)
    best, found = -math.inf, Experts(sums, np.zeros(EXPERTS))
    if not len(kinds):
        return found
    unit = np.sqrt(kinds / kinds.sum(1, keepdims=True))
    for restart in range(restarts):
        draw = np.random.default_rng(restart)
        chosen = [int(draw.integers(len(kinds)))]
        for _ in range(EXPERTS - 1):  # far from those chosen, as a rule
            far = np.maximum(1 - (unit @ unit[chosen].T).max(1), 0) ** 2
            chosen.append(int(draw.choice(len(kinds), p=far / far.sum())) if far.sum() > 0 else chosen[0])
        now = Experts(kinds[chosen] + kinds.sum(0) / kinds.sum() * 50, np.zeros(EXPERTS))
        for _ in range(rounds):
            fit = kinds @ now.log.T.astype(np.float64)
            share = now.shares(fit)
            now = Experts(share.T @ kinds, share.sum(0))
        fit = kinds @ now.log.T + now.prior
        total = float((np.log(np.exp(fit - fit.max(1, keepdims=True)).sum(1)) + fit.max(1)).sum())
        if total > best:
            best, found = total, now
    return found


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(0), SLICE):
            h, rows, _, _ = word_hashes(data, offsets, lower=True)
            of_row = np.split(words_of(h), np.flatnonzero(np.diff(rows)) + 1) if len(h) else []
            yield pa.RecordBatch.from_arrays([pa.array([np.bincount(x, minlength=BINS).astype(np.float32).tobytes() for x in of_row], pa.binary())], names=["kinds"])


def _expected(experts: Experts):
    """Each expert's sums over a part of the texts: place BINS of a row of BINS + 1 counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((EXPERTS, BINS + 1))
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(0), SLICE):
                h, rows, _, _ = word_hashes(data, offsets, lower=True)
                share = experts.of(h, rows, b - a)
                kinds = words_of(h)
                for k in range(EXPERTS):
                    sums[k, :BINS] += np.bincount(kinds, weights=share[rows, k], minlength=BINS)
                sums[:, BINS] += share.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["at", "value"])

    return run


def find_experts(docs: DataFrame) -> Experts:
    """The experts of training texts ``docs`` (doc_id, text): begun from SEEDS texts, refined over all."""
    few = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SEEDS).distinct()
    chosen = docs.join(F.broadcast(few), "doc_id").select("text").mapInArrow(_kinds, "kinds binary").limit(2 * SEEDS).toArrow()
    kinds = np.frombuffer(b"".join(sorted(chosen["kinds"].to_pylist())), np.float32).reshape(-1, BINS)
    experts = begin(kinds)
    for _ in range(EM_ROUNDS):
        sums = np.zeros(EXPERTS * (BINS + 1))
        got = docs.select("text").mapInArrow(_expected(experts), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        sums[got["at"].to_numpy()] = np.round(got["value"].to_numpy(), 6)  # so that the order of adding does not show
        sums = sums.reshape(EXPERTS, BINS + 1)
        experts = Experts(sums[:, :BINS], sums[:, BINS])
    return experts


def _counted(experts: Experts):
    """Distinct words of a slice and how often each occurs, in all texts and in those of each expert; the null word stands for the texts' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(0), SLICE):
                h, rows, starts, stops = word_hashes(data, offsets, lower=True)
                unique, which, first = distinct(h)
                words = [*spelled(data, starts[first], stops[first]), None]
                expert = experts.of(h, rows, b - a).argmax(1)
                table = np.zeros((EXPERTS + 1, len(words)), np.int64)
                table[1:, :-1] = np.bincount(expert[rows] * len(unique) + which, minlength=EXPERTS * len(unique)).reshape(EXPERTS, -1) if len(unique) else 0
                table[1:, -1] = np.bincount(expert, minlength=EXPERTS)
                table[0] = table.sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *map(pa.array, table)], names=["word", *TIMES])

    return run


def _typed(path: str):
    """kind 0: words by hash with their counts, which ``told`` has as well, with their ids; 1: pairs of ids in distinct words, START before and END after each; 2: ids.

    A distinct word counts as one, in parts for the experts whose texts have it; ids of kind 2 count as often as their words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = np.concatenate([word_hashes(data, offsets)[0] for _, _, data, offsets in slices(batch.column(0))])
            times = np.stack([batch.column(1 + k).to_numpy() for k in range(EXPERTS + 1)], 1).astype(float)
            ids, at = pieces(batch.column(0).to_pylist(), path)
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            before = np.empty(len(ids), np.int64)
            before[1:] = ids[:-1]
            before[at[:-1]] = START
            one = times / times[:, :1]
            pair, which = np.unique(np.concatenate((before * 65536 + ids, ids[at[1:] - 1] * 65536 + END)), return_inverse=True)
            who = np.concatenate((owner, np.arange(len(at) - 1)))
            pairs = [np.bincount(which, weights=one[who, k], minlength=len(pair)) for k in range(EXPERTS + 1)]
            each, which = np.unique(ids, return_inverse=True)
            often = [np.bincount(which, weights=times[owner, k], minlength=len(each)) for k in range(EXPERTS + 1)]
            kind = np.repeat(np.array([0, 1, 2], np.int8), [len(h), len(pair), len(each)])
            key = np.concatenate((h.view(np.int64), pair, each))
            data, ends = packed(times[:, 1:], ids, at)
            ends = np.concatenate((ends, np.full(len(kind) - len(h), ends[-1]))).astype(np.int32)
            told = pa.Array.from_buffers(pa.binary(), len(kind), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), *(pa.array(np.concatenate((times[:, k], pairs[k], often[k]))) for k in range(EXPERTS + 1)), told], names=["kind", "key", *TIMES, "told"])

    return run


def _spread(first: np.ndarray, size: np.ndarray, wide: int) -> np.ndarray:
    """Places of ``size`` values of ``wide`` bytes each from ``first`` on, value by value."""
    to = np.cumsum(size)
    at = np.repeat(first, size) + wide * (np.arange(to[-1] if len(to) else 0) - np.repeat(to - size, size))
    return at[:, None] + np.arange(wide)


def packed(times: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each word's begin and the last end): of each word a byte that says which experts have it, their counts
    (8 bytes each), and its ids (2 bytes each). ``times``: a column an expert."""
    has = times > 0
    n, size = has.sum(1), np.diff(at)
    ends = np.append(0, np.cumsum(1 + 8 * n + 2 * size))
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends[:-1]] = np.packbits(has, axis=1, bitorder="little")[:, 0] if len(has) else 0
    out[_spread(ends[:-1] + 1, n, 8)] = times[has].astype("<u8").view(np.uint8).reshape(-1, 8)
    out[_spread(ends[:-1] + 1 + 8 * n, size, 2)] = ids.astype("<u2").view(np.uint8).reshape(-1, 2)
    return out, ends


class Lexicon:
    """Counts and ids of words by their hash."""

    def __init__(self, table: pa.Table | None = None):
        """``table``: key and told. ``said``: what a model says of its words."""
        self.said = None
        self.keys, self.times, self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros((0, EXPERTS + 1)), *[np.zeros(0, np.int64)] * 3
        if table is None or not table.num_rows:
            return
        told = table["told"].combine_chunks()
        told = told.chunk(0) if isinstance(told, pa.ChunkedArray) else told
        _, ends, data = told.buffers()
        ends = np.frombuffer(ends, np.int32)[told.offset : told.offset + len(told) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)
        has = np.unpackbits(data[ends[:-1]][:, None], axis=1, count=EXPERTS, bitorder="little").astype(bool)
        n = has.sum(1)
        times = np.zeros((len(told), EXPERTS + 1))
        times[:, 1:][has] = data[_spread(ends[:-1] + 1, n, 8)].view("<u8")[:, 0]
        times[:, 0] = times.sum(1)
        keys = table["key"].to_numpy()
        order = np.argsort(keys)
        size = (np.diff(ends) - 1 - 8 * n) // 2
        self.ids = data[_spread(ends[:-1] + 1 + 8 * n, size, 2)].view("<u2")[:, 0]
        self.keys, self.times, self.begin, self.size = keys[order], times[order], (np.cumsum(size) - size)[order], size[order]

    def find(self, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of distinct hashes are known, the places of those)."""
        if not len(self.keys) or not len(unique):
            return np.zeros(len(unique), bool), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, unique.view(np.int64)), len(self.keys) - 1)
        hit = self.keys[place] == unique.view(np.int64)
        return hit, place[hit]

    def spelled(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words at some places end to end, where each one's begin and the last end)."""
        size = self.size[a:b]
        to = np.cumsum(size)
        return self.ids[np.repeat(self.begin[a:b] - (to - size), size) + np.arange(to[-1] if len(to) else 0)], np.append(0, to)


class Model:
    """Tables from counts, and the weights of the attention."""

    NAMES = ("Q", "K", "V", "R", "W", "B")

    def __init__(self, ids: np.ndarray, pairs: np.ndarray, often: np.ndarray, tokens: np.ndarray, types: np.ndarray, texts: np.ndarray):
        """Of all texts and of each expert, by column. ``ids``: how often each id stands in distinct words; ``pairs`` (input, id, column ...): how
        often ids follow an id; ``often``: how often each id stands in texts; ``tokens``, ``types``, ``texts``: how many there are."""
        self.tokens, self.types, self.texts = tokens, types, texts
        self.inputs, self.classes = self.maps(ids[:, 0])
        total = np.zeros((CLASSES, EXPERTS + 1))
        np.add.at(total, self.classes, ids)
        whole = (ids[:, 0] + 1) / np.bincount(self.classes, weights=ids[:, 0] + 1, minlength=CLASSES)[self.classes]
        self.shares = np.log((ids + 16 * whole[:, None]) / (total[self.classes] + 16)).astype(np.float32)
        table = np.zeros((INPUTS, CLASSES, EXPERTS + 1))
        u, v = pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)
        np.add.at(table, (self.inputs[u], self.classes[v]), pairs[:, 2:])
        prior = (total[:, 0] + 1) / (total[:, 0] + 1).sum()
        every = (table[:, :, 0] + 8 * prior) / (table[:, :, 0].sum(1, keepdims=True) + 8)
        self.follows = np.log((table + 8 * every[:, :, None]) / (table.sum(1, keepdims=True) + 8)).astype(np.float32)
        # What an id says for each expert: how much more often it stands in the expert's texts than in all.
        rate = (often + 0.5) / (often + 0.5).sum(0)
        one = np.clip(np.log(rate[:, 1:] / rate[:, :1]), -4, 4).astype(np.float32)
        self.says = np.zeros((IDS + 1, EXPERTS), np.float32)
        self.says[:IDS] = one
        small = lambda *shape: (np.random.default_rng(7).standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {"Q": small(EXPERTS, EXPERTS), "K": small(EXPERTS, EXPERTS), "V": np.eye(EXPERTS, dtype=np.float32), "R": np.zeros(SCORED + CONTEXT, np.float32)}
        # At first, what half of the words in sight say adds up; training goes on from there.
        self.p["W"] = np.concatenate((np.zeros((EXPERTS, 1)), CONTEXT / 2 * np.eye(EXPERTS)), 1).astype(np.float32)
        self.p["B"] = np.log((tokens + 1) / (tokens + 1).sum()).astype(np.float32)
        self.lexicon = Lexicon()

    @staticmethod
    def maps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The input of each id and START, and the class of each id: frequent ones are their own, others are told apart by rank."""
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(IDS, np.int64)
        rank[order] = np.arange(IDS)
        inputs = np.append(np.minimum(rank, INPUTS - 2), INPUTS - 1).astype(np.int32)
        bands = 10
        single = CLASSES - bands - 1
        classes = np.where(rank < single, rank, single + np.minimum(np.log2(np.maximum(rank - single, 0) / 32 + 1), bands - 1).astype(np.int64))
        classes[END] = CLASSES - 1
        return inputs, classes.astype(np.int32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def unflat(self, values: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            shape, n = self.p[k].shape, self.p[k].size
            self.p[k] = np.asarray(values[at : at + n], np.float32).reshape(shape)
            at += n

    def words(self, ids: np.ndarray, at: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(what each word says for each expert, its probability under each over the greatest of them, that one's natural logarithm),
        all with a row more: a text's start, an end. ``times``: how often all texts and each expert's have the word."""
        n = len(at) - 1
        says, part, top = np.zeros((n + 1, EXPERTS), np.float32), np.empty((n + 1, EXPERTS + 1), np.float32), np.empty(n + 1, np.float32)
        left = np.maximum(self.tokens, 1)
        more = np.where(self.tokens > 0, DISCOUNT * self.types / left, 1.0)
        if n:
            before = np.empty(len(ids), np.int64)
            before[1:] = ids[:-1]
            before[at[:-1]] = START
            sub = np.add.reduceat(self.follows[self.inputs[before], self.classes[ids]] + self.shares[ids], at[:-1])
            sub += self.follows[self.inputs[ids[at[1:] - 1]], CLASSES - 1] + np.log(more).astype(np.float32)
            says[:n] = np.add.reduceat(self.says[ids], at[:-1]) / np.diff(at)[:, None].astype(np.float32)
            top[:n] = sub.max(1)
            part[:n] = np.exp(sub - top[:n, None])
            hit = np.flatnonzero(times[:, 0])  # of the others no text has the word
            both = np.maximum(times[hit] - DISCOUNT, 0) / left + part[hit] * np.exp(top[hit].astype(float))[:, None]
            high = both.max(1)
            part[hit], top[hit] = both / high[:, None], np.log(high)
        ends = (self.texts + 0.01) / (left + 0.01)
        part[n], top[n] = ends / ends.max(), math.log(ends.max())
        return says, part, top

    def of_lexicon(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``words`` of the lexicon's words without the row more, found once for all texts that are read with it, some at a time."""
        if self.lexicon.said is None:
            n = len(self.lexicon.keys)
            some = [self.words(*self.lexicon.spelled(a, a + FREQUENT), self.lexicon.times[a : a + FREQUENT]) for a in range(0, max(n, 1), FREQUENT)]
            self.lexicon.said = tuple(np.concatenate([x[:-1] for x in column]) for column in zip(*some, strict=True))
        return self.lexicon.said

    def read(self, data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: (tokens and rows as ``lay`` gives them), (``words`` of their distinct words), how often all texts have these, which word each is, its row."""
        h, rows, starts, stops = word_hashes(data, offsets, lower=True)
        unique, which, first = distinct(h)
        hit, place = self.lexicon.find(unique)
        new = np.flatnonzero(~hit)
        ids, at = pieces(spelled(data, starts[first[new]], stops[first[new]]), path)
        others = self.words(ids, at, np.zeros((len(new), EXPERTS + 1)))  # the last is the row more
        row, tables = np.append(new, len(unique)), []
        for known, other in zip(self.of_lexicon(), others, strict=True):
            table = np.empty((len(unique) + 1, *other.shape[1:]), other.dtype)
            table[:-1][hit], table[row] = known[place], other
            tables.append(table)
        times = np.zeros(len(unique))
        times[hit] = self.lexicon.times[place, 0]
        return lay(which, rows, len(offsets) - 1), tuple(tables), times, which, rows

    def tables(self, says: np.ndarray) -> None:
        """Queries, and keys, values and a 1, of distinct words, looked up instead of multiplied anew."""
        p = self.p
        self.q = says @ p["Q"] / np.float32(math.sqrt(EXPERTS))
        self.kv = np.concatenate((says @ p["K"], says @ p["V"], np.ones((len(says), 1), np.float32)), 1)
        self.distances(float((says * says).sum(1).max()))

    def distances(self, longest: float) -> None:
        """What each distance adds; ``bounded``: no weight over- or underflows, ``longest`` being the greatest square of what a word says."""
        p = self.p
        back = np.arange(SCORED)[:, None] + CONTEXT - np.arange(SCORED + CONTEXT)[None, :]
        self.bias = np.where(back >= 0, p["R"][np.clip(back, 0, None)], np.float32(-1e9)).astype(np.float32)
        self.bounded = longest * float(np.linalg.norm(p["Q"]) * np.linalg.norm(p["K"])) / math.sqrt(EXPERTS) + float(np.abs(p["R"]).max()) < 60

    def weigh(self, q: np.ndarray, k: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Unscaled weights of the masked attention of each window's last SCORED places, which see their own text up to themselves."""
        s = q @ k.transpose(0, 2, 1)
        s += self.bias
        mixed = np.flatnonzero(r[:, 0] != r[:, -1])
        if len(mixed):
            s[mixed] += np.where(r[mixed][:, CONTEXT:, None] == r[mixed][:, None, :], np.float32(0), np.float32(-1e9))
        if not self.bounded:
            s -= s.max(2, keepdims=True)
        return np.exp(s, out=s)

    def gates(self, got: np.ndarray) -> np.ndarray:
        """Unscaled shares of the experts."""
        logits = got @ self.p["W"] + self.p["B"]
        if np.abs(logits).max() > 60:
            logits -= logits.max(1, keepdims=True)
        return np.exp(logits, out=logits)

    def score(self, tokens: np.ndarray, rows: np.ndarray, says: np.ndarray, part: np.ndarray, top: np.ndarray, batch: int = 128) -> np.ndarray:
        """Natural logarithm of the probability of each token; ``tokens``: which word each is, -1 an end; the others of ``words``."""
        out = np.empty(len(tokens), np.float32)
        self.tables(says)
        x, r = windows(before(tokens), rows)
        for a in range(0, len(x), batch):
            here = x[a : a + batch]
            kv = self.kv[here]
            got = self.weigh(self.q[here[:, CONTEXT:]], kv[:, :, :EXPERTS], r[a : a + batch]) @ kv[:, :, EXPERTS:]
            lo, hi = a * SCORED, min(len(tokens), (a + len(here)) * SCORED)
            got = got.reshape(-1, EXPERTS + 1)[: hi - lo]
            gate = self.gates(got[:, :EXPERTS] / got[:, EXPERTS:])
            out[lo:hi] = np.einsum("ij,ij->i", gate, part[tokens[lo:hi]]) / gate.sum(1)
        return np.log(out) + top[tokens]

    def learn(self, tokens: np.ndarray, rows: np.ndarray, says: np.ndarray, part: np.ndarray, rate: float, batch: int = 192) -> None:
        """One pass of Adam over the windows of some texts."""
        x, r = windows(before(tokens), rows)
        goal = np.concatenate((tokens, np.full(len(x) * SCORED - len(tokens), -2))).reshape(-1, SCORED)
        m, v2 = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        back = (np.arange(SCORED)[:, None] + CONTEXT - np.arange(SCORED + CONTEXT)[None, :]).clip(0).ravel()
        order = np.random.default_rng(11).permutation(len(x))
        root, longest = np.float32(math.sqrt(EXPERTS)), float((says * says).sum(1).max())
        for step, a in enumerate(range(0, len(x), batch), 1):
            at = order[a : a + batch]
            p, here = self.p, x[at]
            e = says[here]
            near, wide = e[:, CONTEXT:], e.reshape(-1, EXPERTS)
            self.distances(longest)
            kv = np.ones((len(wide), 2 * EXPERTS + 1), np.float32)
            kv[:, : 2 * EXPERTS] = wide @ np.concatenate((p["K"], p["V"]), 1)
            kv = kv.reshape(*here.shape, -1)
            q, k, v = near @ (p["Q"] / root), kv[:, :, :EXPERTS], kv[:, :, EXPERTS : 2 * EXPERTS]
            s = self.weigh(q, k, r[at])
            got = s @ kv[:, :, EXPERTS:]
            total = got[:, :, EXPERTS:]
            s /= total
            got = got[:, :, :EXPERTS] / total
            target = goal[at].reshape(-1)
            live = target != -2
            flat = got.reshape(-1, EXPERTS)
            gate = self.gates(flat)
            after = gate * part[np.where(live, target, -1)]
            gate /= gate.sum(1, keepdims=True)
            after /= after.sum(1, keepdims=True)
            d = gate - after
            d *= (live / np.float32(max(live.sum(), 1)))[:, None]
            g = {"W": flat.T @ d, "B": d.sum(0)}
            dg = (d @ p["W"].T).reshape(got.shape)
            dv = s.transpose(0, 2, 1) @ dg
            ds = dg @ v.transpose(0, 2, 1)
            ds -= (dg * got).sum(2, keepdims=True)
            ds *= s
            g["R"] = np.bincount(back, weights=ds.sum(0).ravel(), minlength=SCORED + CONTEXT).astype(np.float32)
            dq, dk = ds @ k / root, ds.transpose(0, 2, 1) @ q
            g["Q"], g["K"], g["V"] = near.reshape(-1, EXPERTS).T @ dq.reshape(-1, EXPERTS), wide.T @ dk.reshape(-1, EXPERTS), wide.T @ dv.reshape(-1, EXPERTS)
            for name, grad in g.items():
                m[name] = 0.9 * m[name] + 0.1 * grad
                v2[name] = 0.98 * v2[name] + 0.02 * grad * grad
                p[name] = p[name] - np.float32(rate) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.98**step)) + np.float32(1e-6))


def before(tokens: np.ndarray) -> np.ndarray:
    """The token before each; before a text's first stands the end of another, -1, which is its start."""
    return np.concatenate((np.full(1, -1, tokens.dtype), tokens[:-1]))


def windows(inputs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input and row of each place of each window; the first CONTEXT are seen only."""
    n = -(-len(inputs) // SCORED)
    pad = lambda x: np.concatenate((np.full(CONTEXT, -1, x.dtype), x, np.full(n * SCORED - len(x), -1, x.dtype)))
    cut = lambda x: np.lib.stride_tricks.sliding_window_view(x, SCORED + CONTEXT)[::SCORED]
    return cut(pad(inputs)), cut(pad(rows))


def lay(which: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(which word each token is, -1 an end, its row) of all texts end to end."""
    ends = np.cumsum(np.bincount(rows, minlength=n_rows) + 1)
    out, body = np.full(int(ends[-1]), -1, np.int64), np.ones(int(ends[-1]), bool)
    body[ends - 1] = False
    out[body] = which
    return out, np.repeat(np.arange(n_rows), np.diff(ends, prepend=0))


def _trained(path: str, model: Model, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), SLICE):
                (tokens, row), (says, part, _), *_ = model.read(data, offsets, path)
                model.learn(tokens, row, says, part, rate)
                seen += len(tokens)
        if seen:
            flat = model.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))], names=["at", "value", "weight"])

    return run


def fit(docs: DataFrame, counts: DataFrame, texts: np.ndarray, *, tokenizer: str = TOKENIZER, rate: float = 0.02) -> Model:
    """The model of training texts ``docs`` with their ``counts`` (of ``_typed``) and ends (``texts``, of all and of each expert)."""
    sums = [F.sum(c).alias(c) for c in TIMES]
    held = lambda t: np.stack([t[c].to_numpy() for c in TIMES], 1).astype(float) if t.num_rows else np.zeros((0, EXPERTS + 1))

    def by_id(rows: DataFrame) -> np.ndarray:
        got, out = rows.groupBy("v").agg(*sums).toArrow(), np.zeros((IDS, EXPERTS + 1))
        out[got["v"].to_numpy()] = held(got)
        return out

    pairs = counts.where("kind = 1").select(F.expr("key div 65536").alias("u"), F.expr("key % 65536").alias("v"), *TIMES)
    ids = by_id(pairs)
    # Pairs are added up by input and class, of which there are INPUTS times CLASSES at most; any id of a class stands for it.
    inputs, classes = Model.maps(ids[:, 0])
    spark = docs.sparkSession
    stands = lambda x: {int(c): i for i, c in reversed(list(enumerate(x)))}
    one_u, one_v = stands(inputs), stands(classes)
    known = spark.createDataFrame([(i, one_u[int(x)]) for i, x in enumerate(inputs)], "u long, one_u long")
    named = spark.createDataFrame([(i, one_v[int(x)]) for i, x in enumerate(classes)], "v long, one_v long")
    got = pairs.join(F.broadcast(known), "u").join(F.broadcast(named), "v").groupBy("one_u", "one_v").agg(*sums).toArrow()
    table = np.concatenate((np.stack([got["one_u"].to_numpy(), got["one_v"].to_numpy()], 1).astype(float), held(got)), 1)
    words = counts.where("kind = 0")
    total = words.agg(*sums, *[F.sum((F.col(c) > 0).cast("long")).alias(f"types_{c}") for c in TIMES]).first()
    tokens, types = (np.array([total[prefix + c] or 0 for c in TIMES], float) for prefix in ("", "types_"))
    model = Model(ids, table, by_id(counts.where("kind = 2").select(F.col("key").alias("v"), *TIMES)), tokens + texts, types + (texts > 0), texts)
    model.lexicon = Lexicon(words.orderBy(F.desc("n0"), "key").limit(FREQUENT).select("key", "told").toArrow())
    texts_read = docs.select("text")  # as the input is split: all texts, and no shuffle of them
    for k in range(ROUNDS):
        got = texts_read.mapInArrow(_trained(tokenizer, model, rate / (k + 1)), "at long, value double, weight double").groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()
        if got.num_rows:
            flat = model.flat()
            flat[got["at"].to_numpy()] = got["value"].to_numpy()
            model.unflat(flat)
    model.lexicon = Lexicon()  # scoring is given all words
    return model


def _asked(key, table):
    keep = []
    for _, _, data, offsets in slices(table["text"].combine_chunks(), SLICE):
        keep.append(distinct(word_hashes(data, offsets, lower=True)[0])[0])
    unique = distinct(np.concatenate(keep))[0] if keep else np.zeros(0, U)
    return pa.table({"block": pa.array(np.full(len(unique), key[0].as_py(), np.int32)), "key": pa.array(unique.view(np.int64))})


def _scored(path: str, model: Model):
    n_all, n_distinct, n_texts = int(model.tokens[0]), int(model.types[0]), int(model.texts[0])

    def run(left, right):
        model.lexicon = Lexicon(right)
        out = []
        least = math.log10(n_all + n_distinct + 1)  # n_distinct has the end, and so has n_all
        for a, b, data, offsets in slices(left["text"].combine_chunks(), SLICE):
            (tokens, row), tables, times, which, rows = model.read(data, offsets, path)
            score = np.bincount(row, weights=model.score(tokens, row, *tables).astype(float), minlength=b - a) / math.log(10)
            n = np.bincount(rows, minlength=b - a) + 1
            c = times
            base = np.bincount(rows, weights=np.log10(c + 1.0)[which], minlength=b - a) + math.log10(n_texts + 1) - n * least
            known_words = np.bincount(rows, weights=(c > 0)[which], minlength=b - a).astype(np.int64) + (n_texts > 0)
            out.append((n.astype(np.int64), known_words, base, score))
        n, known_words, base, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": pa.array(n), "n_known": pa.array(known_words), "train_tokens": pa.array(np.full(len(n), n_all, np.int64)), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def train(docs: DataFrame, *, tokenizer: str = TOKENIZER) -> tuple[Model, DataFrame]:
    """The model of training texts ``docs`` (doc_id, text), and what is told of their words by hash: counts and ids."""
    experts = find_experts(docs)
    words = docs.select("text").mapInArrow(_counted(experts), "word string, " + ", ".join(f"{c} long" for c in TIMES)).groupBy("word").agg(*[F.sum(c).alias(c) for c in TIMES])
    words = checkpointed(words)
    ends = words.where("word is null").first()
    counts = checkpointed(words.where("word is not null").mapInArrow(_typed(tokenizer), "kind byte, key long, " + ", ".join(f"{c} double" for c in TIMES) + ", told binary"))
    model = fit(docs, counts, np.array([ends[c] if ends else 0 for c in TIMES], float), tokenizer=tokenizer)
    return model, counts.where("kind = 0").select("key", "told")


def score(docs: DataFrame, *, held: int = 2, folds: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text)."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held
    docs = pick(docs, "doc_id", "text").select("doc_id", "text", fold.alias("held_out"))
    model, words = train(docs.where("not held_out").select("doc_id", "text"), tokenizer=tokenizer)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(4, math.ceil(size / BLOCK_BYTES))
    # Both uses take all columns, so that the texts are shuffled once.
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int")).repartition("block")
    asked = dealt.groupBy("block").applyInArrow(_asked, "block int, key long")
    given = asked.join(words, "key").select("block", "key", "told")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_scored(tokenizer, model), schema)


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
