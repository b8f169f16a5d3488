"""SimHash stamps, token estimates and canonical messages."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import since, spread

#: How many tokens of the target model one counted token stands for. Fixed value.
RATIO = 0.78
#: Upper bounds of the budgets. Fixed values.
BUDGETS = ((256, "xs"), (2048, "sm"), (8192, "md"), (32768, "lg"))
WORD = re.compile(r"\w+")
PIECE = re.compile(r"\w+|[^\w\s]")


def simhash64(text: str | None) -> int:
    """Sign of the sum of the bits of each distinct word 3-gram's hash, as a signed number; 0 without words."""
    words = WORD.findall((text or "").lower())
    if not words:
        return 0
    grams = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    raw = np.frombuffer(b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams), np.uint8).reshape(-1, 8)
    set_bits = np.unpackbits(raw, axis=1).sum(0) * 2 > len(grams)
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big", signed=True)


def simhashes(texts: list[str | None]) -> np.ndarray:
    """``simhash64`` of each text: every distinct 3-gram of the batch is hashed once, and bits are summed for all texts together."""
    seen: dict[str, int] = {}
    rows, grams = [], []
    for i, text in enumerate(texts):
        words = WORD.findall((text or "").lower())
        if words:
            own = {" ".join(g) for g in zip(words, words[1:], words[2:], strict=False)} if len(words) > 2 else {" ".join(words)}
            grams.extend([seen.setdefault(g, len(seen)) for g in own])
            rows.extend([i] * len(own))
    out = np.zeros(len(texts), np.int64)
    if not rows:
        return out
    hashed = hashlib.blake2b
    raw = np.frombuffer(b"".join([hashed(g.encode(), digest_size=8).digest() for g in seen]), np.uint8).reshape(-1, 8)
    row, gram = np.array(rows), np.array(grams)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(np.append(first, len(row)))
    bits = np.empty((len(first), 64), bool)
    for k in range(8):  # eight bits at a time, so that a batch takes little room
        bits[:, 8 * k : 8 * k + 8] = 2 * np.add.reduceat(np.unpackbits(raw[gram, k : k + 1], axis=1).astype(np.int32), first) > count[:, None]
    out[row[first]] = np.packbits(bits, axis=1).view(">i8").ravel()
    return out


def simhash(column: str | Column) -> Column:
    """``simhash64`` of a column, a batch at a time."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        told = texts.tolist()
        return pd.Series(np.concatenate([simhashes(told[a : a + 256]) for a in range(0, len(told), 256)]) if told else np.zeros(0, np.int64))

    return run(column)


#: ``\w`` as both Python and Spark may write it.
LETTERS = "[\\p{L}\\p{N}_]+"


def digest64(gram: Column) -> Column:
    """The first eight bytes of an MD5, as a signed number."""
    return F.conv(F.substring(F.md5(gram.cast("binary")), 1, 16), 16, -10).cast("long")


def simhashes_of(rows: DataFrame, key: str, text: str, hashed: Callable[[Column], Column] = digest64) -> DataFrame:
    """``key`` and simhash64 of rows with unique keys, without Python: like ``simhash64``, with another hash of the 3-grams.

    Each distinct gram is a row; its bits are added up two to a number, in 32 sums
    that are made before anything is shuffled.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(LETTERS), F.lit(0))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 3), " "))
    one = spread(rows.select(key, text)).select(F.col(key).alias("k"), words.alias("w")).where(F.size("w") > 0).select("k", F.explode(F.array_distinct(grams)).alias("gram")).select("k", hashed(F.col("gram")).alias("h"))
    pair = F.lit((1 << 32) | 1).cast("long")
    sums = one.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(pair)).alias(f"s{i}") for i in range(32)])
    value = F.lit(0).cast("long")
    for i in range(32):
        for j, part in ((i, F.col(f"s{i}").bitwiseAND(F.lit((1 << 32) - 1).cast("long"))), (i + 32, F.shiftrightunsigned(f"s{i}", 32))):
            bit = (1 << j) - (1 << 64 if j == 63 else 0)
            value = value.bitwiseOR(F.when(2 * part > F.col("n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(F.col(key).alias(key)).join(sums.select(F.col("k").alias(key), value.alias("simhash64")), key, "left").select(key, F.coalesce("simhash64", F.lit(0).cast("long")).alias("simhash64"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def count_pieces(text: str) -> int:
    """A vocabulary-free estimate: words and single signs."""
    return len(PIECE.findall(text))


def tokenizer_counter(path: str, pattern: str = r"\s?\w+|\s?[^\w\s]+|\s+") -> Callable[[str], int]:
    """A counter of the tokens of a vocabulary: a file of ranks that each executor has at ``path``, read once a process."""

    def count(text: str) -> int:
        import tiktoken

        kept = vars(tiktoken).setdefault("_kept_counters", {})
        if path not in kept:
            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            kept[path] = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return len(kept[path].encode_ordinary(text))

    return count


def approx_tokens(column: str | Column, counter: Callable[[str], int] = count_pieces) -> Column:
    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: int(counter(t or "") * RATIO))

    return run(column)


def token_budget(n: Column) -> Column:
    out = None
    for most, name in BUDGETS:
        out = F.when(n <= most, name) if out is None else out.when(n <= most, name)
    return out.otherwise("xl")


def pending(text: DataFrame, stamps: DataFrame, days: float | None = None, limit: int | None = None, now=None) -> DataFrame:
    """Messages without a stamp, oldest first."""
    rows = text.where(since(F.col("ts"), days, now)).join(stamps.select("uuid"), "uuid", "left_anti")
    return rows.orderBy("ts", "uuid").limit(limit) if limit is not None else rows


def stamp(text: DataFrame, counter: Callable[[str], int] = count_pieces, stamped_at: Column | None = None) -> DataFrame:
    rows = text.select("uuid", "session_id", approx_tokens("text_content", counter).alias("approx_tokens"), simhash("text_content").alias("simhash64"), F.col("ts").cast("timestamp").alias("first_seen_ts"))
    return rows.select("uuid", "session_id", "approx_tokens", "simhash64", token_budget(F.col("approx_tokens")).alias("token_budget_bucket"), F.lit(None).cast("string").alias("canonical_uuid"), "first_seen_ts", (stamped_at if stamped_at is not None else F.current_timestamp()).alias("stamped_at"))


def _tables(bits: int, gate: int) -> list[tuple[int, int, list[int]]]:
    """(number, key mask, masks that come before) of the tables that find all signatures within ``bits`` errors that agree in the ``gate`` top bits.

    The other bits are cut into two blocks more than there may be errors, so that two
    blocks agree at least; a table keys on the gate and one choice of two blocks. The
    masks before are those of blocks that, if they agreed too, would make another
    table the pair's first one.
    """
    blocks, free, signed = bits + 2, 64 - gate, lambda x: x - (1 << 64) if x >> 63 else x
    cuts = [free * k // blocks for k in range(blocks + 1)]
    masks = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(cuts, cuts[1:], strict=False)]
    top = ((1 << 64) - 1) ^ ((1 << free) - 1)
    choices = combinations(range(blocks), 2)
    return [(t, signed(top | masks[i] | masks[j]), [signed(masks[k]) for k in range(j) if k != i]) for t, (i, j) in enumerate(choices)]


def near_signatures(signatures: DataFrame, bits: int = 3, gate: int = 16) -> DataFrame:
    """x and y, both ways and each with itself, of the distinct ``signatures`` (simhash64) that differ in at most ``bits`` bits and agree in the ``gate`` top ones.

    Keys are the gate and two of ``bits`` + 2 blocks, 35 bits for three errors, so
    that what shares a key does not grow with the data but for what is alike. A
    pair is compared in every table where it meets and given by the first.
    """
    distinct = signatures.select("simhash64").distinct()
    tables = [F.struct(F.lit(t).alias("t"), F.col("simhash64").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m, _ in _tables(bits, gate)]
    dealt = distinct.select("simhash64", F.explode(F.array(*tables)).alias("at"))
    a, b = (dealt.select(F.col("simhash64").alias(x), "at") for x in "xy")
    differ = F.col("x").bitwiseXOR(F.col("y"))
    first = F.lit(False)
    for t, _, before in _tables(bits, gate):
        this = F.col("at.t") == t
        for m in before:
            this = this & (differ.bitwiseAND(F.lit(m).cast("long")) != 0)
        first = first | this
    return a.join(b, "at").where((hamming(F.col("x"), F.col("y")) <= bits) & first).select("x", "y")


def canonical(stamps: DataFrame, mode: str = "earliest", bits: int = 3, exact: bool = False) -> DataFrame:
    """uuid and canonical_uuid.

    Near are stamps that differ in at most ``bits`` bits and, but with ``exact``,
    agree in the top 16. ``macro``: the smallest uuid that is not later, itself
    included; ``worker``: the smallest that is earlier, else itself; ``earliest``:
    the first seen, ties to the smallest uuid. Equal signatures are joined through
    one row each, so that copies don't multiply.
    """
    rows = stamps.select("uuid", "simhash64", F.col("first_seen_ts").alias("ts"))
    near = near_signatures(rows, bits, 0 if exact else 16)
    if mode == "earliest":
        first = rows.groupBy(F.col("simhash64").alias("y")).agg(F.min(F.struct("ts", "uuid")).alias("first"))
        best = near.join(first, "y").groupBy("x").agg(F.min("first").alias("first"))
        # The first of all near ones is not later than the row itself, which is one of them.
        return rows.join(best, rows["simhash64"] == best["x"]).select("uuid", F.col("first.uuid").alias("canonical_uuid"))
    # The smallest uuid up to each time, for each signature's neighbourhood: one sort instead of a join of all copies.
    seen = rows.select(F.col("simhash64").alias("y"), F.col("uuid").alias("seen"), "ts")
    around = near.join(seen, "y").select("x", "ts", "seen")
    w = Window.partitionBy("x").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = around.groupBy("x", "ts").agg(F.min("seen").alias("least")).withColumn("upto", F.min("least").over(w))
    if mode == "worker":
        w = Window.partitionBy("x").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
        running = running.withColumn("upto", F.min("least").over(w))
    elif mode != "macro":
        raise ValueError(mode)
    out = rows.join(running.select(F.col("x").alias("simhash64"), "ts", "upto"), ["simhash64", "ts"])
    return out.select("uuid", F.coalesce("upto", "uuid").alias("canonical_uuid"))


def resolve(stamps: DataFrame, mode: str = "earliest", **options) -> DataFrame:
    """``stamps`` with canonical_uuid filled."""
    found = canonical(stamps, mode, **options)
    return stamps.drop("canonical_uuid").join(found, "uuid", "left").select(*stamps.columns)
