"""Quality rules: a decision list learned from labels, applied as one Spark expression.

Sequential covering grows conjunctions of thresholds on document statistics that
find low quality, prunes each on rows held back, drops the rows covered and goes
on while the rules stay precise. The list becomes an ordered chain of
``when`` expressions, so that applying it needs neither Python nor a join.

Defined results: a null text counts as empty; an empty table gives no rows; no
usable label gives an empty list, which keeps everything; repeated rows are each
judged; other columns pass through, but those named like a statistic are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.text import SPACES, let, pick, words

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Statistics that rules put thresholds on, from those of ``with_statistics``.
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share")
STATISTICS = ("n_words", "word_chars", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols", *FEATURES[1:])


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(chars)).cast("long")


def n_repeat_words(ws: Column, n: int = 3) -> Column:
    """How many words lie in windows of ``n`` words that occur twice or more in ``ws``.

    Each window's hash is packed with its position and sorted, so that equal
    windows become neighbours; the words of neighbours with equal hashes are compared.
    """

    def same(w: Column, p: Column, q: Column) -> Column:
        out = F.get(w, p) == F.get(w, q)
        for j in range(1, n):
            out = out & (F.get(w, p + j) == F.get(w, q + j))
        return F.coalesce(out, F.lit(False))

    def covered(w: Column, bits: Column) -> Column:
        packed = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - n),
                lambda i: F.call_function("shiftleft", F.xxhash64(*[F.get(w, i + j) for j in range(n)]), bits).bitwiseOR(i.cast("long")),
            )
        )

        def marked(s: Column) -> Column:
            place = lambda x: F.call_function("shiftrightunsigned", F.call_function("shiftleft", x, F.lit(64) - bits), F.lit(64) - bits).cast("int")
            high = lambda x: F.call_function("shiftrightunsigned", x, bits)
            near = lambda x, y: F.coalesce((high(x) == high(y)) & same(w, place(x), place(y)), F.lit(False))
            found = F.filter(s, lambda x, k: near(x, F.get(s, k - 1)) | near(x, F.get(s, k + 1)))
            return F.sort_array(F.transform(found, place))

        spread = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x)
        return let(let(packed, marked), spread)

    return F.when(F.size(ws) <= n, F.lit(0)).otherwise(let(F.ceil(F.log2(F.size(ws) + F.lit(1))).cast("int"), lambda bits: covered(ws, bits))).cast("long")


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text, with the shares that rules use; each is evaluated once however often it is named."""
    counts = let(
        F.coalesce(text, F.lit("")),
        lambda body: F.struct(
            let(words(body), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("word_chars"), n_repeat_words(w).alias("n_repeat_words"))).alias("w"),
            let(
                F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACES}]")), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
            ).alias("l"),
            _count(body, SYMBOLS).alias("n_symbols"),
            _count(body, "[A-Z]").alias("upper"),
            _count(body, "!").alias("bang"),
            _count(body, "[0-9]").alias("digit"),
        ),
    )

    def shares(c: Column) -> Column:
        share = lambda a, b: a / F.greatest(b, F.lit(1))
        chars = c["w"]["word_chars"]
        return F.struct(
            *[c["w"][k].alias(k) for k in ("n_words", "word_chars", "n_repeat_words")],
            *[c["l"][k].alias(k) for k in ("n_lines", "n_dup_lines")],
            c["n_symbols"].alias("n_symbols"),
            share(chars, c["w"]["n_words"]).alias("word_length"),
            share(c["n_symbols"], chars).alias("symbol_share"),
            share(c["l"]["n_dup_lines"], c["l"]["n_lines"]).alias("dup_line_share"),
            share(c["w"]["n_repeat_words"], c["w"]["n_words"]).alias("repeat_share"),
            share(c["upper"], chars).alias("upper_share"),
            share(c["bang"], chars).alias("bang_share"),
            share(c["digit"], chars).alias("digit_share"),
        )

    return let(counts, shares)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the statistics of each text, which take the place of columns of the same names."""
    private = max((c for c in docs.columns), key=len, default="") + "_"  # no column's name
    out = docs.withColumn(private, statistics(docs[text]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in STATISTICS], *[F.col(f"`{private}`.{k}").alias(k) for k in STATISTICS])


@dataclass(frozen=True)
class Literal:
    """``feature <= threshold``, or ``feature > threshold`` where ``above``."""

    feature: str
    above: bool
    threshold: float

    def column(self, at: Callable[[str], Column] = F.col) -> Column:
        return at(self.feature) > F.lit(self.threshold) if self.above else at(self.feature) <= F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction; the first that holds rejects."""

    rules: tuple[tuple[Literal, ...], ...] = ()

    def rule_column(self, at: Callable[[str], Column] = F.col) -> Column:
        """The number from 1 of the first rule that holds, else 0; ``at`` gives a statistic by name."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            test = rule[0].column(at)
            for literal in rule[1:]:
                test = test & literal.column(at)
            out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def __str__(self) -> str:
        return "\n".join(" and ".join(f"{x.feature} {'>' if x.above else '<='} {x.threshold:.6g}" for x in r) for r in self.rules)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, grid: dict[str, np.ndarray], max_literals: int) -> list[Literal]:
    live, rule = np.ones(len(y), bool), []
    while len(rule) < max_literals and (~y[live]).any():
        p0, n0 = y[live].sum(), (~y[live]).sum()
        base, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, cuts in grid.items():
            values, labels = x[name][live], y[live]
            order = np.argsort(values, kind="stable")
            below = np.searchsorted(values[order], cuts, side="right")
            pos = np.concatenate(([0], np.cumsum(labels[order])))[below]
            for above, p, n in ((False, pos, below - pos), (True, p0 - pos, n0 - (below - pos))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (float(gain[k]), Literal(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= best[1].holds(x)
    return rule


def _covers(rule: list[Literal], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for literal in rule:
        out &= literal.holds(x)
    return out


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds near the quantiles, each halfway to the next larger value, so that rules leave a margin."""
    v = np.sort(values)
    low = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1), method="lower"))
    return np.unique((low + v[np.minimum(np.searchsorted(v, low, side="right"), len(v) - 1)]) / 2)


def learn(x: dict[str, np.ndarray], y: np.ndarray, held: np.ndarray, *, max_rules: int = 12, max_literals: int = 4, precision: float = 0.9, bins: int = 64) -> DecisionList:
    """Sequential covering. ``y``: what rules are to find; ``held``: rows only for pruning."""
    grid = {k: _cuts(v, bins) for k, v in x.items() if len(v)}
    left, rules = np.ones(len(y), bool), []
    while len(rules) < max_rules and (y & left & ~held).sum() >= 5:
        g, h = left & ~held, left & held
        rule = _grow({k: v[g] for k, v in x.items()}, y[g], grid, max_literals)
        if not rule:
            break
        xh, yh = {k: v[h] for k, v in x.items()}, y[h]

        def worth(r: list[Literal]) -> float:
            c = _covers(r, xh, len(yh))
            p, n = (yh & c).sum(), (~yh & c).sum()
            return float((p - n) / (p + n)) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if worth(rule) < 2 * precision - 1:
            break
        rules.append(tuple(rule))
        left &= ~_covers(rule, x, len(y))
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = 20_000, base: bool = True, **options) -> DecisionList:
    """Learn from labelled rows; with ``base``, only those that the fixed base tests don't already fail.

    ``max_train``: so many labelled rows at most, chosen by a hash of doc_id; it
    bounds what is broadcast and what reaches the driver (a few numbers a row).
    """
    chosen = pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "quality").limit(max_train)
    # No filter or sort follows: a filter on the statistics would be pushed below the join, and a sort would run them twice.
    # Of rows that share an id one is learned from, the least, so that no more rows are collected than labels are chosen.
    stats = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", statistics(F.col("text")).alias("s"))
    told = stats.groupBy("doc_id", "quality").agg(F.min("s").alias("s")).select("doc_id", "quality", *[F.col(f"s.{k}").alias(k) for k in FEATURES], base_failed(at=lambda k: F.col(f"s.{k}")).alias("base_failed"))
    got = sorted(r for r in told.collect() if not (base and r["base_failed"]))
    x = {k: np.array([r[k] for r in got], float) for k in FEATURES}
    y = np.array([r["quality"] == 0 for r in got], bool)
    held = np.random.default_rng(0).random(len(got)) < 1 / 3
    return learn(x, y, held, **options)


def base_failed(min_words: int = 50, max_repeat_percent: int = 50, at: Callable[[str], Column] = F.col) -> Column:
    return (at("n_words") < min_words) | (100 * at("n_repeat_words") > max_repeat_percent * at("n_words"))


def judge(docs: DataFrame, rules: DecisionList, *, base: bool = True) -> DataFrame:
    """``docs`` with statistics, ``base_failed``, the ``rule`` that fired (0: none) and ``kept``; without ``base`` the rules alone decide."""
    out = with_statistics(docs).withColumns({"base_failed": base_failed(), "rule": rules.rule_column()})
    fired = F.col("rule") != 0
    return out.withColumn("kept", ~(F.col("base_failed") | fired) if base else ~fired)


def keep(docs: DataFrame, rules: DecisionList, *, base: bool = True) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, by a filter that evaluates the statistics once a row.

    A filter on ``judge``'s columns would be pushed below them, and each statistic
    that a rule names would be evaluated anew.
    """

    def rejected(s: Column) -> Column:
        fired = rules.rule_column(s.getField) != 0
        return (base_failed(at=s.getField) | fired) if base else fired

    return docs.where(~let(statistics(docs["text"]), rejected))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
