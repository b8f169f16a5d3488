"""Communities by the constant Potts model, of graphs of any size: Leiden's phases as rounds of joins.

Quality is the weight inside communities less ``gamma`` for each pair of their
nodes. A level has three phases. Nodes move to the community with the largest gain;
inside each community nodes then merge anew from single ones (refinement), which
leaves well connected pieces; the pieces are the next level's nodes, and begin in
the communities that the moves gave.

A round moves many nodes at once and never loses quality. A coin for each community
says whether it gives or takes in this round. Nodes that leave one community, or
come to one, together change at worst what they gain alone by ``gamma`` times the
products of their sizes; so a share of them is drawn that keeps this below the gains
that they add up to, and of these the ones stay that keep it below their own.

No community spans two connected components. A component with up to ``SMALL`` edges,
at whatever level it gets there, is finished by one task (``graph.cpm``, the same
phases in turn); the others go on. Several resolutions share the rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.plans.checkpoints import Scratch

#: Edges of a component that one task may hold; rounds of moves and of merges in a level.
SMALL, MOVES, MERGES = 50_000, 30, 6
#: A level's rounds end when two in a row move no more than this share of its nodes.
FEW = 0.002
#: Numbers of nodes stay below; new communities are numbered beyond.
NEW = 1 << 40
LEAST = 1e-12


def _draw(name: str, round_: int, seed: int):
    """A number from 0 to 1 for each value of a column."""
    return F.pmod(F.xxhash64(name, F.lit(round_), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _proposals(edges: DataFrame, state: DataFrame, round_: int, seed: int, merging: bool, keep: Scratch) -> DataFrame:
    """g, id, size, home, target and gain of the nodes that would move. ``merging``: only single ones, along well connected pieces of their bound."""
    mass = state.groupBy("g", F.col("comm").alias("to")).agg(F.sum("size").alias("mass"), F.max("whole").alias("whole"))
    sums = edges.join(state.select("g", F.col("id").alias("dst"), F.col("comm").alias("to")), ["g", "dst"]).groupBy("g", F.col("src").alias("id"), "to").agg(F.sum("weight").alias("weight"))
    own = state.select("g", "id", "size", F.col("comm").alias("home"), "whole").join(mass.select("g", F.col("to").alias("home"), F.col("mass").alias("own")), ["g", "home"])
    linked = sums.join(own, ["g", "id"])
    if merging:
        linked = keep(linked)
        cut = linked.where("to <> home").groupBy("g", F.col("home").alias("to")).agg(F.sum("weight").alias("cut"))
        mass = mass.join(cut, ["g", "to"], "left").select("g", "to", "mass", (F.coalesce("cut", F.lit(0.0)) >= F.col("g") * F.col("mass") * (F.col("whole") - F.col("mass"))).alias("joined"))
    else:
        mass = mass.select("g", "to", "mass", F.lit(True).alias("joined"))
    linked = linked.join(mass, ["g", "to"])
    takes = (F.col("to") != F.col("home")) & (_draw("to", round_, seed) < 0.5) & F.col("joined")
    value = F.col("weight") - F.col("g") * F.col("size") * F.col("mass")
    found = linked.groupBy("g", "id").agg(
        F.first("size").alias("size"),
        F.first("home").alias("home"),
        F.first("own").alias("own"),
        F.first("whole").alias("whole"),
        F.sum("weight").alias("all"),
        F.sum(F.when(F.col("to") == F.col("home"), F.col("weight")).otherwise(0.0)).alias("inner"),
        F.max(F.when(takes, F.struct(value.alias("value"), (-F.col("to")).alias("to")))).alias("best"),
    )
    stay = F.col("inner") - F.col("g") * F.col("size") * (F.col("own") - F.col("size"))
    best = F.coalesce(F.col("best.value"), F.lit(float("-inf")))
    found = found.where(_draw("home", round_, seed) >= 0.5)
    if merging:
        linked_well = F.col("all") >= F.col("g") * F.col("size") * (F.col("whole") - F.col("size"))
        found = found.where((F.col("own") == F.col("size")) & linked_well)
        target, gain = -F.col("best.to"), best - stay
    else:
        alone = F.col("own") == F.col("size")
        off = ~alone & (best < 0)  # better by itself than in the best of the others
        target = F.when(off, F.col("id") + F.lit(NEW) * (round_ + 1)).otherwise(-F.col("best.to"))
        gain = F.when(off, F.lit(0.0)).otherwise(best) - stay
    return found.select("g", "id", "size", "home", target.alias("target"), gain.alias("gain")).where(F.col("gain") > LEAST)


def _agreed(moves: DataFrame, round_: int, seed: int, keep: Scratch) -> DataFrame:
    """g, id and target of the moves that can be made together without loss."""

    def by(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy("g", side).agg(F.sum("size").alias("t"), F.sum(F.col("size") * F.col("size")).alias("squares"), F.sum("gain").alias("gains"))

    moves = keep(moves)
    for side in ("target", "home"):
        clash = F.col("g") * (F.col("t") * F.col("t") - F.col("squares"))
        share = by(moves, side).select("g", side, F.when(clash > 0, F.least(F.lit(1.0), F.col("gains") / clash)).otherwise(1.0).alias(f"share_{side}"))
        moves = moves.join(share, ["g", side])
    drawn = keep(moves.where(_draw("id", round_, seed + 1) < F.least("share_target", "share_home")).select("g", "id", "size", "home", "target", "gain"))
    both = drawn
    for side in ("target", "home"):
        both = both.join(by(drawn, side).select("g", side, F.col("t").alias(f"t_{side}")), ["g", side])
    lost = F.col("g") * F.col("size") * (F.col("t_target") + F.col("t_home") - 2 * F.col("size")) / 2
    return both.where(F.col("gain") - lost > 0).select("g", "id", "target")


def _rounds(edges: DataFrame, state: DataFrame, most: int, first: int, seed: int, merging: bool, keep: Scratch) -> DataFrame:
    """``state`` after rounds of moves: until two in a row, with other coins, move next to nothing."""
    still, last = 0, keep.mark()
    for round_ in range(first, first + most):
        agreed = _agreed(_proposals(edges, state, round_, seed, merging, keep), round_, seed, keep)
        state = keep(state.drop("moved").join(agreed, ["g", "id"], "left").select("g", "id", "size", F.coalesce("target", "comm").alias("comm"), "component", "whole", F.col("target").isNotNull().alias("moved")))
        keep.forget(last, state)
        told = state.agg(F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("moved")).first()
        still = 0 if told["moved"] > FEW * told["n"] else still + 1
        if still == 2:
            break
    return state.drop("moved")


def _one_task(edges: DataFrame, state: DataFrame, seed: int) -> DataFrame:
    """g, id and comm of components of a bounded number of edges."""
    from tarnwell.operators.graph import cpm

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id")
        ids = b["id"].tolist()
        if not len(a):
            return pd.DataFrame({"g": b["g"], "id": ids, "comm": b["comm"]})
        labels, _ = cpm(ids, list(zip(a["src"], a["dst"], a["weight"], strict=True)), float(b["g"].iloc[0]), seed, sizes=b["size"].tolist(), start=b["comm"].tolist())
        first: dict[int, int] = {}
        for x in ids:
            first.setdefault(labels[x], x)
        return pd.DataFrame({"g": b["g"], "id": ids, "comm": [first[labels[x]] for x in ids]})

    once = edges.where("src < dst").select("g", "component", "src", "dst", "weight")
    return once.groupBy("g", "component").cogroup(state.select(*[F.col(c).alias(c) for c in ("g", "component", "id", "size", "comm")]).groupBy("g", "component")).applyInPandas(run, "g double, id long, comm long")


def communities(edges: DataFrame, nodes: DataFrame, gammas: Sequence[float], seed: int = 42, small: int = SMALL) -> DataFrame:
    """g, id and community (its smallest id) of each of ``nodes`` (id) at each of ``gammas``; ``edges``: src, dst, weight, each pair once."""
    from tarnwell.operators.graph import connected, numbered

    spark = nodes.sparkSession
    keep = Scratch(spark)
    parts = connected(edges, nodes)
    named = keep(numbered(parts, F.col("id")).withColumnRenamed("component", "part"))
    named = named.join(named.select(F.col("id").alias("part"), F.col("nr").alias("component")), "part").select("id", "nr", "component")
    named = keep(named)
    at = lambda side: named.select(F.col("id").alias(side), F.col("nr").alias(f"{side}_nr"))
    pairs = edges.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight")).join(at("src"), "src").join(at("dst"), "dst")
    pairs = pairs.join(named.select(F.col("nr").alias("src_nr"), "component"), "src_nr").select(F.col("src_nr").alias("src"), F.col("dst_nr").alias("dst"), "weight", "component")
    pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "component"))
    each = F.broadcast(spark.createDataFrame([(float(g),) for g in gammas], "g double"))
    edges = keep(pairs.crossJoin(each).select("g", "src", "dst", "weight", "component"))  # once for each resolution
    state = keep(named.crossJoin(each).select("g", F.col("nr").alias("id"), F.lit(1).cast("long").alias("size"), F.col("nr").alias("comm"), "component", F.lit(0).cast("long").alias("whole")))
    member = keep(state.select("g", F.col("id").alias("nr"), "id"))
    done, level = None, 0
    while True:
        counts = edges.groupBy("g", "component").agg(F.count(F.lit(1)).alias("n"))
        large = keep(counts.where(F.col("n") > 2 * small).select("g", "component"))
        rest = _one_task(edges.join(large, ["g", "component"], "left_anti"), state.join(large, ["g", "component"], "left_anti"), seed)
        found = member.join(rest, ["g", "id"]).select("g", "nr", "comm")
        done = keep(found if done is None else done.unionByName(found))
        if not large.limit(1).count():
            break
        edges = keep(edges.join(large, ["g", "component"], "left_semi"))
        state = keep(state.join(large, ["g", "component"], "left_semi"))
        before = state.groupBy("g").agg(F.count(F.lit(1)).alias("before"))
        first = level * (MOVES + MERGES)
        moved = _rounds(edges, state, MOVES, first, seed, merging=False, keep=keep)
        # Refinement: single nodes merge inside the communities that the moves gave.
        whole = moved.groupBy("g", "comm").agg(F.sum("size").alias("whole"), F.min("id").alias("bound"))
        bound = keep(moved.drop("whole").join(whole, ["g", "comm"]).select("g", "id", "size", "component", "whole", "bound"))
        b = lambda side: bound.select("g", F.col("id").alias(side), F.col("bound").alias(f"{side}_in"))  # noqa: B023, E731
        inside = keep(edges.join(b("src"), ["g", "src"]).join(b("dst"), ["g", "dst"]).where("src_in = dst_in").select("g", "src", "dst", "weight"))
        fine = _rounds(inside, bound.select("g", "id", "size", F.col("id").alias("comm"), "component", "whole"), MERGES, first + MOVES, seed, merging=True, keep=keep)
        names = fine.groupBy("g", "comm").agg(F.min("id").alias("piece"))
        pieces = keep(fine.join(names, ["g", "comm"]).join(bound.select("g", "id", "bound"), ["g", "id"]).select("g", "id", "piece", "size", "component", "bound"))
        # A resolution whose graph hardly shrinks any more keeps the communities it has.
        after = pieces.groupBy("g").agg(F.count_distinct("piece").alias("after"))
        stuck = keep(before.join(after, "g").where("after > 0.98 * before").select("g"))
        kept = member.join(pieces.join(stuck, "g", "left_semi").select("g", "id", F.col("bound").alias("comm")), ["g", "id"]).select("g", "nr", "comm")
        done = keep(done.unionByName(kept))
        pieces = keep(pieces.join(stuck, "g", "left_anti"))
        p = lambda side: pieces.select("g", F.col("id").alias(side), F.col("piece").alias(f"{side}_to"))  # noqa: B023, E731
        edges = edges.join(p("src"), ["g", "src"]).join(p("dst"), ["g", "dst"]).where("src_to <> dst_to").groupBy("g", F.col("src_to").alias("src"), F.col("dst_to").alias("dst"), "component").agg(F.sum("weight").alias("weight"))
        edges = keep(edges.select("g", "src", "dst", "weight", "component"))
        homes = pieces.groupBy("g", "bound").agg(F.min("piece").alias("comm"))
        state = keep(pieces.join(homes, ["g", "bound"]).groupBy("g", F.col("piece").alias("id"), "comm", "component").agg(F.sum("size").alias("size")).select("g", "id", "size", "comm", "component", F.lit(0).cast("long").alias("whole")))
        member = keep(member.join(pieces.select("g", "id", "piece"), ["g", "id"]).select("g", "nr", F.col("piece").alias("id")))
        level += 1
    out = done.join(named.select("id", "nr"), "nr")
    first = out.groupBy("g", "comm").agg(F.min("id").alias("community"))
    return out.join(first, ["g", "comm"]).select("g", "id", "community")


def quality(edges: DataFrame, members: DataFrame) -> DataFrame:
    """g, n (of communities) and quality of ``members`` (g, id, community)."""
    m = lambda side, name: members.select("g", F.col("id").alias(side), F.col("community").alias(name))
    inner = edges.where("src <> dst").join(m("src", "a"), "src").join(m("dst", "b"), ["g", "dst"]).where("a = b").groupBy("g").agg(F.sum("weight").alias("inner"))
    sizes = members.groupBy("g", "community").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    return sizes.join(inner, "g", "left").select("g", "n", (F.coalesce("inner", F.lit(0.0)) - F.col("g") * F.col("pairs")).alias("quality"))
