"""All rows of one frame beside all rows of another, a block of vectors against a block.

``packed`` makes one row of some thousand vectors: their ids and one matrix. Frames of
such rows are small in number, so that Spark's Cartesian product of the two reads the
blocks where they are kept, again for each block beside them, and shuffles nothing.
``beside`` gives a task all pairs of its blocks one after another, and ``Best`` keeps
the best of each row meanwhile: what leaves a task doesn't grow with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.plans.checkpoints import checkpointed

#: Rows of a block at most, and at least if blocks are made smaller so that all cores have some; rows of a matrix of similarities.
MOST, LEAST, AT_ONCE = 8192, 1024, 256
#: Pairs whose exact values are found at once.
PAIRS = 1 << 16


def matrix(column: pa.Array | pa.ChunkedArray, of: str = "<f8") -> np.ndarray:
    """A column of arrays of one length; none of it is null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(pc.list_flatten(column), np.dtype(of))
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), of)


def units(data: bytes, n: int) -> np.ndarray:
    """The vectors of a block, scaled to length 1; zeros stay."""
    m = np.frombuffer(data).reshape(n, -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def packed(rows: DataFrame, blocks: int | None = None) -> DataFrame:
    """A row a block: ``block``, ``ids`` (ascending) and, of each other column, the bytes of one array of eight-byte floats.

    ``rows`` has id and columns of numbers or of arrays of numbers, each of one length.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if blocks is None:
        n = rows.count()
        blocks = max(1, -(-n // MOST), min(3 * cores, n // LEAST))
    (_, kind), *others = rows.dtypes

    def run(batches):
        held, n = [], 0

        def out():
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table["id"]))
            for a in range(0, len(table), MOST):
                part = table.slice(a, MOST)
                wide = [(matrix(part[c]) if t.startswith("array") else np.asarray(part[c], "<f8")).tobytes() for c, t in others]
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part["id"].combine_chunks())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in wide)], names=["ids", *(c for c, _ in others)])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= MOST:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    made = rows.repartition(blocks).mapInArrow(run, ", ".join([f"ids array<{kind}>", *(f"{c} binary" for c, _ in others)]))
    return checkpointed(made.select(F.monotonically_increasing_id().alias("block"), "*"))


def beside(left: DataFrame, right: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over all pairs of blocks of two ``packed`` frames, whose columns begin with ``a_`` and ``b_``.

    A task has pairs of few blocks of the left with many of the right, as long as Spark
    finds the blocks equally near; ``run`` must not rely on that.
    """
    a, b = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]) for side, df in (("a", left), ("b", right)))
    tasks = max(left.rdd.getNumPartitions(), 3 * left.sparkSession.sparkContext.defaultParallelism)
    return a.join(b.hint("shuffle_replicate_nl")).coalesce(tasks).mapInArrow(run, schema)


class Best:
    """The ``k`` greatest products of each of some rows with those of block after block; equal ones by id, the smaller first."""

    def __init__(self, left: np.ndarray, k: int):
        """``left``: vectors of length 1 at most, or not much more."""
        self.left, self.narrow, self.k = left, left.astype(np.float32), k
        self.floor = np.full(len(left), -np.inf)
        self.held = pd.DataFrame({"row": np.zeros(0, np.int64), "id": np.zeros(0, object), "score": np.zeros(0)})
        self.new: list[pd.DataFrame] = []

    def add(self, right: np.ndarray, ids: np.ndarray, own: np.ndarray | None = None, shut: Callable | None = None) -> None:
        """``ids`` ascend; ``own``: the rows' own ids, which are left out; ``shut``: given a slice of rows, which of the block they can't have.

        A product in single precision is wrong by less than ``slack``; those that it
        leaves in question are found in double precision, pair by pair, so that equal
        vectors have equal scores wherever they lie.
        """
        if not len(right) or not len(self.left):
            return
        narrow, k = right.astype(np.float32).T, self.k
        longest = float(np.sqrt((right * right).sum(1).max())) if right.size else 0.0
        slack = (right.shape[1] + 8) * 2.0**-22 * max(1.0, longest)
        some = k + (int(pd.Series(ids).value_counts().max()) if own is not None else 0)
        for a in range(0, len(self.left), AT_ONCE):
            at = slice(a, a + AT_ONCE)
            near = self.narrow[at] @ narrow
            if shut is not None:
                near[shut(at)] = -np.inf
            floor = self.floor[at]
            if len(ids) > some and not np.isfinite(floor).all():
                floor = np.maximum(floor, np.partition(near, -some, axis=1)[:, -some])
            row, col = np.nonzero(near >= (floor - 2 * slack).astype(np.float32)[:, None])
            fine = near[row, col] > -np.inf
            if own is not None:
                fine &= own[at][row] != ids[col]
            row, col = row[fine] + a, col[fine]
            score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.left[row[i : i + PAIRS]], right[col[i : i + PAIRS]]) for i in range(0, len(row), PAIRS))])
            score = np.round(score, 12)
            order = np.lexsort((col, -score, row))
            row, col, score = row[order], col[order], score[order]
            first = np.searchsorted(row, row)
            top = np.arange(len(row)) - first < k
            if top.any():
                self.new.append(pd.DataFrame({"row": row[top], "id": ids[col[top]], "score": score[top]}))
        if sum(map(len, self.new)) >= min(len(self.left) * k, max(len(self.held), 1)):
            self.settle()

    def settle(self) -> pd.DataFrame:
        """row, id and score of the best so far."""
        if self.new:
            found = pd.concat([x for x in (self.held, *self.new) if len(x)], ignore_index=True).sort_values(["row", "score", "id"], ascending=[True, False, True], kind="stable")
            self.held, self.new = found[(found.groupby("row").cumcount() < self.k).to_numpy()], []
            full = self.held.groupby("row")["score"].agg(["size", "min"])
            full = full[full["size"] == self.k]
            self.floor[full.index.to_numpy()] = full["min"].to_numpy()
        return self.held


def pairs(batches):
    """Row after row of what ``beside`` gives, as a dictionary; ids are arrays of objects."""
    for batch in batches:
        for i in range(len(batch)):
            row = {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            yield {k: np.array(v.values.to_pylist(), object) if k.endswith("_ids") else v.as_py() for k, v in row.items()}
