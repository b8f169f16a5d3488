"""Tables kept as parquet folders: shards, replacement by key, compaction, freshness."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell import schemas

#: Files of so many bytes hold no table.
EMPTY = 16


def parts(target: str | Path) -> list[Path]:
    """The parquet files of a table that hold something."""
    p = Path(target)
    recover(p)
    found = [p] if p.is_file() else sorted(x for x in p.rglob("*.parquet") if not any(y.startswith((".", "_")) for y in x.relative_to(p).parts)) if p.is_dir() else []
    return [x for x in found if x.stat().st_size > EMPTY]


def recover(target: Path) -> None:
    """Puts back the table that a writer had moved away when it ended between its two renames."""
    if not target.exists() and target.parent.is_dir():
        old = sorted(target.parent.glob(f".{target.name}-old-*"), key=lambda x: x.stat().st_mtime_ns)
        if old:
            with contextlib.suppress(FileNotFoundError):  # the writer was only about to put the new one there
                os.rename(old[-1], target)


def ready(target: str | Path) -> bool:
    return bool(parts(target))


def read(spark: SparkSession, target: str | Path, columns: list[str] | None = None, name: str | None = None) -> DataFrame:
    """A table; where it is missing and ``name`` is one of ours, no rows of its schema."""
    found = parts(target)
    if not found:
        if name is None:
            raise FileNotFoundError(str(target))
        df = spark.createDataFrame([], schemas.TABLES[name])
    else:
        df = spark.read.option("mergeSchema", "true").parquet(*map(str, found))
    return df.select(*columns) if columns else df


def footer_rows(target: str | Path) -> int:
    """Rows by the files' footers alone."""
    import pyarrow.parquet as pq

    return sum(pq.read_metadata(p).num_rows for p in parts(target))


def append(df: DataFrame, target: str | Path) -> None:
    df.write.mode("append").parquet(str(target))


def overwrite(df: DataFrame, target: str | Path) -> None:
    """Replace a table by a frame that may read it: written beside it, then swapped in."""
    target = Path(target)
    side = target.with_name(f".{target.name}-{uuid.uuid4().hex}")
    df.write.parquet(str(side))
    old = target.with_name(f".{target.name}-old-{uuid.uuid4().hex}")
    if target.exists():
        os.rename(target, old)
    os.rename(side, target)
    if old.is_dir():
        shutil.rmtree(old)
    elif old.exists():
        old.unlink()


def replace_by_key(spark: SparkSession, target: str | Path, key: str, ids: DataFrame) -> int:
    """Drop the rows whose key is among ``ids``; how many went."""
    if not ready(target):
        return 0
    old = read(spark, target)
    before = old.count()
    kept = old.join(ids.select(ids[key].alias(key)).distinct(), key, "left_anti").select(*old.columns)
    overwrite(kept, target)
    return before - footer_rows(target)


def compact(spark: SparkSession, target: str | Path, files: int = 1, dry_run: bool = True) -> dict:
    """All parts as ``files`` files; a plan only, unless told otherwise; nothing to do for one part."""
    n = len(parts(target))
    plan = {"target": str(target), "parts": n, "compacted": False}
    if n > files and not dry_run:
        overwrite(read(spark, target).coalesce(files), target)
        plan["compacted"] = True
    return plan


def to_folder(target: str | Path, dry_run: bool = True) -> bool:
    """Turn a single-file table into a folder that holds the file, its time of change kept."""
    p = Path(target)
    if not p.is_file():
        return False
    if not dry_run:
        side = p.with_name(f".{p.name}-{uuid.uuid4().hex}")
        side.mkdir()
        os.rename(p, side / f"part-{time.time_ns()}.parquet")
        os.rename(side, p)
    return True


def table_mtime(target: str | Path) -> int | None:
    return max((p.stat().st_mtime_ns for p in parts(target)), default=None)


def is_fresh(output: str | Path, source_mtime: int | None, sidecar: str | Path) -> bool:
    """Whether the output holds something and was made from exactly this state of the source."""
    if source_mtime is None or not ready(output):
        return False
    try:
        return json.loads(Path(sidecar).read_text())["mtime_ns"] == source_mtime
    except (OSError, ValueError, KeyError, TypeError):
        return False


def stamp(sidecar: str | Path, source_mtime: int) -> None:
    p = Path(sidecar)
    side = p.with_name(f".{p.name}-{uuid.uuid4().hex}")
    side.write_text(json.dumps({"mtime_ns": source_mtime}))
    os.replace(side, p)


def identity(embeddings: DataFrame) -> tuple[str, int] | None:
    """Model and dimension of a vector table, None of an empty one."""
    row = embeddings.select("model", "dim").limit(1).collect()
    return (row[0]["model"], row[0]["dim"]) if row else None


def guard(stored: tuple[str, int] | None, model: str, dim: int | None) -> None:
    """Refuse to mix vectors of different models or dimensions; an empty table takes any."""
    if stored is None:
        return
    if stored[0] != model:
        raise ValueError(f"the table's vectors are of {stored[0]}, not {model}")
    if dim is not None and stored[1] != dim:
        raise ValueError(f"the table's vectors have {stored[1]} dimensions, not {dim}")


def ids_frame(spark: SparkSession, key: str, ids: list[str]) -> DataFrame:
    """A list of ids as a relation to join with, instead of as parameters."""
    return spark.createDataFrame([(i,) for i in ids], f"{key} string").select(F.col(key)).distinct()
