"""Debounce as keyed state, following files, and last-wins tables, as streams."""

import datetime
import random
import threading
import time

import pytest

from tarnwell.operators import analytics
from tarnwell.sources.buckets import Buckets
from tarnwell.streaming import watch

from .transcripts import write

START = datetime.datetime(2024, 1, 1)


def by_rule(events, quiet, longest):
    """When each path is let through, if all its events are known: bursts that end when quiet or when they waited too long."""
    out = []
    for path in {p for p, _ in events}:
        waiting = []
        for t in sorted(t for p, t in events if p == path):
            if waiting and t >= min(waiting[-1] + quiet, waiting[0] + longest if longest else 10**9):
                out.append((path, waiting[0], waiting[-1], len(waiting)))
                waiting = []
            waiting.append(t)
        out.append((path, waiting[0], waiting[-1], len(waiting)))
    return sorted(out)


@pytest.mark.parametrize("quiet,longest", [(5, 0), (5, 12)])
def test_debounce_by_event_time(spark, tmp_path, quiet, longest):
    draw = random.Random(quiet + longest)
    events = [(draw.choice("abc"), t) for t in range(0, 36) if draw.random() < 0.45]
    for k, (p, t) in enumerate([*events, ("end", 500), ("end", 501), ("end", 502)]):  # a file is a batch; the last ones move the watermark on
        spark.createDataFrame([(p, START + datetime.timedelta(seconds=t))], "path string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    stream = spark.readStream.schema("path string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("at", "0 seconds")
    out = watch.debounced(stream, quiet, longest, at="at")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(150)
    zero = int(START.replace(tzinfo=datetime.UTC).timestamp() * 1000)
    got = sorted((r["path"], (r["first_ms"] - zero) // 1000, (r["latest_ms"] - zero) // 1000, r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [r for r in got if r[0] != "end"] == by_rule(events, quiet, longest)


def test_watch_flushes_once_for_a_burst(spark, tmp_path):
    root = write(tmp_path / "c")
    table = watch.RawTable(spark, f"{root}/project/*.jsonl")
    table.register()
    path = root / "project" / "s1.jsonl"
    line = path.read_text().splitlines()[0]

    def grow():
        for k in range(3):
            time.sleep(3 if not k else 0.7)
            path.write_text(path.read_text() + line.replace('"u1"', f'"u9{k}"') + "\n")

    writer = threading.Thread(target=grow)
    writer.start()
    totals = watch.watch(table, str(tmp_path / "state"), quiet=3, longest=0, interval="500 milliseconds", on_flush=lambda d: 5, most_flushes=1, seconds=90)
    writer.join()
    assert (totals.flushes, totals.files, totals.embedded) == (1, 1, 5)
    assert table.frame.where("uuid like 'u9%'").count() == 3


def test_replayed_events_equal_the_batch_view(spark, tmp_path):
    draw = random.Random(4)
    rows = [(f"s{draw.randrange(12)}", draw.randrange(30), f"v{draw.randrange(5)}") for _ in range(120)]
    rows += rows[:30]  # repeated, and late
    schema = "session_id string, classified_at long, label string"
    for k in range(0, len(rows), 50):
        spark.createDataFrame(rows[k : k + 50], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = Buckets(spark, f"{tmp_path}/table", schema, ("session_id",), 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = watch.keep_latest(stream, table, ("classified_at",), f"{tmp_path}/state")
    assert query.awaitTermination(120)
    want = {}
    for s, t, v in rows:
        want[s] = max(want.get(s, (t, v)), (t, v))
    assert {r["session_id"]: (r["classified_at"], r["label"]) for r in table.read().collect()} == want
    batch = analytics.latest(spark.createDataFrame(rows, schema), ["session_id"], "classified_at")
    assert {r["session_id"]: r["classified_at"] for r in batch.collect()} == {s: t for s, (t, _) in want.items()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    schema = "k string, v int"
    table = Buckets(spark, f"file://{tmp_path}/table", schema, ("k",), 8)
    assert table.read().count() == 0
    table.replace(spark.createDataFrame([(f"k{i}", i) for i in range(40)] + [(None, -1)], schema))
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}
    before = files()
    table.replace(spark.createDataFrame([("k3", 300, "x"), ("k3", 301, "y")], "k string, v int, other string"))
    after = files()
    changed = {f.split("_bucket=")[1].split("/")[0] for f, _ in set(after.items()) ^ set(before.items())}
    assert len(changed) == 1 and len(before) >= 7
    got = sorted(map(tuple, table.read().collect()), key=repr)
    assert got == sorted([(f"k{i}", i) for i in range(40) if i != 3] + [("k3", 300), ("k3", 301), (None, -1)], key=repr)
    table.replace(spark.createDataFrame([(None, -2)], schema))
    assert table.read().where("k is null").collect()[0]["v"] == -2 and table.read().count() == 42
    table.replace(spark.createDataFrame([], schema))
    assert table.read().count() == 42
