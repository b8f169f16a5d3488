"""Output of whole results, walks, numbering, stamps, models' patience, tables that a writer left half-way."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from tarnwell import cli
from tarnwell.operators import graph, models, stamps, views
from tarnwell.sources import store


def test_all_rows_are_written(spark):
    df = spark.range(12_345).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit('a,"b '), "id")).alias("b"), F.array("id").alias("c"))
    for form, count in (("ndjson", 12_345), ("csv", 12_346), ("table", 12_346)):
        out = io.StringIO()
        cli.emit(df, form, out)
        assert len(out.getvalue().splitlines()) == count
    out = io.StringIO()
    cli.emit(df.where("id < 2").orderBy("id"), "json", out)
    assert json.loads(out.getvalue()) == [{"id": 0, "b": 'a,"b 0', "c": [0]}, {"id": 1, "b": None, "c": [1]}]
    out = io.StringIO()
    cli.emit(df.limit(0), "json", out)
    assert out.getvalue() == "[]\n"


def test_walks_of_any_depth_and_circles(spark):
    chain = [(f"m{i}", f"m{i - 1}" if i else None) for i in range(5000)]
    circle = [("x", "y"), ("y", "x"), ("below", "y")]
    got = {r["uuid"]: r["depth"] for r in views.thread_walk(spark.createDataFrame(chain + circle, "uuid string, parent_uuid string")).collect()}
    assert len(got) == 5000 and got["m4999"] == 4999


def test_numbers_follow_one_order(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 101).alias("x")).repartition(7)
    got = {r["id"]: r["nr"] for r in graph.numbered(df, F.desc("x"), F.asc("id")).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda t: t[1])] == sorted(range(1000), key=lambda i: (-(i * 7919 % 101), i)) and sorted(got.values()) == list(range(1000))


def test_stamps_of_a_batch_are_those_of_each():
    texts = [None, "", "one", "two words", "The same words, the same words, the same words.", "x y z " * 50, " \n ", "a longer text with a few more words in it"]
    assert stamps.simhashes(texts).tolist() == [stamps.simhash64(t) for t in texts]
    assert stamps.simhashes([]).tolist() == []


def test_tokens_by_a_vocabulary():
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    assert stamps.tokenizer_counter(path)("the quick brown fox") == 4


def test_models_are_asked_again():
    waits, left = [], [3]

    def model(text):
        left[0] -= 1
        if left[0] > 0:
            raise OSError("busy")
        return {"a": text}

    assert models.patient(model, sleep=waits.append)("x") == {"a": "x"} and waits == [2.0, 4.0]

    def never(text):
        raise OSError("down")

    with pytest.raises(OSError):
        models.patient(never, tries=4, sleep=waits.append)("x")
    asked = []

    def refuses(text):
        asked.append(text)
        raise models.Refused("no")

    with pytest.raises(models.Refused):
        models.patient(refuses, sleep=waits.append)("x")
    assert asked == ["x"]


def test_providers_by_name():
    assert models.model_of("echo", answer={"x": 1})("t") == {"x": 1}
    assert models.model_of("replies", call=lambda t: {"content": [{"type": "text", "text": '{"y": 2}'}]})("t") == {"y": 2}
    assert models.model_or_none("replies") is None
    with pytest.raises(ValueError):
        models.model_of("nowhere")
    assert models.estimate("friction", 10) == {"pending": 10, "calls": 5, "tokens_in": 200, "tokens_out": 60, "usd": 0.0075}


def test_a_table_left_between_two_renames_comes_back(spark, tmp_path):
    target = tmp_path / "table"
    store.append(spark.range(5), target)
    os.rename(target, tmp_path / ".table-old-1")
    assert store.read(spark, target).count() == 5 and store.ready(target)
