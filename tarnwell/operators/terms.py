"""Terms that mark clusters: class-based TF-IDF over word 1- and 2-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import spread
from tarnwell.plans.checkpoints import checkpointed

#: Letters with marks that are common enough to fold without Python; others stay as they are. Fixed values.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorsstuuuzzz"


def fold(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def pseudo_docs(clusters: DataFrame, text: DataFrame) -> DataFrame:
    """cluster_id and the texts of its messages, ordered by uuid, a line each."""
    rows = clusters.where("cluster_id >= 0").select("uuid", "cluster_id").join(text.select("uuid", "text_content"), "uuid")
    body = F.transform(F.sort_array(F.collect_list(F.struct("uuid", "text_content"))), lambda x: x["text_content"])
    return rows.groupBy("cluster_id").agg(F.array_join(body, "\n").alias("body"))


def ngrams(df: DataFrame, key: str, text: str, most: int = 2) -> DataFrame:
    """``key`` and term for each 1- to ``most``-gram of words of two letters or more."""
    words = F.regexp_extract_all(fold(F.col(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))

    def grams(w: Column, n: int) -> Column:
        if n == 1:
            return w
        spread = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]))
        return F.when(F.size(w) >= n, spread).otherwise(F.array().cast("array<string>"))

    held = df.select(F.col(key), F.transform(F.array(words), lambda w: F.concat(*[grams(w, n) for n in range(1, most + 1)]))[0].alias("terms"))
    return held.select(key, F.explode("terms").alias("term"))


def ctfidf(df: DataFrame, key: str, text: str, *, top: int = 10, min_df: int = 2, max_df: float = 0.95, most: int = 2) -> DataFrame:
    """``key``, term, weight and rank (1-based) of each class's terms.

    A term counts if ``min_df`` classes or more and at most ``max_df`` of them
    have it. Its weight is its share of the class's terms times ln(1 + 1 / f), f
    being its summed frequency over the average class, whose sum is 1 here.
    Rows of one class may be many; each is exploded where it lies and counted
    before the shuffle.
    """
    counts = checkpointed(ngrams(spread(df.select(key, text)), key, text, most).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))  # used three times
    classes = df.select(key).distinct().agg(F.count(F.lit(1)).alias("n_classes"))
    over = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("f")).crossJoin(F.broadcast(classes))  # one row
    kept = over.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_classes"))).select("term", "f")
    rows = counts.join(kept, "term")
    total = rows.groupBy(key).agg(F.sum("tf").alias("total"))
    weight = F.col("tf") / F.col("total") * F.log(1 + 1 / F.col("f"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 12)), "term")
    out = rows.join(total, key).select(key, "term", weight.alias("weight")).where("weight > 0")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def cluster_terms(clusters: DataFrame, text: DataFrame, **options) -> DataFrame:
    rows = clusters.where("cluster_id >= 0").select("uuid", "cluster_id").join(text.select("uuid", "text_content"), "uuid")
    out = ctfidf(rows, "cluster_id", "text_content", **options)
    return out.select("cluster_id", "term", F.col("weight").cast("float").alias("weight"), "rank")
