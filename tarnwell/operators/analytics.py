"""Views over the tables that pipelines write; each exists only where its table does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_classifications(table: DataFrame) -> DataFrame:
    return table.withColumns({"autonomy": F.col("autonomy_tier"), "success_outcome": F.col("success"), "category": F.col("work_category")})


def session_goals(table: DataFrame) -> DataFrame:
    return table.select("session_id", "goal", "confidence", "classified_at")


def latest(table: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key that is last by ``by``, nulls being earliest; ties by the other columns."""
    rest = [c for c in table.columns if c not in keys and c != by]
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rest])
    return table.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def message_trajectory(table: DataFrame) -> DataFrame:
    one = latest(table, ["session_id", "prev_uuid", "curr_uuid"], "classified_at")
    return one.withColumns({"sentiment": F.col("curr_sentiment"), "transition": F.col("is_transition")})


def conflicts_summary(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("session_id").agg(F.count(F.lit(1)).alias("conflict_count"))


def skill_usage(invocations: DataFrame, catalog: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """Invocations with what the catalog says. A skill of several kinds is matched once, unless ``parity``."""
    if catalog is None:
        none = lambda name: F.lit(None).cast("string").alias(name)
        return invocations.select("*", F.col("skill_id").alias("skill_name"), none("plugin"), none("plugin_version"), none("description"), none("source_kind"), F.lit(False).alias("is_builtin"))
    cat = catalog.select("skill_id", "name", "plugin", "plugin_version", "description", "source_kind")
    if not parity:
        order = F.array_position(F.array(*map(F.lit, ("user-skill", "plugin-skill", "plugin-command", "builtin"))), F.col("source_kind"))
        w = Window.partitionBy("skill_id").orderBy(order, F.col("plugin").asc_nulls_first(), "name")
        cat = cat.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    out = invocations.join(cat, "skill_id", "left")
    return out.select(*invocations.columns, F.coalesce("name", "skill_id").alias("skill_name"), "plugin", "plugin_version", "description", "source_kind", F.coalesce(F.col("source_kind") == "builtin", F.lit(False)).alias("is_builtin"))
