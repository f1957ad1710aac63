"""Agreement of agent coverage with a gold mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mapweave.functions.labels import bucket, gold_bucket
from mapweave.functions.text import canonical_control_id


def agent_side(rows: DataFrame, id_cell: Column, coverage: Column, order: str = "pos") -> DataFrame:
    """(id, agent): bucketed coverage, the last row of an id wins; cells without id or number are skipped."""
    number = coverage.try_cast("double")
    return (rows.select(canonical_control_id(id_cell).alias("id"), F.when(number.isNotNull(), bucket(number)).alias("b"), order)
            .filter((F.col("id") != "") & F.col("b").isNotNull()).groupBy("id").agg(F.max_by("b", order).alias("agent")))


def gold_side(rows: DataFrame, cells: list[str]) -> DataFrame:
    """(id, gold): first cell holding an id, first cell holding a label; the highest bucket of an id counts."""
    found = [canonical_control_id(F.col(c)) for c in cells]
    ident = F.coalesce(*[F.when(f != "", f) for f in found])
    label = F.coalesce(*[gold_bucket(F.col(c)) for c in cells])
    return (rows.select(ident.alias("id"), label.alias("b")).filter(F.col("id").isNotNull() & F.col("b").isNotNull())
            .groupBy("id").agg(F.max("b").alias("gold")))


def compare(agent: DataFrame, gold: DataFrame) -> DataFrame:
    diff = F.col("agent") - F.col("gold")
    return agent.join(gold, "id").withColumn("diff", diff).withColumn(
        "flag", F.when(diff > 0, "OVER").when(diff < 0, "UNDER").otherwise(""))


def check_common(compared: DataFrame) -> None:
    if compared.limit(1).count() == 0:
        raise ValueError("no id occurs on both sides")


METRICS = ["n", "exact", "within_one", "exact_rate", "within_rate", "over", "under", "mean_signed_error"]


def metrics(compared: DataFrame, *by: Column) -> DataFrame:
    d, n = F.col("diff"), F.count(F.lit(1))
    return compared.groupBy(*by).agg(
        n.alias("n"), F.count_if(d == 0).alias("exact"), F.count_if(F.abs(d) <= 25).alias("within_one"),
        F.round(F.count_if(d == 0) / n * 100, 1).alias("exact_rate"), F.round(F.count_if(F.abs(d) <= 25) / n * 100, 1).alias("within_rate"),
        F.count_if(d > 0).alias("over"), F.count_if(d < 0).alias("under"), F.round(F.sum("diff") / n, 1).alias("mean_signed_error"))


def one_sided(agent: DataFrame, gold: DataFrame) -> DataFrame:
    return (agent.join(gold, "id", "left_anti").select("id", F.lit("agent").alias("side"))
            .unionByName(gold.join(agent, "id", "left_anti").select("id", F.lit("gold").alias("side"))))
