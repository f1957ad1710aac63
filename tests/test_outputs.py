"""Published tables: listed once, whole, last run first; columns of the tables that the queries do not reach."""

import json

import pytest
from pyspark.sql import functions as F

from mapweave.operators import decide as D
from mapweave.sources import shared as SH
from mapweave.sources import sinks as K


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def values(df):
    return sorted(r.v for r in df.collect())


def test_a_run_is_written_once_and_the_last_run_is_read(spark):
    path = SH.new_folder(spark, "published")
    K.publish({"a": numbers(spark, 1, 2), "b": numbers(spark)}, path, "r1")
    K.publish({"a": numbers(spark, 9), "b": numbers(spark, 9)}, path, "r1")  # listed already
    assert values(K.published(spark, path, "a")) == [1, 2]
    assert K.published(spark, path, "b").columns == ["v"] and K.published(spark, path, "b").count() == 0
    K.publish({"a": numbers(spark, 3)}, path, "r2")
    assert values(K.published(spark, path, "a")) == [3]
    assert values(K.published(spark, path, "a", "r1")) == [1, 2]
    assert K.manifest(spark, path).count() == 3


def test_a_broken_run_leaves_nothing_to_read(spark):
    path = SH.new_folder(spark, "published")
    K.publish({"a": numbers(spark, 1)}, path, "r1")
    broken = numbers(spark, 1, 0).select(F.when(F.col("v") == 0, F.raise_error(F.lit("broken"))).otherwise(F.lit(1)).cast("long").alias("v"))
    with pytest.raises(Exception, match="broken"):
        K.publish({"a": numbers(spark, 7), "b": broken}, path, "r2")
    assert values(K.published(spark, path, "a")) == [1]
    with pytest.raises(ValueError, match="no table b"):
        K.published(spark, path, "b")
    K.publish({"a": numbers(spark, 7), "b": numbers(spark, 8)}, path, "r2")  # repeated whole
    assert values(K.published(spark, path, "a")) == [7]


def test_a_table_that_lost_rows_is_refused(spark):
    path = SH.new_folder(spark, "published")
    K.publish({"a": numbers(spark, 1, 2)}, path, "r1")
    row = K.manifest(spark, path).first()
    numbers(spark, 5).write.mode("append").parquet(f"{path}/{row.folder}")
    with pytest.raises(ValueError, match="not whole"):
        K.published(spark, path, "a")


def test_summary_without_enriched_rows_has_no_mean(spark):
    rows = spark.createDataFrame([("B_only", 0)], "origin string, coverage_a_to_b int")
    got = {r.metric: r.value for r in K.consolidation_summary(rows, "X", "Y").collect()}
    assert got == {"source_framework_a": "X", "source_framework_b": "Y", "total": "1", "a_enriched": "0", "b_only": "1", "b_supplemental": "0"}


@pytest.mark.parametrize(("told", "shown"), [({"action": 1, "scope": 0.5}, '{"action":1,"scope":0.5}'), ({}, ""), ("high", ""), (None, ""), ([1], "")])
def test_dimension_scores_of_a_judgement_are_kept(spark, told, shown):
    one = F.struct(*[F.lit(v).alias(n) for n, v in [
        ("candidate_id", "t#1"), ("parent_id", "t"), ("requirement", "text"), ("parent_requirement", "parent"), ("semantic_score", 0.9), ("structured_score", 0.9),
        ("action_object_score", 0.9), ("category_prior_score", 0.1), ("combined_score", 0.9), ("hard_gate", "pass"), ("rank", 1)]])
    sources = spark.range(1).select(F.lit("s").alias("source_id"), F.array(one).alias("candidates"))
    answer = json.dumps({"selected_candidate_ids": ["t#1"], "coverage_level": 80, "dimension_scores": told, "gap_dimensions": ["scope"]})
    r = D.decisions_from_judgements(sources, spark.createDataFrame([("s", answer)], "source_id string, judgement string")).first()
    assert (r.dimension_scores, r.gap_dimensions, r.target_ids) == (shown, ["scope"], ["t#1"])
    assert D.decide(sources).first().dimension_scores == ""
