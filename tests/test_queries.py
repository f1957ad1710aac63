"""Registered queries against their SQL at the smallest scale, written tables and the stream."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mapweave.plans import report_queries as RQ
from mapweave.sources import sinks
from mapweave.streaming import runlog_stream as XS
from tests import oracle

SF = "0.001"
NAMES = ["S1_requirement_scan", "S2_duplicate_ids", "T3_tokenize", "T14_hash_embedding", "P1_atomize", "C7_status", "J12_top_k_candidates",
         "J11_final_rank", "D7_D17_correction_rules", "D4_supplied_judgement", "D20_apply_corrections", "J17_target_policy", "A3_target_listing",
         "A8_review_priority", "U5_consolidated_ids", "E5_E6_agreement", "L7_stage_timing", "X1_log_stream"]


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    status, n, _, _, note = oracle.compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert status == "ok", note
    assert n > 0 or name == "L7_stage_timing"


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["source_id", "candidate_id", "rank", "semantic", "category_prior", "combined"]


def test_written_tables_read_back(spark, tmp_path):
    log = RQ.run_log(spark, f"{oracle.DATA}/sf{SF}")
    report = sinks.run_report(log)
    sinks.save(report, str(tmp_path / "report"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "report")).collect())) == sorted(map(tuple, report.collect()))


def test_stream_equals_batch(spark):
    d = f"{oracle.DATA}/sf{SF}"
    got = entry.queries()["X1_log_stream"](spark, d)
    log = RQ.run_log(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    twin = XS.closed_windows(log).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twin.collect()))
