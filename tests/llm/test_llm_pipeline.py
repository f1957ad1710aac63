"""The stages of the pipeline on the given table, and the registered queries against their SQL."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from mapweave.llm import queries, simhash
from tests.llm.fixtures import prose
from tests.oracle import connect, rows_of

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.S))
def test_query_against_sql(spark, name):
    df = queries.Q[name](spark, SF)
    rel = connect("0.001").execute(queries.S[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in rel.description], rel.fetchall())


def test_run_gives_packed_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]


def test_stages_take_effect(spark):
    rng = random.Random(3)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    copy = prose(rng, 200)
    rows = [(1, copy), (2, copy), (3, copy.replace("kara", "other", 1)), (4, prose(rng, 30) + " " + bench), (5, "a password = abcdefghijkl end"), (6, prose(rng, 50)), (7, "idiot moron scum you worthless pathetic idiot. You idiot, you loser!"), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, "/root/testdata/sf0.01")
        assert df.columns == COLUMNS
        kept[name] = {r.doc_id: r.text for r in df.collect()}
    assert 7 not in kept["toxicity"] and len(kept["toxicity"]) == 8
    assert set(kept["simhash_near_dedup"]) == {1, 4, 5, 6, None, 8}
    assert 4 not in kept["benchmark_decontamination"] or len(bench.split()) < 13
    assert kept["secret_scan"][5] == "a [SECRET] end" and {1, 5, 6, 8} <= set(kept["secret_scan"])


def test_levels_know_shingles_of_few_texts_in_a_large_table(spark):
    """10,000 lines in 20 of 200,000 texts each: a sample of fixed size meets most of them once or never."""
    docs = spark.range(200_000).selectExpr("id", "concat_ws(' ', 'a', 'line', 'of', 'five', concat('w', id % 10000)) AS text")
    levels = simhash.shingle_levels(docs, docs.select("id"), 5)
    lines = pa.array([f"a line of five w{i}" for i in range(10_000)])
    known = simhash.level_of(np.concatenate(list(simhash.shingle_sets(lines, 5))), levels)
    assert (known > 0).mean() > 0.8


def test_levels_count_every_text(spark):
    """A shingle of two texts is known as such, whichever texts they are; those of texts outside ids are not counted."""
    rows = [(i, f"one line of five w{i // 2}") for i in range(400)] + [(1000 + i, f"alone in here is v{i}") for i in range(400)]
    docs = spark.createDataFrame(rows + [(i + 5000, "alone in here is v7") for i in range(9)], "id long, text string").repartition(7)
    levels = simhash.shingle_levels(docs, docs.where("id < 5000").select("id"), 5)
    known = lambda word, n: simhash.level_of(np.concatenate(list(simhash.shingle_sets(pa.array([f"{word}{i}" for i in range(n)]), 5))), levels)
    assert (known("one line of five w", 200) == 1).all()
    assert (known("alone in here is v", 400) == 0).mean() > 0.99
    assert simhash.shingle_levels(docs.where("id < 0"), docs.where("id < 0").select("id"), 5).sum() == 0


def test_stages_bound_the_rows_of_a_batch(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", corpus_pipeline.BATCH), ("0", corpus_pipeline.BATCH), ("50", 50)):
            spark.conf.set(name, given)
            corpus_pipeline.redact_secrets(spark, spark.createDataFrame([(1, "x")], "doc_id long, text string"), SF)
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)
