"""Work that must not be done twice: read off the plans, not off the clock."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mapweave.functions import labels as L
from mapweave.functions import text as TX
from mapweave.operators import decide as DE
from mapweave.operators import search as SE
from mapweave.plans import fixtures as FX
from tests import oracle

D = f"{oracle.DATA}/sf0.001"


def plan(df, part="executedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_adjacent_atoms_are_prepared_once(spark):
    q = entry.queries()
    for name in ("J3_cosine", "J10_combined_score"):
        assert plan(q[name](spark, D)).count("FileScan") == 1
    for name in ("J5_structured_similarity", "J6_action_object_similarity", "J7_control_type_similarity", "J8_category_prior"):
        assert "ArrowEvalPython" not in plan(q[name](spark, D))


def test_fields_read_the_tokens_once(spark):
    fields = FX.atoms(spark, D).select("atomic_id", "fields")
    assert plan(fields, "optimizedPlan").count("regexp_extract_all") == 1


def test_filters_stay_above_the_rules(spark):
    """Each rule once, and only what the query shows: notes that nobody reads are not written, in no filter either."""
    for name in ("D8_rescue", "D9_no_target", "D11_zero_with_target", "D12_exact_match", "D14_strong_upgrade", "D15_coverage_floor"):
        found = plan(entry.queries()[name](spark, D), "optimizedPlan")
        assert "Coverage capped by object/action gate" not in found
        assert "lambda v" not in found
        filters = [line for line in found.split("\n") if line.strip(" +-:").startswith("Filter")]
        assert all(len(line) < 1000 for line in filters)


def test_rows_ahead_equal_brute_force():
    rng = np.random.default_rng(3)
    for n, m in ((0, 3), (1, 1), (500, 40)):
        value, order = rng.integers(0, 6, n) / 5, rng.permutation(n)
        values, orders = rng.integers(0, 6, m) / 5, rng.integers(-1, n + 1, m)
        want = [int(((value > v) | ((value == v) & (order < o))).sum()) for v, o in zip(values, orders)]
        assert SE.ahead(value, order, values, orders).tolist() == want


def test_second_decision_brings_only_what_is_read(spark):
    found = plan(entry.queries()["D6_reevaluation"](spark, D), "optimizedPlan")
    assert found.count("from_json") == 2  # one reading of each judgement


def test_labels_make_their_key_once(spark):
    df = spark.range(5).selectExpr("cast(id as string) AS a", "cast(id * 20 as int) AS c", "cast(id as string) AS b")
    assert plan(df.select(L.gap_type(df.a, df.c, df.b).alias("g")), "optimizedPlan").count("translate") == 2
    got = spark.createDataFrame([("Partial",), (" no-gap ",), ("odd",), (None,)], "a string").select(L.lookup(L.label_key(F.col("a")), L.GAP_ALIASES).alias("x"))
    assert [r.x for r in got.collect()] == ["partial_gap", "none", None, None]


def test_judgement_is_readable_as_an_object_with_a_member(spark):
    """What one reading tells is what a second one as a map told."""
    texts = [None, "", "{}", '{"a":1}', '[{"gap":"x"}]', "5", "null", "{not json", '{"gap":"x"', '{"gap":"x"}}', "{'gap':'y'}", '{gap:"x"}', '{"gap":null}', '{"gap":{"b":[1]}}',
             '\n\t{"a":[1,{"b":2}]}', '{"gap":"x",}', '/*c*/{"a":1}', '{"a":1}{"b":2}', '{"gap": tru}', '{"a": 1, "b"}']
    candidate = "array(named_struct('candidate_id', 'c', 'parent_id', 'p', 'requirement', 'r', 'parent_requirement', 'q', 'semantic_score', 0.9D, 'structured_score', 0.9D, " \
                "'action_object_score', 0.9D, 'category_prior_score', 0.9D, 'combined_score', 0.9D, 'hard_gate', 'pass', 'rank', 1))"
    given = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_id string, judgement string")
    got = DE.decisions_from_judgements(given.selectExpr("source_id", f"{candidate} AS candidates"), given)
    known = F.from_json("judgement", "map<string,string>")
    want = given.select("source_id", F.when(F.col("judgement").isNull(), "MissingJudgement").when(known.isNull() | (F.size(known) == 0), "UnreadableJudgement").otherwise("").alias("w"))
    assert got.join(want, "source_id").where("fallback_error <> w").count() == 0


def test_fingerprint_hashes_and_collapses_a_row_once(spark):
    found = plan(entry.queries()["P10_fingerprint"](spark, D), "optimizedPlan")
    assert found.count("parent_requirement") > 0 and found.count("sha2(cast(concat_ws(\x1f") == 1
    assert found.count("regexp_replace") == 1


def test_collapse_changes_white_space_only(spark):
    """The quick test for printable characters leaves the result as the plain pattern gives it."""
    chars = [chr(c) for c in [*range(1, 0x180), 0x1680, *range(0x1FFF, 0x2065), 0x2FFF, 0x3000, 0x3001, 0xFEFF, 0x1F600]]
    texts = [x for c in chars for x in (c, f"a{c}b", f" {c}b", f"a{c} ", f"a {c} b", f"{c}{c}!", f"~{c}\n\u00a0{c}")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = f"[{TX.WHITE}]{{2,}}|[{TX.WHITE}&&[^ ]]"
    assert df.where(TX.collapse(F.col("t")) != F.trim(F.regexp_replace("t", plain, " "))).count() == 0


def test_corrected_decisions_are_dealt_out_while_narrow(spark):
    """What goes through a shuffle are the given columns of a decision, not its candidates and texts."""
    def sent(node):
        own = [a.name() for a in (node.output().apply(i) for i in range(node.output().size()))] if "Exchange" in node.nodeName() else []
        return own + [x for i in range(node.children().size()) for x in sent(node.children().apply(i))]

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        names = sent(entry.queries()["D20_apply_corrections"](spark, D)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "source_id" in names and "k" in names
    assert not {"candidates", "selected_ids", "target_requirements", "target_parent_requirements", "justification"} & set(names)
