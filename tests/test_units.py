"""Small fixtures with values worked out by hand or by brute force."""

import itertools
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.functions import labels as L
from mapweave.functions import text as TX
from mapweave.functions import values as V
from mapweave.functions import vectors as VE
from mapweave.operators import decide as D
from mapweave.operators import gaps as G
from mapweave.operators import rules
from mapweave.operators import runlog as RL
from mapweave.operators import search as SE
from mapweave.operators.ranking import position_rank
from mapweave.params import Params
from mapweave.sources import requirements as R
from mapweave.sources import sinks as SI


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, TX.collapse(F.lit(" a  b\n\n c "))) == "a b c"
    assert one(spark, TX.tokens(F.lit("La sécurité shall PROTECT x-1"))) == ["curit", "protect", "x-1"]
    assert one(spark, TX.gap_tokens(F.lit("Été à la mer"))) == ["été", "mer"]
    assert one(spark, TX.casefold(F.lit("Straße"))) == "strasse"
    assert one(spark, TX.canonical_control_id(F.lit("see GV.OC-03-1: x"))) == "GV.OC-03.1"
    assert one(spark, TX.parent_id(F.lit("a#b#2"))) == "a#b"
    assert one(spark, TX.clean_gap_sentence(F.lit("- Gap: no owner ;"))) == "no owner."
    assert one(spark, TX.truncate(F.lit("abc def"), 5)) == "abc…"


def test_values_and_bands(spark):
    assert one(spark, V.tolerant_float(F.lit("Very High!"))) == 0.95
    assert [one(spark, V.tolerant_int(F.lit(x))) for x in ("2.5", "3.5", "", " 7 ")] == [2, 4, 0, 7]
    assert [one(spark, L.bucket(F.lit(x))) for x in (12.4, 12.5, 87.5, 200.0)] == [0, 25, 100, 100]
    assert [one(spark, L.score_level(F.lit(x))) for x in (25, 26, 5, 95, 130)] == [20, 30, 0, 90, 100]
    assert one(spark, L.gold_bucket(F.lit("Not covered"))) == 0
    assert one(spark, L.gap_type(F.lit("odd"), F.lit(45), F.lit("supportive"))) == "indirect_support_gap"
    assert one(spark, V.gap_items(F.lit('{"gap": " a ", "severity": ""}')))[0].severity == "moderate"


def test_cosine_length_error(spark):
    assert one(spark, VE.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    with pytest.raises(Exception, match="different length"):
        one(spark, VE.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))


def test_sources(spark):
    assert R.resolve_columns(["i.d", "TITLE", "Requirement ", "x"])[1] == ["Category"]
    with pytest.raises(ValueError):
        R.check_columns(spark.range(1), R.ColumnMap(requirement="text", position="id"))
    with pytest.raises(ValueError):
        Params(match_scope="nowhere")


def test_position_rank_keeps_all_rows(spark):
    """Null groups and positions, ties, one hot group and an outlier position; any number of partitions gives the same ranks."""
    rows = [("a", i * 7, 0) for i in range(600)] + [("a", 10 ** 15, 0), (None, 5, 0), (None, 3, 0), ("b", None, 0), ("b", 1, 2), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "g string, pos long, t int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = position_rank(df, ["g"], "pos", "n", ties=("t",))
            assert got.columns == ["g", "pos", "t", "n"]
            found = {(r.g, r.pos, r.t): r.n for r in got.collect()}
            assert len(found) == len(rows)
            assert all(found["a", i * 7, 0] == i + 1 for i in range(600)) and found["a", 10 ** 15, 0] == 601
            assert (found[None, 3, 0], found[None, 5, 0]) == (1, 2)
            assert (found["b", None, 0], found["b", 1, 1], found["b", 1, 2]) == (1, 2, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_review_keeps_null_categories(spark):
    df = spark.createDataFrame([("x", 0.1, 10, 1), (None, 0.1, 10, 2), (None, 0.1, 10, 3)], "source_category string, confidence double, coverage_level int, decision_order long")
    assert sorted(r.batch_no for r in D.review_selection(df, Params(review_batch=1)).collect()) == [1, 1, 2]


def test_append_keeps_the_first_by_order(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "late", 9), ("a", "early", 2), (None, "n", 1), ("b", "b", 3)], "key string, decision string, log_order int")
    SI.append_new(df, None, path)
    SI.append_new(df.withColumn("decision", F.lit("again")).union(spark.createDataFrame([("c", "c", 1)], df.schema)), spark.read.parquet(path), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("key", "decision").collect()), key=str) == [("a", "early"), ("b", "b"), ("c", "c"), (None, "n")]


def test_prices_match_the_longest_part(spark):
    models = spark.createDataFrame([("My-Big-Model",), ("other",), ("",), ("xa",)], "model string")
    prices = spark.createDataFrame([("big", 1.0, 2.0, 0), ("BIG-MODEL", 3.0, 4.0, 1), ("a", 5.0, 6.0, 2), ("A", 7.0, 8.0, 3)], "model string, input double, output double, pos int")
    got = {r.model: (r.input_price, r.output_price) for r in RL.match_prices(models, prices).collect()}
    assert got == {"My-Big-Model": (3.0, 4.0), "other": (0.0, 0.0), "": (0.0, 0.0), "xa": (5.0, 6.0)}


def test_decision_key_ignores_layout(spark):
    df = spark.createDataFrame([("s", [1.0, 2.0])], "source string, scores array<double>")
    key = lambda p: df.select(D.decision_key(p, F.col("source"), F.col("scores")).alias("k")).first().k
    assert len(key(Params())) == 64 and key(Params()) == key(Params(max_pivots=8)) != key(Params(top_k=3))


# ---- cascade
def decision(spark, **over):
    cand = over.pop("cand", None)
    row = dict(source_id="s", selected_ids=[], target_ids=[], target_requirements=[], target_parent_ids=[],
               target_parent_requirements=[], relation_type="partial", equivalence_level="Partial", coverage_level=50,
               gap_type="partial_gap", match_type="Direct", confidence=0.9, justification="", gap="", gap_items=[],
               combine_controls="", recommendation="", mapping_risk="", scoring_rationale="", same_functional_domain=None)
    row.update(over)
    scores = dict(semantic_score=0.5, structured_score=0.3, action_object_score=0.5, category_prior_score=0.1, combined_score=0.5)
    row["candidates"] = [] if cand is None else [dict(candidate_id="t#1", parent_id="t", requirement="r", parent_requirement="pr",
                                                      hard_gate="pass", rank=1, **(scores | cand))]
    schema = ", ".join(f"{n} {t}" for n, t in rules.TYPES.items()) + (
        f", source_id string, same_functional_domain boolean, candidates array<{D.CANDIDATE}>")
    return spark.createDataFrame([row], schema)


def fixed(spark, cap=True, **over):
    return rules.correct(decision(spark, **over), cap=cap).first()


def test_cascade_branches(spark):
    r = fixed(spark, coverage_level=0, relation_type="gap", gap_type="", cand=dict(combined_score=0.6, semantic_score=0.7))
    assert (r.coverage_level, r.relation_type, r.mapping_risk, r.target_ids) == (50, "partial", "High", ["t#1"])
    r = fixed(spark, coverage_level=0, same_functional_domain=False, cand=dict(combined_score=0.6, semantic_score=0.7))
    assert (r.coverage_level, r.equivalence_level, r.gap) == (0, "Gap", "No selected target candidate.")
    target = dict(target_ids=["t#1"], selected_ids=["t#1"])
    r = fixed(spark, **target, coverage_level=80, cand=dict(action_object_score=0.2))
    assert (r.coverage_level, r.mapping_risk) == (50, "High")
    r = fixed(spark, cap=False, **target, coverage_level=80, cand=dict(action_object_score=0.2))
    assert r.coverage_level == 80
    r = fixed(spark, **target, coverage_level=100, equivalence_level="Exact match", cand=dict(action_object_score=0.5))
    assert (r.coverage_level, r.equivalence_level, r.gap_type) == (80, "Partial", "partial_gap")
    r = fixed(spark, **target, coverage_level=60, cand=dict(combined_score=0.6, semantic_score=0.8))
    assert (r.coverage_level, r.scoring_rationale.startswith("Strong candidate upgrade")) == (80, True)
    r = fixed(spark, **target, coverage_level=20, mapping_risk="Low", relation_type="indirect", gap_type="indirect",
              cand=dict(combined_score=0.3, semantic_score=0.4))
    assert (r.coverage_level, r.equivalence_level) == (20, "Not covered")


def test_corrections_latest_wins(spark):
    d = decision(spark, target_ids=["t#1"], selected_ids=["t#1"], coverage_level=40, cand={})
    c = spark.createDataFrame([("s", 1, 1, '{"coverage_level": 70, "mapping_risk": "Low"}'), ("s", 2, 1, '{"coverage_level": 60.9}')],
                              "source_id string, batch_no int, position int, correction string")
    r = D.apply_corrections(d, c).first()
    assert (r.coverage_level, r.pre_review_coverage, r.mapping_risk) == (60, 40, "Low")


def test_rules_run_after_each_correction(spark):
    """Three corrections in one pass equal three passes of one; merged fields would give another result."""
    steps = ['{"coverage_level": 0, "relation_type": "gap", "mapping_risk": ""}', '{"confidence": "0.9", "gap_items": [{"gap": "x", "severity": "major"}]}',
             '{"coverage_level": 100, "equivalence_level": "Partial", "corrected_mapping_risk": "Low"}']
    schema = "source_id string, batch_no int, position int, correction string"
    cand = dict(combined_score=0.5, semantic_score=0.6, action_object_score=0.5)
    d = decision(spark, target_ids=["t#1"], selected_ids=["t#1"], coverage_level=40, cand=cand)
    rows = [("s", 2, 1, steps[2]), ("s", 1, 2, steps[1]), ("s", 1, 1, steps[0]), ("s", 3, 1, "no json")]
    once = D.apply_corrections(d, spark.createDataFrame(rows, schema)).first()
    step = d
    for i, c in enumerate(steps):
        step = D.apply_corrections(step, spark.createDataFrame([("s", 1, i, c)], schema))
    step = step.first()
    assert once.asDict(True) == step.asDict(True)
    assert once.review_notes == steps[2] and once.pre_review_coverage == 40
    alone = D.apply_corrections(d, spark.createDataFrame([("s", 2, 1, steps[2])], schema)).first()
    assert alone.scoring_rationale != once.scoring_rationale or alone.gap_items != once.gap_items


# ---- search against brute force ---------------------------------------------------------------------
def features(spark, n, seed, prefix):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(n):
        copy = i % 3 == 0  # a third of the rows are copies of one
        g = np.random.default_rng(5) if copy else rng
        pick = lambda k: sorted(set(g.choice(words, k).tolist()))  # noqa: B023,E731
        sets = [[], [], pick(1), pick(3), [], [], [], [], pick(1)]
        vec = (g.normal(size=6) + np.eye(6)[g.integers(0, 6)] * 3).tolist()
        rows.append((f"{prefix}{i}", i, f"{prefix}.{i}", vec, sets, sorted(set(sum(sets, []))), str(g.choice(["", "a", "b"])), str(g.choice(["x", "y"])),
                     [], ["x"], float(g.choice([0.5, 0.9])), False, "P" if copy else str(g.choice(["Q", "R"])), []))
    return spark.createDataFrame(rows, "atomic_id string, order_no long, parent_id string, vec array<double>, sets array<array<string>>, "
                                 "ao array<string>, control_family string, primary_key string, secondary_keys array<string>, keys array<string>, "
                                 "confidence double, low_confidence boolean, id_family string, terms array<string>")


@pytest.mark.parametrize("scope", ["soft_enisa", "same_category"])
def test_search_equals_brute_force(spark, scope):
    from mapweave.operators import blocks as B
    p = Params(target_block_rows=20, source_block_rows=4, max_pivots=8, match_scope=scope, affinity_enabled=False)
    s, t = features(spark, 12, 1, "s"), features(spark, 240, 2, "t")
    got = {(r.source_id, r["rank"]): r.candidate_id for r in SE.search(s, t, p).collect()}
    sp, tp = s.toPandas(), t.toPandas()
    parts, pool = B.signals(sp, tp, p), B.in_pool(sp, tp, p)
    want = {}
    for i in range(len(sp)):
        js = [j for j in range(len(tp)) if pool[i, j]]
        score = dict.fromkeys(js, 0.0)
        for name, w in (("semantic", .45), ("structured", .30), ("action_object", .20)):
            for r, j in enumerate(sorted(js, key=lambda j: (-parts[name][i, j], j)), 1):
                score[j] += w * (1.0 / (60 + r))
        ranked = sorted((j for j in js if parts["combined"][i, j] >= p.min_combined),
                        key=lambda j: (-parts["combined"][i, j], -round(score[j], 12), j))
        want.update({(sp.atomic_id[i], r): tp.atomic_id[j] for r, j in enumerate(ranked[:10], 1)})
    assert got == want


def test_injection_never_removes(spark):
    p = Params(target_block_rows=20, max_pivots=8)
    s, t = features(spark, 6, 1, "s"), features(spark, 120, 2, "t")
    with_it = {(r.source_id, r.candidate_id) for r in SE.search(s, t, p).filter("not injected").collect()}
    without = {(r.source_id, r.candidate_id) for r in SE.search(s, t, replace(p, affinity_enabled=False)).collect()}
    assert with_it == without


@pytest.mark.parametrize("top_k, review_top_k", [(8, 3), (3, 8)])
def test_cuts_are_independent(spark, top_k, review_top_k):
    p = Params(target_block_rows=20, max_pivots=8, top_k=top_k, review_top_k=review_top_k)
    s, t = features(spark, 6, 1, "s"), features(spark, 120, 2, "t")
    rows = SE.search(s, t, p).collect()
    for source in {r.source_id for r in rows}:
        own = [r for r in rows if r.source_id == source]
        assert sum(r.in_scoring for r in own) == top_k
        assert sum(r.in_review and not r.injected for r in own) == review_top_k
        assert sum(r.injected for r in own) <= p.affinity_count


# ---- near duplicates ----------------------------------------------------------------------------
def test_near_duplicates_equal_greedy(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"word{i}" for i in range(9)], 12)) for _ in range(12)]
    texts = [b + (f" extra{k}" if k else "") for k, b in itertools.product(range(5), base)] + base
    items = [("p", "action", x, "moderate", i) for i, x in enumerate(texts)]
    df = spark.createDataFrame(items, "parent string, dimension string, gap string, severity string, item_order int")
    got = sorted(r.item_order for r in G.drop_near_duplicates(df).collect())
    toks = lambda x: [w for w in re.findall(r"[a-zA-ZÀ-ÿ0-9]+", x.casefold()) if len(w) > 2]
    kept, keys = [], set()
    for i, x in enumerate(texts):
        a, k = set(toks(x)), " ".join(toks(x)[:16])
        if k in keys or any(len(a & set(toks(texts[j]))) / len(a | set(toks(texts[j]))) >= 0.78 for j in kept):
            continue
        keys.add(k)
        kept.append(i)
    assert got == kept
