"""The search in blocks: kernels, ranks and injection against all pairs, and what it does not do."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.operators import blocks as B
from mapweave.operators import pairs as P
from mapweave.operators import search as SE
from mapweave.params import Params
from tests.test_units import features

SMALL = Params(target_block_rows=50, source_block_rows=5, affinity_enabled=False)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def odd(df):
    """Rows without vector, fields, keys or family among the others."""
    n = F.col("order_no")
    bare = F.transform("sets", lambda s: F.slice(s, 1, 0))
    return df.withColumns({"vec": F.when(n % 11 == 5, F.array().cast("array<double>")).when(n % 11 == 6, F.transform("vec", lambda x: x * 0)).otherwise(F.col("vec")),
                           "sets": F.when(n % 7 == 3, bare).otherwise(F.col("sets")), "ao": F.when(n % 7 == 3, F.slice("ao", 1, 0)).otherwise(F.col("ao")),
                           "keys": F.when(n % 5 == 1, F.array(F.lit("x"), F.lit("y"))).when(n % 13 == 4, F.array().cast("array<string>")).otherwise(F.array("primary_key")),
                           "secondary_keys": F.when(n % 4 == 1, F.array(F.lit("y"), F.lit("z"))).otherwise(F.array().cast("array<string>")),
                           "low_confidence": n % 3 == 1})


def arrow(df):
    return df.toArrow().combine_chunks()


def test_kernels_equal_all_pairs(spark):
    """Exact signals are those of blocks.signals, rough ones are near them, bounds are above them."""
    p = replace(SMALL, affinity_enabled=True)
    s = odd(features(spark, 40, 1, "s")).withColumns({"affine_families": F.array(F.lit("Q")), "profile": "atomic_id"})
    t = odd(features(spark, 700, 2, "t")).withColumn("profile", F.col("atomic_id"))
    sp, tp = arrow(s), arrow(t)
    rows = tp.select(["order_no", "atomic_id"]).append_column("profile", P.pa.array(np.arange(len(tp), dtype=np.int32)))
    block = P.Block(tp, rows, p)
    met = P.Met(P.Chunk(sp, p), block, p)
    frame = block.table.to_pandas()
    want = B.signals(sp.to_pandas(), frame, p)
    i, j = (x.ravel() for x in np.indices(want["combined"].shape))
    got = met.exact(i, j)
    for name in got:
        assert np.abs(got[name] - want[name].ravel()).max() < (2e-9 if name == "combined" else 2e-12)
    bound = met.bound()
    for n, at in enumerate(block.strips):
        assert (bound[:, n] >= want["combined"][:, at].max(axis=1)).all()
        for live in (np.arange(40), np.arange(3, 40, 4)):
            met.among(live, at)
            assert np.abs(met.combined() - want["combined"][live, at]).max() < P.SLACK / 2
            assert (met.affine() == B.affine(sp.to_pandas().iloc[live], frame.iloc[at])).all()
            assert (met.pool() == (B.matches(sp.to_pandas()["keys"].iloc[live], frame["keys"].iloc[at]) > 0) | (P.Lists.of(sp["keys"]).sizes[live] == 0)[:, None]).all()


def ranked(s, t, p):
    """All pairs of the pool in order: (source, [(rank, target row)]), the fusion score and affinity of each."""
    parts, pool = B.signals(s, t, p), B.in_pool(s, t, p)
    for i in range(len(s)):
        js = [j for j in range(len(t)) if pool[i, j]]
        fused = dict.fromkeys(js, 0.0)
        for name, w in (("semantic", .45), ("structured", .30), ("action_object", .20)):
            for r, j in enumerate(sorted(js, key=lambda j: (-parts[name][i, j], t.order_no[j])), 1):
                fused[j] += w * (1.0 / (60 + r))
        able = [j for j in js if parts["combined"][i, j] >= p.min_combined]
        yield i, sorted(able, key=lambda j: (-parts["combined"][i, j], -round(fused[j], 12), t.order_no[j])), fused


@pytest.mark.parametrize("scope", ["soft_enisa", "same_category"])
def test_fusion_scores_equal_all_pairs(spark, scope):
    p = replace(SMALL, match_scope=scope)
    s, t = odd(features(spark, 17, 1, "s")), odd(features(spark, 260, 2, "t")).repartition(3)
    got = {(r.source_id, r.candidate_id): (r["rank"], r.rrf_score) for r in SE.search(s, t, p, all_rrf=True).collect()}
    sp, tp = s.toPandas(), t.toPandas()
    want = {}
    for i, order, fused in ranked(sp, tp, p):
        want.update({(sp.atomic_id[i], tp.atomic_id[j]): (r, round(fused[j], 12)) for r, j in enumerate(order[:10], 1)})
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=2e-12) for x in want)


def test_injection_equals_all_pairs(spark):
    p = replace(SMALL, affinity_enabled=True, affinity_count=3)
    s, t = odd(features(spark, 12, 1, "s")), odd(features(spark, 260, 2, "t")).repartition(3)
    table = spark.createDataFrame([("P", ["Q"]), ("R", ["P", "R"])], "key string, families array<string>")
    got = {(r.source_id, r.candidate_id, r.injected) for r in SE.search(s, t, p, table).collect()}
    sp, tp = s.toPandas(), t.toPandas()
    sp["affine_families"] = [{"P": ["Q"], "R": ["P", "R"]}.get(x, []) for x in sp.id_family]
    near, want = B.affine(sp, tp), set()
    for i, order, _ in ranked(sp, tp, p):
        want |= {(sp.atomic_id[i], tp.atomic_id[j], False) for j in order[:10]}
        want |= {(sp.atomic_id[i], tp.atomic_id[j], True) for j in [j for j in order[10:] if near[i, j]][:3]}
    assert got == want


@pytest.mark.parametrize("scope", ["soft_enisa", "same_category"])
def test_no_target_is_shuffled(spark, monkeypatch, scope):
    """Targets are packed where they are computed, and blocks meet chunks as a product."""
    plans, kept = [], SE.checkpointed
    monkeypatch.setattr(SE, "checkpointed", lambda df: plans.append((df.columns, plan(df))) or kept(df))
    s, t = features(spark, 12, 1, "s"), features(spark, 240, 2, "t")
    SE.search(s, t, replace(SMALL, match_scope=scope, use_rrf=False)).count()
    packs = [x for columns, x in plans if "profiles" in columns]
    met = [x for _, x in plans if "CartesianProduct" in x]
    assert len(packs) == 1 and "Exchange" not in packs[0]
    assert met and all(x.count("Exchange") <= 1 and "SortMergeJoin" not in x for x in met)


def test_ties_of_equal_signals_need_no_counts(spark, monkeypatch):
    """Copies that differ in what no signal shows rank by input order, as their ranks would tell; other ties are counted."""
    called = []
    kept = SE.rank_counts
    monkeypatch.setattr(SE, "rank_counts", lambda *a: called.append(1) or kept(*a))
    s, t = features(spark, 9, 1, "s").withColumn("confidence", F.lit(0.5)), features(spark, 90, 2, "t")
    t = t.withColumn("id_family", F.concat("id_family", (F.col("order_no") % 5).cast("string")))
    got = {(r.source_id, r["rank"]): r.candidate_id for r in SE.search(s, t.where("order_no % 3 = 0"), SMALL).collect()}
    assert not called and all(got[f"s{i}", n + 1] == f"t{3 * n}" for i in range(9) for n in range(10))
    rows = spark.createDataFrame([("a", 0.5, "t1", "i1", 1, 0.1), ("a", 0.5, "t2", "i2", 2, 0.1), ("b", 0.5, "t1", "i1", 1, 0.1), ("b", 0.5, "t2", "i2", 2, 0.2), ("c", 0.5, "t1", "i1", 1, 0.1),
                                  ("c", 0.5, "t2", "i1", 2, 0.1), ("d", 0.5, "t1", None, 1, 0.1), ("d", 0.5, "t2", "i2", 2, 0.1), ("e", 0.5, "t1", "i1", None, 0.1), ("e", 0.5, "t2", "i2", 2, 0.1)],
                                 "profile string, combined double, target string, atomic_id string, order_no long, semantic double")
    rows = rows.withColumns({x: F.lit(0.0) for x in ("keyword", "structured", "action_object")})
    assert sorted(r.profile for r in SE.open_ties(rows).collect()) == ["b", "c", "d", "e"]


def test_payloads_shuffle_likely_targets_only(spark):
    """Texts of targets that are no candidates are left out before the join; none that is one is."""
    from mapweave.operators import retrieval as RT
    columns = {c: F.lit(0.5) for c in RT.SCORES}
    c = spark.range(40).selectExpr("concat('s', id % 4) AS source_id", "concat('t', id * 25) AS candidate_id", "cast(id DIV 4 + 1 AS int) AS rank", "id <> 7 AS in_review",
                                   "false AS injected", "'pass' AS hard_gate").withColumns(columns)
    t = spark.range(3000).selectExpr("concat('t', id) AS atomic_id", "'p' AS parent_id", "concat('r', id) AS atomic_requirement", "repeat('x', 500) AS parent_requirement", "'en' AS category")
    assert RT.likely(t, "atomic_id", c.select("candidate_id")).count() < 60
    out = RT.payloads(c, t)
    got = {(r.source_id, x.candidate_id, x["rank"]) for r in out.collect() for x in r.candidates}
    assert got == {(f"s{i % 4}", f"t{25 * i}", i // 4 + 1) for i in range(40) if i != 7}
    assert "getbit" in plan(out).split("collect_list")[-1]
