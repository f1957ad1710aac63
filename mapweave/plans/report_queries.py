"""Registered queries for roll-up (A), consolidation (U), evaluation (E) and the run log (L), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.functions import labels as L
from mapweave.operators import consolidate as C
from mapweave.operators import evaluate as E
from mapweave.operators import rollup as R
from mapweave.operators import runlog as RL
from mapweave.plans import decision_queries as DQ
from mapweave.plans import fixtures as FX
from mapweave.plans import sqltext as X
from mapweave.plans.fixtures import pick, table

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            S[name] = sql
        return fn
    return register


# ---- roll-up ------------------------------------------------------------------------------------
D0 = f"SELECT *, regexp_replace(source_parent_id, '__row_\\d+', '', 'g') AS parent FROM ({FX.DECISIONS})"
_DIM = X.lookup("item_dimension", L.DIMENSION_ALIASES, "item_dimension")
AGG = f"""SELECT parent, count(*) AS n, sum(coverage_level) / count(*)::DOUBLE AS mean, min(coverage_level) AS low, max(coverage_level) AS high,
  count(*) FILTER (coverage_level >= 75) AS n_strong, count(*) FILTER (coverage_level < 40) / count(*)::DOUBLE AS uncovered,
  count(*) FILTER (coverage_level >= 40) / count(*)::DOUBLE AS direct, count(*) FILTER (coverage_level >= 80) / count(*)::DOUBLE AS strong,
  count(*) FILTER (coverage_level > 0 AND coverage_level < 40) / count(*)::DOUBLE AS indirect,
  count(*) FILTER (coverage_level <= 0) / count(*)::DOUBLE AS none, list(DISTINCT {_DIM}) FILTER (item_dimension IS NOT NULL) AS dims,
  count(*) FILTER (coverage_level > 0 AND coverage_level <= 30) AS n_weak,
  count(*) FILTER (coverage_level > 0 AND coverage_level <= 30 AND relation_type = 'not_covered') AS n_weak_not,
  bool_or(mapping_risk = 'High') AS any_high, arg_min(match_type, decision_order) AS first_match,
  coalesce(arg_min(source_parent_requirement, decision_order) FILTER (source_parent_requirement <> ''),
    arg_min(source_requirement, decision_order)) AS req,
  coalesce(arg_min(source_category, decision_order) FILTER (source_category <> ''), '') AS domain
  FROM ({D0}) GROUP BY parent"""
COV = f"""SELECT *, CASE WHEN uncovered >= 0.75 THEN least(raw, 25) WHEN uncovered >= 0.5 THEN least(raw, 50) ELSE raw END AS cov FROM (
  SELECT *, round_even(CASE WHEN n_strong >= 2 OR (n_strong >= 1 AND low >= 40) THEN 0.6::DOUBLE * mean + 0.4::DOUBLE * high ELSE mean END, 0)::INT AS raw
  FROM ({AGG}))"""


def ladder(v: str) -> str:
    inside = f"(len(dims) > 0 AND len(list_filter(dims, lambda x: x NOT IN {X.values(L.IMPLEMENTATION_DIMS)})) = 0)"
    material = f"(dims IS NOT NULL AND len(list_filter(dims, lambda x: x IN {X.values(L.MATERIAL_DIMS)})) > 0)"
    return f"""CASE WHEN none >= 0.7 AND direct = 0 THEN 'true_gap' WHEN direct = 0 AND indirect > 0 THEN 'indirect_support_gap'
      WHEN {v} >= 70 AND strong >= 0.5 AND {inside} THEN 'implementation_detail_gap'
      WHEN {v} >= 60 AND direct >= 0.6 AND NOT {material} THEN 'implementation_detail_gap'
      WHEN {v} >= 40 AND direct >= 0.25 THEN 'partial_gap' WHEN indirect > 0 OR {v} > 0 THEN 'indirect_support_gap' ELSE 'true_gap' END"""


KIND = f"SELECT *, CASE WHEN cov >= 99.5 THEN 'none' ELSE {ladder('cov')} END AS gt FROM ({COV})"
_LIST = f"""SELECT parent, list(t ORDER BY r) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY c, o) AS r FROM (
  SELECT parent, target_parent_id AS t, min((-coverage_level, decision_order)) AS mk, mk[1] AS c, mk[2] AS o FROM ({D0}) WHERE has_target
  GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1"""
PARENTS = f"""SELECT a.*, coalesce(ts, []) AS ts, CASE WHEN cov <= 0 THEN 'Not covered' WHEN cov >= 99.5 AND gt = 'none' THEN 'Exact coverage'
    WHEN gt = 'implementation_detail_gap' THEN 'Implementation details missing' WHEN cov >= 80 THEN 'Mostly covered'
    WHEN cov >= 60 THEN 'Largely covered' WHEN cov >= 40 THEN 'Partially covered' WHEN cov >= 20 THEN
      CASE WHEN n_weak > 0 AND n_weak = n_weak_not THEN 'Not covered' ELSE 'Indirectly covered' END
    WHEN cov >= 10 THEN 'Very weakly covered' ELSE 'Not covered' END AS rel,
  CASE WHEN ts IS NULL THEN 'None' WHEN len(ts) > 1 OR n > 1 THEN 'Composite' ELSE first_match END AS mt,
  CASE WHEN any_high OR cov <= 25 THEN 'High' WHEN cov < 75 THEN 'Medium' WHEN cov < 100 THEN 'Low' ELSE 'None' END AS risk
  FROM ({KIND}) a LEFT JOIN ({_LIST}) USING (parent)"""


def parent_rows(spark, d):
    return R.parents(FX.decisions(spark, d))


@query("A1_parent_coverage", f"SELECT parent, cov AS coverage_level FROM ({COV})")
def _(spark, d):
    return R.parent_aggregates(FX.decisions(spark, d)).select("parent", R.parent_coverage().alias("coverage_level"))


@query("A2_first_texts", f"SELECT parent, req AS source_parent_requirement, domain FROM ({AGG})")
def _(spark, d):
    return R.parent_aggregates(FX.decisions(spark, d)).select("parent", "source_parent_requirement", "domain")


@query("A3_target_listing", f"""SELECT parent, array_to_string(ts, ',') AS ids, 'Text of ' || array_to_string(ts, ',Text of ') AS texts
  FROM ({_LIST})""")
def _(spark, d):
    return R.target_listing(FX.decisions(spark, d)).select("parent", F.array_join("target_ids", ",").alias("ids"),
                                                           F.array_join("target_texts", ",").alias("texts"))


@query("A4_parent_gap_type", f"SELECT parent, gt AS gap_type FROM ({KIND})")
def _(spark, d):
    return parent_rows(spark, d).select("parent", "gap_type")


@query("A5_synthesis_gap_type", f"SELECT parent, CASE WHEN mean >= 99.5 AND none = 0 THEN 'none' ELSE {ladder('mean')} END AS gap_type FROM ({COV})")
def _(spark, d):
    return R.parent_aggregates(FX.decisions(spark, d)).select("parent", R.synthesis_gap_type().alias("gap_type"))


@query("A6_parent_relationship", f"SELECT parent, rel AS coverage_relationship FROM ({PARENTS})")
def _(spark, d):
    return parent_rows(spark, d).select("parent", "coverage_relationship")


@query("A6_atomic_relationship", f"""SELECT source_id, CASE WHEN relation_type = 'conflict' THEN 'Conflicting' WHEN relation_type = 'not_covered'
  THEN 'Not covered' WHEN coverage_level >= 99.5 THEN 'Exact coverage' WHEN coverage_level >= 80 THEN CASE WHEN g THEN
  'Implementation details missing' ELSE 'Mostly covered' END WHEN coverage_level >= 60 THEN 'Largely covered' WHEN coverage_level >= 40 THEN
  CASE WHEN g THEN 'Implementation details missing' ELSE 'Partially covered' END WHEN coverage_level >= 20 THEN 'Indirectly covered'
  WHEN coverage_level >= 10 THEN 'Very weakly covered' ELSE 'Not covered' END AS relationship
  FROM (SELECT *, gap_type = 'implementation_detail_gap' AS g FROM ({FX.DECISIONS}))""")
def _(spark, d):
    return FX.decisions(spark, d).select("source_id", R.atomic_relationship(
        F.col("coverage_level"), F.col("gap_type"), F.col("relation_type")).alias("relationship"))


@query("A7_parent_risk_and_match", f"SELECT parent, risk AS mapping_risk, mt AS match_type FROM ({PARENTS})")
def _(spark, d):
    return parent_rows(spark, d).select("parent", "mapping_risk", "match_type")


_RD = f"""SELECT *, regexp_replace(source_parent_id, '__row_\\d+', '', 'g') AS parent, CASE WHEN has_c AND len(targets) > 0 THEN abs(c1 - c2) END AS margin
  FROM ({DQ.RULE_DECISIONS})"""
PRIORITY = f"""SELECT parent, pts AS points, CASE WHEN pts >= 3 THEN 'High' WHEN pts >= 1.5 THEN 'Medium' WHEN pts > 0 OR c < 99.5 THEN 'Low' ELSE 'None' END
  AS review_priority, c AS coverage_level, domain FROM (SELECT *, (CASE WHEN margin < 0.003 THEN 0.5 ELSE 0 END
    + CASE WHEN overturn >= 40 THEN 2.0 WHEN overturn >= 20 THEN 1.0 ELSE 0 END + CASE WHEN spread >= 50 THEN 1.0 WHEN spread >= 30 THEN 0.5 ELSE 0 END
    + CASE WHEN risky THEN 1.5 ELSE 0 END + CASE WHEN c <= 0 AND seen AND NOT different THEN 0.5 ELSE 0 END
    + CASE WHEN least(abs(c - 12.5), abs(c - 37.5), abs(c - 62.5), abs(c - 87.5)) <= 4 THEN 0.5 ELSE 0 END)::DOUBLE AS pts FROM (
  SELECT parent, min(margin) AS margin, max(abs(cov - pre_review_coverage)) AS overturn, max(cov) - min(cov) AS spread,
    bool_or(risk = 'High') AS risky, bool_or(has_c) AS seen, bool_or(coalesce(NOT same_functional_domain, false)) AS different,
    round_even(avg(cov), 0)::INT AS c, coalesce(arg_min(source_category, decision_order) FILTER (source_category <> ''), '') AS domain
  FROM ({_RD}) GROUP BY 1))"""


def prioritised(spark, d):
    dec = DQ.rule_decisions(spark, d)
    cov = R.with_parent(dec).groupBy("parent").agg(
        F.bround(F.avg("coverage_level")).cast("int").alias("coverage_level"),
        F.coalesce(R.first_filled(F.col("source_category"), "decision_order"), F.lit("")).alias("domain"))
    return R.review_priority(dec, cov).join(cov, "parent")


@query("A8_review_priority", f"SELECT parent, points, review_priority FROM ({PRIORITY})")
def _(spark, d):
    return prioritised(spark, d).select("parent", "points", "review_priority")


@query("A9_neighbours", f"""SELECT parent, string_agg('• ' || pid || ' · sim ' || round_even(s * 100, 0)::INT || '% — parent text [lower score, not selected]',
    chr(10) ORDER BY r) AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY s DESC, seen_at) AS r FROM (
  SELECT parent, pid, max(s) AS s, min((o, i)) AS seen_at FROM (
    SELECT parent, split_part(id1, '#', 1) AS pid, c1 AS s, decision_order AS o, 0 AS i FROM ({_RD}) WHERE has_c UNION ALL
    SELECT parent, split_part(id2, '#', 1), c2, decision_order, 1 FROM ({_RD}) WHERE has_c) GROUP BY 1, 2)
  ANTI JOIN (SELECT DISTINCT parent, split_part(t, '#', 1) AS pid FROM (SELECT parent, unnest(targets) AS t FROM ({_RD}) WHERE k % 2 = 1))
    USING (parent, pid)) WHERE r <= 3 GROUP BY 1""")
def _(spark, d):
    dec = DQ.rule_decisions(spark, d)
    listed = R.with_parent(dec).filter("k % 2 = 1").select("parent", "target_parent_ids").select(
        "parent", F.explode("target_parent_ids").alias("t")).groupBy("parent").agg(F.collect_set("t").alias("target_ids"))
    return R.neighbours(dec, listed)


REPORT = f"SELECT *, {X.bucket('coverage_level')} AS b FROM ({PRIORITY})"


@query("A10_coverage_by_category", f"""SELECT domain, count(*) AS requirements, round(avg(b), 1) AS average_coverage, count(*) FILTER (b = 0) AS gaps,
  count(*) FILTER (review_priority = 'High') AS high, count(*) FILTER (review_priority = 'Medium') AS medium,
  count(*) FILTER (review_priority = 'Low') AS low, count(*) FILTER (b = 100) AS full FROM ({REPORT}) GROUP BY 1""".replace("AS full", 'AS "full"'))
def _(spark, d):
    return R.coverage_by_category(prioritised(spark, d))


@query("A11_dashboard", f"""SELECT * FROM (SELECT round(avg(b), 1) AS parent_coverage, count(*) AS parents FROM ({REPORT})),
  (SELECT round(avg(cov), 1) AS atomic_coverage, count(*) AS decisions FROM ({_RD}))""")
def _(spark, d):
    return R.dashboard(prioritised(spark, d), DQ.rule_decisions(spark, d))


@query("A12_coverage_distribution", f"""SELECT CASE b WHEN 100 THEN 'Fully covered' WHEN 75 THEN 'Largely covered' WHEN 50 THEN 'Partially covered'
  WHEN 25 THEN 'Indirectly covered' ELSE 'Not covered' END AS coverage_type, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 1)::DOUBLE
  AS percent FROM ({REPORT}) GROUP BY 1""")
def _(spark, d):
    return R.coverage_distribution(prioritised(spark, d))


@query("A13_category_status", f"""SELECT domain, count(*) AS requirements, round(avg(b), 1) AS average_coverage, CASE WHEN avg(b) >= 70 THEN '✓ Good'
  WHEN avg(b) >= 50 THEN '⚠ Fair' ELSE '✗ Poor' END AS status, count(*) FILTER (review_priority = 'High') AS high,
  count(*) FILTER (review_priority = 'Medium') AS medium FROM ({REPORT}) GROUP BY 1""")
def _(spark, d):
    return R.category_status_table(prioritised(spark, d))


@query("A14_insights", f"""SELECT (SELECT string_agg(domain || ' ' || round_even(a, 0)::INT, ', ' ORDER BY a, domain) FROM (SELECT domain, avg(b) AS a
  FROM ({REPORT}) GROUP BY 1 ORDER BY a, domain LIMIT 2)) AS worst, count(*) FILTER (b = 50) AS partial, count(*) FILTER (b = 25) AS indirect,
  count(*) FILTER (review_priority = 'High') AS high, 0::BIGINT AS entity_gaps, count(*) FILTER (b = 0) AS gaps FROM ({REPORT})""")
def _(spark, d):
    return R.insights(prioritised(spark, d))


@query("A15_entity_gaps", f"""SELECT parent, gap AS entity_gap, CASE WHEN gap THEN 'High' ELSE 'Low' END AS review_priority FROM (SELECT parent,
  substr(parent, 2)::BIGINT % 3 = 0 AND cov > 0 AND len(list_filter(ts, lambda t: substr(t, 2)::BIGINT % 4 <> 0)) > 0 AS gap FROM ({PARENTS}))""")
def _(spark, d):
    rows = parent_rows(spark, d).withColumn("review_priority", F.lit("Low"))
    s = table(spark, d, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"),
                                         (F.col("o_orderkey") % 3 == 0).alias("important"), F.col("o_orderkey").alias("pos"))
    t = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"),
                                           (F.col("s_suppkey") % 4 == 0).alias("important"), F.col("s_suppkey").alias("pos"))
    return R.entity_gaps(rows, s, t).select("parent", "entity_gap", "review_priority")


@query("A16_run_summary", f"""SELECT count(*) AS atomic_decisions, round(avg(coverage_level), 1) AS average_coverage, count(*) FILTER (coverage_level = 0)
  AS gaps, count(*) FILTER (f) AS source_atoms, count(*) FILTER (NOT f) AS target_atoms FROM (SELECT coverage_level, true AS f FROM ({FX.DECISIONS})
  UNION ALL SELECT coverage_level, false FROM ({FX.DECISIONS_REVERSED}))""")
def _(spark, d):
    return R.run_summary(FX.decisions(spark, d), FX.decisions(spark, d, True))


@query("A17_lowest_parents", f"""SELECT source_parent_id AS parent, coalesce(arg_min(source_category, decision_order) FILTER (source_category <> ''), '')
  AS category, round(avg(coverage_level), 1) AS coverage FROM ({FX.DECISIONS}) GROUP BY 1 ORDER BY coverage, parent LIMIT 20""")
def _(spark, d):
    return R.lowest_parents(FX.decisions(spark, d))


# ---- consolidation ------------------------------------------------------------------------------
def sql_groups(dec: str) -> str:
    return f"""SELECT source_parent_id AS parent, round_even(sum(coverage_level) / count(*)::DOUBLE, 0)::INT AS coverage, min(decision_order) AS group_order,
      arg_min(CASE WHEN source_parent_requirement <> '' THEN source_parent_requirement ELSE source_requirement END, decision_order) AS requirement,
      arg_min(source_category, decision_order) AS category,
      list(target_parent_id ORDER BY decision_order) FILTER (has_target) AS ts0,
      list(b_contribution ORDER BY decision_order) FILTER (b_contribution <> '') AS bc0,
      list(gap ORDER BY decision_order) FILTER (gap <> '') AS g0 FROM ({dec}) GROUP BY 1"""


def _distinct(x: str) -> str:
    return f"list_filter(coalesce({x}, []), lambda v, i: list_position({x}, v) = i)"


def sql_grouped(dec: str) -> str:
    return (f"SELECT *, {_distinct('ts0')} AS ts, {_distinct('bc0')} AS bc, {_distinct('g0')} AS g FROM ({sql_groups(dec)})")


#: The reverse direction, in which every seventh parent is hardly covered.
BACKWARD = f"""SELECT * REPLACE (CASE WHEN TRY_CAST(regexp_extract(source_parent_id, '\\d+') AS BIGINT) % 7 = 0 THEN coverage_level % 40 ELSE coverage_level END
  AS coverage_level) FROM ({FX.DECISIONS_REVERSED})"""
GROUPS_A, GROUPS_B = sql_grouped(FX.DECISIONS), sql_grouped(BACKWARD)


def backward(spark, d):
    weak = F.regexp_extract("source_parent_id", r"\d+", 0).try_cast("long") % 7 == 0
    return FX.decisions(spark, d, True).withColumn("coverage_level", F.when(weak, F.col("coverage_level") % 40).otherwise(F.col("coverage_level")))


@query("U1_parent_groups", f"""SELECT parent, coverage, requirement, category, array_to_string(ts, ',') AS targets,
  array_to_string(bc[1:3], ' ') AS contributions, array_to_string(g[1:2], ' ') AS gaps FROM ({GROUPS_A})""")
def _(spark, d):
    g = C.parent_groups(FX.decisions(spark, d))
    return g.select("parent", "coverage", "requirement", "category", F.array_join("target_ids", ",").alias("targets"),
                    F.array_join("contributions", " ").alias("contributions"), F.array_join("gaps", " ").alias("gaps"))


def supplied(spark, d):
    return table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"),
        F.when(F.col("o_orderkey") % 4 == 0, "Merged").otherwise("").alias("consolidated_text"))


def supplements(spark, d):
    return table(spark, d, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"),
        F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise("New text").alias("consolidated_text"),
        (F.col("s_suppkey") % 3 == 0).alias("already_covered"))


U_ROWS = f"""SELECT 1 AS pass_no, group_order, parent AS a, array_to_string(ts, ',') AS b, CASE WHEN contains(parent, '__') OR substr(parent, 2)::BIGINT % 4 <> 0
    THEN requirement ELSE 'Merged' END AS text, coverage AS cov, 'A_enriched' AS origin, array_to_string(g[1:2], ' ') AS gap, category FROM ({GROUPS_A})
  UNION ALL SELECT 2, group_order, '', parent, requirement, 0, 'B_only', '', category FROM ({GROUPS_B}) WHERE coverage < 40
  UNION ALL SELECT 3, group_order, '', parent, 'New text', coverage, 'B_supplemental', array_to_string(g[1:2], ' '), category FROM ({GROUPS_B})
    WHERE coverage >= 40 AND coverage < 70 AND NOT contains(parent, '__') AND regexp_extract(parent, '\\d+')::BIGINT % 5 <> 0
    AND regexp_extract(parent, '\\d+')::BIGINT % 3 <> 0"""
U_ROWS = U_ROWS.replace("contains(parent, '__') OR substr(parent, 2)::BIGINT % 4 <> 0",
                        "contains(parent, '__') OR regexp_extract(parent, '\\d+')::BIGINT % 4 <> 0")


def merged(spark, d):
    return C.consolidate(FX.decisions(spark, d), backward(spark, d), supplied(spark, d), supplements(spark, d))


def u_rows(df):
    return df.select(F.col("source_id_a").alias("a"), F.array_join("source_ids_b", ",").alias("b"), F.col("consolidated_text").alias("text"),
                     F.col("coverage_a_to_b").alias("cov"), F.col("gap_a_to_b").alias("gap"), "category")


@query("U2_enriched", f"SELECT a, b, text, cov, gap, category FROM ({U_ROWS}) WHERE pass_no = 1")
def _(spark, d):
    return u_rows(C.enriched(C.parent_groups(FX.decisions(spark, d)), supplied(spark, d)))


@query("U3_b_only", f"SELECT a, b, text, cov, gap, category FROM ({U_ROWS}) WHERE pass_no = 2")
def _(spark, d):
    return u_rows(C.b_only(C.parent_groups(backward(spark, d))))


@query("U4_b_supplemental", f"SELECT a, b, text, cov, gap, category FROM ({U_ROWS}) WHERE pass_no = 3")
def _(spark, d):
    return u_rows(C.b_supplemental(C.parent_groups(backward(spark, d)), supplements(spark, d)))


@query("U5_consolidated_ids", f"""SELECT 'CONS-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS consolidated_id, a, origin FROM (
  SELECT *, row_number() OVER (ORDER BY pass_no, group_order, a, b) AS n FROM ({U_ROWS}))""")
def _(spark, d):
    return merged(spark, d).select("consolidated_id", F.col("source_id_a").alias("a"), "origin")


@query("U6_category_baseline", f"""SELECT origin, count(*) AS n FROM (SELECT 'A_enriched' AS origin FROM ({FX.DECISIONS}) WHERE source_category IN
  ('PROMO', 'SMALL') GROUP BY source_parent_id UNION ALL SELECT 'B_only' FROM (SELECT round_even(avg(coverage_level), 0) AS c FROM
  ({FX.DECISIONS_REVERSED}) WHERE source_category IN ('PROMO', 'SMALL') GROUP BY source_parent_id) WHERE c < 40) GROUP BY 1""")
def _(spark, d):
    chosen = spark.createDataFrame([(" promo ",), ("Small",)], "category string")
    a, b = (C.restrict_categories(FX.decisions(spark, d, r), chosen) for r in (False, True))
    return C.origin_counts(C.consolidate(a, b, supplied(spark, d)))


@query("U7_summary", f"""SELECT count(*) AS total, count(*) FILTER (origin = 'A_enriched') AS a_enriched, count(*) FILTER (origin = 'B_only') AS b_only,
  count(*) FILTER (origin = 'B_supplemental') AS b_supplemental, round_even(avg(cov) FILTER (origin = 'A_enriched'), 0)::INT AS avg_coverage_a
  FROM ({U_ROWS})""")
def _(spark, d):
    return C.summary(merged(spark, d))


# ---- evaluation ---------------------------------------------------------------------------------
FUNCTIONS = ["GV", "ID", "PR", "DE"]


def _id(k):
    return F.concat(pick(k, FUNCTIONS), F.lit(".AM-"), (k % 50).cast("string"), F.lit("."), F.floor(k / 4).cast("string"))


_SQL_ID = f"({X.pick('doc_id', FUNCTIONS)} || '.AM-' || (doc_id % 50) || '.' || (doc_id // 4))"


def agent(spark, d):
    cell = F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("> "), _id(F.col("doc_id")))).otherwise("no id in this cell")
    return E.agent_side(table(spark, d, "documents"), cell, (F.col("n_chars") % 101).cast("string"), "doc_id")


def gold(spark, d):
    x = table(spark, d, "labels").select(
        F.when(F.col("doc_id") % 2 == 0, F.concat(_id(F.col("doc_id")), F.lit(": text"))).otherwise("note").alias("c1"),
        F.when(F.col("quality") == 1, pick(F.col("doc_id"), ["Covered", "Partially", "Largely"])).otherwise("Not covered").alias("c2"),
        _id(F.col("doc_id")).alias("c3"))
    return E.gold_side(x, ["c1", "c2", "c3"])


AGENT = f"SELECT {_SQL_ID} AS id, max_by({X.bucket('(n_chars % 101)')}, doc_id)::INT AS agent FROM documents WHERE doc_id % 10 <> 0 GROUP BY 1"
GOLD = f"""SELECT {_SQL_ID} AS id, max(CASE WHEN quality = 1 THEN {X.pick('doc_id', [100, 50, 75])} ELSE 0 END)::INT AS gold FROM labels GROUP BY 1"""
COMPARED = f"SELECT *, agent - gold AS diff FROM ({AGENT}) JOIN ({GOLD}) USING (id)"
_METRICS = """count(*) AS n, count(*) FILTER (diff = 0) AS exact, count(*) FILTER (abs(diff) <= 25) AS within_one,
  round(count(*) FILTER (diff = 0) / count(*) * 100, 1) AS exact_rate, round(count(*) FILTER (abs(diff) <= 25) / count(*) * 100, 1) AS within_rate,
  count(*) FILTER (diff > 0) AS over, count(*) FILTER (diff < 0) AS under, round(sum(diff) / count(*), 1) AS mean_signed_error"""
_METRICS = _METRICS.replace("AS over", 'AS "over"')

query("E1_agent_side", AGENT)(agent)
query("E2_gold_side", GOLD)(gold)


def compared(spark, d):
    return E.compare(agent(spark, d), gold(spark, d))


@query("E3_common_ids", f"SELECT id FROM ({COMPARED})")
def _(spark, d):
    c = compared(spark, d)
    E.check_common(c)
    return c.select("id")


query("E4_differences", f"SELECT *, CASE WHEN diff > 0 THEN 'OVER' WHEN diff < 0 THEN 'UNDER' ELSE '' END AS flag FROM ({COMPARED})")(compared)


@query("E5_E6_agreement", f"SELECT {_METRICS} FROM ({COMPARED})")
def _(spark, d):
    return E.metrics(compared(spark, d))


@query("E7_one_sided", f"""SELECT id, 'agent' AS side FROM ({AGENT}) ANTI JOIN ({GOLD}) USING (id) UNION ALL SELECT id, 'gold' FROM ({GOLD})
  ANTI JOIN ({AGENT}) USING (id)""")
def _(spark, d):
    return E.one_sided(agent(spark, d), gold(spark, d))


@query("E8_by_function", f"SELECT split_part(id, '.', 1) AS function, {_METRICS} FROM ({COMPARED}) GROUP BY 1")
def _(spark, d):
    return E.metrics(compared(spark, d), F.substring_index("id", ".", 1).alias("function"))


# ---- run log ------------------------------------------------------------------------------------
STEPS = {"click": "candidate_generation", "view": "candidate_generation", "purchase": "final_judge.category_batch", "signup": "run.start",
         "error": "run.done"}
CACHE = ["miss", "hit", "obvious_gap_shortcut", "no_candidate_pool", "no_candidate_after_threshold", "not_checked"]


def run_log(spark, d):
    return log_of(table(spark, d, "events"))


def log_of(e):
    k = F.get_json_object("props", "$.k").cast("int")
    step = F.lit("")
    for t, s in STEPS.items():
        step = F.when(F.col("event_type") == t, s).otherwise(step)
    return e.select(
        F.col("ts").alias("timestamp"), step.alias("step"), F.when(k % 10 == 0, "error").otherwise("ok").alias("status"),
        F.when(k % 10 == 0, "Timeout").alias("error"), (F.col("user_id") % 5).cast("string").alias("category"),
        F.round(F.col("value") / 100, 4).alias("best_combined_score"), F.round(F.col("value") / 150, 4).alias("best_semantic_score"),
        F.when(k % 3 == 0, 0.0).otherwise(F.round(F.col("value") / 200, 4)).alias("best_action_object_score"),
        k.alias("llm_candidates"), pick(k, CACHE).alias("cache_status"), (k % 30).alias("items"), (k % 17).alias("corrections"),
        F.col("user_id").alias("batch"), F.col("event_id").alias("line_no"))


LOG = f"""SELECT ts AS timestamp, CASE event_type {' '.join(f"WHEN '{t}' THEN '{s}'" for t, s in STEPS.items())} END AS step,
  CASE WHEN k % 10 = 0 THEN 'error' ELSE 'ok' END AS status, (user_id % 5)::VARCHAR AS category, round(value / 100, 4) AS best_combined_score,
  round(value / 150, 4) AS best_semantic_score, CASE WHEN k % 3 = 0 THEN 0.0 ELSE round(value / 200, 4) END AS best_action_object_score,
  k AS llm_candidates, {X.pick('k', CACHE)} AS cache_status, k % 30 AS items, k % 17 AS corrections, user_id AS batch, event_id AS line_no
  FROM (SELECT *, (props ->> '$.k')::INT AS k FROM events)"""
CAND = f"SELECT * FROM ({LOG}) WHERE step = 'candidate_generation'"


@query("L1_step_counts", f"SELECT step, status, count(*) AS n FROM ({LOG}) GROUP BY 1, 2")
def _(spark, d):
    return RL.step_counts(run_log(spark, d))


@query("L1_errors", f"SELECT timestamp, step, 'Timeout' AS error FROM ({LOG}) WHERE status = 'error'")
def _(spark, d):
    return RL.errors(run_log(spark, d))


@query("L2_score_stats", " UNION ALL ".join(f"""SELECT '{c}' AS metric, round(avg({c}), 3) AS avg, round(min({c}), 3)::DOUBLE AS min, round(max({c}), 3)::DOUBLE
  AS max FROM ({CAND})""" for c in RL.SCORES))
def _(spark, d):
    return RL.score_stats(run_log(spark, d))


@query("L3_score_buckets", f"""SELECT CASE WHEN best_combined_score >= 0.6 THEN '>=0.6' WHEN best_combined_score >= 0.5 THEN '0.5-0.6' WHEN
  best_combined_score >= 0.4 THEN '0.4-0.5' ELSE '<0.4' END AS bucket, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM ({CAND})), 1)
  AS percent FROM ({CAND}) GROUP BY 1""")
def _(spark, d):
    return RL.score_buckets(run_log(spark, d))


@query("L4_zero_action_object", f"""SELECT count(*) FILTER (best_action_object_score = 0) AS zero, count(*) AS events,
  round(100.0::DOUBLE * count(*) FILTER (best_action_object_score = 0) / count(*), 1) AS percent FROM ({CAND})""")
def _(spark, d):
    return RL.zero_action_object(run_log(spark, d))


@query("L5_reuse_stats", f"""SELECT count(*) FILTER (cache_status = 'miss') AS miss, count(*) FILTER (cache_status = 'hit') AS hit,
  count(*) FILTER (cache_status = 'obvious_gap_shortcut') AS shortcut, count(*) FILTER (cache_status LIKE 'no_candidate%') AS no_candidate FROM ({CAND})""")
def _(spark, d):
    return RL.reuse_stats(run_log(spark, d))


_BATCH = f"SELECT * FROM ({LOG}) WHERE step = 'final_judge.category_batch'"


@query("L6_correction_rate", f"""SELECT sum(corrections)::BIGINT AS corrected, sum(items)::BIGINT AS reviewed, round(100.0::DOUBLE * sum(corrections) / sum(items), 1)
  AS rate, sum(corrections) * 100.0 / sum(items) > 35 AS alert FROM ({_BATCH})""")
def _(spark, d):
    return RL.correction_rate(run_log(spark, d))


@query("L6_batch_rows", f"SELECT category, batch, corrections, items, corrections > items AS exceeds FROM ({_BATCH})")
def _(spark, d):
    return RL.batch_rows(run_log(spark, d))


@query("L7_stage_timing", f"""SELECT 'Full run' AS stage, s AS seconds FROM (SELECT round((epoch_us(max_by(timestamp, line_no) FILTER (step = 'run.done'))
  - epoch_us(max_by(timestamp, line_no) FILTER (step = 'run.start'))) / 1e6, 3) AS s FROM ({LOG})) WHERE s >= 0
  UNION ALL SELECT 'Reviews' AS stage, s AS seconds FROM (SELECT round((epoch_us(max_by(timestamp, line_no) FILTER (step = 'candidate_generation'))
  - epoch_us(max_by(timestamp, line_no) FILTER (step = 'final_judge.category_batch'))) / 1e6, 3) AS s FROM ({LOG})) WHERE s >= 0""")
def _(spark, d):
    stages = RL.STAGES + [("Reviews", "final_judge.category_batch", "candidate_generation")]
    return RL.stage_timing(run_log(spark, d), stages=stages)


@query("L8_events_per_category", f"SELECT category, count(*) AS n FROM ({CAND}) GROUP BY 1")
def _(spark, d):
    return RL.events_per_category(run_log(spark, d))


def usage(spark, d):
    e = table(spark, d, "events")
    name = F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat(F.initcap("event_type"), F.lit("-"), (F.col("user_id") % 3).cast("string")))
    return e.select(name.alias("model"), F.lit(1).alias("calls"), F.round(F.col("value") * 1000).cast("long").alias("input_tokens"),
                    F.col("user_id").alias("output_tokens"))


USAGE = """SELECT CASE WHEN user_id % 10 = 0 THEN 'unknown' ELSE upper(event_type[1]) || event_type[2:] || '-' || (user_id % 3) END AS model, count(*) AS calls,
  sum(CAST(round(value * 1000) AS BIGINT))::BIGINT AS input_tokens, sum(user_id)::BIGINT AS output_tokens FROM events GROUP BY 1"""
PRICES = [("Click", 1.5, 2.0), ("cl", 9.0, 9.0), ("sign", 0.25, 0.5), ("signup-1", 0.75, 1.0), ("view", 0.1, None)]
_PRICES = "(VALUES " + ", ".join(f"('{k}', {i}::DOUBLE, {o if o is not None else 0}::DOUBLE)" for k, i, o in PRICES) + ") AS p(k, i, o)"
PRICED = f"""SELECT u.*, coalesce(i, 0) AS input_price, coalesce(o, 0) AS output_price FROM ({USAGE}) u LEFT JOIN {_PRICES}
  ON contains(lower(model), lower(k)) QUALIFY row_number() OVER (PARTITION BY model ORDER BY length(k) DESC NULLS LAST) = 1"""

query("L9_usage_totals", USAGE)(lambda spark, d: RL.usage_totals(usage(spark, d)))


def priced(spark, d):
    p = spark.createDataFrame([(k, i, o, n) for n, (k, i, o) in enumerate(PRICES)], "model string, input double, output double, pos int")
    return RL.match_prices(RL.usage_totals(usage(spark, d)), p)


query("L10_price_match", PRICED)(priced)


@query("L11_costs", f"""WITH c AS (SELECT model, input_tokens / 1e6 * input_price + output_tokens / 1e6 * output_price AS c FROM ({PRICED}))
  SELECT model, round(c, 4) AS cost_usd FROM c UNION ALL SELECT '(total)', round(sum(c), 4) FROM c""")
def _(spark, d):
    return RL.costs(priced(spark, d))
