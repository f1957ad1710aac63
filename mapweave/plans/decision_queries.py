"""Registered queries for the decision rules (D) and for reuse and target checks (J16, J17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.operators import decide as D
from mapweave.operators import retrieval as RT
from mapweave.operators import search as SE
from mapweave.params import DEFAULTS
from mapweave.plans import fixtures as FX
from mapweave.plans import match_queries as M
from mapweave.plans import sqltext as X
from mapweave.plans.fixtures import pick, table
from mapweave.plans.text_queries import sql_gap_type, sql_relation_type

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            S[name] = sql
        return fn
    return register


# ---- fixture: decisions with two scored candidates per order line ---------------------------------
EQS = ["Partial", "Exact match", "Indirect", "Gap", "Exact match"]
RELS = ["partial", "gap", "conflict", "mostly covered", "", "exact"]
GAPS = ["", "partial", "implementation", "", "none", "conflict", "odd"]
MATCHES = ["Direct", "None", "Composite", "", "Indirect"]
RISKS = ["", "High", "Low", "Medium", ""]
SEVS = ["moderate", "Material", "minor", "major"]
SIGNALS = ("combined", "semantic", "structured", "action_object", "category_prior")
MULTS = {1: (37, 53, 29, 17, 11), 2: (41, 59, 31, 19, 13)}
# scores spread around the thresholds of the rules
SPAN = {"combined": (0.30, 0.60), "semantic": (0.40, 0.55), "structured": (0.0, 0.5), "action_object": (0.0, 0.9),
        "category_prior": (0.0, 0.4)}


def rule_decisions(spark, d, near: str | None = None):
    """near: the column by which rows lie together. They are dealt out while they are narrow, before candidates and texts are made."""
    k = FX.decisions(spark, d).select("source_id", "source_category", "decision_order", "k", "coverage_level", "gap_items",
                                      "confidence", "same_functional_domain", "other_key", "source_parent_id",
                                      "pre_review_coverage")
    k = k.repartition(near) if near else k

    def score(i, n):
        low, width = SPAN[n]
        return F.round(F.lit(low) + F.lit(width) * ((F.col("k") * MULTS[i][SIGNALS.index(n)]) % 101) / 100, 4)

    def candidate(i):
        cid = F.concat(F.lit(f"T{i}."), (F.col("k") % 97).cast("string"), F.lit("#1"))
        return F.struct(cid.alias("candidate_id"), F.concat(F.lit(f"T{i}."), (F.col("k") % 97).cast("string")).alias("parent_id"),
                        F.concat(F.lit("text of "), cid).alias("requirement"), F.lit("parent text").alias("parent_requirement"),
                        *[score(i, n).alias(f"{n}_score") for n in (
                            "semantic", "structured", "action_object", "category_prior", "combined")],
                        F.lit("pass").alias("hard_gate"), F.lit(i).alias("rank"))

    cands = F.when(F.col("k") % 23 == 0, D.none(f"array<{D.CANDIDATE}>")).otherwise(F.array(candidate(1), candidate(2)))
    c1, c2 = (F.concat(F.lit(f"T{i}."), (F.col("k") % 97).cast("string"), F.lit("#1")) for i in (1, 2))
    m = F.col("k") % 4
    ids = (F.when((F.col("k") % 23 == 0) | (m == 0), D.none()).when(m == 1, F.array(c1)).when(m == 2, F.array(c2))
           .otherwise(F.array(c1, c2)))
    kk = F.col("k")
    items = F.when(kk % 5 == 0, F.array(D.gap_item("action", "missing", pick(kk, SEVS), ""))).otherwise(
        D.none(f"array<{D.GAP_ITEM}>"))
    e = F.lit("")
    # coverage in fives reaches every tie of the snap
    cov = (kk * 7) % 21 * 5
    return k.withColumns({
        "candidates": cands, "selected_ids": ids, "target_ids": ids,
        "target_requirements": F.transform(ids, lambda x: F.concat(F.lit("text of "), x)),
        "target_parent_ids": F.transform(ids, lambda x: F.regexp_replace(x, "#1$", "")),
        "target_parent_requirements": F.transform(ids, lambda x: F.lit("parent text")),
        "coverage_level": F.when(kk % 6 == 0, 0).otherwise(cov).cast("int"), "equivalence_level": pick(kk, EQS),
        "relation_type": pick(kk, RELS), "gap_type": pick(kk, GAPS), "match_type": pick(kk, MATCHES), "mapping_risk": pick(kk, RISKS),
        "gap_items": items, "gap": F.when(kk % 2 == 0, "base gap").otherwise(""), "justification": e, "combine_controls": e,
        "recommendation": e, "scoring_rationale": e})


def _sql_score(i, n):
    low, width = SPAN[n]
    return f"round({low} + {width} * ((k * {MULTS[i][SIGNALS.index(n)]}) % 101) / 100, 4)::DOUBLE"


SHORT = {"combined": "c", "semantic": "s", "structured": "st", "action_object": "ao", "category_prior": "cp"}
RULE_DECISIONS = f"""SELECT *, CASE WHEN NOT has_c OR k % 4 = 0 THEN [] WHEN k % 4 = 1 THEN [id1] WHEN k % 4 = 2 THEN [id2]
    ELSE [id1, id2] END AS targets,
  CASE WHEN c1 > c2 OR (c1 = c2 AND s1 >= s2) THEN 1 ELSE 2 END AS bi FROM (
  SELECT source_id, source_category, source_parent_id, pre_review_coverage, decision_order, k, confidence, same_functional_domain,
    CASE WHEN k % 6 = 0 THEN 0 ELSE (k * 7) % 21 * 5 END AS cov, {X.pick('k', EQS)} AS eq, {X.pick('k', RELS)} AS rel,
    {X.pick('k', GAPS)} AS gt, {X.pick('k', MATCHES)} AS mt, {X.pick('k', RISKS)} AS risk,
    k % 23 <> 0 AS has_c, 'T1.' || (k % 97) || '#1' AS id1, 'T2.' || (k % 97) || '#1' AS id2,
    {', '.join(f'{_sql_score(i, n)} AS {SHORT[n]}{i}' for i in (1, 2) for n in SIGNALS)},
    CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS n_items, k % 5 = 0 AND {X.pick('k', SEVS)} IN ('Material', 'major') AS material,
    CASE WHEN k % 2 = 0 THEN 'base gap' ELSE '' END AS gap FROM ({FX.DECISIONS}))"""

_EQ = "CASE WHEN {c} >= 100 THEN 'Exact match' WHEN {c} >= 40 THEN 'Partial' WHEN {c} >= 10 THEN 'Indirect' ELSE 'Gap' END"
_LIMIT = "CASE WHEN {x} < 0.10 THEN 30 WHEN {x} < 0.25 THEN 50 ELSE 100 END"


def sql_cascade(source: str, cap: bool = True) -> str:
    """The rules as a chain of CTEs over scalar columns; every stage replaces the columns it changes."""
    stages = [f"""SELECT * REPLACE (least(greatest(ceil((cov - 5) / 10.0) * 10, 0), 100)::INT AS cov),
        CASE WHEN bi = 1 THEN c1 ELSE c2 END AS bc, CASE WHEN bi = 1 THEN s1 ELSE s2 END AS bs,
        CASE WHEN bi = 1 THEN st1 ELSE st2 END AS bst, CASE WHEN bi = 1 THEN ao1 ELSE ao2 END AS bao,
        CASE WHEN bi = 1 THEN cp1 ELSE cp2 END AS bcp, CASE WHEN bi = 1 THEN id1 ELSE id2 END AS bid FROM ({source})""",
              f"SELECT * REPLACE ({sql_gap_type('gt', 'cov', 'rel')} AS gt) FROM {{p}}",
              f"SELECT * REPLACE ({sql_relation_type('rel', 'cov', 'gt')} AS rel) FROM {{p}}",
              """SELECT *, CASE WHEN has_c AND same_functional_domain IS DISTINCT FROM false AND bao >= 0.45 THEN
        CASE WHEN bc >= 0.55 AND bs >= 0.60 THEN 'partial_gap' WHEN bc >= 0.45 AND (bst >= 0.25 OR bs >= 0.55 OR bcp >= 0.20)
          THEN 'implementation_detail_gap' WHEN bc >= 0.35 OR bs >= 0.48 THEN 'indirect_support_gap' END END AS kind,
        false AS done FROM {p}"""]
    rescue = """SELECT * EXCLUDE (r) REPLACE (CASE WHEN r THEN [bid] ELSE targets END AS targets,
        CASE WHEN r THEN CASE WHEN kind = 'indirect_support_gap' THEN 20 ELSE 50 END ELSE cov END AS cov,
        CASE WHEN r THEN CASE WHEN kind = 'indirect_support_gap' THEN 'Indirect' ELSE 'Partial' END ELSE eq END AS eq,
        CASE WHEN r THEN CASE kind WHEN 'partial_gap' THEN 'partial' WHEN 'indirect_support_gap' THEN 'indirect_support' ELSE kind END
          ELSE rel END AS rel, CASE WHEN r THEN kind ELSE gt END AS gt,
        CASE WHEN r THEN CASE kind WHEN 'partial_gap' THEN 'Candidate rescue - partial' WHEN 'indirect_support_gap' THEN
          'Candidate rescue - indirect' ELSE 'Candidate rescue - implementation detail' END ELSE mt END AS mt,
        CASE WHEN r THEN least(CASE WHEN confidence = 0 THEN 0.45 ELSE confidence END, 0.55) ELSE confidence END AS confidence,
        CASE WHEN r THEN 'High' ELSE risk END AS risk, CASE WHEN r THEN n_items + 1 ELSE n_items END AS n_items,
        CASE WHEN r THEN material OR kind = 'indirect_support_gap' ELSE material END AS material)
        FROM (SELECT *, {cond} AND kind IS NOT NULL AS r FROM {p})"""
    stages += [rescue.replace("{cond}", "len(targets) = 0"),
               """SELECT * EXCLUDE (r) REPLACE (r AS done, CASE WHEN r THEN 'true_gap' ELSE rel END AS rel,
        CASE WHEN r THEN 'true_gap' ELSE gt END AS gt, CASE WHEN r THEN 'Gap' ELSE eq END AS eq, CASE WHEN r THEN 0 ELSE cov END AS cov,
        CASE WHEN r THEN 'None' ELSE mt END AS mt, CASE WHEN r AND risk = '' THEN 'High' ELSE risk END AS risk)
        FROM (SELECT *, len(targets) = 0 AS r FROM {p})""",
               """SELECT *, CASE WHEN has_c THEN greatest(CASE WHEN list_contains(targets, id1) THEN ao1 ELSE 0 END,
        CASE WHEN list_contains(targets, id2) THEN ao2 ELSE 0 END) ELSE 0 END AS mao FROM {p}"""]
    if cap:
        lim = _LIMIT.format(x="mao")
        stages.append(f"""SELECT * EXCLUDE (r, lim) REPLACE (CASE WHEN r THEN lim ELSE cov END AS cov,
        CASE WHEN r THEN {_EQ.format(c='lim')} ELSE eq END AS eq,
        CASE WHEN r AND lim <= 30 THEN 'indirect_support' WHEN r AND lim <= 50 THEN 'partial' ELSE rel END AS rel,
        CASE WHEN r AND lim <= 30 THEN 'indirect_support_gap' ELSE gt END AS gt,
        CASE WHEN r AND lim <= 30 THEN 'Indirect' WHEN r AND lim <= 50 AND mt <> 'Composite' THEN 'Direct' ELSE mt END AS mt,
        CASE WHEN r THEN 'High' ELSE risk END AS risk) FROM (SELECT *, {lim} AS lim, NOT done AND cov > {lim} AS r FROM {{p}})""")
    stages += [rescue.replace("{cond}", "NOT done AND cov = 0"),
               """SELECT * EXCLUDE (r) REPLACE (done OR r AS done, CASE WHEN r AND rel <> 'conflict' THEN 'true_gap' ELSE rel END AS rel,
        CASE WHEN r THEN CASE WHEN rel = 'conflict' THEN 'conflict_gap' ELSE 'true_gap' END ELSE gt END AS gt,
        CASE WHEN r THEN 'Gap' ELSE eq END AS eq, CASE WHEN r THEN 'None' ELSE mt END AS mt,
        CASE WHEN r THEN [] ELSE targets END AS targets, CASE WHEN r AND risk = '' THEN 'High' ELSE risk END AS risk)
        FROM (SELECT *, NOT done AND cov = 0 AS r FROM {p})""",
               f"""SELECT * REPLACE (CASE WHEN NOT done AND eq = 'Exact match' AND cov < 100 THEN {_EQ.format(c='cov')} ELSE eq END AS eq)
        FROM {{p}}""",
               """SELECT * EXCLUDE (r) REPLACE (CASE WHEN r THEN 'Partial' ELSE eq END AS eq, CASE WHEN r THEN least(cov, 80) ELSE cov END AS cov,
        CASE WHEN r THEN 'partial_gap' ELSE gt END AS gt, CASE WHEN r THEN 'High' ELSE risk END AS risk)
        FROM (SELECT *, NOT done AND eq = 'Exact match' AND mao < 0.65 AS r FROM {p})""",
               """SELECT * EXCLUDE (r) REPLACE (CASE WHEN r THEN 'Exact match' ELSE eq END AS eq, CASE WHEN r THEN 'none' ELSE gt END AS gt,
        CASE WHEN r THEN 'direct_full_coverage' ELSE rel END AS rel)
        FROM (SELECT *, NOT done AND cov = 100 AND eq <> 'Exact match' AS r FROM {p})""",
               """SELECT * REPLACE (CASE WHEN done THEN mt WHEN len(targets) > 1 THEN 'Composite' WHEN mt IN ('', 'None') THEN
        CASE WHEN cov >= 50 THEN 'Direct' ELSE 'Indirect' END ELSE mt END AS mt) FROM {p}""",
               """SELECT * EXCLUDE (u) REPLACE (coalesce(u, cov) AS cov, CASE u WHEN 100 THEN 'Exact match' WHEN 80 THEN 'Partial' ELSE eq END AS eq,
        CASE u WHEN 100 THEN 'direct_full_coverage' WHEN 80 THEN 'mostly_covered' ELSE rel END AS rel,
        CASE WHEN u = 100 THEN 'none' WHEN u = 80 THEN CASE WHEN n_items > 0 THEN 'implementation_detail_gap' ELSE 'partial_gap' END
          ELSE gt END AS gt, CASE WHEN u = 100 THEN 'Low' WHEN u = 80 AND risk = '' THEN 'Medium' ELSE risk END AS risk)
        FROM (SELECT *, CASE WHEN NOT done AND len(targets) > 0 AND has_c AND cov < 100 THEN
          CASE WHEN cov >= 80 AND bc >= 0.68 AND bs >= 0.84 AND bao >= 0.18 AND n_items = 0 THEN 100
               WHEN cov < 80 AND bc >= 0.58 AND bs >= 0.76 AND bao >= 0.18 AND bst >= 0.10 AND NOT material THEN 80 END END AS u FROM {p})""",
               f"""SELECT * EXCLUDE (r) REPLACE (CASE WHEN r THEN 50 ELSE cov END AS cov, CASE WHEN r THEN 'Partial' ELSE eq END AS eq,
        CASE WHEN r AND gt IN ('indirect_support_gap', 'true_gap') THEN 'partial_gap' ELSE gt END AS gt,
        CASE WHEN r THEN 'partial' ELSE rel END AS rel) FROM (SELECT *, NOT done AND len(targets) > 0 AND has_c AND lower(risk) <> 'high'
          AND cov <= 30 AND {_LIMIT.format(x='bao')} > 30 AND bc >= 0.60 AS r FROM {{p}})""",
               f"""SELECT * EXCLUDE (r) REPLACE (CASE WHEN r THEN 80 ELSE cov END AS cov, CASE WHEN r THEN 'Partial' ELSE eq END AS eq,
        CASE WHEN r THEN 'mostly_covered' ELSE rel END AS rel, CASE WHEN r THEN CASE WHEN gt IN ('indirect_support_gap', 'true_gap')
          THEN 'partial_gap' WHEN gt IN ('', 'partial_gap') THEN CASE WHEN n_items > 0 THEN 'implementation_detail_gap' ELSE 'partial_gap'
          END ELSE gt END ELSE gt END AS gt)
        FROM (SELECT *, NOT done AND len(targets) > 0 AND has_c AND lower(risk) <> 'high' AND cov <= 50
          AND {_LIMIT.format(x='bao')} >= 80 AND bs >= 0.80 AND bao >= 0.20 AND NOT material AS r FROM {{p}})""",
               """SELECT * EXCLUDE (r) REPLACE (CASE WHEN r THEN 'Not covered' ELSE eq END AS eq, CASE WHEN r THEN 'not_covered' ELSE rel END AS rel)
        FROM (SELECT *, NOT done AND cov <= 30 AND len(targets) > 0 AND has_c AND CASE WHEN cov <= 20 THEN bc < 0.45 OR bs < 0.65
          ELSE bc < 0.50 AND bs < 0.70 END AS r FROM {p})""",
               f"SELECT * REPLACE (CASE WHEN done THEN gt ELSE {sql_gap_type('gt', 'cov', 'rel')} END AS gt) FROM {{p}}",
               f"SELECT * REPLACE (CASE WHEN done THEN rel ELSE {sql_relation_type('rel', 'cov', 'gt')} END AS rel) FROM {{p}}",
               """SELECT * REPLACE (CASE WHEN done OR risk <> '' THEN risk WHEN cov <= 20 OR eq = 'Gap' THEN 'High'
        WHEN cov < 80 OR mt = 'Composite' THEN 'Medium' WHEN cov < 100 THEN 'Low' ELSE 'None' END AS risk) FROM {p}"""]
    ctes = ",\n".join(f"w{i} AS ({s.replace('{p}', f'w{i - 1}')})" for i, s in enumerate(stages))
    return f"WITH {ctes} SELECT * FROM w{len(stages) - 1}"


OUTCOME = """source_id, cov AS coverage_level, eq AS equivalence_level, rel AS relation_type, gt AS gap_type, mt AS match_type,
  risk AS mapping_risk, array_to_string(targets, ',') AS targets, round(confidence, 6) AS confidence, n_items::INT AS n_items"""


def outcome(df):
    return df.select("source_id", "coverage_level", "equivalence_level", "relation_type", "gap_type", "match_type",
                     "mapping_risk", F.array_join("target_ids", ",").alias("targets"), F.round("confidence", 6).alias("confidence"),
                     F.size("gap_items").alias("n_items"))


@query("D7_D17_correction_rules", f"SELECT {OUTCOME} FROM ({sql_cascade(RULE_DECISIONS)})")
def _(spark, d):
    return outcome(D.correct(rule_decisions(spark, d)))


# one query per rule: the rows the rule can touch, seen through the finished cascade
def rule_query(name: str, columns: list[str], where: str, sql_where: str):
    names = {"coverage_level": "cov", "equivalence_level": "eq", "relation_type": "rel", "gap_type": "gt", "match_type": "mt",
             "mapping_risk": "risk"}
    sql = (f"SELECT {', '.join(f'{names[c]} AS {c}' for c in columns)}, count(*) AS n FROM ({sql_cascade(RULE_DECISIONS)}) "
           f"WHERE {sql_where} GROUP BY ALL")

    @query(name, sql)
    def _(spark, d):
        return D.correct(rule_decisions(spark, d)).filter(where).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


rule_query("D7_level_and_taxonomy", ["coverage_level", "gap_type", "relation_type"], "true", "true")
rule_query("D8_rescue", ["coverage_level", "equivalence_level", "gap_type", "mapping_risk"], "match_type like 'Candidate rescue%'",
           "mt LIKE 'Candidate rescue%'")
rule_query("D9_no_target", ["coverage_level", "relation_type", "mapping_risk"], "size(target_ids) = 0", "len(targets) = 0")
rule_query("D10_gate_cap", ["coverage_level", "relation_type", "mapping_risk"], "coverage_level in (30, 50) and mapping_risk = 'High'",
           "cov IN (30, 50) AND risk = 'High'")
rule_query("D11_zero_with_target", ["relation_type", "gap_type", "mapping_risk"], "coverage_level = 0", "cov = 0")
rule_query("D12_exact_match", ["coverage_level", "gap_type", "relation_type"], "equivalence_level in ('Exact match', 'Partial')",
           "eq IN ('Exact match', 'Partial')")
rule_query("D13_match_type", ["match_type"], "true", "true")
rule_query("D14_strong_upgrade", ["coverage_level", "relation_type", "gap_type"], "coverage_level >= 80", "cov >= 80")
rule_query("D15_coverage_floor", ["coverage_level", "relation_type", "gap_type", "mapping_risk"],
           "coverage_level in (50, 80) and mapping_risk != 'High'", "cov IN (50, 80) AND risk <> 'High'")
rule_query("D16_not_covered", ["coverage_level", "relation_type"], "equivalence_level = 'Not covered'", "eq = 'Not covered'")
rule_query("D17_defaults", ["coverage_level", "equivalence_level", "mapping_risk"], "true", "true")


# ---- decisions straight from the search ----------------------------------------------------------
def searched_sources(spark, d):
    """All vector sources with their candidate arrays (null when nothing passed the threshold)."""
    s, t = FX.vectors(spark, d)
    c = SE.search(*M.vector_sides(spark, d), M.VECTOR_PARAMS)
    texts = t.select("atomic_id", "parent_id", "atomic_requirement", F.lit("").alias("parent_requirement"), "category")
    p = RT.payloads(c, texts)
    return s.select(F.col("atomic_id").alias("source_id")).join(p, "source_id", "left")


DECIDED = f"""SELECT source_id, best_id, round(bc, 4) AS bc, round(bs, 4) AS bs FROM (SELECT s.vec_id::VARCHAR AS source_id FROM
  embeddings s WHERE vec_id % 2 = 0) LEFT JOIN (SELECT source_id, candidate_id AS best_id, combined AS bc, semantic AS bs
  FROM ({M._VEC_RANKED}) WHERE rank = 1 AND combined >= 0.04) USING (source_id)"""
_D123 = f"""SELECT source_id, CASE WHEN best_id IS NULL OR bc < 0.45 OR (bc < 0.10 AND bs < 0.20 AND 0.0 < 0.15) THEN '' ELSE best_id
  END AS target, CASE WHEN best_id IS NULL OR bc < 0.45 THEN 0 ELSE 50 END AS coverage_level, CASE WHEN best_id IS NULL THEN
  '{D.BELOW_THRESHOLD}' WHEN bc < 0.10 AND bs < 0.20 THEN '{D.OBVIOUS_GAP}' WHEN bc < 0.45 THEN '{D.LOW_SCORE}' ELSE '{D.PARTLY}' END
  AS gap FROM ({DECIDED})"""


@query("D1_D2_D3_first_decision", _D123)
def _(spark, d):
    return D.decide(searched_sources(spark, d)).select(
        "source_id", F.array_join("target_ids", ",").alias("target"), "coverage_level", "gap")


def scored_sources(spark, d):
    """Decision fixture as undecided sources: candidates in rank order, first one best."""
    r = rule_decisions(spark, d).select("source_id", "k", "candidates")
    low = F.transform("candidates", lambda c: c.withField("combined_score", F.round(c["combined_score"] * 0.2, 4)).withField(
        "semantic_score", F.round(c["semantic_score"] * 0.3, 4)))
    ranked = F.when(F.col("k") % 3 == 0, low).otherwise(F.col("candidates"))
    return r.select("source_id", "k", ranked.alias("candidates"), F.when(F.col("k") % 29 == 0, 0).otherwise(5).alias("pool_size"))


_SCORED = f"""SELECT *, CASE WHEN k % 29 = 0 THEN 'No candidate for scope soft_enisa' WHEN NOT has_c THEN '{D.BELOW_THRESHOLD}'
    WHEN c < 0.10 AND s < 0.20 AND ao1 < 0.15 THEN '{D.OBVIOUS_GAP}' WHEN c < 0.45 THEN '{D.LOW_SCORE}' END AS gap_reason FROM (
  SELECT source_id, k, has_c, ao1, id1, id2, CASE WHEN k % 3 = 0 THEN round(c1 * 0.2, 4) ELSE c1 END AS c,
    CASE WHEN k % 3 = 0 THEN round(s1 * 0.3, 4) ELSE s1 END AS s FROM ({RULE_DECISIONS}))"""
_HEUR = f"""SELECT *, CASE WHEN gap_reason IS NOT NULL THEN 0 WHEN c >= 0.72 AND ao1 >= 0.25 THEN 80 ELSE 50 END AS cov0
  FROM ({_SCORED})"""


@query("D1_gap_decision", f"""SELECT gap_reason AS gap, count(*) AS n FROM ({_SCORED}) WHERE gap_reason IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return D.decide(scored_sources(spark, d)).filter("size(target_ids) = 0").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


@query("D2_obvious_gap", f"SELECT source_id FROM ({_SCORED}) WHERE gap_reason = '{D.OBVIOUS_GAP}'")
def _(spark, d):
    return D.decide(scored_sources(spark, d)).filter(F.col("gap") == D.OBVIOUS_GAP).select("source_id")


@query("D3_heuristic_decision", f"""SELECT source_id, cov0 AS coverage_level, CASE WHEN gap_reason IS NULL THEN id1 ELSE '' END AS target,
  CASE WHEN gap_reason IS NULL THEN 'Medium' ELSE 'High' END AS mapping_risk FROM ({_HEUR})""")
def _(spark, d):
    return D.decide(scored_sources(spark, d)).select("source_id", "coverage_level", F.array_join("target_ids", ",").alias("target"),
                                                     "mapping_risk")


CONFS = ["0.9", "medium", "very low", "", "0.64"]
CONF_VALUES = [0.9, 0.6, 0.2, 0.0, 0.64]


def judgements(spark, d, shift=0):
    r = rule_decisions(spark, d).select("source_id", "k", "candidates")
    kk = F.col("k") + shift
    ids = F.when(kk % 3 == 0, F.lit('["T1.x"]')).when(kk % 3 == 1, F.to_json(F.array(
        F.concat(F.lit("T1."), (F.col("k") % 97).cast("string"), F.lit("#1")), F.lit("unknown")))).otherwise(F.concat(
            F.lit('"T2.'), (F.col("k") % 97).cast("string"), F.lit("#1, T1."), (F.col("k") % 97).cast("string"), F.lit('#1"')))
    text = F.concat(F.lit('{"selected_candidate_ids": '), ids, F.lit(', "coverage_level": "'), ((kk * 7) % 101).cast("string"),
                    F.lit('", "confidence": "'), pick(kk, CONFS), F.lit('", "relation_type": "'), pick(kk, RELS),
                    F.lit('", "gap": "g", "gap_items": [{"missing_element": "m", "severity": "High"}, {"dimension": "x"}],'
                          ' "same_functional_domain": "'), pick(kk, ["yes", "different", "?"]), F.lit('"}'))
    bad = F.when(F.col("k") % 13 == 0, F.lit("{not json")).otherwise(text)
    return r.filter("k % 11 <> 0").select("source_id", bad.alias("judgement"))


_J_IDS = """CASE (k + {h}) % 3 WHEN 0 THEN '' WHEN 1 THEN id1 ELSE id2 || ',' || id1 END"""
_ASKED = f"(gap_reason IS NULL OR gap_reason NOT IN ('{D.OBVIOUS_GAP}', '{D.BELOW_THRESHOLD}')) AND has_c AND NOT (c < 0.10 AND s < 0.20 AND ao1 < 0.15)"


def sql_judged(h: int) -> str:
    return f"""SELECT source_id, k, CASE WHEN asked AND ok THEN ids WHEN gap_reason IS NULL THEN id1 ELSE '' END AS targets,
    CASE WHEN asked AND ok THEN ((k + {h}) * 7) % 101 WHEN asked AND NOT ok THEN least(cov0, 50) ELSE cov0 END AS coverage_level,
    CASE WHEN asked AND ok THEN ({X.pick(f'(k + {h})', CONF_VALUES)})::DOUBLE WHEN gap_reason IS NULL THEN 0.45 ELSE 1.0 END AS confidence,
    CASE WHEN asked AND ok THEN ({X.pick(f'(k + {h})', [True, False, None])}) END AS same,
    CASE WHEN asked AND NOT ok THEN CASE WHEN k % 11 = 0 THEN 'MissingJudgement' ELSE 'UnreadableJudgement' END ELSE '' END AS error
    FROM (SELECT *, {_ASKED} AS asked, k % 11 <> 0 AND k % 13 <> 0 AS ok, {_J_IDS.format(h=h)} AS ids FROM ({_HEUR}))"""


def judged(spark, d, shift=0):
    return D.decisions_from_judgements(scored_sources(spark, d), judgements(spark, d, shift))


@query("D4_supplied_judgement", f"SELECT source_id, targets, coverage_level, confidence, same FROM ({sql_judged(0)})")
def _(spark, d):
    return judged(spark, d).select("source_id", F.array_join("target_ids", ",").alias("targets"), "coverage_level", "confidence",
                                   F.col("same_functional_domain").alias("same"))


@query("D5_judgement_fallbacks", f"SELECT error, count(*) AS n_decisions FROM ({sql_judged(0)}) WHERE error <> '' GROUP BY 1")
def _(spark, d):
    return D.fallback_counts(judged(spark, d))


@query("D6_reevaluation", f"""SELECT a.source_id, CASE WHEN t THEN b.confidence ELSE a.confidence END AS confidence,
  CASE WHEN t THEN b.coverage_level ELSE a.coverage_level END AS coverage_level FROM (SELECT a, b, a.confidence < 0.65 AND b.confidence >=
  a.confidence AS t FROM ({sql_judged(0)}) a JOIN ({sql_judged(1)}) b USING (source_id))""")
def _(spark, d):
    return D.reevaluate(judged(spark, d), judged(spark, d, 1)).select("source_id", "confidence", "coverage_level")


# ---- review -------------------------------------------------------------------------------------
_SELECTED = f"""SELECT source_id, source_category, ceil(row_number() OVER (PARTITION BY source_category ORDER BY decision_order) / 25.0)::BIGINT
  AS batch_no FROM ({FX.DECISIONS}) WHERE NOT (confidence >= 0.80 AND coverage_level > 50)"""


@query("D18_review_selection", f"SELECT * FROM ({_SELECTED})")
def _(spark, d):
    return D.review_selection(FX.decisions(spark, d)).select("source_id", "source_category", "batch_no")


@query("D18_review_batches", f"""SELECT CASE WHEN source_category = '' THEN 'Uncategorized' ELSE source_category END AS category, batch_no,
  count(*) AS n_decisions FROM ({_SELECTED}) GROUP BY 1, 2""")
def _(spark, d):
    return D.review_batches(D.review_selection(FX.decisions(spark, d)))


@query("D19_review_payload", f"""SELECT source_id, CASE WHEN NOT has_c THEN '' WHEN c1 >= c2 THEN id1 || ' text,' || id2 || ' text'
  ELSE id2 || ' text,' || id1 || ' text' END AS shown FROM ({RULE_DECISIONS})""")
def _(spark, d):
    c = rule_decisions(spark, d).select("source_id", D.review_candidates(F.col("candidates"), 10, 4).alias("c"))
    return c.select("source_id", F.array_join(F.transform("c", lambda x: F.concat(x["candidate_id"], F.lit(" "), x["requirement"])), ",")
                    .alias("shown"))


def corrections(spark, d):
    r = rule_decisions(spark, d).filter("k % 4 <> 0").select("source_id", "k")
    kk = F.col("k")
    first = F.concat(
        F.lit('{"relation_type": "partial", "coverage_level": '), ((kk * 3) % 11 * 10).cast("string"),
        F.when(kk % 2 == 0, ".5").otherwise(""), F.lit(', "mapping_risk": "Low"}'))
    second = F.when(kk % 3 == 0, F.concat(
        F.lit('{"corrected_mapping_risk": "Medium", "gap_items": [], "selected_candidate_ids": "nope, T2.'),
        (kk % 97).cast("string"), F.lit('#1"}')))
    both = F.filter(F.array(*[F.struct(F.lit(1).alias("batch_no"), F.lit(i).alias("position"), c.alias("correction")) for i, c in ((1, first), (2, second))]),
                    lambda x: (x["position"] == 1) | x["correction"].isNotNull())
    return r.select("source_id", F.inline(both))


#: The rules run after each correction: once over all corrected rows, again over those with a second one.
_ONCE = sql_cascade(f"""SELECT * REPLACE ('partial' AS rel, (k * 3) % 11 * 10 AS cov, 'Low' AS risk), coalesce(pre_review_coverage, cov) AS before
  FROM ({RULE_DECISIONS}) WHERE k % 4 <> 0""", cap=False)
_TWICE = sql_cascade(f"""SELECT * EXCLUDE (bc, bs, bst, bao, bcp, bid, kind, done, mao) REPLACE ('Medium' AS risk, 0 AS n_items, false AS material,
  CASE WHEN has_c THEN [id2] ELSE targets END AS targets) FROM ({_ONCE}) WHERE k % 3 = 0""", cap=False)


@query("D20_apply_corrections", f"""SELECT {OUTCOME}, before AS pre_review_coverage FROM ({_ONCE}) WHERE k % 3 <> 0
  UNION ALL SELECT {OUTCOME}, before FROM ({_TWICE}) UNION ALL SELECT {OUTCOME}, pre_review_coverage FROM ({RULE_DECISIONS}) WHERE k % 4 = 0""")
def _(spark, d):
    r = D.apply_corrections(rule_decisions(spark, d, near="source_id"), corrections(spark, d))
    return r.select(
        *outcome(r).columns[:7], F.array_join("target_ids", ",").alias("targets"), F.round("confidence", 6).alias("confidence"),
        F.size("gap_items").alias("n_items"), "pre_review_coverage")


# ---- reuse and target check -----------------------------------------------------------------------
@query("J16_decision_reuse", """WITH c AS (SELECT text, lang, min(doc_id) FILTER (doc_id % 3 = 0) AS stored FROM documents GROUP BY 1, 2)
  SELECT doc_id, CASE WHEN stored IS NULL THEN 'miss' ELSE 'hit' END AS status, stored AS decision FROM documents JOIN c USING (text, lang)""")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("key", D.decision_key(DEFAULTS, F.col("text"), F.col("lang")))
    stored = docs.filter("doc_id % 3 = 0").select("key", F.col("doc_id").alias("decision"), F.col("doc_id").alias("stored_order"))
    hits, misses = D.reuse(docs.select("doc_id", "key"), stored)
    return (hits.select("doc_id", F.lit("hit").alias("status"), "decision")
            .unionByName(misses.select("doc_id", F.lit("miss").alias("status"), F.lit(None).cast("long").alias("decision"))))


def _current_targets(spark, d):
    s = table(spark, d, "supplier").filter("s_suppkey % 5 <> 0")
    return s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("parent_id"),
                    F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("#1")).alias("atomic_id"))


def _two_targets(spark, d):
    x = FX.decisions(spark, d)
    extra = F.when(F.col("k") % 4 == 0, F.array(F.concat(F.lit("S"), ((F.col("k") % 10) * 5).cast("string")))).otherwise(D.none())
    parents = F.concat("target_parent_ids", extra)
    return x.withColumns({
        "target_parent_ids": parents, "target_ids": F.transform(parents, lambda p: F.concat(p, F.lit("#1"))),
        "selected_ids": F.transform(parents, lambda p: F.concat(p, F.lit("#1"))),
        "target_requirements": F.transform(parents, lambda p: F.concat(F.lit("Text of "), p)),
        "target_parent_requirements": parents, "equivalence_level": F.lit("Partial")})


_TWO = f"""SELECT *, list_concat(CASE WHEN has_target THEN [target_parent_id] ELSE []::VARCHAR[] END,
    CASE WHEN k % 4 = 0 THEN ['S' || ((k % 10) * 5)] ELSE []::VARCHAR[] END) AS ps FROM ({FX.DECISIONS})"""
_OK = f"SELECT *, list_filter(ps, lambda p: substr(p, 2)::BIGINT % 5 <> 0) AS ok FROM ({_TWO})"


@query("J17_invalid_targets", f"""SELECT source_id, array_to_string(list_sort(list_distinct(list_filter(ps, lambda p:
  substr(p, 2)::BIGINT % 5 = 0))), ',') AS bad_parents FROM ({_OK}) WHERE len(ok) < len(ps)""")
def _(spark, d):
    b = D.invalid_targets(_two_targets(spark, d), _current_targets(spark, d))
    return b.select("source_id", F.array_join("bad_parent_ids", ",").alias("bad_parents"))


@query("J17_target_policy", f"""SELECT source_id, array_to_string(ok, ',') AS parents, CASE WHEN len(ok) = 0 AND len(ps) > 0 THEN 0 ELSE
  coverage_level END AS coverage_level, CASE WHEN len(ok) < len(ps) THEN 'High' ELSE mapping_risk END AS mapping_risk FROM ({_OK})""")
def _(spark, d):
    r = D.check_targets(_two_targets(spark, d), _current_targets(spark, d), "sanitize")
    return r.select("source_id", F.array_join("target_parent_ids", ",").alias("parents"), "coverage_level", "mapping_risk")
