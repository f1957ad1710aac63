"""Registered queries for the taxonomy (C, S9, S10), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.operators import similarity as SI
from mapweave.operators import taxonomy as T
from mapweave.plans import fixtures as FX
from mapweave.plans import sqltext as X
from mapweave.plans.fixtures import pick, table
from mapweave.sources import requirements as R

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            S[name] = sql
        return fn
    return register


SHEET = ["Category", "Definition", "Sub category", "Positive keywords EN", "Keywords FR", "Negative keywords", "Typical actions",
         "Typical objects", "Examples", "Counterexamples"]
CARD_ROWS = [
    ("1. English", "plain words", "tion", "the ; and", "", "und | der", "with", "by", "of the", ""),
    ("2. Deutsch", "", "ung", "und , die", "", "the ", "in der", "auf", "ist", "les"),
    ("", "row without category", "", "the", "", "", "", "", "", ""),
    ("3. Français", "mots", "", "pour", "les | des", "los", "dans", "avec", "par", ""),
    ("4. Español", "", "", "que , los", "", " and ", "con", "para", "una", "der"),
]
RULES = [("2", ["ung", "heit"], ["zzz"], 0.2), ("4", ["ción"], ["the "], 0.3), ("3", ["eaux"], [], 0.25)]
OVERRIDE_SHEET = ["Enabled", "Priority", "Pattern", "Match mode", "Applies to", "Primary category", "Secondary categories", "Confidence",
                  "Reason"]
OVERRIDE_ROWS = [
    ("", "", "tionha", "", "", "4", "1; 9; 4", "", ""),
    ("yes", "200", "^src1\\d$", "regex", "title", "3. Français", "", "0.7", "by title"),
    ("no", "900", "the", "contains", "all", "1", "", "1", "switched off"),
    ("true", "300", " DE ", "exact", "category", "2 - german", "3", "1.4", "exact language"),
    ("true", "x", "((", "regex", "text", "1", "", "0.9", "bad pattern"),
]


def cards_table(spark):
    rows = [(i, *r) for i, r in enumerate(CARD_ROWS)]
    return R.load_cards(spark.createDataFrame(rows, ["pos", *SHEET]))


def overrides_table(spark):
    return R.load_overrides(spark.createDataFrame([(i, *r) for i, r in enumerate(OVERRIDE_ROWS)], ["pos", *OVERRIDE_SHEET]))


def dims(spark):
    return T.collect_cards(cards_table(spark)), T.collect_overrides(overrides_table(spark))


def inputs(spark, d):
    x = table(spark, d, "documents")
    cat = pick(F.col("doc_id"), ["1  English!", "", "de", "other"])
    return x.select("doc_id", F.lit("A").alias("framework"), F.col("doc_id").cast("string").alias("control_id"), F.col("source").alias("title"),
                    cat.alias("original_category"), F.col("text").alias("requirement"), F.lit("{}").alias("fields_json"),
                    F.lit("").alias("keywords_text"))


def classified(spark, d, least=5):
    cards, over = dims(spark)
    return T.classify(inputs(spark, d), cards, over, rules=RULES, least=least)


# ---- expected SQL -------------------------------------------------------------------------------
CARDS = [r for r in CARD_ROWS if r[0]]


def _split(v: str) -> list[str]:
    out = []
    for sep in (";", "|", ","):
        v = v.replace(sep, "\n")
    for x in v.split("\n"):
        x = " ".join(x.split())
        if x and x not in out:
            out.append(x)
    return out


class _Card(dict):
    __getattr__ = dict.__getitem__


def _card(r) -> _Card:
    n = dict(zip(SHEET, r))
    return _Card(category=n["Category"], definition=n["Definition"], subcategories=_split(n["Sub category"]),
                 positive_en=_split(n["Positive keywords EN"]), positive_fr=_split(n["Keywords FR"]), negative=_split(n["Negative keywords"]),
                 actions=_split(n["Typical actions"]), objects=_split(n["Typical objects"]), examples=_split(n["Examples"]),
                 counterexamples=_split(n["Counterexamples"]), number=n["Category"].split(".")[0])


def _sql_score(r) -> str:
    c = _card(r)
    own = "[" + ", ".join(X.q(t) for t in T.card_tokens(c)) + "]"
    out = f"0.18::DOUBLE * len(list_intersect(tk, {own})) / greatest(len(tk) + {len(T.card_tokens(c))} - len(list_intersect(tk, {own})), 1)"
    hit = lambda w: f"contains(low, {X.q(w.casefold())})"
    for words, weight in [(c.positive_en + c.positive_fr, 0.075), (c.actions, 0.045), (c.objects, 0.05), (c.examples, 0.055),
                          (c.subcategories, 0.03), (c.negative, -0.10), (c.counterexamples, -0.08)]:
        for w in words:
            out += f" + CASE WHEN {hit(w)} THEN {weight} ELSE 0 END"
    out += f" + CASE WHEN regexp_matches(low, '\\b{c.number}\\b') THEN 0.16 ELSE 0 END + CASE WHEN {hit(c.category)} THEN 0.18 ELSE 0 END"
    for n, pos, veto, boost in RULES:
        if n == c.number:
            veto_sql = " OR ".join(hit(v) for v in veto) or "false"
            out += f" + CASE WHEN ({' OR '.join(hit(x) for x in pos)}) AND NOT ({veto_sql}) THEN {boost} ELSE 0 END"
    return f"round(greatest(0.0, least(1.25, {out})), 9)"


_BASE = f"""SELECT *, list_distinct({X.toks('low')}) AS tk FROM (SELECT doc_id, source AS title, {X.pick('doc_id', ['1  English!', '', 'de', 'other'])} AS oc, text,
  {X.fold(X.norm("concat_ws(' ', 'A', doc_id::VARCHAR, source, " + X.pick('doc_id', ['1  English!', '', 'de', 'other']) + ", text, '{}', '')"))} AS low FROM documents)"""
SCORES = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, {X.q(r[0])} AS category, {_sql_score(r)} AS score FROM b" for i, r in enumerate(CARDS))
_WITH = f"WITH b AS MATERIALIZED ({_BASE}), s AS MATERIALIZED ({SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rk FROM s)"
_TOP = """t AS (SELECT doc_id, max(category) FILTER (rk = 1) AS best, max(score) FILTER (rk = 1) AS top, max(score) FILTER (rk = 2) AS second FROM r GROUP BY 1),
  c AS (SELECT *, least(0.98, 0.34 + least(0.46, top * 0.55) + least(0.20, greatest(0, top - second) * 0.9))::DOUBLE AS conf FROM t),
  st AS (SELECT *, CASE WHEN top - second < 0.15 AND second > 0.25 THEN 'multi_domain' WHEN conf >= 0.85 THEN 'validated' WHEN conf >= 0.6
    THEN 'medium_confidence' ELSE 'low_confidence' END AS status FROM c),
  o AS (SELECT doc_id, oc, text, CASE WHEN oc = '1  English!' THEN 'exact' WHEN oc = 'de' THEN 'two' WHEN regexp_matches(lower(title), '^src1\\d$') THEN 'three'
    WHEN contains(low, 'tionha') THEN 'four' WHEN contains(lower(text), '((') THEN 'one' END AS how FROM b),
  f AS (SELECT doc_id, how, oc, text, CASE how WHEN 'exact' THEN '1. English' WHEN 'two' THEN '2. Deutsch' WHEN 'three' THEN '3. Français' WHEN 'four' THEN '4. Español'
    WHEN 'one' THEN '1. English' ELSE best END AS primary_category, CASE how WHEN 'exact' THEN 1.0 WHEN 'two' THEN 1.0 WHEN 'three' THEN 0.7 WHEN 'four' THEN 0.98
    WHEN 'one' THEN 0.9 ELSE conf END::DOUBLE AS confidence, CASE WHEN how = 'three' THEN 'medium_confidence' WHEN how IS NOT NULL THEN 'validated' ELSE status END AS status,
    CASE WHEN how = 'exact' THEN 'already_enisa_category' WHEN how IS NOT NULL THEN 'override' ELSE 'deterministic_rules' END AS method FROM o JOIN st USING (doc_id)),
  n AS (SELECT doc_id, string_agg(category, ',' ORDER BY k) AS secondary FROM (SELECT r.doc_id, r.category, r.rk, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.rk) AS k
    FROM r JOIN f USING (doc_id) JOIN s p ON p.doc_id = r.doc_id AND p.category = f.primary_category WHERE r.category <> f.primary_category AND r.score >= 0.25
    AND p.score - r.score <= 0.28) WHERE k <= 2 GROUP BY 1),
  z AS (SELECT f.*, CASE WHEN method = 'override' THEN CASE how WHEN 'two' THEN '3. Français' WHEN 'four' THEN '1. English' ELSE '' END ELSE coalesce(secondary, '') END
    AS secondary FROM f LEFT JOIN n USING (doc_id))"""
FULL = f"{_WITH}, {_TOP}"


_TERMS = "array_to_string(list_filter([trim(t) FOR t IN regexp_split_to_array({}, '[;|,]+')], lambda t, i: t <> ''), '|')"


@query("S9_taxonomy_cards", f"""SELECT p_partkey::INT AS card_pos, category, trim(regexp_replace(lower(category), '[^a-z0-9]+', ' ', 'g')) AS card_key,
  regexp_extract(category, '^(\\d+)', 1) AS number, {_TERMS.format("lower(p_brand) || ';;' || p_type")} AS positive, {_TERMS.format("'not ' || p_type || ' ,| '")} AS negative
  FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 13) || '. ' || p_name ELSE p_name END AS category FROM part) WHERE p_partkey % 9 <> 0""")
def _(spark, d):
    """A sheet made of parts: every ninth row lacks a category, terms repeat and hold empty entries."""
    k, brand = F.col("p_partkey"), F.lower("p_brand")
    sheet = table(spark, d, "part").select(
        k.alias("pos"), F.when(k % 9 == 0, "  ").when(k % 2 == 0, F.concat((k % 13).cast("string"), F.lit(".  "), "p_name")).otherwise(F.col("p_name")).alias("CATEGORY"),
        F.concat(brand, F.lit(";; "), "p_type", F.lit(" , "), brand, F.lit("|")).alias("keywords_en"),
        F.concat(F.lit("not  "), "p_type", F.lit(" ,| ")).alias("Exclusion keywords"))
    return R.load_cards(sheet).select("card_pos", "category", "card_key", "number", F.array_join("positive_en", "|").alias("positive"), F.array_join("negative", "|").alias("negative"))


@query("S10_override_rules", """SELECT source AS pattern, 100 + (min(doc_id) % 3)::INT AS priority, 'contains' AS match_mode, least(1.0, 0.5 + min(doc_id) / 10.0)::DOUBLE
  AS confidence, 'override: ' || source AS reason FROM documents WHERE source <> 'src5' GROUP BY source""")
def _(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("pos"))
    sheet = g.select("pos", F.col("source").alias("Pattern"), (F.col("pos") % 3 + 100).cast("string").alias("Priority"),
                     F.when(F.col("source") == "src5", "No").otherwise("").alias("Enabled"), F.lit("1").alias("Primary category"),
                     (F.lit(0.5) + F.col("pos") / 10).cast("string").alias("Confidence"))
    return R.load_overrides(sheet).select("pattern", "priority", "match_mode", "confidence", "reason")


@query("C1_exact_category", f"{FULL} SELECT doc_id, primary_category FROM z WHERE method = 'already_enisa_category'")
def _(spark, d):
    return classified(spark, d).filter("category_method = 'already_enisa_category'").select("doc_id", "primary_category")


@query("C2_overrides", f"{FULL} SELECT doc_id, primary_category, confidence, secondary FROM z WHERE method = 'override'")
def _(spark, d):
    return classified(spark, d).filter("category_method = 'override'").select(
        "doc_id", "primary_category", F.col("category_confidence").alias("confidence"), F.array_join("secondary_categories", ",").alias("secondary"))


@query("C3_C4_category_scores", f"{FULL} SELECT doc_id, category, round(score, 6) AS score FROM s")
def _(spark, d):
    return classified(spark, d, least=None).select("doc_id", F.inline("ranked")).select("doc_id", "category", F.round("score", 6).alias("score"))


@query("C5_best_category", f"{FULL} SELECT doc_id, best, round(top - second, 6) AS margin FROM t")
def _(spark, d):
    r = F.col("ranked")
    return classified(spark, d).select("doc_id", r[0]["category"].alias("best"), F.round(r[0]["score"] - r[1]["score"], 6).alias("margin"))


@query("C6_confidence", f"{FULL} SELECT doc_id, round(confidence, 6) AS confidence FROM z")
def _(spark, d):
    return classified(spark, d).select("doc_id", F.round("category_confidence", 6).alias("confidence"))


@query("C7_status", f"{FULL} SELECT doc_id, status FROM z")
def _(spark, d):
    return classified(spark, d).select("doc_id", F.col("category_status").alias("status"))


@query("C8_secondary", f"{FULL} SELECT doc_id, secondary FROM z")
def _(spark, d):
    return classified(spark, d).select("doc_id", F.array_join("secondary_categories", ",").alias("secondary"))


@query("C9_supplied_classification", f"""{FULL} SELECT doc_id, CASE WHEN u THEN '3. Français' ELSE primary_category END AS primary_category,
  CASE WHEN u THEN 'supplied' ELSE method END AS method, CASE WHEN u THEN 1.0 ELSE round(confidence, 6) END AS confidence FROM (SELECT *, method =
  'deterministic_rules' AND doc_id % 2 = 1 AND doc_id % 6 <> 3 AS u FROM z)""")
def _(spark, d):
    cards, over = dims(spark)
    c = T.classify(inputs(spark, d).withColumn("atomic_id", F.col("control_id")), cards, over, rules=RULES)
    s = table(spark, d, "documents").filter("doc_id % 2 = 1").select(
        F.col("doc_id").cast("string").alias("atomic_id"), F.when(F.col("doc_id") % 6 == 3, "unknown").otherwise("3").alias("primary"),
        F.lit("1; 4").alias("secondary"), F.lit("1.7").alias("confidence"))
    return T.apply_supplied(c, s, cards).select("doc_id", "primary_category", F.col("category_method").alias("method"),
                                                F.round("category_confidence", 6).alias("confidence"))


@query("C10_apply_category", f"{FULL} SELECT doc_id, primary_category AS category, lower(primary_category) AS category_key, oc AS original_category FROM z")
def _(spark, d):
    return T.apply_to_atoms(classified(spark, d)).select("doc_id", "category", "category_key", "original_category")


def repaired(spark, d):
    """Every third atom is strong; every third has two stored decisions, of which the later counts; the rest is classified."""
    cards, over = dims(spark)
    a = inputs(spark, d).withColumns({
        "key": F.col("control_id"), "primary_category": F.when(F.col("doc_id") % 3 == 0, "old").otherwise(""),
        "category_confidence": F.when(F.col("doc_id") % 3 == 0, 0.9).otherwise(0.95), "category_status": F.lit("stale"),
        "category_method": F.lit("stale"), "secondary_categories": F.array(F.lit("stale"))})
    known = table(spark, d, "documents").filter("doc_id % 3 = 1").select(
        F.col("doc_id").cast("string").alias("key"), F.explode(F.array(F.lit(1), F.lit(2))).alias("log_order")).select(
        "key", "log_order", F.when(F.col("log_order") == 2, "stored").otherwise("earlier").alias("primary_category"),
        F.when(F.col("log_order") == 2, 0.8).otherwise(0.97).alias("category_confidence"), F.lit("kept_status").alias("category_status"),
        F.array(F.lit("s"), F.col("log_order").cast("string")).alias("secondary_categories"))
    return a, T.repair(a, known, cards, over, rules=RULES)


@query("C11_incremental_repair", f"""{FULL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'kept' WHEN doc_id % 3 = 1 THEN 'reused' ELSE 'classified' END AS source,
  CASE WHEN doc_id % 3 = 0 THEN 'old' WHEN doc_id % 3 = 1 THEN 'stored' ELSE primary_category END AS category,
  CASE WHEN doc_id % 3 = 0 THEN 0.9 WHEN doc_id % 3 = 1 THEN 0.8 ELSE round(confidence, 6) END AS confidence,
  CASE WHEN doc_id % 3 = 0 THEN 'stale' WHEN doc_id % 3 = 1 THEN 'kept_status' ELSE status END AS status,
  CASE WHEN doc_id % 3 = 0 THEN 'stale' WHEN doc_id % 3 = 1 THEN 's,2' ELSE secondary END AS secondary FROM z""")
def _(spark, d):
    return repaired(spark, d)[1].select(
        "doc_id", F.col("category_source").alias("source"), F.col("primary_category").alias("category"), F.round("category_confidence", 6).alias("confidence"),
        F.col("category_status").alias("status"), F.array_join("secondary_categories", ",").alias("secondary"))


@query("C11_repair_counts", f"""{FULL} SELECT 'weak_before' AS measure, count(*) FILTER (doc_id % 3 <> 0) AS n FROM z
  UNION ALL SELECT 'weak_after', count(*) FILTER (doc_id % 3 = 1 OR (doc_id % 3 = 2 AND (confidence < 0.85 OR primary_category = ''))) FROM z
  UNION ALL SELECT 'source_' || CASE WHEN doc_id % 3 = 0 THEN 'kept' WHEN doc_id % 3 = 1 THEN 'reused' ELSE 'classified' END, count(*) FROM z GROUP BY 1""")
def _(spark, d):
    return T.repair_counts(*repaired(spark, d))


@query("C12_quality_report", f"""{FULL} SELECT 'A' AS framework, count(*) AS total, count(*) FILTER (confidence < 0.6) AS low, count(*) FILTER (confidence >= 0.6 AND
  confidence < 0.85) AS medium, count(*) FILTER (oc <> '' AND oc <> primary_category) AS changed, count(*) FILTER (status = 'multi_domain' OR secondary <> '') AS multi,
  round(count(*) FILTER (confidence < 0.6) / count(*), 4) AS low_rate, round(count(*) FILTER (confidence >= 0.6 AND confidence < 0.85) / count(*), 4) AS medium_rate,
  round(count(*) FILTER (oc <> '' AND oc <> primary_category) / count(*), 4) AS changed_rate FROM z""")
def _(spark, d):
    return T.quality_report(T.apply_to_atoms(classified(spark, d)))


@query("C12_distribution", f"{FULL} SELECT 'A' AS framework, primary_category AS category, status, count(*) AS atoms FROM z GROUP BY 2, 3")
def _(spark, d):
    return T.distribution(T.apply_to_atoms(classified(spark, d)))


@query("C13_match_keys", f"""SELECT atomic_id, CASE WHEN pos % 5 = 0 AND category <> 'fr' THEN category || ';fr' ELSE category END AS keys FROM ({FX.DOC_ATOMS})""")
def _(spark, d):
    return FX.atoms(spark, d).select("atomic_id", F.array_join(SI.category_keys(
        F.col("primary_category"), F.col("category"), F.col("secondary_categories")), ";").alias("keys"))
