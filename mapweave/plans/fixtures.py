"""Views that let the given tables play the roles of a crosswalk: requirements, atoms, decisions, log, usage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mapweave.operators.prepare import add_fields, add_matching_text, atomize
from mapweave.plans import sqltext as X
from mapweave.sources.tables import read_parquet

# tables whose rows are worth spreading before heavy work on them
SPREAD_KEYS = {"documents": "doc_id", "conversations": "conv_id", "lineitem": "l_orderkey", "embeddings": "vec_id"}
# Fixed fixture values
SEPS = [";", " and shall ", ". ", " and "]
FAMILIES = [("ntre", ["ntre ", "ntion"]), ("eaux", ["eaux", "heea"]), ("sch", ["ich ", "sch"])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", key=SPREAD_KEYS.get(name))


def pick(index: Column, items) -> Column:
    """Item (index mod n) of a short list."""
    n = len(items)
    out = F.lit(items[-1])
    for i in range(n - 2, -1, -1):
        out = F.when(index % n == i, F.lit(items[i])).otherwise(out)
    return out


# ---- requirements (documents) ------------------------------------------------------------------
def raw_requirements(spark, sf_dir) -> DataFrame:
    """Untyped sheet: odd columns, blank cells, repeated ids."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.when(F.col("doc_id") % 7 == 0, F.lit("  ")).otherwise(F.col("source")).alias("Req ID"),
        F.col("source").alias("Title"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(" \n ")).otherwise(F.col("text")).alias("Requirement text"),
        F.concat(F.lit("  "), F.upper("lang"), F.lit("  x")).alias("Category"),
        pick(F.col("doc_id"), ["yes", "Non", "", "✓", "maybe"]).alias("Important"),
        F.col("doc_id").alias("pos"),
    )


RAW_REQUIREMENTS = f"""SELECT CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS raw_id, source AS title,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE {X.norm('text')} END AS requirement,
  upper(lang) || ' x' AS category, {X.pick('doc_id', [True, False, False, True, False])} AS important, doc_id AS pos
  FROM documents"""


def requirements(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("framework"),
        F.concat(F.upper("lang"), F.lit("."), F.col("doc_id").cast("string")).alias("source_id"),
        F.col("source").alias("title"), F.col("text").alias("requirement"), F.col("lang").alias("category"),
        F.lit("").alias("subcategory"), F.col("doc_id").alias("pos"),
        (F.col("doc_id") % 3 == 0).alias("important"), F.lit(True).alias("essential"))


REQUIREMENTS = """SELECT CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS framework,
  upper(lang) || '.' || doc_id AS source_id, source AS title, text AS requirement, lang AS category,
  '' AS subcategory, doc_id AS pos, doc_id % 3 = 0 AS important, true AS essential FROM documents"""


def atoms(spark, sf_dir) -> DataFrame:
    """Atoms of all documents, with category attributes and a control type."""
    return with_atom_attributes(atomize(requirements(spark, sf_dir), SEPS))


def with_atom_attributes(a: DataFrame) -> DataFrame:
    a = a.withColumns({
        "primary_category": F.lit(""),
        "secondary_categories": F.when(F.col("pos") % 5 == 0, F.array(F.lit("fr"))).otherwise(
            F.array().cast("array<string>")),
        "category_confidence": (F.col("pos") % 11) / F.lit(10.0),
        "category_status": F.when(F.col("pos") % 13 == 0, "needs review").otherwise(""),
    })
    return add_fields(a, F.when(F.col("pos") % 2 == 0, "preventive").otherwise("detective"))


def sql_atoms(source: str, seps=SEPS) -> str:
    """Expected atoms of a (parent_id, requirement, category, pos, title, framework) query."""
    parts = f"[{X.norm('requirement')}]"
    for s in seps:
        cut = (f"list_filter(list_transform(string_split_regex(p, '(?i)\\Q{s}\\E'), lambda y: trim(y, ' .')), "
               f"lambda y: y <> '')")
        parts = (f"flatten(list_transform({parts}, lambda p: CASE WHEN contains(lower(p), {X.q(s)}) AND len(p) > 120 "
                 f"THEN {cut} ELSE [p] END))")
    return f"""SELECT r.*, no AS atom_no, parent_id || '#' || no AS atomic_id, {X.norm('parts[no]')} AS atomic_requirement
      FROM (SELECT *, CASE WHEN len(p0) > 0 THEN p0 ELSE [{X.norm('requirement')}] END AS parts
            FROM (SELECT *, {parts} AS p0 FROM ({source}))) r, unnest(range(1, len(parts) + 1)) AS u(no)"""


DOC_ATOMS = sql_atoms("SELECT framework, source_id AS parent_id, title, requirement, category, pos FROM "
                      f"({REQUIREMENTS})")


def sql_atom_features(atoms_sql: str) -> str:
    """Expected fields and attributes on top of sql_atoms."""
    low = "lower(atomic_requirement)"
    return f"""SELECT * EXCLUDE (tk), tk, coalesce(tk[1], '') AS f_action, array_to_string(tk[2:5], ' ') AS f_object,
      CASE WHEN contains({low}, 'shall') OR contains({low}, 'must') OR contains({low}, 'doit')
                OR contains({low}, 'doivent') THEN 'shall/must' ELSE '' END AS f_obligation,
      CASE WHEN pos % 2 = 0 THEN 'preventive' ELSE 'detective' END AS f_control, tk[1:12] AS keywords,
      CASE WHEN pos % 5 = 0 THEN ['fr'] ELSE []::VARCHAR[] END AS secondary,
      (pos % 11) / 10.0::DOUBLE AS confidence, CASE WHEN pos % 13 = 0 THEN 'needs review' ELSE '' END AS status
      FROM (SELECT *, {X.toks('atomic_requirement')} AS tk FROM ({atoms_sql}))"""


# ---- crosswalk sides: benchmark statements against all documents ---------------------------------
def source_requirements(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.lit("S").alias("framework"), F.concat(F.lit("FR."), F.col("item_id").cast("string")).alias("source_id"),
        F.lit("").alias("title"), F.col("text").alias("requirement"),
        F.when(F.col("item_id") % 4 == 0, "fr").otherwise("en").alias("category"),
        F.lit("").alias("subcategory"), F.col("item_id").alias("pos"))


SOURCE_REQUIREMENTS = """SELECT 'S' AS framework, 'FR.' || item_id AS parent_id, '' AS title, text AS requirement,
  CASE WHEN item_id % 4 = 0 THEN 'fr' ELSE 'en' END AS category, item_id AS pos FROM benchmark"""


def source_atoms(spark, sf_dir) -> DataFrame:
    return with_atom_attributes(atomize(source_requirements(spark, sf_dir), SEPS))


SOURCE_ATOMS = sql_atoms(SOURCE_REQUIREMENTS)


def searchable(a: DataFrame) -> DataFrame:
    """Atoms ready for the search: input order, matching text and hashed vector."""
    from mapweave.operators.prepare import embed
    return embed(add_matching_text(a.withColumn("order_no", F.col("pos") * 1000000 + F.col("atom_no"))))


# ---- vectors ------------------------------------------------------------------------------------
def vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("atomic_id"), F.col("vec_id").cast("string").alias("parent_id"),
        F.col("vec_id").alias("order_no"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("string").alias("category"), F.lit("").alias("primary_category"),
        F.array().cast("array<string>").alias("secondary_categories"), F.lit(0.9).alias("category_confidence"),
        F.lit("").alias("category_status"), F.lit("").alias("atomic_requirement"),
        F.struct(*[F.lit("").alias(n) for n in ("domain", "actor", "action", "object", "condition", "deadline",
                                                "evidence", "obligation_type", "control_type")]).alias("fields"))
    return e.filter(F.col("order_no") % 2 == 0), e.filter(F.col("order_no") % 2 == 1)


# ---- decisions (lineitem) -----------------------------------------------------------------------
_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
               "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
GAP_TYPES = ["partial_gap", "implementation_detail_gap", "true_gap"]
DIMS = ["evidence", "action", "deadline", "scope", "role"]
SEVERITIES = ["moderate", "material", "minor"]


def decisions(spark, sf_dir, reverse: bool = False) -> DataFrame:
    """One atomic decision per order line: parent = order (or supplier), target = supplier (or order).

    decision_order numbers the lines of a parent; orders have few lines, suppliers many, so both shapes of
    roll-up are covered.
    """
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    j = li.join(p, "l_partkey")
    k = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber"))
    cov = F.round(F.col("l_discount") * 1000).cast("int")
    own, other = ("l_suppkey", "l_orderkey") if reverse else ("l_orderkey", "l_suppkey")
    letter, tletter = ("S", "O") if reverse else ("O", "S")
    line_key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey",
                           "l_suppkey")], F.col("l_quantity").cast("int").cast("string"),
                           F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    order = ((((F.col("l_partkey") * 8 + F.col("l_linenumber")) * 64 + F.col("l_quantity").cast("long")) * 16
              + F.round(F.col("l_tax") * 100).cast("long")) * 1000000 + F.col(other))
    target = F.concat(F.lit(tletter), F.col(other).cast("string"))
    has_target = (cov > 0) & (k % 9 != 0)
    return j.select(
        F.concat(F.lit(letter), F.col(own).cast("string"), F.when(k % 8 == 0, "__row_7").otherwise(""))
        .alias("source_parent_id"),
        F.concat(F.lit(letter), F.col(own).cast("string"), F.lit("#"), line_key).alias("source_id"),
        order.cast("long").alias("decision_order"),
        F.col("p_brand").alias("source_requirement"),
        F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("Parent "), F.col(own).cast("string")))
        .alias("source_parent_requirement"),
        F.when(k % 10 == 0, "").otherwise(F.col("p_type")).alias("source_category"),
        cov.alias("coverage_level"), (F.col("l_quantity") / 50.0).alias("confidence"),
        F.when(F.col("l_linestatus") == "F", "High").otherwise("Low").alias("mapping_risk"),
        F.when(F.col("l_returnflag") == "A", GAP_TYPES[0]).when(F.col("l_returnflag") == "N", GAP_TYPES[1])
        .otherwise(GAP_TYPES[2]).alias("gap_type"),
        F.when(k % 5 == 0, "not_covered").when(k % 31 == 0, "conflict").otherwise("partial").alias("relation_type"),
        F.when(k % 4 == 0, "Composite").otherwise("Direct").alias("match_type"),
        F.when(has_target, F.array(target)).otherwise(F.array().cast("array<string>")).alias("target_parent_ids"),
        F.when(has_target, F.array(F.concat(target, F.lit("#1")))).otherwise(F.array().cast("array<string>"))
        .alias("target_ids"),
        F.when(has_target, F.array(F.concat(F.lit("Text of "), target))).otherwise(F.array().cast("array<string>"))
        .alias("target_parent_requirements"),
        F.when(k % 3 == 0, F.array(F.struct(
            pick(k, DIMS).alias("dimension"), F.concat(F.lit("Missing "), F.col("p_brand")).alias("gap"),
            pick(k, SEVERITIES).alias("severity")))).otherwise(
                F.array().cast("array<struct<dimension:string,gap:string,severity:string>>")).alias("gap_items"),
        F.when(k % 2 == 0, F.concat(F.lit("Gap on "), F.col("p_brand"))).otherwise("").alias("gap"),
        F.when(k % 7 == 0, F.concat(F.lit("Adds "), F.col("p_brand"))).otherwise("").alias("b_contribution"),
        F.when(k % 12 == 0, (cov + 30) % 101).alias("pre_review_coverage"),
        F.when(k % 14 == 0, False).when(k % 3 == 0, True).alias("same_functional_domain"),
        k.alias("k"), F.col(other).alias("other_key"), F.col("l_tax").alias("tax"))


def sql_decisions(reverse: bool = False) -> str:
    own, other = ("l_suppkey", "l_orderkey") if reverse else ("l_orderkey", "l_suppkey")
    letter, tletter = ("S", "O") if reverse else ("O", "S")
    return f"""SELECT '{letter}' || {own} || CASE WHEN k % 8 = 0 THEN '__row_7' ELSE '' END AS source_parent_id,
      '{letter}' || {own} || '#' || concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CAST(l_quantity AS INT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS source_id,
      (((l_partkey * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT)) * 16
        + CAST(round(l_tax * 100) AS BIGINT)) * 1000000 + {other} AS decision_order,
      p_brand AS source_requirement, CASE WHEN k % 6 = 0 THEN '' ELSE 'Parent ' || {own} END AS source_parent_requirement,
      CASE WHEN k % 10 = 0 THEN '' ELSE p_type END AS source_category, cov AS coverage_level,
      l_quantity / 50.0 AS confidence, CASE WHEN l_linestatus = 'F' THEN 'High' ELSE 'Low' END AS mapping_risk,
      CASE l_returnflag WHEN 'A' THEN 'partial_gap' WHEN 'N' THEN 'implementation_detail_gap' ELSE 'true_gap' END AS gap_type,
      CASE WHEN k % 5 = 0 THEN 'not_covered' WHEN k % 31 = 0 THEN 'conflict' ELSE 'partial' END AS relation_type,
      CASE WHEN k % 4 = 0 THEN 'Composite' ELSE 'Direct' END AS match_type,
      cov > 0 AND k % 9 <> 0 AS has_target, '{tletter}' || {other} AS target_parent_id,
      CASE WHEN k % 3 = 0 THEN {X.pick('k', DIMS)} END AS item_dimension,
      CASE WHEN k % 3 = 0 THEN 'Missing ' || p_brand END AS item_gap,
      CASE WHEN k % 3 = 0 THEN {X.pick('k', SEVERITIES)} END AS item_severity,
      CASE WHEN k % 2 = 0 THEN 'Gap on ' || p_brand ELSE '' END AS gap,
      CASE WHEN k % 7 = 0 THEN 'Adds ' || p_brand ELSE '' END AS b_contribution,
      CASE WHEN k % 12 = 0 THEN (cov + 30) % 101 END AS pre_review_coverage,
      CASE WHEN k % 14 = 0 THEN false WHEN k % 3 = 0 THEN true END AS same_functional_domain,
      k, {other} AS other_key, l_tax AS tax
      FROM (SELECT *, l_partkey * 7 + l_suppkey * 3 + l_linenumber AS k, CAST(round(l_discount * 1000) AS INT) AS cov
            FROM lineitem JOIN part ON l_partkey = p_partkey)"""


DECISIONS = sql_decisions()
DECISIONS_REVERSED = sql_decisions(True)


# ---- run log and usage (events) -----------------------------------------------------------------
LOG_STEPS = {"error": "run.start", "click": "candidate_generation", "view": "final_judge.category_batch"}


def any_of(conds):
    return reduce(lambda a, b: a | b, conds)
