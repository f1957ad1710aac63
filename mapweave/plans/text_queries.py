"""Registered queries for sources (S), text functions (T) and preparation (P), with their expected SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.functions import labels as L
from mapweave.functions import text as TX
from mapweave.functions import values as V
from mapweave.functions import vectors as VE
from mapweave.operators import prepare as P
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


def docs(spark, d):
    return table(spark, d, "documents")


# ---- sources ------------------------------------------------------------------------------------
CMAP = R.ColumnMap(requirement="Requirement text", id="Req ID", title="Title", category="Category",
                   important="Important", position="pos")
SCANNED = f"""SELECT 'F' AS framework, CASE WHEN raw_id = '' THEN 'row_' || (pos + 2) ELSE raw_id END AS source_id,
  title, requirement, category, important, pos FROM ({FX.RAW_REQUIREMENTS}) WHERE requirement <> ''"""


def scanned(spark, d):
    return R.scan_requirements(FX.raw_requirements(spark, d), CMAP, "F")


@query("S1_requirement_scan", f"""SELECT source_id, title, md5(requirement) AS requirement_md5, category,
  {X.fold('category')} AS category_key, pos + 2 AS row_number FROM ({SCANNED})""")
def _(spark, d):
    return scanned(spark, d).select("source_id", "title", F.md5("requirement").alias("requirement_md5"), "category",
                                    "category_key", "row_number")


@query("S2_duplicate_ids", f"""SELECT pos, CASE WHEN row_number() OVER (PARTITION BY source_id ORDER BY pos) > 1
  THEN source_id || '__row_' || (pos + 2) ELSE source_id END AS source_id FROM ({SCANNED})""")
def _(spark, d):
    return R.disambiguate_ids(scanned(spark, d)).select("pos", "source_id")


@query("S2_duplicate_report", f"SELECT source_id, count(*) AS n_rows FROM ({SCANNED}) GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return R.duplicate_ids(scanned(spark, d)).select("source_id", "n_rows")


@query("S3_column_resolver")
def _(spark, d):
    df = docs(spark, d).select(F.col("doc_id").alias("i.D."), F.col("source").alias("TITLE"),
                               F.col("text").alias("Require-ment"), F.col("lang").alias("category"))
    mapping, missing = R.resolve_columns(df.columns)
    assert not missing
    return df.select(*[F.col(f"`{mapping[r]}`").alias(r) for r in R.REQUIRED]).select(
        "ID", "Title", F.length("Requirement").alias("n_chars"), "Category")


S["S3_column_resolver"] = ('SELECT doc_id AS "ID", source AS "Title", length(text)::INT AS n_chars, lang AS "Category" '
                           'FROM documents')


@query("S4_column_check", f"SELECT count(*) AS n_rows FROM ({SCANNED})")
def _(spark, d):
    raw = FX.raw_requirements(spark, d)
    try:
        R.check_columns(raw, R.ColumnMap(requirement="Requirement", position="pos"))
        raise AssertionError("a missing column must be reported")
    except ValueError:
        pass
    R.check_columns(raw, CMAP)
    return scanned(spark, d).agg(F.count(F.lit(1)).alias("n_rows"))


@query("S5_boolean_cells", f"SELECT pos, important FROM ({SCANNED})")
def _(spark, d):
    return scanned(spark, d).select("pos", "important")


@query("S6_row_cap", f"""SELECT source_id FROM ({SCANNED}) WHERE pos IN (SELECT doc_id FROM documents ORDER BY doc_id
  LIMIT 60)""")
def _(spark, d):
    return R.scan_requirements(FX.raw_requirements(spark, d), CMAP, "F", max_rows=60).select("source_id")


@query("S7_collapsed_ids", """SELECT id, count(*) AS n_rows FROM (SELECT CAST(CAST(p_size AS DECIMAL(10,1)) AS VARCHAR)
  AS id FROM part) GROUP BY 1 HAVING count(*) > 1""")
def _(spark, d):
    return R.collapsed_ids(table(spark, d, "part").select(F.col("p_size").cast("double").alias("id")), "id")


_FAM = """SELECT doc_id AS pos, lang || '.' || (doc_id % 10) AS id, lang AS family FROM documents"""


@query("S8_renumber_ids", f"""SELECT pos, family || '.' || row_number() OVER (PARTITION BY family ORDER BY pos) AS new_id
  FROM ({_FAM})""")
def _(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("pos"),
                                 F.concat_ws(".", "lang", (F.col("doc_id") % 10).cast("string")).alias("id"))
    expected = docs(spark, d).groupBy(F.col("lang").alias("family")).agg(F.count(F.lit(1)).alias("n_expected"))
    return R.renumber_ids(rows, "id", "pos", expected).select("pos", "new_id")


@query("S11_json_lines", """SELECT event_id, event_type AS step, value AS score FROM events WHERE event_id % 9 <> 0
  AND event_id % 7 <> 0""")
def _(spark, d):
    e = table(spark, d, "events")
    line = F.to_json(F.struct("event_id", F.col("event_type").alias("step"), F.col("value").alias("score")))
    lines = e.select(F.when(F.col("event_id") % 9 == 0, "  ").when(F.col("event_id") % 7 == 0, F.concat(
        F.lit("{broken "), line)).otherwise(line).alias("line"))
    return R.parse_json_lines(lines, "line", "event_id bigint, step string, score double")


@query("S11_keyed_cache", """SELECT user_id AS key, max_by(event_type, event_id) AS step, max_by(value, event_id) AS score
  FROM events GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("step"),
                                         F.col("value").alias("score"), F.col("event_id").alias("line_no"))
    return R.last_per_key(e, "key", "line_no").drop("line_no")


@query("S12_guideline_files", """SELECT doc_id, length(text)::INT AS n_chars FROM documents WHERE doc_id % 3 <> 2""")
def _(spark, d):
    df = docs(spark, d).select("doc_id", "text", F.concat("source", pick(F.col("doc_id"), [".txt", ".MD", ".pdf"]))
                               .alias("name"))
    return R.guideline_texts(df, "name").select("doc_id", F.length("text").alias("n_chars"))


@query("S13_affinity_overlay", """WITH d AS (SELECT upper(lang) AS key, list_sort(list(DISTINCT upper(source))) AS f
    FROM documents WHERE lang <> 'de' GROUP BY 1),
  o AS (SELECT upper(lang) AS key, list_sort(list(DISTINCT 'X' || (doc_id % 5))) AS f FROM documents
    WHERE lang IN ('de', 'fr') GROUP BY 1)
  SELECT key, array_to_string(coalesce(o.f, d.f), ',') AS families FROM d FULL OUTER JOIN o USING (key)""")
def _(spark, d):
    base = docs(spark, d).filter("lang <> 'de'").groupBy(F.col("lang").alias("key")).agg(
        F.array_sort(F.collect_set("source")).alias("families"))
    over = docs(spark, d).filter("lang IN ('de', 'fr')").groupBy(F.col("lang").alias("key")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("x"), (F.col("doc_id") % 5).cast("string")))).alias("families"))
    return R.overlay_affinity(base, over).select("key", F.array_join("families", ",").alias("families"))


@query("S14_price_overlay", """WITH d AS (SELECT event_type AS model, round(min(value), 2) AS i, round(max(value), 2) AS o
    FROM events WHERE event_type <> 'view' GROUP BY 1),
  o AS (SELECT event_type AS model, CAST(NULL AS DOUBLE) AS i, 7.5::DOUBLE AS o FROM events
    WHERE event_type IN ('view', 'click') GROUP BY 1)
  SELECT model, coalesce(o.i, d.i, 0.0) AS input, coalesce(o.o, d.o, 0.0) AS output
  FROM d FULL OUTER JOIN o USING (model)""")
def _(spark, d):
    e = table(spark, d, "events")
    base = e.filter("event_type <> 'view'").groupBy(F.col("event_type").alias("model")).agg(
        F.round(F.min("value"), 2).alias("input"), F.round(F.max("value"), 2).alias("output"))
    over = e.filter("event_type IN ('view', 'click')").groupBy(F.col("event_type").alias("model")).agg(
        F.lit(None).cast("double").alias("input"), F.lit(7.5).alias("output"))
    return R.overlay_prices(base, over)


@query("S15_atom_snapshot", f"""SELECT atomic_id, parent_id, category, pos % 2 = 0 AS important,
    CASE WHEN pos % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS category_confidence FROM ({FX.DOC_ATOMS})""")
def _(spark, d):
    a = P.atomize(FX.requirements(spark, d), FX.SEPS)
    even = F.col("pos") % 2 == 0
    line = F.to_json(F.struct("atomic_id", "parent_id", "category", F.lit("dropped").alias("unknown"),
                              F.when(even, True).alias("important"), F.when(even, 0.5).alias("category_confidence")))
    return R.atoms_from_snapshot(a.select(line.alias("line")), "line").select(
        "atomic_id", "parent_id", "category", "important", "category_confidence")


# ---- text functions -----------------------------------------------------------------------------
@query("T1_normalize_text", f"SELECT doc_id, md5({X.norm('text')}) AS h, length({X.norm('text')})::INT AS n FROM documents")
def _(spark, d):
    t = TX.collapse(F.col("text"))
    return docs(spark, d).select("doc_id", F.md5(t).alias("h"), F.length(t).alias("n"))


@query("T2_normalize_category", f"""SELECT doc_id, md5({X.fold(X.norm('text'))}) AS folded, md5({X.fold('text')}) AS raw,
  md5({X.norm('text')}) AS cased FROM documents""")
def _(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", F.md5(TX.category_norm(c)).alias("folded"),
                                 F.md5(TX.category_norm(c, trim_spaces=False)).alias("raw"),
                                 F.md5(TX.category_norm(c, case_sensitive=True)).alias("cased"))


@query("T3_tokenize", f"""SELECT doc_id, md5(array_to_string(tk, ' ')) AS h, len(tk)::INT AS n
  FROM (SELECT doc_id, {X.toks('text')} AS tk FROM documents)""")
def _(spark, d):
    df = docs(spark, d).select("doc_id", TX.tokens(F.col("text")).alias("tk"))
    return df.select("doc_id", F.md5(F.array_join("tk", " ")).alias("h"), F.size("tk").alias("n"))


@query("T4_gap_tokenize", f"""SELECT doc_id, md5(array_to_string(tk, ' ')) AS h, len(tk)::INT AS n
  FROM (SELECT doc_id, {X.gap_toks('text')} AS tk FROM documents)""")
def _(spark, d):
    df = docs(spark, d).select("doc_id", TX.gap_tokens(F.col("text")).alias("tk"))
    return df.select("doc_id", F.md5(F.array_join("tk", " ")).alias("h"), F.size("tk").alias("n"))


@query("T5_keys", f"""SELECT doc_id, md5({X.cat_key('text')}) AS category_key,
  md5(regexp_replace({X.fold('text')}, '[^a-z0-9]+', '', 'g')) AS column_key FROM documents""")
def _(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", F.md5(TX.category_key(c)).alias("category_key"),
                                 F.md5(TX.column_key(c)).alias("column_key"))


@query("T6_family_of", """SELECT doc_id, upper(replace(trim(split_part(text, '.', 1)), 'ß', 'ss')) AS family FROM documents""")
def _(spark, d):
    return docs(spark, d).select("doc_id", TX.family_of(F.col("text")).alias("family"))


_IDS = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '__row_' || doc_id || '#' || lang || '#2'
  WHEN 1 THEN source || '__atom' || doc_id WHEN 2 THEN source || '__row_1__row_2' ELSE lang || '#' || doc_id END AS id
  FROM documents"""


@query("T7_display_and_parent_ids", f"""SELECT doc_id, regexp_replace(id, '__row_\\d+', '', 'g') AS display,
  CASE WHEN contains(id, '#') THEN regexp_extract(id, '^(.*)#[^#]*$', 1) ELSE id END AS parent,
  CASE WHEN contains(id, '#') THEN split_part(id, '#', 1) ELSE split_part(id, '__atom', 1) END AS parent_any
  FROM ({_IDS})""")
def _(spark, d):
    n = F.col("doc_id").cast("string")
    m = F.col("doc_id") % 4
    i = (F.when(m == 0, F.concat("source", F.lit("__row_"), n, F.lit("#"), "lang", F.lit("#2")))
         .when(m == 1, F.concat("source", F.lit("__atom"), n))
         .when(m == 2, F.concat("source", F.lit("__row_1__row_2"))).otherwise(F.concat("lang", F.lit("#"), n)))
    return docs(spark, d).select("doc_id", TX.display_id(i).alias("display"), TX.parent_id(i).alias("parent"),
                                 TX.parent_id_any(i).alias("parent_any"))


@query("T8_control_id", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ''
  ELSE upper(lang) || '.AM-' || (doc_id % 30) || '.' || (doc_id % 7) END AS id FROM documents""")
def _(spark, d):
    k = F.col("doc_id")
    cell = F.when(k % 5 == 0, F.col("text")).otherwise(F.concat(
        F.lit("see "), F.upper("lang"), F.lit(".AM-"), (k % 30).cast("string"),
        F.when(k % 2 == 0, "-").otherwise("."), (k % 7).cast("string"), F.lit(": text")))
    return docs(spark, d).select("doc_id", TX.canonical_control_id(cell).alias("id"))


@query("T9_clean_sentence", f"""SELECT conv_id, turn, md5({X.clean('text')}) AS plain,
  md5({X.clean_gap("'AB.1/x#2 (so) -> y: Gap : ' || text")}) AS gap FROM conversations""")
def _(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.md5(TX.clean_sentence(F.col("text"))).alias("plain"),
        F.md5(TX.clean_gap_sentence(F.concat(F.lit("AB.1/x#2 (so) -> y: Gap : "), "text"))).alias("gap"))


@query("T10_truncate", """SELECT doc_id, CASE WHEN length(text) > 240 THEN regexp_replace(substr(text, 1, 239),
  '\\s+$', '') || '…' ELSE text END AS short FROM documents""")
def _(spark, d):
    return docs(spark, d).select("doc_id", TX.truncate(F.col("text"), 240).alias("short"))


FLOATS = ["0.7", " Medium ", "very high confidence", "", "n/a", " 12 ", "VERY LOW", "rather low", "moderate"]
FLOAT_RESULTS = [0.7, 0.6, 0.95, 0.25, 0.25, 12.0, 0.2, 0.35, 0.6]


@query("T11_tolerant_float", f"""SELECT event_id, ({X.pick('event_id', FLOAT_RESULTS)})::DOUBLE AS x FROM events""")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", V.tolerant_float(pick(F.col("event_id"), FLOATS), 0.25).alias("x"))


INTS = ["42", " 7 ", "2.5", "3.5", "x", "", "-1.4"]
INT_RESULTS = [42, 7, 2, 4, 9, 9, -1]


@query("T12_tolerant_int", f"""SELECT event_id, ({X.pick('event_id', INT_RESULTS)})::INT AS n, trunc(value)::INT AS v
  FROM events""")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", V.tolerant_int(pick(F.col("event_id"), INTS), 9).alias("n"),
        V.number_to_int(F.col("value")).alias("v"))


@query("T13_content_hash", """SELECT copies, count(*) AS n_contents FROM (SELECT count(*) AS copies FROM documents
  GROUP BY text, lang) GROUP BY 1""")
def _(spark, d):
    h = docs(spark, d).select(V.content_hash(F.col("lang"), F.col("text")).alias("h"))
    return h.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(
        F.count(F.lit(1)).alias("n_contents"))


def sql_hash_vectors(src: str, key: str, text: str, dims: int = 128) -> str:
    """Sparse hashed vectors (key, idx from 0, val) of a source query."""
    h = "('0x' || substr(sha256('\"' || t || '\"'), 1, 16))::UBIGINT::HUGEINT"
    return f"""SELECT {key}, idx, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS val FROM (
      SELECT {key}, idx, sum(sgn)::DOUBLE AS v FROM (
        SELECT {key}, (h % {dims})::INT AS idx, CASE WHEN (h // {dims}) % 2 = 0 THEN 1 ELSE -1 END AS sgn
        FROM (SELECT {key}, {h} AS h FROM (SELECT {key}, unnest({X.toks(text)}) AS t FROM ({src})))) GROUP BY 1, 2)
      WHERE v <> 0"""


@query("T14_hash_embedding", f"""SELECT doc_id, count(*) AS nnz, round(sum(val), 6) AS s,
  round(sum(val * (idx + 1)), 6) AS w FROM ({sql_hash_vectors('SELECT doc_id, text FROM documents', 'doc_id', 'text')})
  GROUP BY 1""")
def _(spark, d):
    v = docs(spark, d).select("doc_id", F.posexplode(VE.hash_embedding(F.col("text"))).alias("idx", "val"))
    return v.filter("val <> 0").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("nnz"), F.round(F.sum("val"), 6).alias("s"),
        F.round(F.sum(F.col("val") * (F.col("idx") + 1)), 6).alias("w"))


@query("T14_hash_embedding_any_dims", f"""SELECT item_id, count(*) AS nnz, round(sum(val * (idx + 1)), 6) AS w FROM (
  {sql_hash_vectors('SELECT item_id, text FROM benchmark', 'item_id', 'text', 100)}) GROUP BY 1""")
def _(spark, d):
    v = table(spark, d, "benchmark").select(
        "item_id", F.posexplode(VE.hash_embedding(F.col("text"), 100)).alias("idx", "val"))
    return v.filter("val <> 0").groupBy("item_id").agg(
        F.count(F.lit(1)).alias("nnz"), F.round(F.sum(F.col("val") * (F.col("idx") + 1)), 6).alias("w"))


@query("T15_split_list", """SELECT doc_id, len(p)::INT AS n, md5(array_to_string(p, '|')) AS h FROM (SELECT doc_id,
  list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)""")
def _(spark, d):
    p = TX.split_list(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("h"))


BOOLS = [" True ", "same_domain", "No", "DIFFERENT", "perhaps", ""]


@query("T16_tri_state", f"""SELECT event_id, {X.pick('event_id', [True, True, False, False, None, None])} AS b FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", V.tri_bool(pick(F.col("event_id"), BOOLS)).alias("b"))


@query("T17_gap_items", """SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'explicitness' ELSE role END AS dimension,
  md5(trim(text, ' ')) AS gap, CASE WHEN turn % 2 = 0 THEN 'major' ELSE 'moderate' END AS severity
  FROM conversations WHERE turn % 7 <> 6 AND trim(text, ' ') <> ''""")
def _(spark, d):
    t = F.col("turn")
    item = F.struct(F.when(t % 3 != 1, F.col("role")).alias("dimension"),
                    F.when(t % 5 == 0, F.col("text")).alias("gap"),
                    F.when(t % 5 != 0, F.col("text")).alias("missing_element"),
                    F.when(t % 2 == 0, "major").alias("severity"))
    json = F.when(t % 7 == 6, F.lit("{oops")).when(t % 4 == 0, F.to_json(item)).otherwise(
        F.to_json(F.array(item, F.struct(*[F.lit(None).cast("string").alias(n) for n in
                                           ("dimension", "gap", "missing_element", "severity")]))))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.explode(V.gap_items(json)).alias("g"))
    return c.select("conv_id", "turn", "g.dimension", F.md5("g.gap").alias("gap"), "g.severity")


_VARIANTS = ["Partial", "no-match", "Implementation gap", "supportive", "CONFLICT", "None", "", "weird", "exact match",
             "full", "composite", "not covered", "Mostly covered", "gap", "indirect"]


def li(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 1000).cast("int").alias("cov"),
        (F.col("l_partkey") + F.col("l_linenumber")).alias("a"), (F.col("l_suppkey") * 3 + F.col("l_linenumber")).alias("b"),
        F.col("l_quantity").alias("q"), "l_extendedprice")


LI = """SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 1000) AS INT) AS cov, l_partkey + l_linenumber AS a,
  l_suppkey * 3 + l_linenumber AS b, l_quantity AS q, l_extendedprice FROM lineitem"""
_LI_A, _LI_B = X.pick("a", _VARIANTS), X.pick("b", _VARIANTS)
_GAP_BAND = ("CASE WHEN cov >= 100 THEN 'none' WHEN cov >= 40 THEN 'partial_gap' WHEN cov >= 10 THEN "
             "'indirect_support_gap' ELSE 'true_gap' END")
_REL_BAND = ("CASE WHEN cov >= 100 THEN 'direct_full_coverage' WHEN cov >= 80 THEN 'mostly_covered' WHEN cov >= 40 THEN "
             "'partial' WHEN cov >= 10 THEN 'indirect_support' ELSE 'true_gap' END")


def sql_gap_type(value: str, cov: str, rel: str) -> str:
    return (f"coalesce({X.lookup(X.label_key(value), L.GAP_ALIASES)}, {X.lookup(X.label_key(rel), L.GAP_ALIASES)}, "
            f"{_GAP_BAND.replace('cov', cov)})")


def sql_relation_type(value: str, cov: str, gap: str) -> str:
    return (f"CASE WHEN {gap} = 'implementation_detail_gap' AND {cov} > 0 THEN 'implementation_detail_gap' "
            f"WHEN {gap} = 'partial_gap' AND {cov} >= 40 THEN 'partial' "
            f"ELSE coalesce({X.lookup(X.label_key(value), L.RELATION_ALIASES)}, {_REL_BAND.replace('cov', cov)}) END")


@query("T18_gap_type", f"""SELECT gt, count(*) AS n, sum(cov)::BIGINT AS s FROM (SELECT cov,
  {sql_gap_type(_LI_A, 'cov', _LI_B)} AS gt FROM ({LI})) GROUP BY 1""")
def _(spark, d):
    df = li(spark, d)
    return df.select("cov", L.gap_type(pick(F.col("a"), _VARIANTS), F.col("cov"), pick(F.col("b"), _VARIANTS))
                     .alias("gt")).groupBy("gt").agg(F.count(F.lit(1)).alias("n"), F.sum("cov").alias("s"))


@query("T19_relation_type", f"""SELECT rt, count(*) AS n, sum(cov)::BIGINT AS s FROM (SELECT cov,
  {sql_relation_type(_LI_A, 'cov', 'g')} AS rt FROM (SELECT *, {X.pick('b', FX.GAP_TYPES)} AS g FROM ({LI}))) GROUP BY 1""")
def _(spark, d):
    rt = L.relation_type(pick(F.col("a"), _VARIANTS), F.col("cov"), pick(F.col("b"), FX.GAP_TYPES))
    return li(spark, d).select("cov", rt.alias("rt")).groupBy("rt").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cov").alias("s"))


_DIMS = [" Role ", "procedure", "Timing", "proof", "clarity", "granularity", "scope", "control_type", "", "Implementation",
         "responsibilities", "unknown"]


def sql_dimension(x: str, allowed, aliases) -> str:
    key = X.fold(f"trim({x})")
    return X.lookup(key, aliases, f"CASE WHEN {key} IN {X.values(allowed)} THEN {key} ELSE 'explicitness' END")


@query("T20_dimensions", f"""SELECT report, synthesis, count(*) AS n FROM (SELECT
  {sql_dimension(X.pick('a', _DIMS), L.DIMENSIONS, L.DIMENSION_ALIASES)} AS report,
  {sql_dimension(X.pick('a', _DIMS), L.SYNTHESIS_DIMENSIONS, L.SYNTHESIS_DIMENSION_ALIASES)} AS synthesis
  FROM ({LI})) GROUP BY 1, 2""")
def _(spark, d):
    x = pick(F.col("a"), _DIMS)
    return li(spark, d).select(L.dimension(x).alias("report"), L.synthesis_dimension(x).alias("synthesis")).groupBy(
        "report", "synthesis").agg(F.count(F.lit(1)).alias("n"))


_SEVS = ["Critical", " high ", "major", "low", "Minor", "residual", "", "moderate", "x"]


@query("T21_severity", f"""SELECT report, synthesis, rank, from_coverage, count(*) AS n FROM (SELECT
  {X.pick('a', ['material'] * 3 + ['minor'] * 3 + ['moderate'] * 3)} AS report,
  {X.pick('a', ['material'] * 3 + ['minor'] * 2 + ['moderate'] * 4)} AS synthesis,
  ({X.pick('a', [0] * 3 + [2] * 3 + [1] * 3)})::INT AS rank,
  CASE WHEN cov <= 25 THEN 'material' WHEN cov <= 50 THEN 'moderate' ELSE 'minor' END AS from_coverage
  FROM ({LI})) GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    x = pick(F.col("a"), _SEVS)
    return li(spark, d).select(
        L.severity(x).alias("report"), L.synthesis_severity(x).alias("synthesis"), L.severity_rank(x).alias("rank"),
        L.severity_from_coverage(F.col("cov")).alias("from_coverage")).groupBy(
            "report", "synthesis", "rank", "from_coverage").agg(F.count(F.lit(1)).alias("n"))


@query("T22_infer_dimension", f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN
  {sql_dimension('role', L.DIMENSIONS, L.DIMENSION_ALIASES)}
  ELSE {X.first_rule(X.fold('text'), L.DIMENSION_WORDS, 'explicitness')} END AS dim FROM conversations""")
def _(spark, d):
    preferred = F.when(F.col("turn") % 3 == 0, F.array("role")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", L.infer_dimension(F.col("text"), preferred).alias("dim"))


_POINTS = (f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({X.norm('text')}, ' *[•▪] *', chr(1), "
           f"'g'), '([.;]) ', '\\1' || chr(1), 'g'), chr(1)), lambda p: {X.clean_gap('p')}), "
           f"lambda p: p <> '' AND NOT {X.generic('p')})")


@query("T23_gap_points", f"""SELECT conv_id, turn, len(p)::INT AS n, md5(array_to_string(p, '|')) AS h FROM (
  SELECT conv_id, turn, {_POINTS} AS p FROM conversations)""")
def _(spark, d):
    note = F.lit("Coverage capped by object/action gate at 30: low alignment. ")
    df = table(spark, d, "conversations").select("conv_id", "turn", TX.gap_points(F.concat(note, "text")).alias("p"))
    return df.select("conv_id", "turn", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("h"))


@query("T24_synthesis_and_detail", r"""SELECT conv_id, turn, md5(array_to_string(list_filter(CASE WHEN b > 0 THEN
    l[1:b-1] ELSE l END, lambda x: x <> ''), ' ')) AS synthesis,
  md5(array_to_string(list_filter(l, lambda x: starts_with(x, '•')), chr(10))) AS detail FROM (
  SELECT *, list_position(list_transform(l, lambda x: starts_with(x, '•')), true) AS b FROM (
  SELECT conv_id, turn, list_transform(string_split(replace(text, '.' || chr(10) || 'É', chr(10) || '• É'), chr(10)),
    lambda x: trim(x)) AS l FROM conversations))""")
def _(spark, d):
    t = F.replace(F.col("text"), F.lit(".\nÉ"), F.lit("\n• É"))
    r = table(spark, d, "conversations").select("conv_id", "turn", TX.gap_synthesis_and_detail(t).alias("g"))
    return r.select("conv_id", "turn", F.md5("g.synthesis").alias("synthesis"), F.md5("g.detail").alias("detail"))


@query("T25_bucket", f"""SELECT cov4, {X.bucket('cov4')} AS bucket, count(*) AS n FROM (SELECT cov / 4.0 + q AS cov4
  FROM ({LI})) GROUP BY 1, 2""")
def _(spark, d):
    x = F.col("cov") / F.lit(4.0) + F.col("q")
    return li(spark, d).select(x.alias("cov4"), L.bucket(x).alias("bucket")).groupBy("cov4", "bucket").agg(
        F.count(F.lit(1)).alias("n"))


@query("T26_score_level", """SELECT level, count(*) AS n, min(v) AS lo, max(v) AS hi FROM (SELECT v,
  least(greatest(ceil((trunc(v) - 5) / 10.0) * 10, 0), 100)::INT AS level FROM (SELECT q * 2.5 - 10 AS v FROM (SELECT
  l_quantity AS q FROM lineitem))) GROUP BY 1""")
def _(spark, d):
    v = F.col("q") * 2.5 - 10
    return li(spark, d).select(v.alias("v"), L.score_level(v).alias("level")).groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("T27_labels", f"""SELECT label, status, category, count(*) AS n FROM (SELECT
  CASE {X.bucket('cov')} WHEN 100 THEN 'Fully covered' WHEN 75 THEN 'Largely covered' WHEN 50 THEN 'Partially covered'
    WHEN 25 THEN 'Indirectly covered' ELSE 'Not covered' END AS label,
  CASE WHEN cov >= 70 THEN '✓ Good' WHEN cov >= 50 THEN '⚠ Fair' ELSE '✗ Poor' END AS status,
  rtrim(substr(trim('cat ' || (a % 3) || ' ' || repeat('x', 40)), 1, 40)) AS category FROM ({LI})) GROUP BY 1, 2, 3""")
def _(spark, d):
    raw = F.concat(F.lit(" 12. cat "), (F.col("a") % 3).cast("string"), F.lit(" "), F.repeat(F.lit("x"), 40))
    return li(spark, d).select(L.bucket_label(F.col("cov")).alias("label"), L.category_status(F.col("cov")).alias("status"),
                               L.short_category(raw).alias("category")).groupBy("label", "status", "category").agg(
        F.count(F.lit(1)).alias("n"))


_GOLD = ["Not covered", "Indirectly", " partiel ", "largement couvert", "Fully covered", "Couvert", "", "?", "EXACT",
         "covered " + "x" * 40]


@query("T28_gold_label", f"""SELECT event_id, ({X.pick('event_id', [0, 25, 50, 75, 100, 100, None, None, 100, None])})::INT
  AS bucket FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", L.gold_bucket(pick(F.col("event_id"), _GOLD)).alias("bucket"))


@query("T29_equivalence_and_risk", f"""SELECT eq, risk, count(*) AS n FROM (SELECT eq, CASE WHEN cov <= 20 OR eq = 'Gap'
  THEN 'High' WHEN cov < 80 OR a % 2 = 0 THEN 'Medium' WHEN cov < 100 THEN 'Low' ELSE 'None' END AS risk FROM (SELECT *,
  CASE WHEN cov >= 100 THEN 'Exact match' WHEN cov >= 40 THEN 'Partial' WHEN cov >= 10 THEN 'Indirect' ELSE 'Gap' END AS eq
  FROM ({LI}))) GROUP BY 1, 2""")
def _(spark, d):
    eq = L.equivalence(F.col("cov"))
    r = L.risk(F.col("cov"), eq, F.when(F.col("a") % 2 == 0, "Composite").otherwise("Direct"))
    return li(spark, d).select(eq.alias("eq"), r.alias("risk")).groupBy("eq", "risk").agg(F.count(F.lit(1)).alias("n"))


@query("T30_control_family", f"""SELECT doc_id, {X.first_rule(X.fold('text'), FX.FAMILIES, '')} AS fixture_family,
  {X.first_rule(X.fold('text'), L.CONTROL_FAMILIES, '')} AS default_family FROM documents""")
def _(spark, d):
    return docs(spark, d).select("doc_id", L.control_family(F.col("text"), FX.FAMILIES).alias("fixture_family"),
                                 L.control_family(F.col("text")).alias("default_family"))


_ACT = "trim({}, ' -•*;')".format(X.norm("x"))


@query("T31_clean_actions", f"""SELECT conv_id, turn, md5(array_to_string(list_transform(list_filter(list_transform(
  string_split(text, chr(10)), lambda x: {X.end_sentence(_ACT)}), lambda x: x <> '')[1:4], lambda x: '• ' || x), chr(10)))
  AS plan FROM conversations""")
def _(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.md5(TX.format_actions(F.split("text", "\n"), 4)).alias("plan"))


# ---- preparation --------------------------------------------------------------------------------
@query("P1_atomize", f"SELECT atomic_id, parent_id, atom_no::INT AS atom_no, md5(atomic_requirement) AS h FROM ({FX.DOC_ATOMS})")
def _(spark, d):
    return P.atomize(FX.requirements(spark, d), FX.SEPS).select("atomic_id", "parent_id", "atom_no",
                                                                F.md5("atomic_requirement").alias("h"))


_LINES = f"list_transform(string_split(requirement, chr(10)), lambda x: {X.norm('x')})"


@query("P2_atoms_from_lists", f"""WITH r AS ({FX.REQUIREMENTS}),
  listed AS (SELECT source_id, requirement, {_LINES} AS l FROM r WHERE pos % 4 IN (0, 1)),
  ruled AS (SELECT parent_id, atom_no, atomic_requirement FROM ({FX.DOC_ATOMS}) WHERE pos % 4 = 3)
  SELECT source_id AS parent_id, i::INT AS atom_no, md5(l[i]) AS h FROM listed, unnest(range(1, len(l) + 1)) AS u(i)
    WHERE l[i] <> ''
  UNION ALL SELECT source_id, 1, md5({X.norm('requirement')}) FROM listed WHERE len(list_filter(l, lambda x: x <> '')) = 0
  UNION ALL SELECT source_id, 1, md5({X.norm('requirement')}) FROM r WHERE pos % 4 = 2
  UNION ALL SELECT parent_id, atom_no::INT, md5(atomic_requirement) FROM ruled""")
def _(spark, d):
    r = FX.requirements(spark, d)
    lines = F.split("requirement", "\n")
    objects = F.transform(lines, lambda x: F.struct(x.alias("text")))
    json = (F.when(F.col("pos") % 4 == 0, F.to_json(objects)).when(F.col("pos") % 4 == 1, F.to_json(lines))
            .otherwise(F.lit("[]")))
    supplied = r.filter("pos % 4 <> 3").select("source_id", json.alias("atoms_json"))
    return P.atomize_from_lists(r, supplied, FX.SEPS).select(
        "parent_id", "atom_no", F.md5("atomic_requirement").alias("h"))


FEATURES = FX.sql_atom_features(FX.DOC_ATOMS)


@query("P3_rule_fields", f"""SELECT atomic_id, category AS domain, f_action AS action, f_object AS object,
  f_obligation AS obligation_type, array_to_string(keywords, ' ') AS keywords FROM ({FEATURES})""")
def _(spark, d):
    return FX.atoms(spark, d).select("atomic_id", "fields.domain", "fields.action", "fields.object",
                                     "fields.obligation_type", F.array_join("keywords", " ").alias("keywords"))


@query("P4_supplied_fields", f"""SELECT atomic_id, CASE WHEN atom_no % 2 = 0 THEN 'given' ELSE f_action END AS action,
  CASE WHEN atom_no % 2 = 0 THEN '' ELSE f_object END AS object,
  CASE WHEN atom_no % 2 = 1 THEN array_to_string(keywords, ' ') WHEN atom_no % 4 = 0 THEN 'key one two'
    ELSE array_to_string(tk, ' ') END AS keywords FROM ({FEATURES})""")
def _(spark, d):
    a = P.atomize(FX.requirements(spark, d), FX.SEPS)
    kw = F.when(F.col("atom_no") % 4 == 0, F.array(F.lit(" Key  ONE"), F.lit(" "), F.lit("two"))).otherwise(
        F.array().cast("array<string>"))
    s = a.filter("atom_no % 2 = 0").select("atomic_id", F.to_json(F.struct(
        F.lit("given").alias("action"), F.lit(None).cast("string").alias("object"), kw.alias("keywords"))).alias("fields_json"))
    return P.merge_supplied_fields(a, s).select("atomic_id", "fields.action", "fields.object",
                                                F.array_join("keywords", " ").alias("keywords"))


SQL_MATCHING_TEXT = ("concat_ws(' ', category, '', atomic_requirement, category, '', f_action, f_object, '', '', '', "
                     "f_control, array_to_string(CASE WHEN len(keywords) > 0 THEN keywords ELSE tk END, ' '))")


@query("P5_matching_text", f"SELECT atomic_id, md5({SQL_MATCHING_TEXT}) AS h FROM ({FEATURES})")
def _(spark, d):
    return P.add_matching_text(FX.atoms(spark, d)).select("atomic_id", F.md5("matching_text").alias("h"))


_TR = """SELECT *, CASE pos % 5 WHEN 0 THEN 'English ' || pos WHEN 1 THEN '' WHEN 2 THEN requirement END AS en,
  pos % 5 < 3 AS known FROM (SELECT * REPLACE ({n} AS requirement) FROM ({r}))""".format(
    n=X.norm("requirement"), r=FX.REQUIREMENTS)


def _translated(spark, d):
    r = FX.requirements(spark, d).withColumn("requirement", TX.collapse(F.col("requirement")))
    en = (F.when(F.col("pos") % 5 == 0, F.concat(F.lit(" English  "), F.col("pos").cast("string")))
          .when(F.col("pos") % 5 == 1, " ").otherwise(F.col("requirement")))
    t = r.filter("pos % 5 < 3").select("source_id", F.upper("category").alias("source_language"), en.alias("requirement_en"),
                                       F.when(F.col("pos") % 2 == 0, "T").otherwise("").alias("title_en"))
    return P.translate(r, t)


@query("P6_translation", f"""SELECT source_id, md5(CASE WHEN pos % 5 = 0 THEN en ELSE requirement END) AS h,
  CASE WHEN pos % 5 = 0 AND pos % 2 = 0 THEN 'T' ELSE title END AS title,
  CASE WHEN known THEN category ELSE '' END AS source_language,
  CASE WHEN pos % 5 = 0 THEN 'translated' WHEN known THEN 'unchanged' ELSE 'no_translation' END AS status,
  CASE WHEN pos % 5 = 0 THEN md5(requirement) ELSE md5('') END AS original FROM ({_TR})""")
def _(spark, d):
    return _translated(spark, d).select(
        "source_id", F.md5("requirement").alias("h"), "title", "source_language",
        F.col("translation_status").alias("status"), F.md5("original_requirement").alias("original"))


@query("P6_translation_counts", f"""SELECT CASE WHEN known THEN category ELSE '' END AS source_language, count(*) AS n_rows,
  count(*) FILTER (pos % 5 = 0) AS translated, count(*) FILTER (known AND pos % 5 <> 0) AS already_english
  FROM ({_TR}) GROUP BY 1""")
def _(spark, d):
    return P.translation_counts(_translated(spark, d))


@query("P7_embedding_repair", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN nnz ELSE 1 END AS nnz,
  CASE WHEN doc_id % 3 = 0 THEN w ELSE 1.0 END AS w FROM (SELECT d.doc_id, coalesce(nnz, 0) AS nnz, coalesce(w, 0) AS w
  FROM documents d LEFT JOIN ({S['T14_hash_embedding']}) t USING (doc_id))""")
def _(spark, d):
    vec = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<double>")).when(
        F.col("doc_id") % 3 != 0, F.array(F.lit(1.0)))
    a = docs(spark, d).select("doc_id", F.col("text").alias("matching_text"), vec.alias("embedding"))
    r = P.repair_embeddings(a)
    return r.select("doc_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nnz"), F.round(
        VE.dot(F.col("embedding"), F.transform(F.sequence(F.lit(1), F.greatest(F.size("embedding"), F.lit(1))),
                                               lambda i: i.cast("double"))), 6).alias("w"))


@query("P8_chunk", f"""SELECT doc_id, (s / 320)::INT AS window_no, md5(c) AS h FROM (SELECT doc_id, s,
  array_to_string(w[s + 1:s + 400], ' ') AS c FROM (SELECT doc_id, string_split({X.norm('text')}, ' ') AS w FROM documents),
  unnest(range(0, len(w), 320)) AS u(s)) WHERE length(c) > 80""")
def _(spark, d):
    return P.chunk_texts(docs(spark, d).select("doc_id", "text"), "text").select(
        "doc_id", "window_no", F.md5("chunk").alias("h"))


@query("P9_flag_backfill", f"""SELECT atomic_id, coalesce(f.e, true) AS essential, coalesce(f.i, false) AS important,
  f.e IS NOT NULL AS patched FROM ({FX.DOC_ATOMS}) a LEFT JOIN (SELECT source_id AS parent_id, pos % 6 <> 0 AS e, important AS i
  FROM ({FX.REQUIREMENTS}) WHERE pos % 2 = 0) f USING (parent_id)""")
def _(spark, d):
    r = FX.requirements(spark, d)
    a = P.atomize(r, FX.SEPS).drop("essential", "important")
    flags = r.filter("pos % 2 = 0").select("source_id", (F.col("pos") % 6 != 0).alias("essential"), "important")
    return P.backfill_flags(a, flags).select("atomic_id", "essential", "important", "patched")


@query("P10_fingerprint", f"""SELECT framework, substr(sha256(concat_ws('|', a, b, n_atoms)), 1, 16) AS fingerprint, n_atoms,
  n_parents, n_ids FROM (SELECT framework, sum(('0x' || substr(h, 1, 15))::UBIGINT) AS a,
  sum(('0x' || substr(h, 16, 15))::UBIGINT) AS b, count(*) AS n_atoms, count(DISTINCT parent_id) AS n_parents,
  count(DISTINCT atomic_id) AS n_ids FROM (SELECT framework, parent_id, atomic_id, sha256(concat_ws(chr(31), atomic_id,
  parent_id, atomic_requirement, {X.norm('requirement')})) AS h FROM ({FX.DOC_ATOMS})) GROUP BY 1)""")
def _(spark, d):
    r = FX.requirements(spark, d).withColumn("requirement", TX.collapse(F.col("requirement")))
    return P.fingerprint(P.atomize(r, FX.SEPS, collapsed=True))


@query("P11_valid_requirements", "SELECT count(*) AS n_requirements FROM documents WHERE doc_id % 11 <> 0 AND trim(text) <> ''")
def _(spark, d):
    raw = FX.raw_requirements(spark, d).withColumn("Requirement text", F.replace("Requirement text", F.lit("\n"), F.lit("")))
    return P.valid_requirements(raw, "Requirement text")
