"""Registered queries for candidate search (J1-J15), with their expected SQL (every pair scored)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window, functions as F

from mapweave.functions.text import tokens
from mapweave.operators import keyword as KW
from mapweave.operators import retrieval as RT
from mapweave.operators import search as SE
from mapweave.operators import similarity as SI
from mapweave.operators.prepare import chunk_texts, embed
from mapweave.params import STRUCTURED_WEIGHTS, Params
from mapweave.plans import fixtures as FX
from mapweave.plans import sqltext as X
from mapweave.plans.fixtures import table
from mapweave.plans.text_queries import SQL_MATCHING_TEXT, sql_hash_vectors

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            S[name] = sql
        return fn
    return register


VECTOR_PARAMS = Params(affinity_enabled=False)
DOC_PARAMS = Params(affinity_enabled=False, families=tuple((n, tuple(w)) for n, w in FX.FAMILIES))
AFFINITY = [("FR", ["DE", "ES"]), ("EN", ["FR"])]


def vector_sides(spark, d):
    return tuple(SI.with_features(x, VECTOR_PARAMS) for x in FX.vectors(spark, d))


def doc_sides(spark, d, p=DOC_PARAMS):
    return (SI.with_features(FX.searchable(FX.source_atoms(spark, d)), p),
            SI.with_features(FX.searchable(FX.atoms(spark, d)), p))


# ---- expected SQL -------------------------------------------------------------------------------
VECTOR_PAIRS = """SELECT s.vec_id::VARCHAR AS source_id, t.vec_id::VARCHAR AS candidate_id, t.vec_id AS order_no,
  sem AS semantic, cat AS category_prior, round(least(1.0, 0.45 * sem + 0.03 * cat), 9) AS combined FROM (
  SELECT s, t, round(greatest(0.0, list_cosine_similarity(s.embedding::DOUBLE[], t.embedding::DOUBLE[])), 12) AS sem,
    CASE WHEN s.label = t.label THEN 0.9 ELSE 0.0 END AS cat
  FROM (SELECT * FROM embeddings WHERE vec_id % 2 = 0) s, (SELECT * FROM embeddings WHERE vec_id % 2 = 1) t)"""


def sql_features(atoms: str, name: str) -> str:
    """CTEs <name>0 (features) and <name> (with dense vector) of one side."""
    family = X.first_rule(X.fold("concat_ws(' ', f_action, f_object, f_control, atomic_requirement)"), FX.FAMILIES, "")
    return f"""{name}0 AS MATERIALIZED (SELECT *, {SQL_MATCHING_TEXT} AS mt FROM ({FX.sql_atom_features(atoms)})),
    {name}v AS (SELECT atomic_id, list_transform(range(0, 128), lambda i: coalesce(m[i::INT], 0.0)) AS vec FROM (
      SELECT atomic_id, map(list(idx), list(val)) AS m FROM ({sql_hash_vectors(f'SELECT atomic_id, mt FROM {name}0',
                                                                              'atomic_id', 'mt')}) GROUP BY 1)),
    {name} AS MATERIALIZED (SELECT atomic_id, parent_id, pos * 1000000 + atom_no AS order_no, atomic_requirement, category,
      coalesce(vec, list_transform(range(0, 128), lambda i: 0.0)) AS vec,
      [list_distinct({X.toks('category')}), list_distinct({X.toks('f_action')}), list_distinct({X.toks('f_object')}),
       list_distinct({X.toks('f_obligation')}), list_distinct({X.toks('f_control')})] AS sets,
      list_distinct({X.toks("concat_ws(' ', f_action, f_object, f_control)")}) AS ao, {family} AS fam,
      category AS pk, secondary AS sk, upper(split_part(parent_id, '.', 1)) AS idf,
      CASE WHEN confidence > 0 THEN confidence ELSE 0.5 END AS conf,
      contains(status, 'review') OR (CASE WHEN confidence > 0 THEN confidence ELSE 0.5 END) < 0.6 AS low
      FROM {name}0 LEFT JOIN {name}v USING (atomic_id))"""


_W = [STRUCTURED_WEIGHTS[n] for n in ("domain", "action", "object", "obligation_type", "control_type")]


def sql_signals(pairs: str) -> str:
    """Signals over a query with structs a and b of sql_features rows."""
    def inter(x, y):
        return f"len(list_intersect({x}, {y}))"

    fields = []
    for i, w in enumerate(_W, 1):
        x, y = f"a.sets[{i}]", f"b.sets[{i}]"
        fields.append(f"{inter(x, y)} AS i{i}, len({x}) + len({y}) - {inter(x, y)} AS u{i}")
    total = " + ".join(f"CASE WHEN u{i} > 0 THEN {w} * (i{i} / u{i}::DOUBLE) ELSE 0 END" for i, w in enumerate(_W, 1))
    weight = " + ".join(f"CASE WHEN u{i} > 0 THEN {w} ELSE 0 END" for i, w in enumerate(_W, 1))
    same, differ = "(a.fam <> '' AND a.fam = b.fam)", "(a.fam <> '' AND b.fam <> '' AND a.fam <> b.fam)"
    prior = """(CASE WHEN a.pk <> '' AND a.pk = b.pk THEN 1.0 WHEN (a.pk <> '' AND list_contains(b.sk, a.pk))
      OR (b.pk <> '' AND list_contains(a.sk, b.pk)) THEN 0.7 WHEN len(list_intersect(a.sk, b.sk)) > 0 THEN 0.45 ELSE 0 END
      * (CASE WHEN a.low OR b.low THEN least(greatest(0.15, least(a.conf, b.conf)), 0.30)
         ELSE greatest(0.15, least(a.conf, b.conf)) END))"""
    return f"""SELECT *, round(least(1.0, 0.45 * semantic + 0.0 + 0.30 * structured + 0.20 * action_object
        + 0.05 * control_type + 0.03 * category_prior), 9) AS combined FROM (
      SELECT a, b, round(greatest(0.0, list_inner_product(a.vec, b.vec)), 12) AS semantic,
        round(CASE WHEN {weight} > 0 THEN ({total}) / ({weight}) ELSE 0.0 END, 12) AS structured,
        round(CASE WHEN len(a.ao) = 0 OR len(b.ao) = 0 THEN CASE WHEN {same} THEN 0.2 ELSE 0.0 END
          ELSE least(1.0, greatest(0.0, iao / (len(a.ao) + len(b.ao) - iao)::DOUBLE + CASE WHEN {same} THEN 0.25
            WHEN {differ} THEN -0.25 ELSE 0.0 END)) END, 12) AS action_object,
        round(CASE WHEN u5 > 0 AND i5 > 0 THEN i5 / u5::DOUBLE ELSE 0.0 END, 12) AS control_type,
        round({prior}, 12) AS category_prior
      FROM (SELECT a, b, {inter('a.ao', 'b.ao')} AS iao, {', '.join(fields)} FROM ({pairs})))"""


def sql_ranked(keys: str, order: str = "order_no") -> str:
    """Ranks of scored pairs with columns source_id, candidate_id, order_no and the signals."""
    ranks = ", ".join(f"row_number() OVER (PARTITION BY source_id ORDER BY {n} DESC, {order}) AS r_{n}"
                      for n in ("semantic", "structured", "action_object"))
    return f"""SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY combined DESC, rrf DESC, {order}) AS rank FROM (
      SELECT *, round(0.45 * (1.0::DOUBLE / (60 + r_semantic)) + 0.30 * (1.0::DOUBLE / (60 + r_structured))
        + 0.20 * (1.0::DOUBLE / (60 + r_action_object)), 12) AS rrf FROM (SELECT *, {ranks} FROM ({keys})))"""


DOC_SIDES = f"WITH {sql_features(FX.SOURCE_ATOMS, 's')}, {sql_features(FX.DOC_ATOMS, 't')}"
DOC_PAIRS = f"""SELECT a.atomic_id AS source_id, b.atomic_id AS candidate_id, b.order_no AS order_no, a.idf AS sidf, b.idf AS tidf,
  a.pk AS spk, a.sk AS ssk, b.pk AS tpk, b.sk AS tsk, b.parent_id AS parent_id, semantic, structured, action_object, control_type,
  category_prior, combined FROM ({sql_signals('SELECT a, b FROM s AS a, t AS b')})"""
DOC_RANKED = sql_ranked(DOC_PAIRS)
ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in ("semantic", "structured", "action_object", "control_type",
                                                      "category_prior", "combined"))


def rounded(df, *keys):
    return df.select(*keys, *[F.round(f"{n}_score", 6).alias(n) for n in (
        "semantic", "structured", "action_object", "control_type", "category_prior", "combined")])


# ---- pools --------------------------------------------------------------------------------------
@query("J1_global_pool", f"""SELECT atomic_id, 'soft_enisa' AS scope, 'global_pool_with_category_prior' AS scope_key,
  (SELECT count(*) FROM ({FX.DOC_ATOMS})) AS pool_size FROM ({FX.SOURCE_ATOMS})""")
def _(spark, d):
    s, t = FX.source_atoms(spark, d), FX.atoms(spark, d)
    return RT.pool_sizes(s.select("atomic_id"), t.select("atomic_id"))


_KEYS = "list_distinct(list_concat([category], CASE WHEN pos % 5 = 0 THEN ['fr'] ELSE []::VARCHAR[] END))"


@query("J2_category_pool", f"""WITH s AS (SELECT atomic_id, CASE WHEN category = 'fr' THEN ['fr'] WHEN pos % 5 = 0 THEN
    ['en', 'fr'] ELSE ['en'] END AS k FROM ({FX.SOURCE_ATOMS})),
  t AS (SELECT k, count(*) AS n FROM (SELECT {_KEYS} AS k FROM ({FX.DOC_ATOMS})) GROUP BY 1)
  SELECT atomic_id, 'enisa_category' AS scope, array_to_string(s.k, ';') AS scope_key, (SELECT sum(n) FROM t WHERE
  len(list_intersect(s.k, t.k)) > 0)::BIGINT AS pool_size FROM s""")
def _(spark, d):
    def keyed(a):
        return a.select("atomic_id", SI.category_keys(F.col("primary_category"), F.col("category"),
                                                      F.col("secondary_categories")).alias("keys"))
    return RT.pool_sizes(keyed(FX.source_atoms(spark, d)), keyed(FX.atoms(spark, d)),
                         replace(DOC_PARAMS, match_scope="same_category"))


@query("J2_category_scope_search", f"""{DOC_SIDES} SELECT source_id, candidate_id, rank::INT AS rank, round(combined, 6) AS combined
  FROM ({sql_ranked("SELECT * FROM (" + DOC_PAIRS + ") WHERE spk = tpk OR list_contains(tsk, spk) OR list_contains(ssk, tpk)"
                    " OR len(list_intersect(ssk, tsk)) > 0")})
  WHERE rank <= 8 AND combined >= 0.04""")
def _(spark, d):
    p = replace(DOC_PARAMS, match_scope="same_category", review_top_k=8)
    return SE.search(*doc_sides(spark, d, p), p).select("source_id", "candidate_id", "rank",
                                                        F.round("combined_score", 6).alias("combined"))


# ---- pair signals: every atom against the next atom of its document -------------------------------
def sql_adjacent(select: str) -> str:
    pairs = sql_signals("SELECT a, b FROM t AS a JOIN t AS b ON b.order_no = a.order_no + 1")
    return f"WITH {sql_features(FX.DOC_ATOMS, 't')} {select} FROM ({pairs})"


#: What each signal reads of an atom.
READS = {"semantic": ["vec"], "structured": ["sets"], "action_object": ["ao", "control_family"], "control_type": ["sets"],
         "category_prior": ["primary_key", "secondary_keys", "confidence", "low_confidence"]}


def adjacent(spark, d, *signals):
    """The signals of every atom with the next atom of its document; only what they read is computed and sent. The rows of
    the number after its own are a window's frame, so each atom is prepared and shuffled once, not for both sides of a join."""
    f = SI.with_features(FX.searchable(FX.atoms(spark, d)), DOC_PARAMS)
    read = list(dict.fromkeys(c for s in signals for c in READS[s]))
    packed = f.select("atomic_id", "order_no", F.floor(F.col("order_no") / 1000000).alias("pos"), F.struct(*read).alias("a"))
    after = F.collect_list("a").over(Window.partitionBy("pos").orderBy("order_no").rangeBetween(1, 1))
    paired = packed.where("order_no is not null").withColumn("after", after)
    pairs = paired.select(F.col("atomic_id").alias("source_id"), "a", F.explode("after").alias("b"))
    return pairs.select("source_id", *[SI.signal(s, F.col("a"), F.col("b"), DOC_PARAMS) for s in signals])


for _name, _cols in {"J3_cosine": ["semantic"], "J5_structured_similarity": ["structured"],
                     "J6_action_object_similarity": ["action_object"], "J7_control_type_similarity": ["control_type"],
                     "J8_category_prior": ["category_prior"]}.items():
    def _run(spark, d, cols=tuple(_cols)):
        return adjacent(spark, d, *cols).select("source_id", *[F.round(f"{c}_score", 6).alias(c) for c in cols])
    Q[_name] = _run
    S[_name] = sql_adjacent("SELECT a.atomic_id AS source_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _cols))


@query("J10_combined_score", sql_adjacent("""SELECT a.atomic_id AS source_id, round(combined, 6) AS combined,
  CASE WHEN action_object < 0.25 THEN 'low_action_object_alignment_score_cap' ELSE 'pass' END AS hard_gate"""))
def _(spark, d):
    gate = F.when(F.col("action_object_score") < 0.25, "low_action_object_alignment_score_cap").otherwise("pass")
    scored = SI.with_combined(adjacent(spark, d, *READS), DOC_PARAMS)
    return scored.select("source_id", F.round("combined_score", 6).alias("combined"), gate.alias("hard_gate"))


# ---- search -------------------------------------------------------------------------------------
@query("J4_bm25", f"""WITH s AS MATERIALIZED (SELECT atomic_id, {X.toks('atomic_requirement')} AS k FROM ({FX.SOURCE_ATOMS})),
  t AS MATERIALIZED (SELECT atomic_id, pos * 1000000 + atom_no AS order_no, {X.toks('atomic_requirement')} AS k FROM ({FX.DOC_ATOMS})),
  st AS (SELECT count(*) AS n, sum(len(k)) / count(*) AS avgdl FROM t),
  tf AS (SELECT atomic_id, order_no, term, dl, count(*) AS tf FROM (SELECT atomic_id, order_no, len(k) AS dl, unnest(k) AS term
    FROM t) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  w AS MATERIALIZED (SELECT atomic_id, order_no, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5)
    / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN df USING (term), st),
  q AS (SELECT atomic_id AS source_id, term, count(*) AS c FROM (SELECT atomic_id, unnest(k) AS term FROM s) GROUP BY ALL),
  r AS (SELECT source_id, atomic_id AS candidate_id, order_no, round(sum(c * w), 9) AS raw FROM q JOIN w USING (term) GROUP BY ALL)
  SELECT source_id, candidate_id, round(raw / best, 6) AS score, rank::INT AS rank FROM (SELECT *, max(raw) OVER (PARTITION BY
    source_id) AS best, row_number() OVER (PARTITION BY source_id ORDER BY raw DESC, order_no) AS rank FROM r)
  WHERE rank <= 8""")
def _(spark, d):
    return keyword_top(spark, d, replace(DOC_PARAMS, use_keyword=True, weight_keyword=0.2))


def keyword_top(spark, d, p):
    """The eight best by keywords, scores divided by the best one of the source."""
    def side(atoms):
        return atoms.select("atomic_id", (F.col("pos") * 1000000 + F.col("atom_no")).alias("order_no"), tokens(F.col("atomic_requirement")).alias("terms"),
                            SI.category_keys(F.col("primary_category"), F.col("category"), F.col("secondary_categories")).alias("keys"))
    top = KW.Index(side(FX.source_atoms(spark, d)), side(FX.atoms(spark, d)), p).top(8)
    best = F.max("raw_score").over(Window.partitionBy("source_id"))
    return top.select("source_id", "candidate_id", F.round(F.col("raw_score") / best, 6).alias("score"), "rank")


_POOLED = """SELECT pool, atomic_id, order_no, k FROM (SELECT DISTINCT ks AS pool FROM s) JOIN t ON len(list_intersect(pool, t.ks)) > 0"""


@query("J4_bm25_category_pool", f"""WITH s AS MATERIALIZED (SELECT atomic_id, {X.toks('atomic_requirement')} AS k, CASE WHEN category = 'fr' THEN ['fr'] WHEN pos % 5 = 0
    THEN ['en', 'fr'] ELSE ['en'] END AS ks FROM ({FX.SOURCE_ATOMS})),
  t AS MATERIALIZED (SELECT atomic_id, pos * 1000000 + atom_no AS order_no, {X.toks('atomic_requirement')} AS k, {_KEYS} AS ks FROM ({FX.DOC_ATOMS})),
  m AS MATERIALIZED ({_POOLED}), st AS (SELECT pool, count(*) AS n, sum(len(k)) / count(*) AS avgdl FROM m GROUP BY 1),
  tf AS (SELECT pool, atomic_id, order_no, term, dl, count(*) AS tf FROM (SELECT pool, atomic_id, order_no, len(k) AS dl, unnest(k) AS term FROM m) GROUP BY ALL),
  df AS (SELECT pool, term, count(*) AS df FROM tf GROUP BY 1, 2),
  w AS MATERIALIZED (SELECT pool, atomic_id, order_no, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5)
    / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN df USING (pool, term) JOIN st USING (pool)),
  q AS (SELECT atomic_id AS source_id, ks AS pool, term, count(*) AS c FROM (SELECT atomic_id, ks, unnest(k) AS term FROM s) GROUP BY ALL),
  r AS (SELECT source_id, atomic_id AS candidate_id, order_no, round(sum(c * w), 9) AS raw FROM q JOIN w USING (pool, term) GROUP BY ALL)
  SELECT source_id, candidate_id, round(raw / best, 6) AS score, rank::INT AS rank FROM (SELECT *, max(raw) OVER (PARTITION BY
    source_id) AS best, row_number() OVER (PARTITION BY source_id ORDER BY raw DESC, order_no) AS rank FROM r) WHERE rank <= 8""")
def _(spark, d):
    return keyword_top(spark, d, replace(DOC_PARAMS, use_keyword=True, weight_keyword=0.2, match_scope="same_category"))


_VEC_RANKED = sql_ranked("SELECT *, 0.0 AS structured, 0.0 AS action_object FROM (" + VECTOR_PAIRS + ")")


@query("J9_rank_fusion", f"""SELECT source_id, candidate_id, round(rrf, 9) AS rrf FROM ({_VEC_RANKED}) WHERE rank <= 10
  AND combined >= 0.04""")
def _(spark, d):
    return SE.search(*vector_sides(spark, d), VECTOR_PARAMS, all_rrf=True).select(
        "source_id", "candidate_id", F.round("rrf_score", 9).alias("rrf"))


@query("J12_top_k_candidates", f"""SELECT source_id, candidate_id, rank::INT AS rank, round(semantic, 6) AS semantic,
  round(category_prior, 6) AS category_prior, round(combined, 6) AS combined FROM ({_VEC_RANKED}) WHERE rank <= 8
  AND combined >= 0.04""")
def _(spark, d):
    return SE.search(*vector_sides(spark, d), replace(VECTOR_PARAMS, review_top_k=8)).select(
        "source_id", "candidate_id", "rank", F.round("semantic_score", 6).alias("semantic"),
        F.round("category_prior_score", 6).alias("category_prior"), F.round("combined_score", 6).alias("combined"))


@query("J11_final_rank", f"""{DOC_SIDES} SELECT source_id, candidate_id, rank::INT AS rank, {ROUNDED} FROM ({DOC_RANKED})
  WHERE rank <= 10 AND combined >= 0.04""")
def _(spark, d):
    return rounded(SE.search(*doc_sides(spark, d), DOC_PARAMS), "source_id", "candidate_id", "rank")


_AFFINE = """(spk = tpk OR list_contains(ssk, tpk) OR list_contains(tsk, spk) OR len(list_intersect(ssk, tsk)) > 0
  OR (sidf = 'FR' AND tidf IN ('DE', 'ES')) OR (sidf = 'EN' AND tidf = 'FR'))"""


@query("J13_affinity_injection", f"""{DOC_SIDES} SELECT source_id, candidate_id, late AS injected, round(combined, 6) AS combined
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id, late ORDER BY rank) AS nth FROM (SELECT *,
    rank > 10 AND {_AFFINE} AS late FROM ({DOC_RANKED}) WHERE combined >= 0.04))
  WHERE rank <= 10 OR (late AND nth <= 4)""")
def _(spark, d):
    p = replace(DOC_PARAMS, affinity_enabled=True)
    table = spark.createDataFrame(AFFINITY, "key string, families array<string>")
    return SE.search(*doc_sides(spark, d, p), p, table).select(
        "source_id", "candidate_id", "injected", F.round("combined_score", 6).alias("combined"))


@query("J14_candidate_payload", f"""{DOC_SIDES} SELECT source_id, string_agg(rank || ' ' || candidate_id || ' ' || parent_id || ' '
  || CASE WHEN action_object < 0.25 THEN 'low_action_object_alignment_score_cap' ELSE 'pass' END, ',' ORDER BY rank) AS payload,
  round(sum(round(combined, 4)), 4) AS scores FROM ({DOC_RANKED}) WHERE rank <= 10 AND combined >= 0.04 GROUP BY 1""")
def _(spark, d):
    c = SE.search(*doc_sides(spark, d), DOC_PARAMS)
    p = RT.payloads(c, FX.atoms(spark, d))
    line = lambda x: F.concat_ws(" ", x["rank"].cast("string"), x["candidate_id"], x["parent_id"], x["hard_gate"])
    return p.select("source_id", F.array_join(F.transform("candidates", line), ",").alias("payload"), F.round(
        F.aggregate("candidates", F.lit(0.0), lambda a, x: a + x["combined_score"]), 4).alias("scores"))


@query("J15_guideline_passages", f"""WITH q AS (SELECT item_id, list(val ORDER BY idx) AS v, list(idx ORDER BY idx) AS i FROM (
    {sql_hash_vectors('SELECT item_id, text FROM benchmark', 'item_id', 'text')}) GROUP BY 1),
  c0 AS MATERIALIZED (SELECT doc_id * 1000 + (s / 320)::INT AS chunk_id, array_to_string(w[s + 1:s + 400], ' ') AS chunk FROM
    (SELECT doc_id, string_split({X.norm('text')}, ' ') AS w FROM documents), unnest(range(0, len(w), 320)) AS u(s)
    WHERE length(array_to_string(w[s + 1:s + 400], ' ')) > 80),
  cv AS MATERIALIZED ({sql_hash_vectors('SELECT chunk_id, chunk FROM c0', 'chunk_id', 'chunk')}),
  qv AS MATERIALIZED ({sql_hash_vectors('SELECT item_id, text FROM benchmark', 'item_id', 'text')}),
  p AS (SELECT item_id, chunk_id, round(sum(qv.val * cv.val), 9) AS cosine FROM qv JOIN cv USING (idx) GROUP BY ALL)
  SELECT item_id::VARCHAR AS source_id, chunk_id::VARCHAR AS candidate_id, round(cosine, 6) AS cosine, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, chunk_id) AS rank FROM p) WHERE rank <= 3""")
def _(spark, d):
    q = embed(table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("atomic_id"),
                                                  F.col("item_id").alias("order_no"), "text"), "text")
    c = chunk_texts(table(spark, d, "documents").select("doc_id", "text"), "text")
    c = c.withColumn("order_no", F.col("doc_id") * 1000 + F.col("window_no"))
    c = embed(c.withColumn("atomic_id", F.col("order_no").cast("string")), "chunk")
    return RT.guideline_passages(q, c).withColumn("cosine", F.round("cosine", 6))


