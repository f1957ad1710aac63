"""Registered queries for gap items (A18-A25), output tables (K) and the run-log stream (X1), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.functions import labels as L
from mapweave.operators import gaps as G
from mapweave.operators import rollup as R
from mapweave.operators import taxonomy as T
from mapweave.operators.rules import none
from mapweave.plans import decision_queries as DQ
from mapweave.plans import fixtures as FX
from mapweave.plans import report_queries as RQ
from mapweave.plans import sqltext as X
from mapweave.plans import taxonomy_queries as TQ
from mapweave.plans.fixtures import table
from mapweave.plans.text_queries import _POINTS, sql_dimension
from mapweave.sources import sinks as K
from mapweave.sources import shared as SH
from mapweave.streaming import runlog_stream as XS

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            S[name] = sql
        return fn
    return register


def talk(spark, d):
    """Conversations as decisions: a turn is an atom of its conversation, its text a gap."""
    c = table(spark, d, "conversations")
    pid = F.concat(F.lit("C"), F.col("conv_id").cast("string"))
    item = F.array(F.struct(F.col("role").alias("dimension"), F.col("text").alias("gap"), F.lit("high").alias("severity")))
    return c.select(
        "conv_id", "turn", pid.alias("source_parent_id"), F.concat(pid, F.lit("#"), F.col("turn").cast("string")).alias("source_id"),
        F.col("turn").alias("decision_order"), (F.col("turn") * 10 % 110).cast("int").alias("coverage_level"), F.lit("partial_gap").alias("gap_type"),
        F.lit("partial").alias("relation_type"), F.lit("Low").alias("mapping_risk"), F.lit("Direct").alias("match_type"),
        F.lit("").alias("source_requirement"), pid.alias("source_parent_requirement"), F.lit("").alias("source_category"),
        F.when(F.col("turn") % 2 == 0, item).otherwise(none("array<struct<dimension:string,gap:string,severity:string>>")).alias("gap_items"),
        F.col("text").alias("gap"))


_TALK_DIMENSION = sql_dimension("role", L.DIMENSIONS, L.DIMENSION_ALIASES)
#: Gap items of the conversations: c, s and i order them.
_ITEMS = f"""SELECT * FROM (SELECT 'C' || conv_id AS parent, turn * 10 % 110 AS c, 'C' || conv_id || '#' || turn AS s, 0 AS i, {_TALK_DIMENSION} AS dimension,
    {X.clean_gap('text')} AS gap, 'material' AS severity FROM conversations WHERE turn % 2 = 0 AND turn * 10 % 110 < 100 AND trim(text) <> '' AND NOT {X.generic('text')}
  UNION ALL SELECT parent, turn * 10 % 110, parent || '#' || turn, i - 1, {X.first_rule(X.fold('p[i]'), L.DIMENSION_WORDS, 'explicitness')}, p[i],
    CASE WHEN turn * 10 % 110 <= 25 THEN 'material' WHEN turn * 10 % 110 <= 50 THEN 'moderate' ELSE 'minor' END FROM (
    SELECT 'C' || conv_id AS parent, turn, {_POINTS} AS p FROM conversations WHERE turn % 2 = 1 AND turn * 10 % 110 < 100), unnest(range(1, len(p) + 1)) AS u(i))
  WHERE gap <> ''"""
#: The greedy pass as a fold over the items of a group in order; an element is a list of one item.
_NEAR = """CASE WHEN len(list_filter(acc, lambda e: e.k = x[1].k OR len(list_intersect(e.t, x[1].t)) >=
    0.78::DOUBLE * (len(e.t) + len(x[1].t) - len(list_intersect(e.t, x[1].t))) - 1e-12 AND len(list_intersect(e.t, x[1].t)) > 0)) > 0
  THEN acc ELSE list_concat(acc, x) END"""
_KEPT = f"""SELECT parent, dimension, e.gap AS gap, e.severity AS severity, e.o AS o FROM (SELECT parent, dimension, unnest(list_reduce(l, lambda acc, x: {_NEAR})) AS e FROM (
  SELECT parent, dimension, list([{{'gap': gap, 'severity': severity, 'k': array_to_string(w[1:16], ' '), 't': list_distinct(w), 'o': o}}] ORDER BY o) AS l FROM (
    SELECT parent, dimension, gap, arg_min(severity, (c, s, i)) AS severity, min((c, s, i)) AS o, {X.gap_toks('gap')} AS w FROM ({_ITEMS}) GROUP BY parent, dimension, gap)
  GROUP BY parent, dimension))"""


@query("A18_gap_items", f"SELECT parent, i::INT AS item, dimension, md5(gap) AS gap, severity FROM ({_ITEMS})")
def _(spark, d):
    return G.collect_gap_items(talk(spark, d)).select("parent", F.col("item_order._i").alias("item"), "dimension", F.md5("gap").alias("gap"), "severity")


@query("A19_near_duplicates", f"SELECT parent, dimension, gap, severity FROM ({_KEPT})")
def _(spark, d):
    return G.drop_near_duplicates(G.collect_gap_items(talk(spark, d))).select("parent", "dimension", "gap", "severity")


_WORDS = ("array_to_string(list_filter(string_split(trim(regexp_replace(replace(" + X.fold("text") + ", '.', ' '), '\\s+', ' ', 'g')), ' '), "
          "lambda w: len(w) > 2)[1:18], ' ')")


@query("A20_equal_keys", f"""SELECT parent, dimension, min(turn) AS turn FROM (SELECT role AS parent, 'x' AS dimension, conv_id * 1000 + turn AS turn, {_WORDS} AS k
  FROM conversations) GROUP BY parent, dimension, k""")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("role").alias("parent"), F.lit("x").alias("dimension"), F.col("text").alias("gap"),
                                                (F.col("conv_id") * 1000 + F.col("turn")).alias("item_order"))
    return G.drop_equal_keys(c).select("parent", "dimension", F.col("item_order").alias("turn"))


def own_summaries(spark, d):
    t = talk(spark, d)
    agg = R.parent_aggregates(t)
    return agg, G.summaries(agg, G.drop_near_duplicates(G.collect_gap_items(t)), "Target")


_RANKS = "CASE dimension " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(L.DIMENSION_ORDER)) + f" ELSE {len(L.DIMENSION_ORDER)} END"
_TALK_AGG = f"""SELECT 'C' || conv_id AS parent, round(sum(c) / count(*)::DOUBLE, 1) AS m, min(c) AS low, count(*) FILTER (c >= 40) / count(*)::DOUBLE AS direct,
  count(*) FILTER (c >= 80) / count(*)::DOUBLE AS strong, count(*) FILTER (c > 0 AND c < 40) / count(*)::DOUBLE AS indirect,
  count(*) FILTER (c <= 0) / count(*)::DOUBLE AS none, list(DISTINCT {_TALK_DIMENSION}) FILTER (turn % 2 = 0) AS dims
  FROM (SELECT *, turn * 10 % 110 AS c FROM conversations) GROUP BY conv_id"""


@query("A21_gap_summary", f"""WITH kept AS (SELECT parent, count(*) FILTER (severity IN ('material', 'moderate')) AS n,
    string_agg('• ' || gap, chr(10) ORDER BY {_RANKS}, CASE severity WHEN 'material' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, o) AS b FROM ({_KEPT}) GROUP BY parent),
  agg AS (SELECT *, CASE WHEN m >= 99.5 THEN 'none' ELSE {RQ.ladder('m')} END AS gt FROM ({_TALK_AGG})),
  told AS (SELECT parent, low, b, CASE WHEN m <= 0 THEN 'Not covered' WHEN m >= 99.5 AND gt = 'none' THEN 'Exact coverage' WHEN gt = 'implementation_detail_gap' THEN 'Implementation details missing'
      WHEN m >= 80 THEN 'Mostly covered' WHEN m >= 60 THEN 'Largely covered' WHEN m >= 40 THEN 'Partially covered' WHEN m >= 20 THEN 'Indirectly covered'
      WHEN m >= 10 THEN 'Very weakly covered' ELSE 'Not covered' END AS rel, coalesce(n, 0) AS n FROM agg LEFT JOIN kept USING (parent))
  SELECT parent, CASE WHEN low >= 100 THEN 'Target fully covers this requirement.' ELSE CASE rel
    WHEN 'Not covered' THEN 'Target does not identify a direct equivalent obligation for the source requirement.'
    WHEN 'Indirectly covered' THEN 'Target provides related or supportive provisions, but they do not establish equivalent direct coverage.'
    WHEN 'Partially covered' THEN 'Target partially covers the source requirement, with ' || n || ' substantive residual difference(s).'
    WHEN 'Mostly covered' THEN 'Target mostly covers the source requirement, with residual differences requiring interpretation or complementary evidence.'
    ELSE 'Target covers the main objective, but residual differences remain.' END || coalesce(chr(10) || chr(10) || b, '') END AS gap FROM told""")
def _(spark, d):
    return own_summaries(spark, d)[1]


@query("A22_summary_choice", f"""SELECT parent, CASE WHEN mean >= 99.5 THEN 'Target fully covers this requirement.' WHEN substr(parent, 2)::BIGINT % 2 = 0 THEN 'Supplied'
  ELSE 'Own ' || parent END AS gap FROM ({RQ.AGG})""")
def _(spark, d):
    agg = R.parent_aggregates(FX.decisions(spark, d))
    own = agg.select("parent", F.concat(F.lit("Own "), "parent").alias("gap"))
    supplied = agg.filter(F.substring("parent", 2, 20).cast("long") % 2 == 0).select("parent", F.lit(" Supplied ").alias("summary"))
    return G.choose_summary(own, agg, supplied, "Target")


@query("A23_supplied_synthesis", f"""SELECT doc_id::VARCHAR AS parent, md5({X.clean('source')} || chr(10) || chr(10) || '• ' || {X.clean('text')}) AS summary,
  CASE WHEN doc_id % 2 = 0 THEN 'partial_gap' ELSE 'implementation_detail_gap' END AS parent_gap_type,
  CASE WHEN doc_id % 2 = 0 THEN 'partial' ELSE 'implementation_detail_gap' END AS parent_relation_type FROM documents WHERE doc_id % 5 <> 0 AND trim(text) <> ''""")
def _(spark, d):
    gap = F.struct(F.lit("clarity").alias("dimension"), F.col("text").alias("missing_element"))
    json = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, "Partial").alias("gap_type"), F.col("source").alias("summary"),
                              F.array(gap, gap).alias("residual_gaps")))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("parent"), F.when(F.col("doc_id") % 5 == 0, "{bad").otherwise(json).alias("synthesis"))
    return G.supplied_syntheses(rows).withColumn("summary", F.md5("summary"))


@query("A24_distinct_targets", f"""SELECT parent, target_id, row_number() OVER (PARTITION BY parent ORDER BY o)::INT AS position FROM (SELECT parent, target_parent_id AS target_id,
  min(decision_order) AS o FROM ({RQ.D0}) WHERE has_target GROUP BY 1, 2)""")
def _(spark, d):
    return G.distinct_targets(FX.decisions(spark, d))


def planned(spark, d):
    rows = R.parents(FX.decisions(spark, d)).withColumn("gap", F.when(F.col("coverage_level") % 3 == 0, "x Fully covers this requirement.").otherwise("Gap."))
    actions = rows.select("parent", F.array(F.lit("- do this"), F.lit(" "), F.lit("and that!")).alias("actions")).filter(F.length("parent") > 3)
    return G.action_plans(rows, actions)


@query("A25_action_plans", f"""SELECT parent, CASE WHEN cov < 99.5 AND cov % 3 <> 0 AND length(parent) > 3 THEN '• do this.' || chr(10) || '• and that!' ELSE '' END
  AS action_plan FROM ({RQ.PARENTS})""")
def _(spark, d):
    return planned(spark, d).select("parent", "action_plan")


# ---- output tables ------------------------------------------------------------------------------
def written(spark, tables: dict, name: str):
    """One of the tables, read back after all were published."""
    path = SH.new_folder(spark, "output")
    K.publish(tables, path, "run")
    return K.published(spark, path, name)


_LABEL = f"CASE {X.bucket('cov')} " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in L.BUCKET_LABELS.items()) + " END"


@query("K1_parent_table", f"""SELECT 'A' AS source_regulation, parent AS source_control_id, req AS source_requirement, domain AS category, 'B' AS target_regulation,
  array_to_string(ts, ', ') AS target_control_ids, array_to_string([('Text of ' || t) FOR t IN ts], chr(10) || '---' || chr(10)) AS target_requirements,
  {_LABEL} AS coverage_relationship, {X.bucket('cov')} AS coverage_level, CASE WHEN cov % 3 = 0 THEN 'x Fully covers this requirement.' ELSE 'Gap.' END AS gap,
  '' AS detailed_gap, CASE WHEN cov < 99.5 AND cov % 3 <> 0 AND length(parent) > 3 THEN '• do this.' || chr(10) || '• and that!' ELSE '' END AS action_plan,
  risk AS review_priority FROM ({RQ.PARENTS})""")
def _(spark, d):
    rows = planned(spark, d).withColumn("review_priority", F.col("mapping_risk"))
    return written(spark, {"parents": K.parent_table(rows, "A", "B")}, "parents")


_KIND = X.lookup("regexp_replace(lower(trim(gt)), '[^a-z0-9]+', '_', 'g')", L.PARENT_GAP_ALIASES, "CASE WHEN trim(gt) = '' THEN '' ELSE 'partial_gap' END")
_LINE = """{i} || '. ' || id{i} || ' | combined=' || c{i} || ' | action_object=' || ao{i} || ' | semantic=' || s{i} || ' | gate=pass'"""


@query("K2_atomic_table", f"""SELECT 'A' AS source_regulation, regexp_replace(source_id, '__row_\\d+', '', 'g') AS source_atomic_id,
  regexp_replace(source_parent_id, '__row_\\d+', '', 'g') AS source_parent_id, 'text ' || k AS source_requirement, source_category, 'B' AS target_regulation,
  array_to_string(targets, ', ') AS target_atomic_ids, array_to_string([('text of ' || t) FOR t IN targets], chr(10) || '---' || chr(10)) AS target_requirements,
  CASE WHEN lower(rel) = 'conflict' OR kind = 'conflict_gap' THEN 'Conflicting' WHEN lower(rel) = 'not_covered' THEN 'Not covered' WHEN cov >= 99.5 THEN 'Exact coverage'
    WHEN cov >= 80 THEN CASE WHEN kind = 'implementation_detail_gap' THEN 'Implementation details missing' ELSE 'Mostly covered' END WHEN cov >= 60 THEN 'Largely covered'
    WHEN cov >= 40 THEN CASE WHEN kind = 'implementation_detail_gap' THEN 'Implementation details missing' ELSE 'Partially covered' END
    WHEN cov >= 20 THEN 'Indirectly covered' WHEN cov >= 10 THEN 'Very weakly covered' ELSE 'Not covered' END AS coverage_relationship,
  gt AS gap_type, cov::INT AS coverage_level, mt AS match_type, CASE WHEN k % 3 = 0 THEN '{{"action":' || (k % 101) || '}}' ELSE '' END AS dimension_scores,
  CASE WHEN k % 2 = 0 THEN 'scope; actor' ELSE '' END AS gap_dimensions, gap, '' AS recommendation, '' AS scoring_rationale,
  CASE WHEN has_c THEN {_LINE.format(i=1)} || chr(10) || {_LINE.format(i=2)} ELSE '' END AS candidate_diagnostics
  FROM (SELECT *, {_KIND} AS kind FROM ({DQ.RULE_DECISIONS}))""")
def _(spark, d):
    k = F.col("k")
    rows = DQ.rule_decisions(spark, d).withColumns({
        "source_requirement": F.concat(F.lit("text "), k.cast("string")),
        "dimension_scores": F.when(k % 3 == 0, F.concat(F.lit('{"action":'), (k % 101).cast("string"), F.lit("}"))).otherwise(""),
        "gap_dimensions": F.when(k % 2 == 0, F.array(F.lit("scope"), F.lit("actor"))).otherwise(none())})
    return written(spark, {"atoms": K.atomic_table(rows, "A", "B")}, "atoms")


Q["K3_coverage_by_category"], S["K3_coverage_by_category"] = RQ.Q["A10_coverage_by_category"], RQ.S["A10_coverage_by_category"]


@query("K4_category_quality", f"""SELECT parent AS source_control_id, arg_max(source_category, decision_order) AS source_category, arg_max(mapping_risk, decision_order) AS mapping_risk,
  arg_max(coverage_level, decision_order) AS coverage_level FROM ({RQ.D0}) GROUP BY 1""")
def _(spark, d):
    return K.category_quality_table(FX.decisions(spark, d))


_NUMBERED = f"SELECT *, row_number() OVER (ORDER BY pass_no, group_order, a, b) AS n FROM ({RQ.U_ROWS})"
_CONS = "'CONS-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS consolidated_id"


def merged_table(spark, d, name):
    return written(spark, K.consolidated_tables(SH.saved(RQ.merged(spark, d), "merged"), "Left", "Right"), name)


@query("K5_consolidated_table", f"""SELECT {_CONS}, n.category, text AS consolidated_text, origin, cov AS coverage_a_to_b, a AS source_id_a,
  CASE WHEN pass_no = 1 THEN ga.requirement ELSE '' END AS source_text_a, replace(b, ',', ', ') AS source_ids_b,
  CASE WHEN pass_no = 1 THEN array_to_string([('Text of ' || t) FOR t IN ga.ts[1:2]], ' | ') ELSE gb.requirement END AS source_text_b,
  CASE WHEN pass_no = 1 THEN array_to_string(ga.bc[1:3], ' ') ELSE '' END AS b_contribution, gap AS gap_a_to_b
  FROM ({_NUMBERED}) n LEFT JOIN ({RQ.GROUPS_A}) ga ON n.a = ga.parent LEFT JOIN ({RQ.GROUPS_B}) gb ON pass_no > 1 AND n.b = gb.parent""")
def _(spark, d):
    return merged_table(spark, d, "consolidated")


@query("K5_traceability", f"SELECT {_CONS}, category, origin, cov AS coverage_a_to_b, a AS source_id_a, replace(b, ',', ', ') AS source_ids_b FROM ({_NUMBERED})")
def _(spark, d):
    return merged_table(spark, d, "traceability")


@query("K5_summary", f"""SELECT u.position::INT AS position, ['source_framework_a', 'source_framework_b', 'total', 'a_enriched', 'b_only', 'b_supplemental', 'avg_coverage_a_to_b'][u.position] AS metric,
  v[u.position] AS value FROM (SELECT ['Left', 'Right', count(*)::VARCHAR, (count(*) FILTER (origin = 'A_enriched'))::VARCHAR, (count(*) FILTER (origin = 'B_only'))::VARCHAR,
  (count(*) FILTER (origin = 'B_supplemental'))::VARCHAR, round_even(avg(cov) FILTER (origin = 'A_enriched'), 0)::INT || '%'] AS v FROM ({RQ.U_ROWS})), unnest(range(1, 8)) AS u(position)
  WHERE v[u.position] IS NOT NULL""")
def _(spark, d):
    return merged_table(spark, d, "summary")


def quality_table(spark, d, name):
    atoms = SH.saved(T.apply_to_atoms(TQ.classified(spark, d)), "atoms")
    return written(spark, K.category_report(atoms, "doc_id"), name)


_EXAMPLE = """SELECT doc_id::VARCHAR AS control_id, oc AS original_category, primary_category AS category, replace(secondary, ',', '; ') AS secondary,
  round(confidence, 6) AS category_confidence, status AS category_status, method AS category_method FROM z"""


def examples(spark, d, kind):
    return quality_table(spark, d, kind).withColumn("category_confidence", F.round("category_confidence", 6))


@query("K6_category_examples", f"{TQ.FULL} {_EXAMPLE} WHERE status = 'multi_domain' OR secondary <> '' ORDER BY doc_id LIMIT 200")
def _(spark, d):
    return examples(spark, d, "multi")


@query("K6_low_confidence", f"{TQ.FULL} {_EXAMPLE} WHERE confidence < 0.6 ORDER BY doc_id LIMIT 200")
def _(spark, d):
    return examples(spark, d, "low")


@query("K6_changed", f"{TQ.FULL} {_EXAMPLE} WHERE oc <> '' AND oc <> primary_category ORDER BY doc_id LIMIT 200")
def _(spark, d):
    return examples(spark, d, "changed")


@query("K6_distribution", f"{TQ.FULL} SELECT primary_category AS category, count(*) AS atoms FROM z GROUP BY 1")
def _(spark, d):
    return quality_table(spark, d, "distribution")


@query("K6_summary", f"""{TQ.FULL} SELECT u.position::INT AS position, ['framework', 'total_atoms', 'low_confidence', 'medium_confidence', 'changed', 'multi_domain', 'recommended_match_scope'][u.position]
  AS metric, v[u.position] AS value FROM (SELECT ['A', count(*)::VARCHAR, (count(*) FILTER (confidence < 0.6))::VARCHAR, (count(*) FILTER (confidence >= 0.6 AND confidence < 0.85))::VARCHAR,
  (count(*) FILTER (oc <> '' AND oc <> primary_category))::VARCHAR, (count(*) FILTER (status = 'multi_domain' OR secondary <> ''))::VARCHAR, 'soft_enisa'] AS v FROM z),
  unnest(range(1, 8)) AS u(position)""")
def _(spark, d):
    return quality_table(spark, d, "summary")


@query("K7_keyed_append", """SELECT user_id AS key, arg_min(event_type, event_id) AS decision, count(DISTINCT user_id) AS n FROM events GROUP BY 1""")
def _(spark, d):
    path = SH.new_folder(spark, "keyed") + "/t"
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("decision"), F.col("event_id").alias("log_order"))
    K.append_new(e.filter("key % 2 = 0"), None, path)
    K.append_new(e.withColumn("decision", F.when(F.col("key") % 2 == 0, "later").otherwise(F.col("decision"))), spark.read.parquet(path), path)
    return spark.read.parquet(path).groupBy("key", "decision").agg(F.count(F.lit(1)).alias("n"))


def _long(prefix: str, sql: str, values: list[str], *keys: str) -> str:
    """Rows of sql as (metric, value), named as `run_report` names them."""
    name = " || '.' || ".join([X.q(prefix), *keys])
    return " UNION ALL ".join(f"""SELECT {name} || '.{v}' AS metric, "{v}"::VARCHAR AS value FROM ({sql})""" for v in values)


_REPORT = [
    _long("summary", f"""SELECT count(*) AS events, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (step = 'candidate_generation') AS candidate_events
      FROM ({RQ.LOG})""", ["events", "errors", "candidate_events"]),
    _long("steps", RQ.S["L1_step_counts"], ["n"], "step", "status"), _long("scores", RQ.S["L2_score_stats"], ["avg", "min", "max"], "metric"),
    _long("buckets", RQ.S["L3_score_buckets"], ["n", "percent"], "bucket"), _long("zero_action_object", RQ.S["L4_zero_action_object"], ["zero", "events", "percent"]),
    _long("reuse", RQ.S["L5_reuse_stats"], ["miss", "hit", "shortcut", "no_candidate"]),
    _long("corrections", RQ.S["L6_correction_rate"], ["corrected", "reviewed", "rate", "alert"]),
    _long("categories", RQ.S["L8_events_per_category"], ["n"], "category"),
    _long("stages", RQ.S["L7_stage_timing"] , ["seconds"], "stage")]


@query("K8_run_report", f"SELECT * FROM ({' UNION ALL '.join(_REPORT)}) WHERE metric <> 'stages.Reviews.seconds'")
def _(spark, d):
    return written(spark, K.run_tables(RQ.run_log(spark, d)), "report")


Q["K8_errors"], S["K8_errors"] = lambda spark, d: written(spark, K.run_tables(RQ.run_log(spark, d)), "errors"), RQ.S["L1_errors"]
Q["K8_batches"], S["K8_batches"] = lambda spark, d: written(spark, K.run_tables(RQ.run_log(spark, d)), "batches"), RQ.S["L6_batch_rows"]


def agreement(spark, d, name):
    return written(spark, K.agreement_tables(SH.saved(RQ.agent(spark, d), "agent"), SH.saved(RQ.gold(spark, d), "gold")), name)


@query("K9_agreement_detail", RQ.S["E4_differences"])
def _(spark, d):
    return agreement(spark, d, "detail")


_MEASURES = ["n", "exact", "within_one", "exact_rate", "within_rate", "over", "under", "mean_signed_error", "agent_ids", "gold_ids"]


@query("K9_agreement_metrics", " UNION ALL ".join(f"""SELECT {i} AS position, '{m}' AS metric, "{m}"::VARCHAR AS value FROM (SELECT *, (SELECT count(*) FROM ({RQ.AGENT})) AS agent_ids,
  (SELECT count(*) FROM ({RQ.GOLD})) AS gold_ids FROM ({RQ.S['E5_E6_agreement']}))""" for i, m in enumerate(_MEASURES, 1)))
def _(spark, d):
    return agreement(spark, d, "metrics")


@query("K9_one_sided", RQ.S["E7_one_sided"])
def _(spark, d):
    return agreement(spark, d, "one_sided")


# ---- stream -------------------------------------------------------------------------------------
@query("X1_log_stream", f"""SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, step, count(*) AS n, count(*) FILTER (best_combined_score < 0.4) AS low_scores,
  count(*) FILTER (cache_status = 'hit') AS hits FROM (SELECT *, date_trunc('hour', timestamp) AS w FROM ({RQ.LOG})) WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL
  10 MINUTE FROM events) GROUP BY w, step""")
def _(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    log = RQ.log_of(raw).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    out = SH.new_folder(spark, "windows") + "/t"
    XS.stream_counts(log, out, SH.new_folder(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
