"""Output tables. Each function shapes a DataFrame; `save`, `append_new` and `publish` write them as Parquet."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from mapweave.functions.labels import bucket, bucket_label
from mapweave.functions.text import display_id, gap_synthesis_and_detail
from mapweave.functions.values import first_text
from mapweave.operators import evaluate, rollup, runlog, taxonomy

MANIFEST = "run string, number long, name string, folder string, n_rows long"


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def append_new(df: DataFrame, stored: DataFrame | None, path: str, key: str = "key", order: str = "log_order") -> None:
    """Append-only keyed table: of the rows of a key the first by `order` is kept, and none if the key is stored already.

    The order column is not stored. Null keys are one key.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in rest])
    if stored is not None:
        known = stored.select(F.col(key).alias("_k")).distinct()
        first = first.join(known, F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    first.write.mode("append").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The listed tables below path: run, number of the run, name, folder and rows. Empty before the first run."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def publish(tables: dict[str, DataFrame], path: str, run: str) -> None:
    """Write the tables of a run as Parquet below path; readers see all of them or none.

    Each table goes to a new folder, and one file of the manifest lists them when all are complete: what a broken run leaves
    behind is never read. A run that is listed is not written again, so a job can be repeated.
    """
    spark = next(iter(tables.values())).sparkSession
    known = manifest(spark, path).agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"), F.coalesce(F.max(F.col("run") == run), F.lit(False)).alias("listed")).first()
    if known["listed"]:
        return
    rows = []
    for name, df in tables.items():
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{folder}")
        rows.append((run, known["last"] + 1, name, folder, spark.read.parquet(f"{path}/{folder}").count()))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/_manifest")


def published(spark: SparkSession, path: str, name: str, run: str | None = None) -> DataFrame:
    """A table of a run, the last one unless named; ValueError if it is not listed or has other rows than were written."""
    listed = manifest(spark, path).filter(F.col("name") == name)
    listed = listed.filter(F.col("run") == run) if run is not None else listed
    at = listed.agg(F.max_by(F.struct("folder", "n_rows"), F.struct("number", "run")).alias("at")).first()["at"]
    if at is None:
        raise ValueError(f"no table {name} below {path}")
    df = spark.read.parquet(f"{path}/{at['folder']}")
    if df.count() != at["n_rows"]:
        raise ValueError(f"table {name} below {path} is not whole")
    return df


def parent_table(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Display columns of parent rows; action_plan, neighbours and flags appear when present."""
    gap = gap_synthesis_and_detail(F.col("gap"))
    optional = [F.col(c) for c in ("action_plan", "neighbours") if c in rows.columns]
    flags = [F.col(c) for c in ("essential", "important") if c in rows.columns]
    return rows.select(
        F.lit(source).alias("source_regulation"), F.col("parent").alias("source_control_id"),
        F.col("source_parent_requirement").alias("source_requirement"), F.col("domain").alias("category"),
        F.lit(target).alias("target_regulation"), F.array_join("target_ids", ", ").alias("target_control_ids"),
        F.array_join("target_texts", "\n---\n").alias("target_requirements"), bucket_label(F.col("coverage_level")).alias("coverage_relationship"),
        bucket(F.col("coverage_level")).alias("coverage_level"), gap["synthesis"].alias("gap"), gap["detail"].alias("detailed_gap"),
        *optional, "review_priority", *flags)


def atomic_table(decisions: DataFrame, source: str, target: str) -> DataFrame:
    """The evidence of every decision in 18 columns; an empty object of dimension scores is shown as an empty text."""
    line = lambda c: F.concat(c["rank"].cast("string"), F.lit(". "), c["candidate_id"], F.lit(" | combined="),
                              c["combined_score"].cast("string"), F.lit(" | action_object="), c["action_object_score"].cast("string"),
                              F.lit(" | semantic="), c["semantic_score"].cast("string"), F.lit(" | gate="), c["hard_gate"])
    return decisions.select(
        F.lit(source).alias("source_regulation"), display_id(F.col("source_id")).alias("source_atomic_id"),
        display_id(F.col("source_parent_id")).alias("source_parent_id"), "source_requirement", "source_category", F.lit(target).alias("target_regulation"),
        F.array_join(F.transform("target_ids", display_id), ", ").alias("target_atomic_ids"),
        F.array_join("target_requirements", "\n---\n").alias("target_requirements"),
        rollup.atomic_relationship(F.col("coverage_level"), F.col("gap_type"), F.col("relation_type")).alias("coverage_relationship"),
        "gap_type", "coverage_level", "match_type", "dimension_scores", F.array_join("gap_dimensions", "; ").alias("gap_dimensions"),
        "gap", "recommendation", "scoring_rationale",
        F.array_join(F.transform(F.slice("candidates", 1, 5), line), "\n").alias("candidate_diagnostics"))


def category_quality_table(decisions: DataFrame, order: str = "decision_order") -> DataFrame:
    """Last decision of every display parent."""
    pid = display_id(first_text(F.col("source_parent_id"), F.col("source_id")))
    last = F.max_by(F.struct("source_category", "mapping_risk", "coverage_level"), order)
    return decisions.groupBy(pid.alias("source_control_id")).agg(last.alias("v")).select("source_control_id", "v.*")


def consolidated_table(rows: DataFrame) -> DataFrame:
    return rows.select("consolidated_id", "category", "consolidated_text", "origin", "coverage_a_to_b", "source_id_a", "source_text_a",
                       F.array_join("source_ids_b", ", ").alias("source_ids_b"), "source_text_b", "b_contribution", "gap_a_to_b")


def traceability_table(rows: DataFrame) -> DataFrame:
    return consolidated_table(rows).select("consolidated_id", "category", "origin", "coverage_a_to_b", "source_id_a", "source_ids_b")


def consolidation_summary(rows: DataFrame, source: str, target: str) -> DataFrame:
    """(position, metric, value): both frameworks, rows by origin and, if there are enriched rows, their mean coverage."""
    from_a = F.col("origin") == "A_enriched"
    n = lambda c: F.count_if(c).cast("string")
    mean = F.bround(F.avg(F.when(from_a, F.col("coverage_a_to_b")))).cast("int").cast("string")
    wide = rows.agg(
        F.lit(source).alias("source_framework_a"), F.lit(target).alias("source_framework_b"), n(F.lit(True)).alias("total"),
        n(from_a).alias("a_enriched"), n(F.col("origin") == "B_only").alias("b_only"), n(F.col("origin") == "B_supplemental").alias("b_supplemental"),
        F.concat(mean, F.lit("%")).alias("avg_coverage_a_to_b"))
    return metric_rows(wide).filter("value IS NOT NULL")


def metric_rows(wide: DataFrame, first: int = 1) -> DataFrame:
    """The columns of a table of one row as rows (position, metric, value), values as text and positions from `first`."""
    pairs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for i, c in enumerate(wide.columns, first)]
    return wide.select(F.inline(F.array(*pairs)))


def consolidated_tables(rows: DataFrame, source: str, target: str) -> dict[str, DataFrame]:
    return {"consolidated": consolidated_table(rows), "traceability": traceability_table(rows), "summary": consolidation_summary(rows, source, target)}


def category_examples(atoms: DataFrame, kind: str, n: int = 200, order: str = "order_no") -> DataFrame:
    """The first n example rows of a quality report: low confidence, changed or multi-domain atoms."""
    cond = {"low": F.col("category_confidence") < 0.60,
            "changed": (F.col("original_category") != "") & (F.col("original_category") != F.col("category")),
            "multi": (F.col("category_status") == "multi_domain") | (F.size("secondary_categories") > 0)}[kind]
    return atoms.filter(cond).orderBy(order).limit(n).select(
        "control_id", "original_category", "category", F.array_join("secondary_categories", "; ").alias("secondary"),
        "category_confidence", "category_status", "category_method")


def category_report(atoms: DataFrame, order: str = "order_no", n: int = 200) -> dict[str, DataFrame]:
    """The five tables of the category-quality report of one framework: summary, distribution and three lists of examples."""
    q = taxonomy.quality_report(atoms).select(
        F.col("framework"), F.col("total").alias("total_atoms"), F.col("low").alias("low_confidence"), F.col("medium").alias("medium_confidence"),
        F.col("changed"), F.col("multi").alias("multi_domain"), F.lit("soft_enisa").alias("recommended_match_scope"))  # fixed value: the one scope that is recommended
    counts = taxonomy.distribution(atoms).groupBy("category").agg(F.sum("atoms").alias("atoms"))
    return {"summary": metric_rows(q), "distribution": counts, **{kind: category_examples(atoms, kind, n, order) for kind in ("low", "changed", "multi")}}


def agreement_tables(agent: DataFrame, gold: DataFrame) -> dict[str, DataFrame]:
    """Agreement of both sides: every common id, the metrics as rows, and the ids of one side alone."""
    found = evaluate.compare(agent, gold)
    rows = metric_rows(evaluate.metrics(found))
    for i, (name, side) in enumerate((("agent_ids", agent), ("gold_ids", gold)), len(evaluate.METRICS) + 1):
        rows = rows.unionByName(metric_rows(side.agg(F.count(F.lit(1)).alias(name)), i))
    return {"detail": found, "metrics": rows, "one_sided": evaluate.one_sided(agent, gold)}


def run_report(log: DataFrame) -> DataFrame:
    """All run-log figures as one long (metric, value) table: events, steps, scores, buckets, zero scores, reuse, corrections,
    categories and stages. Errors and review batches, a row each, are tables of their own (`run_tables`)."""
    def long(df, prefix, *keys):
        name = F.concat_ws(".", F.lit(prefix), *keys)
        values = [c for c in df.columns if c not in keys]
        pairs = F.array(*[F.struct(F.concat_ws(".", name, F.lit(c)).alias("metric"), F.col(c).cast("string").alias("value")) for c in values])
        return df.select(F.inline(pairs))
    events = log.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == "error").alias("errors"),
                     F.count_if(F.col("step") == "candidate_generation").alias("candidate_events"))
    parts = [long(events, "summary"), long(runlog.step_counts(log), "steps", "step", "status"), long(runlog.score_stats(log), "scores", "metric"),
             long(runlog.score_buckets(log), "buckets", "bucket"), long(runlog.zero_action_object(log), "zero_action_object"),
             long(runlog.reuse_stats(log), "reuse"), long(runlog.correction_rate(log), "corrections"),
             long(runlog.events_per_category(log), "categories", "category"), long(runlog.stage_timing(log), "stages", "stage")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def run_tables(log: DataFrame) -> dict[str, DataFrame]:
    return {"report": run_report(log), "errors": runlog.errors(log), "batches": runlog.batch_rows(log)}
