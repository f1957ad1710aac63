"""Run-log analysis and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Stages reported with their first and last event.
STAGES = [("Full run", "run.start", "run.done"), ("Directional mapping", "direction_mapping.start", "direction_mapping.done"),
          ("Final judge", "final_judge.start", "final_judge.done"),
          ("Parent gap synthesis", "parent_gap_synthesis.start", "parent_gap_synthesis.done")]
SCORES = ["best_combined_score", "best_semantic_score", "best_action_object_score", "llm_candidates"]


def candidate_events(log: DataFrame) -> DataFrame:
    return log.filter(F.col("step") == "candidate_generation")


def step_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce("step", F.lit("unknown")).alias("step"), F.coalesce("status", F.lit("unknown")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"))


def errors(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status") == "error").select("timestamp", "step", "error")


def score_stats(log: DataFrame) -> DataFrame:
    """Long table (metric, avg, min, max) over the candidate events."""
    pairs = F.array(*[F.struct(F.lit(s).alias("metric"), F.col(s).cast("double").alias("v")) for s in SCORES])
    long = candidate_events(log).select(F.inline(pairs)).filter(F.col("v").isNotNull())
    return long.groupBy("metric").agg(F.round(F.avg("v"), 3).alias("avg"), F.round(F.min("v"), 3).alias("min"), F.round(F.max("v"), 3).alias("max"))


def _percent(n, total):
    return F.round(F.lit(100.0) * n / total, 1)


def score_buckets(log: DataFrame) -> DataFrame:
    s = F.col("best_combined_score")
    name = F.when(s >= 0.6, ">=0.6").when(s >= 0.5, "0.5-0.6").when(s >= 0.4, "0.4-0.5").otherwise("<0.4")
    c = candidate_events(log)
    total = c.agg(F.count(F.lit(1)).alias("_t"))
    return (c.filter(s.isNotNull()).groupBy(name.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
            .join(F.broadcast(total)).select("bucket", "n", _percent(F.col("n"), F.col("_t")).alias("percent")))  # total: one row


def zero_action_object(log: DataFrame) -> DataFrame:
    zero = F.count_if(F.col("best_action_object_score") == 0)
    return candidate_events(log).agg(zero.alias("zero"), F.count(F.lit(1)).alias("events"), _percent(zero, F.count(F.lit(1))).alias("percent"))


def reuse_stats(log: DataFrame) -> DataFrame:
    is_ = lambda *v: F.count_if(F.col("cache_status").isin(*v))
    return candidate_events(log).agg(is_("miss").alias("miss"), is_("hit").alias("hit"), is_("obvious_gap_shortcut").alias("shortcut"),
                                     is_("no_candidate_pool", "no_candidate_after_threshold").alias("no_candidate"))


def correction_rate(log: DataFrame, order: str = "line_no") -> DataFrame:
    """Corrected decisions over reviewed ones; the first final event counts, else the sum over batches."""
    done, batch = F.col("step") == "final_judge.done", F.col("step") == "final_judge.category_batch"
    n = log.agg(F.min_by(F.when(done, F.coalesce("corrections", F.lit(0))), F.when(done, F.col(order))).alias("_d"),
                F.sum(F.when(batch, F.coalesce("corrections", F.lit(0)))).alias("_b"),
                F.coalesce(F.sum(F.when(batch, F.coalesce("items", F.lit(0)))), F.lit(0)).alias("reviewed"))
    corrected = F.coalesce("_d", "_b", F.lit(0)).cast("long")
    rate = F.when(F.col("reviewed") > 0, F.lit(100.0) * corrected / F.col("reviewed"))
    return n.select(corrected.alias("corrected"), "reviewed", F.round(rate, 1).alias("rate"), F.coalesce(rate > 35, F.lit(False)).alias("alert"))


def batch_rows(log: DataFrame) -> DataFrame:
    b = log.filter(F.col("step") == "final_judge.category_batch")
    return b.select("category", "batch", "corrections", "items", (F.col("corrections") > F.col("items")).alias("exceeds"))


def stage_timing(log: DataFrame, order: str = "line_no", stages=STAGES) -> DataFrame:
    """Seconds between the last start and the last end of each stage; negative spans are left out."""
    rows = []
    last = {}
    for _, start, end in stages:
        for step in (start, end):
            if step not in last:
                last[step] = f"t{len(last)}"
                hit = F.col("step") == step
                rows.append(F.max_by(F.when(hit, F.col("timestamp")), F.when(hit, F.col(order))).alias(last[step]))
    wide = log.agg(*rows)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = F.array(*[F.struct(F.lit(label).alias("stage"), ((micros(last[e]) - micros(last[s])) / 1e6).alias("seconds"))
                      for label, s, e in stages])
    return wide.select(F.inline(spans)).filter(F.col("seconds") >= 0).withColumn("seconds", F.round("seconds", 3))


def events_per_category(log: DataFrame) -> DataFrame:
    return candidate_events(log).groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def usage_totals(usage: DataFrame) -> DataFrame:
    name = F.when(F.coalesce("model", F.lit("")) == "", "unknown").otherwise(F.col("model"))
    return usage.groupBy(name.alias("model")).agg(F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
                                                  F.sum("output_tokens").alias("output_tokens"))


def match_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Longest price key contained in the model name, ignoring case; no match costs nothing.

    A name is spread into its parts, so keys are found by an equi-join whatever the number of prices; the number of parts is
    bounded by the length of a name.
    """
    k = prices.select(F.lower("model").alias("_part"), F.col("model").alias("_key"), "input", "output", F.col("pos").alias("_pos"))
    names = models.select(F.col("model").alias("_name")).distinct().where("_name <> ''")
    low = F.lower("_name")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.transform(
        F.sequence(F.lit(1), F.length(low) - i + 1), lambda n: F.substring(low, i, n))))
    found = names.select("_name", F.explode(F.array_distinct(parts)).alias("_part")).join(k, "_part")
    best = found.groupBy("_name").agg(F.min_by(F.struct("input", "output"), F.struct(-F.length("_key"), "_pos")).alias("_best"))
    j = models.join(best, F.col("model") == F.col("_name"), "left")
    return j.select(*models.columns, F.coalesce("_best.input", F.lit(0.0)).alias("input_price"),
                    F.coalesce("_best.output", F.lit(0.0)).alias("output_price"))


def costs(priced: DataFrame) -> DataFrame:
    """Cost per model and in total (model '(total)'), four digits."""
    c = priced.withColumn("_c", F.col("input_tokens") / 1e6 * F.col("input_price") + F.col("output_tokens") / 1e6 * F.col("output_price"))
    rows = c.select("model", F.round("_c", 4).alias("cost_usd"))
    return rows.unionByName(c.agg(F.lit("(total)").alias("model"), F.round(F.sum("_c"), 4).alias("cost_usd")))
