"""What surrounds the search: pool sizes, candidate payloads, guideline passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mapweave.operators.search import search
from mapweave.operators.similarity import with_features
from mapweave.params import DEFAULTS, GLOBAL_SCOPES, Params
from mapweave.sources.shared import saved

GUIDELINE = Params(weight_semantic=1.0, weight_structured=0.0, weight_action_object=0.0, weight_control_type=0.0,
                   weight_category_prior=0.0, use_structured=False, use_rrf=False, affinity_enabled=False,
                   min_combined=0.0, top_k=3, review_top_k=3)


def pool_sizes(sources: DataFrame, targets: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Scope, scope key and pool size of every source, without forming a pair.

    Targets are first counted per distinct key list. Only key lists, never atoms, are matched with each other,
    so a category holding a third of all rows still costs one row per list.
    """
    total = targets.agg(F.count(F.lit(1)).alias("_total"))
    if p.match_scope in GLOBAL_SCOPES:
        return sources.select("atomic_id").join(F.broadcast(total)).select(  # total is a single row
            "atomic_id", F.lit(p.match_scope).alias("scope"), F.lit("global_pool_with_category_prior").alias("scope_key"),
            F.col("_total").alias("pool_size"))
    lists = targets.groupBy("keys").agg(F.count(F.lit(1)).alias("_n"))
    source_lists = sources.select("keys").distinct().withColumnRenamed("keys", "_sk")
    per_key = lists.select("keys", "_n", F.explode("keys").alias("_key"))
    matched = (source_lists.select("_sk", F.explode("_sk").alias("_key")).join(per_key, "_key")
               .select("_sk", "keys", "_n").distinct().groupBy("_sk").agg(F.sum("_n").alias("_pool")))
    j = sources.join(matched, F.col("keys") == F.col("_sk"), "left").join(F.broadcast(total))
    none = F.size("keys") == 0
    return j.select(
        "atomic_id", F.when(none, "all").otherwise("enisa_category").alias("scope"),
        F.when(none, "no_category").otherwise(F.array_join("keys", ";")).alias("scope_key"),
        F.when(none, F.col("_total")).otherwise(F.coalesce("_pool", F.lit(0))).alias("pool_size"))


SCORES = ["semantic_score", "keyword_score", "structured_score", "action_object_score", "control_type_score",
          "category_prior_score", "combined_score"]


def likely(df: DataFrame, key: str, wanted: DataFrame, bits: int = 23) -> DataFrame:
    """The rows of df whose key is in wanted (one column), and a few others. A filter of 2**bits bits is sent to all tasks
    (2**(bits - 6) rows at most, whatever the number of keys); no row of df is shuffled."""
    def spots(c):
        at = F.pmod(F.xxhash64(c), F.lit(1 << bits))
        return F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")

    word, bit = spots(F.col(wanted.columns[0]))
    words = wanted.select(word.alias("_word"), F.expr("1L").alias("_one"), bit.alias("_bit")).groupBy("_word").agg(
        F.bit_or(F.call_function("shiftleft", "_one", "_bit")).alias("_bits"))
    word, bit = spots(F.col(key))
    found = df.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word")
    return found.where(F.call_function("getbit", "_bits", "_bit") == 1).select(*df.columns)


def payloads(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: its candidates in rank order as an array of structs, scores to four digits.

    The array holds the candidates of the review cut and the injected ones only, so its length is bounded by the parameters.
    Target texts join here, after the cut; only those of likely() candidates are shuffled for it, since a text carries its parent's.
    """
    candidates = saved(candidates.where("in_review"), "payload")
    t = likely(targets, "atomic_id", candidates.select("candidate_id")).select(F.col("atomic_id").alias("candidate_id"), "parent_id",
                       F.col("atomic_requirement").alias("requirement"), "parent_requirement", "category")
    entry = F.struct("rank", "candidate_id", "parent_id", "requirement", "parent_requirement", "category",
                     *[F.round(s, 4).alias(s) for s in SCORES], "hard_gate",
                     F.col("injected").alias("affinity_injected"))
    return candidates.join(t, "candidate_id").groupBy("source_id").agg(
        F.array_sort(F.collect_list(entry)).alias("candidates"))


def guideline_passages(queries: DataFrame, chunks: DataFrame, p: Params = GUIDELINE) -> DataFrame:
    """Best passages per query vector by cosine. Both sides: atomic_id, order_no, embedding."""
    def bare(df):
        empty = F.lit("")
        fields = F.struct(*[empty.alias(n) for n in ("domain", "actor", "action", "object", "condition", "deadline",
                                                     "evidence", "obligation_type", "control_type")])
        return with_features(df.select(
            "atomic_id", "order_no", "embedding", empty.alias("parent_id"), empty.alias("category"),
            empty.alias("primary_category"), F.array().cast("array<string>").alias("secondary_categories"),
            F.lit(0.0).alias("category_confidence"), empty.alias("category_status"),
            empty.alias("atomic_requirement"), fields.alias("fields")), p)
    return search(bare(queries), bare(chunks), p).select(
        "source_id", "candidate_id", F.col("combined_score").alias("cosine"), "rank")
