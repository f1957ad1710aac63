"""Coverage decisions: from candidates or supplied judgements, then the ordered correction rules.

A decision is one row. Rules are projections: each stage reads the columns left by the one before it, so
Spark keeps them as consecutive projects inside one stage and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, functions as F

from mapweave.functions import labels as L
from mapweave.functions.text import split_list
from mapweave.functions.values import (GAP_ITEM, first_text, gap_items, number_to_int,
                                       tolerant_float, tolerant_int,
                                       tri_bool)
from mapweave.operators.ranking import position_rank
from mapweave.operators.rules import TEXTS, append, correct, fold, gap_item, none, state_of, two_digits, with_state  # noqa: F401
from mapweave.params import DEFAULTS, Params

CANDIDATE = ("struct<candidate_id:string,parent_id:string,requirement:string,parent_requirement:string,"
             "semantic_score:double,structured_score:double,action_object_score:double,category_prior_score:double,"
             "combined_score:double,hard_gate:string,rank:int>")
# Texts that later stages and readers recognise.
NO_POOL = "No candidate for scope "
BELOW_THRESHOLD = "No candidate passed the combined score threshold"
OBVIOUS_GAP = "Obvious Gap shortcut: best retrieval scores are below safe thresholds."
LOW_SCORE = "Low deterministic combined score"
FAILED_PREFIX = "LLM evaluation failed"
FAILED = FAILED_PREFIX + "; deterministic heuristic fallback used. Manual review required."
MOSTLY = "Mostly covered by deterministic scoring, but not validated as an exact equivalence."
PARTLY = "The candidate covers part of the obligation but misses material elements."
STALE_REMOVED = ("Stale target references were removed because they are not present in the current target framework "
                 "input.")
STALE_GAP = ("Stale target references were removed; no selected target exists in the current target framework input.")


def put(df: DataFrame, cond: Column, **values) -> DataFrame:
    """Overwrite columns where cond holds; all new values see the old row."""
    cols = {}
    for name, v in values.items():
        v = v if isinstance(v, Column) else F.lit(v)
        # the DDL form leaves array elements nullable, which a plain schema type may forbid
        cols[name] = F.when(cond, v.cast(df.schema[name].dataType.simpleString())).otherwise(F.col(name))
    return df.withColumns(cols)


# ---- first decisions ----------------------------------------------------------------------------
def is_obvious_gap(best: Column, p: Params) -> Column:
    if not p.obvious_gap_enabled:
        return F.lit(False)
    return ((best["combined_score"] < p.obvious_gap_combined) & (best["semantic_score"] < p.obvious_gap_semantic)
            & (best["action_object_score"] < p.obvious_gap_action_object))


def decide(sources: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Sources with their candidate array (rank order; null or empty when none) -> one decision each.

    Columns read: source_id, candidates and, when present, pool_size (0 means the scope had no target).
    """
    cands = F.coalesce(F.col("candidates"), none(sources.schema["candidates"].dataType.simpleString()))
    pool = F.col("pool_size") if "pool_size" in sources.columns else F.lit(1)
    df = sources.withColumn("candidates", cands).withColumn("_b", F.try_element_at("candidates", F.lit(1)))
    combined, ao = F.col("_b.combined_score"), F.col("_b.action_object_score")
    gap_reason = (F.when(pool == 0, NO_POOL + p.match_scope).when(F.size("candidates") == 0, BELOW_THRESHOLD)
                  .when(is_obvious_gap(F.col("_b"), p), OBVIOUS_GAP)
                  .when(combined < 0.45, LOW_SCORE))
    df = df.withColumn("_gap", gap_reason).withColumn(
        "_cov", F.when(F.col("_gap").isNotNull(), 0).when((combined >= 0.72) & (ao >= p.gate_cap75), 80).otherwise(50))
    gap, is_gap = F.col("_gap"), F.col("_gap").isNotNull()
    text = F.when(is_gap, gap).when(F.col("_cov") == 80, MOSTLY).otherwise(PARTLY)
    target = lambda name: F.when(is_gap, none()).otherwise(F.array(F.col(f"_b.{name}")))
    keep = [c for c in sources.columns if c not in ("candidates", "pool_size")]
    return df.select(
        *keep, "candidates", target("candidate_id").alias("selected_ids"), target("candidate_id").alias("target_ids"),
        target("requirement").alias("target_requirements"), target("parent_id").alias("target_parent_ids"),
        target("parent_requirement").alias("target_parent_requirements"),
        F.when(is_gap, "true_gap").otherwise("partial").alias("relation_type"),
        F.when(is_gap, "Gap").otherwise("Partial").alias("equivalence_level"), F.col("_cov").alias("coverage_level"),
        F.when(is_gap, "true_gap").otherwise("partial_gap").alias("gap_type"),
        F.when(is_gap, "None").otherwise("Direct").alias("match_type"),
        F.when(is_gap, 1.0).otherwise(0.45).alias("confidence"),
        F.when(is_gap, gap).otherwise("Deterministic fallback decision based on combined semantic, keyword, structured "
                                      "and action/object scores.").alias("justification"),
        text.alias("gap"),
        F.array(gap_item("explicitness", text, F.when(is_gap, "material").otherwise("moderate"),
                         F.when(is_gap, "No sufficient selected target candidate.")
                         .otherwise("Deterministic heuristic only."))).alias("gap_items"),
        F.lit("").alias("combine_controls"),
        F.when(is_gap, "No sufficient match passed retrieval and judging. In soft_enisa mode, category does not block "
                       "global fallback.")
        .otherwise("Review manually before relying on deterministic fallback output.").alias("recommendation"),
        F.when(is_gap, "High").otherwise("Medium").alias("mapping_risk"),
        F.when(is_gap, "No candidate passed the retrieval/scope gates.").otherwise(F.concat(
            F.lit("combined="), two_digits(combined), F.lit("; action_object="), two_digits(ao))).alias("scoring_rationale"),
        F.lit(None).cast("boolean").alias("same_functional_domain"), F.lit("").alias("b_contribution"),
        none().alias("gap_dimensions"), F.lit("").alias("dimension_scores"))


JUDGEMENT = ("struct<selected_candidate_ids:string,relation_type:string,equivalence_level:string,coverage_level:string,"
             "match_type:string,confidence:string,justification:string,gap:string,gap_type:string,"
             "gap_classification:string,gap_items:string,residual_gaps:string,gap_dimensions:string,"
             "mapping_risk:string,scoring_rationale:string,same_functional_domain:string,combine_controls:string,"
             "recommendation:string,b_contribution:string,dimension_scores:string>")


def id_list(c: Column) -> Column:
    """JSON list or comma string -> array of ids."""
    listed = F.from_json(c, TEXTS)
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.coalesce(listed, none())).otherwise(split_list(c))


def selected_targets(candidates: Column, ids: Column) -> dict[str, Column]:
    """Target columns for selected ids, looked up in the candidate array; parents distinct in order."""
    chosen = F.transform(ids, lambda i: F.filter(candidates, lambda c: c["candidate_id"] == i)[0])
    distinct = lambda f: F.array_distinct(F.filter(F.transform(chosen, f), lambda x: x != ""))
    return {
        "selected_ids": ids, "target_ids": ids,
        "target_requirements": F.transform(chosen, lambda c: F.coalesce(c["requirement"], F.lit(""))),
        "target_parent_ids": distinct(lambda c: first_text(c["parent_id"], c["candidate_id"])),
        "target_parent_requirements": distinct(lambda c: first_text(c["parent_requirement"], c["requirement"])),
    }


def decisions_from_judgements(sources: DataFrame, judgements: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Supplied judgement JSON (source_id, judgement) -> decisions; only ids among the candidates are kept.

    A source whose judgement is missing or unreadable gets the heuristic decision, capped and flagged.
    """
    # sources without candidates never reach the judge; known before the join, so that candidates nobody reads are not sent
    asked = (F.size("candidates") > 0) & ~is_obvious_gap(F.try_element_at("candidates", F.lit(1)), p)
    df = decide(sources, p).withColumn("_asked", asked).join(judgements.select("source_id", "judgement"), "source_id", "left")
    asked, read = F.col("_asked"), F.when(F.col("_asked"), F.col("judgement"))
    # one reading tells the fields and whether it is an object with a member at all: what is none is kept in _unread
    df = df.withColumn("j", F.from_json(read, f"{JUDGEMENT[:-1]},_unread:string>", {"columnNameOfCorruptRecord": "_unread"}))
    j = F.col("j")
    text = lambda n, d="": F.when(first_text(j[n]) == "", F.lit(d)).otherwise(j[n])
    ok = j.isNotNull() & j["_unread"].isNull() & read.rlike(r"^[ \t\r\n]*\{[ \t\r\n]*[\"']")
    candidate_ids = F.transform("candidates", lambda c: c["candidate_id"])
    ids = F.filter(id_list(F.coalesce(j["selected_candidate_ids"], F.lit(""))), lambda i: F.array_contains(candidate_ids, i))
    # a JSON number is truncated, a number written as text is rounded
    quoted = F.col("judgement").rlike(r'"coverage_level"\s*:\s*"')
    cov = F.when(quoted, tolerant_int(j["coverage_level"])).otherwise(number_to_int(j["coverage_level"].try_cast("double")))
    gaps = first_text(F.when(j["gap_items"] != "[]", j["gap_items"]), j["residual_gaps"])
    kind = first_text(j["gap_type"], j["gap_classification"])
    judged = {
        **selected_targets(F.col("candidates"), ids),
        "relation_type": text("relation_type", "gap"), "equivalence_level": text("equivalence_level", "Gap"),
        "coverage_level": cov, "match_type": text("match_type", "None"), "confidence": tolerant_float(j["confidence"]),
        "justification": text("justification"), "gap": text("gap"),
        "gap_type": L.gap_type(kind, cov, F.coalesce(j["relation_type"], F.lit(""))),
        "combine_controls": text("combine_controls"), "recommendation": text("recommendation"),
        "gap_items": gap_items(gaps), "mapping_risk": text("mapping_risk"),
        "scoring_rationale": text("scoring_rationale"), "same_functional_domain": tri_bool(j["same_functional_domain"]),
        "b_contribution": text("b_contribution"), "gap_dimensions": id_list(F.coalesce(j["gap_dimensions"], F.lit(""))),
        # the JSON text of an object; anything else, and an empty object, counts as none
        "dimension_scores": F.when(j["dimension_scores"].rlike(r"^\{[^}]"), j["dimension_scores"]).otherwise(""),
    }
    df = df.withColumns({"_judged": asked & ok, "_failed": asked & ~ok})
    error = F.when(F.col("judgement").isNull(), "MissingJudgement").otherwise("UnreadableJudgement")
    df = df.withColumn("fallback_error", F.when(F.col("_failed"), error).otherwise(""))
    df = put(df, F.col("_judged"), **judged)
    high = F.col("_failed") & (F.col("coverage_level") > 50)
    df = put(df, high, equivalence_level="Partial", confidence=F.least("confidence", F.lit(0.45)), coverage_level=50)
    df = put(df, F.col("_failed"), justification=FAILED,
             scoring_rationale=F.concat(F.lit("fallback_error="), "fallback_error"),
             recommendation="Manual review required. Technical API details are available in logs.")
    return df.drop("judgement", "j", "_asked", "_judged", "_failed")


def fallback_counts(decisions: DataFrame) -> DataFrame:
    return (decisions.filter(F.startswith("justification", F.lit(FAILED_PREFIX)))
            .groupBy(F.col("fallback_error").alias("error")).agg(F.count(F.lit(1)).alias("n_decisions")))


def reevaluate(first: DataFrame, second: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Below the confidence threshold a second decision replaces the first when it is at least as confident."""
    rest = [c for c in first.columns if c != "source_id"]
    # columns, not one struct: what nobody reads is neither computed nor sent for the second decision
    two = second.select("source_id", *[F.col(c).alias(f"_second_{c}") for c in rest])
    j = first.join(two, "source_id", "left")
    take = (F.col("confidence") < p.reevaluate_below) & (F.col("_second_confidence") >= F.col("confidence"))
    return j.select("source_id", *[F.when(take, F.col(f"_second_{c}")).otherwise(F.col(c)).alias(c) for c in rest])


# ---- review -------------------------------------------------------------------------------------
def review_selection(decisions: DataFrame, p: Params = DEFAULTS, order: str = "decision_order") -> DataFrame:
    """Decisions to review with their batch number per category; ranks stay balanced for a huge category."""
    df = decisions
    if p.review_only_ambiguous:
        df = df.filter(~((F.col("confidence") >= p.review_confidence) & (F.col("coverage_level") > 50)))
    ranked = position_rank(df, ["source_category"], order, "_n")
    return ranked.withColumn("batch_no", F.ceil(F.col("_n") / F.lit(p.review_batch)).cast("long")).drop("_n")


def review_batches(selected: DataFrame) -> DataFrame:
    name = F.when(F.col("source_category") == "", "Uncategorized").otherwise(F.col("source_category"))
    return selected.groupBy(name.alias("category"), "batch_no").agg(F.count(F.lit(1)).alias("n_decisions"))


def review_candidates(candidates: Column, n: int = 10, chars: int = 240) -> Column:
    """The n candidates shown to a reviewer, by combined score (earlier first among equals), texts shortened."""
    keyed = F.array_sort(F.transform(candidates, lambda c, i: F.struct(
        (-F.coalesce(c["combined_score"], F.lit(0.0))).alias("k"), i.alias("i"), c.alias("c"))))
    return F.transform(F.slice(keyed, 1, n), lambda x: F.struct(
        x["c"]["candidate_id"].alias("candidate_id"), x["c"]["parent_id"].alias("parent_id"),
        F.substring(F.coalesce(x["c"]["requirement"], F.lit("")), 1, chars).alias("requirement")))


OVERWRITABLE = ["relation_type", "equivalence_level", "match_type", "gap_type", "justification", "gap",
                "combine_controls", "recommendation", "mapping_risk", "scoring_rationale"]


def _whole(text: Column) -> Column:
    """Number text cut to an integer; null for other text and for numbers no level can have."""
    x = text.try_cast("double")
    return F.when(F.abs(x) < 1e6, x).cast("int")


def corrected(s, c: Column) -> dict[str, Column]:
    """The fields that one correction changes; empty and unreadable ones change nothing."""
    shown = F.transform(s("candidates"), lambda x: x["candidate_id"])
    ids = F.filter(c["ids"], lambda i: F.array_contains(shown, i))
    targets = {n: F.when(F.size(ids) > 0, v).otherwise(s(n)) for n, v in selected_targets(s("candidates"), ids).items()}
    return {**{n: F.when(c[n] != "", c[n]).otherwise(s(n)) for n in OVERWRITABLE}, **targets,
            **{n: F.coalesce(c[n], s(n)) for n in ("coverage_level", "confidence", "gap_items")}}


def apply_corrections(decisions: DataFrame, corrections: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Supplied corrections (source_id, batch_no, position, correction JSON) on top of decisions.

    The corrections of a decision apply one after another by batch and position, and after each the rules run without the
    action/object cap, so a later one sees what the rules made of the earlier. Unreadable corrections count as none; the last
    readable one is kept in review_notes. Untouched rows pass unchanged. The corrections of one decision, a row each time it
    is reviewed, meet in one array.
    """
    read = F.from_json("correction", "map<string,string>")
    value = lambda n: first_text(F.col("_c")[n], F.col("_c")[f"corrected_{n}"])
    items = first_text(F.col("_c")["gap_items"], F.col("_c")["residual_gaps"])
    one = F.struct(
        "batch_no", "position", *[value(n).alias(n) for n in OVERWRITABLE], _whole(value("coverage_level")).alias("coverage_level"),
        value("confidence").try_cast("double").alias("confidence"), F.when(F.startswith(F.trim(items), F.lit("[")), gap_items(items)).alias("gap_items"),
        id_list(first_text(value("selected_candidate_ids"), value("target_ids"))).alias("ids"), "correction")
    ordered = corrections.withColumn("_c", read).filter(F.col("_c").isNotNull()).select("source_id", one.alias("_one")).groupBy("source_id").agg(
        F.array_sort(F.collect_list("_one")).alias("_all"))
    hit = F.col("_all").isNotNull()
    j = decisions.join(ordered, "source_id", "left").withColumn("review_notes", F.try_element_at("_all", F.lit(-1))["correction"])
    if "pre_review_coverage" not in decisions.columns:
        j = j.withColumn("pre_review_coverage", F.lit(None).cast("int"))
    j = put(j, hit, pre_review_coverage=F.coalesce("pre_review_coverage", "coverage_level"))
    state = fold(state_of(j.columns), F.col("_all"), corrected, p, cap=False)
    keep = decisions.columns + [c for c in ("pre_review_coverage", "review_notes") if c not in decisions.columns]
    return with_state(j, state, hit).select(*keep)


LAYOUT = ("target_block_rows", "source_block_rows", "max_pivots")


# ---- reuse and referential check -----------------------------------------------------------------
def decision_key(p: Params, *content: Column) -> Column:
    """Key of everything a decision depends on: source, candidates with their scores, and the parameters.

    The full SHA-256, since a shared key reuses a wrong decision. Parameters of layout alone do not enter.
    """
    told = {f.name: getattr(p, f.name) for f in fields(p) if f.name not in LAYOUT}
    return F.sha2(F.to_json(F.struct(F.lit(repr(told)), *content), {"ignoreNullFields": "false"}), 256)


def reuse(requests: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the stored decision, misses) by key; the first decision stored under a key counts."""
    first = stored.groupBy("key").agg(F.min_by("decision", "stored_order").alias("decision"))
    return requests.join(first, "key"), requests.join(first, "key", "left_anti")


def storable(decisions: DataFrame, stored: DataFrame) -> DataFrame:
    """New decisions worth keeping: unknown key and no fallback."""
    fresh = decisions.filter(~F.startswith("justification", F.lit(FAILED_PREFIX)))
    return fresh.join(stored.select("key").distinct(), "key", "left_anti")


def invalid_targets(decisions: DataFrame, target_atoms: DataFrame) -> DataFrame:
    """(source_id, bad_target_ids, bad_parent_ids) for ids that are not in the current target table."""
    atoms = target_atoms.select(F.col("atomic_id").alias("id"), F.lit("atom").alias("kind"))
    known = atoms.union(target_atoms.select("parent_id", F.lit("parent"))).distinct()
    used = (decisions.select("source_id", F.explode("target_ids").alias("id"), F.lit("atom").alias("use"))
            .union(decisions.select("source_id", F.explode("target_parent_ids"), F.lit("parent"))))
    # ids are made distinct first, so a target that a third of all decisions point to is looked up once
    fits = (F.col("u.id") == F.col("k.id")) & ((F.col("use") == "parent") | (F.col("kind") == "atom"))
    unknown = used.select("id", "use").distinct().alias("u").join(known.alias("k"), fits, "left_anti")
    bad = used.join(unknown, ["id", "use"])
    pick = lambda use: F.array_sort(F.collect_set(F.when(F.col("use") == use, F.col("id"))))
    return bad.groupBy("source_id").agg(pick("atom").alias("bad_target_ids"), pick("parent").alias("bad_parent_ids"))


def check_targets(decisions: DataFrame, target_atoms: DataFrame, policy: str = DEFAULTS.invalid_target_policy) -> DataFrame:
    """Apply the invalid-target policy: raise, or (drop / sanitize / convert_to_gap) remove stale references."""
    bad = invalid_targets(decisions, target_atoms)
    if policy == "raise":
        n = bad.count()
        if n:
            raise ValueError(f"{n} decisions point to unknown targets, e.g. {bad.limit(3).collect()}")
        return decisions
    parents = target_atoms.select(F.col("parent_id").alias("id")).distinct()
    wrong_parent = (decisions.select("source_id", F.explode("target_parent_ids").alias("id")).join(parents, "id", "left_anti")
                    .groupBy("source_id").agg(F.collect_set("id").alias("_wp")))
    j = decisions.join(bad.select("source_id", F.col("bad_target_ids").alias("_bad")), "source_id", "left").join(
        wrong_parent, "source_id", "left")
    stale = F.coalesce(F.size("_bad") > 0, F.lit(False))
    pairs = F.filter(F.arrays_zip("target_ids", "target_requirements"), lambda x: ~F.array_contains("_bad", x["target_ids"]))
    j = j.withColumn("_ok", F.when(stale, pairs))
    part, gone = stale & (F.size("_ok") > 0), stale & (F.size("_ok") == 0)
    ids = F.transform("_ok", lambda x: x["target_ids"])
    j = put(j, part, selected_ids=ids, target_ids=ids,
            target_requirements=F.transform("_ok", lambda x: F.coalesce(x["target_requirements"], F.lit(""))),
            target_parent_ids=F.filter("target_parent_ids", lambda x: ~F.array_contains(F.coalesce("_wp", none()), x)),
            mapping_risk="High",
            gap=append(F.col("gap"), STALE_REMOVED))
    j = put(j, gone, selected_ids=none(), target_ids=none(), target_requirements=none(), target_parent_ids=none(),
            target_parent_requirements=none(), coverage_level=0, equivalence_level="Gap", relation_type="true_gap",
            gap_type="true_gap", match_type="None", mapping_risk="High", gap=STALE_GAP)
    return j.drop("_bad", "_wp", "_ok")


