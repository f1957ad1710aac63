"""Gap items of parents: collection, near-duplicate removal, summaries, supplied syntheses, action plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mapweave.functions import labels as L
from mapweave.functions.text import (casefold, clean_gap_sentence, clean_sentence, format_actions, gap_points, gap_tokens, is_generic_gap)
from mapweave.functions.values import first_text
from mapweave.operators.rollup import parent_relationship, report_gap_type, with_parent
from mapweave.operators.search import checkpointed

NEAR_DUPLICATE, KEY_TOKENS, SYNTHESIS_KEY_TOKENS = 0.78, 16, 18


def collect_gap_items(decisions: DataFrame) -> DataFrame:
    """One row per gap item of a decision below 100: structured items, or else points split from the text.

    `item_order` sorts by coverage, source id and position inside the decision.
    """
    d = with_parent(decisions).filter(F.col("coverage_level") < 100)
    items = F.transform(F.filter("gap_items", lambda g: (F.trim(g["gap"]) != "") & ~is_generic_gap(g["gap"])), lambda g: F.struct(
        L.dimension(first_text(g["dimension"], F.lit("explicitness"))).alias("dimension"), clean_gap_sentence(F.trim(g["gap"])).alias("gap"),
        L.severity(g["severity"]).alias("severity")))
    dims = F.col("gap_dimensions") if "gap_dimensions" in d.columns else F.array().cast("array<string>")
    points = F.transform(gap_points(F.col("gap")), lambda t: F.struct(
        L.infer_dimension(t, dims).alias("dimension"), t.alias("gap"), L.severity_from_coverage(F.col("coverage_level")).alias("severity")))
    chosen = F.when(F.size("gap_items") > 0, items).otherwise(points)
    return d.select("parent", F.col("coverage_level").alias("_c"), F.col("source_id").alias("_s"), F.posexplode(chosen).alias("_i", "g")).select(
        "parent", F.struct("_c", "_s", "_i").alias("item_order"), "g.dimension", "g.gap", "g.severity").filter(F.col("gap") != "")


def drop_near_duplicates(items: DataFrame, group: list[str] = ("parent", "dimension"), order: str = "item_order") -> DataFrame:
    """Greedy in item order: an item goes when an earlier kept item has its key or at least 78 % equal tokens.

    Equal texts collapse first. Remaining items meet only on tokens of their rarest-first prefix (two sets that
    similar must share one) and with a similar size. Kept and dropped items then settle in rounds: an item is kept
    once no earlier rival is open, and it drops its later rivals. No group is gathered in one task.
    """
    g = list(group)
    firsts = items.groupBy(*g, "gap").agg(F.min_by(F.struct(order, "severity"), order).alias("_f"))
    rows = firsts.select(*g, "gap", F.col(f"_f.{order}").alias(order), "_f.severity").withColumn("_t", F.array_distinct(gap_tokens(F.col("gap"))))
    key = F.array_join(F.slice(gap_tokens(F.col("gap")), 1, KEY_TOKENS), " ")
    rows = checkpointed(rows.withColumns({"_key": key, "_id": F.md5(F.to_json(F.struct(*g, "gap"))), "_n": F.size("_t")}))
    freq = rows.select(*g, F.explode("_t").alias("tok")).groupBy(*g, "tok").agg(F.count(F.lit(1)).alias("_df"))
    sorted_tokens = (rows.select(*g, "_id", "_n", F.explode("_t").alias("tok")).join(freq, [*g, "tok"])
                     .groupBy(*g, "_id", "_n").agg(F.array_sort(F.collect_list(F.struct("_df", "tok"))).alias("_o")))
    keep = F.col("_n") - F.ceil(F.col("_n") * NEAR_DUPLICATE - 1e-9).cast("int") + 1
    prefix = sorted_tokens.select(*g, "_id", F.explode(F.slice("_o", F.lit(1), keep)).alias("_p")).select(*g, "_id", F.col("_p.tok").alias("tok"))
    left = prefix.join(rows.select("_id", "_t", "_n", order), "_id")
    right = left.select(*g, "tok", *[F.col(c).alias(f"r{c}") for c in ("_id", "_t", "_n", order)])
    inter = F.size(F.array_intersect("_t", "r_t"))
    near = inter / (F.col("_n") + F.col("r_n") - inter) >= NEAR_DUPLICATE
    sized = (F.col("r_n") >= F.col("_n") * NEAR_DUPLICATE - 1e-9) & (F.col("_n") >= F.col("r_n") * NEAR_DUPLICATE - 1e-9)
    edges = left.join(right, [*g, "tok"]).filter((F.col(order) < F.col(f"r{order}")) & sized & near).select(
        F.col("_id").alias("a"), F.col("r_id").alias("b")).distinct()
    edges = checkpointed(edges)
    open_ = rows.select("_id", *g, "_key", order)
    kept = None
    while True:
        # first open item of every key, and items without an earlier open rival
        heads = open_.groupBy(*g, "_key").agg(F.min_by("_id", order).alias("_id")).select("_id")
        blocked = edges.join(open_.select(F.col("_id").alias("a")), "a", "left_semi").select(F.col("b").alias("_id")).distinct()
        new = checkpointed(heads.join(blocked, "_id", "left_anti"))
        if new.limit(1).count() == 0:
            break
        kept = new if kept is None else kept.unionByName(new)
        same_key = new.join(rows.select("_id", *g, "_key"), "_id").select(*g, "_key").distinct()
        rivals = edges.join(new.select(F.col("_id").alias("a")), "a", "left_semi").select(F.col("b").alias("_id")).distinct()
        open_ = checkpointed(open_.join(same_key, [*g, "_key"], "left_anti").join(rivals, "_id", "left_anti"))
    survivors = rows.join(kept, "_id", "left_semi") if kept is not None else rows.filter(F.lit(False))
    return survivors.select(*g, "gap", "severity", order)


def drop_equal_keys(items: DataFrame, group: str = "parent", order: str = "item_order") -> DataFrame:
    """Synthesis variant: the first item per dimension and first 18 words of three letters or more."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.replace(casefold(F.col("gap")), F.lit("."), F.lit(" ")), r"\s+", " ")), " "),
                     lambda w: F.length(w) > 2)
    keyed = items.withColumn("_k", F.array_join(F.slice(words, 1, SYNTHESIS_KEY_TOKENS), " "))
    rest = [c for c in items.columns if c not in (group, "dimension")]
    return keyed.groupBy(group, "dimension", "_k").agg(F.min_by(F.struct(*rest), order).alias("_v")).select(
        group, "dimension", *[F.col(f"_v.{c}").alias(c) for c in rest])


# The texts below are results that are compared as they stand.
def synthesis_sentence(relationship: Column, coverage: Column, target: str, n_substantive: Column) -> Column:
    t = F.lit(target)
    return (F.when((coverage <= 0) | (relationship == "Not covered"), F.concat(t, F.lit(
        " does not identify a direct equivalent obligation for the source requirement.")))
        .when(relationship == "Indirectly covered", F.concat(t, F.lit(
            " provides related or supportive provisions, but they do not establish equivalent direct coverage.")))
        .when(relationship == "Partially covered", F.concat(t, F.lit(" partially covers the source requirement, with "),
                                                            n_substantive.cast("string"), F.lit(" substantive residual difference(s).")))
        .when(relationship == "Mostly covered", F.concat(t, F.lit(
            " mostly covers the source requirement, with residual differences requiring interpretation or complementary evidence.")))
        .otherwise(F.concat(t, F.lit(" covers the main objective, but residual differences remain."))))


def full_coverage_sentence(target: str) -> str:
    return f"{target} fully covers this requirement."


def summaries(aggregates: DataFrame, items: DataFrame, target: str) -> DataFrame:
    """(parent, gap): sentence plus bullets by dimension order and severity. `aggregates` from rollup.parent_aggregates."""
    rank = F.lit(len(L.DIMENSION_ORDER))
    for i, name in reversed(list(enumerate(L.DIMENSION_ORDER))):
        rank = F.when(F.col("dimension") == name, i).otherwise(rank)
    bullet = F.struct(rank.alias("d"), L.severity_rank(F.col("severity")).alias("s"), F.col("item_order").alias("o"), F.col("gap").alias("t"))
    per = items.groupBy("parent").agg(F.array_sort(F.collect_list(bullet)).alias("_b"), F.count_if(
        F.col("severity").isin("material", "moderate")).alias("_n"))
    mean = F.round("mean", 1)
    j = aggregates.join(per, "parent", "left")
    relationship = parent_relationship(mean, report_gap_type(mean))
    sentence = synthesis_sentence(relationship, mean, target, F.coalesce("_n", F.lit(0)))
    bullets = F.array_join(F.transform("_b", lambda b: F.concat(F.lit("• "), b["t"])), "\n")
    text = F.when(F.col("low") >= 100, full_coverage_sentence(target)).when(F.col("_b").isNull(), sentence).otherwise(
        F.concat(sentence, F.lit("\n\n"), bullets))
    return j.select("parent", text.alias("gap"))


def choose_summary(own: DataFrame, aggregates: DataFrame, supplied: DataFrame, target: str) -> DataFrame:
    """Fully covered parents get the fixed sentence, others the supplied synthesis (parent, summary), else their own."""
    s = supplied.select("parent", F.trim("summary").alias("_s"))
    j = aggregates.select("parent", "mean").join(own, "parent").join(s, "parent", "left")
    return j.select("parent", F.when(F.col("mean") >= 99.5, full_coverage_sentence(target)).otherwise(
        first_text(F.col("_s"), F.col("gap"))).alias("gap"))


SYNTHESIS = ("struct<parent_gap_type:string,gap_type:string,parent_relation_type:string,relation_type:string,coverage_synthesis:string,"
             "summary:string,residual_gaps:array<struct<dimension:string,gap:string,missing_element:string,residual_gap:string,severity:string>>>")


def supplied_syntheses(rows: DataFrame) -> DataFrame:
    """(parent, synthesis JSON) -> parent, summary text, gap type and relation type; unreadable JSON is skipped."""
    p = rows.select("parent", F.from_json("synthesis", SYNTHESIS).alias("j"), F.from_json("synthesis", "map<string,string>").alias("_m"))
    p = p.filter(F.col("_m").isNotNull() & (F.size("_m") > 0))
    gap = lambda g: F.trim(first_text(g["gap"], g["missing_element"], g["residual_gap"]))
    raw = F.filter(F.coalesce("j.residual_gaps", F.from_json(F.lit("[]"), SYNTHESIS.split("residual_gaps:")[1][:-1])), lambda g: gap(g) != "")
    items = F.transform(raw, lambda g: F.struct(
        L.synthesis_dimension(first_text(g["dimension"], F.lit("explicitness"))).alias("dimension"), clean_sentence(gap(g)).alias("gap")))
    key = L.label_key(first_text(F.col("j.parent_gap_type"), F.col("j.gap_type")))
    detail = F.exists("_i", lambda g: g["dimension"].isin("evidence", "explicitness", "deadline", "condition"))
    inferred = F.when(F.size("_i") == 0, "none").when(detail, "implementation_detail_gap").otherwise("partial_gap")
    p = p.withColumn("_i", items).withColumn("parent_gap_type", F.coalesce(L.lookup(key, L.SYNTHESIS_GAP_ALIASES), inferred))
    relation = F.lit("partial")
    for k, v in L.SYNTHESIS_RELATIONS.items():
        relation = F.when(F.col("parent_gap_type") == k, v).otherwise(relation)
    words = lambda t: F.array_join(F.slice(F.filter(F.split(F.trim(F.regexp_replace(F.replace(casefold(t), F.lit("."), F.lit(" ")), r"\s+", " ")), " "),
                                                    lambda w: F.length(w) > 2), 1, SYNTHESIS_KEY_TOKENS), " ")
    keys = F.transform("_i", lambda g: F.concat(g["dimension"], F.lit("|"), words(g["gap"])))
    p = p.withColumn("_k", keys).withColumn("_u", F.filter("_i", lambda g, i: F.array_position(F.col("_k"), F.element_at("_k", (i + 1))) == i + 1))
    own = clean_sentence(F.trim(first_text(F.col("j.coverage_synthesis"), F.col("j.summary"))))
    sentence = first_text(own, F.lit("The target framework provides partial or indirect coverage, but residual obligations remain."))
    bullets = F.array_join(F.transform("_u", lambda g: F.concat(F.lit("• "), g["gap"])), "\n")
    return p.select("parent", F.when(F.size("_u") > 0, F.concat(sentence, F.lit("\n\n"), bullets)).otherwise(sentence).alias("summary"),
                    "parent_gap_type", first_text(F.trim(first_text(F.col("j.parent_relation_type"), F.col("j.relation_type"))), relation)
                    .alias("parent_relation_type"))


def distinct_targets(decisions: DataFrame, order: str = "decision_order") -> DataFrame:
    """(parent, target_id, position): distinct targets of a parent in order of first use, one row each."""
    e = with_parent(decisions).select("parent", order, F.posexplode("target_parent_ids").alias("_i", "target_id")).filter(F.col("target_id") != "")
    firsts = e.groupBy("parent", "target_id").agg(F.min(F.struct(order, "_i")).alias("_at"))
    w = Window.partitionBy("parent").orderBy("_at")
    return firsts.withColumn("position", F.row_number().over(w)).drop("_at")


def needs_plan() -> Column:
    return ((F.col("coverage_level") < 99.5) & (F.trim(F.coalesce("gap", F.lit(""))) != "")
            & ~F.contains(casefold(F.col("gap")), F.lit("fully covers this requirement")))


def action_plans(rows: DataFrame, supplied: DataFrame, n: int = 4) -> DataFrame:
    """Adds action_plan from supplied actions (parent, actions array) where the row needs a plan; '' otherwise."""
    j = rows.join(supplied.select("parent", "actions"), "parent", "left")
    return j.withColumn("action_plan", F.when(needs_plan(), F.coalesce(format_actions(F.col("actions"), n), F.lit(""))).otherwise("")).drop("actions")
