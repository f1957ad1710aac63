"""Roll-up of atomic decisions to parents, review priority, neighbours and report tables.

Parents are grouped with partial aggregates only. Lists are cut by rank before they are collected, so a parent
that owns a large part of all decisions never forms one big array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mapweave.functions import labels as L
from mapweave.functions.text import WHITE, casefold, display_id, parent_id
from mapweave.functions.values import first_text

# Points and limits of the review priority.
MARGIN_TIE, CONTEST_BAND, EDGE_BAND = 0.003, 0.01, 4.0
EDGES = (12.5, 37.5, 62.5, 87.5)
HIGH_POINTS, MEDIUM_POINTS = 3.0, 1.5


def with_parent(decisions: DataFrame) -> DataFrame:
    """Adds `parent`: the display id of the source parent."""
    raw = first_text(F.col("source_parent_id"), parent_id(F.col("source_id")))
    return decisions.withColumn("parent", display_id(raw))


def first_filled(value: Column, order: str) -> Column:
    return F.min_by(F.when(value != "", value), F.when(value != "", F.col(order)))


def share(cond: Column) -> Column:
    return F.count_if(cond) / F.count(F.lit(1))


def parent_aggregates(decisions: DataFrame, order: str = "decision_order") -> DataFrame:
    cov = F.col("coverage_level")
    kind = L.parent_gap_label(F.when(F.col("gap_type") == "", L.gap_type_from_coverage(cov, F.col("relation_type")))
                              .otherwise(F.col("gap_type")))
    d = with_parent(decisions).withColumns({
        "_kind": kind, "_dims": F.array_sort(F.array_distinct(F.transform("gap_items", lambda g: L.dimension(g["dimension"])))),
        "_rel": casefold(F.coalesce("relation_type", F.lit(""))), "_risk": F.lower("mapping_risk")})
    weak = (cov > 0) & (cov <= 30)
    return d.groupBy("parent").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("coverage_level") / F.count(F.lit(1))).alias("mean"),
        F.min("coverage_level").alias("low"), F.max("coverage_level").alias("high"),
        F.count_if(cov >= 75).alias("n_strong"), share(cov < 40).alias("uncovered"), share(cov >= 40).alias("direct"),
        share(cov >= 80).alias("strong"), share((cov > 0) & (cov < 40)).alias("indirect"), share(cov <= 0).alias("none"),
        F.bool_or(F.col("_kind") == "conflict_gap").alias("conflict"),
        # sorted sets of ten dimension names: at most 2 ** 10 of them
        F.array_distinct(F.flatten(F.collect_set("_dims"))).alias("dims"),
        F.count_if(weak).alias("n_weak"), F.count_if(weak & (F.col("_rel") == "not_covered")).alias("n_weak_not"),
        F.bool_or(F.col("_risk") == "high").alias("any_high"), F.bool_or(F.col("_risk") == "medium").alias("any_medium"),
        F.coalesce(first_filled(F.col("source_parent_requirement"), order), F.min_by("source_requirement", order))
        .alias("source_parent_requirement"),
        F.coalesce(first_filled(F.col("source_category"), order), F.lit("")).alias("domain"),
        F.min_by("match_type", order).alias("first_match_type"))


def parent_coverage() -> Column:
    """Mean, lifted toward the best atom when strong, then capped when many atoms are uncovered."""
    lift = (F.col("n_strong") >= 2) | ((F.col("n_strong") >= 1) & (F.col("low") >= 40))
    raw = F.bround(F.when(lift, F.col("mean") * 0.6 + F.col("high") * 0.4).otherwise(F.col("mean"))).cast("int")
    return F.when(F.col("uncovered") >= 0.75, F.least(raw, F.lit(25))).when(
        F.col("uncovered") >= 0.5, F.least(raw, F.lit(50))).otherwise(raw)


def _gap_ladder(value: Column) -> Column:
    dims = F.col("dims")
    inside = (F.size(dims) > 0) & (F.size(F.array_except(dims, F.array(*[F.lit(x) for x in L.IMPLEMENTATION_DIMS]))) == 0)
    material = F.arrays_overlap(dims, F.array(*[F.lit(x) for x in L.MATERIAL_DIMS]))
    direct = F.col("direct")
    return (F.when((F.col("none") >= 0.70) & (direct == 0), "true_gap")
            .when((direct == 0) & (F.col("indirect") > 0), "indirect_support_gap")
            .when((value >= 70) & (F.col("strong") >= 0.50) & inside, "implementation_detail_gap")
            .when((value >= 60) & (direct >= 0.60) & ~material, "implementation_detail_gap")
            .when((value >= 40) & (direct >= 0.25), "partial_gap")
            .when((F.col("indirect") > 0) | (value > 0), "indirect_support_gap").otherwise("true_gap"))


def report_gap_type(coverage: Column) -> Column:
    return F.when(coverage >= 99.5, "none").when(F.col("conflict"), "conflict_gap").otherwise(_gap_ladder(coverage))


def synthesis_gap_type() -> Column:
    mean = F.col("mean")
    return (F.when(F.col("conflict"), "conflict_gap").when((mean >= 99.5) & (F.col("none") == 0), "none")
            .otherwise(_gap_ladder(mean)))


def parent_relationship(coverage: Column, gap_type: Column) -> Column:
    all_weak_not = (F.col("n_weak") > 0) & (F.col("n_weak") == F.col("n_weak_not"))
    return (F.when(gap_type == "conflict_gap", "Conflicting").when(coverage <= 0, "Not covered")
            .when((coverage >= 99.5) & (gap_type == "none"), "Exact coverage")
            .when(gap_type == "implementation_detail_gap", "Implementation details missing")
            .when(coverage >= 80, "Mostly covered").when(coverage >= 60, "Largely covered")
            .when(coverage >= 40, "Partially covered")
            .when(coverage >= 20, F.when(all_weak_not, "Not covered").otherwise("Indirectly covered"))
            .when(coverage >= 10, "Very weakly covered").otherwise("Not covered"))


def atomic_relationship(coverage: Column, gap_type: Column, relation: Column) -> Column:
    kind, rel = L.parent_gap_label(gap_type), casefold(F.coalesce(relation, F.lit("")))
    detail = kind == "implementation_detail_gap"
    return (F.when((rel == "conflict") | (kind == "conflict_gap"), "Conflicting").when(rel == "not_covered", "Not covered")
            .when(coverage >= 99.5, "Exact coverage").when((coverage >= 80) & detail, "Implementation details missing")
            .when(coverage >= 80, "Mostly covered").when(coverage >= 60, "Largely covered")
            .when((coverage >= 40) & detail, "Implementation details missing").when(coverage >= 40, "Partially covered")
            .when(coverage >= 20, "Indirectly covered").when(coverage >= 10, "Very weakly covered").otherwise("Not covered"))


def parent_risk(coverage: Column) -> Column:
    return (F.when(F.col("any_high") | (coverage <= 25), "High").when(F.col("any_medium") | (coverage < 75), "Medium")
            .when(coverage < 100, "Low").otherwise("None"))


def target_listing(decisions: DataFrame, limit: int = 5, order: str = "decision_order") -> DataFrame:
    """(parent, target_ids, target_texts): distinct cleaned target parents, best-covered first, first five.

    First positions per (parent, target) are aggregated before the cut, so only listed targets are collected.
    """
    d = with_parent(decisions)
    pos = F.struct((-F.col("coverage_level")).alias("c"), F.col(order).alias("o"), F.col("_i").alias("i"))

    def listing(values: Column, name: str) -> DataFrame:
        e = d.select("parent", "coverage_level", order, F.posexplode(values).alias("_i", "_v")).filter(F.col("_v") != "")
        firsts = e.groupBy("parent", "_v").agg(F.min(pos).alias("_at"))
        w = Window.partitionBy("parent").orderBy("_at")
        top = firsts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
        lst = F.array_sort(F.collect_list(F.struct("_r", "_v")))
        return top.groupBy("parent").agg(F.transform(lst, lambda x: x["_v"]).alias(name))

    ids = listing(F.transform("target_parent_ids", display_id), "target_ids")
    return ids.join(listing(F.col("target_parent_requirements"), "target_texts"), "parent", "left")


def parents(decisions: DataFrame) -> DataFrame:
    """One row per parent: coverage, gap type, relationship, targets, match type and risk."""
    cov, gap = F.col("coverage_level"), F.col("gap_type")
    p = parent_aggregates(decisions).withColumn("coverage_level", parent_coverage())
    p = p.withColumn("gap_type", report_gap_type(cov))
    p = p.withColumn("coverage_relationship", parent_relationship(cov, gap))
    j = p.join(target_listing(decisions), "parent", "left")
    size = F.coalesce(F.size("target_ids"), F.lit(0))
    match = F.when(size <= 0, "None").when((size > 1) | (F.col("n") > 1), "Composite").otherwise(F.col("first_match_type"))
    empty = F.array().cast("array<string>")
    return j.select("parent", "source_parent_requirement", "domain", F.coalesce("target_ids", empty).alias("target_ids"),
                    F.coalesce("target_texts", empty).alias("target_texts"), "coverage_relationship", "gap_type",
                    "coverage_level", match.alias("match_type"), parent_risk(cov).alias("mapping_risk"), "n")


# ---- review priority ------------------------------------------------------------------------------
def decision_signals(d: DataFrame) -> DataFrame:
    """Per decision: margin to and number of contesting other-parent candidates, and the gate on selected ones.

    Works on the candidate array of the row, whose length the search bounds.
    """
    pid = lambda c: display_id(first_text(c["parent_id"], parent_id(c["candidate_id"])))
    ordered = F.array_sort(F.transform("candidates", lambda c, i: F.struct(
        (-F.coalesce(c["combined_score"], F.lit(0.0))).alias("s"), i.alias("i"), pid(c).alias("p"))))
    top = F.try_element_at("_o", F.lit(1))
    d = d.withColumn("_o", ordered).withColumn("_others", F.filter("_o", lambda x: x["p"] != top["p"]))
    gap = lambda x: x["s"] - top["s"]
    contest = F.size(F.array_distinct(F.transform(F.filter("_others", lambda x: gap(x) <= CONTEST_BAND), lambda x: x["p"])))
    listed = F.size("target_ids") > 0
    chosen = F.when(F.size("selected_ids") > 0, F.col("selected_ids")).otherwise(F.col("target_ids"))
    gated = F.exists("candidates", lambda c: F.array_contains(chosen, c["candidate_id"])
                     & ~F.coalesce(c["hard_gate"], F.lit("pass")).isin("", "pass"))
    return d.withColumns({
        "margin": F.when(listed, F.array_min(F.transform("_others", gap))), "contest": F.when(listed, contest).otherwise(0),
        "gated": gated}).drop("_o", "_others")


def review_priority(decisions: DataFrame, coverage: DataFrame) -> DataFrame:
    """(parent, points, review_priority); `coverage` has parent and its un-bucketed coverage_level."""
    d = decision_signals(with_parent(decisions))
    different = F.coalesce(~F.col("same_functional_domain"), F.lit(False))
    agg = d.groupBy("parent").agg(
        F.min("margin").alias("margin"), F.max("contest").alias("contest"), F.bool_or("gated").alias("gated"),
        F.max(F.abs(F.col("coverage_level") - F.col("pre_review_coverage"))).alias("overturn"),
        (F.max("coverage_level") - F.min("coverage_level")).alias("spread"),
        F.bool_or(F.lower("mapping_risk") == "high").alias("risky"), F.bool_or(F.size("candidates") > 0).alias("seen"),
        F.bool_or(different).alias("different"))
    cov = F.col("coverage_level")
    near = F.least(*[F.abs(cov - e) for e in EDGES]) <= EDGE_BAND
    pts = lambda cond, n: F.when(cond, float(n)).otherwise(0.0)
    points = (pts(F.col("margin") < MARGIN_TIE, 0.5) + pts(F.col("contest") >= 2, 0.5) + pts(F.col("gated"), 1.5)
              + F.when(F.col("overturn") >= 40, 2.0).when(F.col("overturn") >= 20, 1.0).otherwise(0.0)
              + F.when(F.col("spread") >= 50, 1.0).when(F.col("spread") >= 30, 0.5).otherwise(0.0) + pts(F.col("risky"), 1.5)
              + pts((cov <= 0) & F.col("seen") & ~F.col("different"), 0.5) + pts(near, 0.5))
    return agg.join(coverage.select("parent", "coverage_level"), "parent").withColumn("points", points).select(
        "parent", "points", F.when(F.col("points") >= HIGH_POINTS, "High").when(F.col("points") >= MEDIUM_POINTS, "Medium")
        .when((F.col("points") > 0) | (cov < 99.5), "Low").otherwise("None").alias("review_priority"))


def neighbours(decisions: DataFrame, listed: DataFrame, limit: int = 3, chars: int = 110,
               order: str = "decision_order") -> DataFrame:
    """(parent, neighbours): the best retrieved target parents that are not listed, formatted one per line."""
    d = with_parent(decisions).select("parent", order, F.posexplode("candidates").alias("_i", "c"))
    gate = ~F.coalesce(F.col("c.hard_gate"), F.lit("pass")).isin("", "pass")
    e = d.select("parent", display_id(first_text(F.col("c.parent_id"), parent_id(F.col("c.candidate_id")))).alias("pid"),
                 F.coalesce("c.combined_score", F.lit(0.0)).alias("score"), F.struct(
                     F.coalesce("c.combined_score", F.lit(0.0)).alias("s"), (-F.col(order)).alias("o"), (-F.col("_i")).alias("i")
                 ).alias("_at"), F.struct(first_text(F.col("c.parent_requirement"), F.col("c.requirement")).alias("text"),
                                          gate.alias("gate")).alias("v")).filter(F.col("pid") != "")
    best = e.groupBy("parent", "pid").agg(F.max("score").alias("score"), F.max_by("v", "_at").alias("v"), F.max(
        F.struct((-F.col("_at.o")).alias("o"), F.col("_at.i"))).alias("_x"), F.min(F.struct(
            (-F.col("_at.o")).alias("o"), (-F.col("_at.i")).alias("i"))).alias("_seen")).drop("_x")
    shown = listed.select("parent", F.explode("target_ids").alias("pid"))
    free = best.join(shown, ["parent", "pid"], "left_anti")
    w = Window.partitionBy("parent").orderBy(F.desc("score"), "_seen")
    top = free.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    flat = F.trim(F.regexp_replace("v.text", f"[{WHITE}]+", " "))
    excerpt = F.when(F.length(flat) > chars, F.concat(F.rtrim(F.substring(flat, 1, chars)), F.lit("…"))).otherwise(flat)
    why = F.when(F.col("v.gate"), "weak action/object alignment").otherwise("lower score, not selected")
    line = F.concat(F.lit("• "), "pid", F.lit(" · sim "), F.bround(F.col("score") * 100).cast("int").cast("string"),
                    F.lit("% — "), excerpt, F.lit(" ["), why, F.lit("]"))
    lines = F.array_sort(F.collect_list(F.struct("_r", line.alias("l"))))
    return top.groupBy("parent").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("neighbours"))


# ---- reports (input: parent rows with domain, coverage_level, review_priority) ---------------------
def _counts() -> list[Column]:
    b = L.bucket(F.col("coverage_level"))
    return [F.count(F.lit(1)).alias("requirements"), F.round(F.avg(b), 1).alias("average_coverage"),
            F.count_if(b == 0).alias("gaps"), *[F.count_if(F.col("review_priority") == x).alias(x.lower())
                                                for x in ("High", "Medium", "Low")], F.count_if(b == 100).alias("full")]


def coverage_by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("domain").agg(*_counts())


def category_status_table(rows: DataFrame) -> DataFrame:
    avg = F.avg(L.bucket(F.col("coverage_level")))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("requirements"), F.round(avg, 1).alias("average_coverage"),
                                      L.category_status(avg).alias("status"),
                                      F.count_if(F.col("review_priority") == "High").alias("high"),
                                      F.count_if(F.col("review_priority") == "Medium").alias("medium"))


def coverage_distribution(rows: DataFrame) -> DataFrame:
    counted = rows.groupBy(L.bucket_label(F.col("coverage_level")).alias("coverage_type")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("_t"))
    return counted.join(F.broadcast(total)).select(  # total is a single row
        "coverage_type", "n", F.round(F.col("n") / F.col("_t") * 100, 1).alias("percent"))


def dashboard(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    p = rows.agg(F.round(F.avg(L.bucket(F.col("coverage_level"))), 1).alias("parent_coverage"), F.count(F.lit(1)).alias("parents"))
    a = decisions.agg(F.round(F.avg("coverage_level"), 1).alias("atomic_coverage"), F.count(F.lit(1)).alias("decisions"))
    return p.join(F.broadcast(a))  # both are single rows


def insights(rows: DataFrame) -> DataFrame:
    """One row: the two worst categories and the counts behind the key statements."""
    b = L.bucket(F.col("coverage_level"))
    avg = rows.groupBy("domain").agg(F.avg(b).alias("a"))
    worst = avg.orderBy("a", "domain").limit(2).agg(F.array_sort(F.collect_list(F.struct("a", "domain"))).alias("w")).select(
        F.array_join(F.transform("w", lambda x: F.concat(L.short_category(x["domain"]), F.lit(" "), F.bround(x["a"]).cast("int").cast(
            "string"))), ", ").alias("worst"))
    flag = F.col("entity_gap") if "entity_gap" in rows.columns else F.lit(False)
    counts = rows.agg(F.count_if(b == 50).alias("partial"), F.count_if(b == 25).alias("indirect"),
                      F.count_if(F.col("review_priority") == "High").alias("high"), F.count_if(flag).alias("entity_gaps"),
                      F.count_if(b == 0).alias("gaps"))
    return counts.join(F.broadcast(worst))  # both are single rows


def entity_gaps(rows: DataFrame, source_flags: DataFrame, target_flags: DataFrame) -> DataFrame:
    """Flag important parents covered by a target that is not important. Flags: (id, important), first id wins."""
    s = source_flags.select(display_id(F.col("id")).alias("parent"), "important", "pos").groupBy("parent").agg(
        F.min_by("important", "pos").alias("source_important"))
    t = target_flags.select(display_id(F.col("id")).alias("_t"), "important", "pos").groupBy("_t").agg(
        F.min_by("important", "pos").alias("_ti"))
    used = rows.filter(F.col("coverage_level") > 0).select("parent", F.explode("target_ids").alias("_t"))
    missing = (used.join(t, "_t", "left").filter(~F.coalesce("_ti", F.lit(False))).groupBy("parent")
               .agg(F.array_sort(F.collect_list("_t")).alias("not_important")))
    j = rows.join(s, "parent", "left").join(missing, "parent", "left")
    gap = F.coalesce("source_important", F.lit(False)) & F.col("not_important").isNotNull()
    # The text of the note.
    note = F.concat(F.lit("• Important entities: coverage relies on target requirement "), F.array_join("not_important", ", "), F.lit(
        " which applies to essential entities only (Important=False). At "), L.bucket(F.col("coverage_level")).cast("string"), F.lit(
        "% overlap, this obligation is not enforced for important entities."))
    return j.withColumns({
        "entity_gap": gap, "entity_note": F.when(gap, note).otherwise(""),
        "review_priority": F.when(gap, "High").otherwise(F.col("review_priority"))}).drop("not_important", "source_important")


def run_summary(forward: DataFrame, backward: DataFrame) -> DataFrame:
    both = forward.select("coverage_level", F.lit(1).alias("f")).unionByName(backward.select("coverage_level", F.lit(0).alias("f")))
    return both.agg(F.count(F.lit(1)).alias("atomic_decisions"), F.round(F.avg("coverage_level"), 1).alias("average_coverage"),
                    F.count_if(F.col("coverage_level") == 0).alias("gaps"), F.sum("f").alias("source_atoms"),
                    F.sum(1 - F.col("f")).alias("target_atoms"))


def lowest_parents(decisions: DataFrame, n: int = 20, order: str = "decision_order") -> DataFrame:
    raw = first_text(F.col("source_parent_id"), parent_id(F.col("source_id")))
    return (decisions.groupBy(raw.alias("parent")).agg(
        F.coalesce(first_filled(F.col("source_category"), order), F.lit("")).alias("category"),
        F.round(F.avg("coverage_level"), 1).alias("coverage")).orderBy("coverage", "parent").limit(n))
