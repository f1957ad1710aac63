"""The ordered correction rules of a decision.

A rule reads a State and puts new values for some of its fields. `correct` keeps the fields in columns, one projection a
rule: these are compiled, and what no later step reads is never computed. Its last projection is marked as not
deterministic, so a filter on the result stays above the rules instead of being written out through all of them.
`fold` runs the rules inside an array expression; there the fields form one struct, bound by a one-element transform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mapweave.functions import labels as L
from mapweave.functions.text import casefold
from mapweave.functions.values import GAP_ITEM, first_text
from mapweave.params import DEFAULTS, Params

TEXTS = "array<string>"
TYPES = {
    "selected_ids": TEXTS, "target_ids": TEXTS, "target_requirements": TEXTS, "target_parent_ids": TEXTS,
    "target_parent_requirements": TEXTS, "coverage_level": "int", "equivalence_level": "string", "confidence": "double",
    "gap_items": f"array<{GAP_ITEM}>", "relation_type": "string", "match_type": "string", "gap_type": "string",
    "justification": "string", "gap": "string", "combine_controls": "string", "recommendation": "string",
    "mapping_risk": "string", "scoring_rationale": "string",
}
RULED = list(TYPES)
# Texts that later stages and readers recognise.
NOT_COVERED_FULLY = ("Target framework does not fully cover the source requirement. Review detailed gap items for "
                     "missing actor/action/object/scope/evidence dimensions.")
DOWNGRADED = "Exact match downgraded because action/object alignment is insufficient."
REVIEW = ("Review manually, especially relation type, gap classification, action/object alignment, scope and "
          "evidence differences.")
RESCUE_REASONS = {
    "partial_gap": "The best candidate has material semantic and structured overlap; treat as partial coverage with "
                   "high review risk rather than true gap.",
    "implementation_detail_gap": "The target appears to cover the same governance/control area but lacks "
                                 "implementation detail, explicitness or evidence.",
    "indirect_support_gap": "The target is related/supportive but does not provide direct coverage.",
}
GATE_NOTE = (": selected target has insufficient main action/object alignment for higher coverage. The candidate is kept "
             "for traceability; it is not forced to Gap.")


class State:
    """The struct a rule reads; `put` gives the struct it leaves behind."""

    def __init__(self, value: Column):
        self.value = value

    def __call__(self, name: str) -> Column:
        return self.value[name]

    def best(self, name: str) -> Column:
        return F.coalesce(self.value["best"][name], F.lit(0.0))

    def put(self, cond: Column, **values) -> Column:
        out = self.value
        for n, v in values.items():
            v = v if isinstance(v, Column) else F.lit(v)
            v = v.cast(TYPES[n]) if n in TYPES else v
            out = out.withField(n, F.when(cond, v).otherwise(self.value[n]))
        return out

    def put_or(self, name: str, default) -> Column:
        return F.when(self(name) == "", default).otherwise(self(name))


class Columns(State):
    """A state whose fields are columns of a table; `put` gives the columns that change."""

    def __init__(self):
        super().__init__(None)

    def __call__(self, name: str) -> Column:
        return F.col(f"_rule_{name}")

    def best(self, name: str) -> Column:
        return F.coalesce(self("best")[name], F.lit(0.0))

    def put(self, cond: Column, **values) -> dict[str, Column]:
        out = {}
        for n, v in values.items():
            v = v if isinstance(v, Column) else F.lit(v)
            out[f"_rule_{n}"] = F.when(cond, v.cast(TYPES[n]) if n in TYPES else v).otherwise(self(n))
        return out


def none(type_: str = TEXTS) -> Column:
    return F.array().cast(type_)


def append(c: Column, note: Column | str) -> Column:
    note = F.lit(note) if isinstance(note, str) else note
    return F.when(c != "", F.concat(c, F.lit("\n"), note)).otherwise(note)


def two_digits(c: Column) -> Column:
    return F.format_number(c, 2)


def gap_item(dimension, gap, severity, target_coverage) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(dimension).alias("dimension"), lit(gap).alias("gap"), lit(severity).alias("severity"),
                    lit(target_coverage).alias("target_coverage"))


def is_material(items: Column) -> Column:
    return F.exists(items, lambda g: casefold(F.coalesce(g["severity"], F.lit(""))).isin("material", "major", "critical"))


def best_candidate(candidates: Column) -> Column:
    """Highest combined, then semantic score; the earlier one among equals; null for an empty list."""
    keyed = F.transform(candidates, lambda c, i: F.struct(
        F.coalesce(c["combined_score"], F.lit(0.0)).alias("x"), F.coalesce(c["semantic_score"], F.lit(0.0)).alias("y"),
        (-i).alias("z"), c.alias("c")))
    return F.array_max(keyed)["c"]


def gate_limit(action_object: Column, p: Params) -> Column:
    if not p.gate_enabled or p.gate_mode in ("off", "none", "disabled"):
        return F.lit(100)
    if p.gate_mode in ("hard", "legacy"):
        return F.when(action_object < p.gate_hard, 25).otherwise(100)
    return F.when(action_object < p.gate_cap25, 30).when(action_object < p.gate_cap75, 50).otherwise(100)


def has_target(s: State) -> Column:
    return F.size(s("target_ids")) > 0


def has_best(s: State) -> Column:
    return s("best").isNotNull()


def scores(s: State, *names: str) -> Column:
    """'combined=0.70, semantic=0.81' for the best candidate."""
    parts = []
    for i, n in enumerate(names):
        parts += [F.lit((", " if i else "") + n + "="), two_digits(s.best(f"{n}_score"))]
    return F.concat(*parts)


# ---- one function per rule ------------------------------------------------------------------------
def snap(s: State, p: Params) -> Column:
    return s.put(F.lit(True), coverage_level=L.score_level(s("coverage_level")))


def gap_taxonomy(s: State, p: Params) -> Column:
    return s.put(~s("done"), gap_type=L.gap_type(s("gap_type"), s("coverage_level"), s("relation_type")))


def relation_taxonomy(s: State, p: Params) -> Column:
    return s.put(~s("done"), relation_type=L.relation_type(s("relation_type"), s("coverage_level"), s("gap_type")))


def rescue_kind(s: State, p: Params) -> Column:
    """What the best candidate could be rescued as; null when a rescue is not allowed."""
    combined, semantic = s.best("combined_score"), s.best("semantic_score")
    kind = (F.when((combined >= p.rescue_partial_combined) & (semantic >= p.rescue_partial_semantic), "partial_gap")
            .when((combined >= p.rescue_implementation_combined)
                  & ((s.best("structured_score") >= 0.25) | (semantic >= 0.55) | (s.best("category_prior_score") >= 0.20)),
                  "implementation_detail_gap")
            .when((combined >= p.rescue_indirect_combined) | (semantic >= p.rescue_indirect_semantic),
                  "indirect_support_gap"))
    different = F.coalesce(~s("same_functional_domain"), F.lit(False))
    allowed = (F.lit(p.rescue_enabled) & ~different & has_best(s)
               & (F.coalesce(s("best")["candidate_id"], F.lit("")) != "")
               & (s.best("action_object_score") >= p.rescue_min_action_object))
    return s.put(F.lit(True), kind=F.when(allowed, kind))


# The texts below are results that are compared as they stand.
def rescue(s: State, p: Params, cond: Column) -> Column:
    """Where cond holds and the best candidate is strong enough, keep it as partial or indirect coverage."""
    kind, best = s("kind"), s("best")
    partial, indirect = kind == "partial_gap", kind == "indirect_support_gap"
    reason = F.when(partial, RESCUE_REASONS["partial_gap"]).when(indirect, RESCUE_REASONS["indirect_support_gap"]).otherwise(
        RESCUE_REASONS["implementation_detail_gap"])
    note = F.concat(reason, F.lit(" Candidate rescue scores: "), scores(s, "combined", "semantic", "structured", "action_object"),
                    F.lit("."))
    cid, text = best["candidate_id"], F.coalesce(best["requirement"], F.lit(""))
    item = gap_item(F.when(kind == "implementation_detail_gap", "explicitness").otherwise("action"), reason,
                    F.when(indirect, "material").otherwise("moderate"),
                    F.concat(F.lit("Candidate "), cid, F.lit(" retained for traceability; manual validation required.")))
    low_ao = s.best("action_object_score") < p.gate_cap75
    return s.put(
        cond & kind.isNotNull(), selected_ids=F.array(cid), target_ids=F.array(cid), target_requirements=F.array(text),
        target_parent_ids=F.array(first_text(best["parent_id"], cid)),
        target_parent_requirements=F.array(first_text(best["parent_requirement"], text)),
        coverage_level=F.when(indirect, 20).when(partial & low_ao, 40).otherwise(50),
        equivalence_level=F.when(indirect, "Indirect").otherwise("Partial"),
        relation_type=F.when(partial, "partial").when(indirect, "indirect_support").otherwise(kind), gap_type=kind,
        match_type=F.when(partial, "Candidate rescue - partial").when(indirect, "Candidate rescue - indirect")
        .otherwise("Candidate rescue - implementation detail"),
        confidence=F.least(F.when(s("confidence") == 0, 0.45).otherwise(s("confidence")), F.lit(0.55)), mapping_risk="High",
        justification=append(s("justification"), note), gap=append(s("gap"), note),
        scoring_rationale=append(s("scoring_rationale"), note), gap_items=F.concat(s("gap_items"), F.array(item)))


def rescue_missing(s: State, p: Params) -> Column:
    return rescue(s, p, ~has_target(s))


def close_without_target(s: State, p: Params) -> Column:
    return s.put(~has_target(s), relation_type="true_gap", gap_type="true_gap", equivalence_level="Gap", coverage_level=0,
                 match_type="None", selected_ids=none(), gap=s.put_or("gap", "No selected target candidate."),
                 mapping_risk=s.put_or("mapping_risk", "High"), done=True)


def measure_selected(s: State, p: Params) -> Column:
    ids = F.when(has_target(s), s("target_ids")).otherwise(s("selected_ids"))
    chosen = F.filter(s("candidates"), lambda c: F.array_contains(ids, c["candidate_id"]))
    best = F.array_max(F.transform(chosen, lambda c: F.coalesce(c["action_object_score"], F.lit(0.0))))
    return s.put(F.lit(True), selected_ao=F.coalesce(best, F.lit(0.0)))


def cap_by_gate(s: State, p: Params) -> Column:
    limit = gate_limit(s("selected_ao"), p)
    note = F.concat(F.lit("Coverage capped by object/action gate at "), limit.cast("string"), F.lit(GATE_NOTE))
    return s.put(
        ~s("done") & (s("coverage_level") > limit), coverage_level=limit, equivalence_level=L.equivalence(limit),
        relation_type=F.when(limit <= 30, "indirect_support").when(limit <= 50, "partial").otherwise(s("relation_type")),
        gap_type=F.when(limit <= 30, "indirect_support_gap").when(limit <= 50, s.put_or("gap_type", "partial_gap"))
        .otherwise(s("gap_type")),
        match_type=F.when(limit <= 30, "Indirect").when((limit <= 50) & (s("match_type") != "Composite"), "Direct")
        .otherwise(s("match_type")),
        mapping_risk="High", scoring_rationale=append(s("scoring_rationale"), note))


def rescue_zero(s: State, p: Params) -> Column:
    return rescue(s, p, ~s("done") & (s("coverage_level") == 0))


def close_zero(s: State, p: Params) -> Column:
    conflict = s("relation_type") == "conflict"
    return s.put(
        ~s("done") & (s("coverage_level") == 0), relation_type=F.when(conflict, "conflict").otherwise("true_gap"),
        gap_type=F.when(conflict, "conflict_gap").otherwise("true_gap"), equivalence_level="Gap", match_type="None",
        target_ids=none(), target_requirements=none(), target_parent_ids=none(), target_parent_requirements=none(),
        selected_ids=none(), gap=s.put_or("gap", "No sufficient coverage identified."),
        mapping_risk=s.put_or("mapping_risk", "High"), done=True)


def is_exact(s: State) -> Column:
    return s("equivalence_level") == "Exact match"


def exact_below_full(s: State, p: Params) -> Column:
    return s.put(~s("done") & is_exact(s) & (s("coverage_level") < 100), equivalence_level=L.equivalence(s("coverage_level")))


def exact_without_alignment(s: State, p: Params) -> Column:
    return s.put(~s("done") & is_exact(s) & (s("selected_ao") < 0.65), equivalence_level="Partial",
                 coverage_level=F.least(s("coverage_level"), F.lit(80)), gap_type="partial_gap", mapping_risk="High",
                 gap=append(s("gap"), DOWNGRADED))


def full_is_exact(s: State, p: Params) -> Column:
    return s.put(~s("done") & (s("coverage_level") == 100) & ~is_exact(s), equivalence_level="Exact match", gap_type="none",
                 relation_type="direct_full_coverage")


def name_match(s: State, p: Params) -> Column:
    several = F.size(s("target_ids")) > 1
    unnamed = s("match_type").isin("", "None")
    kind = (F.when(several, "Composite").when(unnamed & (s("coverage_level") >= 50), "Direct").when(unnamed, "Indirect")
            .otherwise(s("match_type")))
    joined = F.when(several, s.put_or("combine_controls", F.array_join(s("target_ids"), ", "))).otherwise(s("combine_controls"))
    return s.put(~s("done"), match_type=kind, combine_controls=joined)


def find_upgrade(s: State, p: Params) -> Column:
    cov, items = s("coverage_level"), s("gap_items")
    base = ~s("done") & has_target(s) & has_best(s) & (cov < 100) & (s.best("action_object_score") >= p.upgrade_action_object)
    exact = (base & (cov >= 80) & (s.best("combined_score") >= p.upgrade_exact_combined)
             & (s.best("semantic_score") >= p.upgrade_exact_semantic) & (F.size(items) == 0))
    most = (base & (cov < 80) & (s.best("combined_score") >= p.upgrade_combined)
            & (s.best("semantic_score") >= p.upgrade_semantic)
            & (s.best("structured_score") >= p.upgrade_structured) & ~is_material(items))
    return s.put(F.lit(True), upgrade=F.when(exact, 100).when(most, 80))


# The texts below are results that are compared as they stand.
def apply_upgrade(s: State, p: Params) -> Column:
    """Under-scored decisions with a strong best candidate: 100 without gap items, otherwise 80."""
    u = s("upgrade")
    full = u == 100
    note = F.when(full, F.concat(F.lit(
        "Strong candidate upgrade (Exact match): retrieval evidence and absence of residual gaps support full coverage ("),
        scores(s, "combined", "semantic", "action_object"), F.lit(").")))
    note = note.otherwise(F.concat(F.lit(
        "Strong candidate upgrade (Mostly covered): high retrieval evidence overrides weaker LLM classification ("),
        scores(s, "combined", "semantic", "structured", "action_object"), F.lit(").")))
    detail = F.when(F.size(s("gap_items")) > 0, "implementation_detail_gap").otherwise("partial_gap")
    return s.put(u.isNotNull(), coverage_level=u, equivalence_level=F.when(full, "Exact match").otherwise("Partial"),
                 relation_type=F.when(full, "direct_full_coverage").otherwise("mostly_covered"),
                 gap_type=F.when(full, "none").otherwise(detail), gap=F.when(full, "").otherwise(s("gap")),
                 mapping_risk=F.when(full, "Low").otherwise(s.put_or("mapping_risk", "Medium")),
                 scoring_rationale=append(s("scoring_rationale"), note))


def _can_lift(s: State) -> Column:
    return ~s("done") & has_target(s) & (casefold(s("mapping_risk")) != "high") & has_best(s)


# The texts below are results that are compared as they stand.
def lift_to_50(s: State, p: Params) -> Column:
    combined = s.best("combined_score")
    note = F.concat(F.lit("Coverage floor (50%): strong combined score ("), two_digits(combined), F.lit(
        ") overrides under-classification — the gate has not capped coverage, suggesting genuine partial overlap."))
    weak = s("gap_type").isin("indirect_support_gap", "true_gap")
    return s.put(_can_lift(s) & (s("coverage_level") <= 30) & (gate_limit(s.best("action_object_score"), p) > 30)
                 & (combined >= p.floor_combined), coverage_level=50, equivalence_level="Partial",
                 gap_type=F.when(weak, "partial_gap").otherwise(s("gap_type")), relation_type="partial",
                 scoring_rationale=append(s("scoring_rationale"), note))


def lift_to_80(s: State, p: Params) -> Column:
    semantic, ao, g = s.best("semantic_score"), s.best("action_object_score"), s("gap_type")
    note = F.concat(F.lit("Coverage floor (80%): high semantic ("), two_digits(semantic), F.lit(") and action/object ("),
                    two_digits(ao),
                    F.lit(") scores support Mostly covered — remaining gap is likely implementation detail."))
    detail = F.when(F.size(s("gap_items")) > 0, "implementation_detail_gap").otherwise("partial_gap")
    return s.put(_can_lift(s) & (s("coverage_level") <= 50) & (gate_limit(ao, p) >= 80) & (semantic >= p.floor_semantic)
                 & (ao >= p.floor_action_object) & ~is_material(s("gap_items")), coverage_level=80, equivalence_level="Partial",
                 relation_type="mostly_covered",
                 gap_type=F.when(g.isin("indirect_support_gap", "true_gap"), "partial_gap").when(g.isin("", "partial_gap"), detail)
                 .otherwise(g), scoring_rationale=append(s("scoring_rationale"), note))


# The texts below are results that are compared as they stand.
def label_not_covered(s: State, p: Params) -> Column:
    """Very weak indirect decisions get the label; their coverage is kept."""
    cov, combined, semantic = s("coverage_level"), s.best("combined_score"), s.best("semantic_score")
    weak = F.when(cov <= 20, (combined < p.not_covered_strict_combined) | (semantic < p.not_covered_strict_semantic)).otherwise(
        (combined < p.not_covered_combined) & (semantic < p.not_covered_semantic))
    note = F.concat(F.lit("Not covered (cov="), cov.cast("string"), F.lit("%, "), F.when(cov <= 20, "OR").otherwise("AND"),
                    F.lit(" logic): "), scores(s, "combined", "semantic"),
                    F.lit(" — retrieval evidence insufficient to justify indirect label."))
    return s.put(~s("done") & (cov <= 30) & has_target(s) & has_best(s) & weak, equivalence_level="Not covered",
                 relation_type="not_covered", scoring_rationale=append(s("scoring_rationale"), note))


def fill_texts(s: State, p: Params) -> Column:
    missing = (s("coverage_level") < 100) & (s("gap") == "")
    open_ = (s("recommendation") == "") & ~is_exact(s)
    return s.put(~s("done"), gap=F.when(missing, NOT_COVERED_FULLY).otherwise(s("gap")),
                 recommendation=F.when(open_, REVIEW).otherwise(s("recommendation")),
                 mapping_risk=s.put_or("mapping_risk", L.risk(s("coverage_level"), s("equivalence_level"), s("match_type"))))


def cascade(p: Params, cap: bool) -> list:
    steps = [snap, gap_taxonomy, relation_taxonomy, rescue_kind, rescue_missing, close_without_target, measure_selected]
    steps += [cap_by_gate] if cap else []
    steps += [rescue_zero, close_zero, exact_below_full, exact_without_alignment, full_is_exact, name_match]
    steps += [find_upgrade, apply_upgrade] if p.upgrade_enabled else []
    steps += [lift_to_50, lift_to_80] if p.floor_enabled else []
    return steps + [label_not_covered, gap_taxonomy, relation_taxonomy, fill_texts]


def state_of(columns) -> Column:
    """The struct of a decision's columns that the rules read and change."""
    return F.struct(*[c.alias(n) for n, c in fields_of(columns).items()])


def fields_of(columns) -> dict[str, Column]:
    """The fields of a state: what the rules read and change, and their own marks."""
    ruled = {n: F.col(n).cast(t) for n, t in TYPES.items()}
    kept = {n: F.col(n) for n in columns if n in ("same_functional_domain", "candidates")}
    marks = {"done": F.lit(False), "kind": F.lit(None).cast("string"), "selected_ao": F.lit(0.0), "upgrade": F.lit(None).cast("int")}
    return ruled | kept | {"best": best_candidate(F.col("candidates"))} | marks


def settle(state: Column, p: Params, cap: bool) -> Column:
    """The struct after all rules in their fixed order."""
    for rule in cascade(p, cap):
        state = _bind(state, rule, p)
    return state


def fold(state: Column, changes: Column, change, p: Params, cap: bool) -> Column:
    """Apply the changes of an array one after another, each followed by all rules.

    change: function (State, element) -> values by column name.
    """
    def step(before: Column, element: Column) -> Column:
        s = State(before)
        return settle(s.put(F.lit(True), **change(s, element), done=False, kind=F.lit(None).cast("string"), selected_ao=0.0, upgrade=F.lit(None).cast("int")), p, cap)
    return F.aggregate(changes, state, step)


def with_state(decisions: DataFrame, state: Column, when: Column | None = None) -> DataFrame:
    """decisions with the ruled columns of the struct; rows that do not satisfy `when` keep theirs."""
    out = decisions.withColumn("_s", F.when(when, state) if when is not None else state)
    done = lambda n: F.col(f"_s.{n}") if when is None else F.when(when, F.col(f"_s.{n}")).otherwise(
        F.col(n).cast(TYPES[n]))
    return out.select(*[done(c).alias(c) if c in TYPES else F.col(c) for c in decisions.columns])


def correct(decisions: DataFrame, p: Params = DEFAULTS, cap: bool = True) -> DataFrame:
    """Run the rules in their fixed order; cap=False leaves out the action/object cap (reviewed rows)."""
    df = decisions.withColumns({f"_rule_{n}": c for n, c in fields_of(decisions.columns).items()})
    for rule in cascade(p, cap):
        df = df.withColumns(rule(Columns(), p))
    always = F.spark_partition_id() >= 0  # true in every row, but not deterministic
    return df.select(*[F.when(always, F.col(f"_rule_{c}")).alias(c) if c in TYPES else F.col(c) for c in decisions.columns])


def _bind(state: Column, rule, p: Params) -> Column:
    return F.transform(F.array(state), lambda v: rule(State(v), p))[0]
