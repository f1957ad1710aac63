"""Label taxonomies: normalisers and bands. Each takes Columns and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mapweave.functions.text import casefold
from mapweave.params import CONTROL_FAMILIES

# Alias tables and ordered keyword rules.
GAP_ALIASES = {
    "true_gap": ["gap", "no_match", "no_coverage", "true_gap"],
    "partial_gap": ["partial", "partial_gap", "partially_covered"],
    "implementation_detail_gap": ["implementation", "implementation_gap", "implementation_detail",
                                  "implementation_detail_gap", "detail_gap"],
    "indirect_support_gap": ["indirect", "indirect_support", "supportive", "indirect_support_gap"],
    "conflict_gap": ["conflict", "conflict_gap"],
    "none": ["none", "no_gap"],
}
RELATION_ALIASES = {
    "direct_full_coverage": ["exact", "exact_match", "full"],
    "mostly_covered": ["mostly_equivalent", "mostly_covered"],
    "partial": ["partial", "partially_covered"],
    "composite_coverage": ["composite", "composite_coverage"],
    "implementation_detail_gap": ["implementation_detail_gap"],
    "indirect_support": ["indirect", "indirect_support", "supportive"],
    "true_gap": ["gap", "no_match", "true_gap"],
    "conflict": ["conflict"],
    "not_covered": ["not_covered"],
}
PARENT_GAP_ALIASES = {
    "none": ["none", "no_gap"],
    "true_gap": ["true_gap", "gap", "not_covered"],
    "partial_gap": ["partial", "partial_gap"],
    "implementation_detail_gap": ["implementation", "implementation_gap", "implementation_detail",
                                  "implementation_detail_gap"],
    "indirect_support_gap": ["indirect", "supportive", "indirect_support", "indirect_support_gap"],
    "conflict_gap": ["conflict", "conflict_gap"],
}
SYNTHESIS_GAP_ALIASES = {
    "none": ["none", "no_gap"],
    "true_gap": ["true_gap", "gap"],
    "partial_gap": ["partial_gap", "partial"],
    "implementation_detail_gap": ["implementation_gap", "implementation_detail", "implementation_detail_gap"],
    "indirect_support_gap": ["indirect", "indirect_support", "indirect_support_gap"],
    "conflict_gap": ["conflict", "conflict_gap"],
}
SYNTHESIS_RELATIONS = {
    "none": "direct_full_coverage", "partial_gap": "partial",
    "implementation_detail_gap": "implementation_detail_gap", "indirect_support_gap": "indirect_support",
    "conflict_gap": "conflict", "true_gap": "true_gap",
}
DIMENSIONS = ["actor", "action", "object", "scope", "condition", "deadline", "evidence", "governance",
              "explicitness", "control_type"]
DIMENSION_ALIASES = {
    "actor": ["actors", "role"],
    "governance": ["responsibility", "responsibilities", "process", "procedure"],
    "deadline": ["frequency", "timing"],
    "evidence": ["proof", "documentation"],
    "explicitness": ["explicit", "specificity", "granularity"],
}
SYNTHESIS_DIMENSIONS = ["actor", "action", "object", "scope", "condition", "deadline", "evidence", "governance",
                        "explicitness", "implementation"]
SYNTHESIS_DIMENSION_ALIASES = {
    "actor": ["actors", "role", "roles"],
    "governance": ["process", "responsibility", "responsibilities"],
    "implementation": ["procedure"],
    "deadline": ["frequency", "timing"],
    "evidence": ["proof", "documentation"],
    "explicitness": ["explicit", "clarity", "specificity"],
}
DIMENSION_ORDER = ["action", "object", "scope", "actor", "condition", "deadline", "evidence", "governance",
                   "control_type", "explicitness"]
DIMENSION_WORDS = [
    ("actor", ["actor", "role", "responsible", "entity", "personnel", "third party", "prestataire"]),
    ("evidence", ["evidence", "record", "documented", "proof", "trace", "journal", "documenté", "preuve"]),
    ("deadline", ["deadline", "frequency", "periodic", "annual", "monthly", "timeframe", "délai", "périodique",
                  "annuel"]),
    ("scope", ["scope", "perimeter", "critical", "essential", "ot", "ict", "all systems", "périmètre", "critique"]),
    ("condition", ["condition", "where", "when", "if", "risk-based", "as necessary", "si", "lorsque"]),
    ("governance", ["policy", "procedure", "governance", "approval", "responsibility", "process", "politique",
                    "procédure"]),
    ("action", ["define", "implement", "review", "test", "monitor", "notify", "maintain", "mettre en œuvre",
                "surveiller", "notifier", "tester"]),
    ("object", ["asset", "system", "account", "access", "data", "backup", "logs", "ressource", "compte", "données"]),
]
IMPLEMENTATION_DIMS = ["evidence", "deadline", "condition", "governance", "explicitness"]
MATERIAL_DIMS = ["actor", "action", "object", "scope"]
MATERIAL_WORDS = ["critical", "high", "material", "major"]
BUCKET_LABELS = {0: "Not covered", 25: "Indirectly covered", 50: "Partially covered", 75: "Largely covered",
                 100: "Fully covered"}
GOLD_LABELS = [
    ("not covered", 0), ("non couvert", 0), ("indirect", 25), ("partial", 50), ("partiel", 50),
    ("largely", 75), ("largement", 75), ("mostly", 75), ("fully covered", 100), ("exact", 100),
    ("covered", 100), ("couvert", 100),
]


def lookup(key: Column, groups: dict, default: Column | None = None) -> Column:
    """Map a value through {result: [aliases]}; null, or the default, when it has no alias."""
    found = {}
    for result, aliases in groups.items():
        for alias in aliases:
            found.setdefault(alias, result)
    # one look into a constant map: a chain of conditions would make the key anew for each of them
    value = F.try_element_at(F.create_map(*[F.lit(x) for pair in found.items() for x in pair]), key)
    return value if default is None else F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def label_key(c: Column) -> Column:
    return F.translate(F.trim(casefold(F.coalesce(c, F.lit("")))), " -", "__")


def gap_type(value: Column, coverage: Column, relation: Column) -> Column:
    band = (F.when(coverage >= 100, "none").when(coverage >= 40, "partial_gap")
            .when(coverage >= 10, "indirect_support_gap").otherwise("true_gap"))
    return F.coalesce(lookup(label_key(value), GAP_ALIASES), lookup(label_key(relation), GAP_ALIASES), band)


def relation_type(value: Column, coverage: Column, gap: Column) -> Column:
    band = (F.when(coverage >= 100, "direct_full_coverage").when(coverage >= 80, "mostly_covered")
            .when(coverage >= 40, "partial").when(coverage >= 10, "indirect_support").otherwise("true_gap"))
    return (F.when((gap == "implementation_detail_gap") & (coverage > 0), "implementation_detail_gap")
            .when((gap == "partial_gap") & (coverage >= 40), "partial")
            .otherwise(F.coalesce(lookup(label_key(value), RELATION_ALIASES), band)))


def parent_gap_label(value: Column) -> Column:
    key = label_key(value)
    return lookup(key, PARENT_GAP_ALIASES, F.when(key == "", "").otherwise("partial_gap"))


def gap_type_from_coverage(coverage: Column, relation: Column) -> Column:
    return (F.when(coverage >= 100, "none")
            .when(F.contains(casefold(F.coalesce(relation, F.lit(""))), F.lit("implementation")),
                  "implementation_detail_gap")
            .when(coverage >= 40, "partial_gap").when(coverage >= 10, "indirect_support_gap").otherwise("true_gap"))


def dimension(value: Column, allowed=DIMENSIONS, aliases=DIMENSION_ALIASES) -> Column:
    key = casefold(F.trim(F.coalesce(value, F.lit(""))))
    return lookup(key, aliases, F.when(key.isin(list(allowed)), key).otherwise("explicitness"))


def synthesis_dimension(value: Column) -> Column:
    return dimension(value, SYNTHESIS_DIMENSIONS, SYNTHESIS_DIMENSION_ALIASES)


def severity(value: Column) -> Column:
    key = F.trim(casefold(F.coalesce(value, F.lit(""))))
    return (F.when(key.isin(MATERIAL_WORDS), "material").when(key.isin("low", "minor", "residual"), "minor")
            .otherwise("moderate"))


def synthesis_severity(value: Column) -> Column:
    key = F.trim(casefold(F.coalesce(value, F.lit(""))))
    return (F.when(key.isin(MATERIAL_WORDS), "material").when(key.isin("low", "minor"), "minor")
            .otherwise("moderate"))


def severity_rank(value: Column) -> Column:
    s = severity(value)
    return F.when(s == "material", 0).when(s == "minor", 2).otherwise(1)


def severity_from_coverage(coverage: Column) -> Column:
    return F.when(coverage <= 25, "material").when(coverage <= 50, "moderate").otherwise("minor")


def infer_dimension(text: Column, preferred: Column) -> Column:
    """The first preferred value decides; otherwise the first rule with a keyword in the text."""
    t = casefold(F.coalesce(text, F.lit("")))
    out = F.lit("explicitness")
    for dim, words in reversed(DIMENSION_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        out = F.when(hit, F.lit(dim)).otherwise(out)
    return F.when(F.size(preferred) > 0, dimension(F.try_element_at(preferred, F.lit(1)))).otherwise(out)


def bucket(coverage: Column) -> Column:
    """Nearest of 0/25/50/75/100, ties up; outside values are clamped by the bands."""
    c = F.coalesce(coverage.cast("double"), F.lit(0.0))
    return (F.when(c >= 87.5, 100).when(c >= 62.5, 75).when(c >= 37.5, 50).when(c >= 12.5, 25).otherwise(0))


def score_level(coverage: Column) -> Column:
    """Truncated to an integer, then nearest multiple of ten, ties down, within 0..100."""
    c = F.coalesce(coverage.try_cast("int"), F.lit(0))
    return F.least(F.greatest(F.ceil((c - 5) / F.lit(10.0)) * 10, F.lit(0)), F.lit(100)).cast("int")


def bucket_label(coverage: Column) -> Column:
    b = bucket(coverage)
    out = F.lit(BUCKET_LABELS[0])
    for level in (25, 50, 75, 100):
        out = F.when(b == level, BUCKET_LABELS[level]).otherwise(out)
    return out


def category_status(avg: Column) -> Column:
    return F.when(avg >= 70, "✓ Good").when(avg >= 50, "⚠ Fair").otherwise("✗ Poor")


def short_category(c: Column) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*\d+\.\s*", ""))
    return F.rtrim(F.substring(text, 1, 40))


def gold_bucket(cell: Column) -> Column:
    """Free label text -> bucket; null for empty or long cells and for cells without a known label."""
    t = F.lower(F.trim(F.coalesce(cell, F.lit(""))))
    out = F.lit(None).cast("int")
    for key, value in reversed(GOLD_LABELS):
        out = F.when(F.contains(t, F.lit(key)), F.lit(value)).otherwise(out)
    return F.when((t != "") & (F.length(t) <= 40), out)


def equivalence(coverage: Column) -> Column:
    return (F.when(coverage >= 100, "Exact match").when(coverage >= 40, "Partial")
            .when(coverage >= 10, "Indirect").otherwise("Gap"))


def risk(coverage: Column, equivalence_level: Column, match_type: Column) -> Column:
    return (F.when((coverage <= 20) | (equivalence_level == "Gap"), "High")
            .when((coverage < 80) | (match_type == "Composite"), "Medium")
            .when(coverage < 100, "Low").otherwise("None"))


def control_family(text: Column, families=CONTROL_FAMILIES) -> Column:
    """First family, in order, with any of its words in the text; '' when none."""
    def first(t: Column) -> Column:
        out = F.lit("")
        for name, words in reversed(list(families)):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(t, F.lit(w))
            out = F.when(hit, F.lit(name)).otherwise(out)
        return out
    # the one-element transform binds the folded text once instead of folding it for every word
    return F.transform(F.array(casefold(F.coalesce(text, F.lit("")))), first)[0]
