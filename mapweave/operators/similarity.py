"""Similarity signals of a given pair of atoms, as Columns over two feature structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mapweave.functions.labels import control_family
from mapweave.functions.text import casefold, category_norm, family_of, token_set, tokens
from mapweave.functions.vectors import cosine
from mapweave.params import ACTION_OBJECT_FIELDS, DEFAULTS, STRUCTURED_WEIGHTS, Params

FIELDS = list(STRUCTURED_WEIGHTS)


def category_keys(atom_primary: Column, category: Column, secondary: Column, use_secondary: bool = True) -> Column:
    """Distinct match keys in order: primary (or category), category, secondaries."""
    primary = F.when(F.coalesce(atom_primary, F.lit("")) == "", category).otherwise(atom_primary)
    parts = [F.array(category_norm(primary), category_norm(category))]
    if use_secondary:
        parts.append(F.transform(F.coalesce(secondary, F.array().cast("array<string>")), lambda k: category_norm(k)))
    return F.array_distinct(F.filter(F.concat(*parts), lambda k: k != ""))


def with_features(atoms: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """atomic_id, order_no, parent_id + everything a pair score needs, computed once per atom.

    Expects fields, atomic_requirement, category attributes and embedding; only compact arrays leave here.
    """
    primary = F.when(F.coalesce(F.col("primary_category"), F.lit("")) == "", F.col("category")).otherwise(
        F.col("primary_category"))
    joined = F.concat_ws(" ", *[F.col(f"fields.{n}") for n in ACTION_OBJECT_FIELDS])
    status = casefold(F.coalesce(F.col("category_status"), F.lit("")))
    conf = F.when(F.col("category_confidence") > 0, F.least(F.col("category_confidence"), F.lit(1.0))).otherwise(0.5)
    low = F.contains(status, F.lit("low")) | F.contains(status, F.lit("review"))
    cols = [
        F.col("atomic_id"), F.col("order_no").cast("long").alias("order_no"), F.col("parent_id"),
        F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")).alias("vec"),
        F.array(*[token_set(F.col(f"fields.{n}")) for n in FIELDS]).alias("sets"),
        token_set(joined).alias("ao"),
        control_family(F.concat_ws(" ", joined, F.col("atomic_requirement")), p.families).alias("control_family"),
        category_norm(primary).alias("primary_key"),
        F.array_distinct(F.filter(F.transform("secondary_categories", lambda k: category_norm(k)), lambda k: k != ""))
        .alias("secondary_keys"),
        category_keys(F.col("primary_category"), F.col("category"), F.col("secondary_categories"),
                      p.secondary_matching).alias("keys"),
        conf.alias("confidence"), (low | (conf < 0.60)).alias("low_confidence"),
        F.upper(family_of(F.col("parent_id"))).alias("id_family"),
        (tokens(F.col("keyword_text")) if "keyword_text" in atoms.columns
         else F.array().cast("array<string>")).alias("terms"),
    ]
    return atoms.select(*cols)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def structured_similarity(a: Column, b: Column) -> Column:
    """Weighted mean of the field Jaccards; fields empty on both sides do not count."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for i, w in enumerate(STRUCTURED_WEIGHTS.values()):
        x, y = a["sets"][i], b["sets"][i]
        present = (F.size(x) > 0) | (F.size(y) > 0)
        total = total + F.when(present, jaccard(x, y) * F.lit(w)).otherwise(0.0)
        weight = weight + F.when(present, F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(F.lit(0.0))


def action_object_similarity(a: Column, b: Column) -> Column:
    fa, fb = a["control_family"], b["control_family"]
    same, differ = (fa != "") & (fa == fb), (fa != "") & (fb != "") & (fa != fb)
    shift = F.when(same, 0.25).when(differ, -0.25).otherwise(0.0)
    empty = (F.size(a["ao"]) == 0) | (F.size(b["ao"]) == 0)
    return (F.when(empty, F.when(same, 0.20).otherwise(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), jaccard(a["ao"], b["ao"]) + shift))))


def control_type_similarity(a: Column, b: Column) -> Column:
    i = FIELDS.index("control_type")
    x, y = a["sets"][i], b["sets"][i]
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(jaccard(x, y))


def category_prior(a: Column, b: Column) -> Column:
    pa, pb = a["primary_key"], b["primary_key"]
    raw = (F.when((pa != "") & (pa == pb), 1.0)
           .when((pa != "") & F.array_contains(b["secondary_keys"], pa), 0.70)
           .when((pb != "") & F.array_contains(a["secondary_keys"], pb), 0.70)
           .when(F.arrays_overlap(a["secondary_keys"], b["secondary_keys"]), 0.45).otherwise(0.0))
    factor = F.greatest(F.lit(0.15), F.least(a["confidence"], b["confidence"]))
    factor = F.when(a["low_confidence"] | b["low_confidence"], F.least(factor, F.lit(0.30))).otherwise(factor)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * factor))


def combined_score(semantic, keyword, structured, action_object, control_type, prior, p: Params = DEFAULTS) -> Column:
    base = (semantic * p.weight_semantic + keyword * p.weight_keyword + structured * p.weight_structured
            + action_object * p.weight_action_object + control_type * p.weight_control_type) / F.lit(p.weight_sum)
    return F.least(F.lit(1.0), base + prior * p.weight_category_prior)


def signal(name: str, a: Column, b: Column, p: Params = DEFAULTS) -> Column:
    """One signal of a pair of feature structs, as <name>_score, at the precision of the search."""
    zero = F.lit(0.0)
    value = {
        "semantic": lambda: F.greatest(zero, cosine(a["vec"], b["vec"])) if p.use_semantic else zero,
        "keyword": lambda: zero,
        "structured": lambda: structured_similarity(a, b) if p.use_structured else zero,
        "action_object": lambda: action_object_similarity(a, b) if p.use_structured else zero,
        "control_type": lambda: control_type_similarity(a, b) if p.use_structured else zero,
        "category_prior": lambda: category_prior(a, b),
    }[name]()
    return F.round(value, 12).alias(f"{name}_score")


def with_combined(scored: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds the combined score; a signal that is not there counts as zero."""
    names = ["semantic", "keyword", "structured", "action_object", "control_type", "category_prior"]
    found = [F.col(f"{n}_score") if f"{n}_score" in scored.columns else F.lit(0.0) for n in names]
    return scored.withColumn("combined_score", F.round(combined_score(*found, p), 9))


def score_pairs(pairs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pairs with feature structs a and b -> all signals and the combined score, at the precision of the search."""
    names = ["semantic", "keyword", "structured", "action_object", "control_type", "category_prior"]
    scored = pairs.select(*[c for c in pairs.columns if c not in ("a", "b")], *[signal(n, F.col("a"), F.col("b"), p) for n in names])
    return with_combined(scored, p)
