"""Tolerant readers for values written by people or models, and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mapweave.functions.text import collapse

# Verbal scale, boolean words and the shape of a gap item.
VERBAL_SCALE = [("very high", 0.95), ("very low", 0.2), ("moderate", 0.6), ("medium", 0.6), ("high", 0.85), ("low", 0.35)]
TRUE_CELLS = ["true", "vrai", "1", "yes", "oui", "y", "o", "x", "✓", "✔", "essential", "important"]
FALSE_CELLS = ["false", "faux", "0", "no", "non", "n", "", "na", "n/a", "-"]
SAME_WORDS = ["true", "yes", "same", "same_domain"]
DIFFERENT_WORDS = ["false", "no", "different", "different_domain"]
GAP_ITEM = "struct<dimension:string,gap:string,severity:string,target_coverage:string>"
RAW_GAP_ITEM = ("struct<dimension:string,missing_dimension:string,gap:string,missing_element:string,"
                "residual_gap:string,severity:string,target_coverage:string,coverage_note:string>")


def first_text(*cols: Column) -> Column:
    """First argument that is neither null nor ''; '' when there is none."""
    return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(""))


def tolerant_float(c: Column, default: float = 0.0) -> Column:
    t = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    verbal = F.lit(None).cast("double")
    for word, score in reversed(VERBAL_SCALE):
        verbal = F.when(F.contains(t, F.lit(word)), F.lit(score)).otherwise(verbal)
    # a cast that fails is dear: only what can be a number is tried
    return F.coalesce(F.when(t.rlike("[0-9]|inf|nan"), t.try_cast("double")), verbal, F.lit(float(default)))


def tolerant_int(c: Column, default: int = 0) -> Column:
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    whole = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))
    return F.coalesce(whole, F.bround(t.try_cast("double")).try_cast("int"), F.lit(int(default)))


def number_to_int(c: Column, default: int = 0) -> Column:
    """A value that is already numeric is truncated, not rounded."""
    return F.coalesce(c.try_cast("int"), F.lit(int(default)))


def tri_bool(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(SAME_WORDS), True).when(t.isin(DIFFERENT_WORDS), False)


def cell_bool(c: Column, default: bool) -> Column:
    t = F.lower(collapse(c))
    return F.when(t.isin(TRUE_CELLS), True).when(t.isin(FALSE_CELLS), False).otherwise(F.lit(default))


def content_hash(*cols: Column) -> Column:
    """16 hex digits naming the content of the given columns; equal content, equal hash."""
    return F.substring(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256), 1, 16)


def gap_items(c: Column) -> Column:
    """JSON object or list of objects -> array of gap items; entries without gap text are dropped."""
    t = F.trim(F.coalesce(c, F.lit("")))
    text = F.when(F.startswith(t, F.lit("{")), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)
    raw = F.coalesce(F.from_json(text, f"array<{RAW_GAP_ITEM}>"), F.array().cast(f"array<{RAW_GAP_ITEM}>"))
    items = F.transform(F.filter(raw, lambda r: r.isNotNull()), lambda r: F.struct(
        F.when(first_text(r.dimension, r.missing_dimension) == "", F.lit("explicitness"))
        .otherwise(first_text(r.dimension, r.missing_dimension)).alias("dimension"),
        F.trim(first_text(r.gap, r.missing_element, r.residual_gap)).alias("gap"),
        F.when(first_text(r.severity) == "", F.lit("moderate")).otherwise(r.severity).alias("severity"),
        first_text(r.target_coverage, r.coverage_note).alias("target_coverage"),
    ))
    return F.filter(items, lambda r: r.gap != "")
