"""Requirement tables: scan, id handling, taxonomy and rule tables, caches and texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from mapweave.functions.text import (casefold, category_key, category_norm, collapse, column_key_of,
                                     split_terms)
from mapweave.functions.values import cell_bool
from mapweave.operators.ranking import position_rank

REQUIRED = ["ID", "Title", "Requirement", "Category"]


@dataclass(frozen=True)
class ColumnMap:
    """Names of the input columns; '' means the table has no such column."""
    requirement: str
    id: str = ""
    title: str = ""
    category: str = ""
    subcategory: str = ""
    essential: str = ""
    important: str = ""
    position: str = "pos"


def resolve_columns(columns: list[str], required: list[str] = REQUIRED) -> tuple[dict[str, str], list[str]]:
    """Match required names to columns ignoring case and punctuation; returns (mapping, missing)."""
    known = {column_key_of(c): c for c in columns}
    mapping = {r: known[column_key_of(r)] for r in required if column_key_of(r) in known}
    return mapping, [r for r in required if r not in mapping]


def check_columns(df: DataFrame, cmap: ColumnMap) -> None:
    if not cmap.requirement:
        raise ValueError("the requirement column must be named")
    wanted = [v for v in (cmap.id, cmap.title, cmap.requirement, cmap.category, cmap.subcategory, cmap.essential,
                          cmap.important, cmap.position) if v]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available columns are {df.columns}")


def cap_rows(df: DataFrame, position: str, n: int) -> DataFrame:
    """First n rows by position; 0 keeps all. Applied before empty rows are dropped."""
    return df.orderBy(position).limit(n) if n > 0 else df


def scan_requirements(df: DataFrame, cmap: ColumnMap, framework: str | Column, max_rows: int = 0) -> DataFrame:
    """Raw table -> requirements with cleaned cells and default ids (positions count from 0)."""
    check_columns(df, cmap)
    df = cap_rows(df, cmap.position, max_rows)
    cell = lambda name: collapse(F.col(name)) if name else F.lit("")
    pos = F.col(cmap.position).cast("long")
    out = df.select(
        (framework if isinstance(framework, Column) else F.lit(framework)).alias("framework"),
        cell(cmap.id).alias("_id"), cell(cmap.title).alias("title"), cell(cmap.requirement).alias("requirement"),
        cell(cmap.category).alias("category"), cell(cmap.subcategory).alias("subcategory"),
        (cell_bool(F.col(cmap.essential), True) if cmap.essential else F.lit(True)).alias("essential"),
        (cell_bool(F.col(cmap.important), False) if cmap.important else F.lit(False)).alias("important"),
        pos.alias("pos"),
    ).filter(F.col("requirement") != "")
    return out.select(
        "framework",
        F.when(F.col("_id") == "", F.concat(F.lit("row_"), F.col("pos") + 2)).otherwise(F.col("_id")).alias("source_id"),
        "title", "requirement", "category", category_norm(F.col("category")).alias("category_key"),
        "subcategory", "essential", "important", (F.col("pos") + 2).alias("row_number"), "pos",
    )


def disambiguate_ids(reqs: DataFrame) -> DataFrame:
    """Second and later rows of an id become id__row_N.

    Only ids with more than one row are joined back, with their first position; the side of the rows may be split, so an id
    that repeats over a large part of the table does not meet in one task.
    """
    keys = ["framework", "source_id"]
    firsts = reqs.groupBy(*keys).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    again = F.coalesce(F.col("pos") > F.col("_first"), F.lit(False))
    renamed = F.concat(F.col("source_id"), F.lit("__row_"), F.col("pos") + 2)
    return (reqs.join(firsts, keys, "left").withColumn("source_id", F.when(again, renamed).otherwise(F.col("source_id")))
            .select(*reqs.columns))


def duplicate_ids(reqs: DataFrame) -> DataFrame:
    return (reqs.groupBy("framework", "source_id").agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))


def collapsed_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Ids that repeat in a numerically stored id column (a lost trailing zero); text columns give no rows."""
    numeric = isinstance(df.schema[id_column].dataType, T.NumericType)
    ids = df.filter(F.col(id_column).isNotNull()).select(F.trim(F.col(id_column).cast("string")).alias("id"))
    found = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    return found if numeric else found.filter(F.lit(False))


def renumber_ids(df: DataFrame, id_column: str, position: str, expected: DataFrame) -> DataFrame:
    """Rebuild family.n ids in row order, but only when every family has its expected row count.

    `expected` has columns family, n_expected. Rows keep their id when the counts disagree anywhere.
    """
    raw = F.trim(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    rows = df.withColumn("_family", F.when(F.contains(raw, F.lit(".")), F.trim(F.substring_index(raw, ".", 1))))
    ranked = position_rank(rows.filter(F.col("_family").isNotNull()), ["_family"], position, "_n")
    counts = rows.filter(F.col("_family").isNotNull()).groupBy("_family").agg(F.count(F.lit(1)).alias("_found"))
    verdict = (counts.join(expected, F.col("_family") == F.col("family"), "full_outer")
               .agg(F.coalesce(F.bool_and(F.coalesce(F.col("_found") == F.col("n_expected"), F.lit(False))),
                               F.lit(False)).alias("_ok")))
    new_id = F.concat_ws(".", "_family", F.col("_n").cast("string"))
    done = ranked.join(F.broadcast(verdict)).withColumn(  # verdict is a single row
        "new_id", F.when(F.col("_ok"), new_id).otherwise(raw)).drop("_family", "_n", "_ok")
    blank = rows.filter(F.col("_family").isNull()).withColumn("new_id", raw).drop("_family")
    return done.unionByName(blank)


def overlay_affinity(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(key, families) defaults replaced per key by overrides; keys and families in upper case."""
    up = lambda df, name: df.select(
        F.upper("key").alias("key"), F.transform("families", F.upper).alias(name))
    return (up(defaults, "d").join(up(overrides, "o"), "key", "full_outer")
            .select("key", F.coalesce("o", "d").alias("families")))


def overlay_prices(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(model, input, output): override fields win one by one; a new model starts from zero prices."""
    o = overrides.select("model", F.col("input").alias("_i"), F.col("output").alias("_o"))
    return (defaults.join(o, "model", "full_outer")
            .select("model", F.coalesce("_i", "input", F.lit(0.0)).alias("input"),
                    F.coalesce("_o", "output", F.lit(0.0)).alias("output")))


def parse_json_lines(lines: DataFrame, column: str, schema: str | T.StructType) -> DataFrame:
    """One record per parseable line; blank and malformed lines are skipped."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    strict = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    rec = F.from_json(F.col(column), strict, {"columnNameOfCorruptRecord": "_bad"})
    return (lines.filter(F.trim(F.col(column)) != "").withColumn("_r", rec)
            .filter(F.col("_r").isNotNull() & F.col("_r._bad").isNull())
            .select(*[c for c in lines.columns if c != column], *[F.col(f"_r.{f.name}") for f in schema.fields]))


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keyed cache: the last value written for a key wins."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_v"))
            .select(key, *[F.col(f"_v.{c}").alias(c) for c in rest]))


def read_guidelines(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def guideline_texts(df: DataFrame, name: str) -> DataFrame:
    """Only plain text and markdown files are read as guidelines."""
    return df.filter(F.lower(F.col(name)).rlike(r"\.(txt|md)$"))


CARD_COLUMNS = {
    "subcategories": ["Sub category", "Subcategory", "Subcategories"],
    "positive_en": ["Positive keywords EN", "Keywords EN", "Positive keywords"],
    "positive_fr": ["Positive keywords FR", "Keywords FR"],
    "negative": ["Negative keywords", "Exclusion keywords"],
    "actions": ["Typical actions", "Actions"],
    "objects": ["Typical objects", "Objects"],
    "examples": ["Examples", "Positive examples"],
    "counterexamples": ["Counterexamples", "Negative examples"],
}


def _alias(df: DataFrame, *names: str) -> Column:
    known = {column_key_of(c): c for c in df.columns}
    for n in names:
        if column_key_of(n) in known:
            return collapse(F.col(known[column_key_of(n)]))
    return F.lit("")


def load_cards(df: DataFrame, position: str = "pos") -> DataFrame:
    """Taxonomy sheet -> cards with term lists, key and leading number; rows without category are skipped."""
    if "category" not in {column_key_of(c) for c in df.columns}:
        raise ValueError("the taxonomy table needs a Category column")
    cols = [F.col(position).cast("int").alias("card_pos"), _alias(df, "Category").alias("category"),
            _alias(df, "Definition", "Description").alias("definition"),
            _alias(df, "Strict rules", "Rules").alias("strict_rules")]
    known = {column_key_of(c): c for c in df.columns}
    for name, aliases in CARD_COLUMNS.items():
        source = next((known[column_key_of(a)] for a in aliases if column_key_of(a) in known), None)
        cols.append((split_terms(collapse(F.col(source))) if source else F.array().cast("array<string>")).alias(name))
    cards = df.select(*cols).filter(F.col("category") != "")
    return cards.withColumn("card_key", category_key(F.col("category"))).withColumn(
        "number", F.regexp_extract("category", r"^\s*(\d+)", 1))


def load_overrides(df: DataFrame, position: str = "pos") -> DataFrame:
    """Override sheet -> enabled rules with defaults; order is priority descending, then position."""
    number = lambda c, d: F.coalesce(c.try_cast("double"), F.lit(float(d)))
    text = lambda c, d: F.when(c == "", F.lit(d)).otherwise(c)
    pattern = _alias(df, "Pattern")
    rules = df.select(
        F.col(position).cast("int").alias("rule_pos"),
        text(_alias(df, "Enabled"), "true").alias("_enabled"), pattern.alias("pattern"),
        number(_alias(df, "Priority"), 100).cast("int").alias("priority"),
        casefold(text(_alias(df, "Match mode"), "contains")).alias("match_mode"),
        casefold(text(_alias(df, "Applies to"), "all")).alias("applies_to"),
        _alias(df, "Primary category", "Force ENISA category").alias("primary_category"),
        split_terms(_alias(df, "Secondary categories")).alias("secondary_categories"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(_alias(df, "Confidence"), 0.98))).alias("confidence"),
        _alias(df, "Reason").alias("reason"),
    )
    return (rules.filter((F.col("pattern") != "") & (F.col("primary_category") != "")
                         & ~casefold(F.col("_enabled")).isin("false", "0", "no", "non"))
            .withColumn("reason", F.when(F.col("reason") == "", F.concat(F.lit("override: "), "pattern"))
                        .otherwise(F.col("reason"))).drop("_enabled"))


ATOM_SNAPSHOT = T.StructType([
    T.StructField("framework", T.StringType()), T.StructField("atomic_id", T.StringType()),
    T.StructField("parent_id", T.StringType()), T.StructField("atomic_requirement", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("secondary_categories", T.ArrayType(T.StringType())),
    T.StructField("category_confidence", T.DoubleType()), T.StructField("category_status", T.StringType()),
    T.StructField("essential", T.BooleanType()), T.StructField("important", T.BooleanType()),
])
_DEFAULTS = {"keywords": F.array, "secondary_categories": F.array, "category_confidence": lambda: F.lit(0.0),
             "essential": lambda: F.lit(True), "important": lambda: F.lit(False)}


def atoms_from_snapshot(lines: DataFrame, column: str) -> DataFrame:
    """JSON snapshot rows -> atoms; missing columns get defaults, unknown ones are dropped."""
    rec = lines.select(F.from_json(F.col(column), ATOM_SNAPSHOT).alias("a")).filter(F.col("a").isNotNull())
    cols = []
    for f in ATOM_SNAPSHOT.fields:
        default = _DEFAULTS[f.name]() if f.name in _DEFAULTS else F.lit("")
        cols.append(F.coalesce(F.col(f"a.{f.name}"), default.cast(f.dataType)).alias(f.name))
    return rec.select(*cols)

