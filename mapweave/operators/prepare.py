"""Preparation: atoms, fields, texts, vectors, chunks and flags. Narrow except where a table is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mapweave.functions.text import WHITE, collapse, tokens
from mapweave.functions.vectors import hash_embedding
from mapweave.params import DEFAULTS, OBLIGATION_WORDS, SEPARATORS, TEXT_FIELDS

LONG_PART = 120


def _java_quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def _splitter(sep: str):
    pattern = "(?i)" + _java_quote(sep)

    def pieces(p: Column) -> Column:
        cut = F.transform(F.split(p, pattern), lambda x: F.btrim(x, F.lit(" .")))
        splits = (F.length(p) > LONG_PART) & F.contains(F.lower(p), F.lit(sep))
        return F.when(splits, F.filter(cut, lambda x: x != "")).otherwise(F.array(p))
    return pieces


def atom_parts(text: Column, separators=SEPARATORS, collapsed: bool = False) -> Column:
    """Text -> array of parts. Each separator in turn splits the parts that hold it and are long.

    collapsed: the text has been through collapse() already, which is not repeated.
    """
    text = text if collapsed else collapse(text)
    parts = F.array(text)
    for sep in separators:
        parts = F.flatten(F.transform(parts, _splitter(sep)))
    # the one-element transform binds the parts once instead of evaluating the whole chain twice
    return F.transform(F.array(parts), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))[0]


def atomize(reqs: DataFrame, separators=SEPARATORS, collapsed: bool = False) -> DataFrame:
    """requirements -> atoms (parent_id, atom_no, atomic_id, atomic_requirement + the row's columns)."""
    exploded = reqs.select("*", F.posexplode(atom_parts(F.col("requirement"), separators, collapsed)).alias("_p", "_t"))
    return _as_atoms(exploded.withColumn("atom_no", F.col("_p") + 1).drop("_p"))


def _as_atoms(df: DataFrame) -> DataFrame:
    return (df.withColumnRenamed("source_id", "parent_id").withColumnRenamed("requirement", "parent_requirement")
            .withColumn("atomic_id", F.concat("parent_id", F.lit("#"), F.col("atom_no").cast("string")))
            .withColumnRenamed("_t", "atomic_requirement"))


ATOM_LIST = "array<struct<text:string,rationale:string>>"


def atomize_from_lists(reqs: DataFrame, supplied: DataFrame, separators=SEPARATORS) -> DataFrame:
    """Atoms from supplied JSON lists (source_id, atoms_json).

    Items are objects with a text or plain strings. Blank items are skipped but keep their number; a row
    whose list is empty or all blank becomes one atom, a row with no or unreadable list is split by rule.
    """
    objects = F.from_json("atoms_json", ATOM_LIST)
    plain = F.transform(F.from_json("atoms_json", "array<string>"), lambda x: F.struct(
        x.alias("text"), F.lit("").alias("rationale")))
    is_objects = F.col("atoms_json").rlike(r"^\s*\[\s*\{")
    lists = supplied.select("source_id", F.when(is_objects, objects).otherwise(plain).alias("_items"))
    joined = reqs.join(lists, "source_id", "left")
    usable = F.filter(
        F.transform(F.col("_items"), lambda x, i: F.struct(
            (i + 1).alias("atom_no"), collapse(x["text"]).alias("text"),
            collapse(x["rationale"]).alias("rationale"))),
        lambda x: x["text"] != "")
    whole = lambda why: F.array(F.struct(F.lit(1).alias("atom_no"), collapse(F.col("requirement")).alias("text"),
                                         F.lit(why).alias("rationale")))
    rule = F.transform(atom_parts(F.col("requirement"), separators), lambda x, i: F.struct(
        (i + 1).alias("atom_no"), x.alias("text"), F.lit("heuristic").alias("rationale")))
    chosen = (F.when(F.col("_items").isNull(), rule)
              .when(F.size("_items") == 0, whole("No atomization returned"))
              .when(F.size(usable) == 0, whole("fallback_empty_atomization")).otherwise(usable))
    out = joined.select("*", F.explode(chosen).alias("_a")).select(
        *reqs.columns, F.col("_a.atom_no").alias("atom_no"), F.col("_a.text").alias("_t"),
        F.col("_a.rationale").alias("atomization_rationale"))
    return _as_atoms(out)


def rule_fields(text: Column, category: Column, control_type: Column | None = None) -> Column:
    """struct of the ten fields read off the token list; kept as one struct so tokens are computed once. A column for the
    control type comes in here: withField would take the struct apart and compute the tokens for each of its members."""
    found = tokens(text)
    low = F.lower(text)
    flag = F.lit(False)
    for w in OBLIGATION_WORDS:
        flag = flag | F.contains(low, F.lit(w))

    def build(t: Column) -> Column:
        e = F.lit("")
        return F.struct(
            category.alias("domain"), e.alias("actor"),
            F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("action"),
            F.array_join(F.slice(t, 2, 4), " ").alias("object"),
            e.alias("condition"), e.alias("deadline"), e.alias("evidence"),
            F.when(flag, "shall/must").otherwise("").alias("obligation_type"),
            (e if control_type is None else control_type).alias("control_type"), F.slice(t, 1, 12).alias("keywords"))
    return F.transform(F.array(found), build)[0]


def add_fields(atoms: DataFrame, control_type: Column | None = None) -> DataFrame:
    return (atoms.withColumn("fields", rule_fields(F.col("atomic_requirement"), F.col("category"), control_type))
            .withColumn("keywords", F.when(F.size("fields.keywords") > 0, F.col("fields.keywords"))
                        .otherwise(tokens(F.col("atomic_requirement")))))


SUPPLIED_FIELDS = ("struct<domain:string,actor:string,action:string,object:string,condition:string,deadline:string,"
                   "evidence:string,obligation_type:string,control_type:string,keywords:array<string>>")


def merge_supplied_fields(atoms: DataFrame, supplied: DataFrame) -> DataFrame:
    """Supplied field JSON (atomic_id, fields_json) replaces the rule fields; null members become ''."""
    parsed = supplied.select("atomic_id", F.from_json("fields_json", SUPPLIED_FIELDS).alias("_f"),
                             F.get_json_object("fields_json", "$.keywords").alias("_kw"))
    j = add_fields(atoms).join(parsed, "atomic_id", "left")
    names = [n for n in TEXT_FIELDS] + ["obligation_type"]
    given = F.transform(F.filter(F.col("_f.keywords"), lambda k: collapse(k) != ""), lambda k: F.lower(collapse(k)))
    listed = F.coalesce(given, F.array().cast("array<string>"))
    cleaned = (F.when(F.startswith(F.col("_kw"), F.lit("[")), listed)
               .otherwise(tokens(F.coalesce("_kw", F.lit("")))))
    members = [F.coalesce(F.col(f"_f.{n}"), F.lit("")).alias(n) for n in names]
    built = F.struct(*members, cleaned.alias("keywords"))
    order = ["domain", "actor", "action", "object", "condition", "deadline", "evidence", "obligation_type",
             "control_type", "keywords"]
    built = F.struct(*[built[n].alias(n) for n in order])
    use = F.col("_f").isNotNull()
    keywords = F.when(use & (F.size(cleaned) > 0), cleaned).when(use, tokens(F.col("atomic_requirement"))).otherwise(
        F.col("keywords"))
    return j.withColumns({"fields": F.when(use, built).otherwise(F.col("fields")), "keywords": keywords}).drop(
        "_f", "_kw")


def matching_text(category: Column, subcategory: Column, text: Column, fields: Column, keywords: Column) -> Column:
    return F.concat_ws(" ", category, subcategory, text, *[fields[n] for n in TEXT_FIELDS],
                       F.array_join(keywords, " "))


def add_matching_text(atoms: DataFrame) -> DataFrame:
    return atoms.withColumn("matching_text", matching_text(
        F.col("category"), F.col("subcategory"), F.col("atomic_requirement"), F.col("fields"), F.col("keywords")))


def translate(reqs: DataFrame, translations: DataFrame) -> DataFrame:
    """Left join of (source_id, source_language, requirement_en, title_en); originals are kept.

    An empty or equal translation leaves the row unchanged apart from its language.
    """
    t = translations.select("source_id", F.lower(collapse(F.col("source_language"))).alias("_lang"),
                            collapse(F.col("requirement_en")).alias("_req"), collapse(F.col("title_en")).alias("_title"))
    j = reqs.join(t, "source_id", "left")
    known = F.col("_req").isNotNull()
    moved = known & (F.col("_req") != "") & (F.col("_req") != F.col("requirement"))
    return j.select(
        *[c for c in reqs.columns if c not in ("requirement", "title")],
        F.when(moved, F.col("_req")).otherwise(F.col("requirement")).alias("requirement"),
        F.when(moved & (F.col("_title") != ""), F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.when(moved, F.col("requirement")).otherwise("").alias("original_requirement"),
        F.when(moved, F.col("title")).otherwise("").alias("original_title"),
        F.when(known, F.when(F.col("_lang") == "", "unknown").otherwise(F.col("_lang"))).otherwise("")
        .alias("source_language"),
        F.when(moved, "translated").when(known, "unchanged").otherwise("no_translation").alias("translation_status"))


def translation_counts(translated: DataFrame) -> DataFrame:
    return (translated.groupBy("source_language").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("translation_status") == "translated").alias("translated"),
        F.count_if(F.col("translation_status") == "unchanged").alias("already_english")))


def embed(atoms: DataFrame, text: str = "matching_text", dims: int = DEFAULTS.embedding_dims) -> DataFrame:
    return atoms.withColumn("embedding", hash_embedding(F.col(text), dims))


def repair_embeddings(atoms: DataFrame, text: str = "matching_text", dims: int = DEFAULTS.embedding_dims) -> DataFrame:
    """Null or empty vectors are recomputed, all others kept as they are."""
    broken = F.col("embedding").isNull() | (F.size("embedding") <= 0)
    kept = atoms.filter(~broken).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return kept.unionByName(embed(atoms.filter(broken).drop("embedding"), text, dims).select(*kept.columns))


def chunk_texts(docs: DataFrame, text: str, words: int = DEFAULTS.chunk_words, overlap: int = DEFAULTS.chunk_overlap,
                min_chars: int = 80) -> DataFrame:
    """Overlapping word windows over the whole text; windows of min_chars characters or fewer are left out."""
    step = max(1, words - overlap)
    lst = F.filter(F.split(F.col(text), f"[{WHITE}]+"), lambda w: w != "")
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step)))
    return (docs.withColumn("_w", lst)
            .select(*[c for c in docs.columns if c != text], "_w", F.posexplode(starts).alias("_i", "_s"))
            .withColumn("chunk", F.array_join(F.slice("_w", F.col("_s") + 1, F.lit(words)), " "))
            .filter(F.length("chunk") > min_chars)
            .drop("_w", "_s").withColumnRenamed("_i", "window_no"))


def backfill_flags(atoms: DataFrame, flags: DataFrame) -> DataFrame:
    """essential/important from (source_id, essential, important) by parent; existing values, then
    true/false, where the parent is unknown."""
    f = flags.select(F.col("source_id").alias("parent_id"), F.col("essential").alias("_e"),
                     F.col("important").alias("_i"))
    old = lambda n: F.col(n) if n in atoms.columns else F.lit(None).cast("boolean")
    rest = [c for c in atoms.columns if c not in ("essential", "important")]
    return atoms.join(f, "parent_id", "left").select(
        *rest, F.coalesce("_e", old("essential"), F.lit(True)).alias("essential"),
        F.coalesce("_i", old("important"), F.lit(False)).alias("important"),
        F.col("_e").isNotNull().alias("patched"))


def fingerprint(atoms: DataFrame) -> DataFrame:
    """One row per framework: content fingerprint, atom count and distinct ids.

    Row hashes are added up as numbers, so the result does not depend on row order and nothing is
    collected; changing, adding or removing any row changes the sums. A row hashes its whole parent text, so the hash is a
    column of its own: inside the sums it would be made once for each of them.
    """
    row = F.sha2(F.concat_ws("\x1f", "atomic_id", "parent_id", "atomic_requirement", "parent_requirement"), 256)
    part = lambda i: F.sum(F.conv(F.substring("_row", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
    sums = atoms.select("framework", "parent_id", "atomic_id", row.alias("_row")).groupBy("framework").agg(
        part(0).alias("_a"), part(1).alias("_b"), F.count(F.lit(1)).alias("n_atoms"),
        F.countDistinct("parent_id").alias("n_parents"), F.countDistinct("atomic_id").alias("n_ids"))
    whole = F.concat_ws("|", F.col("_a").cast("string"), F.col("_b").cast("string"), F.col("n_atoms").cast("string"))
    return sums.select("framework", F.substring(F.sha2(whole, 256), 1, 16).alias("fingerprint"), "n_atoms",
                       "n_parents", "n_ids")


def check_not_empty(atoms: DataFrame, name: str) -> None:
    if atoms.limit(1).count() == 0:
        raise ValueError(f"framework {name} has no atoms")


def valid_requirements(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").agg(
        F.count(F.lit(1)).alias("n_requirements"))
