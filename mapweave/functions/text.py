"""Text functions: Column -> Column, all evaluated inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from mapweave.params import STOP_WORDS

# Every character that counts as white space.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# matches only what has to change, so a single blank between words costs no replacement; most characters are printable
# ASCII, which one comparison rules out before the long class is tried
WHITE_RUN = f"(?![!-~])(?:[{WHITE}]{{2,}}|[{WHITE}&&[^ ]])"
TOKEN = "[a-zA-Z0-9_-]{2,}"
GAP_TOKEN = "[a-zA-ZÀ-ÿ0-9]+"
GENERIC_GAP_PHRASES = [
    "target framework does not fully cover the source requirement",
    "review detailed analysis in the atomic sheet",
    "manual review required",
    "no selected target candidate",
    "no sufficient coverage identified",
    "no sufficient match passed retrieval",
    "obvious gap shortcut",
    "coverage capped by object/action gate",
    "coverage downgraded by object/action gate",
    "candidate is kept for traceability",
    "not forced to gap",
]


def literal_array(values) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def collapse(c: Column) -> Column:
    """White space runs become one blank, ends are trimmed, null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(c.cast("string"), WHITE_RUN, " ")), F.lit(""))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def category_norm(c: Column, case_sensitive: bool = False, trim_spaces: bool = True) -> Column:
    c = collapse(c) if trim_spaces else F.coalesce(c.cast("string"), F.lit(""))
    return c if case_sensitive else casefold(c)


def tokens(c: Column, stop=STOP_WORDS) -> Column:
    # white space never belongs to a token, so the text needs no collapsing first
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), 0)
    stop = list(stop)
    return F.filter(found, lambda t: ~t.isin(stop))


def token_set(c: Column, stop=STOP_WORDS) -> Column:
    return F.array_distinct(tokens(c, stop))


def gap_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(casefold(c), F.lit(GAP_TOKEN), 0), lambda t: F.length(t) > 2)


def category_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(collapse(c)), "[^a-z0-9]+", " "))


def column_key(c: Column) -> Column:
    return F.regexp_replace(casefold(c), "[^a-z0-9]+", "")


def column_key_of(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", str(name).casefold())


def family_of(c: Column) -> Column:
    return F.upper(F.trim(F.substring_index(F.coalesce(c, F.lit("")), ".", 1)))


def display_id(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"__row_\d+", "")


def parent_id(c: Column) -> Column:
    """Everything before the last '#'."""
    return F.regexp_replace(c, r"(?s)#[^#]*$", "")


def parent_id_any(c: Column) -> Column:
    """Before the first '#', or else before '__atom'."""
    return (F.when(F.contains(c, F.lit("#")), F.substring_index(c, "#", 1))
            .otherwise(F.substring_index(c, "__atom", 1)))


CONTROL_ID = r"([A-Z]{2}\.[A-Z]{2}-\d+[.\-]\d+)"


def canonical_control_id(c: Column, pattern: str = CONTROL_ID) -> Column:
    """First control id in a cell ('' when none); a second dash is read as a dot."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1)
    dashes = F.length(found) - F.length(F.replace(found, F.lit("-"), F.lit("")))
    return F.when(dashes == 2, F.regexp_replace(found, r"-([^-]*)$", ".$1")).otherwise(found)


def end_sentence(c: Column) -> Column:
    return F.when((c != "") & ~c.rlike(r"[.!?]$"), F.concat(c, F.lit("."))).otherwise(c)


def clean_sentence(c: Column) -> Column:
    return end_sentence(F.btrim(collapse(c), F.lit(" -;\n\t")))


def clean_gap_sentence(c: Column) -> Column:
    s = F.btrim(collapse(c), F.lit(" -\n\t;"))
    s = F.regexp_replace(s, r"^(?U)\w+[\w./-]*#\d+\s*\([^)]*\)\s*->\s*[^:]+:\s*", "")
    s = F.regexp_replace(s, r"^(?i)(gap|residual gap|missing element)\s*:\s*", "")
    return end_sentence(F.btrim(s, F.lit(" -\n\t;")))


def truncate(c: Column, n: int) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    cut = F.concat(F.regexp_replace(F.substring(c, 1, n - 1), f"[{WHITE}]+$", ""), F.lit("…"))
    return F.when(F.length(c) > n, cut).otherwise(c) if n > 0 else c


def split_list(c: Column) -> Column:
    """Comma list -> array of trimmed, non-empty items."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def split_terms(c: Column) -> Column:
    """Term list split on newline, semicolon, pipe or comma; collapsed, distinct, in order."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n;|,]+"), collapse)
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def is_generic_gap(c: Column) -> Column:
    t = casefold(collapse(c))
    hit = F.lit(False)
    for p in GENERIC_GAP_PHRASES:
        hit = hit | F.contains(t, F.lit(p))
    return hit


def gap_points(c: Column) -> Column:
    """Free gap text -> array of cleaned points; gate notes and stock phrases are dropped."""
    t = collapse(c)
    t = F.regexp_replace(t, "(?i)Coverage downgraded by object/action gate:", "")
    t = F.regexp_replace(t, r"(?i)Coverage capped by object/action gate[^.]*\.\s*", "")
    parts = F.transform(F.split(t, r"\n+|\s*[•▪]\s*|(?<=[.;])\s+"), clean_gap_sentence)
    return F.filter(parts, lambda x: (x != "") & ~is_generic_gap(x))


def gap_synthesis_and_detail(c: Column) -> Column:
    """struct(synthesis, detail): text lines before the first bullet, and all bullet lines."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), F.trim)
    bullet = F.transform(lines, lambda x: F.startswith(x, F.lit("•")))
    first = F.array_position(bullet, True)
    head = F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)
    return F.struct(
        F.array_join(F.filter(head, lambda x: x != ""), " ").alias("synthesis"),
        F.array_join(F.filter(lines, lambda x: F.startswith(x, F.lit("•"))), "\n").alias("detail"),
    )


def clean_actions(actions: Column, n: int) -> Column:
    """Array of raw action texts -> at most n cleaned sentences (n is the length of the plan shown)."""
    items = F.transform(actions, lambda x: end_sentence(F.btrim(collapse(x), F.lit(" -•*;\n\t"))))
    return F.slice(F.filter(items, lambda x: x != ""), 1, n)


def format_actions(actions: Column, n: int) -> Column:
    return F.array_join(F.transform(clean_actions(actions, n), lambda x: F.concat(F.lit("• "), x)), "\n")
