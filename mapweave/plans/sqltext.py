"""SQL spellings of the text functions, used only to state expected results of the registered queries."""

from __future__ import annotations

from mapweave.functions.text import GAP_TOKEN, GENERIC_GAP_PHRASES, TOKEN, WHITE
from mapweave.params import STOP_WORDS


def q(s) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def values(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def pick(index: str, items) -> str:
    """CASE that picks item (index mod n); None is NULL."""
    items = list(items)
    lit = lambda v: "NULL" if v is None else (q(v) if isinstance(v, str) else str(v))
    arms = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(items))
    return f"(CASE {index} % {len(items)} {arms} END)"


def norm(x: str) -> str:
    return f"coalesce(trim(regexp_replace({x}, '[{WHITE}]+', ' ', 'g')), '')"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def toks(x: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({norm(x)}), '{TOKEN}'), "
            f"lambda t: t NOT IN {values(STOP_WORDS)})")


def gap_toks(x: str) -> str:
    return f"list_filter(regexp_extract_all({fold(x)}, '{GAP_TOKEN}'), lambda t: len(t) > 2)"


def cat_key(x: str) -> str:
    return f"trim(regexp_replace({fold(norm(x))}, '[^a-z0-9]+', ' ', 'g'))"


def end_sentence(x: str) -> str:
    return f"(CASE WHEN {x} <> '' AND right({x}, 1) NOT IN ('.', '!', '?') THEN {x} || '.' ELSE {x} END)"


def clean(x: str, strip: str = " -;") -> str:
    return end_sentence(f"trim({norm(x)}, '{strip}')")


def clean_gap(x: str) -> str:
    s = f"trim({norm(x)}, ' -;')"
    s = f"regexp_replace({s}, '^[\\pL\\pN_]+[\\pL\\pN_./-]*#\\d+\\s*\\([^)]*\\)\\s*->\\s*[^:]+:\\s*', '')"
    s = f"regexp_replace({s}, '(?i)^(gap|residual gap|missing element)\\s*:\\s*', '')"
    return end_sentence(f"trim({s}, ' -;')")


def generic(x: str) -> str:
    t = fold(norm(x))
    return "(" + " OR ".join(f"contains({t}, {q(p)})" for p in GENERIC_GAP_PHRASES) + ")"


def lookup(key: str, groups: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {key} IN {values(a)} THEN {q(r)}" for r, a in groups.items())
    return f"(CASE {arms} ELSE {default} END)"


def label_key(x: str) -> str:
    return f"replace(replace(trim({fold(x)}), ' ', '_'), '-', '_')"


def bucket(x: str) -> str:
    return (f"(CASE WHEN {x} >= 87.5 THEN 100 WHEN {x} >= 62.5 THEN 75 WHEN {x} >= 37.5 THEN 50 "
            f"WHEN {x} >= 12.5 THEN 25 ELSE 0 END)")


def first_rule(text: str, rules, default: str) -> str:
    """CASE over ordered (result, words): the first rule with a word contained in the text."""
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, {q(w)})" for w in words) + f" THEN {q(name)}"
        for name, words in rules)
    return f"(CASE {arms} ELSE {q(default)} END)"
