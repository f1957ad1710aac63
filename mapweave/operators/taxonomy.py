"""Classification into the cards of a taxonomy.

Cards and override rules are dimension tables without a limit of rows: the driver reads them, and blocks of bounded size go to
the tasks, where one automaton for each block finds all their terms in a text (terms.py). Classifying a table stays a narrow
projection without any join.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from mapweave.functions.text import casefold, category_key, category_norm, collapse, literal_array, split_terms
from mapweave.operators import terms as TM
from mapweave.params import DEFAULTS, STOP_WORDS, Params

# Weights of the term groups and the built-in rules (number, words, veto words, boost).
GROUP_WEIGHTS = [("positive", 0.075), ("actions", 0.045), ("objects", 0.050), ("examples", 0.055), ("subcategories", 0.030),
                 ("negative", -0.10), ("counterexamples", -0.08)]
JACCARD_WEIGHT, NUMBER_WEIGHT, NAME_WEIGHT, MOST = 0.18, 0.16, 0.18, 1.25
BUILTIN_RULES = [
    ("11", ["pr.aa", "access right", "access rights", "accès", "droits d'accès", "droit d'accès", "identity", "identité",
            "authentication", "authentification", "authorization", "autorisation", "account", "compte", "privileg",
            "privilège", "habilitation", "remote access", "accès distant", "mfa", "multi-factor", "annuaire",
            "directory service"], ["training", "awareness", "formation", "sensibilisation"], 0.46),
    ("9", ["cryptographic", "cryptographie", "cryptographique", "encryption", "encrypt", "chiffrement", "chiffrer",
           "key management", "gestion des clés", "clé cryptographique", "certificate", "certificat", "tls", "vpn"], [], 0.44),
    ("3", ["incident", "security event", "évènement de sécurité", "événement de sécurité", "event reporting",
           "notification d'incident", "incident response", "réponse à incident", "post-incident", "escalation",
           "escalade"], ["remote access", "accès distant"], 0.42),
    ("4", ["business continuity", "continuité", "crisis", "crise", "backup", "sauvegarde", "restore", "restoration",
           "recovery", "reprise", "disaster", "rto", "rpo", "denial-of-service", "déni de service"], [], 0.42),
    ("5", ["supplier", "supply chain", "third party", "third-party", "prestataire", "fournisseur", "sous-traitant",
           "outsourcing", "external provider", "contract", "contrat"], [], 0.40),
    ("6", ["patch", "correctif", "vulnerability", "vulnérabilité", "maintenance", "mco", "mcs", "configuration",
           "hardening", "durcissement", "architecture", "segmentation", "network", "réseau", "development",
           "développement", "software", "firmware", "change management", "mise en production"], [], 0.39),
    ("7", ["effectiveness", "efficacité", "audit", "assessment", "évaluation", "review of measures",
           "independent review", "test de sécurité", "intrusion test", "control testing", "kpi", "indicator",
           "indicateur"], ["access review", "revue des droits"], 0.37),
    ("8", ["training", "formation", "awareness", "sensibilisation", "cyber hygiene", "hygiène", "exercise", "exercice",
           "skills", "compétence"], ["incident response exercise", "business continuity exercise"], 0.40),
    ("10", ["human resources", "ressources humaines", "onboarding", "offboarding", "arrivée", "départ", "screening",
            "background check", "personnel", "employee", "employé"], [], 0.38),
    ("12", ["asset", "actif", "inventory", "inventaire", "recensement", "cartography", "cartographie", "mapping", "cmdb",
            "list of systems", "liste des systèmes", "ecosystem mapping", "cartographie de l'écosystème"],
     ["supplier contract", "contrat fournisseur"], 0.38),
    ("13", ["physical", "physique", "environmental", "environnemental", "premises", "locaux", "server room",
            "salle serveur", "datacenter", "data center", "vidéosurveillance", "badge", "fire", "incendie",
            "climatisation"], [], 0.39),
    ("1", ["security policy", "politique de sécurité", "pssi", "roles", "rôles", "responsibilities", "responsabilités",
           "authorities", "gouvernance organisation", "governance organization"], [], 0.34),
    ("2", ["risk management", "gestion des risques", "risk analysis", "analyse de risque", "legal requirement",
           "regulatory requirement", "exigence réglementaire", "compliance", "conformité", "action plan",
           "plan d'action", "risk treatment"], [], 0.36),
]


def collect_cards(cards: DataFrame) -> list[Row]:
    rows = list(cards.orderBy("card_pos").toLocalIterator())
    if not rows:
        raise ValueError("no taxonomy cards found")
    return rows


def collect_overrides(rules: DataFrame) -> list[Row]:
    return list(rules.orderBy(F.desc("priority"), "rule_pos").toLocalIterator())


def _terms(card: Row, group: str) -> list[str]:
    words = (card.positive_en or []) + (card.positive_fr or []) if group == "positive" else card[group] or []
    return [w.casefold() for w in words if w.strip()]


def card_tokens(card: Row) -> list[str]:
    parts = [card.category, card.definition, " ".join(card.subcategories or [])]
    for g in ("positive_en", "positive_fr", "actions", "objects", "examples"):
        parts += card[g] or []
    found = re.findall(r"[a-zA-Z0-9_-]{2,}", " ".join(parts).casefold())
    return sorted(set(found) - set(STOP_WORDS))


def _weighted(card: Row) -> list[tuple[str, float]]:
    return [(w, weight) for group, weight in GROUP_WEIGHTS for w in _terms(card, group)] + [(card.category.casefold(), NAME_WEIGHT)]


def with_scores(df: DataFrame, cards: list[Row], text: str = "full_text", rules=BUILTIN_RULES, least: int | None = 5) -> DataFrame:
    """Adds `ranked`: array of (score, category), best first, card order among equals; scores to nine digits.

    It holds all cards that score above 0, and the first of the others where it would have fewer than `least` entries; with
    least=None all cards.
    """
    low = casefold(collapse(F.col(text)))
    coded = [(i, c.category, c.number, _weighted(c), card_tokens(c)) for i, c in enumerate(cards)]
    folded = [(number, [w.casefold() for w in yes], [w.casefold() for w in no], boost) for number, yes, no, boost in rules]
    found = []
    for block in TM.blocks(coded, lambda c: sum(len(t) for t, _ in c[3]) + sum(map(len, c[4])), TM.BLOCK_CHARS):
        scores = TM.Scores(block, folded, JACCARD_WEIGHT, NUMBER_WEIGHT, STOP_WORDS, MOST, least)

        def scored(texts: pa.Array, scores=scores) -> pa.Array:
            return scores(texts)

        found.append(F.arrow_udf(_one(scored), "array<struct<k:double,i:int,category:string>>")(low))
    # entries sort by -score, then place; one block is sorted already
    ranked = F.array_sort(F.concat(*found)) if len(found) > 1 else found[0]
    return df.withColumn("ranked", ranked).withColumn("ranked", F.transform("ranked", lambda e: F.struct((-e["k"]).alias("score"), e["category"].alias("category"))))


def _one(fn):
    """fn as a function of one Arrow array, the form that Spark takes."""
    def run(texts: pa.Array) -> pa.Array:
        return fn(texts)
    return run


def score_confidence(top: Column, second: Column) -> Column:
    margin = F.greatest(F.lit(0.0), top - second)
    return F.least(F.lit(0.98), F.lit(0.34) + F.least(F.lit(0.46), top * 0.55) + F.least(F.lit(0.20), margin * 0.90))


def score_status(confidence: Column, top: Column, second: Column, p: Params = DEFAULTS) -> Column:
    return (F.when((top - second < p.category_margin) & (second > 0.25), "multi_domain")
            .when(confidence >= p.category_strong, "validated").when(confidence >= p.category_medium, "medium_confidence")
            .otherwise("low_confidence"))


def secondary_categories(primary: Column, p: Params = DEFAULTS) -> Column:
    """Other categories scored at least 0.25 and within 0.28 of the primary, best first."""
    own = F.coalesce(F.filter("ranked", lambda e: e["category"] == primary)[0]["score"], F.lit(0.0))
    near = F.filter("ranked", lambda e: (e["category"] != primary) & (e["score"] >= 0.25) & (own - e["score"] <= 0.28))
    return F.slice(F.transform(near, lambda e: e["category"]), 1, p.max_secondary) if p.max_secondary > 0 else (
        F.array().cast("array<string>"))


def _table(entries: list[tuple[str, str]]) -> Column:
    """A map of constants; of equal keys the first counts."""
    return F.from_json(F.lit(json.dumps(dict(reversed(entries)))), "map<string,string>")


def resolve(value: Column, cards: list[Row]) -> Column:
    """Category named by key, or by leading number; null when unknown."""
    key, number = category_key(value), F.regexp_extract(value, r"^\s*(\d+)", 1)
    by_key, by_number = _table([(c.card_key, c.category) for c in cards]), _table([(c.number, c.category) for c in cards if c.number])
    return F.coalesce(F.try_element_at(by_key, key), F.try_element_at(by_number, number))


def merge_secondary(primary: Column, values: Column, cards: list[Row], n: int = 2) -> Column:
    found = F.transform(values, lambda v: resolve(v, cards))
    return F.slice(F.array_distinct(F.filter(found, lambda v: v.isNotNull() & (v != primary))), 1, n)


class _Names:
    """resolve() for values at hand."""

    def __init__(self, cards: list[Row]) -> None:
        self.by_key = {c.card_key: c.category for c in reversed(cards)}
        self.by_number = {c.number: c.category for c in reversed(cards) if c.number}

    def of(self, value: str | None) -> str | None:
        key = re.sub("[^a-z0-9]+", " ", " ".join((value or "").split()).casefold()).strip()
        number = re.match(r"^\s*(\d+)", value or "")
        return self.by_key.get(key) or (self.by_number.get(number.group(1)) if number else None)


CONTEXTS = {"id": "control_id", "control_id": "control_id", "title": "title", "original_category": "original_category",
            "category": "original_category", "requirement": "requirement", "text": "requirement", "fields": "fields_json",
            "keywords": "keywords_text"}


DECISION = "primary string, secondary array<string>, confidence double, reason string"


def override_decision(overrides: list[Row], cards: list[Row], low: Column) -> Column:
    """The first rule, in priority order, whose pattern matches its context; null when none does."""
    names, known = _Names(cards), []
    for o in overrides:
        primary = names.of(o.primary_category)
        if primary is None:
            continue
        seconds = [r for v in o.secondary_categories or [] if (r := names.of(v)) and r != primary]
        pattern = o.pattern if o.match_mode == "regex" else o.pattern.casefold()
        known.append(((CONTEXTS.get(o.applies_to, ""), o.match_mode, pattern), (primary, list(dict.fromkeys(seconds))[:2], float(o.confidence), o.reason)))
    out = []
    for block in TM.blocks(known, lambda r: len(r[0][2]), TM.BLOCK_CHARS):
        columns = sorted({rule[0] for rule, _ in block})
        index = TM.Rules([(columns.index(c), mode, pattern) for (c, mode, pattern), _ in block], len(columns))
        texts = F.array(*[casefold(F.col(c)) if c else low for c in columns])
        # rules are looked up by number, so a table of them is a constant of the plan, not a tree of conditions
        values = F.from_json(F.lit(json.dumps([dict(zip(("primary", "secondary", "confidence", "reason"), v)) for _, v in block])), f"array<struct<{DECISION}>>")
        out.append(F.try_element_at(values, _first_of(index)(texts) + 1))
    return F.coalesce(*out) if out else F.lit(None).cast(f"struct<{DECISION}>")


def _first_of(index: TM.Rules):
    def found(texts: pa.Array) -> pa.Array:
        wide = index.contexts
        flat = texts.flatten()
        return index(*(flat.take(pa.array(range(i, len(flat), wide), pa.int64())) for i in range(wide)))

    def run(texts: pa.Array) -> pa.Array:
        return TM.in_parts(found, texts)
    return F.arrow_udf(run, "int")


def full_text() -> Column:
    return collapse(F.concat_ws(" ", "framework", "control_id", "title", "original_category", "requirement", "fields_json", "keywords_text"))


def classify(df: DataFrame, cards: list[Row], overrides: list[Row] = (), p: Params = DEFAULTS, rules=BUILTIN_RULES,
             least: int | None = 5) -> DataFrame:
    """Adds primary_category, secondary_categories, category_confidence, category_status, category_method,
    category_scores: exact category first, then overrides, then the best score.

    Columns read: framework, control_id, title, original_category, requirement, fields_json, keywords_text.
    """
    df = with_scores(df.withColumn("full_text", full_text()), cards, "full_text", rules, least)
    exact = F.try_element_at(_table([(c.card_key, c.category) for c in cards]), category_key(F.col("original_category")))
    exact = F.lit(None).cast("string") if p.category_force else exact
    df = df.withColumns({"_exact": exact, "_over": override_decision(list(overrides), cards, casefold(F.col("full_text")))})
    top, second = F.col("ranked")[0]["score"], F.coalesce(F.try_element_at("ranked", F.lit(2))["score"], F.lit(0.0))
    conf = score_confidence(top, second)
    by_exact, by_over = F.col("_exact").isNotNull(), F.col("_over").isNotNull()
    primary = F.when(by_exact, F.col("_exact")).when(by_over, F.col("_over.primary")).otherwise(F.col("ranked")[0]["category"])
    df = df.withColumns({
        "primary_category": primary,
        "category_confidence": F.when(by_exact, 1.0).when(by_over, F.col("_over.confidence")).otherwise(conf),
        "category_status": F.when(by_exact, "validated").when(
            by_over, F.when(F.col("_over.confidence") >= 0.85, "validated").otherwise("medium_confidence"))
        .otherwise(score_status(conf, top, second, p)),
        "category_method": F.when(by_exact, "already_enisa_category").when(by_over, "override").otherwise("deterministic_rules"),
        "category_scores": F.when(by_exact, F.create_map(F.col("_exact"), F.lit(1.0))).when(
            by_over, F.create_map(F.col("_over.primary"), F.col("_over.confidence"))).otherwise(F.map_from_entries(
                F.transform(F.slice("ranked", 1, 5), lambda e: F.struct(e["category"].alias("key"), F.round(e["score"], 4).alias("value"))))),
    })
    seconds = F.when(by_over & ~by_exact, F.col("_over.secondary")).otherwise(secondary_categories(F.col("primary_category"), p))
    return df.withColumn("secondary_categories", seconds).drop("_exact", "_over", "full_text")


def apply_supplied(df: DataFrame, supplied: DataFrame, cards: list[Row], p: Params = DEFAULTS) -> DataFrame:
    """Supplied classification (atomic_id, primary, secondary list text, confidence) where its category is known.

    Rows decided exactly or by an override keep their result; supplied secondaries come before the scored ones.
    """
    s = supplied.select("atomic_id", resolve(F.col("primary"), cards).alias("_p"), split_terms(F.col("secondary")).alias("_s"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)))).alias("_c"))
    j = df.join(s, "atomic_id", "left")
    use = F.col("_p").isNotNull() & (F.col("category_method") == "deterministic_rules")
    status = F.when(F.col("_c") >= 0.85, "validated").when(F.col("_c") >= 0.60, "medium_confidence").otherwise("low_confidence")
    return j.withColumns({
        "secondary_categories": F.when(use, merge_secondary(F.col("_p"), F.concat("_s", "secondary_categories"), cards, p.max_secondary))
        .otherwise(F.col("secondary_categories")),
        "primary_category": F.when(use, F.col("_p")).otherwise(F.col("primary_category")),
        "category_confidence": F.when(use, F.col("_c")).otherwise(F.col("category_confidence")),
        "category_status": F.when(use, status).otherwise(F.col("category_status")),
        "category_method": F.when(use, "supplied").otherwise(F.col("category_method"))}).drop("_p", "_s", "_c")


def apply_to_atoms(df: DataFrame) -> DataFrame:
    """Category columns of classified atoms; the first original category is kept."""
    return df.withColumns({"category": F.col("primary_category"), "category_key": category_norm(F.col("primary_category")),
                           "subcategory": F.lit("")})


CATEGORY_COLUMNS = ["primary_category", "secondary_categories", "category_confidence", "category_status", "category_method", "category_margin", "category_scores"]


def is_weak(p: Params = DEFAULTS) -> Column:
    return (F.col("category_confidence") < p.category_strong) | (F.coalesce("primary_category", F.lit("")) == "")


def repair(atoms: DataFrame, decisions: DataFrame, cards: list[Row], overrides: list[Row] = (), p: Params = DEFAULTS,
           rules=BUILTIN_RULES, order: str = "log_order") -> DataFrame:
    """Reclassify only weak atoms. Known decisions are reused by key, whole: of a key the last by `order` counts.

    decisions: key, order and category columns, which replace those of the atom; category columns that only the atom has are
    emptied, so nothing of an older decision stays. Adds category_source: kept, reused or classified.
    """
    weak = F.coalesce(is_weak(p), F.lit(True))
    kept = atoms.filter(~weak).withColumn("category_source", F.lit("kept"))
    told = [c for c in decisions.columns if c not in ("key", order)]
    known = decisions.groupBy("key").agg(F.max_by(F.struct(*told), order).alias("_known"))
    todo = atoms.filter(weak)
    stale = [c for c in CATEGORY_COLUMNS if c in atoms.columns and c not in told]
    hits = todo.join(known, "key").withColumns({
        **{c: F.col(f"_known.{c}") for c in told}, **{c: F.lit(None).cast(atoms.schema[c].dataType) for c in stale},
        "category_source": F.lit("reused")}).drop("_known")
    misses = classify(todo.join(known, "key", "left_anti").drop(*CATEGORY_COLUMNS), cards, overrides, p, rules)
    misses = misses.withColumn("category_source", F.lit("classified"))
    cols = kept.columns
    return kept.unionByName(hits.select(*cols)).unionByName(misses.select(*cols))


def repair_counts(before: DataFrame, after: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(measure, n): weak atoms before and after a repair, and atoms by category_source."""
    count = lambda df, c, name: df.agg(F.count_if(F.coalesce(c, F.lit(True))).alias("n")).select(F.lit(name).alias("measure"), "n")
    by_source = after.groupBy(F.concat(F.lit("source_"), "category_source").alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    return count(before, is_weak(p), "weak_before").unionByName(count(after, is_weak(p), "weak_after")).unionByName(by_source)


def quality_report(atoms: DataFrame) -> DataFrame:
    """One row per framework with counts and rates to four digits."""
    conf, n = F.coalesce("category_confidence", F.lit(0.0)), F.count(F.lit(1))
    low, medium = F.count_if(conf < 0.60), F.count_if((conf >= 0.60) & (conf < 0.85))
    changed = F.count_if((F.col("original_category") != "") & (F.col("original_category") != F.col("category")))
    multi = F.count_if((F.col("category_status") == "multi_domain") | (F.size("secondary_categories") > 0))
    return atoms.groupBy("framework").agg(
        n.alias("total"), low.alias("low"), medium.alias("medium"), changed.alias("changed"), multi.alias("multi"),
        F.round(low / n, 4).alias("low_rate"), F.round(medium / n, 4).alias("medium_rate"), F.round(changed / n, 4).alias("changed_rate"))


def distribution(atoms: DataFrame) -> DataFrame:
    status = F.when(F.col("category_status") == "", "unknown").otherwise(F.col("category_status"))
    return atoms.groupBy("framework", "category", status.alias("status")).agg(F.count(F.lit(1)).alias("atoms"))
