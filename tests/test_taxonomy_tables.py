"""Scores and override rules of large tables against a walk over all of them."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from mapweave.operators import taxonomy as T
from mapweave.operators import terms as TM
from mapweave.params import STOP_WORDS

WORDS = [a + b for a in "ka lo mi ten sur vé dra pol un ix".split() for b in "ra sel mo ti an ost é zig nu ke".split()]


def card(rng, i):
    pick = lambda n: [rng.choice(WORDS) + rng.choice(["", " " + rng.choice(WORDS)]) for _ in range(rng.randint(0, n))]
    return Row(card_pos=i, category=f"{i % 97}. Card {rng.choice(WORDS)} {i}", card_key=f"{i % 97} card {i}", number=str(i % 97) if i % 3 else "", definition=" ".join(pick(4)),
               subcategories=pick(2), positive_en=pick(3), positive_fr=pick(2), actions=pick(2), objects=pick(2), examples=pick(2), negative=pick(1), counterexamples=pick(1))


def score(card, low, rules):
    """A card's score for a text in folded case, term by term."""
    words, own = set(re.findall(r"[a-zA-Z0-9_-]{2,}", low)) - set(STOP_WORDS), set(T.card_tokens(card))
    out = T.JACCARD_WEIGHT * len(words & own) / max(len(words | own), 1)
    out += sum(w for group, w in T.GROUP_WEIGHTS for term in T._terms(card, group) if term in low)
    out += T.NUMBER_WEIGHT if card.number and re.search(rf"(?a:\b){card.number}(?a:\b)", low) else 0
    out += T.NAME_WEIGHT if card.category.casefold() in low else 0
    out += sum(b for n, yes, no, b in rules if n == card.number and any(x in low for x in yes) and not any(x in low for x in no))
    return round(max(0.0, min(T.MOST, out)), 9)


def texts(rng, n):
    return [" ".join(rng.choice([*WORDS, str(rng.randint(0, 120)), "The", "card"]) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", None, " \n"]


@pytest.mark.parametrize(("n", "limit"), [(5000, 2_000_000), (300, 900), (1, 10)])
def test_scores_of_many_cards(spark, monkeypatch, n, limit):
    monkeypatch.setattr(TM, "BLOCK_CHARS", limit)
    rng = random.Random(n)
    cards, rules = [card(rng, i) for i in range(n)], [("5", ["kara", "losel"], ["mimo"], 0.4), ("11", ["ti"], [], 0.2), ("absent", ["kara"], [], 0.9)]
    rows = texts(rng, 40 if n > 1000 else 120)
    df = spark.createDataFrame(list(enumerate(rows)), "i int, full_text string").repartition(3)
    for r in T.with_scores(df, cards, rules=rules).collect():
        low = " ".join((r.full_text or "").split()).casefold()
        want = sorted((-score(c, low, rules), c.card_pos, c.category) for c in cards)
        above = [(-s, c) for s, _, c in want if s < 0]
        got = [(x.score, x.category) for x in r.ranked]
        assert len(got) >= min(5, n) and [c for _, c in got[:len(above)]] == [c for _, c in above]
        assert [s for s, _ in got[:len(above)]] == pytest.approx([s for s, _ in above], abs=2e-9)
        assert all(s == 0 for s, _ in got[len(above):])
    whole = T.with_scores(df.limit(3), cards, rules=rules, least=None).select(F.size("ranked").alias("n")).collect()
    assert {r.n for r in whole} == {n}


CONTEXT_COLUMNS = ["control_id", "title", "original_category", "requirement", "fields_json", "keywords_text"]


def test_many_overrides(spark, monkeypatch):
    rng = random.Random(9)
    cards = [card(rng, i) for i in range(120)]
    modes = ["contains", "contains", "exact", "regex"]

    def pattern(mode):
        w = " ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 3)))
        return rng.choice([w + r"\b", rf"(?<={w[:3]}){w[3:]}", rf"^{w}", f"(?P<a>{w[:2]}).*(?P=a){w}", f"{w}+?x?", "((" + w, f"{w}|zz{w}"]) if mode == "regex" else w.upper()
    rules = []
    for i in range(5000):
        mode = rng.choice(modes)
        rules.append(Row(priority=5000 - i // 3, rule_pos=i, pattern=pattern(mode), match_mode=mode, applies_to=rng.choice(["all", "title", "id", "text", "odd", "keywords"]),
                         primary_category=rng.choice(["5", cards[7].category, "no such", "17 x"]), secondary_categories=[rng.choice(["3", "9", cards[8].category])], confidence=rng.random(), reason=f"r{i}"))
    # a rule that only Python's expressions know, one without a sure fragment, signs that fold to others
    rules[10:13] = [Row(**{**rules[10].asDict(), "pattern": p, "match_mode": "regex", "applies_to": "all", "primary_category": "5"}) for p in (r"(?P<x>kara) (?P=x)", r"\d{7}", "Kısel kis")]
    rows = [tuple(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25))) for _ in CONTEXT_COLUMNS) for _ in range(60)]
    rows += [("kara kara", "", "", "", "", ""), ("1234567", "", "", "", "", ""), ("", "", "", "", "", "\\u212aısel kis"), ("", rules[50].pattern, "", None, None, " ")]
    df = spark.createDataFrame([(i, "F", *r) for i, r in enumerate(rows)], "i int, framework string, " + ", ".join(f"{c} string" for c in CONTEXT_COLUMNS)).withColumn("full_text", T.full_text())
    names = T._Names(cards)
    assert names.of("5") and names.of("no such") is None

    def walked(r):
        for o in rules:
            column = T.CONTEXTS.get(o.applies_to)
            low = lambda t: (t or "").lower().replace("ß", "ss")
            text = low(r[column]) if column else low(r.full_text)
            try:
                hit = re.search(o.pattern, text, re.IGNORECASE) if o.match_mode == "regex" else text.strip() == o.pattern.casefold().strip() if o.match_mode == "exact" else o.pattern.casefold() in text
            except re.error:
                hit = o.pattern.casefold() in text
            primary = names.of(o.primary_category)
            if hit and primary:
                return o.reason, primary
    for limit in (2_000_000, 4_000):
        monkeypatch.setattr(TM, "BLOCK_CHARS", limit)
        got = df.withColumn("d", T.override_decision(rules, cards, F.lower("full_text"))).collect()
        want = [walked(r) for r in got]
        assert [r.d and (r.d.reason, r.d.primary) for r in got] == want
        assert sum(w is not None for w in want) > 20
    assert df.withColumn("d", T.override_decision([], cards, F.lower("full_text"))).where("d is not null").count() == 0


def test_fragments_are_in_every_match():
    for pattern, part in [("^src1\\d$", "src1"), ("ab?cde", "cde"), ("(a|b)c", ""), ("x{2}y", ""), ("a\\.bcd+", "bcd"), ("[ab]c", ""), ("a*b", "b"), ("\\x41bc", ""), ("", "")]:
        assert TM.fragment(pattern) == part


def test_a_batch_is_scored_in_parts(monkeypatch):
    """No more than ROWS texts are Python objects at once; the parts together are the whole."""
    scores = TM.Scores([(0, "a", "1", [("the", 0.1)], ["the"]), (1, "b", "2", [("und", 0.2)], [])], [], 0.18, 0.16, [], 1.25, None)
    texts = pa.array(["the", None, "und 2", ""] * 600)
    seen = []
    monkeypatch.setattr(scores, "scored", lambda low, real=scores.scored: seen.append(len(low)) or real(low))
    assert scores(texts).to_pylist() == scores(texts.slice(0, 4)).to_pylist() * 600
    assert max(seen) <= TM.ROWS and len(scores(texts.slice(0, 0))) == 0
