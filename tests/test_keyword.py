"""The keyword index against scores of all pairs, with pools, hot terms, ties and hard rows."""

import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from mapweave.operators import blocks as B
from mapweave.operators import keyword as KW
from mapweave.params import Params

SCHEMA = "atomic_id string, order_no long, terms array<string>, keys array<string>"
WORDS = [f"w{i}" for i in range(60)]


def atoms(rng, name, n, keys):
    """Words by falling frequency: the first is in most rows, the last in few."""
    rows = []
    for i in range(n):
        terms = [WORDS[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.randint(1, 12))] + ["the"] * rng.randint(0, 2)
        rows.append((f"{name}{i}", i, terms, rng.sample(keys, rng.randint(0, len(keys)))))
    return [*rows, (f"{name}-none", n, [], keys[:1]), (f"{name}-odd", n + 1, ["unseen" + name, "the"], [])]


def brute(sources, targets, pooled, k):
    out = {}
    for sid, _, query, keys in sources:
        pool = [t for t in targets if not pooled or not keys or set(keys) & set(t[3])]
        df = Counter(w for t in pool for w in set(t[2]))
        mean = sum(len(t[2]) for t in pool) / max(len(pool), 1) or 1
        scored = []
        for tid, order, terms, _ in pool:
            tf = Counter(terms)
            raw = sum(math.log(1 + (len(pool) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(terms) / mean)) for w in query if w in tf)
            scored.append((-round(raw, 9), order, tid))
        out[sid] = [(t, round(-s, 6)) for s, _, t in sorted(scored)[:k] if s < 0]
    return out


@pytest.mark.parametrize(("scope", "k", "n"), [("soft_enisa", 8, 400), ("same_category", 3, 250), ("same_category", 1, 60)])
def test_top_against_all_pairs(spark, monkeypatch, scope, k, n):
    monkeypatch.setattr(KW, "FIRST_READ", 2)  # so that later rounds decide
    rng = random.Random(n)
    sources, targets = atoms(rng, "s", 40, ["a", "b", "c"]), atoms(rng, "t", n, ["a", "b", "c", "d"])
    targets += [(f"copy{i}", n + 10 + i, targets[0][2], targets[0][3]) for i in range(30)]
    index = KW.Index(*(spark.createDataFrame(x, SCHEMA).repartition(5) for x in (sources, targets)), Params(match_scope=scope))
    got = {s[0]: [] for s in sources}
    for r in index.top(k).orderBy("source_id", "rank").collect():
        got[r.source_id].append((r.candidate_id, round(r.raw_score, 6)))
    want = brute(sources, targets, scope == "same_category", k)
    assert got == want


def test_search_weights_give_the_same_scores(spark):
    """The columns that the search adds make the scores that the index finds, each source with the statistics of its pool."""
    rng = random.Random(3)
    sources, targets = atoms(rng, "s", 20, ["a", "b"]), atoms(rng, "t", 90, ["a", "b"])
    p = replace(Params(match_scope="same_category"), use_keyword=True)
    s, t = (x.toPandas() for x in KW.with_keywords(*(spark.createDataFrame(x, SCHEMA) for x in (sources, targets)), p))
    raw = np.where(B.in_pool(s, t, p), np.round(B.keyword(s, t), 6), -1)
    want = brute(sources, targets, True, 1000)
    for i, sid in enumerate(s["atomic_id"]):
        found = {tid: raw[i, j] for j, tid in enumerate(t["atomic_id"]) if raw[i, j] > 0}
        assert found == pytest.approx(dict(want[sid]), abs=2e-6)
        assert s["keyword_best"][i] == pytest.approx(want[sid][0][1] if want[sid] else 1.0, abs=1e-6)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(atoms(random.Random(1), "t", 5, ["a"]), SCHEMA)
    for s, t in ((none, some), (some, none), (none, none)):
        assert KW.Index(s, t, Params()).top(3).count() == 0


def test_counts_and_pools_shuffle_no_target(spark):
    """Terms are counted inside a row, thresholds need no sort of the pairs, and tasks get a bounded number of pairs."""
    rng = random.Random(5)
    rows = spark.createDataFrame([*atoms(rng, "t", 50, ["a", "b"]), ("null", 99, None, [])], SCHEMA)
    counts = KW.term_counts(rows, "atomic_id")
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    want = {(r.atomic_id, w, n) for r in rows.collect() for w, n in Counter(r.terms or []).items()}
    assert {tuple(r) for r in counts.collect()} == want
    sums = spark.createDataFrame([(s, t, float(t % 97)) for s in range(3) for t in range(500)] + [(3, 1, 5.0)], "s_no long, t_no long, raw double")
    reached = KW.Index._reached(sums, 4)
    assert "Window" not in reached._jdf.queryExecution().optimizedPlan().toString()
    got = dict(reached.collect())
    assert got[3] == 0 and all(90 <= got[s] <= 96 for s in range(3))


def test_tasks_get_a_bounded_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(KW, "PAIRS", 100)
    rng = random.Random(6)
    sources, targets = atoms(rng, "s", 20, ["a"]), atoms(rng, "t", 90, ["a"])
    index = KW.Index(*(spark.createDataFrame(x, SCHEMA) for x in (sources, targets)), Params())
    terms = index.query.join(index.heads, ["pool", "term"])
    assert "RepartitionByExpression [t_no" in index._sums(terms)._jdf.queryExecution().optimizedPlan().toString()
    pairs = terms.agg({"df": "sum"}).first()[0]
    assert f", {-(-pairs // 100)}" in index._sums(terms)._jdf.queryExecution().optimizedPlan().toString()
