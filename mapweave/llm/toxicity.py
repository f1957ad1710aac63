"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into classes: insult, threat, target, negation, report, quotation and clause end. The weights
of insults (whole words or word beginnings) are learned from a bounded sample of labelled texts. A clause transducer
reads the classes and composes them: an insult in a clause matches plainly or aimed at a target, turned round by negation,
or merely reported. Clause scores go into a logistic model fitted on the same sample. Single words never score alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import thrifty
from mapweave.llm.learning import Scaled, fold, logistic, sampled, sigmoid

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]+|[\"“”«»]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
#: The closed classes of the grammar in English, German, French and Spanish.
WORDS = {
    THREAT: ["kill", "murder", "hurt", "strangle", "slaughter", "exterminate", "töten", "umbringen", "tuer", "massacrer", "matar", "asesinar"],
    TARGET: ["you", "your", "yours", "you're", "u", "they", "them", "those", "du", "dich", "dir", "ihr", "euch", "tu", "toi", "vous", "tú", "ti", "usted", "ustedes", "vosotros"],
    NEGATION: ["not", "never", "no", "isn't", "aren't", "wasn't", "don't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"],
    REPORT: ["said", "says", "called", "wrote", "quoted", "claimed", "reported", "sagte", "nannte", "schrieb", "dit", "écrit", "dijo", "llamó", "escribió"],
}
CLOSED = {w: c for c, ws in WORDS.items() for w in ws}
STEM = (3, 4, 5, 6)
CACHE = 300_000
FEATURES = 9


class Grammar:
    """insults: word -> weight; stems: word beginning -> weight."""

    def __init__(self, insults: dict[str, float], stems: dict[str, float], model: tuple | None = None) -> None:
        self.insults, self.stems, self.model = insults, stems, model
        self.known: dict[str, tuple[int, float]] = {}

    def classify(self, token: str) -> tuple[int, float]:
        """Class and weight of a token: the lexical transducer."""
        found = self.known.get(token)
        if found is None:
            low = token.lower()
            weight = self.insults.get(low, 0.0)
            for n in STEM:
                if len(low) > n:
                    weight = max(weight, self.stems.get(low[:n], 0.0))
            c = low[0]
            found = ((INSULT, weight) if weight else (CLOSED[low], 1.0) if low in CLOSED else (END, 0.0) if c in ".!?;:\n" else (QUOTE, 0.0) if c in "\"“”«»" else (OTHER, 0.0))
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[token] = found
        return found

    def features(self, text: str) -> list[float]:
        """Sums over the matched clauses of a text; zeros where no clause matches."""
        out = [0.0] * FEATURES
        tokens = TOKEN.findall(text)
        classes = list(map(self.classify, tokens))
        if not any(c in (INSULT, THREAT) for c, _ in classes):
            return out
        plain = aimed = denied = reported = threats = best = 0.0
        clauses = 0
        words = [0.0, None, False, False, False, False]  # insult weight, place of the last negation, negated, target, report, threat

        def close():
            nonlocal plain, aimed, denied, reported, threats, best, clauses
            weight, _, negated, target, report, threat = words
            if weight or (threat and target):
                clauses += 1
                value = weight + (2.0 if threat and target else 0.0)
                if report:
                    reported += value
                elif negated:
                    denied += value
                elif target:
                    aimed += value
                else:
                    plain += value
                threats += bool(threat and target)
                best = max(best, value * (0.3 if report or negated else 1.2 if target else 1.0))
            words[:] = [0.0, None, False, False, False, False]

        quoted = False
        for i, (c, weight) in enumerate(classes):
            if c == INSULT:
                words[0] += weight
                if words[1] is not None and i - words[1] <= 3:
                    words[2] = True
            elif c == THREAT:
                words[5] = True
            elif c == TARGET:
                words[3] = True
            elif c == NEGATION:
                words[1] = i
            elif c == REPORT:
                words[4] = True
            elif c == QUOTE:
                quoted = not quoted
            elif c == END and not quoted:
                close()
        close()
        return [1.0, math.log1p(plain), math.log1p(aimed), math.log1p(denied), math.log1p(reported), threats, best, math.log1p(clauses), (plain + aimed) / math.sqrt(len(tokens) + 1)]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t or "") for t in texts], dtype=float).reshape(-1, FEATURES)
        if self.model is None:
            return np.full(len(x), 0.0)
        scale, w = self.model
        return sigmoid(np.hstack([scale(x), np.ones((len(x), 1))]) @ w)


def lexicon(toxic: list[str], clean: list[str], least: int = 3, ratio: float = 20.0) -> tuple[dict, dict]:
    """Words and word beginnings whose share of toxic texts is `ratio` times that of the others, with log-odds weights.

    A longer beginning is left out where a shorter one already has it, and a word where its beginning has it.
    """
    def counted(texts):
        words, stems = Counter(), Counter()
        for t in texts:
            own = {w.lower() for w in TOKEN.findall(t) if w[0].isalpha()}
            words.update(own)
            stems.update({w[:n] for w in own for n in STEM if len(w) > n})
        return words, stems

    (w1, s1), (w0, s0) = counted(toxic), counted(clean)
    n1, n0 = len(toxic) + 1, len(clean) + 1

    def weighed(a, b, floor):
        out = {}
        for x, k in a.items():
            odds = ((k + 0.5) / n1) / ((b[x] + 0.5) / n0)
            if k >= floor and odds >= ratio:
                out[x] = min(6.0, math.log(odds))
        return out

    floor = max(least, len(toxic) // 150)
    stems = weighed(s1, s0, floor)
    stems = {s: v for s, v in stems.items() if not any(s[:n] in stems for n in STEM if n < len(s))}
    # a beginning counts if several words share it; else the word itself is the entry
    heads = Counter(w[:n] for w in w1 for n in STEM if len(w) > n and w[:n] in stems)
    stems = {s: v for s, v in stems.items() if heads[s] >= 5}
    words = {w: v for w, v in weighed(w1, w0, floor).items() if not any(w[:n] in stems for n in STEM if len(w) > n)}
    return words, stems


def learned(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", folds: int = 4, held: int = 2, n_toxic: int = 4000, n_clean: int = 8000) -> Grammar:
    """Grammar and model from at most n_toxic + n_clean labelled rows of the folds other than `held`.

    The sample is the first rows by a hash of the key. Half of it gives the lexicon, the other half the model, so the model
    sees the lexicon as new texts do. Keys or labels that are null are not used; of repeated labels the highest holds.
    """
    marks = labels.where(f"{key} is not null and {label} is not null").groupBy(key).agg(F.max(label).alias("mark")).where(fold(key, folds) != held)
    order = F.xxhash64(key, F.lit(7))
    wanted = sampled(marks.where("mark = 1"), n_toxic, order).union(sampled(marks.where("mark = 0"), n_clean, order))
    wanted = F.broadcast(wanted.select(F.col(key).alias("__key"), "mark"))  # at most n_toxic + n_clean rows of two numbers
    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("t")).join(wanted, "__key").select("__key", F.coalesce("t", F.lit("")).alias("t"), "mark").collect()
    rows = sorted(rows)
    first, second = rows[0::2], rows[1::2]
    insults, stems = lexicon([r.t for r in first if r.mark], [r.t for r in first if not r.mark])
    grammar = Grammar(insults, stems)
    x = np.array([grammar.features(r.t) for r in second], dtype=float).reshape(-1, FEATURES)
    y = np.array([float(r.mark) for r in second])
    if 0 < y.sum() < len(y):
        scale = Scaled(x)
        grammar.model = (scale, logistic(scale(x), y))
    grammar.known = {}
    return grammar


def _scored(docs: DataFrame, grammar: Grammar, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(grammar)
    names = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["__score double"])

    def run(batches):
        for b in batches:
            score = sent.value.scores(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(score)], names=names + ["__score"])
    return docs.mapInArrow(thrifty(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.3, folds: int = 4, held: int = 2, **sizes) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Null and empty texts match no clause and get the score of such texts. Repeated rows score alike; a null key is scored
    and falls in the fold of the empty text. Without labels of both kinds every score is 0.
    """
    grammar = learned(docs, labels, text, key, folds=folds, held=held, **sizes)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _scored(rows, grammar, "text").select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def detoxified(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, text: str = "text", key: str = "doc_id", threshold: float = 0.3, **sizes) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns as they are. labelled: the table that labels speak of, else docs."""
    grammar = learned(docs if labelled is None else labelled, labels, text, key, **sizes)
    return _scored(docs, grammar, text).where(F.col("__score") < threshold).drop("__score")
