"""Secret scans: three fixed patterns, and a battery of randomness tests on other long tokens.

A candidate is a maximal run of base64 or URL-safe characters, and each of its parts of 16 or more characters between the
signs of one encoding or of both, so that a token in a path is also tested by itself. The encoding is inferred from the
characters. Chi-squared distance from uniform use of the alphabet, the number of runs and the serial correlation only gate: a
candidate that is unlike a random string in one of them is left out. The p-value that is ranked is another statistic, a bound on
the chance that ordinary text changes its character class as often. The candidates of a document share a false-discovery
budget that is weighted by length, since short strings say little.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mapweave.llm.common import thrifty

#: Fixed patterns and least lengths of the base.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ["assign", "access", "hex", "random"]
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Characters between the signs of base64, of its URL-safe form, and of both.
PARTS = [re.compile(r"[A-Za-z0-9_-]{16,}"), re.compile(r"[A-Za-z0-9+/]{16,}"), re.compile(r"[A-Za-z0-9]{16,}")]
#: Encodings from narrow to wide: name and alphabet.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
INDEX = {name: {c: i for i, c in enumerate(a)} for name, a in ENCODINGS.items()}
RATE, REJECT = 0.01, 0.02


def encoding(token: str) -> str | None:
    """The narrowest alphabet that holds all characters."""
    own = set(token)
    return next((name for name, index in INDEX.items() if own <= index.keys()), None)


def tail(z: float) -> float:
    """Two-sided normal tail."""
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str, name: str) -> float:
    """Smallest of the three p-values that the token is random in its encoding, times three."""
    index, n = INDEX[name], len(token)
    x = np.array([index[c] for c in token])
    k = len(index)
    counts = np.bincount(x, minlength=k)
    expected = n / k
    chi = float(((counts - expected) ** 2 / expected).sum())
    spread = math.sqrt(2 * (k - 1) * (n - 1) / n)
    p_chi = 0.5 * math.erfc((chi - (k - 1)) / spread / math.sqrt(2))  # only too uneven a use counts
    high = x >= k / 2
    ones = int(high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * ones * (n - ones) / n
    deviation = (mean - 1) * (mean - 2) / max(1, n - 1)
    p_runs = tail((runs - mean) / math.sqrt(deviation)) if deviation > 0 else 0.0
    c = x - x.mean()
    total = float((c * c).sum())
    p_serial = tail((float((c[1:] * c[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total > 0 else 0.0
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def text_chance(token: str) -> float:
    """A bound on the chance that a word or identifier looks like this token: changes of character class are rare in text.

    In text neighbouring characters differ in class (lower, upper, digit, sign) with a chance of at most 0.12; the tail of the
    binomial count is bounded by Chernoff's inequality.
    """
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in token]
    n, changes = len(token) - 1, sum(a != b for a, b in zip(kind, kind[1:]))
    q, f = 0.12, changes / max(1, len(token) - 1)
    if f <= q:
        return 1.0
    f = min(f, 1 - 1e-9)
    return math.exp(-n * (f * math.log(f / q) + (1 - f) * math.log((1 - f) / (1 - q))))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the runs and of their parts, each once; padding belongs to what it follows."""
    out = {}
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        end = a + len(m[0].rstrip("="))
        out[a, b] = True
        if encoding(m[0][:end - a]) in (None, "base64", "base64url"):
            for part in PARTS:
                for x in part.finditer(text, a, end):
                    out[x.start(), b if x.end() == end else x.end()] = True
    return list(out)


def extra(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of other candidates that pass the battery, under false-discovery control with weights by length; those that overlap are one."""
    tests = []
    for a, b in candidates(text):
        token = text[a:b].rstrip("=")
        if any(a < y and x < b for x, y in taken) or not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token):
            continue
        name = encoding(token)
        if name and battery(token, name) >= REJECT:
            tests.append((text_chance(token), len(token), a, b))
    if not tests:
        return []
    weight = sum(n for _, n, _, _ in tests) / len(tests)
    ranked = sorted((p * weight / n, a, b) for p, n, a, b in tests)
    last = max((i for i, (p, _, _) in enumerate(ranked, 1) if p <= RATE * i / len(ranked)), default=0)
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in ranked[:last]):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: str | None) -> tuple[list, list]:
    """Base spans and all spans, as (start, place of the kind, end) in order of start and kind; offsets in code points."""
    text = text or ""
    base = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in WORDS):
            base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = [(a, 3, b) for a, b in extra(text, [(a, b) for a, _, b in base])]
    return sorted(base), sorted(base + more)


def told(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _scan(batches):
    for b in batches:
        out = []
        for t in b.column("text"):
            base, every = spans(t.as_py())
            count = [sum(k == i for _, k, _ in base) for i in range(3)]
            out.append((*count, hashlib.sha256(told(base).encode()).hexdigest(), told(every)))
        cols = list(zip(*out)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of docs; null and empty texts have no spans.

    Rows are scanned one by one: null and repeated keys are kept as they are, other columns are not read.
    """
    rows = docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return rows.mapInArrow(thrifty(_scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted_text(text: str | None, mark: str) -> str | None:
    if text is None:
        return None
    _, found = spans(text)
    out, at = [], 0
    for a, _, b in found:
        if b > at:
            out += [text[at:max(a, at)], mark if a >= at else ""]
            at = b
    return "".join(out) + text[at:] if found else text


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans replaced by mark, and the column of lengths, if there is one, brought up to date."""
    names = docs.columns

    def run(batches):
        for b in batches:
            cols = {n: b.column(n) for n in names}
            before = cols[text].to_pylist()
            after = [redacted_text(t, mark) for t in before]
            if length in cols:
                cols[length] = pa.array([n if x == y else len(y) for n, x, y in zip(cols[length].to_pylist(), before, after)], cols[length].type)
            cols[text] = pa.array(after, cols[text].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)
    return docs.mapInArrow(thrifty(run), docs.schema)
