"""Benchmark decontamination by winnowing.

Of every `window - k + 1` neighbouring k-word hashes the smallest is a fingerprint, in documents and benchmark alike, so
every shared run of `window` words shares a fingerprint. Documents look their fingerprints up in those of the benchmark,
which is sent out in blocks of a checked size; a hit is extended to all windows that hold it, and each window is compared
as text. Items of fewer words than a window are looked up whole, by their own length. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import Rolling, U, raw, saved, slices, sliding_min, thrifty

#: Byte -> lower-case word byte, or 0 outside words: ASCII letters and digits and all bytes beyond ASCII are words.
WORD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)
BYTES, WORDS = Rolling(11), Rolling(12)
SLICE, PLACE = 1 << 19, 26


class Words:
    """Words of rows of text: places of start and end, row, and hashes of runs of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.low = WORD[data]
        inside = self.low != 0
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        self.start = np.nonzero(inside & (~before | first[:-1]))[0]
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        self.end = np.nonzero(inside & (~after | first[1:]))[0] + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.count = np.searchsorted(self.start, offsets[1:]) - self.first
        self.prefix = WORDS.prefix(BYTES.of(BYTES.prefix(self.low), self.start, self.end))

    def runs(self, n: int) -> np.ndarray:
        """Starts of all runs of n words within a row."""
        return np.nonzero(self.row[:len(self.row) - n + 1] == self.row[n - 1:])[0] if 0 < n <= len(self.row) else np.zeros(0, np.int64)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return WORDS.of(self.prefix, at, at + n)

    def text(self, at: int, n: int) -> bytes:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[at:at + n].tolist(), self.end[at:at + n].tolist()))

    def fingerprints(self, k: int, window: int) -> np.ndarray:
        """Places of the smallest k-word hash of each window; the leftmost of equal ones."""
        if len(self.row) < window:
            return np.zeros(0, np.int64)
        at = np.arange(len(self.row) - k + 1)
        packed = self.hashes(at, k) >> U(PLACE) << U(PLACE) | at.astype(np.uint64)
        low = sliding_min(packed, window - k + 1)[self.runs(window)]
        return np.unique(low & U((1 << PLACE) - 1)).astype(np.int64)


class Block:
    """What tasks need of a block of the benchmark: sorted fingerprints, sorted window hashes, windows as text with item ids."""

    def __init__(self, rows: list[tuple], k: int, window: int) -> None:
        self.k, self.window = k, window
        self.windows: dict[bytes, set] = defaultdict(set)
        prints, self.hashes = [], defaultdict(list)
        for item, text in rows:
            w = Words(*raw(pa.array([text], pa.string())))
            n = min(window, len(w.start))
            if not n:
                continue
            at = w.runs(n)
            self.hashes[n].append(w.hashes(at, n))
            for i in at.tolist():
                self.windows[w.text(i, n)].update([] if item is None else [item])
            if n == window:
                prints.append(w.hashes(w.fingerprints(k, window), k))
        self.windows = dict(self.windows)
        self.hashes = {n: np.unique(np.concatenate(h)) for n, h in self.hashes.items()}
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)

    def hits(self, w: Words) -> list[tuple[int, int, set]]:
        """(first word, words, items) of each window of the block that occurs."""
        found = []
        for n, known in self.hashes.items():
            if n == self.window:
                at = w.fingerprints(self.k, n)
                at = at[within(w.hashes(at, self.k), self.prints)]
                at = np.unique((at[:, None] - np.arange(n - self.k + 1)).ravel())
                at = at[(at >= 0) & (at + n <= len(w.row))]
                at = at[w.row[at] == w.row[at + n - 1]] if len(at) else at
            else:
                at = w.runs(n)
            for i in at[within(w.hashes(at, n), known)].tolist():
                text = w.text(i, n)
                if text in self.windows:
                    found.append((i, n, self.windows[text]))
        return found


def within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(x):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    return known[np.minimum(at, len(known) - 1)] == x


def _scan(texts: pa.Array, block: Block):
    """(words, hit runs, items) of each row."""
    data, offsets = raw(texts)
    for a, b in slices(offsets, SLICE):
        w = Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        runs, items = defaultdict(list), defaultdict(set)
        for i, n, ids in block.hits(w):
            r = int(w.row[i])
            at = i - int(w.first[r])
            runs[r].append((at, at + n))
            items[r] |= ids
        for r in range(b - a):
            yield int(w.count[r]), merged(runs.get(r, [])), items.get(r, set())


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def verdict(words: int, runs: list, items: set) -> tuple:
    """n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = sum(b - a for a, b in runs)
    ids = ",".join(sorted(map(str, items)))
    return words, hit, len(items), hashlib.sha256(ids.encode()).hexdigest(), hit > 0 and 20 * hit >= words


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def blocks(benchmark: DataFrame, text: str, item: str, block_bytes: int):
    """Blocks of at most about block_bytes of benchmark text, one after the other."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i) if n > 1 else rows
        yield i == n - 1 == 0, [tuple(r) for r in part.toLocalIterator()]


def free(name: str, taken: list[str]) -> str:
    """name, made longer until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _judged(docs: DataFrame, benchmark: DataFrame, text: str, k: int, window: int, block_bytes: int, item: str, columns: list[str], clean_only: bool) -> DataFrame:
    spark = docs.sparkSession
    kept = [f for f in docs.schema.fields if f.name in columns]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ([] if clean_only else [RESULT]))
    names = [f.name for f in kept]
    body, row, other, words, runs, items = (free(n, names) for n in ("__text", "__row", "__other", "__words", "__runs", "__items"))

    def answer(b, texts, judged):
        cols = [b.column(n) for n in names]
        if clean_only:
            ok = pa.array([not j[4] for j in judged], pa.bool_())
            return pa.RecordBatch.from_arrays([c.filter(ok) for c in cols], names=names)
        return pa.RecordBatch.from_arrays(cols + [pa.array(x, t) for x, t in zip(zip(*judged) if judged else [[]] * 5, [pa.int64()] * 3 + [pa.string(), pa.bool_()])], names=names + NAMES)

    source = docs.select(*[F.col(f"`{n}`") for n in names], F.col(text).cast("string").alias(body))
    parts, numbered = [], None
    for alone, rows in blocks(benchmark, item=item, text="text", block_bytes=block_bytes):
        sent = spark.sparkContext.broadcast(Block(rows, k, window))
        if alone:
            def run(batches, sent=sent):
                for b in batches:
                    texts = b.column(body)
                    yield answer(b, texts, [verdict(*x) for x in _scan(texts, sent.value)])
            return source.mapInArrow(thrifty(run), schema)
        if numbered is None:  # row numbers must be the same for every block, so they are written once
            numbered = saved(source.withColumn(row, F.monotonically_increasing_id()), "numbered")

        def run(batches, sent=sent):
            for b in batches:
                found = [(r, n, x, sorted(i)) for r, (n, x, i) in zip(b.column("__row").to_pylist(), _scan(b.column("__text"), sent.value))]
                yield pa.RecordBatch.from_pylist([{"__row": r, "n": n, "runs": [{"a": p, "b": q} for p, q in x], "items": i} for r, n, x, i in found], schema=PART)
        parts.append(numbered.select(F.col(row).alias("__row"), F.col(body).alias("__text")).mapInArrow(thrifty(run), "__row long, n long, runs array<struct<a: long, b: long>>, items array<string>"))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    every = every.groupBy("__row").agg(F.max("n").alias("n"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_set("items")).alias("items"))
    every = every.select(F.col("__row").alias(other), F.col("n").alias(words), F.col("runs").alias(runs), F.col("items").alias(items))
    joined = numbered.drop(body).join(every, F.col(row) == F.col(other))

    def finish(batches):
        for b in batches:
            judged = [verdict(n, merged([(x["a"], x["b"]) for x in r]), set(i)) for n, r, i in zip(b.column(words).to_pylist(), b.column(runs).to_pylist(), b.column(items).to_pylist())]
            yield answer(b, None, judged)
    return joined.mapInArrow(finish, schema)


PART = pa.schema([("__row", pa.int64()), ("n", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", k: int = 5, window: int = 13, block_bytes: int = 1 << 23) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs.

    Null and empty texts have no words. Items without words match nothing; the windows of an item with a null id hit words,
    but the item is not counted; rows that repeat an id are one item with the windows of all. Null and repeated keys of
    docs are kept as they are. An empty benchmark hits nothing.
    """
    out = _judged(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), benchmark, "text", k, window, block_bytes, item, ["doc_id"], False)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", k: int = 5, window: int = 13, block_bytes: int = 1 << 23, item: str = "item_id") -> DataFrame:
    """docs without contaminated rows, all columns as they are."""
    return _judged(docs, benchmark, text, k, window, block_bytes, item, docs.columns, True)
