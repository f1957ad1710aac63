"""Repeated passages of 100 bytes, found by a prefix-free parse.

Rolling-hash triggers: in each window of `span` bytes the leftmost smallest hash of `k` bytes is the trigger. A run of windows
with the same trigger is a phrase; phrases overlap by span - 1 bytes, so each window lies in one phrase, and a repeated window
has the same trigger wherever it stands. The phrases make a dictionary with the first place of each.

* A trigger with a single phrase in the whole corpus: all its places but the first are repeats, window by window.
* A trigger with several phrases: their windows are parsed again with longer triggers, which leaves few of them open. These are put in
  suffix order inside a batch, equal neighbours are merged to their first place, and the rest is merged by window hash across batches.

Places are ordered by (doc_id, row, start), as the corpus is. Each batch sends just its first place of a trigger or window, so a passage in a third
of all documents is a row for each batch, not for each document. Texts are never gathered by key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.common import Rolling, U, discard, raw, saved, slices, sliding_min

TRIGGER, PHRASE, FIRST, SECOND = Rolling(21), Rolling(22), Rolling(23), Rolling(24)
#: Bytes parsed at once, bits of a place in them, and windows sorted at once.
SLICE, PLACE, WINDOWS = 1 << 20, 26, 200_000
NO_KEY = -(2**63)
#: Kinds of rows of the parse: the first place of a trigger in a batch, a further phrase of it there, a repeat inside the batch.
HEAD, MORE, DONE = 0, 1, 2


def parse(data: np.ndarray, offsets: np.ndarray, span: int, k: int, allowed: np.ndarray | None = None):
    """Phrases of rows of text: row, start in the row, windows, hash of the trigger, hash of the phrase; of the allowed windows only."""
    n = len(data) - span + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    p = TRIGGER.prefix(data)
    at = np.arange(len(data) - k + 1)
    h = TRIGGER.of(p, at, at + k)
    packed = h >> U(PLACE) << U(PLACE) | at.astype(np.uint64)
    trigger = (sliding_min(packed, span - k + 1) & U((1 << PLACE) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = row[:n] == row[span - 1:]
    valid = np.nonzero(valid if allowed is None else valid & allowed[:n])[0]
    if not len(valid):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    t, r = trigger[valid], row[valid]
    new = np.concatenate([[0], np.nonzero((t[1:] != t[:-1]) | (r[1:] != r[:-1]) | (valid[1:] != valid[:-1] + 1))[0] + 1])
    start, windows = valid[new], np.diff(np.append(new, len(valid)))
    q = PHRASE.prefix(data)
    return r[new], start - offsets[r[new]], windows, h[t[new]], PHRASE.of(q, start, start + windows + span - 1)


def ordered_rows(ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Rank of each row by (doc_id, row number)."""
    rank = np.zeros(len(ids), np.int64)
    rank[np.lexsort([numbers, ids])] = np.arange(len(ids))
    return rank


def groups_of(keys: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places and group starts of equal keys, each group in the given order; the last key is the first to sort by."""
    at = np.lexsort([order, *keys])
    differ = np.zeros(len(at), bool)
    if len(at):
        differ[0] = True
        for x in keys:
            differ[1:] |= x[at][1:] != x[at][:-1]
    return at, differ


def runs_of(rank: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring phrases of a row joined."""
    at = np.lexsort([start, rank])
    rank, start, windows = rank[at], start[at], windows[at]
    new = np.nonzero(np.concatenate([[True], (rank[1:] != rank[:-1]) | (start[1:] != start[:-1] + windows[:-1])]))[0] if len(at) else np.zeros(0, np.int64)
    return rank[new], start[new], np.add.reduceat(windows, new) if len(new) else windows


def marked(phrases: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """Which bytes begin a window of the given runs."""
    count, flat = np.diff(phrases.offsets.to_numpy()), phrases.flatten()
    at = np.repeat(offsets[:-1], count) + flat.field("start").to_numpy()
    step = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + flat.field("windows").to_numpy(), -1)
    return np.cumsum(step)[:-1] > 0


PARSED = "kind byte, trigger long, phrase long, doc_id long, number long, start long, windows long"
PLACED = [("doc_id", pa.int64()), ("number", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())]


def _parse(span: int, k: int):
    schema = pa.schema([("kind", pa.int8()), ("trigger", pa.int64()), ("phrase", pa.int64()), *PLACED])

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").fill_null(NO_KEY).to_numpy()
            numbers = b.column("number").to_numpy()
            data, offsets = raw(b.column("text"))
            allowed = marked(b.column("phrases"), offsets) if "phrases" in b.schema.names else None
            parts = []
            for a, z in slices(offsets, SLICE):
                some = slice(int(offsets[a]), int(offsets[z]))
                r, *rest = parse(data[some], offsets[a:z + 1] - offsets[a], span, k, None if allowed is None else allowed[some])
                parts.append((r + a, *rest))
            if not parts:
                continue
            row, start, windows, trigger, phrase = (np.concatenate(x) for x in zip(*parts))
            rank = ordered_rows(ids, numbers)
            by_rank = np.argsort(rank)
            order = rank[row] << 40 | start
            at, head = groups_of([phrase, trigger], order)
            repeat = at[~head]
            first = at[head]  # sorted by trigger, phrase
            own = np.concatenate([[True], trigger[first][1:] != trigger[first][:-1]]) if len(first) else head
            # of each trigger the phrase with the first place leads
            lead, lead_head = groups_of([trigger[first]], order[first])
            leads, others = first[lead[lead_head]], first[lead[~lead_head]]
            several = np.add.reduceat((~lead_head).astype(np.int64), np.nonzero(lead_head)[0]) > 0 if len(lead) else own
            for kind, which in ((np.where(several, HEAD + 10, HEAD), leads), (np.full(len(others), MORE), others)):
                yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), pa.array(trigger[which].view(np.int64)), pa.array(phrase[which].view(np.int64)), pa.array(ids[row[which]]), pa.array(numbers[row[which]]), pa.array(start[which]), pa.array(windows[which])], schema=schema)
            r, s, w = runs_of(rank[row[repeat]], start[repeat], windows[repeat])
            r = by_rank[r]
            none = pa.nulls(len(r), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), DONE, np.int8)), none, none, pa.array(ids[r]), pa.array(numbers[r]), pa.array(s), pa.array(w)], schema=schema)
    return run


def _windows(span: int):
    """Windows of the phrases of each row in suffix order: the first place of each window in the batch, and repeats inside it."""
    schema = pa.schema([("first", pa.int64()), ("second", pa.int64()), *PLACED])

    def run(batches):
        for big in batches:
            phrases = big.column("phrases")
            n = np.add.reduceat(np.append(phrases.flatten().field("windows").to_numpy(), 0), phrases.offsets.to_numpy()[:-1] - phrases.offsets[0].as_py()) if big.num_rows else []
            for a, z in slices(np.concatenate([[0], np.cumsum(n)]), WINDOWS):
                yield from some(big.slice(a, z - a))

    def some(b):
        ids, numbers = b.column("doc_id").fill_null(NO_KEY).to_numpy(), b.column("number").to_numpy()
        data, offsets = raw(b.column("text"))
        phrases = b.column("phrases")
        count = np.diff(phrases.offsets.to_numpy())
        flat = phrases.flatten()
        start, windows = flat.field("start").to_numpy(), flat.field("windows").to_numpy()
        row = np.repeat(np.repeat(np.arange(b.num_rows), count), windows)
        begin = np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        if not len(row):
            return
        place = offsets[row] + begin
        rank = ordered_rows(ids, numbers)
        suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, span)[place]).view(f"S{span}").ravel()
        order = rank[row] << 40 | begin
        at = np.argsort(order, kind="stable")
        at = at[np.argsort(suffix[at], kind="stable")]  # suffix order, equal windows by place
        head = np.concatenate([[True], suffix[at][1:] != suffix[at][:-1]])
        first, repeat = at[head], at[~head]
        one, two = FIRST.prefix(data), SECOND.prefix(data)
        yield pa.RecordBatch.from_arrays([pa.array(FIRST.of(one, place[first], place[first] + span).view(np.int64)), pa.array(SECOND.of(two, place[first], place[first] + span).view(np.int64)), pa.array(ids[row[first]]), pa.array(numbers[row[first]]), pa.array(begin[first]), pa.array(np.ones(len(first), np.int64))], schema=schema)
        r, s, w = runs_of(rank[row[repeat]], begin[repeat], np.ones(len(repeat), np.int64))
        r = np.argsort(rank)[r]
        none = pa.nulls(len(r), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(ids[r]), pa.array(numbers[r]), pa.array(s), pa.array(w)], schema=schema)
    return run


def covered(runs: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """Byte ranges that windows cover: runs of (first window, windows)."""
    out: list[tuple[int, int]] = []
    for s, w in sorted(runs):
        e = s + w - 1 + span
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(span: int, texts: bool):
    def run(batches):
        for b in batches:
            out = []
            for t, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                ranges = covered([(r["start"], r["windows"]) for r in runs or []], span)
                at, kept = 0, []
                for s, e in ranges:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), sum(e - s for s, e in ranges), len(ranges), hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            types = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * texts
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, y) for c, y in zip(zip(*out) if out else [[]] * len(types), types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts])
    return run


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", span: int = 100, triggers: tuple[int, ...] = (32, 88)) -> DataFrame:
    """(number, runs) of the rows of docs that hold repeats: number is the row's, runs are (start, windows), in bytes.

    triggers: lengths of the triggers of one parse after the other, at most span.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("number"), F.col(text).cast("string").alias("text"))
    place = F.struct("doc_id", "number", "start")
    own = Window.partitionBy("trigger")
    settled, open_ = [], None
    for k in triggers:
        parsed = saved((rows if open_ is None else rows.join(open_, "number")).mapInArrow(_parse(span, k), PARSED), "parse")
        heads = parsed.where(F.col("kind").isin(HEAD, HEAD + 10))
        heads = heads.withColumn("first", F.min(place).over(own)).withColumn("open", (F.min("phrase").over(own) != F.max("phrase").over(own)) | (F.max("kind").over(own) > HEAD))
        heads = heads.where(F.col("open") | (place != F.col("first"))).select("number", "start", "windows", "open")
        others = parsed.where(F.col("kind").isin(MORE, DONE)).select("number", "start", "windows", (F.col("kind") == MORE).alias("open"))
        settled.append(saved(heads.union(others), "settled"))
        discard(parsed)
        open_ = settled[-1].where("open").groupBy("number").agg(F.collect_list(F.struct("start", "windows")).alias("phrases"))
    windows = saved(rows.join(open_, "number").mapInArrow(_windows(span), "first long, second long, doc_id long, number long, start long, windows long"), "windows")
    same = Window.partitionBy("first", "second")
    again = windows.where("first is not null").withColumn("least", F.min(place).over(same)).where(place != F.col("least"))
    done = again.select("number", "start", "windows").union(windows.where("first is null").select("number", "start", "windows"))
    for t in settled:
        done = done.union(t.where("not open").select("number", "start", "windows"))
    out = saved(done.groupBy("number").agg(F.collect_list(F.struct("start", "windows")).alias("runs")), "runs")
    for t in (*settled, windows):
        discard(t)
    return out


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", span: int = 100, texts: bool = False, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs, and with texts the kept bytes.

    Every byte covered by a string of span bytes that also starts earlier is removed: in a smaller doc_id, or earlier in the
    same row. Null and empty texts have no bytes. A null doc_id comes before all others; rows that repeat a doc_id are
    ordered as they are read. Other columns are not read. docs is read several times and must give its rows in the same order
    each time, as a table of files does.
    """
    runs = repeats(docs, text, key, span, **options)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("number"), F.col(text).cast("string").alias("text"))
    joined = rows.join(runs, "number", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_cut(span, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
