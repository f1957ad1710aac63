"""Token ids in binary files: a concatenated id array with Elias-Fano coded document boundaries.

A file holds up to `FRAMES` frames, each ended by a line end. Frame (numbers little-endian): `MAGIC`, a head of nine 64-bit
numbers (part, number in the part, documents, ids, bytes of an id, low bits of a boundary, bytes of the upper bits, documents
with a key, base of the keys), then

* the documents' keys as differences from the base, 64 bits each (documents without a key come first and have none),
* the boundaries: the end of document i, a number of ids, split into its low bits, packed, and its upper bits as a bit
  vector with a one at (end >> low bits) + i,
* the select structure: for every `SAMPLE` bits of that vector the ones before it, 32 bits each,
* the ids.

A boundary takes about 2 + log2(ids / documents) bits and the select structure 1/16 bit a bit, in place of 64. select(i) finds
the stretch by its count of ones, then the one inside the stretch.

Writing: documents are dealt out by ranges of the key and sorted, so that frames follow each other by part and number; a task
encodes its texts and closes a frame at `FRAME_IDS` ids. Spark's text writer stores a frame to a row.
Reading: a task takes one file at a time; where a frame starts among all ids is the sum of the ids in the frames before it.
"""

from __future__ import annotations

import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapweave.llm.common import Rolling, raw, release, saved, slices, tokenizer_of
from mapweave.sources.shared import shared_folder

MAGIC = b"IDEF0001"
HEAD = 9
#: Bits of the upper vector to one count of the select structure.
SAMPLE = 512
#: Ids in a frame, and frames in a file. A document is never split, so a longer one makes a longer frame.
FRAME_IDS, FRAMES = 1 << 18, 32
#: Bytes of text that are encoded together, units kept by a task (about 0.1 GB), and the bytes of the longest unit kept.
SLICE, UNITS, LONGEST = 1 << 22, 2_000_000, 256
#: Units that are encoded as one text, texts that go to the tokenizer at once, and ids that are put together at once.
JOINED, CALL, GATHER = 64, 512, 1 << 19
_state: dict[str, "Units"] = {}

# Classes of bytes: 0 part of a longer character, 1 letter, 2 digit, 3 other sign, 4 white space but 5 the space.
CLASS = np.array([5 if c == 32 else 4 if c in (9, 10, 11, 12, 13, 28, 29, 30, 31) else 0 if c > 127 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)
#: Whether a byte-level tokenizer surely cuts between two bytes of these classes: between letters, digits and signs, and before white space.
CUT = np.array([[a in (1, 2, 3) and b in (1, 2, 3, 4, 5) and a != b for b in range(6)] for a in range(6)])
SOLID = np.array([0, 1, 1, 1, 0, 0], bool)
APOSTROPHE = 39


class Units:
    """Ids of texts by a byte-level tokenizer, through the ids of their units.

    Such a tokenizer first cuts a text into words, each with the one space before it, numbers, runs of signs and white space,
    and looks at nothing behind a cut. A unit ends where two ASCII signs prove a cut; letters after an apostrophe, which can
    be a contraction, and characters beyond ASCII never do. So the ids of a text are those of its units in a row. Known
    units are kept, named by two 64-bit hashes; only new ones go to the tokenizer. A text that spells one of the tokenizer's added tokens is one unit.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer_of(path)
        self.names = Rolling(12), Rolling(13)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a sign of a token stands for a byte
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known, self.check, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)  # by rising hash
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), CALL):
            found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts[i:i + CALL]], add_special_tokens=False)
            out += [np.array(e.ids, np.uint32) for e in found]
        return out

    def learn(self, units: list[bytes]) -> np.ndarray:
        """Numbers of new units. Those of a space and ASCII signs go to the tokenizer in joined texts, in which their bytes part the ids again."""
        spaced = np.fromiter((len(u) > 1 and u[0] == 32 and SOLID[CLASS[u[1]]] and u.isascii() for u in units), bool, len(units))
        joined, single = ([units[i] for i in np.flatnonzero(m)] for m in (spaced, ~spaced))
        alone, groups = self.ids_of(single), self.ids_of([b"".join(joined[i:i + JOINED]) for i in range(0, len(joined), JOINED)])
        ids = np.concatenate([*groups, *alone, np.zeros(0, np.uint32)])
        whole = sum(map(len, groups))
        ends = np.searchsorted(np.cumsum(self.bytes[ids[:whole]]), np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))) + 1
        size = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, alone), np.int64, len(alone))]).astype(np.int32)
        self.start = np.concatenate([self.start, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])
        out = np.zeros(len(units), np.int32)
        out[np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])] = len(self.size) - len(units) + np.arange(len(units))
        return out

    def numbers(self, units: pa.Array) -> np.ndarray:
        """Numbers of different units; new ones are learned, those over LONGEST bytes only for now."""
        data, offsets = raw(units)
        name, check = np.zeros((2, len(units)), np.uint64)
        for s, e in slices(offsets, 1 << 16):
            if e - s > 1 or offsets[e] - offsets[s] <= LONGEST:
                own, at = data[offsets[s]:offsets[e]], offsets[s:e + 1] - offsets[s]
                name[s:e], check[s:e] = (r.of(r.prefix(own), at[:-1], at[1:]) for r in self.names)
        at = np.minimum(np.searchsorted(self.known, name), max(len(self.known) - 1, 0))
        found = (self.known[at] == name) & (self.check[at] == check) if len(self.known) else np.zeros(len(name), bool)
        found &= np.diff(offsets) <= LONGEST
        out = self.number[at] if len(self.known) else np.zeros(len(name), np.int32)
        new = np.flatnonzero(~found)
        out[new] = self.learn(units.take(pa.array(new)).to_pylist())
        kept = new[np.diff(offsets)[new] <= LONGEST]
        kept = kept[np.argsort(name[kept], kind="stable")]
        at = np.searchsorted(self.known, name[kept])
        self.known, self.check, self.number = np.insert(self.known, at, name[kept]), np.insert(self.check, at, check[kept]), np.insert(self.number, at, out[kept])
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[offsets[i]:offsets[i + 1]], each ended by id 0, and the len + 1 offsets of the ids."""
        starts = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            kind = CLASS[data]
            here, after = kind[:-1], kind[1:]
            at = CUT[here, after]
            at &= (data[:-1] != APOSTROPHE) | (after != 1)
            at[:-1] |= (after[:-1] == 5) & SOLID[after[1:]]  # a space before a sign belongs to it, whatever is in front
            starts[1:-1] = at
        whole = data.tobytes()
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right"))
                starts[offsets[text - 1]:offsets[text]] = False
                at = whole.find(token, at + 1)
        starts[offsets] = True
        starts[len(data)] = True
        cuts = np.flatnonzero(starts)
        del starts
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(whole)]) if len(data) else pa.array([], pa.large_binary())
        coded = units.dictionary_encode()
        if len(self.size) + len(coded.dictionary) > UNITS:
            self.clear()
        code = self.numbers(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int32)
        del units, coded
        ends = np.concatenate([[0], np.cumsum(self.size[code], dtype=np.int64)])
        bounds = ends[np.searchsorted(cuts, offsets)] if len(data) else np.zeros(len(offsets), np.int64)
        ids = np.zeros(int(ends[-1]), np.uint32)
        for a in range(0, len(code), GATHER):
            part = code[a:a + GATHER]
            size = self.size[part]
            at = np.repeat(self.start[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            ids[ends[a]:ends[a + len(part)]] = self.flat[at]
        # id 0 at the end of every text
        return np.insert(ids, bounds[1:], 0).astype(f"<u{self.width}"), bounds + np.arange(len(offsets))


def packed_bits(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, one after another."""
    bits = (values[:, None] >> np.arange(width)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


class Boundaries:
    """Elias-Fano code of rising numbers with a select structure."""

    def __init__(self, low_bits: int, count: int, low: bytes, upper: np.ndarray, before: np.ndarray) -> None:
        self.low_bits, self.count, self.low, self.upper, self.before = low_bits, count, np.frombuffer(low, np.uint8), upper, before

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> "Boundaries":
        n = len(values)
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        places = (values >> low_bits) + np.arange(n)
        size = -(-((int(places[-1]) if n else 0) + 1) // SAMPLE) * SAMPLE
        bits = np.zeros(size, np.uint8)
        bits[places] = 1
        ones = bits.reshape(-1, SAMPLE).sum(axis=1)
        return cls(low_bits, n, packed_bits(values, low_bits), np.packbits(bits, bitorder="little"), (np.cumsum(ones) - ones).astype("<u4"))

    def select(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers, from 0."""
        out = np.zeros(len(i), np.int64)
        for a in range(0, len(i), 2048):
            part = i[a:a + 2048]
            stretch = np.searchsorted(self.before, part, "right") - 1
            bits = np.unpackbits(self.upper.reshape(-1, SAMPLE // 8)[stretch], axis=1, bitorder="little")
            inside = np.argmax(np.cumsum(bits, axis=1, dtype=np.int32) > (part - self.before[stretch])[:, None], axis=1)
            high = stretch * SAMPLE + inside - part
            bit = part[:, None] * self.low_bits + np.arange(self.low_bits)
            low = (self.low[bit >> 3].astype(np.int64) >> (bit & 7)) & 1 if self.low_bits else np.zeros((len(part), 0), np.int64)
            out[a:a + 2048] = (high << self.low_bits) + (low << np.arange(self.low_bits)).sum(axis=1)
        return out


def frame_of(part: int, number: int, keys: list[int | None], sizes: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    known = np.array([k for k in keys if k is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = Boundaries.of(np.cumsum(sizes), len(ids))
    head = np.array([part, number, len(keys), len(ids), width, ends.low_bits, len(ends.upper), len(known), base], "<i8")
    return b"".join([MAGIC, head.tobytes(), (known - base).astype("<i8").tobytes(), ends.low.tobytes(), ends.upper.tobytes(), ends.before.tobytes(), ids.astype(f"<u{width}").tobytes()])


class Frame:
    """A frame's head, keys, boundaries and ids, from byte `at` of a file; `end` is where the next begins. ValueError if it isn't whole."""

    def __init__(self, data: memoryview, at: int = 0) -> None:
        if bytes(data[at:at + 8]) != MAGIC or len(data) < at + 8 + 8 * HEAD:
            raise ValueError("no frame of ids")
        self.part, self.number, self.docs, self.ids, self.width, low_bits, upper, known, base = (int(x) for x in np.frombuffer(data, "<i8", HEAD, at + 8))
        at += 8 + 8 * HEAD
        sizes = [8 * known, -(-self.docs * low_bits // 8), upper, upper * 8 // SAMPLE * 4, self.ids * self.width]
        self.end = at + sum(sizes) + 1
        if bytes(data[self.end - 1:self.end]) != b"\n":
            raise ValueError("a frame of ids is cut off")
        parts = []
        for n in sizes:
            parts.append(data[at:at + n])
            at += n
        self.keys = [None] * (self.docs - known) + (np.frombuffer(parts[0], "<i8") + base).tolist()
        self.ends = Boundaries(low_bits, self.docs, parts[1], np.frombuffer(parts[2], np.uint8), np.frombuffer(parts[3], "<u4").astype(np.int64))
        self.values = np.frombuffer(parts[4], f"<u{self.width}")

    def bounds(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end among the frame's ids of its i-th documents."""
        ends = self.ends.select(i)
        starts = np.where(i > 0, self.ends.select(np.maximum(i - 1, 0)), 0)
        return starts, ends


def frames(data: memoryview):
    """The frames of a file."""
    at = 0
    while at < len(data):
        frame = Frame(data, at)
        at = frame.end
        yield frame


def _encode(path: str, frame_ids: int):
    def run(batches):
        if path not in _state:
            _state[path] = Units(path)
        units, part, number = _state[path], TaskContext.get().partitionId(), 0
        keys, sizes, ids, have = [], [], [], 0

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([frame_of(part, number, keys, np.concatenate(sizes), np.concatenate(ids), units.width)], pa.binary())], names=["frame"])
        for b in batches:
            data, offsets = raw(b.column("text"))
            own = b.column("key").to_pylist()
            for s, e in slices(offsets, SLICE):
                found, bounds = units.encode(data[offsets[s]:offsets[e]], offsets[s:e + 1] - offsets[s])
                release()
                at = 0
                while at < e - s:  # as many documents as the open frame still takes, at least one
                    end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + frame_ids - have, "right")) - 1)
                    end = min(end, e - s)
                    keys += own[s + at:s + end]
                    sizes.append(np.diff(bounds[at:end + 1]))
                    ids.append(found[bounds[at]:bounds[end]])
                    have += int(bounds[end] - bounds[at])
                    at = end
                    if have >= frame_ids or at < e - s:
                        yield closed()
                        keys, sizes, ids, have, number = [], [], [], 0, number + 1
        if keys:
            yield closed()
    return run


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", frame_ids: int = FRAME_IDS) -> None:
    """Write the ids of every text, ended by id 0, to files under path in ascending order of the key.

    tokenizer: a byte-level tokenizer file of the tokenizers library, at the same place on every executor. A null text is
    empty and gives id 0 alone. Rows without a key come first; rows with equal keys follow each other by a hash of the text,
    then by the text, and may lie in several frames. An empty table makes no file. Other columns are ignored, whatever their names.
    """
    rows = docs.select(named(key).cast("long").alias("key"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.asc_nulls_first("key"), "tie").sortWithinPartitions(F.asc_nulls_first("key"), "tie", "text").select("key", "text")
    found = rows.mapInArrow(_encode(tokenizer, frame_ids), "frame binary")
    found.select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", FRAMES).text(path)


RESULT = "part long, number long, key long, start long, n_tokens long, ids_crc32 long"


def _read(batches):
    names = [x.split()[0] for x in RESULT.split(", ")]
    for b in batches:
        for content in b.column("content"):
            for f in frames(memoryview(content.as_buffer())):
                starts, ends = f.bounds(np.arange(f.docs))
                sums = [zlib.crc32(f.values[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                columns = [np.full(f.docs, f.part), np.full(f.docs, f.number), f.keys, starts, ends - starts, sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files under path; start counts the ids of all documents before it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = saved(files.mapInArrow(_read, RESULT), "id-files")
    # a row per frame, then a row per part: neither grows with the documents of a part
    sizes = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("ids"))
    parts = dict(sizes.groupBy("part").agg(F.sum("ids")).collect())
    first = [0]
    for p in range(max(parts, default=0)):
        first.append(first[-1] + parts.get(p, 0))
    before = F.sum("ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("part", "number", (F.coalesce(before, F.lit(0)) + F.lit(first).cast("array<bigint>")[F.col("part").cast("int")]).alias("base"))
    return found.join(bases, ["part", "number"]).select("key", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def stored(docs: DataFrame, tokenizer: str, key: str = "doc_id", **options) -> DataFrame:
    """Write docs to files in the shared folder and read them back: (key, start, n_tokens, ids_crc32) of every row."""
    path = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex[:12]}"
    write(docs, path, tokenizer, key, **options)
    return read(docs.sparkSession, path).withColumnRenamed("key", key)
