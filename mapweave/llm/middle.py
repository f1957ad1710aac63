"""Fill-in-middle: texts cut at line ends into prefix, middle and suffix, and put together again with marks.

A Fenwick tree over blocks of `BLOCK` bytes holds, for each block, the line ends and the code points in it. A cut after k
lines descends the tree by binary lifting to the block that holds the k-th line end, with the code points before the block
found on the way; the end itself is then looked for in that block alone. Each text is worked on by itself, in its task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import raw

BLOCK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
RESULT = "key long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Bytes of output in one batch.
BATCH = 1 << 24


class Blocks:
    """Fenwick tree of line ends and code points over the blocks of one text (UTF-8 bytes)."""

    def __init__(self, data: np.ndarray, block: int = BLOCK) -> None:
        self.data, self.block = data, block
        self.size = -(-len(data) // block)
        starts = np.arange(0, len(data), block)
        self.ends = data == 10
        self.heads = (data & 0xC0) != 0x80
        self.tree = np.zeros((self.size + 1, 2), np.int64)
        if self.size:
            for column, mask in enumerate((self.ends, self.heads)):
                self.tree[1:, column] = np.add.reduceat(mask, starts, dtype=np.int64)
            for step in (1 << k for k in range(self.size.bit_length())):  # each node adds itself to its parent, level by level
                child = np.arange(step, self.size + 1 - step, 2 * step)
                self.tree[child + step] += self.tree[child]
        whole = self.before(self.size)
        self.line_ends, self.chars = int(whole[0]), int(whole[1])
        self.lines = self.line_ends + bool(len(data) and data[-1] != 10)

    def before(self, blocks: int) -> np.ndarray:
        """Line ends and code points in the first `blocks` blocks."""
        out = np.zeros(2, np.int64)
        while blocks:
            out += self.tree[blocks]
            blocks &= blocks - 1
        return out

    def cut(self, lines: int) -> tuple[int, int]:
        """Bytes and code points of the first `lines` lines."""
        if lines == 0:
            return 0, 0
        if lines > self.line_ends:  # the last line has no end
            return len(self.data), self.chars
        at, left, chars = 0, lines, 0
        for step in (1 << k for k in range(self.size.bit_length() - 1, -1, -1)):
            if at + step <= self.size and self.tree[at + step, 0] < left:
                at += step
                left -= int(self.tree[at, 0])
                chars += int(self.tree[at, 1])
        first = at * self.block
        end = first + int(np.flatnonzero(self.ends[first:first + self.block])[left - 1]) + 1
        return end, chars + int(np.count_nonzero(self.heads[first:end]))


def draws(key: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers of 32 bits from the seed and the key (nothing for a null key)."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(h[i:i + 8], 16) for i in range(0, 32, 8))


def transformed(data: bytes, key: int | None, seed: int, rate: int, spm: int, block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """(lines, form, code points of prefix and middle, output) of one text."""
    text = Blocks(np.frombuffer(data, np.uint8), block)
    h = draws(key, seed)
    if not data or any(m in data for m in MARKS) or h[2] % 100 >= rate:
        return text.lines, "plain", None, None, data
    first, second = sorted(x % (text.lines + 1) for x in h[:2])
    (a, a_chars), (b, b_chars) = text.cut(first), text.cut(second)
    p, s, m = MARKS
    prefix, middle, suffix = p + data[:a], m + data[a:b], s + data[b:]
    if h[3] % 100 < spm:
        return text.lines, "spm", a_chars, b_chars - a_chars, suffix + prefix + middle
    return text.lines, "psm", a_chars, b_chars - a_chars, prefix + suffix + middle


def _run(seed: int, rate: int, spm: int):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RESULT.split(", ")]

    def batch(rows):
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].view(pa.string())], names=names)

    def run(batches):
        for b in batches:
            data, offsets = raw(b.column("text"))
            rows, size = [], 0
            for key, s, e in zip(b.column("key").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                rows.append((key, *transformed(data[s:e].tobytes(), key, seed, rate, spm)))
                size += e - s
                if size > BATCH:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)
    return run


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed: the parts between the marks, in their first order."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def filled(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row: its text in the order plain, prefix-suffix-middle or
    suffix-prefix-middle.

    rate: per cent of the texts that are cut; spm: per cent of these in the form spm. A null text is empty. Empty texts and
    texts that hold a mark stay plain, with null counts. A null key draws as an empty one. Rows that repeat a key draw
    alike; each row gives one row. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    def named(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")
    out = docs.select(named(key).cast("long").alias("key"), named(text).cast("string").alias("text")).mapInArrow(_run(seed, rate, spm), RESULT)
    return out.withColumnRenamed("key", key)
