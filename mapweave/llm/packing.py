"""Packing documents into fixed-length sequences by best fit and swap-based local search.

Tasks turn texts into token pieces. Pieces of one length are interchangeable, so the search works on bin patterns (the
lengths in a bin, and how many bins are alike): a table of at most `limit` lengths, however many documents there are. The
pieces of a length are numbered by salted counts, and each looks its bin up by length and number. No task holds all pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.common import partitions, raw, release, saved, slices, tokenizer_of

#: Words kept by a task, about 0.1 GB in Arrow arrays; then it begins anew.
CACHE_WORDS = 2_000_000
#: Bytes of text whose words are looked up together: a word is looked up once in them.
SLICE = 1 << 23
#: Pieces of words whose ids are put together at once.
GATHER = 1 << 19
PUNCTUATION = ".,!?;:%&*$#|"
_state: dict[str, "Tokens"] = {}


class Tokens:
    """Token ids of the white-space separated words of texts.

    The tokenizer drops white space and never joins across it, so a word's ids do not depend on its neighbours. Known
    words are kept, at most CACHE_WORDS of them; only new ones go to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer_of(path)
        normalizer = self.tokenizer.normalizer
        self.normalise = normalizer.normalize_str if normalizer else str
        self.plain: set[str] = set()  # letters that stay letters
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.pieces = pa.array([""])  # a piece's number is its place; number 0 is empty
        self.words = pa.array([], pa.string())
        self.codes = np.zeros(0, np.int64)  # of each word the numbers of its two pieces in one
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int32), np.zeros(1, np.int32)

    def parts(self, word: str) -> tuple[str, ...]:
        """A word cut where the tokenizer surely cuts it, at punctuation after letters; one that may hold more cuts stays whole.

        What counts are the letters as the tokenizer normalises them: some become a letter and a combining mark, which it
        joins to the punctuation behind.
        """
        core = word.rstrip(PUNCTUATION)
        if not core.isalpha() or not (core.isascii() or self.plain.issuperset(core) or self.stays_letters(core)):
            return (word,) if core else ("", word)
        return (core.lower() if core.isascii() else core, word[len(core):])

    def stays_letters(self, core: str) -> bool:
        if not self.normalise(core).isalpha():
            return False
        self.plain.update(core)
        return True

    def learn(self, words: list[str]) -> None:
        cut = [self.parts(w) for w in words]
        single = pa.array(list({p for c in cut if len(c) == 2 for p in c}), pa.string())
        at = pc.index_in(single, value_set=self.pieces)
        number = dict(zip(single.filter(at.is_valid()).to_pylist(), at.drop_null().to_pylist()))
        single = single.filter(at.is_null()).to_pylist()
        groups, ids, sizes = [single[i:i + 200] for i in range(0, len(single), 200)], [], []
        for i in range(0, len(groups), 20):  # pieces of letters or of punctuation alone end with their first word-end token
            for group, e in zip(groups[i:i + 20], self.batch([" ".join(g) for g in groups[i:i + 20]])):
                found = np.array(e.ids, dtype=np.uint32)
                ends = np.nonzero(self.word_end[found])[0]
                if len(ends) == len(group):
                    ids.append(found[:ends[-1] + 1])
                    sizes.append(np.diff(ends, prepend=-1))
                else:
                    self.add(group, ids, sizes)
        whole = [c[0] for c in cut if len(c) == 1]
        self.add(whole, ids, sizes)
        size = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int32)
        self.start = np.concatenate([self.start, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *ids])
        number.update(zip(single + whole, range(len(self.size) - len(size), len(self.size))))
        self.pieces = pa.concat_arrays([self.pieces, pa.array(single + whole, pa.string())])
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])
        codes = np.array([number[c[0]] << 32 | (number[c[1]] if len(c) == 2 else 0) for c in cut], np.int64)
        self.codes = np.concatenate([self.codes, codes])

    def batch(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def add(self, texts: list[str], ids: list, sizes: list) -> None:
        for i in range(0, len(texts), 2000):
            found = [np.array(e.ids, dtype=np.uint32) for e in self.batch(texts[i:i + 2000])]
            ids.append(np.concatenate(found))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each ended by id 0, and the len + 1 offsets."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.string())
        if len(self.words) > CACHE_WORDS:
            self.clear()
        known = pc.index_in(names, value_set=self.words)
        at, new = known.fill_null(0).to_numpy().astype(np.int64), known.is_null().to_numpy(zero_copy_only=False)
        at[new] = len(self.words) + np.arange(int(new.sum()))
        self.learn(names.filter(known.is_null()).to_pylist())
        bounds = split.offsets.to_numpy()
        code = self.codes[at][coded.indices.to_numpy()]
        del split, coded, names, known, at, new
        code = np.stack([code >> 32, code & 0xFFFFFFFF], axis=1).ravel().astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(self.size[code], dtype=np.int64)])
        bounds = ends[2 * (bounds - bounds[0])]
        ids = np.zeros(int(ends[-1]), np.uint32)
        for a in range(0, len(code), GATHER):
            part = code[a:a + GATHER]
            size = self.size[part]
            at = np.repeat(self.start[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            ids[ends[a]:ends[a + len(part)]] = self.flat[at]
        return np.insert(ids, bounds[1:], 0), bounds + np.arange(len(texts) + 1)


def _pieces(path: str, limit: int):
    def run(batches):
        if path not in _state:
            _state[path] = Tokens(path)
        tokens = _state[path]
        for b in batches:
            texts = b.column("text").fill_null("")
            for at, end in slices(raw(texts)[1], SLICE):
                ids, offsets = tokens.encode(texts.slice(at, end - at))
                release()
                out = [[], [], [], [], []]
                for key, a, z in zip(b.column("doc_id").slice(at, end - at).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    for n, s in enumerate(range(a, z, limit)):
                        e = min(s + limit, z)
                        for c, v in zip(out, (key, n, s - a, e - s, zlib.crc32(ids[s:e].astype("<u4").tobytes()))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], limit: int) -> Counter:
    """Bins of the multiset of lengths by best fit in falling order, many equal bins at a time."""
    bins: Counter = Counter()
    free: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, how many]
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room == 0:
            bins[pattern] += n
            return
        if not free[room]:
            bisect.insort(rooms, room)
        free[room].append([pattern, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = limit // length
                if left >= each:
                    put(limit - each * length, (length,) * each, left // each)
                    left %= each
                else:
                    put(limit - left * length, (length,) * left, 1)
                    left = 0
                continue
            room = rooms[i]
            pattern, n = free[room].pop()
            if not free[room]:
                del rooms[i]
            each = room // length
            take = min(n, left // each)
            if take:
                if n > take:
                    put(room, pattern, n - take)
                put(room - each * length, pattern + (length,) * each, take)
                left -= take * each
            else:
                if n > 1:
                    put(room, pattern, n - 1)
                put(room - left * length, pattern + (length,) * left, 1)
                left = 0
    for group in free.values():
        for pattern, n in group:
            bins[pattern] += n
    return bins


def local_search(bins: Counter, limit: int) -> Counter:
    """Moves and swaps between underfull bins that raise the sum of squared fills, until no bin can go.

    The emptiest bin gives: a piece moves to a bin with room (fullest result first), else one piece is exchanged for a
    smaller one, or one piece for two smaller ones. Each step makes the receiving bin the fuller of the two, so the sum of
    squares grows, and bins that lose their last piece vanish. Equal bins step together. A bin that can give nothing is
    set aside until a bin appears that it can give to. The steps end where none gains, since the sum of squares is bounded.
    """
    bins = Counter({tuple(sorted(p, reverse=True)): n for p, n in bins.items()})
    least = -(-sum(sum(p) * n for p, n in bins.items()) // limit)
    stuck: set[Pattern] = set()
    while sum(bins.values()) > least:
        open_ = sorted((p for p in bins if sum(p) < limit), key=lambda p: (sum(p), p))
        giver = next((p for p in open_ if p not in stuck), None)
        if giver is None:
            break
        step = best_step(giver, open_, bins, limit)
        if step is None:
            stuck.add(giver)
            continue
        other, out, back = step
        before = {p: bins[p] for p in (replaced(giver, out, back), replaced(other, back, out)) if p}
        n = bins[giver] // 2 if other == giver else min(bins[giver], bins[other])
        for p in (giver, other):
            bins[p] -= n
            if not bins[p]:
                del bins[p]
        for p in (replaced(giver, out, back), replaced(other, back, out)):
            if p:
                bins[p] += n
        fresh = sorted((p for p, had in before.items() if sum(p) < limit and had < 2), key=lambda p: (sum(p), p))
        stuck = {p for p in stuck if p in bins and p not in fresh and best_step(p, fresh, bins, limit) is None}
    return bins


def replaced(pattern: Pattern, out: Pattern, into: Pattern) -> Pattern:
    rest = list(pattern)
    for x in out:
        rest.remove(x)
    return tuple(sorted([*rest, *into], reverse=True))


def best_step(giver: Pattern, open_: list[Pattern], bins: Counter, limit: int):
    """(receiver, pieces it gets, pieces it gives back) with the largest gain in squared fill; None if no step gains."""
    best, low = None, sum(giver)
    for other in reversed(open_):
        if other == giver and bins[giver] < 2:
            continue
        high = sum(other)
        room = limit - high
        if best and 2 * room * (room + high - low) <= best[0]:
            continue
        mine, theirs = sorted(set(giver)), sorted(set(other))
        options = [((x,), ()) for x in mine] + [((x, y), ()) for i, x in enumerate(giver) for y in giver[i + 1:]]
        options += [((x,), (y,)) for x in mine for y in theirs if y < x]
        options += [((x, y), (z,)) for i, x in enumerate(giver) for y in giver[i + 1:] for z in theirs if z < x + y]
        options += [((x,), (y, z)) for x in mine for i, y in enumerate(other) for z in other[i + 1:] if y + z < x]
        for out, back in options:
            d = sum(out) - sum(back)
            gain = 2 * d * (d + high - low)
            if 0 < d <= room and gain > 0 and (best is None or gain > best[0]):
                best = (gain, other, out, back)
    return best and best[1:]


def _placed(bins: Counter):
    """For each length: numbers of its pieces at which an entry begins; and of the entry the bins, place of the first, pieces a bin."""
    table = defaultdict(list)
    done: Counter = Counter()
    sequence = 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in pattern:  # n pieces of this length fill this slot of n bins
            table[length].append((done[length], sequence, offset))
            done[length] += n
            offset += length
        sequence += n
    return {length: np.array(rows, dtype=np.int64) for length, rows in table.items()}


def _assign(table: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            length, number = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.nonzero(np.diff(length[order]))[0] + 1):
                if len(at):
                    rows = table[int(length[at[0]])]
                    e = np.searchsorted(rows[:, 0], number[at], "right") - 1
                    sequence[at], offset[at] = rows[e, 1] + number[at] - rows[e, 0], rows[e, 2]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(sequence), pa.array(offset)], names=keep + ["sequence_id", "offset"])
    return run


def packed(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each row of docs.

    A null or empty text is the end token alone. Rows are documents of their own, also where keys repeat or are null. An
    empty table gives no rows. tokenizer: path of the vocabulary file on every executor.
    """
    spark = docs.sparkSession
    pieces = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _pieces(tokenizer, limit), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = saved(pieces, "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark))).alias("salt")
    counts = pieces.groupBy("length", salt).count()
    offsets = saved(counts.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"), "count"), "counts")
    lengths = {r[0]: r[1] for r in offsets.groupBy("length").agg(F.sum("count")).collect()}  # at most limit rows
    bins = local_search(best_fit(lengths, limit), limit)
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("salt", salt).withColumn("nth", F.row_number().over(order)).join(offsets.drop("count"), ["length", "salt"])
    numbered = numbered.withColumn("number", F.col("before") + F.col("nth") - 1).drop("salt", "nth", "before")
    return numbered.mapInArrow(_assign(_placed(bins)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
