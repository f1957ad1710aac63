"""Near duplicates by 64-bit SimHash: fingerprints in Python tasks, exact links through vantage-point shards.

The tree. Vantage point v looks at disjoint blocks of bits. Level L has L blocks; a fingerprint's place is the list of its
Hamming distances to v inside each block. By the triangle bound the distances of two fingerprints in a block differ
by at most their own distance there, so two fingerprints at distance r lie in places that differ by r in sum at most.
A fingerprint therefore has one home shard and visits just the shards within that bound; each block of level L splits
into two at level 2L, so shards over the capacity are split further, down to single fingerprints. Links are exact.
"""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import U, components, discard, forest, mixed, partitions, raw, saved, slices, thrifty
from mapweave.llm.decontam import Words

#: Fixed vantage point and the levels of the tree: number of blocks -> bits of a distance in the shard key.
VANTAGE = 0x9E3779B97F4A7C15
KEY_BITS = {4: 5, 8: 4, 16: 3, 32: 2, 64: 1}


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the word shingles of a text: A-Z in lower case, words are runs without ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, 42)  # one shingle: its bits are in over half
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.concatenate([[0], ends])[:len(words) - shingle + 1].tolist(), (ends[shingle - 1:] - 1).tolist()
    counts, n, step = np.zeros(64, np.int64), len(starts), 1 << 16
    for at in range(0, n, step):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + step], ends[at:at + step])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle):
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
    return run


def _steps(level: int, radius: int) -> np.ndarray:
    """All differences of distance lists whose absolute sum is at most radius."""
    out = [np.zeros(level, np.int8)]
    for r in range(1, radius + 1):
        for where in combinations(range(level + r - 1), r):  # multisets of r blocks
            blocks = np.bincount([w - i for i, w in enumerate(where)], minlength=level)
            used = np.nonzero(blocks)[0]
            for signs in range(1 << len(used)):
                d = blocks.astype(np.int8)
                for i, u in enumerate(used):
                    d[u] *= -1 if signs >> i & 1 else 1
                out.append(d)
    return np.array(out)


def _distances(fp: np.ndarray, level: int) -> np.ndarray:
    width = 64 // level
    x = fp ^ np.uint64(VANTAGE)
    mask = np.uint64(2**width - 1)
    return np.stack([np.bitwise_count((x >> np.uint64(i * width)) & mask) for i in range(level)], axis=1).astype(np.int8)


def _key(d: np.ndarray, level: int) -> np.ndarray:
    out = np.zeros(len(d), np.uint64)
    for i in range(level):
        out |= d[:, i].astype(np.uint64) << np.uint64(i * KEY_BITS[level])
    return out.view(np.int64)


def _visits(level: int, radius: int, inside: bool):
    """Rows (place, fp, home) -> a row for each shard to visit; inside: only shards within the place, a shard one level up."""
    steps, width = _steps(level, radius), 64 // level

    def run(batches):
        for b in batches:
            for o in range(0, b.num_rows, 20_000):
                c = b.slice(o, 20_000)
                place, fp, home = (c.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                home = home.astype(bool)
                d = _distances(fp.view(np.uint64), level)
                own = _key(d, level)
                keys, fps, homes = [], [], []
                for s in steps:
                    at = d + s
                    ok = ((at >= 0) & (at <= width)).all(axis=1)
                    key = _key(np.where(ok[:, None], at, 0), level)
                    ok &= ~home | (key >= own)  # two homes meet once, in the larger key
                    if inside:
                        ok &= _key(np.where(ok[:, None], at, 0)[:, 0::2] + np.where(ok[:, None], at, 0)[:, 1::2], level // 2) == place
                    keys.append(key[ok])
                    fps.append(fp[ok])
                    homes.append((home & (key == own))[ok])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, fps, homes)], names=["place", "fp", "home"])
    return run


def _links(members: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links of a shard: between members, and of members with visitors."""
    every = np.concatenate([members, visitors])
    step = max(1, (1 << 22) // max(1, len(every)))
    label = every.view(np.int64).copy()
    near = []
    for o in range(0, len(members), step):
        i, j = np.nonzero(np.bitwise_count(members[o:o + step, None] ^ every[None, :]) <= radius)
        i = i + o
        keep = i != j
        if keep.any():
            near.append((i[keep], j[keep]))
    if not near:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate([a for a, _ in near]), np.concatenate([b for _, b in near])
    before = None
    while before is None or (label != before).any():
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
    own = every.view(np.int64)
    keep = label != own
    return own[keep], label[keep]


def by_place(batches):
    """Columns of batches sorted by the first one, cut so that a place is never in two of them."""
    rest = None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
        if len(cols[0]):
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut:
                yield [c[:cut] for c in cols]
            cols = [c[cut:] for c in cols]
        rest = cols
    if rest is not None and len(rest[0]):
        yield rest


def _solve(radius: int):
    """Rows (place, fp, home) sorted by place -> edges."""
    def run(batches):
        for place, fp, home in by_place(batches):
            bounds = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1, [len(place)]])
            us, vs = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                h = home[a:b].astype(bool)
                if b - a > 1 and h.any():
                    f = fp[a:b].view(np.uint64)
                    u, v = _links(f[h], f[~h], radius)
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])
    return run


def linked_fingerprints(fps: DataFrame, radius: int = 2, capacity: int = 1 << 16) -> DataFrame:
    """Edges (u, v) that span every group of distinct fingerprints fp linked at radius or fewer differing bits."""
    spark = fps.sparkSession
    level = 4
    rows, edges, inside = fps.select(F.lit(0).cast("long").alias("place"), "fp", F.lit(True).alias("home")), None, False
    while True:
        visits = saved(rows.mapInArrow(_visits(level, radius, inside), "place long, fp long, home boolean"), "visits")
        heavy = saved(visits.groupBy("place").count().where(F.col("count") > capacity).select("place"), "heavy")
        more = level < 64 and heavy.limit(1).count() > 0
        light = visits.join(heavy, "place", "left_anti") if more else visits
        found = light.repartition(partitions(spark), "place").sortWithinPartitions("place").mapInArrow(_solve(radius), "u long, v long")
        found = saved(found, "links")
        if not more:
            discard(visits)
        edges = found if edges is None else edges.union(found)
        if not more:
            return edges
        rows, level, inside = visits.join(heavy, "place", "left_semi").select("place", "fp", "home"), 2 * level, True


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = 2, capacity: int = 1 << 16) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Fingerprints link at radius or fewer differing bits; component_id is the smallest key reachable. Null and empty texts
    have fingerprint zero and are linked like any other. A row with a null key gets its fingerprint and no component, and
    its text joins nothing; repeated keys give repeated rows. Other columns are not read, so their names cannot clash.
    capacity: rows of a shard, above which it is split; rows are 17 bytes and a shard is compared within one task.
    """
    prints = saved(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
                   .mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "prints")
    fps = saved(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = components(linked_fingerprints(fps.select("fp"), radius, capacity), "simhash")
    placed = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = saved(placed.join(smallest, "root").select("fp", "component_id"), "placed")
    out = prints.join(placed, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Eight slices of 16 bits; pairs of 128-bit hashes that meet in one and differ in at most NEAR bits are tried first.
SLICE_BITS, NEAR = 16, 34
#: Rows of a chunk that are compared with another chunk at once.
STRIP = 256


def shingle_sets(texts: pa.Array, shingle: int):
    """The distinct shingle hashes of each text, as sorted numbers; a text of fewer words is one shingle."""
    data, offsets = raw(texts)
    for s, e in slices(offsets, 1 << 19):
        w = Words(data[offsets[s]:offsets[e]], offsets[s:e + 1] - offsets[s])
        for first, n in zip(w.first.tolist(), w.count.tolist()):
            k = min(n, shingle)
            yield np.unique(w.hashes(np.arange(first, first + n - k + 1), k)) if k else np.zeros(0, np.uint64)


def wide_fingerprint(s: np.ndarray) -> list[int]:
    """SimHash of 128 bits, as two numbers, of a set of shingle hashes: each counts once, however often the text repeats it."""
    out = []
    for h in (s, mixed(s ^ U(0xA5A5A5A5A5A5A5A5))):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(bits * 2 > len(s), bitorder="little").view("<i8")[0]))
    return out


def parity(s: np.ndarray) -> bytes:
    """A bitmap of 2 to 4 bits a shingle, 64 or more: a bit is the parity of the shingles that fall on it."""
    bits = 1 << max(6, math.ceil(math.log2(max(1, 2 * len(s)))))
    at = (mixed(s) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has, by their bitmaps: shared shingles cancel out."""
    x, y = sorted((np.frombuffer(z, np.uint8) for z in (x, y)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)  # the longer one folded to the length of the other
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def _wide(shingle: int):
    """Rows (doc_id, text) -> digest and size of the set of shingles, its SimHash and its bitmap."""
    def run(batches):
        for b in batches:
            out = []
            for s in shingle_sets(b.column("text"), shingle):
                sums = [int(mixed(s ^ U(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                out.append((*sums, len(s), *wide_fingerprint(s), parity(s)))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "d", "e", "n", "a", "b", "p"])
    return run


def shard_pairs(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (u, v) of classes (id, a) out of the vantage-point shards: they span all groups whose fingerprints a are linked at
    radius or fewer differing bits, one pair for each class but the first of its group at most twice."""
    fps = saved(classes.groupBy(F.col("a").alias("fp")).agg(F.min("id").alias("first")), "fps")
    ends = [fps.select(F.col("fp").alias(e), F.col("first").alias(f"first_{e}")) for e in "uv"]
    linked = linked_fingerprints(fps.select("fp"), radius).join(ends[0], "u").join(ends[1], "v")
    linked = linked.select(F.least("first_u", "first_v").alias("u"), F.greatest("first_u", "first_v").alias("v"))
    same = classes.join(fps, classes.a == fps.fp).where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    return saved(same.union(linked).distinct(), "shards")


def _slice_visits(batches):
    """A row for each slice of each fingerprint."""
    for b in batches:
        ids, lo, hi = (b.column(n).to_numpy() for n in ("id", "a", "b"))
        for i in range(8):
            part = (hi if i > 3 else lo).view(np.uint64) >> U(16 * (i % 4)) & U(0xFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64) | i << SLICE_BITS), pa.array(ids), pa.array(lo), pa.array(hi)], names=["place", "id", "a", "b"])


def tree_of(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the pairs that make a forest of the smallest distances."""
    at = np.argsort(d, kind="stable")
    kept = []
    while len(at):
        if kept:
            every = np.concatenate(kept)
            nodes, roots = forest(i[every], j[every])
            label = dict(zip(nodes.tolist(), roots.tolist()))
            x, y = (np.array([label.get(v, v) for v in side[at].tolist()]) for side in (i, j))
        else:
            x, y = i[at], j[at]
        apart = x != y
        at, x, y = at[apart], x[apart], y[apart]
        if len(at):
            ends, first = np.unique(np.concatenate([x, y]), return_index=True)
            kept.append(np.unique(at[np.unique(first % len(at))]))
    return np.concatenate(kept) if kept else at


def grouped(batches):
    """Columns of the runs of equal first values of batches sorted by it; runs of one row are left out."""
    for cols in by_place(batches):
        bounds = np.concatenate([[0], np.nonzero(np.diff(cols[0]))[0] + 1, [len(cols[0])]])
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if e - s > 1:
                yield [c[s:e] for c in cols]


def strips(first: int, chunk: int):
    """Slices of STRIP rows of a chunk: the comparison with another chunk needs memory for these only."""
    return (slice(at, min(at + STRIP, first + chunk)) for at in range(first, first + chunk, STRIP))


def _slice_pairs(chunk: int):
    """Shards in order -> of each shard a forest of its nearest pairs."""
    def run(batches):
        for _, ids, a, b in grouped(batches):
            a, b = a.view(np.uint64), b.view(np.uint64)
            for o in range(0, len(ids), chunk):
                for p in range(0, o + 1, chunk):
                    n, found = slice(p, p + chunk), []
                    for m in strips(o, chunk):
                        d = np.bitwise_count(a[m, None] ^ a[None, n]) + np.bitwise_count(b[m, None] ^ b[None, n])
                        i, j = np.nonzero(d <= NEAR)
                        x, y, e = ids[m][i], ids[n][j], d[i, j]
                        keep = x < y if o == p else x != y
                        x, y, e = x[keep], y[keep], e[keep]
                        t = tree_of(x, y, e)
                        found.append((x[t], y[t], e[t]))
                    x, y, e = (np.concatenate(c) for c in zip(*found))
                    if len(x):
                        t = tree_of(x, y, e)
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[t], y[t])), pa.array(np.maximum(x[t], y[t]))], names=["u", "v"])
    return run


#: Shingles are counted by the upper COUNTED bits of their hashes, in 2**BUCKETS stretches that are dealt to tasks, FLUSH at a time.
COUNTED, BUCKETS, FLUSH = 32, 10, 1 << 20


def _shingle_counts(shingle: int):
    """Rows (text) -> (bucket, low): the shingles of all texts by the upper bits of their hashes, the rest of COUNTED bits as three bytes each."""
    def packed(held):
        at = np.sort(np.concatenate(held) >> U(64 - COUNTED)).astype(np.uint32)
        bits = COUNTED - BUCKETS
        bounds = np.searchsorted(at, np.arange((1 << BUCKETS) + 1, dtype=np.uint64) << U(bits))
        low = np.ascontiguousarray((at & ((1 << bits) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
        some = np.nonzero(np.diff(bounds))[0]
        parts = [low[bounds[i]:bounds[i + 1]].tobytes() for i in some.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(parts, pa.binary())], names=["bucket", "low"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            for s in shingle_sets(b.column("text"), shingle):
                held.append(s)
                n += len(s)
                if n >= FLUSH:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)
    return run


def _bucket_levels(bits: int):
    """Rows (bucket, low) in order -> (bucket, levels): for each place of the bucket the doublings of its most common shingle."""
    def run(batches):
        bucket, counts = None, None

        def done():
            most = counts.reshape(1 << bits - BUCKETS, -1).max(axis=1)
            levels = np.where(most > 1, np.log2(np.maximum(most, 1)).astype(np.uint8), 0).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["bucket", "levels"])

        for b in batches:
            for at, low in zip(b.column("bucket").to_pylist(), b.column("low")):
                if at != bucket:
                    if bucket is not None:
                        yield done()
                    bucket, counts = at, np.zeros(1 << COUNTED - BUCKETS, np.int32)
                x = np.frombuffer(low.as_py(), np.uint8).reshape(-1, 3).astype(np.uint32)
                np.add.at(counts, x[:, 0] | x[:, 1] << 8 | x[:, 2] << 16, 1)
        if bucket is not None:
            yield done()
    return run


def shingle_levels(texts: DataFrame, ids: DataFrame, shingle: int, bits: int = 22) -> np.ndarray:
    """How common shingles are, as a table of 2**bits places by hash: doublings of the most common one there, 0 for those met once.

    Every shingle of every text in ids is counted, by 32 bits of its hash. The levels only order the shingles, so they bear on time,
    not on results; shingles that fall on one place count as the more common of them. Texts that only a likely() id lets in are
    counted too. Tasks send about three bytes a shingle; the driver gets a byte for each place.
    """
    n = partitions(texts.sparkSession)
    low = likely(texts, ids).select("text").mapInArrow(thrifty(_shingle_counts(shingle)), "bucket int, low binary")
    found = low.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(thrifty(_bucket_levels(bits)), "bucket int, levels binary")
    levels = np.zeros((1 << BUCKETS, 1 << bits - BUCKETS), np.uint8)
    for r in found.toLocalIterator():
        levels[r.bucket] = np.frombuffer(r.levels, np.uint8)
    return np.roll(levels.ravel(), 1 << bits - 1)  # places are the upper bits as of a signed number


def level_of(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The levels of shingles out of the table: the place is the upper bits, as of a signed number."""
    bits = len(levels).bit_length() - 1
    return levels[(s.view(np.int64) >> 64 - bits) + (len(levels) >> 1)]


def least_common(a, b, similarity: float):
    """How many shingles sets of the sizes a and b share at least at this similarity."""
    return np.ceil(similarity / (1 + similarity) * (a + b) - 1e-6)


def prefix(s: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones first: two sets as similar as asked share one of them."""
    s = s[np.argsort(level_of(s, levels), kind="stable")]
    return s[:len(s) - math.ceil(similarity * len(s) - 1e-6) + 1] if len(s) else s


def _prefixes(shingle: int, similarity: float, sent):
    """Rows (id, text) -> (id, firsts): the shingles of the prefix, in order. sent: the broadcast table of levels."""
    def run(batches):
        for b in batches:
            firsts = [prefix(s, sent.value, similarity).tobytes() for s in shingle_sets(b.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(firsts, pa.binary())], names=["id", "firsts"])
    return run


def _postings(batches):
    """Rows (id, root, size, firsts) -> (token, id, root, size, place) of each shingle of the prefix."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            c = b.slice(at, 500)
            firsts = [np.frombuffer(f.as_py(), np.int64) for f in c.column("firsts")]
            n = [len(f) for f in firsts]
            cols = [np.concatenate(firsts), *(np.repeat(c.column(k).to_numpy(), n) for k in ("id", "root", "size")), np.concatenate([np.arange(k, dtype=np.int32) for k in n])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["token", "id", "root", "size", "place"])


def _prefix_pairs(similarity: float, chunk: int):
    """Postings in order -> all pairs of different roots whose places and sizes allow the similarity."""
    def run(batches):
        for _, ids, roots, size, place in grouped(batches):
            if (roots == roots[0]).all():
                continue
            rest = size - place  # shingles from this one on
            for o in range(0, len(ids), chunk):
                for p, m in product(range(0, o + 1, chunk), strips(o, chunk)):
                    n = slice(p, p + chunk)
                    ok = np.minimum(rest[m, None], rest[None, n]) >= least_common(size[m, None], size[None, n], similarity)
                    i, j = np.nonzero(ok & (roots[m, None] != roots[None, n]))
                    x, y = ids[m][i], ids[n][j]
                    keep = x < y if o == p else x != y
                    if keep.any():
                        x, y = x[keep], y[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["u", "v"])
    return run


def _sets(shingle: int):
    def run(batches):
        for b in batches:
            sets = [s.tobytes() for s in shingle_sets(b.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], names=["id", "s"])
    return run


def _alike(similarity: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("su"), b.column("sv")):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(n).filter(keep) for n in ("u", "v")], names=["u", "v"])
    return run


def _sift(similarity: float):
    """Rows (u, v, nu, pu, nv, pv) -> the pairs that their bitmaps do not rule out, with the least number of shingles apart."""
    def run(batches):
        for b in batches:
            nu, nv = (b.column(c).to_numpy() for c in ("nu", "nv"))
            apart = np.array([least_apart(x.as_py(), y.as_py()) for x, y in zip(b.column("pu"), b.column("pv"))], np.int64)
            keep = pa.array(apart <= nu + nv - 2 * least_common(nu, nv, similarity))
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep), pa.array(apart).filter(keep)], names=["u", "v", "apart"])
    return run


def sifted(pairs: DataFrame, classes: DataFrame, similarity: float, name: str) -> DataFrame:
    """The pairs (u, v) of classes (id, n, p) that can have the similarity: no such pair is lost, few others stay."""
    end = [classes.select(F.col("id").alias(e), F.col("n").alias(f"n{e}"), F.col("p").alias(f"p{e}")) for e in "uv"]
    return saved(pairs.join(end[0], "u").join(end[1], "v").select("u", "v", "nu", "pu", "nv", "pv").mapInArrow(thrifty(_sift(similarity)), "u long, v long, apart long"), name)


def likely(texts: DataFrame, nodes: DataFrame, bits: int = 23) -> DataFrame:
    """The rows (id, text) of texts whose id is in nodes (id, distinct), and a few others. A filter of 2**bits bits is sent to all tasks
    (2**(bits - 6) rows at most, whatever the number of nodes); no text is shuffled."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    words = nodes.select(word.alias("word"), F.expr("1L").alias("one"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.call_function("shiftleft", "one", "bit")).alias("bits"))
    found = texts.withColumns({"word": word, "bit": bit}).join(F.broadcast(words), "word")
    return found.where(F.call_function("getbit", "bits", "bit") == 1).select("id", "text")


def among(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of texts whose id is in nodes (id, distinct). Only likely() ones are shuffled; the join then decides."""
    return likely(texts, nodes).join(nodes, "id")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, name: str) -> DataFrame:
    """The pairs (u, v) whose texts (id, text) have the similarity, each tested by its sets of shingles."""
    nodes = saved(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "nodes")
    sets = saved(among(texts, nodes).select("id", "text").mapInArrow(thrifty(_sets(shingle)), "id long, s binary"), "sets")
    joined = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("sv")), "v")
    links = saved(joined.mapInArrow(thrifty(_alike(similarity)), "u long, v long"), name)
    discard(sets)
    discard(nodes)
    return links


def nearest_links(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Verified links (u, v) out of pairs (u, v, apart), not one for each pair: each v is tested with the u that seems nearest,
    then each two trees that are still apart with the pair that seems nearest. What stays apart is left to the next pass."""
    first = verified(pairs.groupBy("v").agg(F.min_by("u", F.struct("apart", "u")).alias("u")).select("u", "v"), texts, shingle, similarity, "alike")
    roots = components(first, "trees")
    for e in "uv":
        pairs = pairs.join(roots.select(F.col("node").alias(e), F.col("root").alias(f"r{e}")), e, "left").withColumn(f"r{e}", F.coalesce(f"r{e}", e))
    apart = pairs.where("ru != rv").groupBy(F.least("ru", "rv"), F.greatest("ru", "rv")).agg(F.min(F.struct("apart", "u", "v")).alias("x")).select("x.u", "x.v")
    apart = saved(apart, "apart")
    links = first.union(verified(apart, texts, shingle, similarity, "alike"))
    discard(apart)
    return links


def similar(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8, chunk: int = 2048) -> DataFrame:
    """(doc_id, component_id) of the distinct non-null keys of docs, linked by shared word shingles. Links are exact.

    Texts with the same set of distinct shingles are one class, named by a 128-bit digest of the set. The 64-bit SimHashes of
    these sets go through the vantage-point shards of near_duplicates(); the linked ones that pass the test of their sets join
    classes. Of each group one goes on: SimHashes of 128 bits that share a 16-bit slice give further pairs, in each shard a
    forest of the nearest, tested likewise. Then every class sends its prefix, the rarest of its shingles, at least one of which any partner at the
    similarity has in its own prefix. All pairs that meet, are not joined yet and whose sizes and places allow the similarity are
    compared by bitmaps, which rule out only pairs below the similarity; what is left is tested by the sets. Texts without words are equal to each other. Repeated keys count as one document with the text that
    sorts first.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    repeated = saved(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        rows = rows.join(repeated, "doc_id", "left_anti").union(rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text")))
    prints = saved(rows.mapInArrow(thrifty(_wide(shingle)), "doc_id long, d long, e long, n long, a long, b long, p binary"), "wide")
    classes = saved(prints.groupBy("d", "e", "n").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("a", "b", "p")]), "classes")
    texts = rows.withColumnRenamed("doc_id", "id")

    worded = classes.where("n > 0").select("id", "a", "b")
    pairs = shard_pairs(worded)
    near = sifted(pairs, classes, similarity, "near")
    discard(pairs)
    joined = verified(near.select("u", "v"), texts, shingle, similarity, "alike")
    discard(near)
    inner = components(joined, "shards").where("node <> root").select(F.col("node").alias("id"))
    visits = worded.join(inner, "id", "left_anti").mapInArrow(_slice_visits, "place long, id long, a long, b long")
    pairs = saved(visits.repartition(n, "place").sortWithinPartitions("place").mapInArrow(_slice_pairs(chunk), "u long, v long").distinct(), "nearest")
    near = sifted(pairs, classes, similarity, "near")
    discard(pairs)
    links = joined.union(nearest_links(near, texts, shingle, similarity))
    discard(near)
    roots = components(links, "similar")
    placed = classes.where("n > 0").join(roots, classes.id == roots.node, "left")
    placed = saved(placed.select("id", F.coalesce("root", "id").alias("root"), F.col("n").cast("int").alias("size")), "placed")

    levels = spark.sparkContext.broadcast(shingle_levels(texts, placed.select("id"), shingle))
    firsts = texts.mapInArrow(thrifty(_prefixes(shingle, similarity, levels)), "id long, firsts binary").join(placed, "id")
    postings = firsts.mapInArrow(thrifty(_postings), "token long, id long, root long, size int, place int")
    pairs = postings.repartition(n, "token").sortWithinPartitions("token").mapInArrow(_prefix_pairs(similarity, chunk), "u long, v long").distinct()
    pairs = saved(pairs, "candidates")
    left = sifted(pairs, classes, similarity, "left")
    discard(pairs)
    links = links.union(verified(left.select("u", "v"), texts, shingle, similarity, "alike"))
    discard(left)
    roots = components(links, "similar")
    named = classes.join(roots, classes.id == roots.node, "left").select("d", "e", "n", F.coalesce("root", "id").alias("component_id"))
    return prints.join(named, ["d", "e", "n"]).select("doc_id", "component_id")


def similar_removed(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of similar(): the smallest doc_id. Rows with a null doc_id stay, repeated rows count once."""
    keep = similar(docs, **options).where("doc_id = component_id").select("doc_id")
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)
