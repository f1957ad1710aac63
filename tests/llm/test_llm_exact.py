"""Operators against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from mapweave.llm import common, decontam, embed, packing, simhash, substring
from tests.llm.fixtures import documents, empty, prose, texts


def linked(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(300, 420)] + [(500 + i, 501 + i) for i in range(60)]
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "u long, v long").repartition(5)
    got = dict(common.components(df).collect())
    want = linked(600, edges)
    assert all(got.get(i, i) == want[i] for i in range(600))
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("capacity", [4096, 3])
def test_simhash(spark, capacity):
    docs = documents(spark)
    got = simhash.near_duplicates(docs, capacity=capacity).collect()
    assert len(got) == docs.count()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {i: brute_fingerprint(t) for i, t in rows}
    assert all(int(r.fingerprint, 16) == want[r.doc_id] and re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got)
    ids = sorted(i for i in want if i is not None)
    pairs = [(a, b) for a in ids for b in ids if a < b and (want[a] ^ want[b]).bit_count() <= 2]
    roots = linked(max(ids) + 1, pairs)
    assert all(r.component_id == (None if r.doc_id is None else roots[r.doc_id]) for r in got)
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("capacity", [5000, 40])
def test_links_of_dense_fingerprints(spark, capacity):
    """A ball of fingerprints around one centre overfills shards, so they are split level by level."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(250)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = dict(common.components(simhash.linked_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, capacity)).collect())
    want = linked(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2])
    assert [got.get(f, f) for f in fps] == [fps[i] for i in want]


def shingles(t):
    w = re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", (t or "").lower()).split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_similar_documents(spark):
    docs = documents(spark)
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    got = dict(simhash.similar(docs).collect())
    ids = sorted(rows)
    sets = {i: shingles(rows[i]) for i in ids}
    pairs = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = linked(max(ids) + 1, pairs)
    assert set(got) == set(ids)
    assert all(got[i] >= want[i] and want[got[i]] == want[i] for i in ids)  # only true links
    assert sum(got[i] == want[i] for i in ids) >= 0.95 * len(ids)
    kept = simhash.similar_removed(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in ids if got[i] == i)
    assert kept.where("doc_id is null").count() == 1
    assert simhash.similar_removed(empty(spark)).count() == 0


def similar_roots(spark, rows):
    """Components of similar() and those of brute force, over rows of texts."""
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    sets = [shingles(t) for t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = dict(simhash.similar(docs).collect())
    return [got[i] for i in range(len(rows))], linked(len(rows), pairs)


def test_similar_texts_go_through_the_vantage_point_shards(spark, monkeypatch):
    """The shards join the same groups as a comparison of all fingerprints, and the pipeline's stage asks them."""
    rng = random.Random(12)
    texts = []
    for _ in range(8):
        words = prose(rng, 400).split()
        texts += [" ".join(words)] + [" ".join(words[:k] + ["changed"] + words[k + 1:]) for k in range(3, 390, 60)]
    prints = [simhash.wide_fingerprint(s)[0] for s in simhash.shingle_sets(pa.array(texts), 5)]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if bin((prints[i] ^ prints[j]) & ((1 << 64) - 1)).count("1") <= 2}
    got = simhash.shard_pairs(spark.createDataFrame(list(enumerate(prints)), "id long, a long")).collect()
    assert near and linked(len(texts), near) == linked(len(texts), [(r.u, r.v) for r in got])
    monkeypatch.setattr(simhash, "shard_pairs", lambda classes: (_ for _ in ()).throw(KeyError("shards")))
    with pytest.raises(KeyError, match="shards"):
        simhash.similar_removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_similar_texts_of_one_template(spark):
    """Most pairs share about 0.76, so a real pair often has nearer neighbours that are no copies."""
    rng = random.Random(12)
    passage, rows = prose(rng, 175), []
    for _ in range(60):
        own = prose(rng, 25).split()
        rows += [" ".join([passage, *own]), " ".join([passage, *own[:8], prose(rng, 17)])]
    got, want = similar_roots(spark, rows)
    assert len(set(want)) == 60 and got == want


def test_similar_texts_with_much_filler(spark):
    """One repeated word makes up most of each text; the rest differs."""
    rng = random.Random(13)
    got, want = similar_roots(spark, ["na " * 400 + prose(rng, 60) for _ in range(20)])
    assert want == list(range(20)) and got == want


def test_bitmaps_rule_out_no_similar_sets():
    rng = np.random.default_rng(15)
    for n in (1, 3, 31, 32, 33, 200, 5000):
        for other in (0, 1, n // 9, n // 3, n):
            for more in (0, n // 5, 2 * n):
                x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                y = np.unique(np.concatenate([x[other:], rng.integers(0, 2**63, other + more, dtype=np.uint64)]))
                apart = len(np.setxor1d(x, y))
                found = simhash.least_apart(simhash.parity(x), simhash.parity(y))
                assert found <= apart and found == simhash.least_apart(simhash.parity(y), simhash.parity(x))
                assert (apart - found) % 2 == 0 and (apart > 1 or found == apart)
                common = len(np.intersect1d(x, y))
                if common >= 0.8 * (len(x) + len(y) - common):
                    assert found <= len(x) + len(y) - 2 * simhash.least_common(len(x), len(y), 0.8)
                if other == n >= 200 and not more:  # sets that share nothing
                    assert found > len(x) + len(y) - 2 * simhash.least_common(len(x), len(y), 0.8)


def test_among_keeps_all_asked_rows(spark):
    texts = spark.range(3000).selectExpr("id", "string(id) text")
    nodes = spark.range(0, 3000, 7)
    for bits in (6, 10, 23):
        got = simhash.among(texts, nodes, bits).collect()
        assert sorted((r.id, r.text) for r in got) == [(i, str(i)) for i in range(0, 3000, 7)]
    assert simhash.among(texts, nodes.where("id < 0")).count() == 0


def test_similar_texts_of_repeated_passages(spark):
    """Nearly equal sets of shingles, one text repeats a passage; and many lone pairs just above the similarity."""
    rng, rows = random.Random(14), []
    for _ in range(10):
        t = prose(rng, 100)
        rows += [t, t + " " + " ".join(t.split()[-10:] * 100)]
    for _ in range(150):
        t = prose(rng, 100)
        rows += [t, " ".join(t.split()[:90] + prose(rng, 10).split())]
    got, want = similar_roots(spark, rows)
    assert len(set(want)) == 160 and got == want


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 16))
    x[40:60] = x[0] + rng.normal(scale=0.02, size=(20, 16))
    x[60:70] = x[1]
    x[70:85] = x[2] + rng.normal(scale=0.22, size=(15, 16)) * np.linalg.norm(x[2]) / 4
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 16), (202, [None] * 16), (203, [float("nan")] * 16), (204, [float("inf")] + [1.0] * 15), (205, []), (206, [1.0, 2.0]), (None, x[0].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame([(i, e, 1, "k") for i, e in rows], "vec_id long, embedding array<double>, label int, root string").repartition(3)
    got = embed.near_duplicates(df, block=8).collect()
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    pairs = [(i, j) for i in range(120) for j in range(i) if near[i, j]]
    root = linked(120, pairs)
    for r in got:
        if r.vec_id is not None and r.vec_id < 120:
            want = int(near[r.vec_id].sum()) - 1 + (r.vec_id == 3)
            assert (r.n_links, r.component_id, r.kept) == (want, root[r.vec_id], root[r.vec_id] == r.vec_id)
        else:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept == (None if r.vec_id is None else True)
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_windows_go_over_the_borders_of_partitions(spark):
    """150 rows in 8 partitions, fewer than a window in each: one pass compares each row with the next 24 in order."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {tuple(sorted(r)) for r in embed.passes(df, 0.8, 1, 24).collect()}
    bits = (x @ np.random.default_rng(1000).normal(size=(4, embed.BITS)) > 0).astype(np.int64)
    key = bits @ (1 << np.arange(embed.BITS - 1, -1, -1, dtype=np.int64))
    order = np.lexsort((np.arange(150), key)).tolist()
    want = {tuple(sorted((a, b))) for n, a in enumerate(order) for b in order[n + 1:n + 25] if x[a] @ x[b] >= 0.8}
    assert want <= got and all(x[a] @ x[b] >= 0.8 for a, b in got)
    assert [embed.passes_for(n, 0.95, 24) for n in (1_000, 10**6)] == [12, 19]


def test_packing(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = documents(spark, rows=[*enumerate(texts()), (900, "don't “quote”, it's 12,5% <|endoftext|> ΟΔΥΣΣΕΥΣ é")])
    got = packing.packed(docs, path, 256).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    rows = docs.select("doc_id", "text").collect()
    repeated = Counter(r.doc_id for r in rows)
    for i, t in {r.doc_id: r.text for r in rows}.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want = [(n, s, min(256, len(ids) - s), zlib.crc32(ids[s:s + 256].tobytes())) for n, s in enumerate(range(0, len(ids), 256))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == sorted(want * repeated[i])
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 256
    least = -(-sum(r.length for r in got) // 256)
    assert least <= len(bins) <= least + 1 + sum(r.length > 128 for r in got) // 4
    assert packing.packed(empty(spark), path).count() == 0


def test_local_search_empties_bins():
    start = Counter({(6, 3): 4, (5, 2): 4, (4, 2, 1): 2, (3,): 2})
    end = packing.local_search(start, 10)
    pieces = Counter()
    for p, n in start.items():
        for x in p:
            pieces[x] += n
    after = Counter()
    for p, n in end.items():
        assert sum(p) <= 10 and n > 0
        for x in p:
            after[x] += n
    assert after == pieces and sum(end.values()) < sum(start.values())


def test_local_search_ends_where_no_step_gains():
    rng = random.Random(1)
    start = Counter()
    for _ in range(600):
        p = []
        while (x := rng.randint(30, 400)) + sum(p) <= 1000:
            p.append(x)
        start[tuple(sorted(p, reverse=True))] += 1
    end = packing.local_search(start, 1000)
    least = -(-sum(sum(p) * n for p, n in start.items()) // 1000)
    open_ = sorted((p for p in end if sum(p) < 1000), key=lambda p: (sum(p), p))
    assert sum(end.values()) == least or all(packing.best_step(p, open_, end, 1000) is None for p in open_)


def brute_repeats(rows, span):
    """rows in corpus order -> kept bytes and number of removed runs of each."""
    seen, out = set(), []
    for t in rows:
        data, cut = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(data) - span + 1):
            s = data[i:i + span]
            if s in seen:
                cut[i:i + span] = b"\1" * span
            seen.add(s)
        out.append((len(data), sum(cut), len(re.findall(b"\1+", bytes(cut))), hashlib.sha256(bytes(b for b, c in zip(data, cut) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("parts", [1, 6])
def test_repeated_passages(spark, parts):
    rows = [(i, t) for i, t in enumerate(texts(7))]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, number string, start int").repartition(parts)
    got = {r.doc_id: tuple(r)[1:] for r in substring.deduplicated(docs).collect()}
    ordered = sorted(rows)
    want = brute_repeats([t for _, t in ordered], 100)
    assert got == {i: w for (i, _), w in zip(ordered, want)}
    assert substring.deduplicated(docs.limit(0)).count() == 0


def test_repeats_of_repeated_and_null_keys(spark):
    t = prose(random.Random(9), 60)
    docs = spark.createDataFrame([(5, t), (5, t), (None, t), (1, None)], "doc_id long, text string")
    got = substring.deduplicated(docs, texts=True).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, len(t.encode()), len(t.encode())]
    assert next(r for r in got if r.doc_id is None).n_removed == 0
    assert b"".join(bytes(r.kept) for r in got) == t.encode()


def brute_contamination(docs, bench):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in docs:
        w = words(t)
        hit, items = set(), set()
        for item, b in bench:
            x = words(b)
            n = min(13, len(x))
            wanted = {tuple(x[j:j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j:j + n]) in wanted:
                    hit |= set(range(j, j + n))
                    items |= {item} - {None}
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 23, 500])
def test_decontamination(spark, block_bytes):
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 13, 14, 12, 5, 1, 2])] + [(20, None), (21, "!!"), (None, prose(rng, 30)), (0, prose(rng, 20))]
    rows = list(enumerate(texts(3)))
    for n, (_, t) in enumerate(items):
        w = (t or "").split()
        rows += [(300 + n, prose(rng, 20) + " " + (t or "").upper() + ", " + prose(rng, 5)), (400 + n, prose(rng, 9) + " " + " ".join(w[2:16])), (500 + n, " ".join(w[:12]) + " -- " + prose(rng, 600))]
    docs = documents(spark, rows=rows)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in decontam.contamination(docs, bench, block_bytes=block_bytes).collect()), key=str)
    assert got == brute_contamination([(r.doc_id, r.text) for r in docs.collect()], items)
    clean = decontam.decontaminated(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in got)
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert decontam.contamination(empty(spark), bench).count() == 0


def test_winnowing_guarantee():
    """Every run of 13 shared words holds a shared fingerprint."""
    rng = random.Random(8)
    shared = prose(rng, 13)
    for _ in range(50):
        prints = []
        for _ in range(2):
            w = decontam.Words(*common.raw(decontam.pa.array([f"{prose(rng, 30)} {shared} {prose(rng, 30)}"])))
            prints.append(set(w.hashes(w.fingerprints(5, 13), 5).tolist()))
        assert prints[0] & prints[1]


def test_hash_of_equal_stretches():
    data = np.frombuffer(b"abcabcabc", np.uint8)
    r = common.Rolling(1)
    h = r.of(r.prefix(data), np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert h[0] == h[1] != h[2]


def test_words_of_all_letters_before_punctuation():
    """Every letter outside the large blocks, and each tenth of those, before every punctuation mark, has the tokenizer's ids."""
    import sys
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    letters = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L" and (c < 0x3400 or 0xA000 <= c < 0xAC00 or c > 0xD7A3 and (c < 0x17000 or c > 0x18D08) or c % 10 == 0)]
    assert len(letters) > 27_000
    marks = packing.PUNCTUATION
    words = [f"{x}{marks[i % len(marks)]}" for i, x in enumerate(letters)] + [f"a{x}{m}" for x in "\u0130\u0958\u095f\u09dc\u09dd\u09df\u00e9\u1e9b\ufb1d" for m in marks] + [f"{x}{x}.!" for x in letters[::7]]
    ids, offsets = packing.Tokens(path).encode(pa.array(words))
    tokenizer = Tokenizer.from_file(path)
    bad = [w for w, e, s, z in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), offsets, offsets[1:]) if ids[s:z].tolist() != [*e.ids, 0]]
    assert not bad, bad[:20]


@pytest.mark.parametrize("block_bytes", [1 << 23, 300])
def test_contamination_with_named_items_and_clashing_columns(spark, block_bytes):
    """Ids of any type in one block and in many; columns with the names that the code itself adds are kept."""
    rng = random.Random(6)
    items = [(f"item-{i}", prose(rng, 40)) for i in range(8)]
    rows = [(i, prose(rng, 20) + " " + items[i][1] if i < 5 else prose(rng, 30), "x", "y", "z") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text string, __row string, __words string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, bench, block_bytes=block_bytes).collect()}
    assert all(got[i].n_items == 1 and got[i].contaminated and got[i].items_sha256 == hashlib.sha256(f"item-{i}".encode()).hexdigest() for i in range(5))
    kept = decontam.decontaminated(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows[5:])


def test_known_words_are_kept_in_arrays():
    """Ids do not depend on what a task has seen, nor on when it begins anew, and a known word takes tens of bytes, not hundreds."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=9)) + rng.choice(["", ".", ","]) for _ in range(20_000)]
    path = public_tokenizers.path("word_bpe_49k.json")
    one = packing.Tokens(path)
    texts = [pa.array([" ".join(words[a:a + 2000])]) for a in range(0, len(words), 2000)]
    want = [one.encode(t)[0].tolist() for t in texts]
    assert [one.encode(t)[0].tolist() for t in texts] == want
    assert [packing.Tokens(path).encode(t)[0].tolist() for t in texts] == want
    assert one.words.nbytes + one.pieces.nbytes + one.codes.nbytes < 60 * len(words)
