"""Manifest, id files and fill-in-middle against brute force and exact round trips, with the hard rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mapweave.llm import idstore, merkle, middle
from tests.llm.fixtures import documents, empty, prose

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, fanout):
    """The root of nodes and, for each, its siblings and its steps up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            s = a - a % fanout
            paths[i].append(("".join(nodes[s:a]), "".join(nodes[a + 1:s + fanout])))
        nodes = [H(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], paths


def manifest_by_hand(rows, fanout):
    """rows: (doc_id, source, lang, n_chars, text); -> sorted (doc_id, leaf, subroot, root, path, folded)."""
    def first(x):
        return (x is not None, x if x is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted(((first(r[0]), H(*map(field, r)), r) for r in rows if r[2] == lang), key=lambda x: x[:2]) for lang in langs]
    trees = [tree([x[1] for x in g], fanout) for g in groups]
    root, above = tree([t[0] for t in trees], fanout)
    out = []
    for g, (subroot, paths), up in zip(groups, trees, above):
        for (_, leaf, r), path in zip(g, paths):
            text = r[4].lower() if r[4] is not None and r[4].isascii() else r[4]
            node = H(*map(field, (*r[:4], text)))
            for left, right in path + up:
                node = H(left, node, right)
            out.append((r[0], leaf, subroot, root, H(*(a + b for a, b in path + up)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "langs", "fanout"), [(1, ["en"], 8), (9, ["en", None], 8), (300, ["en", "de", "é", "zz", None, "", "a.b"], 8), (60, list(range(30)), 3)])
def test_manifest_against_brute_force(spark, n, langs, fanout):
    rng = random.Random(n)
    rows = [(i if rng.random() < 0.9 else rng.choice([None, 3]), rng.choice(["a", None]), None if (x := langs[min(int(rng.expovariate(1)), len(langs) - 1)]) is None else str(x), rng.choice([None, 5]), rng.choice([None, "", "Text Ü", "ABC", prose(rng, 5)])) for i in range(n)]
    rows += [rows[0]] * 3
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, at string, `a.b` string").repartition(3)
    seen = F.when(F.col("text").rlike(r"^[\x00-\x7f]*$"), F.lower("text")).otherwise(F.col("text"))
    got = merkle.manifest(docs, fanout=fanout, seen={"text": seen}).withColumn("path", F.sha2(merkle.siblings(F.col("path")), 256)).select("doc_id", "leaf", "subroot", "root", "path", "folded_root", "verified")
    assert sorted((tuple(r) for r in got.collect()), key=str) == manifest_by_hand(rows, fanout)


def test_manifest_without_rows_and_without_tampering(spark):
    assert merkle.manifest(empty(spark)).count() == 0
    docs = documents(spark)
    got = merkle.manifest(docs, columns=("doc_id", "text", "mark"), group="place").collect()
    assert len(got) == docs.count() and all(r.verified for r in got) and len({r.subroot for r in got}) == 1


def test_places_do_not_depend_on_partitions(spark):
    docs = documents(spark)
    a, b = (sorted(map(str, merkle.manifest(docs.repartition(n)).collect())) for n in (1, 13))
    assert a == b


HARD = ["", None, "a", "don't can''t 'tis x's 'S", "  two  spaces \t\n\n end  ", "a b   c　 d e  f", "<|endoftext|> x<|endoftext|>y <|endof", "été Ärger naïve—dash…", "1234 56,78 9²3 Ⅷ ٣٤", "日本語 テキスト です。 中文", "\U0001F600 \U0001F600‍ é̈ x́y", "\x1c a\x1d \x85b \x00c", "x" * 5000, " " * 300, "\n" * 50 + "z", "a!b?c 'a' \"'s\" ''s", "http://x.y/z?q=1&r=a's"]


def test_unit_ids_equal_the_tokenizer():
    rng = random.Random(5)
    signs = list("ab Z1 9 '\t\n.,-<|>sS") + ["  ", "é", " ", "日", "́", "'s ", "'re", "²", "\x1f", " ", "\U0001F600", "ſ"]
    texts = [t or "" for t in HARD] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    units, tokenizer = idstore.Units(BYTES), Tokenizer.from_file(BYTES)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ids, bounds = units.encode(data, offsets)
    for t, s, e in zip(texts, bounds, bounds[1:]):
        assert ids[s:e].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], repr(t)


@pytest.mark.parametrize("n", [0, 1, 2, 700, 5000])
def test_select_structure(n):
    rng = np.random.default_rng(n)
    ends = np.cumsum(rng.choice([1, 2, 40, 3000], n))
    code = idstore.Boundaries.of(ends, int(ends[-1]) if n else 0)
    assert code.select(np.arange(n)).tolist() == ends.tolist()
    if n == 5000:
        assert len(code.low) + len(code.upper) + 4 * len(code.before) < 8 * n / 3.5


@pytest.mark.parametrize("frame_ids", [1 << 18, 50])
def test_id_files_round_trip(spark, frame_ids):
    docs = documents(spark, rows=list(enumerate(HARD * 3)))
    got = sorted((tuple(r) for r in idstore.stored(docs, BYTES, frame_ids=frame_ids).collect()), key=lambda r: r[1])
    tokenizer, at = Tokenizer.from_file(BYTES), 0
    want = {}
    for i, t in [(r.doc_id, r.text) for r in docs.collect()]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r[0] for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x or 0))
    for key, start, n, crc in got:
        assert start == at and (n, crc) in want[key]
        want[key].remove((n, crc))
        at += n
    assert not any(want.values()) and idstore.stored(empty(spark), BYTES).count() == 0


def test_broken_id_file():
    data = idstore.frame_of(0, 0, [None, 4], np.array([2, 3]), np.arange(5), 2) + b"\n"
    two = list(idstore.frames(memoryview(data * 2)))
    assert [f.keys for f in two] == [[None, 4]] * 2 and two[1].bounds(np.array([1]))[0].tolist() == [2]
    for bad in (data[:-3], b"x" + data, data + b"z"):
        with pytest.raises(ValueError):
            list(idstore.frames(memoryview(bad)))


def middle_by_hand(text, key, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(x, 16) for x in re.findall("." * 8, hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest())]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1, 3, 64, 4096])
def test_cuts_of_the_fenwick_tree(block):
    rng = random.Random(block)
    for _ in range(150):
        text = "".join(rng.choice(["\n", "a", "é", "日本", "\U0001F600", "\r", " ", "xyz "]) for _ in range(rng.randint(0, 200)))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        tree = middle.Blocks(np.frombuffer(text.encode(), np.uint8), block)
        assert tree.lines == len(units) and tree.chars == len(text)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (0, 50)])
def test_fill_in_middle(spark, rate, spm):
    rng = random.Random(8)
    texts = HARD + ["a <P> b", "<M>", "<S", "P>\n<", "\n", "\n\n\n", "no end", "é\n" * 9000, "".join(prose(rng, 6) + "\n" for _ in range(4000))]
    texts += ["\n".join(prose(rng, rng.randint(0, 4)) for _ in range(rng.randint(1, 20))) for _ in range(60)]
    docs = documents(spark, rows=list(enumerate(texts)))
    out = middle.filled(docs, rate=rate, spm=spm)
    out = out.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str((r.doc_id, *middle_by_hand(r.text, r.doc_id, rate, spm), r.text or "")) for r in docs.collect()))
    assert sorted(str(tuple(r)) for r in out) == want
    assert middle.filled(empty(spark)).count() == 0
