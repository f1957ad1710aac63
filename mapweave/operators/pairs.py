"""Kernels of the search: a chunk of sources against blocks of targets, one after the other, in bounded memory.

A block is cut into strips of similar targets. A source skips a strip whose upper bound (angle bound of the vectors, tokens that
the strip holds) does not reach what the source has found already. For the rest all signals are computed roughly, in single
precision; only pairs that can still matter by that are scored exactly, one by one, as blocks.signals would.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mapweave.operators import blocks as B
from mapweave.params import STRUCTURED_WEIGHTS, Params

#: Targets of a strip, vectors around which a block is cut, and by how much rough scores may be off.
STRIP, PIVOTS, SLACK = 512, 16, 2e-5
#: Pairs whose vectors are multiplied at once, and comparisons of ranks made at once.
AT_ONCE, COMPARED = 1 << 14, 1 << 20
WEIGHTS = list(STRUCTURED_WEIGHTS.values())
RANKED = ["semantic", "keyword", "structured", "action_object"]


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def one(column) -> pa.Array:
    """A column as one array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells of a table that hold."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class Lists:
    """Lists of strings, one for each row: values and where the rows begin."""

    def __init__(self, values: pa.Array, sizes: np.ndarray):
        self.values, self.sizes = values, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.rows = np.repeat(np.arange(len(sizes)), sizes)

    @classmethod
    def of(cls, column) -> Lists:
        column = one(column)
        return cls(column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))

    @classmethod
    def scalars(cls, column) -> Lists:
        """A list of one for each value that is neither null nor empty."""
        column = one(column)
        some = pc.fill_null(pc.not_equal(column, ""), False)
        return cls(column.filter(some), some.to_numpy(zero_copy_only=False).astype(np.int64))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of rows, place of the value) of all values of these rows."""
        n = self.sizes[rows]
        which = np.repeat(np.arange(len(rows)), n)
        return which, np.repeat(self.starts[rows] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())


class Postings:
    """Lists of the sources by value: which rows hold it."""

    def __init__(self, lists: Lists):
        self.sizes, self.n = lists.sizes, len(lists.sizes)
        found = pc.dictionary_encode(lists.values)
        self.known = found.dictionary
        codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.codes, self.code_rows = codes, lists.rows
        self.count = np.bincount(codes, minlength=len(self.known))
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        self.rows = lists.rows[np.argsort(codes, kind="stable")]
        self.pairs = np.sort(lists.rows * max(1, len(self.known)) + codes)

    def coded(self, lists: Lists) -> np.ndarray:
        """The codes of a target's values, -1 where no source has it."""
        if not len(self.known) or not len(lists.values):
            return np.full(len(lists.values), -1)
        return pc.fill_null(pc.index_in(lists.values, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def hits(self, rows: np.ndarray, codes: np.ndarray, live: np.ndarray, place: np.ndarray, width: int):
        """Shared values of the live sources with targets that hold codes, as a table of counts, or as (cells, counts) where few
        cells have any. place: the place of a source among the live ones, or -1."""
        rows, codes = rows[codes >= 0], codes[codes >= 0]
        n = self.count[codes]
        if not n.sum():
            return None
        size = len(live) * width
        here = np.bincount(codes, minlength=len(self.known))
        common = np.nonzero(here * self.count >= max(16, size // 64))[0]
        dense = None
        if len(common):
            number = np.full(len(self.known), -1)
            number[common] = np.arange(len(common))
            left = np.zeros((len(live), len(common)), np.float32)
            for c in common.tolist():
                at = place[self.rows[self.start[c]:self.start[c + 1]]]
                left[at[at >= 0], number[c]] = 1
            often = number[codes] >= 0
            right = np.zeros((width, len(common)), np.float32)
            right[rows[often], number[codes[often]]] = 1
            dense = left @ right.T
            rows, codes, n = rows[~often], codes[~often], n[~often]
        at = np.repeat(self.start[codes] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        i = place[self.rows[at]]
        met = (i * width + np.repeat(rows, n))[i >= 0]
        if dense is None and len(met) < size // 16:
            return np.unique(met, return_counts=True)
        dense = np.zeros((len(live), width), np.float32) if dense is None else dense
        if len(met):
            dense += np.bincount(met, minlength=size).reshape(dense.shape)
        return dense

    def shared(self, i: np.ndarray, lists: Lists, codes: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values the sources i share with the targets j, pair by pair."""
        which, at = lists.take(j)
        wanted = i[which] * max(1, len(self.known)) + codes[at]
        found = np.zeros(len(wanted), bool)
        if len(self.pairs) and len(wanted):
            near = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
            found = (self.pairs[near] == wanted) & (codes[at] >= 0)
        return np.bincount(which[found], minlength=len(i)).astype(float)

    def share(self, present: np.ndarray) -> np.ndarray:
        """The share of each source's values that are present."""
        return np.bincount(self.code_rows, weights=present[self.codes], minlength=self.n) / np.maximum(self.sizes, 1)


def vectors(column) -> np.ndarray:
    """Unit rows of an array of arrays."""
    column = one(column)
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if len(n) and n.min() == n.max() > 0 and not column.flatten().null_count:
        m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(n), -1)
        norm = np.sqrt((m * m).sum(axis=1))
        return m / np.where(norm == 0, 1.0, norm)[:, None]
    return B.unit_rows(column.to_pylist())


def texts(column) -> np.ndarray:
    return one(column).to_numpy(zero_copy_only=False)


class Side:
    """The columns of a chunk or of a block that the signals read."""

    def __init__(self, table: pa.Table, p: Params, vec: np.ndarray | None = None):
        self.table, self.n = table, len(table)
        self.vec = vec if vec is not None else vectors(table["vec"]) if p.use_semantic else np.zeros((self.n, 1))
        self.vec32 = self.vec.astype(np.float32)
        self.lists = {}
        if p.use_structured:
            sets = one(table["sets"])
            inner = Lists.of(sets.flatten())
            width = len(WEIGHTS)
            if len(inner.sizes) != self.n * width:
                raise ValueError(f"sets must hold {width} lists")
            field = inner.rows % width
            for f in range(width):
                self.lists[f] = Lists(inner.values.filter(pa.array(field == f)), inner.sizes[f::width])
            self.lists["ao"] = Lists.of(table["ao"])
            self.family = texts(table["control_family"])
        self.primary = texts(table["primary_key"])
        self.lists["primary"], self.lists["secondary"] = Lists.scalars(table["primary_key"]), Lists.of(table["secondary_keys"])
        self.confidence, self.low = (one(table[c]).to_numpy(zero_copy_only=False) for c in ("confidence", "low_confidence"))
        self.low = self.low.astype(bool)
        self.frame = table.to_pandas() if p.use_keyword else None


class Chunk(Side):
    """Sources."""

    def __init__(self, table: pa.Table, p: Params):
        super().__init__(table, p)
        self.lists["keys"] = Lists.of(table["keys"])
        if p.affinity_enabled:
            self.lists["affine"] = Lists.of(table["affine_families"])
        self.postings = {name: Postings(x) for name, x in self.lists.items()}


class Block(Side):
    """Targets, one row for each different content, similar ones beside each other; rows (profile, order_no, atomic_id) are all targets."""

    def __init__(self, profiles: pa.Table, rows: pa.Table, p: Params):
        of, vec = one(rows["profile"]).to_numpy(), None
        if p.use_semantic and len(profiles) > STRIP:
            vec = vectors(profiles["vec"])
            order = np.argsort((vec @ vec[:: len(vec) // PIVOTS][:PIVOTS].T).argmax(axis=1), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            of, vec, profiles = place[of], vec[order], profiles.take(pa.array(order)).combine_chunks()
        super().__init__(profiles, p, vec)
        self.by = np.argsort(of, kind="stable")  # rows of a profile stay in their order
        self.count = np.bincount(of, minlength=self.n)
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        self.order = one(rows["order_no"].cast(pa.float64())).to_numpy(zero_copy_only=False)
        self.of, self.rows, self.all = of, rows, None
        self.target = texts(profiles["profile"])
        self.lists["keys"] = Lists.of(self.table["keys"])
        if p.affinity_enabled:
            self.lists["family"] = Lists.scalars(self.table["id_family"])
        self.strips = [slice(a, min(a + STRIP, self.n)) for a in range(0, self.n, STRIP)]
        self.centre, self.radius = [], []
        for at in self.strips:
            v = self.vec[at][self.vec[at].any(axis=1)]
            c = v.sum(axis=0) / max(np.sqrt((v.sum(axis=0) ** 2).sum()), 1e-12)
            self.centre.append(c)
            self.radius.append((v @ c).min() if len(v) and c.any() else -1.0)

    def members(self, u: int, k: int) -> list[tuple]:
        if self.all is None:
            at = pa.array(self.by)
            self.all = list(zip(self.rows["order_no"].take(at).to_pylist(), self.rows["atomic_id"].take(at).to_pylist()))
        return self.all[self.start[u]:self.start[u] + min(k, self.count[u])]


#: Lists of the targets that are looked up among the lists of the sources.
LOOKED_UP = [("primary", "primary"), ("primary", "secondary"), ("secondary", "primary"), ("secondary", "secondary"), ("keys", "keys"),
             ("keys", "primary"), ("keys", "secondary"), ("affine", "family")]


class Met:
    """A chunk and a block."""

    def __init__(self, s: Chunk, t: Block, p: Params):
        self.s, self.t, self.p = s, t, p
        names = ([(f, f) for f in [*range(len(WEIGHTS)), "ao"]] if p.use_structured else []) + [x for x in LOOKED_UP if x[0] in s.lists and x[1] in t.lists]
        self.codes = {x: s.postings[x[0]].coded(t.lists[x[1]]) for x in names}
        if p.use_semantic and s.vec.shape[1] != t.vec.shape[1]:
            if s.vec.any() and t.vec.any():
                raise ValueError("embeddings of different length")
            self.same_width = False
        else:
            self.same_width = p.use_semantic

    def bound(self) -> np.ndarray:
        """(sources, strips): no combined score of a strip is above it."""
        s, t, p = self.s, self.t, self.p
        out = np.zeros((s.n, len(t.strips)))
        if self.same_width:
            radius = np.arccos(np.clip(np.array(t.radius), -1, 1))
            angle = np.arccos(np.clip(s.vec @ np.array(t.centre).T, -1, 1)) - radius[None, :]
            out += p.weight_semantic * np.maximum(0.0, np.where(s.vec.any(axis=1)[:, None], np.cos(np.maximum(0.0, angle - 1e-6)), 0.0))
        out += p.weight_keyword if p.use_keyword else 0.0
        if p.use_structured:
            used = [f for f in range(len(WEIGHTS)) if s.lists[f].sizes.any()]
            weight = sum((WEIGHTS[f] * (s.lists[f].sizes > 0) for f in used), np.zeros(s.n))
            for k, at in enumerate(t.strips):
                share = {}
                for f in [*used, "ao"]:
                    lists, codes, known = t.lists[f], self.codes[f, f], s.postings[f]
                    here = codes[lists.starts[at.start]:lists.starts[at.stop]]
                    present = np.zeros(max(1, len(known.known)))
                    present[here[here >= 0]] = 1
                    share[f] = known.share(present)
                total = sum((WEIGHTS[f] * share[f] for f in used), np.zeros(s.n))
                action = np.where(s.lists["ao"].sizes > 0, np.minimum(1.0, share["ao"] + 0.25), 0.20)
                out[:, k] += (p.weight_structured * total / np.where(weight > 0, weight, 1) + p.weight_action_object * action
                              + p.weight_control_type * share.get(B.CONTROL_TYPE, 0.0))
        return np.minimum(1.0, out / p.weight_sum + p.weight_category_prior) + SLACK

    # ---- rough signals of live sources and the targets of a strip ------------------------------------
    def among(self, live: np.ndarray, at: slice) -> None:
        self.live, self.at, self.width = live, at, at.stop - at.start
        self.place = np.full(self.s.n, -1)
        self.place[live] = np.arange(len(live))
        self.shape = (len(live), self.width)

    def hits(self, mine, theirs):
        lists = self.t.lists[theirs]
        a, b = lists.starts[self.at.start], lists.starts[self.at.stop]
        return self.s.postings[mine].hits(lists.rows[a:b] - self.at.start, self.codes[mine, theirs][a:b], self.live, self.place, self.width)

    def any_hit(self, mine, theirs) -> np.ndarray | None:
        found = self.hits(mine, theirs)
        if isinstance(found, tuple):
            out = np.zeros(self.shape, bool)
            out.ravel()[found[0]] = True
            return out
        return None if found is None else found > 0

    def add_jaccard(self, out: np.ndarray, name, weight: float) -> bool:
        found = self.hits(name, name)
        if found is None:
            return False
        a, b = self.s.lists[name].sizes[self.live].astype(np.float32), self.t.lists[name].sizes[self.at].astype(np.float32)
        if isinstance(found, tuple):
            at, n = found
            out.ravel()[at] += (weight * n / (a[at // self.width] + b[at % self.width] - n)).astype(np.float32)
        else:
            union = np.add.outer(a, b)
            union -= found
            np.maximum(union, 1, out=union)
            found /= union
            out += found if weight == 1 else np.float32(weight) * found
        return True

    def semantic(self) -> np.ndarray:
        """Not cut at 0."""
        if not self.same_width:
            return np.zeros(self.shape, np.float32)
        return self.s.vec32[self.live] @ self.t.vec32[self.at].T

    def keyword(self) -> np.ndarray:
        """The exact signal: all pairs of a strip at once."""
        s, t = self.s.frame.iloc[self.live], self.t.frame.iloc[self.at]
        return np.round(B.keyword(s, t) / s["keyword_best"].to_numpy()[:, None], B.DIGITS)

    def structured(self) -> np.ndarray | None:
        """None where no pair shares a value."""
        s, t, w = self.s, self.t, np.array(WEIGHTS, np.float32)
        total = np.zeros(self.shape, np.float32)
        if not [f for f in range(len(w)) if self.add_jaccard(total, f, WEIGHTS[f])]:
            return None
        a = np.stack([s.lists[f].sizes[self.live] > 0 for f in range(len(w))], axis=1).astype(np.float32)
        b = np.stack([t.lists[f].sizes[self.at] > 0 for f in range(len(w))], axis=1).astype(np.float32)
        weight = np.add.outer(a @ w, b @ w)
        weight -= (a * w) @ b.T
        np.maximum(weight, np.float32(1e-6), out=weight)
        total /= weight
        return total

    def families(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Equal families, and different ones where both are known."""
        fs, ft = self.s.family[self.live], self.t.family[self.at]
        if not (fs != "").any() or not (ft != "").any():
            return None
        known, codes = {}, []
        for side in (fs, ft):
            codes.append(np.array([0 if x == "" else known.setdefault(x, len(known) + 1) for x in side.tolist()], np.int32))
        same = codes[0][:, None] == codes[1][None, :]
        both = (codes[0] > 0)[:, None] & (codes[1] > 0)[None, :]
        return same & both, both & ~same

    def action(self) -> np.ndarray | None:
        """None where no pair shares a value or a family."""
        out = np.zeros(self.shape, np.float32)
        some, shift = self.add_jaccard(out, "ao", 1), self.families()
        if shift is None:
            return out if some else None
        same, differ = shift
        out += np.float32(0.25) * same
        out -= np.float32(0.25) * differ
        np.clip(out, 0, 1, out=out)
        a, b = self.s.lists["ao"].sizes[self.live] == 0, self.t.lists["ao"].sizes[self.at] == 0
        return np.where(a[:, None] | b[None, :], np.float32(0.20) * same, out) if a.any() or b.any() else out

    def add_prior(self, out: np.ndarray, weight: float) -> None:
        found = [(0.45, self.hits("secondary", "secondary")), (0.70, self.hits("primary", "secondary")), (0.70, self.hits("secondary", "primary")), (1.0, self.hits("primary", "primary"))]
        found = [(value, f) for value, f in found if f is not None]
        if not found:
            return
        raw = np.zeros(self.shape, np.float32)
        for value, f in found:
            if isinstance(f, tuple):
                raw.ravel()[f[0]] = value
            else:
                raw[f > 0] = value
        s, t = self.s, self.t
        mine, theirs = s.confidence[self.live].astype(np.float32), t.confidence[self.at].astype(np.float32)
        i, j = cells(raw)
        if len(i) < raw.size // 4:
            factor, low = np.minimum(mine[i], theirs[j]), s.low[self.live][i] | t.low[self.at][j]
        else:
            factor, low = np.minimum.outer(mine, theirs), s.low[self.live][:, None] | t.low[self.at][None, :]
            i = j = slice(None)
        np.maximum(factor, np.float32(0.15), out=factor)
        np.minimum(factor, np.float32(0.30), out=factor, where=low)
        out[i, j] += np.float32(weight) * raw[i, j] * factor

    def combined(self) -> np.ndarray:
        p = self.p
        v = np.zeros(self.shape, np.float32)
        if p.use_semantic:
            v = np.maximum(self.semantic(), 0)
            v *= np.float32(p.weight_semantic)
        if p.use_keyword:
            v += (p.weight_keyword * self.keyword()).astype(np.float32)
        if p.use_structured:
            for weight, signal in ((p.weight_structured, self.structured()), (p.weight_action_object, self.action())):
                if signal is not None:
                    signal *= np.float32(weight)
                    v += signal
            self.add_jaccard(v, B.CONTROL_TYPE, p.weight_control_type)
        if p.weight_sum != 1:
            v /= np.float32(p.weight_sum)
        if p.weight_category_prior:
            self.add_prior(v, p.weight_category_prior)
        return np.minimum(v, 1, out=v)

    def affine(self) -> np.ndarray:
        out = np.zeros(self.shape, bool)
        for x in (("keys", "primary"), ("keys", "secondary"), ("affine", "family")):
            found = self.any_hit(*x)
            if found is not None:
                out |= found
        return out

    def pool(self) -> np.ndarray:
        """Pairs that share a key; a source without keys keeps all."""
        found = self.any_hit("keys", "keys")
        out = np.zeros(self.shape, bool) if found is None else found
        out[self.s.lists["keys"].sizes[self.live] == 0] = True
        return out

    # ---- exact signals of pairs ----------------------------------------------------------------------
    def shared(self, mine, theirs, i, j) -> np.ndarray:
        return self.s.postings[mine].shared(i, self.t.lists[theirs], self.codes[mine, theirs], j)

    def exact(self, i: np.ndarray, j: np.ndarray, names=("semantic", "keyword", "structured", "action_object", "control_type", "category_prior")) -> dict[str, np.ndarray]:
        """Signals of the pairs of sources i and targets j, as blocks.signals gives them."""
        s, t, p = self.s, self.t, self.p
        zero = np.zeros(len(i))
        out = {x: zero for x in ("semantic", "keyword", "structured", "action_object", "control_type", "category_prior")}
        if self.same_width and "semantic" in names:
            dots = [(s.vec[i[a:a + AT_ONCE]] * t.vec[j[a:a + AT_ONCE]]).sum(axis=1) for a in range(0, len(i), AT_ONCE)]
            out["semantic"] = np.round(np.maximum(0.0, np.concatenate([zero[:0], *dots])), B.DIGITS)
        if p.use_keyword and "keyword" in names:
            out["keyword"] = self.keyword()[self.place[i], j - self.at.start]
        if p.use_structured and "structured" in names:
            total, weight = zero.copy(), zero.copy()
            for f, w in enumerate(WEIGHTS):
                a, b = s.lists[f].sizes[i], t.lists[f].sizes[j]
                if not a.any() and not b.any():
                    continue
                inter = self.shared(f, f, i, j)
                union = a + b - inter
                jac = np.divide(inter, union, out=np.zeros(len(i)), where=union > 0)
                total += np.where(union > 0, w * jac, 0.0)
                weight += np.where(union > 0, w, 0.0)
                if f == B.CONTROL_TYPE:
                    out["control_type"] = np.round(jac, B.DIGITS)
            out["structured"] = np.round(np.divide(total, weight, out=np.zeros(len(i)), where=weight > 0), B.DIGITS)
        if p.use_structured and "action_object" in names:
            a, b = s.lists["ao"].sizes[i], t.lists["ao"].sizes[j]
            inter = self.shared("ao", "ao", i, j)
            union = a + b - inter
            jac = np.divide(inter, union, out=np.zeros(len(i)), where=union > 0)
            fs, ft = s.family[i], t.family[j]
            same, differ = (fs != "") & (fs == ft), (fs != "") & (ft != "") & (fs != ft)
            shifted = np.clip(jac + np.where(same, 0.25, 0.0) - np.where(differ, 0.25, 0.0), 0.0, 1.0)
            out["action_object"] = np.round(np.where((a == 0) | (b == 0), np.where(same, 0.20, 0.0), shifted), B.DIGITS)
        if "category_prior" in names:
            raw = np.where(self.shared("secondary", "secondary", i, j) > 0, 0.45, 0.0)
            raw = np.where(self.shared("primary", "secondary", i, j) + self.shared("secondary", "primary", i, j) > 0, 0.70, raw)
            raw = np.where((s.primary[i] != "") & (s.primary[i] == t.primary[j]), 1.0, raw)
            factor = np.maximum(0.15, np.minimum(s.confidence[i], t.confidence[j]))
            low = s.low[i] | t.low[j]
            out["category_prior"] = np.round(np.clip(raw * np.where(low, np.minimum(factor, 0.30), factor), 0, 1), B.DIGITS)
            base = (p.weight_semantic * out["semantic"] + p.weight_keyword * out["keyword"]
                    + p.weight_structured * out["structured"] + p.weight_action_object * out["action_object"]
                    + p.weight_control_type * out["control_type"]) / p.weight_sum
            out["combined"] = np.round(np.minimum(1.0, base + p.weight_category_prior * out["category_prior"]), B.SCORE_DIGITS)
        return out


def in_order(member: tuple) -> tuple:
    """Nulls first, as Spark sorts."""
    return tuple((x is not None, x) if x is not None else (False,) for x in member)


class Best:
    """What the sources of a chunk have found so far: the k best targets, ties of the k-th included, and with affinity the k best affine ones."""

    def __init__(self, table: pa.Table, p: Params, k: int):
        self.s, self.p, self.k = Chunk(table, p), p, k
        self.profile, self.key = texts(table["profile"]), table["_key"][0].as_py() if "_key" in table.column_names else None
        self.found = [{} for _ in range(self.s.n)]
        self.heaps = {False: [[] for _ in range(self.s.n)], True: [[] for _ in range(self.s.n)]}
        self.reached = {x: np.full(self.s.n, float(p.min_combined)) for x in (False, True)}
        self.limit = np.full(self.s.n, 4 * k + 16)

    def meet(self, t: Block) -> None:
        met, p = Met(self.s, t, self.p), self.p
        bound = met.bound()
        for n, at in enumerate(t.strips):
            least = np.minimum(self.reached[False], self.reached[True]) if p.affinity_enabled else self.reached[False]
            live = np.nonzero(bound[:, n] >= least)[0]
            if not len(live):
                continue
            met.among(live, at)
            v = met.combined()
            i, j = self._near(v, self.reached[False][live])
            affine = None
            if p.affinity_enabled:
                affine = met.affine()
                x, y = self._near(np.where(affine, v, np.float32(-1)), self.reached[True][live])
                i, j = np.divmod(np.union1d(i * v.shape[1] + j, x * v.shape[1] + y), v.shape[1])
            if len(i):
                self._add(met, live[i], j + at.start, None if affine is None else affine[i, j])

    def _near(self, v: np.ndarray, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores that can be among the k best of their row here and reach what is given."""
        i, j = cells(v >= (reached - SLACK).astype(np.float32)[:, None])
        many = np.nonzero(np.bincount(i, minlength=len(v)) > 2 * self.k)[0]
        if len(many):
            least = np.full(len(v), -np.inf, np.float32)
            least[many] = np.partition(v[many], v.shape[1] - self.k, axis=1)[:, v.shape[1] - self.k] - 2 * np.float32(SLACK)
            keep = v[i, j] >= least[i]
            i, j = i[keep], j[keep]
        return i, j

    def _add(self, met: Met, i: np.ndarray, j: np.ndarray, affine: np.ndarray | None) -> None:
        parts = met.exact(i, j)
        score = parts["combined"]
        affine = np.zeros(len(i), bool) if affine is None else affine
        keep = (score >= self.reached[False][i]) | (affine & (score >= self.reached[True][i]))
        values = np.stack([parts[x][keep] for x in ("semantic", "keyword", "structured", "action_object", "control_type", "category_prior", "combined")], axis=1).tolist()
        for a, b, x, near, value in zip(i[keep].tolist(), j[keep].tolist(), score[keep].tolist(), affine[keep].tolist(), values):
            if x < self.reached[False][a] and not (near and x >= self.reached[True][a]):
                continue
            n = min(self.k, int(met.t.count[b]))
            for kind in (False, True) if near else (False,):
                heap = self.heaps[kind][a]
                for _ in range(n):
                    if len(heap) < self.k:
                        heapq.heappush(heap, x)
                    elif x > heap[0]:
                        heapq.heapreplace(heap, x)
                    else:
                        break
                if len(heap) == self.k:
                    self.reached[kind][a] = max(self.reached[kind][a], heap[0])
            own, target = self.found[a], met.t.target[b]
            members = met.t.members(b, self.k)
            if target in own:
                members = sorted(own[target][2] + members, key=in_order)[:self.k]
            own[target] = (x, near, members, value)
            if len(own) > self.limit[a]:
                self._prune(a)

    def _prune(self, a: int) -> None:
        least, affine = self.reached[False][a], self.reached[True][a]
        self.found[a] = {t: e for t, e in self.found[a].items() if e[0] >= least or (e[1] and e[0] >= affine)}
        self.limit[a] = 2 * len(self.found[a]) + 4 * self.k + 16

    def rows(self):
        """Batches of (profile, target, key, affine, members, signals...)."""
        out = []
        for a in range(self.s.n):
            self._prune(a)
            out += [(self.profile[a], t, self.key, e[1], [{"order_no": o, "atomic_id": x} for o, x in e[2]], *e[3]) for t, e in self.found[a].items()]
            if len(out) > 20_000 or a == self.s.n - 1:
                yield out
                out = []


def counts_of(cond: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at[cond], minlength=n)


class Ranks:
    """How many targets of the pool are ahead of given candidates on each signal: greater, or equal and earlier."""

    def __init__(self, table: pa.Table, p: Params, names: list[str], pooled: bool):
        self.s, self.p, self.names, self.pooled = Chunk(table, p), p, names, pooled
        cands = one(table["cands"])
        self.source = np.repeat(np.arange(self.s.n), pc.list_value_length(cands).to_numpy(zero_copy_only=False))
        flat = cands.flatten()
        self.n = len(flat)
        self.first = np.searchsorted(self.source, np.arange(self.s.n + 1))
        self.profile, self.atomic_id = texts(table["profile"])[self.source], flat.field("atomic_id")
        self.order = flat.field("order_no").cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.value = {x: flat.field(x).to_numpy(zero_copy_only=False) for x in names}
        self.ahead = {x: np.zeros(self.n, np.int64) for x in names}
        self.least = {x: np.minimum.reduceat(self.value[x], self.first[:-1]) for x in names} if self.n else {}

    def meet(self, t: Block) -> None:
        met = Met(self.s, t, self.p)
        self._zeros(met)
        live = np.arange(self.s.n)
        for at in t.strips:
            met.among(live, at)
            pool = met.pool() if self.pooled else None
            for x in self.names:
                v = {"semantic": met.semantic, "keyword": met.keyword, "structured": met.structured, "action_object": met.action}[x]()
                if v is None:
                    continue
                least = self.least[x]
                ok = v >= np.where(least > 0, least - SLACK, -SLACK).astype(np.float32)[:, None]
                zero = np.nonzero(least <= 0)[0]
                ok[zero] &= v[zero] != 0  # exactly 0: nothing in common
                i, j = cells(ok if pool is None else ok & pool)
                if len(i):
                    value = met.exact(i, j + at.start, (x,))[x]
                    some = value > 0
                    self._count(t, x, i[some], j[some] + at.start, value[some])

    def _earlier(self, order: np.ndarray, than: np.ndarray) -> np.ndarray:
        return (order < than) | (np.isnan(than) & ~np.isnan(order))

    def _zeros(self, met: Met) -> None:
        """Candidates without a value on a signal: all targets of the pool that are earlier, be it with or without one."""
        t = met.t
        zero = {x: self.value[x] == 0 for x in self.names}
        any_zero = np.nonzero(np.logical_or.reduce(list(zero.values())))[0]
        if not len(any_zero):
            return
        before = np.zeros(self.n, np.int64)
        if not self.pooled:
            before[any_zero] = np.searchsorted(np.sort(t.order), self.order[any_zero], "left")
        else:
            met.among(np.unique(self.source[any_zero]), slice(0, t.n))
            pool = met.pool()
            for c in any_zero.tolist():
                before[c] = (pool[met.place[self.source[c]]][t.of] & self._earlier(t.order, self.order[c])).sum()
        for x in self.names:
            self.ahead[x] += np.where(zero[x], before, 0)

    def _count(self, t: Block, x: str, i: np.ndarray, u: np.ndarray, value: np.ndarray) -> None:
        n = t.count[u]  # all targets with this content
        at = t.by[np.repeat(t.start[u] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
        i, value, order = np.repeat(i, n), np.repeat(value, n), t.order[at]
        width = self.first[i + 1] - self.first[i]
        ends = np.cumsum(width)
        a = 0
        while a < len(i):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + COMPARED, "right")))
            m = width[a:b]
            which = np.repeat(np.arange(a, b), m)
            c = np.repeat(self.first[i[a:b]] - np.concatenate([[0], np.cumsum(m)])[:-1], m) + np.arange(m.sum())
            mine, theirs, earlier = self.value[x][c], value[which], self._earlier(order[which], self.order[c])
            self.ahead[x] += counts_of((theirs > mine) | ((theirs == mine) & earlier), c, self.n)
            self.ahead[x] -= counts_of((mine == 0) & earlier, c, self.n)  # counted by _zeros already
            a = b
