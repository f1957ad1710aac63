"""Array kernels for one block of sources against one block of targets.

Spark decides which blocks meet and ships them; these helpers only score what they are given.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from mapweave.operators.keyword import K1, LENGTH_PART
from mapweave.params import GLOBAL_SCOPES, STRUCTURED_WEIGHTS, Params

CONTROL_TYPE = list(STRUCTURED_WEIGHTS).index("control_type")
DIGITS = 12       # signals are compared at this precision
SCORE_DIGITS = 9  # combined scores are ranked at this precision


def unit_rows(vectors) -> np.ndarray:
    rows = [np.asarray(v, dtype=float) if v is not None else np.zeros(0) for v in vectors]
    width = {len(r) for r in rows if len(r)}
    if len(width) > 1:
        raise ValueError(f"embeddings of different length: {sorted(width)}")
    m = np.zeros((len(rows), width.pop() if width else 1))
    for i, r in enumerate(rows):
        if len(r):
            m[i] = r
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm == 0, 1.0, norm)[:, None]


def _flat(lists):
    sizes = np.array([len(x) if x is not None else 0 for x in lists], dtype=np.int64)
    items = np.concatenate([np.asarray(x, dtype=object) for x, n in zip(lists, sizes) if n]) if sizes.sum() else (
        np.zeros(0, dtype=object))
    return sizes, np.repeat(np.arange(len(sizes)), sizes), items


def matches(left, right, lweight=None, rweight=None) -> np.ndarray:
    """(left rows, right rows): number of shared items, or the sum of weight products over them."""
    ls, lrow, litem = _flat(left)
    rs, rrow, ritem = _flat(right)
    shape = (len(ls), len(rs))
    if not len(litem) or not len(ritem):
        return np.zeros(shape)
    codes, _ = pd.factorize(np.concatenate([litem, ritem]))
    lc, rc = codes[:len(litem)], codes[len(litem):]
    order = np.argsort(rc, kind="stable")
    counts = np.bincount(rc, minlength=codes.max() + 1)
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = counts[lc]
    li = np.repeat(np.arange(len(lc)), n)
    ri = order[np.repeat(starts[lc] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
    cells = lrow[li] * shape[1] + rrow[ri]
    weights = None
    if lweight is not None:
        weights = np.concatenate(lweight)[li] * np.concatenate(rweight)[ri]
    return np.bincount(cells, weights=weights, minlength=shape[0] * shape[1]).reshape(shape).astype(float)


def sizes_of(lists) -> np.ndarray:
    return np.array([len(x) if x is not None else 0 for x in lists], dtype=float)


def _jaccard(left, right):
    inter = matches(left, right)
    union = sizes_of(left)[:, None] + sizes_of(right)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0), union > 0


def keyword(s: pd.DataFrame, t: pd.DataFrame) -> np.ndarray:
    """Raw BM25 scores. Frequencies are in the source's weights; the mean length of its pool shapes the target's."""
    raw = np.zeros((len(s), len(t)))
    for avg_len, rows in s.groupby("avg_len").indices.items():
        part = s.iloc[rows]
        length = 1 - LENGTH_PART + LENGTH_PART * t["doc_len"].to_numpy() / avg_len
        weight = [np.asarray(tf) * (K1 + 1) / (np.asarray(tf) + K1 * n) for tf, n in zip(t["term_tf"], length)]
        raw[rows] = matches(part["term_list"], t["term_list"], list(part["term_weight"]), weight)
    return raw


def signals(s: pd.DataFrame, t: pd.DataFrame, p: Params) -> dict[str, np.ndarray]:
    shape = (len(s), len(t))
    zero = np.zeros(shape)
    out = {"semantic": zero, "keyword": zero, "structured": zero, "action_object": zero, "control_type": zero}
    if p.use_semantic:
        a, b = unit_rows(s["vec"]), unit_rows(t["vec"])
        if a.shape[1] == b.shape[1]:
            out["semantic"] = np.round(np.maximum(0.0, a @ b.T), DIGITS)
        elif a.any() and b.any():
            raise ValueError("embeddings of different length")
    if p.use_keyword:
        out["keyword"] = np.round(keyword(s, t) / s["keyword_best"].to_numpy()[:, None], DIGITS)
    if p.use_structured:
        total, weight = np.zeros(shape), np.zeros(shape)
        for i, w in enumerate(STRUCTURED_WEIGHTS.values()):
            ls, lt = [x[i] for x in s["sets"]], [x[i] for x in t["sets"]]
            if not sizes_of(ls).any() and not sizes_of(lt).any():
                continue
            jac, present = _jaccard(ls, lt)
            total += np.where(present, w * jac, 0.0)
            weight += np.where(present, w, 0.0)
            if i == CONTROL_TYPE:
                out["control_type"] = np.round(jac, DIGITS)
        out["structured"] = np.round(np.divide(total, weight, out=np.zeros(shape), where=weight > 0), DIGITS)
        jac, _ = _jaccard(s["ao"], t["ao"])
        fs, ft = s["control_family"].to_numpy()[:, None], t["control_family"].to_numpy()[None, :]
        same, differ = (fs != "") & (fs == ft), (fs != "") & (ft != "") & (fs != ft)
        shifted = np.clip(jac + np.where(same, 0.25, 0.0) - np.where(differ, 0.25, 0.0), 0.0, 1.0)
        empty = (sizes_of(s["ao"]) == 0)[:, None] | (sizes_of(t["ao"]) == 0)[None, :]
        out["action_object"] = np.round(np.where(empty, np.where(same, 0.20, 0.0), shifted), DIGITS)
    ps, pt = s["primary_key"].to_numpy(), t["primary_key"].to_numpy()
    one = lambda v: [[x] if x else [] for x in v]
    raw = np.where(matches(s["secondary_keys"], t["secondary_keys"]) > 0, 0.45, 0.0)
    raw = np.where(matches(one(ps), t["secondary_keys"]) + matches(s["secondary_keys"], one(pt)) > 0, 0.70, raw)
    raw = np.where((ps[:, None] != "") & (ps[:, None] == pt[None, :]), 1.0, raw)
    factor = np.maximum(0.15, np.minimum(s["confidence"].to_numpy()[:, None], t["confidence"].to_numpy()[None, :]))
    low = s["low_confidence"].to_numpy(bool)[:, None] | t["low_confidence"].to_numpy(bool)[None, :]
    out["category_prior"] = np.round(np.clip(raw * np.where(low, np.minimum(factor, 0.30), factor), 0, 1), DIGITS)
    base = (p.weight_semantic * out["semantic"] + p.weight_keyword * out["keyword"]
            + p.weight_structured * out["structured"] + p.weight_action_object * out["action_object"]
            + p.weight_control_type * out["control_type"]) / p.weight_sum
    out["combined"] = np.round(np.minimum(1.0, base + p.weight_category_prior * out["category_prior"]), SCORE_DIGITS)
    return out


def in_pool(s: pd.DataFrame, t: pd.DataFrame, p: Params) -> np.ndarray:
    """Global scopes: every pair. Category scopes: pairs sharing a key; a source without keys keeps all."""
    if p.match_scope in GLOBAL_SCOPES:
        return np.ones((len(s), len(t)), dtype=bool)
    return (matches(s["keys"], t["keys"]) > 0) | (sizes_of(s["keys"]) == 0)[:, None]


def affine(s: pd.DataFrame, t: pd.DataFrame) -> np.ndarray:
    """Pairs that share a category or whose target family is affine to the source family."""
    cats = [([pk] if pk else []) + list(sk) for pk, sk in zip(t["primary_key"], t["secondary_keys"])]
    families = [[f] if f else [] for f in t["id_family"]]
    return (matches(s["keys"], cats) > 0) | (matches(s["affine_families"], families) > 0)


def best_cells(score: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Mask of each row's k best scores (ties of the k-th included) at or above floor."""
    if score.shape[1] <= k:
        return score >= floor
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    return score >= np.maximum(kth, floor)[:, None]
