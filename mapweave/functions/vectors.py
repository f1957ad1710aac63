"""Hashed embeddings and cosine similarity."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from mapweave.functions.text import TOKEN
from mapweave.params import STOP_WORDS

#: Tokens whose slots a task remembers.
KNOWN_SLOTS = 1 << 18


def token_slot(token: str, dims: int) -> int:
    """Signed slot of a token: slot+1, negative when the sign bit of its hash is odd."""
    high, slot = divmod(int(hashlib.sha256(f'"{token}"'.encode()).hexdigest()[:16], 16), dims)
    return -(slot + 1) if high % 2 else slot + 1


class Slots(dict):
    """The slots of the tokens met so far; 0 for stop words."""

    def __init__(self, dims: int):
        super().__init__(dict.fromkeys(STOP_WORDS, 0))
        self.dims = dims

    def __missing__(self, token: str) -> int:
        slot = token_slot(token, self.dims)
        if len(self) < KNOWN_SLOTS:
            self[token] = slot
        return slot


def _scatter(dims: int):
    find = re.compile(TOKEN).findall

    @F.arrow_udf("array<double>")
    def scatter(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slot = Slots(dims).__getitem__
        for texts in batches:
            found = [list(map(slot, find(t))) for t in texts.to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
            row = np.repeat(np.arange(len(found)), sizes)[flat != 0]
            flat = flat[flat != 0]
            m = np.bincount(row * dims + np.abs(flat) - 1, weights=np.sign(flat), minlength=len(found) * dims).reshape(len(found), dims)
            norm = np.sqrt((m * m).sum(axis=1))
            m /= np.where(norm == 0, 1.0, norm)[:, None]
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * dims), pa.array(m.ravel()))
    return scatter


def hash_embedding(text: Column, dims: int = 128) -> Column:
    """Signed token counts over `dims` slots, scaled to length one: the tokens of text.tokens, found and added up per
    Arrow batch, each different one hashed once, so no shuffle is needed."""
    return _scatter(dims)(F.lower(F.coalesce(text, F.lit(""))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 when a side is empty or all zero; an error when the lengths differ."""
    empty = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
    return (F.when(empty, F.lit(0.0))
            .when(F.size(a) != F.size(b), F.raise_error(F.lit("embeddings of different length")).cast("double"))
            .otherwise(value))
