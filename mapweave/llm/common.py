"""Helpers shared by the operators: shared-folder tables, Arrow slices, 64-bit hashing and connected components."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions.memory import release
from mapweave.sources import shared

U = np.uint64


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back; then Spark may drop the shuffles of the ended job.

    Spark keeps shuffle files until the driver's garbage is collected, which a driver with little to do puts off for long.
    """
    out = shared.saved(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by saved() that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().toUri().getPath() == jvm.org.apache.hadoop.fs.Path(shared.shared_folder(spark)).toUri().getPath():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the len + 1 offsets of its rows; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(array) + 1, offset=array.offset * 8) if len(array) else np.zeros(1, np.int64)
    if data is None or not len(array):
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def tokenizer_of(path: str):
    """The tokenizer of a file, for one thread: a task has one core, and each further thread keeps memory of its own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def thrifty(run):
    """run for mapInArrow, giving freed memory back to the system after each batch: workers live through all stages of a job."""
    def each(batches):
        for b in run(batches):
            yield b
            release()
    return each


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes each; a longer row is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretch of a sequence, from prefix sums and inverse powers."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
        self.base = U(int(rng.integers(2**40, 2**62)) * 4 + 3)
        self.inverse = U(pow(int(self.base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n + 1:
            n = max(n + 1, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """values: bytes (looked up in the table) or 64-bit numbers."""
        self.powers(len(values))
        if values.dtype == np.uint8:
            values = self.table[values]
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[:len(values)], out=out[1:], dtype=np.uint64)
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of width values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the smallest node that each reaches, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        differ = low != high
        if not differ.any():
            break
        np.minimum.at(root, high[differ], low[differ])
        while (root[root] != root).any():
            root = root[root]
        a, b = a[differ], b[differ]
    return nodes, nodes[root]


def _contract(batches):
    tables = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if tables:
        nodes, roots = forest(np.concatenate([t[0] for t in tables]), np.concatenate([t[1] for t in tables]))
        keep = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["u", "v"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node reachable.

    Each task first contracts its own edges to a forest. Then large-star and small-star steps alternate until nothing
    changes. A hub is aggregated before the shuffle, and its join can be split, so no task holds all its neighbours.
    Null ends and loops are ignored; repeated edges count once.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = saved(e.mapInArrow(_contract, "u long, v long"), name)
    state = None
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        after = saved(small, name)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = after
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
