"""Near duplicates of vectors by sorted projection passes.

Each pass orders the vectors by concatenated signs of random projections and compares every vector with the next `window` in
that order; pairs at or over the threshold are verified in double precision and joined across passes. Equal vectors are one
row first. What bounded windows leave open inside a found group is then settled exactly: members within half the threshold
angle of the group's first vector are linked with each other by the triangle inequality, all others are compared with the
whole group in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.common import components, partitions, saved

BITS = 60


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of equally long vectors, and the vectors' lengths in components."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return x, size


def _sort_key(seed: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, _ = unit_rows(b.column("x"))
            planes = np.random.default_rng(seed).normal(size=(x.shape[1], BITS))
            bits = (x @ planes > 0).astype(np.int64)
            key = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column("id"), b.column("x")], names=["key", "id", "x"])
    return run


FOUND = "pass int, u long, v long, key long, x array<double>"


def _near(ids: np.ndarray, xs: np.ndarray, old: int, window: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of rows in order with the next `window` rows; pairs within the first `old` rows are known."""
    us, vs = [], []
    for o in range(max(0, old - window), len(ids), 512):
        rows = xs[o:o + 512 + window]
        near = rows[:512] @ rows.T >= cosine
        i, j = np.nonzero(near)
        keep = (j > i) & (j <= i + window) & (j + o >= old)
        us.append(ids[o + i[keep]])
        vs.append(ids[o + j[keep]])
    return np.concatenate(us), np.concatenate(vs)


def _windows(number: int, window: int, cosine: float):
    """Rows in order -> links of each with the next `window` rows, and the first and last `window` rows of the partition (v null)."""
    def links(u, v):
        n = len(u)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), pa.array(u), pa.array(v), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.float64()))], names=["pass", "u", "v", "key", "x"])

    def edges(ids, keys, xs):
        n = len(ids)
        x = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * xs.shape[1]), pa.array(xs.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), pa.array(ids), pa.nulls(n, pa.int64()), pa.array(keys), x], names=["pass", "u", "v", "key", "x"])

    def run(batches):
        ids, keys, xs, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            x, _ = unit_rows(b.column("x"))
            old = len(ids)
            new = b.column("id").to_numpy(), b.column("key").to_numpy()
            if seen < window:
                first = slice(0, window - seen)
                yield edges(new[0][first], new[1][first], x[first])
            seen += len(x)
            ids, keys = np.concatenate([ids, new[0]]), np.concatenate([keys, new[1]])
            xs = x if xs is None else np.concatenate([xs, x])
            yield links(*_near(ids, xs, old, window, cosine))
            ids, keys, xs = ids[-window:], keys[-window:], xs[-window:]
        last = min(len(ids), seen - window)  # rows that are not among the first
        if last > 0:
            yield edges(ids[-last:], keys[-last:], xs[-last:])
    return run


def _borders(window: int, cosine: float):
    """First and last rows of all partitions by pass and order -> links; between two rows over a border no row is missing."""
    def run(batches):
        ids, xs = np.zeros(0, np.int64), None
        for b in batches:
            if b.num_rows:
                x, _ = unit_rows(b.column("x"))
                old = len(ids)
                ids, xs = np.concatenate([ids, b.column("u").to_numpy()]), x if xs is None else np.concatenate([xs, x])
                u, v = _near(ids, xs, old, window, cosine)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                ids, xs = ids[-window:], xs[-window:]
    return run


def passes_for(rows: int, cosine: float, window: int, recall: float = 0.98, least: int = 12) -> int:
    """Passes in which a pair at the cosine, among evenly spread vectors, shares enough leading bits once with this chance."""
    bits = math.log2(max(2.0, rows / window))
    meets = (1 - math.acos(cosine) / math.pi) ** bits
    return max(least, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def passes(vectors: DataFrame, cosine: float, n_passes: int, window: int) -> DataFrame:
    """Verified links (u, v) between the rows (id, x) of unit vectors, over all passes; windows go over the borders of partitions."""
    n, out = partitions(vectors.sparkSession), None
    for p in range(n_passes):
        keyed = vectors.mapInArrow(_sort_key(1000 + p), "key long, id long, x array<double>")
        ordered = keyed.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
        found = ordered.mapInArrow(_windows(p, window, cosine), FOUND)
        out = found if out is None else out.union(found)
    out = saved(out, "passes")
    edges = out.where("v is null").select("pass", "key", "u", "x").repartition(n, "pass").sortWithinPartitions("pass", "key", "u")
    return out.where("v is not null").select("u", "v").union(edges.mapInArrow(_borders(window, cosine), "u long, v long"))


def _compare(cosine: float):
    """Blocks of fringe and group rows -> how many rows of the group, weighted by size, each fringe row is linked with, and back."""
    def run(batches):
        for b in batches:
            ids, counts = [], []
            for f, g in zip(b.column("fringe"), b.column("members")):
                fi, fx, fw = block(f)
                gi, gx, gw, core = *block(g), np.array([r["core"] for r in g.as_py()])
                near = (fx @ gx.T >= cosine) & (fi[:, None] != gi[None, :])
                ids += [fi, gi[core]]
                counts += [near @ gw, (near.T @ fw)[core]]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(counts))], names=["id", "n"])

    def block(rows):
        rows = rows.as_py()
        return np.array([r["id"] for r in rows], np.int64), np.array([r["x"] for r in rows]), np.array([r["size"] for r in rows], np.int64)
    return run


def near_duplicates(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", cosine: float = 0.95, n_passes: int = 12, window: int = 24, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. So do vectors whose number of
    components is not the most frequent one. n_passes is the least number of passes; it grows with the rows. Rows that repeat a key are rows of their own with links to each other; a row
    with a null key has no links and null in component_id and kept.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda t, x: t + x * x))
    large = F.array_max(F.transform("e", lambda x: F.abs(x)))  # scaled first, so that squares neither overflow nor vanish
    sound = F.col("vec_id").isNotNull() & F.coalesce((F.size("e") > 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    rows = rows.withColumn("e", F.when(sound & (large > 0), F.transform("e", lambda x: x / large)))
    rows = rows.withColumn("e", F.transform("e", lambda x: x / norm))
    rows = saved(rows, "vectors")
    usual = rows.where("e is not null").groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()  # one row
    usual = usual[0].n if usual else 0
    classes = saved(rows.where(F.size("e") == usual).groupBy("e").agg(F.min("vec_id").alias("id"), F.count("*").alias("size")).select("id", F.col("e").alias("x"), "size"), "classes")
    n_passes = passes_for(classes.count(), cosine, window, least=n_passes)
    links = saved(passes(classes.select("id", "x"), cosine, n_passes, window), "pairs")
    roots = components(links, "vectors")
    groups = classes.join(roots.withColumnRenamed("node", "id"), "id")
    groups = groups.union(classes.join(roots.select(F.col("root").alias("id")).distinct(), "id").withColumn("root", F.col("id")))
    groups = saved(groups, "groups")
    # angle to the group's first vector
    first = groups.where("id = root").select("root", F.col("x").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    placed = groups.join(first, "root").withColumn("core", F.acos(F.least(dot, F.lit(1.0))) <= math.acos(cosine) / 2 - 1e-7).drop("y")
    placed = saved(placed, "placed")
    cores = placed.where("core").groupBy("root").agg(F.sum("size").alias("total"))
    inside = placed.where("core").join(cores, "root").select("id", (F.col("total") - F.col("size")).alias("n"))
    # fringe rows meet all rows of their group, a block with a block
    n_blocks = placed.groupBy("root").agg(F.ceil(F.count("*") / block).alias("nb"), F.max((~F.col("core")).cast("int")).alias("open")).where("open = 1").select("root", "nb")
    open_ = placed.join(n_blocks, "root").withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")))
    row = F.struct("id", "x", "size", "core")
    members = open_.groupBy("root", "b").agg(F.collect_list(row).alias("members"))
    fringe = open_.where("not core").groupBy("root", F.col("b").alias("c")).agg(F.collect_list(row).alias("fringe"))
    pairs = members.join(fringe, "root").select("fringe", "members").repartition(partitions(spark))
    outer = pairs.mapInArrow(_compare(cosine), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    linked = inside.union(outer).groupBy("id").agg(F.sum("n").alias("n"))
    per_class = classes.select("id", "x", "size").join(linked, "id", "left").join(groups.select("id", "root"), "id", "left")
    per_class = saved(per_class.select(F.col("x").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")), "per_class")
    out = rows.join(per_class, "e", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
