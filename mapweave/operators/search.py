"""Exact top-k target search without a pair table.

1. Targets are packed, where they are computed, into blocks of bounded size, equal ones as one row with its members: only the first
   k members of a profile can ever be among the k best, because members tie on every signal and rank by input order. Equal
   sources collapse to one profile and are packed into chunks likewise. No target is shuffled.
2. Every chunk meets every block (in category scopes the part of it that shares a key with the chunk) as a product of two small
   tables of packed rows. A task walks through its blocks and keeps the k best of each source so far, ties included.
3. What a source has found bounds what it still looks at: a block is cut into strips of similar targets, and a strip whose upper
   bound (angle bound for the vectors, tokens it holds for the fields) stays below is skipped. In the rest, scores in single
   precision decide which pairs are scored exactly; nothing is dropped that could still rank. The kernels are in pairs.py.
4. The work is quadratic where no strip can be skipped; memory, shuffles and tables written are not.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from mapweave.functions.memory import release
from mapweave.operators import pairs as P
from mapweave.operators.keyword import with_keywords
from mapweave.params import DEFAULTS, FAMILY_AFFINITY, GLOBAL_SCOPES, Params
from mapweave.sources.shared import saved

SIGNALS = ["semantic", "keyword", "structured", "action_object", "control_type", "category_prior", "combined"]
# everything that decides a score, an affinity or a pool; equal values mean the same profile
FEATURES = ["vec", "sets", "ao", "control_family", "primary_key", "secondary_keys", "confidence", "low_confidence",
            "keys", "id_family", "term_list", "term_tf", "doc_len"]
SOURCE_ONLY = ["affine_families", "term_weight", "avg_len", "keyword_best"]
#: Chunks of sources that a task holds at once.
CHUNKS = 8


def checkpointed(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so lost executors do not replay the whole lineage."""
    return saved(df, "search")


def _present(df: DataFrame) -> list[str]:
    return [c for c in FEATURES + SOURCE_ONLY if c in df.columns]


def _profiled(df: DataFrame) -> DataFrame:
    """Adds a 128-bit content key over the features."""
    cols = [F.col(c) for c in _present(df)]
    return df.withColumn("profile", F.concat_ws("-", F.xxhash64(*cols).cast("string"),
                                                F.xxhash64(F.lit("second"), *cols).cast("string")))


def _collapse(df: DataFrame, k: int) -> DataFrame:
    """One row per profile with its first k members in input order."""
    first_k = Window.partitionBy("profile").orderBy("order_no", "atomic_id")
    kept = _profiled(df).withColumn("_rn", F.row_number().over(first_k)).filter(F.col("_rn") <= k)
    return kept.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("order_no", "atomic_id"))).alias("members"),
                                       *[F.first(c).alias(c) for c in _present(df)])


def _stretches(batches, size: int):
    """Batches as tables of size rows, the last one smaller."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - n)
            held.append(part)
            n, b = n + part.num_rows, b.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _packs(size: int, columns: list[str]):
    """Rows -> a row for each `size` of them at most: the different profiles and, in order, all rows of them."""
    def pack(table: pa.Table):
        table = table.take(pc.sort_indices(table, sort_keys=[("order_no", "ascending"), ("atomic_id", "ascending")], null_placement="at_start"))
        found = P.one(table["profile"]).dictionary_encode()
        of = found.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        first = np.unique(of, return_index=True)[1]
        profiles = table.select(["profile", *columns]).take(pa.array(first))
        rows = pa.table({"profile": pa.array(of), "order_no": table["order_no"], "atomic_id": table["atomic_id"]})
        return pa.RecordBatch.from_pydict({"id": [uuid.uuid4().hex], "profiles": pa.array([P.packed(profiles)], pa.binary()), "rows": pa.array([P.packed(rows)], pa.binary())})

    def run(batches):
        for table in _stretches(batches, size):
            yield pack(table)
            release()
    return run


PACKED = "id string, profiles binary, rows binary"


def target_blocks(targets: DataFrame, p: Params) -> DataFrame:
    """Blocks (id, profiles, rows) of p.target_block_rows targets at most."""
    columns = [c for c in FEATURES if c in targets.columns]
    packed = _profiled(targets).select("profile", F.col("order_no").cast("long").alias("order_no"), F.col("atomic_id").cast("string").alias("atomic_id"), *columns)
    return checkpointed(packed.mapInArrow(_packs(p.target_block_rows, columns), PACKED))


def _by_key(batches):
    """Blocks -> a row for each key that targets of the block have, with these targets only."""
    for b in batches:
        for name, profiles, rows in zip(*(b.column(c) for c in ("id", "profiles", "rows"))):
            profiles, rows = P.unpacked(profiles.as_buffer()), P.unpacked(rows.as_buffer())
            keys = P.Lists.of(profiles["keys"])
            values = keys.values.to_numpy(zero_copy_only=False)
            of = P.one(rows["profile"]).to_numpy()
            for key in sorted(set(values.tolist())):
                mine = np.unique(keys.rows[values == key])
                place = np.full(len(profiles), -1, np.int32)
                place[mine] = np.arange(len(mine))
                here = np.nonzero(place[of] >= 0)[0]
                part = rows.take(pa.array(here)).set_column(0, "profile", pa.array(place[of[here]]))
                yield pa.RecordBatch.from_pydict({"_key": [key], "id": [f"{name.as_py()} {key}"], "profiles": pa.array([P.packed(profiles.take(pa.array(mine)))], pa.binary()),
                                                  "rows": pa.array([P.packed(part)], pa.binary())})


def _chunked(size: int, columns: list[str], keyed: bool):
    """Source rows -> a row for each `size` of them at most, by key."""
    def run(batches):
        for b in _stretches(batches, 16 * size if keyed else size):
            keys = P.texts(b["_key"]) if keyed else np.zeros(len(b), object)
            for key in dict.fromkeys(keys.tolist()):
                at = np.nonzero(keys == key)[0]
                for o in range(0, len(at), size):
                    part = b.select(columns).take(pa.array(at[o:o + size]))
                    yield pa.RecordBatch.from_pydict({**({"_key": [key]} if keyed else {}), "chunk": [uuid.uuid4().hex], "sources": pa.array([P.packed(part)], pa.binary())})
    return run


def source_chunks(sources: DataFrame, p: Params, extra: tuple = (), keyed: bool = False) -> DataFrame:
    """Chunks ([_key,] chunk, sources) of p.source_block_rows sources at most; keyed: a source is in a chunk of each of its keys."""
    columns = [*(["_key"] if keyed else []), "profile", *_present(sources), *extra]
    if keyed:
        sources = sources.withColumn("_key", F.explode(F.array_distinct("keys")))
    parts = max(1, math.ceil(sources.count() / p.source_block_rows / CHUNKS))
    dealt = sources.select(*columns).repartitionByRange(parts, *columns[:2 if keyed else 1])
    return checkpointed(dealt.mapInArrow(_chunked(p.source_block_rows, columns, keyed), ("_key string, " if keyed else "") + "chunk string, sources binary"))


def _meet(blocks: DataFrame, chunks: DataFrame, keyed: bool, begin, end, p: Params, schema) -> DataFrame:
    """Every chunk with every block, with equal _key where keyed: begin(sources) makes what meets the blocks one after the other, and end(it)
    gives its columns. Chunks and blocks are read where they meet; only the results are written."""
    spark = blocks.sparkSession
    parts = max(1, math.ceil(chunks.count() / CHUNKS))
    blocks = blocks.coalesce(max(1, math.ceil(4 * spark.sparkContext.defaultParallelism / parts)))
    if keyed:
        blocks = blocks.mapInArrow(_by_key, f"_key string, {PACKED}")
    small = chunks.repartition(parts).hint("shuffle_replicate_nl")  # a product: no block is sorted, shuffled or sent to the driver
    pairs = (blocks.join(small, "_key") if keyed else blocks.crossJoin(small)).select("id", "profiles", "rows", "chunk", "sources")
    names = [f.name for f in schema.fields]

    def run(batches):
        held, block, at = {}, None, None
        for b in batches:
            for name, profiles, rows, chunk, sources in zip(*(b.column(c) for c in ("id", "profiles", "rows", "chunk", "sources"))):
                if chunk.as_py() not in held:
                    held[chunk.as_py()] = begin(P.unpacked(sources.as_buffer()))
                if name.as_py() != at:
                    at, block = name.as_py(), P.Block(P.unpacked(profiles.as_buffer()), P.unpacked(rows.as_buffer()), p)
                held[chunk.as_py()].meet(block)
        for one in held.values():
            for columns in end(one):
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return checkpointed(pairs.mapInArrow(run, schema))


MEMBERS = pa.list_(pa.struct([("order_no", pa.int64()), ("atomic_id", pa.string())]))
RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("profile", "target", "key")] + [T.StructField("affine", T.BooleanType())]
                      + [T.StructField("members", T.ArrayType(T.StructType([T.StructField("order_no", T.LongType()), T.StructField("atomic_id", T.StringType())])))]
                      + [T.StructField(s, T.DoubleType()) for s in SIGNALS])


def _found(best: P.Best):
    kinds = [pa.string()] * 3 + [pa.bool_(), MEMBERS] + [pa.float64()] * len(SIGNALS)
    for rows in best.rows():
        yield [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)]


def _scored(blocks: DataFrame, sources: DataFrame, p: Params, k: int, keyed: bool) -> DataFrame:
    """Targets (profile, target, affine, order_no, atomic_id, signals) that hold the k best of every source, overall and affine, with all
    ties; of a target profile the first k. A pair that shares several keys is found in each of them and taken from the first."""
    found = _meet(blocks, source_chunks(sources, p, keyed=keyed), keyed, lambda table: P.Best(table, p, k), _found, p, RESULT)
    if keyed:
        found = found.withColumn("_k", F.min("key").over(Window.partitionBy("profile", "target"))).where("key = _k")
    rows = found.select("profile", "target", "affine", F.explode("members").alias("m"), *SIGNALS).select("profile", "target", "affine", "m.order_no", "m.atomic_id", *SIGNALS)
    first_k = Window.partitionBy("profile", "target").orderBy("order_no", "atomic_id")
    return rows.withColumn("_rn", F.row_number().over(first_k)).where(F.col("_rn") <= k).drop("_rn")


def top_targets(blocks: DataFrame, sources: DataFrame, p: Params, k: int) -> DataFrame:
    """Per source profile the targets with the k best combined scores, all ties included, and with injection the k best affine ones as
    well. In category scopes only sources without a key search the whole pool."""
    if p.match_scope in GLOBAL_SCOPES:
        return _within(_scored(blocks, sources, p, k, False), k, F.rank)
    found = _scored(blocks, sources.filter(F.size("keys") > 0), p, k, True)
    rest = sources.filter(F.size("keys") == 0)
    return _within(found if rest.isEmpty() else found.unionByName(_scored(blocks, rest, p, k, False)), k, F.rank)


def _within(df: DataFrame, k: int, ranker) -> DataFrame:
    """Rows among the k best of their source profile, overall or among the affine ones."""
    overall = Window.partitionBy("profile").orderBy(F.desc("combined"))
    affine = Window.partitionBy("profile", "affine").orderBy(F.desc("combined"))
    return (df.withColumns({"_all": ranker().over(overall), "_aff": ranker().over(affine)})
            .filter((F.col("_all") <= k) | (F.col("affine") & (F.col("_aff") <= k))).drop("_all", "_aff"))


def ahead(value: np.ndarray, order: np.ndarray, values: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """For each (values, orders): how many rows have a greater value, or the same one and a smaller order.

    Only rows that can be ahead of some candidate are sorted, so the cost does not multiply with the candidates.
    """
    near = value >= values.min()
    value, order = value[near], order[near]
    at = np.lexsort((order, -value))
    value, order = -value[at], order[at]
    first, last = np.searchsorted(value, -values, "left"), np.searchsorted(value, -values, "right")
    return np.array([a + np.searchsorted(order[a:b], o, "left") for a, b, o in zip(first.tolist(), last.tolist(), orders)], dtype=np.int64)


def rank_counts(wanted: DataFrame, sources: DataFrame, blocks: DataFrame, p: Params) -> DataFrame:
    """Exact rank of given candidates on each ranked signal within the whole pool.

    `wanted`: profile (source), atomic_id, order_no and the candidate's signals. Every task counts, over its blocks of targets,
    how many beat each candidate, or tie with it and come earlier; the counts are then added up.
    """
    used = [x for x, on in zip(P.RANKED, (p.use_semantic, p.use_keyword, p.use_structured, p.use_structured)) if on]  # rrf reads no other
    grouped = wanted.groupBy("profile").agg(F.collect_list(F.struct("atomic_id", "order_no", *P.RANKED)).alias("cands"))
    chunks = source_chunks(sources.join(grouped, "profile"), p, ("cands",))
    pooled = p.match_scope not in GLOBAL_SCOPES

    def counts(ranks: P.Ranks):
        yield [pa.array(ranks.profile, pa.string()), ranks.atomic_id, *(pa.array(ranks.ahead[x]) if x in used else pa.array(np.zeros(ranks.n, np.int64)) for x in P.RANKED)]

    schema = T.StructType([T.StructField(x, T.StringType()) for x in ("profile", "atomic_id")] + [T.StructField(f"n_{x}", T.LongType()) for x in P.RANKED])
    counted = _meet(blocks, chunks, False, lambda table: P.Ranks(table, p, used, pooled), counts, p, schema)
    return counted.groupBy("profile", "atomic_id").agg(*[(F.sum(f"n_{x}") + 1).alias(f"rank_{x}") for x in P.RANKED])


def open_ties(found: DataFrame) -> DataFrame:
    """(profile, combined) of the ties that input order alone does not settle. Candidates of equal ranked signals follow each other in
    input order on each of them, so the first has the better ranks; ids and orders must tell the candidates apart for that."""
    equal = [F.min(x) == F.max(x) for x in P.RANKED]
    plain = (F.count("order_no") == F.count(F.lit(1))) & (F.countDistinct("atomic_id") == F.count(F.lit(1)))
    for e in equal:
        plain = plain & e
    return (found.groupBy("profile", "combined").agg(F.countDistinct("target").alias("_c"), plain.alias("_plain"))
            .filter((F.col("_c") > 1) & ~F.col("_plain")).select("profile", "combined"))


def rrf(p: Params):
    """Weighted reciprocal ranks of the signals that are switched on."""
    terms = []
    if p.use_semantic:
        terms.append(F.lit(p.weight_semantic) * (F.lit(1.0) / (F.lit(p.rrf_k) + F.col("rank_semantic"))))
    if p.use_keyword:
        terms.append(F.lit(p.weight_keyword) * (F.lit(1.0) / (F.lit(p.rrf_k) + F.col("rank_keyword"))))
    if p.use_structured:
        terms.append(F.lit(p.weight_structured) * (F.lit(1.0) / (F.lit(p.rrf_k) + F.col("rank_structured"))))
        terms.append(F.lit(p.weight_action_object) * (F.lit(1.0) / (F.lit(p.rrf_k) + F.col("rank_action_object"))))
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.round(out, 12)


def search(sources: DataFrame, targets: DataFrame, p: Params = DEFAULTS, affinity: DataFrame | None = None,
           all_rrf: bool = False) -> DataFrame:
    """Ranked candidates of every source atom, exact over the whole pool.

    Inputs come from similarity.with_features; `affinity` is (key, families). Returned per source: the first
    max(top_k, review_limit) candidates with their rank, plus up to affinity_count injected ones (the next best
    affine candidates below the review cut). in_scoring marks the first top_k, in_review the first review_limit and the
    injected ones; the two cuts do not depend on each other. Rank is by combined score, then reciprocal-rank fusion, then input order. The fusion
    score only breaks ties, so exact pool ranks are counted just for candidates whose score ties across
    different signals (for all of them with all_rrf).
    """
    if p.use_keyword:
        sources, targets = with_keywords(sources, targets, p)
    if p.affinity_enabled:
        table = affinity if affinity is not None else sources.sparkSession.createDataFrame(
            list(FAMILY_AFFINITY.items()), "key string, families array<string>")
        joined = sources.join(table.select(F.col("key").alias("id_family"), "families"), "id_family", "left")
        sources = joined.withColumn("affine_families", F.coalesce(
            "families", F.array().cast("array<string>"))).drop("families")
    shown = max(p.top_k, p.review_limit)
    # at most `shown` affine candidates are taken already, so the next ones lie within shown + affinity_count
    k = shown + (p.affinity_count if p.affinity_enabled else 0)
    src, blocks = checkpointed(_collapse(sources, 1)), target_blocks(targets, p)
    expanded = checkpointed(top_targets(blocks, src, p, k))
    ranked = expanded.withColumn("rrf_score", F.lit(None).cast("double"))
    if p.use_rrf:
        tied = open_ties(expanded)
        wanted = expanded if all_rrf else expanded.join(tied, ["profile", "combined"], "left_semi")
        if all_rrf or not tied.isEmpty():
            ranks = rank_counts(wanted, src, blocks, p).withColumn("rrf_score", rrf(p))
            ranked = expanded.join(ranks, ["profile", "atomic_id"], "left")
    order = [F.desc("combined"), F.desc_nulls_last("rrf_score"), F.col("order_no")]
    overall = Window.partitionBy("profile").orderBy(*order)
    ranked = ranked.withColumn("rank", F.row_number().over(overall))
    late = F.col("affine") & (F.col("rank") > p.review_limit)
    nth = Window.partitionBy("profile", late).orderBy(*order)
    ranked = (ranked.withColumn("injected", late & (F.row_number().over(nth) <= p.affinity_count))
              .filter((F.col("rank") <= shown) | F.col("injected"))
              .withColumns({"in_scoring": F.col("rank") <= p.top_k, "in_review": (F.col("rank") <= p.review_limit) | F.col("injected")})
              # beyond the shown part the pool rank is unknown, so injected rows are numbered on
              .withColumn("rank", F.row_number().over(overall)))
    gate = F.when(F.lit(p.gate_enabled) & (F.col("action_object") < p.gate_cap75),
                  "low_action_object_alignment_score_cap").otherwise("pass")
    per_source = _profiled(sources).select("profile", F.col("atomic_id").alias("source_id"),
                                           F.col("order_no").alias("source_order"))
    return per_source.join(ranked, "profile").select(
        "source_id", "source_order", F.col("atomic_id").alias("candidate_id"),
        F.col("order_no").alias("candidate_order"), *[F.col(s).alias(f"{s}_score") for s in SIGNALS], "rrf_score",
        gate.alias("hard_gate"), "rank", "injected", "in_scoring", "in_review")
