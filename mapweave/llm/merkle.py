"""Merkle manifest of a table: a hash tree per group of rows, a tree over the groups, and a proof for every row.

A leaf is the hash of a row's columns. The rows of a group ascend by key, and every `fanout` consecutive nodes become one
until one is left, the group's subroot; the subroots, in the order of the groups, become the root in the same way.

Slot pivot: a level is one grouping by (group, number of the parent) whose conditional aggregates spread the children into
`fanout` columns. The concatenated columns hash to the parent; leaving a child's own column out gives its siblings. Proofs
then go down again, from each parent to its children, so that level k moves 1/fanout**k of the rows; texts are read once and
never shuffled. Places come from one range-partitioned, sorted write, so a group of any size is spread over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import discard, saved
from mapweave.sources import shared

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"


def named(name: str) -> Column:
    """A column by its whole name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def leaf_of(values: list[Column]) -> Column:
    """The hash of values: "-" for null, else the number of UTF-8 bytes, ":" and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def siblings(path: Column) -> Column:
    """The nodes beside a path, level by level from the leaf up, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, saved, with `at`: the row's place from 0 in the given order, nulls first.

    Rows are dealt out by ranges of the order and written sorted; a place is the rows of the earlier partitions (one
    figure for each partition comes to the driver) and the number within its own.
    """
    cols = [F.col(c).asc_nulls_first() for c in order]
    put = saved(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    sizes = dict(put.groupBy(part.cast("int")).count().collect())
    first = [0]
    for p in range(max(sizes, default=0)):
        first.append(first[-1] + sizes.get(p, 0))
    return put.withColumn("at", F.lit(first).cast("array<bigint>")[part.cast("int")] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))


def slots(fanout: int, name: str) -> list[str]:
    return [f"{name}{i}" for i in range(fanout)]


def pivoted(nodes: DataFrame, fanout: int, carry: list[str]) -> DataFrame:
    """One row per parent of nodes (g, n, at, node, carry...): its children's nodes and carried values as columns, and its own node."""
    each = [F.expr(f"max(CASE WHEN at % {fanout} = {i} THEN {c} END) AS {c}{i}") for c in ["node", *carry] for i in range(fanout)]
    up = nodes.where("n > 1").groupBy("g", F.expr(f"at div {fanout} AS at")).agg(F.max("n").alias("below"), *each)
    return up.withColumn("n", F.expr(f"(below + {fanout - 1}) div {fanout}")).withColumn("node", F.sha2(F.concat_ws("", *slots(fanout, "node")), 256))


def climbed(nodes: DataFrame, largest: int, fanout: int, carry: list[str], name: str) -> list[DataFrame]:
    """The saved levels above nodes, lowest first, until groups of `largest` nodes have one; single nodes do not climb on."""
    levels = []
    while largest > 1:
        levels.append((shared.saved if levels else saved)(pivoted(nodes, fanout, [] if levels else carry), f"{name}-level"))
        nodes = levels[-1].select("g", "n", "at", "node")
        largest = -(-largest // fanout)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The last node of every group."""
    return reduce(DataFrame.union, [t.where("n = 1").select("g", "node") for t in [nodes, *levels]])


def children(parents: DataFrame, fanout: int, carry: list[str]) -> DataFrame:
    """A row per child of parents (g, subroot, at, slots, path): its place, node, carried values and path."""
    def child(i: int) -> str:
        left, right = (", ".join(["''", *x]) for x in (slots(fanout, "node")[:i], slots(fanout, "node")[i + 1:]))
        step = f"struct(concat_ws({left}) AS left, concat_ws({right}) AS right)"
        return f"struct({', '.join([f'at * {fanout} + {i} AS at', f'node{i} AS node', f'concat(array({step}), path) AS path', *[f'{c}{i} AS {c}' for c in carry]])})"
    one = F.expr(f"explode(filter(array({', '.join(map(child, range(fanout)))}), c -> c.node IS NOT NULL)) AS c")
    return parents.select("g", "subroot", one).select("g", "subroot", "c.*")


def descended(levels: list[DataFrame], above: DataFrame, fanout: int, carry: list[str]) -> DataFrame:
    """(g, subroot, at, node, path, carry...) of every node below the levels; above: (g, subroot, path) of the groups' last nodes."""
    below = None
    for k in range(len(levels) - 1, -1, -1):
        level, kept = levels[k], carry if k == 0 else []
        parents = level.where("n = 1").join(above, "g")
        if below is not None:
            parents = parents.unionByName(level.where("n > 1").join(below.select("g", "at", "subroot", "path"), ["g", "at"]))
        below = children(parents, fanout, kept)
        below = below if k == 0 else shared.saved(below, "paths")
    return below


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = COLUMNS, fanout: int = 8, seen: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, path, folded_root, verified) of every row.

    path: for each level from the leaf up to the root the siblings to the left and to the right, concatenated. seen: what a
    reader now holds in some columns; folded_root is folded from the leaf of these values (without seen, from the leaf
    itself), and verified tells whether it is the root.

    Nulls are values of their own in every column; rows without a key come first in their group, a null group is the first
    group. Rows with equal keys ascend by leaf; rows equal in all columns have equal leaves and proofs of their own. A group
    of one row has its leaf as subroot, and a single group its subroot as root. An empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    own = {c: named(c) for c in columns}
    rows = docs.select(named(key).alias("key"), named(group).alias("part"), leaf_of(list(own.values())).alias("node"), leaf_of(list({**own, **(seen or {})}.values())).alias("now"))
    read = saved(rows, "leaves")
    rows = numbered(read, ["part", "key", "node"], "leaves")
    discard(read)
    groups = numbered(rows.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n")), ["part"], "groups").withColumnRenamed("at", "g")
    found = groups.agg(F.max("n"), F.count("*")).first()
    largest, n_groups = found[0] or 0, found[1]
    places = groups.select(F.col("part").alias("p"), "first", "n", "g")
    leaves = rows.join(places, F.col("part").eqNullSafe(F.col("p"))).select("g", "n", (F.col("at") - F.col("first")).alias("at"), "node", "key", "now")
    carry = ["key", "now"]
    levels = climbed(leaves, largest, fanout, carry, "tree")
    subroots = shared.saved(tops(leaves, levels), "subroots")
    over = subroots.select(F.lit(0).cast("long").alias("g"), F.lit(n_groups).cast("long").alias("n"), F.col("g").alias("at"), "node")
    roots = climbed(over, n_groups, fanout, [], "roots")
    top = tops(over, roots).first()
    none = F.array().cast(f"array<{STEP}>").alias("path")
    if roots:
        start = docs.sparkSession.range(1).select(F.col("id").alias("g"), F.lit(None).cast("string").alias("subroot"), none)
        above = shared.saved(descended(roots, start, fanout, []).select(F.col("at").alias("g"), F.col("node").alias("subroot"), "path"), "above")
    else:
        above = subroots.select("g", F.col("node").alias("subroot"), none)
    out = leaves.where("n = 1").join(above, "g").select("subroot", "node", "path", *carry)
    if levels:
        out = descended(levels, above, fanout, carry).select("subroot", "node", "path", *carry).unionByName(out)
    root = F.lit(top["node"] if top else None).cast("string")
    out = out.select(F.col("key").alias(key), F.col("node").alias("leaf"), "subroot", root.alias("root"), "path", folded(F.col("now"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
