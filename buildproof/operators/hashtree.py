"""A tree of digests over buckets of rows: two tables are compared from the root down, and only buckets that differ are read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from .assertions import named

#: Children of a node, rows of a leaf that a depth is chosen for, and levels of the tree that are folders of the rows (256 at most).
FANOUT, LEAF_ROWS, FOLDERS = 16, 4096, 2
MAX_DEPTH = 12
#: Nodes of a level whose children are looked up by name; where more differ, the levels are joined.
LISTED = 256
LEAF, TOP = "__leaf", "__top"
DIGESTS = ("rows_a", "rows_b", "keys_a", "keys_b")


@dataclass(frozen=True)
class Layout:
    """How the rows of a table are dealt out: all its columns in order, those that choose the leaf, and the levels below the root."""

    columns: tuple[str, ...]
    keys: tuple[str, ...]
    depth: int

    @property
    def folders(self) -> int:
        """Leaves that share a folder."""
        return FANOUT ** (self.depth - min(self.depth, FOLDERS))


def depth_for(rows: int) -> int:
    """The least depth whose leaves hold LEAF_ROWS rows or fewer on average."""
    depth = 0
    while FANOUT**depth * LEAF_ROWS < rows and depth < MAX_DEPTH:
        depth += 1
    return depth


def _unhashed(kind: DataType) -> bool:
    """Whether a type is, or holds, one that has no hash: maps and variants."""
    if isinstance(kind, StructType):
        return any(_unhashed(f.dataType) for f in kind.fields)
    return _unhashed(kind.elementType) if isinstance(kind, ArrayType) else isinstance(kind, (MapType, VariantType))


def hashable(df: DataFrame, column: str) -> Column:
    """The values of a column in a form that has a hash: maps as their sorted entries where those have one, else as JSON text."""
    kind, c = df.schema[column].dataType, named(column)
    if isinstance(kind, MapType) and not (_unhashed(kind.keyType) or _unhashed(kind.valueType)):
        return F.array_sort(F.map_entries(c))
    return F.to_json(F.struct(c.alias("v"))) if _unhashed(kind) else c


def _hash(df: DataFrame, columns: Sequence[str], seed: int) -> Column:
    """Of values as they are, nulls told apart from values. Equal for -0.0 and 0.0, and for all NaN."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (named(c).isNull(), hashable(df, c))])


def with_leaf(df: DataFrame, layout: Layout) -> DataFrame:
    """df and the leaf of every row."""
    return df.withColumn(LEAF, F.pmod(_hash(df, layout.keys or layout.columns, 1), F.lit(FANOUT**layout.depth)))


def laid_out(df: DataFrame, layout: Layout, parts: int) -> DataFrame:
    """Rows with leaf and folder, dealt out by ranges of leaves: each folder is written by few tasks, and each file holds a range of leaves in order.

    Leaves come from a hash, so the ranges are known beforehand and df is computed once. A leaf that holds more than a task should (a key of very many rows) is
    split by adaptive execution, as the deal is a rebalancing one.
    """
    leaves = FANOUT**layout.depth
    leafed = with_leaf(df, layout).withColumn(TOP, F.floor(F.col(LEAF) / layout.folders).cast("int"))
    ranged = leafed.withColumn("__range", F.floor(F.col(LEAF) / max(1, min(layout.folders, leaves // parts))))
    return ranged.hint("rebalance", parts, F.col("__range")).sortWithinPartitions(TOP, LEAF).drop("__range")


def tree(df: DataFrame, layout: Layout) -> DataFrame:
    """level, node, n and digests of every node that has rows.

    A digest is the sum of 64-bit hashes, two of them of different seeds, of rows and of their keys: it doesn't depend on order, tells how
    often a row stands there, and adds up from leaf to root. One scan; a row for each leaf and task is shuffled.
    """
    whole = "decimal(38,0)"
    hashes = [_hash(df, columns, seed).cast(whole) for columns, seed in ((layout.columns, 3), (layout.columns, 4), (layout.keys, 5), (layout.keys, 6))]
    leaves = with_leaf(df, layout).select(LEAF, *[h.alias(d) for h, d in zip(hashes, DIGESTS)])
    leaves = leaves.groupBy(LEAF).agg(F.count(F.lit(1)).alias("n"), *[F.sum(d).cast(whole).alias(d) for d in DIGESTS])
    levels = F.transform(F.sequence(F.lit(0), F.lit(layout.depth)), lambda k: F.struct(k.alias("level"), F.floor(F.col(LEAF) / F.pow(F.lit(float(FANOUT)), layout.depth - k)).cast("long").alias("node")))
    nodes = leaves.select(F.explode(levels).alias("at"), "n", *DIGESTS).select("at.*", "n", *DIGESTS)
    return nodes.groupBy("level", "node").agg(F.sum("n").alias("n"), *[F.sum(d).cast(whole).alias(d) for d in DIGESTS])


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """node, and whether its keys differ, of nodes of one level that are not the same on both sides."""
    a, b = (df.select("node", *[F.col(c).alias(f"{side}_{c}") for c in ("n", *DIGESTS)]) for df, side in ((old, "old"), (new, "new")))
    both = a.join(b, "node", "full_outer")
    same = lambda *columns: F.forall(F.array(*[F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in columns]), lambda x: x)
    return both.filter(~same("n", *DIGESTS)).select("node", (~same("n", "keys_a", "keys_b")).alias("keys_differ"))


def differing_leaves(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """node (a leaf), keys_differ of the leaves in which two trees of one layout differ, found from the root down.

    Of each level only the children of nodes that differ are read, as long as these are few enough to be named in a filter; beyond that the leaves are joined.
    """
    spark, ask = old.sparkSession, None
    for level in range(depth + 1):
        sides = [t.filter(F.col("level") == level) if ask is None else t.filter((F.col("level") == level) & F.col("node").isin(*ask)) for t in (old, new)]
        found = _differing(*sides).limit(LISTED + 1).collect()
        if level == depth and len(found) <= LISTED or not found:
            return spark.createDataFrame([tuple(r) for r in found], "node long, keys_differ boolean").coalesce(1)
        if len(found) > LISTED:
            break
        ask = [r.node * FANOUT + k for r in found for k in range(FANOUT)]
    return _differing(*[t.filter(F.col("level") == depth) for t in (old, new)])


def in_leaves(rows: DataFrame, leaves: DataFrame, layout: Layout, folders: bool = False) -> DataFrame:
    """The rows in some leaves. rows: with LEAF, and with folders in TOP. Few leaves are named in the filter, so that other folders and row groups are never opened; many are joined."""
    few = [r.node for r in leaves.select("node").limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        wanted = F.col(LEAF).isin(*few) if few else F.lit(False)
        return rows.filter(wanted & F.col(TOP).isin(*sorted({n // layout.folders for n in few}))) if folders and few else rows.filter(wanted)
    return rows.join(leaves.select(F.col("node").alias(LEAF)), LEAF, "left_semi")


def same_kinds(a: StructType, b: StructType) -> bool:
    """Whether both sides have the same columns, but for case, of the same types: only then are their hashes those of equal rows."""
    x, y = ({f.name.upper(): f.dataType for f in s} for s in (a, b))
    return x == y and len(x) == len(a) == len(b)
