"""Digests of tables as trees, so that no task digests everything.

A leaf is the digest of a row's content; a node is the digest of its children's digests,
in order, ``FANOUT`` at most.  Each level is an aggregation over the level below, until
one node is left.  Two tables are compared from the roots down: only children of nodes
that differ are looked at, so the rows that differ are named without comparing all.  A
row is verified against a root by the digests beside its path.

Defined cases: rows are in the order of a key that is unique (ties by a hash of the row);
null content has a digest of its own; an empty table has no levels and a null root;
tables of unequal length differ from the first row that one of them does not have."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators.batch import row_ids
from sextant.operators.retrieval import sized
from sextant.session import written

FANOUT = 256


def leaf(content: Column) -> Column:
    """The digest of a row: of a mark and its content, so that no leaf passes for a node."""
    return F.sha2(F.coalesce(F.concat(F.lit("leaf:"), content), F.lit("null")), 256)


def node(children: Column) -> Column:
    return F.sha2(F.concat(F.lit("node:"), F.array_join(children, ",")), 256)


@dataclass
class Tree:
    """Levels of (number, digest), leaves first; leaves have their key as well."""

    levels: list[DataFrame]
    fanout: int

    def root(self) -> str | None:
        return self.levels[-1].collect()[0].digest if self.levels else None  # one row


def build(rows: DataFrame, key: str, content: Column, fanout: int = FANOUT) -> Tree:
    """The tree of ``rows`` in the order of ``key``."""
    leaves = row_ids(rows.select(F.col(key).alias("key"), leaf(content).alias("digest")), "key", name="number")
    level, levels = written(leaves.select("number", "key", "digest"), "leaves"), []
    if level.isEmpty():
        return Tree([], fanout)
    while True:
        levels.append(level)
        if level.limit(2).count() == 1:
            return Tree(levels, fanout)
        parent = F.expr(f"number DIV {int(fanout)}").alias("number")
        above = level.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct("number", "digest"))).alias("c"))  # fanout at most
        level = written(above.select("number", node(F.col("c.digest")).alias("digest")), "nodes")


def differences(a: Tree, b: Tree) -> DataFrame:
    """(number, key, other_key) of the leaves that differ, or that one tree lacks."""
    spark = (a.levels or b.levels)[0].sparkSession if a.levels or b.levels else None
    if spark is None:
        raise ValueError("two empty tables have no session to answer in")
    none = "number bigint, key string, digest string"
    sides = [t.levels or [spark.createDataFrame([], none)] for t in (a, b)]
    # A tree of fewer levels has the same nodes below; above its root nothing is known.
    shared = min(map(len, sides))
    suspects: DataFrame | None = None
    for k in range(shared - 1, -1, -1):
        x, y = (s[k].select("number", "digest", *(["key"] if k == 0 else [])) for s in sides)
        if suspects is not None:
            mine = lambda d: d.join(sized(suspects), F.expr(f"{'number'} DIV {a.fanout}") == F.col("above"), "left_semi")  # noqa: E731, B023
            x, y = mine(x), mine(y)
        both = x.alias("x").join(y.alias("y"), F.col("x.number") == F.col("y.number"), "full_outer").where(~F.col("x.digest").eqNullSafe(F.col("y.digest")))
        number = F.coalesce("x.number", "y.number")
        if k == 0:
            return both.select(number.alias("number"), F.col("x.key").alias("key"), F.col("y.key").alias("other_key"))
        suspects = written(both.select(number.alias("above")), "suspects")
    raise AssertionError("a tree has leaves")


def paths(tree: Tree, numbers: DataFrame) -> DataFrame:
    """(number, digest, path) of chosen leaves: for each level above, the digests of the
    group that the path goes through."""
    out = tree.levels[0].join(sized(numbers.select("number").distinct()), "number").select("number", "digest", F.col("number").alias("at"), F.array().cast("array<array<string>>").alias("path"))
    for level in tree.levels[:-1]:
        groups = level.groupBy(F.expr(f"number DIV {tree.fanout}").alias("above")).agg(F.array_sort(F.collect_list(F.struct("number", "digest"))).alias("c")).select("above", F.col("c.digest").alias("c"))
        step = out.withColumn("above", F.expr(f"at DIV {tree.fanout}"))
        out = step.join(groups, "above").select("number", "digest", F.col("above").alias("at"), F.concat("path", F.array("c")).alias("path"))
    return out.select("number", "digest", "path")


def holds(number: Column, digest: Column, path: Column, root: str, fanout: int = FANOUT) -> Column:
    """Whether a leaf's path leads from its digest to the root: at each level the digest
    so far is the member of the group that the number says."""
    start = F.struct(number.alias("at"), digest.alias("digest"), F.lit(True).alias("ok"))
    place = lambda acc: (acc["at"] % fanout).cast("int")
    step = lambda acc, group: F.struct(F.call_function("div", acc["at"], F.lit(fanout)).alias("at"), node(group).alias("digest"), (acc["ok"] & F.coalesce(F.get(group, place(acc)) == acc["digest"], F.lit(False))).alias("ok"))
    return F.aggregate(path, start, step, lambda acc: acc["ok"] & (acc["digest"] == root))
