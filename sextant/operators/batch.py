"""Batch algebra: rows in an order given by a column, never by position.

Numbers of rows come from one sort by the order column (``row_ids``) that does
not gather all rows in a task: ranks within ranges plus the ranges' offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.session import written


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """Rows in ranges of ``order``, the range of each as ``__p``; written once, as a
    range shuffle that is made twice need not deal the same way twice.  Rows with
    the same order go by a hash of all their columns, so that no value has to fit
    a range."""
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    return written(df.withColumn("__h", tie).repartitionByRange(*order, "__h").withColumn("__p", F.spark_partition_id()), "ranges")


def starts(sizes: DataFrame, size: str) -> DataFrame:
    """What the ranges before each range add up to: __p, __s, from a row for each
    range with its ``size``."""
    before = F.coalesce(F.sum(size).over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("__p", before.alias("__s"))


def row_ids(df: DataFrame, *order: str, name: str = "row_id") -> DataFrame:
    """Number rows from 0 by ``order``, ties by a hash of the row.  A range shuffle
    sorts them; each range's rows are ranked by themselves, and ranges begin where
    the ones before end."""
    part = ranged(df, *order)
    local = part.withColumn("__n", F.row_number().over(W.partitionBy("__p").orderBy(*order, "__h")))
    sizes = part.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    out = local.join(F.broadcast(starts(sizes, "__c")), "__p", "left")
    number = F.when(F.col("__s").isNull(), F.raise_error(F.lit("a range of rows has no start"))).otherwise(F.col("__s") + F.col("__n") - 1)
    return out.withColumn(name, number.cast("bigint")).drop("__p", "__n", "__s", "__h")


def union_columns(a: DataFrame, b: DataFrame, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Columns of both by key, and the violations: rows that one side misses or
    whose shared columns differ."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    both = a.alias("a").join(b.alias("b"), key, "full_outer")
    same = F.lit(True)
    for c in shared:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    missing = F.lit(False)
    for side, cols in (("a", a.columns), ("b", b.columns)):
        own = [c for c in cols if c != key]
        if own:
            missing |= F.col(f"{side}.{own[0]}").isNull()
    bad = both.where(~same | missing).select(key)
    extra = [F.col(f"b.{c}") for c in b.columns if c not in a.columns]
    good = both.where(same & ~missing).select(key, *(F.col(f"a.{c}") for c in a.columns if c != key), *extra)
    return good, bad


def concat(*frames: DataFrame) -> DataFrame:
    """Rows of all, numbered by which one they come from."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def chunk(df: DataFrame, n: int, total: int, key: str = "row_id") -> DataFrame:
    """Equal contiguous chunks; the number of rows must divide."""
    if total % n:
        raise ValueError(f"{total} rows do not make {n} equal chunks")
    return df.withColumn("chunk", F.floor(F.col(key) / F.lit(total // n)).cast("int"))


def repeat(df: DataFrame, n: int, interleave: bool, total: int, key: str = "row_id") -> DataFrame:
    """Each row n times: a a b b, or (not interleaved) a b a b."""
    many = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = F.col(key) * n + F.col("rep") if interleave else F.col("rep") * F.lit(total) + F.col(key)
    return many.withColumn("new_id", place.cast("bigint"))


def pad_to_divisor(df: DataFrame, divisor: int, total: int, key: str = "row_id") -> DataFrame:
    """Rows of the beginning again, until the number of rows divides."""
    need = -total % divisor
    own = df.withColumn("is_pad", F.lit(False))
    if not need or not total:
        return own
    again = df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(-(-need // total) - 1)))).withColumn(key, F.col("__r") * total + F.col(key)).where(F.col(key) < need)
    return own.unionByName(again.drop("__r").withColumn(key, F.col(key) + total).withColumn("is_pad", F.lit(True)))


def fold(df: DataFrame, size: int, column: str, key: str = "row_id") -> DataFrame:
    """Rows of ``size`` consecutive values."""
    grouped = df.groupBy(F.floor(F.col(key) / size).cast("bigint").alias("fold")).agg(F.array_sort(F.collect_list(F.struct(key, column))).alias("x"))
    return grouped.select("fold", F.col(f"x.{column}").alias(column))


def unfold(df: DataFrame, size: int, column: str) -> DataFrame:
    return df.select("fold", F.posexplode(column).alias("i", column)).select((F.col("fold") * size + F.col("i")).alias("row_id"), column)


def minibatches(df: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """Batches in an order given by a hash of seed and key."""
    drawn = df.withColumn("draw", F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256))
    return row_ids(drawn, "draw", key, name="pos").withColumn("batch", F.floor(F.col("pos") / size).cast("bigint")).drop("draw")


def drop_last(df: DataFrame, size: int, total: int, key: str = "row_id") -> DataFrame:
    """Without the last batch if it is short."""
    return df.withColumn("batch", F.floor(F.col(key) / size).cast("bigint")).where(F.col("batch") < total // size)


def collate(df: DataFrame, key: str, order: str) -> DataFrame:
    """A row for each key, with the values of each other column as a list in order."""
    columns = [c for c in df.columns if c != key]
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *columns)))
    return df.groupBy(key).agg(packed.alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in columns))


def from_columns(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A small batch from lists, which must be of one length."""
    lengths = {k: len(v) for k, v in columns.items()}
    if len(set(lengths.values())) > 1:
        raise ValueError(f"columns differ in length: {lengths}")
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema)


def sizes(df: DataFrame) -> DataFrame:
    """Bytes of each column: of texts and binaries their content, of numbers their
    width, of arrays that of their elements."""
    width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}

    def of(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.octet_length(c)
        if kind.startswith("array<"):
            return F.size(c) * width.get(kind[6:-1], 8)
        return F.lit(width.get(kind, 8))

    return df.agg(*(F.coalesce(F.sum(of(n, t).cast("bigint")), F.lit(0)).alias(n) for n, t in df.dtypes))


def as_integers(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as integers, cut towards zero; what does not fit is an error."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})
