"""Data sets from sources: first-wins dedup, decontamination by key, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Parts of a category that are ranked by themselves.
PARTS = 64


def draw(namespace: str, key: Column, seed: int = 42) -> Column:
    """The place a hash gives a row: stable whatever else is in the table."""
    return F.sha2(F.concat(F.lit(f"{seed}|{namespace}|"), key.cast("string")), 256)


def first_of(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key.  An aggregation keeps one row for each key and
    task before anything moves, so a key that is everywhere is no burden."""
    packed = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*df.columns).alias("row"))
    return df.groupBy(key.alias("__k")).agg(F.min_by(packed["row"], packed).alias("row")).select("row.*")


def exclude(df: DataFrame, key: Column, held: DataFrame, held_key: Column) -> DataFrame:
    """Rows whose key is not among those of ``held``."""
    keys = held.select(held_key.alias("__h")).distinct()
    return df.withColumn("__h", key).join(keys, "__h", "left_anti").drop("__h")


def capped(df: DataFrame, category: str, order: Column, most: int) -> DataFrame:
    """The first ``most`` rows of each category."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(category).orderBy(order))).where(F.col("place") <= most)


def quota_split(df: DataFrame, category: str, quality: Column, key: str, quotas: DataFrame) -> DataFrame:
    """Of each category the best rows up to its quota (n_train + n_val), dealt
    by another hash: the first n_train to train, the rest to val.  A category is
    first ranked in parts, of which each keeps no more than the quota."""
    limits = F.broadcast(quotas)
    order = [F.col("__q"), F.col("__d"), F.col(key)]
    rows = df.join(limits, category).withColumn("__q", quality).withColumn("__d", draw("select", F.col(key))).withColumn("__s", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    within = F.col("place") <= F.col("n_train") + F.col("n_val")
    best = rows.withColumn("place", F.row_number().over(W.partitionBy(category, "__s").orderBy(*order))).where(within).drop("__s", "place")
    chosen = best.withColumn("place", F.row_number().over(W.partitionBy(category).orderBy(*order))).where(within).drop("__q", "__d")
    dealt = chosen.withColumn("deal", F.row_number().over(W.partitionBy(category).orderBy(draw("split", F.col(key)), key)))
    return dealt.withColumn("split", F.when(F.col("deal") <= F.col("n_train"), "train").otherwise("val"))


def shortfall(df: DataFrame, category: str, quotas: DataFrame) -> DataFrame:
    """category, available, required, missing; categories without rows as well."""
    have = df.groupBy(category).agg(F.count(F.lit(1)).alias("available"))
    need = quotas.select(category, (F.col("n_train") + F.col("n_val")).cast("bigint").alias("required"))
    counted = need.join(have, category, "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
    return counted.withColumn("missing", F.greatest(F.col("required") - F.col("available"), F.lit(0).cast("bigint")))


def order_digest(df: DataFrame, order: str, key: Column) -> DataFrame:
    """SHA-256 of the ids in order, one to a line.  Digests the ids of a data
    set that was selected, which are few."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), key.cast("string").alias("k")))), lambda x: x["k"]), "\n")
    return df.agg(F.sha2(F.concat(lines, F.lit("\n")), 256).alias("digest"))
