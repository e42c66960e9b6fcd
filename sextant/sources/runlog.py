"""Run logs: lines of ``step:N - key:value - ...``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.operators.batch import row_ids


def read(spark: SparkSession, path: str) -> DataFrame:
    """line_no and line of text files; numbers increase within a file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def metrics(lines: DataFrame) -> DataFrame:
    """line_no, step, key, value.  Colours are dropped; what has no step or no
    number is skipped; a key ends at the last colon."""
    clean = lines.select("line_no", F.regexp_replace("line", "\x1b\\[[0-9;]*m", "").alias("line"))
    stepped = clean.withColumn("step", F.regexp_extract("line", r"step:(\d+)", 1).try_cast("bigint")).where("step IS NOT NULL")
    parts = stepped.select("line_no", "step", F.explode(F.split(F.regexp_replace("line", r"^.*?step:\d+( - )?", ""), " - ")).alias("part"))
    return parts.select("line_no", "step", F.trim(F.regexp_extract("part", r"^(.*):([^:]*)$", 1)).alias("key"), F.trim(F.regexp_extract("part", r"^(.*):([^:]*)$", 2)).try_cast("double").alias("value")).where("value IS NOT NULL AND key <> ''")


def prefix_mean(m: DataFrame, prefix: str) -> DataFrame:
    """Mean of the metric of that name and of all below it."""
    return m.where((F.col("key") == prefix) | F.startswith("key", F.lit(prefix + "/"))).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def last_write(m: DataFrame) -> DataFrame:
    """The last value of each key."""
    return m.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def reconcile(a: DataFrame, b: DataFrame, relative: float = 1e-6, absolute: float = 1e-6) -> DataFrame:
    """Values of both that belong together (the n-th of a step and key), by step:
    how many were compared and how many differ by more than the tolerance."""
    w = W.partitionBy("step", "key").orderBy("line_no")
    numbered = lambda m, name: m.select("step", "key", F.row_number().over(w).alias("n"), F.col("value").alias(name))
    both = numbered(a, "x").join(numbered(b, "y"), ["step", "key", "n"])
    off = F.abs(F.col("x") - F.col("y")) > relative * F.greatest(F.abs("x"), F.abs("y")) + absolute
    return both.groupBy("step").agg(F.count(F.lit(1)).alias("compared"), F.count_if(off).alias("different"))


def gaps(steps: DataFrame) -> DataFrame:
    """step and gap to the one before, where that is not 1.  Steps whose direct
    predecessor exists drop out first; what is left, a row for each gap, is
    matched with the ends of runs in order."""
    before = steps.select((F.col("step") + 1).alias("step"))
    starts = steps.join(before, "step", "left_anti")
    after = steps.select((F.col("step") - 1).alias("step"))
    ends = steps.join(after, "step", "left_anti")
    rank = lambda df, name: row_ids(df.select(F.col("step").alias(name)), name, name="n")
    joined = rank(starts, "step").join(rank(ends, "end").withColumn("n", F.col("n") + 1), "n")
    return joined.select("step", (F.col("step") - F.col("end")).alias("gap"))
