"""Evaluation runs: metrics, strata, gates, paired comparison."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comparisons a criterion may ask for.
COMPARISONS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "==": operator.eq}


def share(condition: Column, of: Column | None = None) -> Column:
    """Aggregate: share of the rows (or of those with ``of``) that fulfil a
    condition; null if there are none."""
    if of is None:
        return F.avg(condition.cast("double"))
    return F.avg(F.when(of, condition.cast("double")))


def search_metrics(r: DataFrame, *keys: str) -> DataFrame:
    """Rows, matches, searches and their conditional means by ``keys``."""
    em, s = F.col("em") == 1, F.col("searches")
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("em").alias("correct"), F.avg("em").alias("em"), F.avg("searches").alias("mean_searches"),
        F.avg(F.when(em, s)).alias("mean_searches_correct"), F.avg(F.when(~em, s)).alias("mean_searches_wrong"),
        share(s >= 2).alias("p_two"), share(s >= 3).alias("p_three"), share(F.col("clipped") == 1).alias("clipped"), share(em, s >= 2).alias("em_of_two"),
    )


def strata(r: DataFrame, dimensions: list[str]) -> DataFrame:
    """Metrics overall and along each dimension, one at a time: one pass with
    grouping sets instead of one for each dimension."""
    sets = ", ".join(["()", *(f"({d})" for d in dimensions)])
    view = f"strata_{id(r)}"
    r.createOrReplaceTempView(view)
    label = "CASE " + " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dimensions) + " ELSE 'overall' END"
    value = "coalesce(" + ", ".join(f"CAST(CASE WHEN grouping({d}) = 0 THEN {d} END AS STRING)" for d in dimensions) + ", 'all')"
    return r.sparkSession.sql(f"SELECT {label} AS dimension, {value} AS value, count(*) AS n, avg(em) AS em, avg(searches) AS mean_searches, avg(CAST(searches >= 2 AS DOUBLE)) AS p_two FROM {view} GROUP BY GROUPING SETS ({sets})")


def criteria(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """name, observed, comparison, threshold, passed for one row of metrics; a
    missing value fails."""
    rows = [F.struct(F.lit(name).alias("name"), F.col(name).cast("double").alias("observed"), F.lit(op).alias("comparison"), F.lit(float(limit)).alias("threshold"), F.coalesce(COMPARISONS[op](F.col(name).cast("double"), F.lit(float(limit))), F.lit(False)).alias("passed")) for name, op, limit in rules]
    return metrics.select(F.inline(F.array(*rows)))


def decision(passed: DataFrame) -> DataFrame:
    """GO if all criteria pass."""
    return passed.agg(F.when(F.coalesce(F.bool_and("passed"), F.lit(False)), "GO").otherwise("NO-GO").alias("decision"), F.count_if(~F.col("passed")).alias("failed"))


#: The four outcomes of a pair.
OUTCOMES = ("both_correct", "baseline_only", "candidate_only", "both_wrong")


def outcome(base: Column, candidate: Column) -> Column:
    return F.when((base == 1) & (candidate == 1), OUTCOMES[0]).when(base == 1, OUTCOMES[1]).when(candidate == 1, OUTCOMES[2]).otherwise(OUTCOMES[3])


def paired(base: DataFrame, candidate: DataFrame, key: str = "sample_id") -> DataFrame:
    """Both runs' rows of the samples that both have."""
    other = candidate.select(key, F.col("em").alias("em_b"), F.col("searches").alias("searches_b"))
    return base.select(key, "em", "searches").join(other, key).withColumn("category", outcome(F.col("em"), F.col("em_b")))


#: Cumulative probabilities of a Poisson(1) variable up to 8.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])


def bootstrap(pairs: DataFrame, resamples: int, seed: int, value: Column, key: str = "sample_id") -> DataFrame:
    """Mean of ``value`` and a 95% interval over resamples.

    How often a row is in a resample is Poisson(1), drawn from a hash of seed,
    resample and key by the inverse of the distribution.  Each task keeps a vector
    of sums, one for each resample, so that a row is never copied and what is
    shuffled does not grow with the rows."""
    stream = np.random.default_rng(seed).integers(0, 1 << 63, resamples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            hashed, v = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(v), 256):  # 256 x resamples numbers at once
                x = hashed[at : at + 256, None] * stream[None, :]
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                times = np.searchsorted(POISSON, (x >> np.uint64(11)) / float(1 << 53), "right")
                total += v[at : at + 256] @ times
                count += times.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32)), pa.array(total), pa.array(count)], ["b", "s", "n"])

    rows = pairs.select(F.xxhash64(key).alias("h"), value.cast("double").alias("v")).where("v IS NOT NULL")
    sums = rows.mapInArrow(go, "b int, s double, n double").groupBy("b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = sums.select(F.try_divide("s", "n").alias("m"))  # one row for each resample
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg("m").alias("mean"), F.count("m").alias("resamples"))


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; null counts as broken."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())), lambda x: x.isNotNull())


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks.  One pass over the rows for all
    rules."""
    return df.select(F.col(key), F.explode(broken(rules)).alias("rule"))


def enforce(found: DataFrame) -> None:
    """Raise if there are violations."""
    if first := found.take(5):
        raise ValueError(f"violations: {first}")
