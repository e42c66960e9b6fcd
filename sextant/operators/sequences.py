"""Statistics of token sequences, on arrays or on one row for each token."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType


def pad_left(a: Column, length: int, pad: Column) -> Column:
    """Cut to the last ``length``, then filled up in front."""
    cut = F.slice(a, F.greatest(F.size(a) - length + 1, F.lit(1)), F.lit(length))
    return F.concat(F.array_repeat(pad, F.lit(length) - F.size(cut)), cut)


def pad_right(a: Column, length: int, pad: Column) -> Column:
    cut = F.slice(a, 1, length)
    return F.concat(cut, F.array_repeat(pad, F.lit(length) - F.size(cut)))


def convert_pad(a: Column, pad: Column, to_left: bool) -> Column:
    """All padding to one side, the rest in its order."""
    fill, rest = F.filter(a, lambda x: x == pad), F.filter(a, lambda x: x != pad)
    return F.concat(fill, rest) if to_left else F.concat(rest, fill)


def eos_mask(a: Column, eos: int) -> Column:
    """1 up to the first end token and on it, 0 after."""
    at = F.array_position(a, eos)
    return F.transform(a, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of arrays end to end, and where each array begins."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(a), 0))
    return a.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


@F.arrow_udf(ArrayType(IntegerType()))
def _positions(mask: pa.Array) -> pa.Array:
    m, at = _lists(mask)
    total = np.concatenate([[0], np.cumsum(m == 1)])
    count = total[1:] - np.repeat(total[at[:-1]], np.diff(at))
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.where(m == 1, count - 1, 0).astype(np.int32)))


def position_ids(mask: Column) -> Column:
    """Running count of the mask less 1, 0 where the mask is 0.  On Arrow batches,
    as sums over prefixes of arrays would take the square of their length."""
    return _positions(mask)


def info_mask(lengths: Column, own: Column) -> Column:
    """For turns of given lengths: true on the policy's tokens, false on others."""
    return F.flatten(F.zip_with(lengths, own, lambda n, o: F.array_repeat(o, n.cast("int"))))


def rolling_context(a: Column, b: Column, most: int) -> Column:
    """The last ``most`` of both together."""
    both = F.concat(a, b)
    return F.slice(both, F.greatest(F.size(both) - most + 1, F.lit(1)), F.lit(most))


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Advantages by the recurrence from the end, for many sequences at once: a
    step is a step of all of them, the shorter ones joining later."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def f(r: pa.Array, v: pa.Array) -> pa.Array:
        reward, at = _lists(r)
        value, _ = _lists(v)
        out, size = np.zeros(len(reward)), np.diff(at)
        order = np.argsort(-size, kind="stable")
        last, ahead = np.zeros(len(size)), np.zeros(len(size))
        for back in range(1, int(size.max(initial=0)) + 1):
            rows = order[: np.searchsorted(-size[order], -back, "right")]
            i = at[rows + 1] - back
            last[rows] = reward[i] + gamma * ahead[rows] - value[i] + gamma * lam * last[rows]
            ahead[rows] = value[i]
            out[i] = last[rows]
        return pa.ListArray.from_arrays(pa.array(at), pa.array(out))

    return f(rewards.cast("array<double>"), values.cast("array<double>"))


def group_advantage(df: DataFrame, score: str, group: str, epsilon: float = 1e-6) -> DataFrame:
    """(score - mean) / (deviation + epsilon) in each group; a group of one has
    mean 0 and deviation 1."""
    stats = df.groupBy(group).agg(F.avg(score).alias("__m"), F.stddev_samp(score).alias("__s"), F.count(F.lit(1)).alias("__n"))
    one = F.col("__n") == 1
    value = (F.col(score) - F.when(one, 0.0).otherwise(F.col("__m"))) / (F.when(one, 1.0).otherwise(F.col("__s")) + epsilon)
    return df.join(stats, group).withColumn("advantage", value).drop("__m", "__s", "__n")


def kl(logp: Column, ref: Column, kind: str) -> Column:
    """Estimate of the divergence of one token."""
    if kind == "kl":
        return logp - ref
    if kind == "abs":
        return F.abs(logp - ref)
    if kind == "mse":
        return 0.5 * (logp - ref) * (logp - ref)
    if kind == "low_var_kl":
        d = ref - logp
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(d) - d - 1))
    raise ValueError(f"unknown estimate {kind}")


def masked_mean(value: Column, mask: Column) -> Column:
    """Aggregate: mean where the mask is 1; null where it never is."""
    return F.try_divide(F.sum(value * mask), F.sum(mask))


def masked_variance(value: Column, mask: Column, unbiased: bool = True) -> Column:
    """Aggregate: variance where the mask is 1; null for one row or none."""
    kept = F.when(mask == 1, value)
    return F.var_samp(kept) if unbiased else F.var_pop(kept)


def policy_loss(t: DataFrame, clip: float) -> DataFrame:
    """pg_loss, clip_fraction and approximate divergence over masked tokens
    (logp, old_logp, advantage, mask)."""
    ratio = F.exp(F.col("logp") - F.col("old_logp"))
    plain, cut = -F.col("advantage") * ratio, -F.col("advantage") * F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio))
    m = F.col("mask")
    return t.agg(masked_mean(F.greatest(plain, cut), m).alias("pg_loss"), masked_mean((cut > plain).cast("double"), m).alias("clip_fraction"), masked_mean(F.col("old_logp") - F.col("logp"), m).alias("approx_kl"))


def value_loss(t: DataFrame, clip: float) -> DataFrame:
    """vf_loss and its clip fraction (vpred, value, ret, mask)."""
    cut = F.greatest(F.col("value") - clip, F.least(F.col("value") + clip, F.col("vpred")))
    a, b = (F.col("vpred") - F.col("ret")) ** 2, (cut - F.col("ret")) ** 2
    return t.agg((0.5 * masked_mean(F.greatest(a, b), F.col("mask"))).alias("vf_loss"), masked_mean((b > a).cast("double"), F.col("mask")).alias("clip_fraction"))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def entropy(logits: Column) -> Column:
    """Of the distribution that the logits give."""
    z = log_sum_exp(logits)
    return z - F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - z) * x)


def logprob(logits: Column, label: Column) -> Column:
    return F.element_at(logits, label + 1) - log_sum_exp(logits)


def presence_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Less by the penalty for each token that was generated, once."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def f(x: pa.Array, ids: pa.Array) -> pa.Array:
        out, at = _lists(x)
        token, of = _lists(ids)
        row = np.repeat(np.arange(len(of) - 1), np.diff(of))
        known = (token >= 0) & (token < np.diff(at)[row])
        out = out.astype(float)
        out[np.unique(at[row[known]] + token[known].astype(np.int64))] -= penalty
        return pa.ListArray.from_arrays(pa.array(at), pa.array(out))

    return f(logits.cast("array<double>"), seen)


def adaptive_kl(t: DataFrame, start: float, target: float, horizon: float) -> DataFrame:
    """Controller's coefficient after each step (step, kl, n): a running product,
    as each update multiplies by what the step alone gives.  A row is a step, of
    which a run has few."""
    factor = 1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("kl") / target - 1)) * F.col("n") / horizon
    total = F.sum(F.log(factor)).over(W.partitionBy("run").orderBy("step"))
    return t.withColumn("beta", start * F.exp(total))


def whiten(t: DataFrame, column: str, epsilon: float = 1e-8) -> DataFrame:
    """(x - mean) / sqrt(variance + epsilon) over all rows."""
    stats = t.agg(F.avg(column).alias("__m"), F.var_samp(column).alias("__v"))  # one row
    return t.crossJoin(F.broadcast(stats)).withColumn("whitened", (F.col(column) - F.col("__m")) / F.sqrt(F.col("__v") + epsilon)).drop("__m", "__v")
