"""Partitions of balanced total length."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.batch import row_ids


def differencing(lengths: list[int], k: int, equal_size: bool) -> list[list[int]]:
    """Indices in ``k`` parts: the two states of largest spread merge, heaviest
    part of one with lightest of the other, until one state is left."""
    if k < 1 or len(lengths) < k or (equal_size and len(lengths) % k):
        raise ValueError(f"{len(lengths)} lengths do not make {k} parts")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal_size:
        starts = [[(lengths[i], [i]) for i in order[at : at + k]] for at in range(0, len(order), k)]
    else:
        starts = [[(lengths[i], [i])] + [(0, [])] * (k - 1) for i in order]
    heap = []
    for n, parts in enumerate(starts):
        parts = sorted(parts, key=lambda p: (p[0], p[1]), reverse=True)
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), n, parts))
    count = len(starts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x + y, i + j) for (x, i), (y, j) in zip(a, reversed(b), strict=True)), key=lambda p: (p[0], p[1]), reverse=True)
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), count, merged))
        count += 1
    return [sorted(ids) for _, ids in heap[0][2]]


def greedy(lengths: list[int], k: int) -> list[list[int]]:
    """In input order, each to the lightest part so far."""
    heap = [(0, p) for p in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        total, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (total + n, p))
    return parts


def partition(df: DataFrame, k: int, equal_size: bool = True, method: str = "differencing") -> DataFrame:
    """batch, idx, part for rows of (batch, idx, seqlen); a batch is what one step
    takes, so it fits in a task.  Null lengths count as 0.  A batch whose rows do not
    make ``k`` parts of equal size, such as a last one, is filled up by places of
    length 0, so that the parts' sizes differ by no more than those places; with fewer
    rows than ``k`` some parts are empty."""

    def go(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        idx, lengths = group["idx"].to_pylist(), group["seqlen"].to_pylist()
        known = [n or 0 for n in lengths]
        if method == "differencing":
            fill = -len(known) % k if equal_size else max(0, k - len(known))
            parts = differencing(known + [0] * fill, k, equal_size)
        else:
            parts = greedy(known, k)
        of = {i: p for p, ids in enumerate(parts) for i in ids}
        return pa.table({"batch": pa.array(group["batch"].to_pylist(), pa.int64()), "idx": pa.array(idx, pa.int64()), "seqlen": pa.array(lengths, pa.int64()), "part": pa.array([of[i] for i in range(len(idx))], pa.int32())})

    rows = df.select(F.col("batch").cast("bigint").alias("batch"), F.col("idx").cast("bigint").alias("idx"), F.col("seqlen").cast("bigint").alias("seqlen"))
    return rows.groupBy("batch").applyInArrow(go, "batch bigint, idx bigint, seqlen bigint, part int")


def imbalance(parts: DataFrame) -> DataFrame:
    """batch, least, most and mean total of the parts."""
    totals = parts.groupBy("batch", "part").agg(F.sum("seqlen").alias("total"))
    return totals.groupBy("batch").agg(F.min("total").alias("least"), F.max("total").alias("most"), F.avg("total").alias("mean"))


def microbatches(df: DataFrame, most_tokens: int) -> DataFrame:
    """batch and how many micro-batches of at most so many tokens it takes."""
    return df.groupBy("batch").agg(F.ceil(F.sum("seqlen") / most_tokens).cast("bigint").alias("n"))




def deal(rows: DataFrame, length: str, key: str, k: int) -> DataFrame:
    """``rows`` with a ``part`` of ``k`` for each, over the whole table: by descending
    length, rounds of ``k`` rows deal one to each part, every other round backwards.  No
    row of a round is longer than one of the round before, so the parts' totals differ by
    no more than the largest length, and their sizes by one.  Rows are ranked by ranges;
    no task has them all.  Null lengths count as 0; rows of equal length go by ``key``."""
    if k < 1:
        raise ValueError(f"{k} parts")
    ranked = row_ids(rows.withColumn("__down", -F.coalesce(F.col(length), F.lit(0)).cast("bigint")), "__down", key, name="__rank")
    place, back = F.col("__rank") % k, F.call_function("div", F.col("__rank"), F.lit(k)) % 2 == 1
    return ranked.withColumn("part", F.when(back, k - 1 - place).otherwise(place).cast("int")).drop("__down", "__rank")
