"""Responses of policies: routed to scorers, scored offline, made into pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators.sequences import pad_right


def dispatch(source: Column, scorers: dict[tuple[str, ...], Column], strict: bool = True) -> Column:
    """The score of the scorer that takes a row's source.  A source nobody takes is
    an error, or null if not ``strict``."""
    out = F.raise_error(F.concat(F.lit("no scorer for source "), F.coalesce(source, F.lit("null")))).cast("double") if strict else F.lit(None).cast("double")
    for names, score in reversed(scorers.items()):
        out = F.when(source.isin(*names), score.cast("double")).otherwise(out)
    return out


def unknown_sources(df: DataFrame, source: str, scorers: dict[tuple[str, ...], Column]) -> DataFrame:
    """source, n of rows that no scorer takes."""
    known = [n for names in scorers for n in names]
    return df.where(~F.coalesce(F.col(source).isin(*known), F.lit(False))).groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def with_responses(prompts: DataFrame, generated: DataFrame, key: str, order: str, response: str) -> DataFrame:
    """Prompts with all their responses as one column, in order; prompts without
    any have an empty list."""
    lists = generated.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(response).alias("r")))), lambda x: x["r"]).alias("responses"))
    return prompts.join(lists, key, "left").withColumn("responses", F.coalesce("responses", F.array().cast("array<string>")))


def offline_scores(prompts: DataFrame, key: str, score: Callable[[Column], Column]) -> DataFrame:
    """key, n, best, mean score of each prompt's list of responses; the best is
    null without responses."""
    scored = F.transform("responses", lambda r: score(r).cast("double"))
    rows = prompts.select(key, scored.alias("s"))
    mean = F.try_divide(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), F.size("s"))
    return rows.select(key, F.size("s").alias("n"), F.array_max("s").alias("best"), mean.alias("mean"))


def pass_rate(best: DataFrame) -> DataFrame:
    """Share of prompts of which some response has score 1."""
    return best.agg(F.count(F.lit(1)).alias("prompts"), F.avg((F.coalesce("best", F.lit(0.0)) == 1).cast("double")).alias("pass_rate"))


def preference_pair(chosen: Column, rejected: Column, eos: int, length: int, pad: int = 0) -> Column:
    """Both answers as token ids with the end id, cut and filled up to ``length``,
    each with its own mask."""

    def side(ids: Column, name: str) -> list[Column]:
        ended = F.slice(F.concat(ids, F.array(F.lit(eos).cast("bigint"))), 1, length)
        mask = pad_right(F.transform(ended, lambda _: F.lit(1)), length, F.lit(0))
        return [pad_right(ended, length, F.lit(pad).cast("bigint")).alias(name), mask.alias(f"{name}_mask")]

    return F.struct(*side(chosen, "chosen"), *side(rejected, "rejected"))


def shifted_loss(logp: Column, mask: Column) -> Column:
    """Cross-entropy of next tokens: ``logp`` at i is that of the token at i + 1,
    which counts if the mask has it; null without such tokens."""
    next_mask = F.slice(mask, F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0)))
    kept = F.zip_with(F.slice(logp, F.lit(1), F.greatest(F.size(logp) - 1, F.lit(0))), next_mask, lambda p, m: F.when(m == 1, -p).otherwise(0.0))
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.aggregate(next_mask, F.lit(0), lambda a, x: a + x))


RETRIEVERS: dict[str, Callable[..., DataFrame]] = {}


def retriever(name: str) -> Callable[..., DataFrame]:
    """The search registered under ``name`` (bm25, dense)."""
    from sextant.operators import retrieval

    known = {"bm25": retrieval.bm25, "dense": retrieval.dense_scores, **RETRIEVERS}
    if name not in known:
        raise ValueError(f"no retriever {name}; there are {sorted(known)}")
    return known[name]


def response_rows(hits: DataFrame, contents: DataFrame, key: str, scores: bool) -> DataFrame:
    """One row for each query: its documents in order of rank, with their scores
    or, without ``scores``, by themselves."""
    packed = F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("id"), "contents", "score")))
    lists = hits.join(contents, key).groupBy("query_id").agg(packed.alias("x"))
    if scores:
        return lists.select("query_id", F.transform("x", lambda h: F.struct(h["id"].alias("id"), h["contents"].alias("contents"), h["score"].alias("score"))).alias("result"))
    return lists.select("query_id", F.transform("x", lambda h: F.struct(h["id"].alias("id"), h["contents"].alias("contents"))).alias("result"))


def on_workers(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """An arbitrary function of a worker's batch, on the executors."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from f(pa.Table.from_batches([batch])).to_batches()

    return df.mapInArrow(go, schema)


def dispatched(df: DataFrame, workers: int, total: int, mode: str, key: str = "row_id") -> DataFrame:
    """Rows with the worker they go to: ``one_to_all`` copies each to every worker,
    ``chunks`` deals equal contiguous parts, of which the first may be larger by a
    row; ``all_to_all`` expects a worker column."""
    if mode == "one_to_all":
        return df.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))
    if mode == "chunks":
        small, more = divmod(total, workers)
        edge = more * (small + 1)
        late = F.floor((F.col(key) - edge) / F.lit(max(small, 1))) + more
        return df.withColumn("worker", F.when(F.col(key) < edge, F.floor(F.col(key) / F.lit(small + 1))).otherwise(late).cast("int"))
    if mode == "all_to_all":
        if "worker" not in df.columns:
            raise ValueError("rows must say their worker")
        return df
    raise ValueError(f"unknown mode {mode}")
