"""Session, scratch-space and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.session import scratch, ship, written  # noqa: F401

#: Rows handed to a Python worker at once: bounds its memory where texts are long.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Ship the code, and bound what one Arrow batch holds, by rows and by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def row_bytes(df: DataFrame) -> int:
    """Bytes of all rows as they are in memory (texts as UTF-8, 16 for the rest of
    a row): counted, since what files take says little where text compresses well."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) for n, t in df.dtypes if t in ("string", "binary")]
    return int(df.select(sum(wide, F.lit(16)).cast("bigint").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0])


def parts_for(df: DataFrame, bytes_each: int, least: int = 8) -> int:
    """How many parts of about ``bytes_each`` the rows of ``df`` make."""
    return max(least, -(-row_bytes(df) // bytes_each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table.  Texts that lie in fewer files than there are cores (so in one
    or few row groups) are dealt out; many files are read as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and len(df._jdf.inputFiles()) < cores else df


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str, most_rows: int = 50_000) -> DataFrame:
    """Join; ``right`` is broadcast only if it was counted to be at most
    ``most_rows`` rows, otherwise both sides shuffle on ``on``."""
    return left.join(F.broadcast(right) if small_enough(right, most_rows) else right, on, how)


def join_rows(left: DataFrame, right: DataFrame, on: list[str], how: str, most_rows: int = 200_000) -> DataFrame:
    """As ``join_sized``, but null keys match null keys.  For semi and anti joins,
    of which the left side's columns are the result."""
    other = right.select(*(F.col(c).alias(f"__{c}") for c in on))
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(F.broadcast(other) if small_enough(other, most_rows) else other, same, how)


def text_hash(text: Column) -> Column:
    """What tells rows of one id (or of none) apart, by their text."""
    return F.xxhash64(text.cast("string"), F.lit(29))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that share ``keys``, from rows that come sorted by them.

    A run that goes over the end of a batch is carried to the next one.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cuts = [*np.flatnonzero(new).tolist(), n]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for cut in cuts[:-1]:
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at, n - at))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def by_runs(df: DataFrame, parts: int, keys: list[str], order: list[str], f: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Shuffle on ``keys`` and apply ``f`` to the rows of each key, many keys to
    a Python call: what a grouped map does without its cost for each group."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            yield from f(group)

    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(go, schema)
