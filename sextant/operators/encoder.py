"""Vectors of texts by signed hashing, and search that joins them with BM25.

A text's features are its words and pairs of neighbouring words, by 64-bit hashes made
in the JVM for words and by the same function in tasks for pairs.  Each has a place and a sign in a vector of fixed width, and a weight: the
logarithm of how often it occurs, times the rarity of its bucket, of which there are so
many that their numbers are a bounded table (``BUCKETS``).  Vectors have length 1, so
that inner products are similarities.

Defined cases: null texts, and texts without words, have no vector; a corpus without
texts gives each bucket the same weight; rows keep their ids, repeated or null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.functions.text import phrase_tokens

WIDTH, BUCKETS = 384, 1 << 18
#: Buckets whose counts move together; texts whose vectors are made at a time.
SLICE, PIECE = 1 << 12, 1024
U = np.uint64
#: The constants of xxHash.
_P = tuple(U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: What is added to a rank before two lists of hits are joined by the sums of inverses.
FUSED_AT = 60


def words_of(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    return F.transform(phrase_tokens(text), lambda x: F.xxhash64(x))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def _hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    h = (_turned(x * _P[1], 31) * _P[0]) ^ (seed + _P[4] + U(8))
    h = _turned(h, 27) * _P[0] + _P[3]
    h = (h ^ (h >> U(33))) * _P[1]
    h = (h ^ (h >> U(29))) * _P[2]
    return h ^ (h >> U(32))


def features(words: np.ndarray) -> np.ndarray:
    """Hashes of a text's words and of their neighbouring pairs, which are those that
    ``F.xxhash64`` gives for two of them."""
    x = words.view(np.uint64)
    return np.concatenate([words, _hash_long(x[1:], _hash_long(x[:-1], U(42))).view(np.int64)])


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the words of each text of a batch; none for a null one."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        yield flat[lo:hi]


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """ln(1 + n / (1 + texts with a feature of the bucket)), for each bucket.  Tasks
    count, and their counts are added up in slices."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += batch.num_rows
            for words in texts(batch.column(0)):
                out[np.unique(features(words) % BUCKETS)] += 1
        if n:
            yield _slices([-1, *range(0, BUCKETS, SLICE)], [np.array([n]), *(out[at : at + SLICE] for at in range(0, BUCKETS, SLICE))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(packed, np.int64)
        yield _slices(list(sums), list(sums.values()))

    rows = docs.where(F.col(text_col).isNotNull()).select(words_of(F.col(text_col)).alias("w"))
    n, out = 0, np.zeros(BUCKETS)
    counts = rows.mapInArrow(count, "at int, n binary").repartition("at").mapInArrow(add, "at int, n binary").toArrow()  # BUCKETS numbers
    for at, packed in zip(*(c.to_pylist() for c in counts.columns), strict=True):
        if at < 0:
            n = int(np.frombuffer(packed, np.int64)[0])
        else:
            out[at : at + SLICE] = np.frombuffer(packed, np.int64)
    return np.log(1 + max(n, 1) / (1 + out))


def _slices(at: list[int], counts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], ["at", "n"])


def vectors_of(lists: pa.Array, weights: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A row for each text, given the hashes of its words; a text at a time, so that
    what is sorted is short."""
    out = np.zeros((len(lists), width))
    for row, words in zip(out, texts(lists), strict=True):
        hashes, count = np.unique(features(words), return_counts=True)
        bits = hashes.view(np.uint64)
        place = ((bits >> U(20)) % U(width)).astype(np.int64)
        sign = np.where(bits >> U(63), -1.0, 1.0)
        row += np.bincount(place, sign * (1 + np.log(count)) * weights[hashes % BUCKETS], width)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def encode(texts: DataFrame, weights: np.ndarray, id_col: str, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, v): the vector of each text that has words."""
    box = texts.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(1)), 0))  # a filter on rows would take texts apart once more
            for at in range(0, batch.num_rows, PIECE):
                some = batch.slice(at, PIECE)
                v = vectors_of(some.column(1), box.value, width)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, width), pa.int32()), pa.array(v.ravel(), pa.float32()))], ["id", "v"])

    return texts.select(F.col(id_col).cast("bigint").alias("id"), words_of(F.col(text_col)).alias("w")).mapInArrow(go, "id bigint, v array<float>")


def fused(k: int, *hits: DataFrame) -> DataFrame:
    """query_id, doc_id, score, rank: lists of hits (query_id, doc_id, rank) joined by the
    sum of 1 / (``FUSED_AT`` + rank); ties by doc_id."""
    parts = [h.select("query_id", "doc_id", (1.0 / (FUSED_AT + F.col("rank"))).alias("s")) for h in hits]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    total = both.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
