"""Exact top-k by inner product.

Vectors are rotated onto the principal axes of the whole table, so that the
first few coordinates carry most of a product, and candidates lie in blocks of
descending length, scanned in that order.  A query starts with the k-th best
score among the longest vectors of the table as its threshold, and meets no
block whose longest vector cannot reach it.  A chunk of candidates ends a
query's scan when the product of lengths falls below its threshold; else partial
sums grow by ``STEP`` coordinates at a time, and after each step pairs go whose
sum plus the Cauchy-Schwarz bound of the rest falls short, with queries and
candidates that have no pair left.  What passes all steps gets an exact product.
Blocks of queries meet blocks of candidates in tasks of bounded size, and the
best k of the blocks' best k are the result.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part; shorter vectors count as padded with zeros; rows that share an id
are separate candidates, and each is left out only of its own query; a vector
without an id is a candidate and no query; ties go to the smaller id, null last; with fewer than k candidates all are returned; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.llm.base import table, written

K = 20
#: Rows of a block of queries and of a block of candidates.
QUERY_BLOCK, BLOCK = 2048, 16384
#: Longest vectors that give the first thresholds (collected: a fixed number).
HEAD = 1024
#: Coordinates by which partial sums grow, and candidates of a chunk.
STEP, CHUNK = 16, 1024
#: Stands for a null id: larger than all others.
NO_ID = np.iinfo(np.int64).max
PACKED = "vec_id bigint, is_query boolean, length double, v binary"
BEST = "uid bigint, query_id bigint, vec_id bigint, score bigint"


def packed(vectors: DataFrame, scale: float, id_col: str, vec_col: str, is_query: Column) -> DataFrame:
    """Usable vectors as packed doubles, floor(scale * component)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for i, q, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if v is None or any(x is None for x in v):
                    continue
                x = np.floor(np.array(v, float) * scale)
                if np.isfinite(x).all():
                    for to, value in zip(rows, (i, bool(q), float(np.sqrt(x @ x)), x.tobytes()), strict=True):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.bool_()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.binary())], ["vec_id", "is_query", "length", "v"])

    return vectors.select(F.col(id_col).cast("bigint").alias("id"), is_query.alias("q"), F.col(vec_col).alias("x")).mapInArrow(go, PACKED)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for row, v in zip(out, column.to_pylist(), strict=True):
        x = np.frombuffer(v)
        row[: len(x)] = x
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes of all vectors, largest first (right singular vectors)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "x"])

    gram = np.zeros((width, width))
    for r in vectors.select("v").mapInArrow(go, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # width^2 rows
        gram[r.i, r.j] = r.x
    return np.ascontiguousarray(np.linalg.eigh(gram)[1][:, ::-1])


class Scan:
    """Best k of a block of candidates for each of a block of queries."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, axes: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.q, self.own, self.axes, self.k = queries, own, axes, k
        self.length = np.sqrt((queries**2).sum(1))
        self.turned = queries @ axes
        #: Where steps end, and the length of what is left of each query there.
        self.ends = [*range(STEP, axes.shape[1], STEP), axes.shape[1]]
        self.rest = self._left(self.turned)
        #: Pairs that were looked at after each step, the first number before any.
        self.pairs = np.zeros(len(self.ends) + 1, np.int64)
        self.best = np.full((len(queries), k), -np.inf)
        self.floor = floor

    def _left(self, turned: np.ndarray) -> np.ndarray:
        """Length of what is left of each row after each step."""
        squares = np.concatenate([np.zeros((len(turned), 1)), np.cumsum(turned[:, ::-1] ** 2, 1)], 1)
        return np.sqrt(squares[:, [turned.shape[1] - e for e in self.ends]])

    def reach(self, active: np.ndarray, x: np.ndarray, other: np.ndarray, bar: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row of ``x``) that can reach the bar, by growing partial
        sums; not those of a query with itself."""
        turned = x @ self.axes
        left = self._left(turned)
        q, c = active, np.arange(len(x))
        alive = self.own[q, None] != other[None, :]
        self.pairs[0] += alive.sum()
        least = (bar - slack)[q]
        sums = np.zeros(alive.shape)
        begin = 0
        for step, end in enumerate(self.ends):
            sums += self.turned[q, begin:end] @ turned[c, begin:end].T
            begin = end
            bound = np.multiply.outer(self.rest[q, step], left[c, step])
            bound += sums
            alive &= bound >= least[:, None]
            self.pairs[step + 1] += np.count_nonzero(alive)
            rows, cols = alive.any(1), alive.any(0)
            if not rows.any():
                break
            if end < self.ends[-1] and rows.mean() * cols.mean() < 0.8:
                keep = np.ix_(rows, cols)
                q, c, least, alive, sums = q[rows], c[cols], least[rows], alive[keep], sums[keep]
        a, b = np.nonzero(alive)
        return q[a], c[b]

    def exact(self, qi: np.ndarray, x: np.ndarray, xi: np.ndarray) -> np.ndarray:
        """Products of pairs.  Doubles hold them exactly below 2^53."""
        top = (self.length.max(initial=0) * np.sqrt((x**2).sum(1)).max(initial=0)) * 1.01
        if top < 2**53:
            return np.einsum("ij,ij->i", self.q[qi], x[xi])
        return np.einsum("ij,ij->i", self.q[qi].astype(np.int64), x[xi].astype(np.int64))

    def run(self, x: np.ndarray, uid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate row, score) of all that can be among the best k."""
        length = np.sqrt((x**2).sum(1))
        order = np.argsort(-length, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        active = np.arange(len(self.q))
        for at in range(0, len(order), CHUNK):
            rows = order[at : at + CHUNK]
            bar = np.maximum(self.floor, self.best[:, 0])
            slack = 1e-6 + 1e-9 * self.length * length[rows[0]]
            active = active[(self.length * length[rows[0]] + slack >= bar)[active]]
            if not len(active):
                break
            a, b = self.reach(active, x[rows], uid[rows], bar, slack)
            for i in np.array_split(np.arange(len(a)), len(a) // 65536 + 1):
                qi, xi = a[i], rows[b[i]]
                score = self.exact(qi, x, xi)
                good = score >= np.maximum(self.floor, self.best[:, 0])[qi]
                found.append((qi[good], xi[good], score[good]))
                self._raise(qi[good], score[good].astype(float))
        if not found:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        qi, xi, score = (np.concatenate(c) for c in zip(*found, strict=True))
        good = score >= np.maximum(self.floor, self.best[:, 0])[qi]
        return qi[good], xi[good], score[good]

    def _raise(self, qi: np.ndarray, score: np.ndarray) -> None:
        """Take scores into each query's best k, smallest first."""
        order = np.lexsort((-score, qi))
        qi, score = qi[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        top = rank < self.k
        qi, score, rank = qi[top], score[top], rank[top]
        some = np.unique(qi)
        new = np.full((len(some), self.k), -np.inf)
        new[np.searchsorted(some, qi), rank] = score
        self.best[some] = np.sort(np.concatenate([self.best[some], new], 1), 1)[:, self.k :]


def best(qi: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are the k best of their query, ties to the smaller id."""
    order = np.lexsort((ids, -score, qi))
    return order[(np.arange(len(order)) - np.searchsorted(qi[order], qi[order])) < k]


def topk(vectors: DataFrame, is_query: Column, k: int = K, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for each vector that ``is_query`` marks."""
    stored = written(packed(vectors, scale, id_col, vec_col, is_query).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q"), F.coalesce(F.max(F.octet_length("v")), F.lit(0)).alias("b")).collect()[0]
    width = max(1, size.b // 8)
    axes = rotation(stored, width)
    head = stored.orderBy(F.desc("length"), "uid").limit(HEAD).select("uid", "v").collect()
    head_x = np.zeros((len(head), width))
    for row, r in zip(head_x, head, strict=True):
        x = np.frombuffer(r.v)
        row[: len(x)] = x
    head_uid = np.array([r.uid for r in head], np.int64)
    n_q, n_c = max(1, -(-size.q // QUERY_BLOCK)), max(1, -(-size.n // BLOCK))

    # Blocks of descending length; kept as a column, as parts of a shuffle have no lasting numbers.
    stored = written(stored.repartitionByRange(n_c, F.desc("length"), "uid").withColumn("cb", F.spark_partition_id()), "blocks")
    tops = sorted(stored.groupBy("cb").agg(F.max("length").alias("top")).collect())  # a row for each block
    names, top = [r.cb for r in tops], np.array([r.top for r in tops])

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, uid = matrix(batch.column("v"), width), batch.column("uid").to_numpy()
            score = np.where(uid[:, None] == head_uid[None, :], -np.inf, q @ head_x.T)
            bar = np.partition(score, -k, 1)[:, -k] if len(head_uid) >= k else np.full(len(q), -np.inf)
            bar = bar - 1e-6 - 1e-9 * np.abs(bar, where=np.isfinite(bar), out=np.zeros_like(bar))
            most = np.multiply.outer(np.sqrt((q**2).sum(1)), top) * (1 + 1e-9) + 1e-6
            met = [[n for n, ok in zip(names, row, strict=True) if ok] for row in (most >= bar[:, None]).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bar), pa.array(met, pa.list_(pa.int32()))], [*batch.schema.names, "floor", "met"])

    asked = stored.where("is_query").select("uid", "vec_id", "v").mapInArrow(floors, "uid bigint, vec_id bigint, v binary, floor double, met array<int>")
    left = asked.withColumn("qb", F.pmod(F.xxhash64("uid"), F.lit(n_q)).cast("int")).withColumn("cb", F.explode("met")).drop("met")
    right = stored.select("uid", "vec_id", "v", "cb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    empty = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]).empty_table()

    def scan(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return empty
        uid, own = candidates["uid"].to_numpy(), queries["uid"].to_numpy()
        ids, names = candidates["vec_id"].fill_null(NO_ID).to_numpy(), queries["vec_id"].to_numpy()
        qi, xi, score = Scan(matrix(queries["v"], width), own, axes, k, queries["floor"].to_numpy()).run(matrix(candidates["v"], width), uid)
        top = best(qi, ids[xi], score, k)
        qi, xi = qi[top], xi[top]
        return pa.table([pa.array(own[qi]), pa.array(names[qi]), pa.array(ids[xi], mask=ids[xi] == NO_ID), pa.array(score[top].astype(np.int64))], schema=empty.schema)

    some = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(scan, BEST)
    rank = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract ``op10``: every row whose id 20 divides, against all rows."""
    return topk(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
