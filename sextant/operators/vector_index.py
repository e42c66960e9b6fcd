"""A stored index for approximate nearest neighbours by inner product.

Vectors lie in lists around trained centres; within a list, what is left of a vector
after its centre is taken off is kept as one byte for each of some groups of
coordinates.  Centres and codebooks are trained by Lloyd rounds, each an aggregation
over a bounded sample (``SAMPLE`` rows for each centre); every vector is indexed.  A
search reads the lists nearest to each query until they hold a share of all codes,
scores the codes by table look-ups, and scores the best of them exactly.

The index is three folders: ``model`` (centres, codebooks, sizes of lists), ``codes``
(blocks of at most ``BLOCK`` vectors of one list, files in order of lists) and
``vectors`` (for exact scores).  It is written once and opened by its path.

Defined cases: vectors that are null, of another width than the widest, or hold null
or non-finite numbers are not indexed, and such queries find nothing; rows with equal
ids are separate vectors; an empty table makes an index in which nothing is found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.retrieval import Kept, dot, meet, sized, top_k
from sextant.session import written

#: Training rows for each centre, rounds, most centres, and their number by the number of vectors.
SAMPLE, ROUNDS, MOST_LISTS, LISTS_BY_ROOT = 64, 6, 16_384, 4.0
#: Coordinates that share a byte, values of it, vectors of a block at most.
GROUP, CODES, BLOCK = 4, 256, 4096
#: Share of all codes a query reads at most; candidates scored exactly.
SHARE, SHORTLIST = 0.45, 100
#: Rows that meet all centres at a time; numbers of the tables of queries that meet the
#: codes together, and bytes of the codes they meet in one task.
PIECE, TABLES, PART_BYTES = 512, 4 << 20, 256 << 20

#: Stands for a null id in blocks.
NO_ID = -(1 << 63)


def usable(vectors: DataFrame, id_col: str, vector_col: str, width: int | None = None) -> DataFrame:
    """(id, v) of vectors of finite numbers (of ``width``)."""
    v = F.col(vector_col) if dict(vectors.dtypes)[vector_col] == "array<float>" else F.transform(F.col(vector_col), lambda x: x.cast("float"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return rows.where(F.size("v") == width) if width else rows


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; ``PIECE`` rows meet all centres at a time."""
    square = (centres**2).sum(1)
    return np.concatenate([np.empty(0, np.int64), *((square - 2 * x[at : at + PIECE] @ centres.T).argmin(1) for at in range(0, len(x), PIECE))])


def _grouped(x: np.ndarray, groups: int) -> np.ndarray:
    """Rows as (row, group, coordinate), with zeros where groups do not fill up."""
    pad = -x.shape[1] % groups
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), groups, -1)


def _sums(g: np.ndarray, c: np.ndarray, n: np.ndarray, total: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of (group, centre, count, packed sum), many to a batch."""
    for at in range(0, len(g), BLOCK):
        some = slice(at, at + BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(g[some], pa.int32()), pa.array(c[some], pa.int32()), pa.array(n[some], pa.int64()), pa.array(total[some], pa.binary())], ["g", "c", "n", "total"])


def lloyd(rows: DataFrame, centres: np.ndarray, groups: int, rounds: int) -> np.ndarray:
    """Rounds of moving centres to the means of the rows (v) nearest to them, for each
    group of coordinates by itself; ``centres`` is (group, centre, coordinate).  A task
    adds up what it sees of each centre; sums move packed, a row for each centre."""
    for _ in range(rounds):
        box = rows.sparkSession.sparkContext.broadcast(centres)  # bounded by the numbers of centres

        def add(batches: Iterator[pa.RecordBatch], box=box) -> Iterator[pa.RecordBatch]:
            now = box.value
            total, n = np.zeros(now.shape), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, PIECE):
                    v = batch.column(0).slice(at, PIECE)
                    parts = _grouped(_matrix(v, len(v[0])).astype(np.float64), groups)
                    for g in range(groups):
                        of = nearest(parts[:, g], now[g])
                        order = np.argsort(of, kind="stable")
                        own, first = np.unique(of[order], return_index=True)
                        total[g, own] += np.add.reduceat(parts[order, g], first)
                        n[g, own] += np.diff(np.append(first, len(of)))
            g, c = np.nonzero(n)
            yield from _sums(g, c, n[g, c], [total[i, j].tobytes() for i, j in zip(g, c, strict=True)])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], list] = {}
            for batch in batches:
                for g, c, n, total in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    of = sums.setdefault((g, c), [0, 0.0])
                    of[0] += n
                    of[1] = of[1] + np.frombuffer(total)
            g, c = np.array(list(sums), np.int64).reshape(-1, 2).T
            yield from _sums(g, c, np.array([n for n, _ in sums.values()], np.int64), [total.tobytes() for _, total in sums.values()])

        schema = "g int, c int, n bigint, total binary"
        moved = centres.copy()
        sums = rows.select("v").mapInArrow(add, schema).repartition("g", "c").mapInArrow(merge, schema).toArrow()  # a packed row for each centre
        for g, c, n, total in zip(*(x.to_pylist() for x in sums.columns), strict=True):
            moved[g, c] = np.frombuffer(total) / n
        box.unpersist()
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, rounds: int = ROUNDS, width: int | None = None) -> str:
    """Write an index of ``vectors`` to ``path``; if their ``width`` is known, they are
    computed once only."""
    spark = vectors.sparkSession
    size = width or usable(vectors, id_col, vector_col).agg(F.max(F.size("v")).alias("width")).collect()[0].width or 0  # one row
    rows = usable(vectors, id_col, vector_col, size or 1)
    rows.write.parquet(f"{path}/vectors")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/vectors")
    n = rows.count()
    size = size if n else 0
    lists = max(1, min(n, MOST_LISTS, lists or round(LISTS_BY_ROOT * n**0.5)))
    groups = max(1, -(-size // GROUP))
    draw = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) / float(1 << 30)
    learn = written(rows.where(draw < min(1.0, 2 * SAMPLE * max(lists, CODES) / max(n, 1))).dropDuplicates(["v"]).select("v"), "learn")
    seeds = learn.orderBy(F.xxhash64("v", F.lit(5))).limit(max(lists, CODES)).toArrow()["v"].combine_chunks()  # no more than there are centres
    if len(seeds):
        seeds = _matrix(seeds, size).astype(np.float64)
        coarse = lloyd(learn, seeds[None, :lists], 1, rounds)[0]
        centres = spark.sparkContext.broadcast(coarse)

        def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(0), size).astype(np.float64)
                x -= centres.value[nearest(x, centres.value)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, size), pa.int32()), pa.array(x.ravel()))], ["v"])

        left = _grouped(seeds - coarse[nearest(seeds, coarse)], groups).transpose(1, 0, 2)[:, :CODES]
        books = lloyd(written(learn.mapInArrow(leave, "v array<double>"), "left"), left, groups, rounds)
    else:
        coarse, books = np.zeros((1, 1)), np.zeros((1, 1, 1))
    box = spark.sparkContext.broadcast((coarse, books))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, books = box.value
        for batch in batches:
            x = _matrix(batch.column(1), coarse.shape[1]).astype(np.float64)
            of = nearest(x, coarse)
            parts = _grouped(x - coarse[of], len(books))
            codes = np.stack([nearest(parts[:, g], books[g]) for g in range(len(books))], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "id", "code"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                while a < b:
                    if held and (held[0].column(0)[0].as_py() != int(of[a]) or sum(h.num_rows for h in held) == BLOCK):
                        yield _block(held)
                        held = []
                    take = min(b - a, BLOCK - sum(h.num_rows for h in held))
                    held.append(batch.slice(a, take))
                    a += take
        if held:
            yield _block(held)

    coded = rows.mapInArrow(encode, "list int, id bigint, code binary")
    # Ranges of list and id: a list that has a third of all vectors is many ranges.
    parts = max(spark.sparkContext.defaultParallelism, min(n // 200_000, 4096))
    dealt = coded.repartitionByRange(parts, "list", "id").sortWithinPartitions("list", "id")
    dealt.mapInArrow(pack, "list int, n int, ids binary, codes binary").write.parquet(f"{path}/codes")
    counts = np.zeros(len(coarse), np.int64)
    for r in spark.read.parquet(f"{path}/codes").groupBy("list").agg(F.sum("n").alias("n")).collect():  # a row for each centre
        counts[r["list"]] = r.n
    model = [(size, n, len(coarse), groups, coarse.astype(np.float64).tobytes(), books.astype(np.float64).tobytes(), counts.tobytes())]
    spark.createDataFrame(model, "width int, n bigint, lists int, groups int, coarse binary, books binary, sizes binary").coalesce(1).write.parquet(f"{path}/model")
    return path


def _block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(held)
    ids = whole["id"].fill_null(NO_ID).to_numpy()
    return pa.RecordBatch.from_pydict({"list": [whole["list"][0].as_py()], "n": [len(ids)], "ids": [ids.tobytes()], "codes": [b"".join(whole["code"].to_pylist())]}, pa.schema([("list", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary())]))


class Index:
    """An index that was written to ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        r = spark.read.parquet(f"{path}/model").collect()[0]  # one row
        self.width, self.n = r.width, r.n
        self.coarse = np.frombuffer(r.coarse).reshape(r.lists, -1)
        self.books = np.frombuffer(r.books).reshape(r.groups, -1, self._per_group(r)) if r.width else np.zeros((1, 1, 1))
        self.sizes = np.frombuffer(r.sizes, np.int64)

    @staticmethod
    def _per_group(r) -> int:
        return -(-r.width // r.groups)

    def _read(self, score: np.ndarray, share: float) -> list[np.ndarray]:
        """For each row of scores of centres the lists that a query reads, best first, as
        long as they hold no more than ``share`` of all codes (one at least)."""
        out = []
        for lists in np.argsort(-score, 1, kind="stable"):
            some = lists[: max(1, int(np.searchsorted(np.cumsum(self.sizes[lists]), share * self.n, "right")))]
            out.append(some[self.sizes[some] > 0])
        return out

    def candidates(self, queries: DataFrame, share: float = SHARE, shortlist: int = SHORTLIST) -> DataFrame:
        """(query_id, id) of the best ``shortlist`` of each query (query_id, q) by codes.
        Groups of queries meet the blocks of codes, each in some tasks; a task holds a
        group with its tables, lets the blocks pass and hands on the best it saw."""
        chunk = max(1, TABLES // (len(self.books) * self.books.shape[1]))
        many = max(1, -(-queries.count() // chunk))
        codes = self.spark.read.parquet(f"{self.path}/codes")
        parts = max(1, min(-(-self.n // PIECE), -(-4 * self.spark.sparkContext.defaultParallelism // many)), -(-self.n * (8 + len(self.books)) // PART_BYTES))
        box = self.spark.sparkContext.broadcast((self.coarse, self.sizes, self.books, self.n))  # as large as the model

        class Group:
            def __init__(self, batch: pa.RecordBatch) -> None:
                coarse, sizes, books, n = box.value
                index = Index.__new__(Index)
                index.sizes, index.n = sizes, n
                self.ids, q = batch.column("query_id"), _matrix(batch.column("q"), coarse.shape[1]).astype(np.float64)
                self.base = q @ coarse.T
                self.reads = np.zeros(self.base.shape, bool)
                for i, lists in enumerate(index._read(self.base, share)):
                    self.reads[i, lists] = True
                self.tables = np.ascontiguousarray(np.einsum("qgd,gcd->gcq", _grouped(q, len(books)), books))
                self.kept = Kept(len(q), shortlist)

            def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                for of, ids, codes in zip(batch.column("list"), batch.column("ids"), batch.column("codes"), strict=True):
                    asked = np.flatnonzero(self.reads[:, of.as_py()])
                    if not len(asked):
                        continue
                    ids = np.frombuffer(ids.as_buffer(), np.int64)
                    codes = np.frombuffer(codes.as_buffer(), np.uint8).reshape(len(ids), -1)
                    base, whole = self.base[:, of.as_py()], 4 * len(asked) >= len(self.ids)
                    if whole:  # whole rows of the tables are faster to read than most of them
                        base, asked = np.where(self.reads[:, of.as_py()], base, -np.inf), np.arange(len(self.ids))
                    for at in range(0, len(ids), PIECE):
                        some = codes[at : at + PIECE]
                        score = np.broadcast_to(base[asked], (len(some), len(asked))).copy()
                        for g, table in enumerate(self.tables):
                            score += table[some[:, g]] if whole else table[some[:, g, None], asked]
                        i, j = np.nonzero((score >= self.kept.least[asked]) & (score > -np.inf))
                        self.kept.add(asked[j], ids[at + i], score[i, j], score[i, j])
                return iter(())

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from meet(batches, Group, Group.take, lambda now: iter([now.kept.rows(now.ids, ["query_id", "id", "score"])]))

        copies = lambda df, n: df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
        asked = copies(queries, parts).select((F.pmod(F.xxhash64("query_id"), F.lit(many)) * parts + F.col("copy")).alias("block"), F.lit(0).alias("side"), "query_id", "q", nothing("int", "list"), nothing("binary", "ids"), nothing("binary", "codes"))
        read = copies(codes, many).select((F.pmod(F.xxhash64("list", "ids"), F.lit(parts)) + parts * F.col("copy")).alias("block"), F.lit(1).alias("side"), nothing("bigint", "query_id"), nothing("array<float>", "q"), "list", "ids", "codes")
        met = asked.unionByName(read).repartition(many * parts, "block").sortWithinPartitions("block", "side")
        return top_k(met.mapInArrow(go, "query_id bigint, id bigint, score double"), shortlist, "id", digits=12).select("query_id", "id")

    def search(self, queries: DataFrame, k: int, share: float = SHARE, shortlist: int = SHORTLIST, id_col: str = "query_id", vector_col: str = "q") -> DataFrame:
        """query_id, vec_id, score, rank: the best ``k`` of each query, scores exact."""
        asked = written(usable(queries, id_col, vector_col, self.width or 1).select(F.col("id").alias("query_id"), F.col("v").alias("q")), "asked")
        near = written(self.candidates(asked, share, max(k, shortlist)), "near")
        vectors = self.spark.read.parquet(f"{self.path}/vectors").withColumn("id", F.coalesce("id", F.lit(NO_ID)))
        exact = vectors.join(sized(near), "id").join(sized(asked), "query_id").select("query_id", F.nullif("id", F.lit(NO_ID)).alias("vec_id"), dot(F.col("q"), F.col("v")).alias("score"))
        return top_k(exact, k, "vec_id")

    def reads(self, queries: DataFrame, share: float = SHARE) -> DataFrame:
        """(query_id, share_read): what part of all codes each query (query_id, q) reads."""
        box = self.spark.sparkContext.broadcast((self.coarse, self.sizes, self.n))

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coarse, sizes, n = box.value
            index = Index.__new__(Index)
            index.sizes, index.n = sizes, n
            for batch in batches:
                for at in range(0, batch.num_rows, PIECE):
                    part = batch.slice(at, PIECE)
                    lists = index._read(_matrix(part.column("q"), coarse.shape[1]).astype(np.float64) @ coarse.T, share)
                    yield pa.RecordBatch.from_arrays([part.column("query_id"), pa.array([int(sizes[x].sum()) / max(n, 1) for x in lists], pa.float64())], ["query_id", "share_read"])

        return queries.select("query_id", "q").mapInArrow(go, "query_id bigint, share_read double")
