"""Retrieval as relational algebra: an inverted index of tables, BM25, dense
scores, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.functions.text import phrase_tokens
from sextant.session import written

K1, B = 0.9, 0.4
#: Sides of up to so many rows are broadcast if a row is a few numbers or words;
#: larger ones shuffle.
SMALL = 100_000
#: Queries of a block, numbers of the vectors it meets in a task, and scores held at a time.
QUERY_BLOCK, BLOCK_NUMBERS, TILE = 4096, 1 << 24, 1 << 20


def sized(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = 8 << 20) -> DataFrame:
    """term, doc_id, tf.  Texts are dealt by document, so that they move and not their
    words, in parts of about ``piece`` bytes, which bound the counts that a task holds."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    size = base.agg(F.sum(F.octet_length("t"))).collect()[0][0] or 0  # one row
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, min(65_536, size // piece))
    exploded = base.repartition(parts, "doc_id").select("doc_id", F.explode(phrase_tokens(F.col("t"))).alias("term"))
    return exploded.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc_id", "tf")


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.size(phrase_tokens(F.col(text_col))).cast("bigint").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def _counted(queries: DataFrame, docs: DataFrame, query_id: str, text_col: str, doc_id: str) -> tuple[DataFrame, DataFrame, int, float]:
    """(query_id, word, qtf, idf) that are asked; (doc_id, dl, words, tfs) of every
    document, a row for each, cut to the queries' words; number of documents and
    average length.

    Words are numbers from a table of the queries' distinct ones, which is broadcast if
    it is small; document frequencies come from the cut postings.  Queries without
    words have no hits."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(phrase_tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = written(asked, "asked")
    known = written(asked.select("term").distinct().select(F.col("term").alias("known"), F.monotonically_increasing_id().alias("word")), "known")
    few = known.count() <= SMALL
    # Dealt by document once: counts by (document, term) stay where they are.  Words
    # nobody asks for are counted under a null one, of which each document has one,
    # so that the corpus is tokenised once for postings, lengths and statistics.
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("t")).repartition("doc_id").select("doc_id", F.coalesce(phrase_tokens(F.col("t")), F.array().cast("array<string>")).alias("w"))
    # The outer form keeps Catalyst from tokenising twice for a filter.
    terms = base.select("doc_id", F.size("w").alias("dl"), F.explode_outer(F.concat("w", F.array(F.lit(None).cast("string")))).alias("term"))
    if few:
        found = terms.join(F.broadcast(known), F.col("term") == F.col("known"), "left").groupBy("doc_id", "word").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max("dl").alias("dl"))
    else:  # what moves is counted first
        found = terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max("dl").alias("dl")).join(known, F.col("term") == F.col("known"), "left").where("word IS NOT NULL OR term IS NULL")
    packed = found.groupBy("doc_id").agg(F.max("dl").alias("dl"), F.collect_list("word").alias("words"), F.collect_list(F.when(F.col("word").isNotNull(), F.col("tf"))).alias("tfs"))
    counted = written(packed, "postings")
    whole = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).collect()[0]  # one row
    frequency = counted.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(whole.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    small = F.broadcast if few else lambda df: df
    told = small(known.join(frequency, "word").select("known", "word", idf.alias("idf")))
    return asked.join(told, F.col("term") == F.col("known")).select("query_id", "word", "qtf", "idf"), counted, whole.n, whole.avgdl or 1.0


def bm25(queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B, query_id: str = "query_id", text_col: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """query_id, doc_id, score of every pair that shares a term."""
    asked, counted, _, avgdl = _counted(queries, docs, query_id, text_col, doc_id)
    postings = counted.select("doc_id", "dl", F.explode(F.arrays_zip("words", "tfs")).alias("p")).select("doc_id", "dl", F.col("p.words").alias("word"), F.col("p.tfs").alias("tf"))
    weight = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return postings.join(sized(asked), "word").groupBy("query_id", "doc_id").agg(F.sum(weight * F.col("qtf")).alias("score"))


class _Words:
    """The ``k`` best documents of each query of a block so far; a document comes as
    one row of its words and their counts."""

    def __init__(self, batch: pa.RecordBatch, k: int, k1: float, b: float, avgdl: float) -> None:
        self.ids, self.kept, self.k, self.terms = batch.column("query_id"), Kept(batch.num_rows, k), k, (k1, b, avgdl)
        lists = batch.column("terms")
        self.owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        words, idf, self.times = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("word", "idf", "qtf"))
        self.words, first, self.word = np.unique(words, return_index=True, return_inverse=True)
        self.idf = idf[first]
        self.held, self.n = [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        """Some documents, whose words hold about ``TILE`` numbers at most at a time, or
        one document's."""
        ends = np.cumsum(batch.column("words").value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TILE, "right")))
            self._add(batch.slice(at, to - at))
            at = to

    def _add(self, batch: pa.RecordBatch) -> None:
        lists, tf = batch.column("words"), batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
        word = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        place = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        use = np.flatnonzero(self.words[place] == word)
        place, tf, row = place[use], tf[use], row[use]
        k1, b, avgdl = self.terms
        weight = self.idf[place] * tf / (tf + k1 * (1 - b + b * batch.column("dl").to_numpy()[row] / avgdl))
        self.held.append((place, batch.column("doc_id").to_numpy()[row], weight))
        self.n += len(place)
        if self.n > TILE:
            self.score()

    def score(self) -> None:
        """Score the documents that are held, each of them whole."""
        if not self.held:
            return
        place, ids, weight = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        docs, doc = np.unique(ids, return_inverse=True)
        order = np.argsort(place, kind="stable")
        doc, weight = doc[order], weight[order]
        start = np.searchsorted(place[order], np.arange(len(self.words) + 1))
        count = np.diff(start)
        queries, step = np.arange(self.kept.n), max(1, 2 * TILE // max(1, len(docs)))
        for at in range(0, self.kept.n if len(docs) else 0, step):
            q = queries[at : at + step]
            lo, hi = np.searchsorted(self.owner, [q[0], q[-1] + 1])
            word, times, row = self.word[lo:hi], self.times[lo:hi], self.owner[lo:hi] - at
            n = count[word]
            one = np.repeat(start[word] - np.cumsum(n) + n, n) + np.arange(n.sum())  # where each word's postings are
            score = np.bincount(np.repeat(row, n) * len(docs) + doc[one], np.repeat(times, n) * weight[one], len(q) * len(docs)).reshape(len(q), len(docs))
            least = self.kept.least[q]
            fresh = np.isinf(least)
            if len(docs) > self.k and fresh.any():  # these documents' own k-th score is a bound as well
                least[fresh] = np.partition(score[fresh], len(docs) - self.k, axis=1)[:, len(docs) - self.k]
            i, j = np.nonzero((score >= (least - 2e-6)[:, None]) & (score > 0))
            self.kept.add(q[i], docs[j], score[i, j], rounded(score[i, j]))

    def rows(self) -> pa.RecordBatch:
        self.score()
        return self.kept.rows(self.ids, ["query_id", "doc_id", "score"])


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, k1: float = K1, b: float = B, query_id: str = "query_id", text_col: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The k best of ``bm25`` for each query, with rank: blocks of queries meet blocks of
    documents, which move packed, and a task hands on the best of its block, so that
    pairs never move.  ``doc_id`` is a whole number; a null one comes first among ties."""
    asked, counted, n, avgdl = _counted(queries, docs, query_id, text_col, doc_id)
    lists = written(asked.groupBy("query_id").agg(F.collect_list(F.struct("word", "qtf", "idf")).alias("terms")), "lists")
    many = max(1, -(-lists.count() // max(256, min(1 << 18, (1 << 20) // k))))
    words = counted.agg(F.sum(F.size("words"))).collect()[0][0] or 0  # one row
    parts = max(1, -(-words // (1 << 23)), min(n, -(-4 * docs.sparkSession.sparkContext.defaultParallelism // many)))
    copies = lambda df, n: df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    nothing = lambda of, name: F.lit(None).cast(of.schema[name].dataType).alias(name)
    no_id = F.lit(-(1 << 63))
    counted = counted.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), no_id)).where(F.size("words") > 0)
    left = copies(lists, parts).select((F.pmod(F.xxhash64("query_id"), F.lit(many)) * parts + F.col("copy")).alias("block"), F.lit(0).alias("side"), "query_id", "terms", *(nothing(counted, c) for c in counted.columns))
    right = copies(counted, many).select((F.pmod(F.xxhash64("doc_id"), F.lit(parts)) + parts * F.col("copy")).alias("block"), F.lit(1).alias("side"), nothing(lists, "query_id"), nothing(lists, "terms"), *counted.columns)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meet(batches, lambda x: _Words(x, k, k1, b, avgdl), lambda now, x: iter(now.add(x) or ()), lambda now: iter([now.rows()]))

    met = left.unionByName(right).repartition(many * parts, "block").sortWithinPartitions("block", "side")
    found = met.mapInArrow(go, f"query_id {lists.schema['query_id'].dataType.simpleString()}, doc_id bigint, score double")
    return top_k(found.withColumn("doc_id", F.nullif("doc_id", no_id)), k, "doc_id")


def top_k(hits: DataFrame, k: int, *ties: str, partition: str = "query_id", digits: int = 6) -> DataFrame:
    """The k best of each partition by score, with rank from 1."""
    rounded = hits.withColumn("score", F.round("score", digits))
    order = W.partitionBy(partition).orderBy(F.desc("score"), *ties)
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Finite numbers as ``F.round`` rounds them: halves of their shortest decimals go
    away from zero."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled + 0.5)
    close = np.flatnonzero((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3) | (scaled > 1e12))
    out = np.copysign(whole / 10.0**digits, x)
    for i in close.tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if abs(x[i]) < 1e15 else x[i]
    return out


class _Block:
    """Queries that vectors meet as they come: (id, numbers, group) of all."""

    def __init__(self, batch: pa.RecordBatch, width: int) -> None:
        self.ids, self.q = batch.column("query_id"), _numbers(batch, width)
        self.groups: dict = {}
        for i, w in enumerate(batch.column("w").to_pylist()):
            self.groups.setdefault(w, []).append(i)
        self.groups = {w: np.array(of) for w, of in self.groups.items()}

    def shared(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of vectors that have a group in common."""
        w = batch.column("w").dictionary_encode() if batch.column("w").null_count < batch.num_rows else None
        if w is None:
            yield self.groups.get(None, np.empty(0, np.int64)), np.arange(batch.num_rows)
            return
        of = w.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(w.dictionary) + 1))
        for code, group in enumerate(w.dictionary.to_pylist()):
            if group in self.groups:
                yield self.groups[group], order[cuts[code] : cuts[code + 1]]

    def pairs(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Scores of all pairs, each a sum in the order of the coordinates."""
        ids, v = batch.column("vec_id"), _numbers(batch, self.q.shape[1])
        for qi, vi in self.shared(batch):
            step = max(1, TILE // max(1, len(vi)))
            for at in range(0, len(qi), step):
                some = qi[at : at + step]
                q, total, part = self.q[some], np.zeros((len(some), len(vi))), np.empty((len(some), len(vi)))
                for d in range(self.q.shape[1]):
                    np.multiply(q[:, d, None], v[vi, d][None, :], out=part)
                    total += part
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(np.repeat(some, len(vi)))), ids.take(pa.array(np.tile(vi, len(some)))), pa.array(total.ravel())], ["query_id", "vec_id", "score"])


class Kept:
    """The ``k`` best of each of ``n`` queries so far, by key, then by id; ``least`` is the
    key that a query's next one must reach."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k, self.least = n, k, np.full(n, -np.inf)
        self.held, self.new, self.waiting = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)), [], 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        self.new.append((query, ids, score, key))
        self.waiting += len(query)
        if self.waiting > max(1 << 14, len(self.held[0]) // 4):
            self.compact()

    def compact(self) -> None:
        columns = [np.concatenate(x) for x in zip(self.held, *self.new, strict=True)]
        order = np.lexsort((columns[1], -columns[3], columns[0]))
        query = columns[0][order]
        kept = np.arange(len(query)) - np.searchsorted(query, np.arange(self.n))[query] < self.k
        self.held, self.new, self.waiting = tuple(x[order[kept]] for x in columns), [], 0
        counts = np.bincount(self.held[0], minlength=self.n)
        full = np.flatnonzero(counts == self.k)
        self.least[full] = self.held[3][(np.cumsum(counts) - 1)[full]]

    def rows(self, query_ids: pa.Array, names: list[str]) -> pa.RecordBatch:
        self.compact()
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.held[0])), pa.array(self.held[1]), pa.array(self.held[2])], names)


class _Best(_Block):
    """The ``k`` best vectors of each query so far, by rounded score, then by id.

    Products of matrices leave out what is below a query's k-th score by more than
    they can be wrong; the others are scored by sums in the order of the coordinates,
    as pairs are, so that the result does not depend on how products are made."""

    def __init__(self, batch: pa.RecordBatch, width: int, k: int) -> None:
        super().__init__(batch, width)
        self.kept, self.length = Kept(len(self.q), k), np.linalg.norm(self.q, axis=1)

    def add(self, batch: pa.RecordBatch) -> None:
        ids, v = batch.column("vec_id").to_numpy(zero_copy_only=False), _numbers(batch, self.q.shape[1])
        step, k = max(1, TILE // max(1, len(self.q))), self.kept.k
        for at in range(0, len(v), step):
            tile = v[at : at + step]
            score = self.q @ tile.T
            wrong = 2e-6 + 1e-12 * self.length * np.linalg.norm(tile, axis=1).max()
            least = self.kept.least
            fresh = np.isinf(least)
            if len(tile) > k and fresh.any():  # the tile's own k-th score is a bound as well
                least = least.copy()
                least[fresh] = np.partition(score[fresh], len(tile) - k, axis=1)[:, len(tile) - k] - wrong[fresh]
            qi, vi = np.nonzero(score >= (least - wrong)[:, None])
            for cut in range(0, len(qi), TILE // 4):
                a, b = qi[cut : cut + TILE // 4], vi[cut : cut + TILE // 4]
                total = np.zeros(len(a))
                for d in range(self.q.shape[1]):
                    total += self.q[a, d] * tile[b, d]
                self.kept.add(a, ids[at + b], total, rounded(total))

    def rows(self) -> pa.RecordBatch:
        return self.kept.rows(self.ids, ["query_id", "vec_id", "score"])


def _numbers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)


def meet[T](batches: Iterator[pa.RecordBatch], block: Callable[[pa.RecordBatch], T], take: Callable[[T, pa.RecordBatch], Iterator[pa.RecordBatch]], end: Callable[[T], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries and the vectors behind each, from rows sorted by (block, side)."""
    asked: list[pa.RecordBatch] = []
    now, at = None, None
    for batch in batches:
        key = np.stack([batch.column("block").to_numpy(), batch.column("side").to_numpy()])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            number, side, part = int(key[0, a]), int(key[1, a]), batch.slice(a, b - a)
            if number != at:
                if now is not None:
                    yield from end(now)
                asked, now, at = [], None, number
            if side == 0:
                asked.append(part)
                continue
            if now is None and asked:
                now, asked = block(pa.Table.from_batches(asked).combine_chunks().to_batches()[0]), []
            if now is not None:
                yield from take(now, part)
    if now is not None:
        yield from end(now)


def _dense(queries: DataFrame, vectors: DataFrame, k: int | None, within: str | None) -> DataFrame:
    """query_id, vec_id, score: pairs of blocks of queries and blocks of vectors, each in
    one task, which holds the queries and lets the vectors pass.  Rows that are null,
    not finite or of another width than the widest are scored one by one."""
    finite = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    group = lambda df: df.withColumn("w", F.col(within) if within else F.lit(None).cast("int"))
    q, v = group(queries).select("query_id", "q", "w"), group(vectors).select("vec_id", "embedding", "w")
    if within:
        q, v = q.where("w IS NOT NULL"), v.where("w IS NOT NULL")
    width = v.where(finite("embedding")).agg(F.max(F.size("embedding")).alias("n")).collect()[0].n or 0  # one row
    plain_q, plain_v = (F.col(i).isNotNull() & finite(c) & (F.size(c) == width) & F.lit(width > 0) for i, c in (("query_id", "q"), ("vec_id", "embedding")))
    n_q, odd_q = q.agg(F.count_if(plain_q), F.count_if(~F.coalesce(plain_q, F.lit(False)))).collect()[0]  # one row
    n_v, odd_v = v.agg(F.count_if(plain_v), F.count_if(~F.coalesce(plain_v, F.lit(False)))).collect()[0]  # one row
    many = max(1, -(-n_q // QUERY_BLOCK))
    parts = max(1, -(-n_v * width // BLOCK_NUMBERS), min(n_v, -(-4 * vectors.sparkSession.sparkContext.defaultParallelism // many)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    copies = lambda df, n: df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    asked = copies(q.where(plain_q), parts).select((own("query_id", many) * parts + F.col("copy")).alias("block"), F.lit(0).alias("side"), "query_id", F.lit(None).cast(v.schema["vec_id"].dataType).alias("vec_id"), F.col("q").alias("v"), "w")
    read = copies(v.where(plain_v), many).select((own("vec_id", parts) + parts * F.col("copy")).alias("block"), F.lit(1).alias("side"), F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"), "vec_id", F.col("embedding").alias("v"), "w")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if k is None:
            yield from meet(batches, lambda b: _Block(b, width), lambda now, b: now.pairs(b), lambda now: iter(()))
        else:
            yield from meet(batches, lambda b: _Best(b, width, k), lambda now, b: iter(now.add(b) or ()), lambda now: iter([now.rows()]))

    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, vec_id {v.schema['vec_id'].dataType.simpleString()}, score double"
    out = asked.unionByName(read).repartition(many * parts, "block").sortWithinPartitions("block", "side").mapInArrow(go, schema)
    one = lambda a, b: (a.join(b.withColumnRenamed("w", "__w"), F.col("w") == F.col("__w")) if within else a.crossJoin(b.drop("w"))).select("query_id", "vec_id", dot(F.col("q"), F.col("embedding")).alias("score"))
    if odd_q:
        out = out.unionByName(one(q.where(~F.coalesce(plain_q, F.lit(False))), v))
    if odd_v:
        out = out.unionByName(one(q.where(plain_q), v.where(~F.coalesce(plain_v, F.lit(False)))))
    return out


def dense_scores(queries: DataFrame, vectors: DataFrame, within: str | None = None) -> DataFrame:
    """query_id, vec_id, score of all pairs (query_id, q) and (vec_id, embedding), or of
    those that agree in the column ``within``."""
    return _dense(queries, vectors, None, within)


def dense_top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k best of ``dense_scores`` for each query, exactly: a task hands on the best
    of its block only.  ``vec_id`` is a number."""
    return top_k(_dense(queries, vectors, k, None), k, "vec_id")


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    total = F.aggregate(F.slice(kept, 2, 1 << 30), F.element_at(kept, 1), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(kept))


def encoder_prefix(c: Column, model: str, is_query: bool) -> Column:
    """What a model's family expects before a text.  Fixed values."""
    if "e5" in model:
        return F.concat(F.lit("query: " if is_query else "passage: "), c)
    if "bge" in model and is_query:
        return F.concat(F.lit("Represent this sentence for searching relevant passages: "), c)
    return c


def lexical_overlap(query_words: Column, text_words: Column) -> Column:
    """Share of the query's distinct words that the text has: the reranker used
    where no model is plugged in.  Both sides are arrays of distinct words, made
    once for each text and not for each pair."""
    return F.when(F.size(query_words) == 0, 0.0).otherwise(F.size(F.array_intersect(query_words, text_words)) / F.size(query_words))


def overlap_top(items: DataFrame, hits: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k best of all pairs of items (query_id, qt) and hits (own, r, doc_id) by
    ``lexical_overlap``, ties by (own, r): query_id, rank, own, doc_id, score.

    Words meet words, so that only pairs with a word in common are made.  The others
    have score 0, and of these the first k hits are enough to fill up a query."""
    asked = items.select("query_id", F.size("qt").alias("size"), F.explode("qt").alias("term"))
    texts = docs.join(sized(hits.select("doc_id").distinct()), "doc_id").select("doc_id", F.array_distinct(phrase_tokens(F.col("text"))).alias("dt"))
    met = texts.select("doc_id", F.explode_outer("dt").alias("term")).join(sized(asked), "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    some = met.join(sized(hits), "doc_id").select("query_id", "own", "r", "doc_id", F.round(F.col("n") / F.col("size"), 6).alias("score"))
    first = hits.orderBy("own", "r").limit(k)  # k rows
    rest = items.select("query_id").crossJoin(F.broadcast(first)).select("query_id", "own", "r", "doc_id", F.lit(0.0).alias("score"))
    pairs = some.unionByName(rest).groupBy("query_id", "own", "r", "doc_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "own", "r")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "own", "doc_id", "score")


def rerank(pairs: DataFrame, k: int, score: Column, keep: list[str]) -> DataFrame:
    """The k best of each query; ties keep the order they came in (``pos``).
    Only ``keep`` columns move with the scores."""
    scored = pairs.select("query_id", "pos", *keep, F.round(score, 6).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
