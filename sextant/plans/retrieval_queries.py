"""Queries over retrieval and batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.functions.text import contains_phrase, normalize_phrase, passages_to_string, phrase_tokens
from sextant.operators import batch as B
from sextant.operators import encoder as X
from sextant.operators import inverted_index as I
from sextant.operators import retrieval as R
from sextant.operators import vector_index as V
from sextant.plans.data import CONTENTS, passages, table
from sextant.plans.text_queries import d_phrase
from sextant.registry import register
from sextant.session import scratch, written

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
BM25_SQL = f"""p AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL),
dl AS (SELECT doc_id, len({_TOKENS}) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
hits AS (SELECT item_id AS query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))), 6) AS score
 FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM hits)"""


def bm25_top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    hits = R.bm25_top(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), table(spark, sf_dir, "documents"), k)
    return written(hits, "top")  # small, and read more than once


@register("bm25_index", f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.postings(table(spark, sf_dir, "documents"))


@register("bm25_stats", f"SELECT count(*) AS n, round(avg(len({_TOKENS})), 6) AS avgdl FROM documents")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_stats(R.doc_stats(table(spark, sf_dir, "documents"))).select("n", F.round("avgdl", 6).alias("avgdl"))


@register("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM top WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_top(spark, sf_dir, 10).select("query_id", "doc_id", "score", "rank")


def word_index(spark: SparkSession, sf_dir: str) -> I.Index:
    """An inverted index of all documents, written and opened again."""
    return I.Index(spark, I.build(table(spark, sf_dir, "documents"), scratch(spark, "word-index")))


@register("inverted_topk", f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM top WHERE rank <= 10")
def inverted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``bm25_topk``, from a stored index."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return word_index(spark, sf_dir).search(items, 10).select("query_id", "doc_id", "score", "rank")


@register("inverted_terms", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def inverted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of each word, and how often it occurs, decoded from the blocks."""
    count = F.aggregate("tf", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return word_index(spark, sf_dir).blocks().groupBy("term").agg(F.sum("n").alias("df"), F.sum(count).alias("tf"))


@register("inverted_skips")
def inverted_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the shards that hold a word of an item, how many a search for the ten best
    reads."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return word_index(spark, sf_dir).plan(items, 10)[1]


@register("gather_docs", f"WITH {BM25_SQL} SELECT query_id, rank, doc_id, {CONTENTS} AS contents FROM top JOIN documents USING (doc_id) WHERE rank <= 3")
def gather_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).join(R.sized(bm25_top(spark, sf_dir, 3)), "doc_id").select("query_id", "rank", "doc_id", "contents")


_CONTEXT = f"""WITH {BM25_SQL}, c AS (SELECT query_id, string_agg('Doc ' || rank || '(Title: ' || source || ' ' || doc_id || ') ' || text || chr(10), '' ORDER BY rank) AS context,
 bool_or(contains(' ' || {d_phrase('text')} || ' ', ' ' || {d_phrase("(SELECT b.text FROM benchmark b WHERE b.item_id = query_id)")} || ' ')) AS contained FROM top JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id)
SELECT query_id, context, contained FROM c"""


@register("context_topk", _CONTEXT)
def context_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: three best passages for each item, as a context, and whether one
    of them contains the item."""
    hits = passages(spark, sf_dir).join(R.sized(bm25_top(spark, sf_dir, 3)), "doc_id")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), normalize_phrase(F.col("text")).alias("needle"))
    found = hits.join(R.sized(items), "query_id").withColumn("has", contains_phrase(normalize_phrase(F.col("text")), F.col("needle")))
    grouped = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "contents"))).alias("x"), F.bool_or("has").alias("contained"))
    return grouped.select("query_id", passages_to_string(F.col("x.contents")).alias("context"), "contained")


@register("rag_context", f"""WITH c AS (SELECT user_id, event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, string_agg('Doc ' || n || '(Title: ' || source || ' ' || d.doc_id || ') ' || text || chr(10), '' ORDER BY n) AS context FROM c JOIN documents d USING (doc_id) WHERE n <= 2 GROUP BY user_id""")
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached ids of each user, the first two, looked up in the corpus."""
    most = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("m"))
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    cached = table(spark, sf_dir, "events").crossJoin(F.broadcast(most)).select("user_id", "ts", "event_id", (F.col("event_id") % F.col("m")).alias("doc_id")).withColumn("n", F.row_number().over(order)).where("n <= 2")
    got = cached.join(passages(spark, sf_dir), "doc_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("n", "contents"))).alias("x"))
    return got.select("user_id", passages_to_string(F.col("x.contents")).alias("context"))


_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
DENSE_SQL = f"hits AS (SELECT q.vec_id AS query_id, v.vec_id, round({_DOT}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM hits)"


def dense_top(spark: SparkSession, sf_dir: str, k: int, asked: str = "vec_id % 20 = 0") -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.dense_top(queries, vectors, k)


@register("dense_topk", f"WITH {DENSE_SQL} SELECT query_id, vec_id, score, rank FROM top WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_top(spark, sf_dir, 10).select("query_id", "vec_id", "score", "rank")


#: How many vectors of best coded scores ``ann_recall`` scores exactly for each query.
SHORTLIST = 50


def ann_top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k best by an index of 8-bit codes: all vectors are scored by their codes
    and the best ``SHORTLIST`` of each query exactly."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    step = vectors.agg((F.max(F.array_max(F.transform("embedding", F.abs))).cast("double") / 127).alias("step"))
    coded = vectors.crossJoin(F.broadcast(step)).select("vec_id", F.transform("embedding", lambda x: F.when(F.col("step") > 0, F.round(x / F.col("step"))).otherwise(0).cast("tinyint")).alias("embedding"))
    near = R.dense_top(queries, coded, max(k, SHORTLIST)).select("query_id", "vec_id")
    exact = near.join(vectors, "vec_id").join(R.sized(queries), "query_id").select("query_id", "vec_id", R.dot(F.col("q"), F.col("embedding")).alias("score"))
    return R.top_k(exact, k, "vec_id")


_CODED = "list_transform(v.embedding, lambda x: CASE WHEN step > 0 THEN round(x / step) ELSE 0 END)"


@register("ann_recall", f"""WITH {DENSE_SQL}, s AS (SELECT CAST(max(list_max(list_transform(embedding, lambda x: abs(x)))) AS DOUBLE) / 127 AS step FROM embeddings),
c AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST({_CODED} AS DOUBLE[])), 6) AS coded FROM embeddings q, embeddings v, s WHERE q.vec_id % 20 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coded DESC, vec_id) AS place FROM c),
f AS (SELECT n.query_id, n.vec_id, row_number() OVER (PARTITION BY n.query_id ORDER BY hits.score DESC, n.vec_id) AS place FROM n JOIN hits ON hits.query_id = n.query_id AND hits.vec_id = n.vec_id WHERE n.place <= 50)
SELECT t.query_id, avg(CASE WHEN f.vec_id IS NULL THEN 0.0 ELSE 1.0 END) AS recall FROM top t LEFT JOIN f ON f.query_id = t.query_id AND f.vec_id = t.vec_id AND f.place <= 10 WHERE t.rank <= 10 GROUP BY t.query_id""")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of the search by codes against the exact one, for every query."""
    found = ann_top(spark, sf_dir, 10).select("query_id", "vec_id")
    exact = dense_top(spark, sf_dir, 10).select("query_id", "vec_id")
    return exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def vector_index(spark: SparkSession, sf_dir: str) -> V.Index:
    """An index of all embeddings, written and opened again."""
    return V.Index(spark, V.build(table(spark, sf_dir, "embeddings"), scratch(spark, "vector-index")))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@register("vector_index_topk")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every twentieth embedding, from stored lists of codes; tested
    against exact search."""
    return vector_index(spark, sf_dir).search(_asked(spark, sf_dir), 10).select("query_id", "vec_id", "score", "rank")


@register("vector_index_recall")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 by score against exact search, and the share of codes read."""
    index, asked = vector_index(spark, sf_dir), _asked(spark, sf_dir)
    found = index.search(asked, 10).select("query_id", "vec_id", "score")
    last = dense_top(spark, sf_dir, 10).groupBy("query_id").agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("n"))
    hit = F.coalesce((F.col("score") >= F.col("last") - 1e-5).cast("int"), F.lit(0))
    recall = last.join(found, "query_id", "left").groupBy("query_id").agg((F.sum(hit) / F.max("n")).alias("recall"))
    return recall.join(index.reads(V.usable(asked, "query_id", "q", index.width).select(F.col("id").alias("query_id"), F.col("v").alias("q"))), "query_id", "left")


def encoded_top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k documents whose vectors are nearest to each item's, by the stored index."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    weights = X.rarity(docs)
    path = V.build(X.encode(docs, weights, "doc_id"), scratch(spark, "text-index"), "id", "v", width=X.WIDTH)
    asked = X.encode(items, weights, "item_id").withColumnsRenamed({"id": "query_id", "v": "q"})
    return written(V.Index(spark, path).search(asked, k).withColumnRenamed("vec_id", "doc_id"), "encoded")


@register("encoded_topk")
def encoded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search over texts; the vectors are tested against their definition."""
    return encoded_top(spark, sf_dir, 10).select("query_id", "doc_id", "rank", "score")


@register("hybrid_topk")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by words and by vectors, joined by rank."""
    words = bm25_top(spark, sf_dir, 20).where("rank <= 20").select("query_id", "doc_id", "rank")
    return X.fused(10, words, encoded_top(spark, sf_dir, 20).select("query_id", "doc_id", "rank"))


@register("encoded_recall")
def encoded_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item: whether dense and hybrid search find the best hit by words among
    their ten."""
    words = bm25_top(spark, sf_dir, 20).select("query_id", "doc_id", "rank")
    dense = encoded_top(spark, sf_dir, 20).select("query_id", "doc_id", "rank")
    best = words.where("rank = 1").select("query_id", "doc_id")
    there = lambda hits, name: best.join(hits.where("rank <= 10").select("query_id", "doc_id", F.lit(True).alias(name)), ["query_id", "doc_id"], "left").select("query_id", F.coalesce(name, F.lit(False)).alias(name))
    return there(dense, "dense").join(there(X.fused(10, words.where("rank <= 20"), dense), "hybrid"), "query_id")


@register("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 6) AS total FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(R.l2_normalize(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("mean_pool", "SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY label, i")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.collect_list(F.struct(F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.when(F.col("vec_id") % 3 != 0, 1).otherwise(0).alias("m"))).alias("r"))
    return one.select("label", F.posexplode(R.mean_pool(F.col("r.v"), F.col("r.m"))).alias("i", "x")).select("label", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@register("encoder_prefix", "SELECT item_id, 'query: ' || text AS e5, 'Represent this sentence for searching relevant passages: ' || text AS bge, text AS other FROM benchmark")
def encoder_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", R.encoder_prefix(t, "e5-base", True).alias("e5"), R.encoder_prefix(t, "bge-base", True).alias("bge"), R.encoder_prefix(t, "dpr", True).alias("other"))


_OVERLAP = f"(SELECT CASE WHEN len(a) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(a), 6) END FROM (SELECT list_distinct({_TOKENS.replace('text', 'qt')}) AS a, list_distinct({_TOKENS.replace('text', 'dt')}) AS b))"


@register("rerank_all_pairs", f"""WITH {BM25_SQL}, d AS (SELECT query_id AS own, rank AS r, doc_id FROM top WHERE rank <= 2), x AS (SELECT b.item_id AS query_id, own, r, doc_id, b.text AS qt, (SELECT t.text FROM documents t WHERE t.doc_id = d.doc_id) AS dt FROM benchmark b, d),
s AS (SELECT query_id, own, r, doc_id, {_OVERLAP} AS score FROM x), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, own, r) AS INTEGER) AS rank FROM s) SELECT query_id, rank, own, doc_id, score FROM o WHERE rank <= 5""")
def rerank_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query of the request against every document of every query."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(phrase_tokens(F.col("text"))).alias("qt"))
    hits = bm25_top(spark, sf_dir, 2).select(F.col("query_id").alias("own"), F.col("rank").alias("r"), "doc_id")
    return R.overlap_top(items, hits, table(spark, sf_dir, "documents").select("doc_id", "text"), 5)


@register("retrieve_then_rerank", f"""WITH {BM25_SQL}, x AS (SELECT query_id, rank AS r, t.doc_id, (SELECT b.text FROM benchmark b WHERE b.item_id = query_id) AS qt, d.text AS dt FROM top t JOIN documents d USING (doc_id) WHERE rank <= 10),
s AS (SELECT query_id, r, doc_id, {_OVERLAP} AS score FROM x), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS INTEGER) AS rank FROM s) SELECT query_id, rank, doc_id, score FROM o WHERE rank <= 3""")
def retrieve_then_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(phrase_tokens(F.col("text"))).alias("qt"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = docs.join(R.sized(bm25_top(spark, sf_dir, 10).select("query_id", F.col("rank").alias("pos"), "doc_id")), "doc_id").withColumn("dt", F.array_distinct(phrase_tokens(F.col("text")))).drop("text").join(R.sized(items), "query_id")
    return R.rerank(pairs, 3, R.lexical_overlap(F.col("qt"), F.col("dt")), ["doc_id"]).select("query_id", "rank", "doc_id", "score")


@register("serp_assemble", """WITH s AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
u AS (SELECT user_id, 0 AS section, n, event_id FROM s WHERE event_type = (SELECT min(event_type) FROM events) AND n = 1 UNION ALL SELECT user_id, 1, n, event_id FROM s WHERE event_type = (SELECT max(event_type) FROM events) AND n <= 2 UNION ALL
 SELECT user_id, 2, n, event_id FROM s WHERE event_type NOT IN ((SELECT min(event_type) FROM events), (SELECT max(event_type) FROM events)) AND n <= 2)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY section, n, event_id) AS INTEGER) AS pos, event_id FROM u""")
def serp_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer box first, then up to k organic results, then up to k related."""
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.min("event_type").alias("box"), F.max("event_type").alias("organic"))
    ranked = events.withColumn("n", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))).crossJoin(F.broadcast(ends))
    section = F.when((F.col("event_type") == F.col("box")) & (F.col("n") == 1), 0).when((F.col("event_type") == F.col("organic")) & (F.col("n") <= 2), 1).when(~F.col("event_type").isin(F.col("box"), F.col("organic")) & (F.col("n") <= 2), 2)
    shown = ranked.withColumn("section", section).where("section IS NOT NULL")
    return shown.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("section", "n", "event_id")).alias("pos"), "event_id")


# Batch algebra, over orders numbered by key.
_O = "o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)"


def numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = B.row_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    return rows, table(spark, sf_dir, "orders").count()


@register("batch_row_ids", f"WITH {_O} SELECT o_orderkey, row_id FROM o")
def batch_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir)[0].select("o_orderkey", "row_id")


@register("batch_row_ids_wide", "SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders")
def batch_row_ids_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows, by an order with many ties."""
    return B.row_ids(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


@register("batch_union", "SELECT o_orderkey AS row_id, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 3")
def batch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "row_id")
    left = orders.select("row_id", "o_custkey", "o_totalprice")
    right = orders.select("row_id", F.when(F.col("row_id") % 10 == 3, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), "o_orderpriority")
    return B.union_columns(left, right)[0]


@register("batch_union_violations", "SELECT o_orderkey AS row_id FROM orders WHERE o_orderkey % 10 = 3")
def batch_union_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "row_id")
    right = orders.select("row_id", F.when(F.col("row_id") % 10 == 3, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return B.union_columns(orders.select("row_id", "o_custkey"), right)[1]


@register("batch_concat", "SELECT 0 AS part, n_nationkey AS k FROM nation UNION ALL SELECT 1, r_regionkey FROM region")
def batch_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.concat(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))).select("part", "k")


@register("batch_chunk", f"WITH {_O} SELECT row_id, CAST(row_id // ((SELECT count(*) FROM orders) // 5) AS INTEGER) AS chunk FROM o")
def batch_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = numbered(spark, sf_dir)
    return B.chunk(rows, 5, n).select("row_id", "chunk")


@register("batch_repeat", f"WITH {_O} SELECT row_id, rep, row_id * 3 + rep AS interleaved, rep * (SELECT count(*) FROM orders) + row_id AS tiled FROM o, (SELECT unnest(range(3))::INTEGER AS rep)")
def batch_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = numbered(spark, sf_dir)
    both = B.repeat(rows, 3, True, n)
    return both.select("row_id", "rep", F.col("new_id").alias("interleaved"), (F.col("rep") * F.lit(n) + F.col("row_id")).cast("bigint").alias("tiled"))


@register("batch_reorder", f"WITH {_O} SELECT (SELECT count(*) FROM orders) - 1 - row_id AS new_id, o_orderkey FROM o")
def batch_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = numbered(spark, sf_dir)
    places = rows.select("row_id", (F.lit(n) - 1 - F.col("row_id")).alias("new_id"))
    return rows.join(places, "row_id").select("new_id", "o_orderkey")


@register("batch_pad", f"""WITH {_O}, c AS (SELECT count(*) AS n FROM orders) SELECT row_id, o_orderkey, false AS is_pad FROM o UNION ALL SELECT row_id + n, o_orderkey, true FROM o, c WHERE row_id < (7 - n % 7) % 7""")
def batch_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = numbered(spark, sf_dir)
    return B.pad_to_divisor(rows, 7, n).select("row_id", "o_orderkey", "is_pad")


@register("batch_fold", f"WITH {_O} SELECT row_id // 4 AS fold, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY row_id) AS keys FROM o GROUP BY 1")
def batch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fold(numbered(spark, sf_dir)[0], 4, "o_orderkey").select("fold", F.array_join(F.transform("o_orderkey", lambda x: x.cast("string")), ",").alias("keys"))


@register("batch_unfold", f"WITH {_O} SELECT row_id, o_orderkey FROM o")
def batch_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.unfold(B.fold(numbered(spark, sf_dir)[0], 4, "o_orderkey"), 4, "o_orderkey")


@register("minibatch_assign", "SELECT doc_id, (row_number() OVER (ORDER BY sha256('42|' || doc_id), doc_id) - 1) // 16 AS batch FROM documents")
def minibatch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.minibatches(table(spark, sf_dir, "documents").select("doc_id"), 16, 42, "doc_id").select("doc_id", "batch")


@register("random_subset", "SELECT doc_id FROM documents ORDER BY sha256('42|' || doc_id), doc_id LIMIT 50")
def random_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of fixed size, drawn by a hash."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.sha2(F.concat(F.lit("42|"), F.col("doc_id").cast("string")), 256), "doc_id").limit(50)


@register("drop_last", f"WITH {_O} SELECT row_id, row_id // 64 AS batch FROM o WHERE row_id // 64 < (SELECT count(*) FROM orders) // 64")
def drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = numbered(spark, sf_dir)
    return B.drop_last(rows, 64, n).select("row_id", "batch")


@register("group_slots", "SELECT item_id, slot, 4 AS group_size FROM benchmark, (SELECT unnest(range(4))::INTEGER AS slot)")
def group_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"))
    return B.repeat(items, 4, True, 0).select(F.col("row_id").alias("item_id"), F.col("rep").alias("slot"), F.lit(4).alias("group_size"))


@register("active_rows", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN reverse(text) ELSE '' END AS reply FROM conversations")
def active_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work on the active rows only, then back in place with blanks."""
    turns = table(spark, sf_dir, "conversations")
    done = turns.where("role = 'user'").select("conv_id", "turn", F.reverse("text").alias("reply"))
    return turns.select("conv_id", "turn").join(done, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("reply", F.lit("")).alias("reply"))
