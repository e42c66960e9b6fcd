"""Dense search in blocks against sums in the order of the coordinates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import retrieval


def rows_of(x, more=()):
    return [*((i, [float(a) for a in v], i % 3 if i % 11 else None) for i, v in enumerate(x)), *more]


ODD = [(9000, None, 1), (9001, [1.0] * 5, 1), (9002, [float("nan")] * 8, 1), (9003, [None] * 8, 2), (9004, [], 0), (9020, [float("inf")] * 8, 1), (None, [0.5] * 8, 1)]


@pytest.fixture(scope="module")
def data():
    x = np.random.default_rng(5).normal(size=(700, 8)).round(2).astype(np.float32)
    x[200:420] = x[3]  # a third are one vector
    return x


@pytest.mark.parametrize("odd", [(), ODD])
def test_blocks_equal_pairs(spark, data, odd, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 13)
    monkeypatch.setattr(retrieval, "TILE", 500)
    v = spark.createDataFrame(rows_of(data, odd), "vec_id bigint, embedding array<float>, label int").repartition(3)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    all_ = q.crossJoin(v.select("vec_id", "embedding", F.col("label").alias("l"))).select("query_id", "vec_id", retrieval.dot(F.col("q"), F.col("embedding")).alias("score"), (F.col("label") == F.col("l")).alias("same"))
    shown = lambda d, *c: sorted(tuple(map(str, (r[x] for x in c))) for r in d.collect())
    for within, want in ((None, all_), ("label", all_.where("same"))):
        got = retrieval.dense_scores(q, v, within)
        assert shown(got, "query_id", "vec_id", "score") == shown(want, "query_id", "vec_id", "score")
    for k in (1, 10, 800):
        got, want = retrieval.dense_top(q, v, k), retrieval.top_k(all_, k, "vec_id")
        assert shown(got, "query_id", "vec_id", "score", "rank") == shown(want, "query_id", "vec_id", "score", "rank")


def test_no_pair_moves_for_the_best(spark, data):
    """Tasks hand on k rows for each query, not all pairs."""
    v = spark.createDataFrame(rows_of(data), "vec_id bigint, embedding array<float>, label int")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = retrieval.dense_top(q, v, 10)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    moved = retrieval._dense(q, v, 10, None)
    assert moved.count() <= 35 * 10 * 4 * spark.sparkContext.defaultParallelism


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-8, 9, 3000), rng.integers(-10**9, 10**9, 3000) / 1e6 + rng.choice([0, 5e-7, 4.9999999e-7], 3000), [0.0, -0.0, 2.5e-7, 5e-7, -5e-7, 1.0000005, 1e14 + 0.3]])
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(x)], "i int, x double").select("i", F.round("x", 6).alias("r"))
    want = np.array([r.r for r in df.orderBy("i").collect()])
    assert (retrieval.rounded(x) == want).all()


def test_words_in_blocks_find_what_all_pairs_find(spark, monkeypatch):
    """Ties, copies, repeated and null ids, empty texts, queries of one word and of many."""
    monkeypatch.setattr(retrieval, "TILE", 300)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(i)}" for i in rng.zipf(1.5, rng.integers(0, 30)) if i < 50) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, "w1 w2 same text") for i in range(90)), (5, "w1 w3"), (None, "w1 w2 w2"), (2000, None), (2001, "")], "doc_id bigint, text string").repartition(3)
    asked = [*(f"w{i} w{j}" for i in range(1, 6) for j in range(1, 9)), "w1", "same", "w1 w1 w2 w3 w4 w5 w6 w7", "nowhere", "", None]
    queries = spark.createDataFrame([((i, i % 3), t) for i, t in enumerate(asked)], "query_id struct<id:int,turn:int>, text string")
    key = lambda d: sorted((tuple(r.query_id), r["rank"], -1 if r.doc_id is None else r.doc_id, round(r.score, 5)) for r in d.collect())
    for k in (1, 10, 600):
        assert key(retrieval.bm25_top(queries, docs, k)) == key(retrieval.top_k(retrieval.bm25(queries, docs), k, "doc_id"))
    moved = retrieval.bm25_top(queries, docs, 1)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in moved


def test_documents_move_packed(spark, monkeypatch):
    """A document is one row whatever its words; many queries of few words do not make
    the corpus's words shuffle, and many words find the same."""
    kept, plans = {}, {}

    def written(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        kept[name] = df.cache()
        return kept[name]

    monkeypatch.setattr(retrieval, "written", written)
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} w{i % 7} other") for i in range(200)], "doc_id bigint, text string").repartition(3)
    queries = spark.createDataFrame([(i, f"w{i % 3} w{i % 4}") for i in range(60)], "query_id bigint, text string")
    rows = lambda d: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in d.collect())
    monkeypatch.setattr(retrieval, "SMALL", 20)  # fewer than rows of queries, more than their words
    found = rows(retrieval.bm25_top(queries, docs, 3))
    assert kept["postings"].count() == 200 and len(found) == 180
    assert "strategy=broadcast" in plans["postings"]
    monkeypatch.setattr(retrieval, "SMALL", 2)
    assert rows(retrieval.bm25_top(queries, docs, 3)) == found and kept["postings"].count() == 200
    assert "strategy=broadcast" not in plans["postings"]
