"""Stored indexes: of vectors, and of words."""

import random

import numpy as np
from pyspark.sql import functions as F

from sextant.operators import inverted_index, retrieval, vector_index
from sextant.session import scratch


def vectors_of(spark, x, more=()):
    rows = [(i, [float(a) for a in v], "clash") for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *more], "vec_id bigint, embedding array<float>, list string")


def test_vector_index(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16))
    x[300:700] = x[7]  # a third of all rows are one vector
    odd = [(5000, None, ""), (5001, [1.0] * 15, ""), (5002, [float("nan")] * 16, ""), (5003, [None] * 16, ""), (5004, [], ""), (None, [0.0] * 16, "")]
    path = scratch(spark, "index")
    vector_index.build(vectors_of(spark, x, odd).repartition(3), path)
    index = vector_index.Index(spark, path)  # opened from its files
    assert index.n == 1201 and index.sizes.sum() == 1201
    blocks = spark.read.parquet(f"{path}/codes").collect()
    assert sorted(i for b in blocks for i in np.frombuffer(b.ids, np.int64).tolist()) == [vector_index.NO_ID, *range(1200)]
    assert all(b.n <= vector_index.BLOCK and len(b.codes) == b.n * 4 for b in blocks)
    asked = vectors_of(spark, x, odd).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {}
    for r in index.search(asked, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    x = x.astype(np.float32).astype(float)
    recall = []
    for q in range(0, 1200, 20):
        exact = np.sort(x @ x[q])[::-1]
        assert [r["rank"] for r in got[q]] == list(range(1, 11))
        assert np.allclose([r.score for r in got[q]], [x[q] @ x[r.vec_id] for r in got[q]], atol=1e-5)
        recall.append(np.mean([r.score >= exact[9] - 1e-5 for r in got[q]]))
    assert set(got) == set(range(0, 1200, 20)) and np.mean(recall) >= 0.9
    reads = [r.share_read for r in index.reads(vector_index.usable(asked, "query_id", "q", 16).select(F.col("id").alias("query_id"), F.col("v").alias("q"))).collect()]
    assert len(reads) == 60 and np.median(reads) < 0.5
    everything = index.search(asked, 10, share=1.0, shortlist=1201).groupBy("query_id").agg(F.min("score").alias("s")).collect()
    assert all(abs(r.s - np.sort(x @ x[r.query_id])[-10]) < 1e-5 for r in everything)


def test_vector_index_of_nothing(spark):
    for rows in ([], [(1, None, "")]):
        path = scratch(spark, "index")
        vector_index.build(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, list string"), path)
        asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id bigint, q array<float>")
        assert vector_index.Index(spark, path).search(asked, 3).collect() == []


def corpus(spark, n=900, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(i * 7 - 50, " ".join(["the"] * rng.randint(0, 9) + rng.choices(words, [1 / (k + 1) for k in range(300)], k=rng.randint(0, 60))), "clash") for i in range(n)]
    rows += [(5, None, ""), (12, "", ""), (20_000, "w7 " * 3000, ""), (None, "w7 w8", ""), (34, "rare w1", ""), (34, "rare rare w2 w3", "")] + [(30_000 + i, "the same w5 text w299", "") for i in range(400)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, term string").repartition(3)


def test_inverted_index_finds_what_bm25_finds(spark):
    docs = corpus(spark)
    path = scratch(spark, "words")
    inverted_index.build(docs, path, shard=64)
    index = inverted_index.Index(spark, path)
    queries = spark.createDataFrame([(0, "the w5 W5 w299"), (1, "rare"), (2, "w7 w8 w250 the"), (3, "nowhere"), (4, ""), (5, None), (6, "same text"), (7, "the " + " ".join(f"w{i}" for i in range(40)))], "query_id bigint, text string")
    want = retrieval.top_k(retrieval.bm25(queries, docs.where("doc_id IS NOT NULL")), 10, "doc_id")
    key = lambda d: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in d.collect())
    got = index.search(queries, 10)
    assert key(got) == key(want)
    files = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in files  # the corpus itself is not read
    reads = {r["query_id"]: r for r in index.plan(queries, 10, first=1)[1].collect()}
    assert set(reads) == {0, 1, 2, 6, 7} and all(1 <= r["read"] <= r["shards"] for r in reads.values())
    assert sum(r["read"] for r in reads.values()) < sum(r["shards"] for r in reads.values())


def test_a_search_moves_no_row_for_each_query_and_shard(spark, monkeypatch):
    path = scratch(spark, "words")
    inverted_index.build(corpus(spark), path, shard=16)
    index = inverted_index.Index(spark, path)
    assert index.blocks().where("term = 'the'").count() > 50  # shards
    aside = []
    monkeypatch.setattr(inverted_index, "written", lambda df, name, put=inverted_index.written: aside.append(put(df, name)) or aside[-1])
    queries = spark.range(300).selectExpr("id AS query_id", "'the w' || id AS text")
    want = retrieval.top_k(retrieval.bm25(queries, corpus(spark).where("doc_id IS NOT NULL")), 2, "doc_id")
    key = lambda d: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in d.collect())
    assert key(index.search(queries, 2)) == key(want)
    assert max(df.count() for df in aside) <= 600  # a row for each query and word, where 300 queries meet over 50 shards


def test_blocks_hold_all_postings(spark):
    docs = corpus(spark, 200)
    path = scratch(spark, "words")
    inverted_index.build(docs, path, shard=32)
    blocks = inverted_index.Index(spark, path).blocks().collect()
    assert len({(b["term"], b["shard"]) for b in blocks}) == len(blocks)
    got = {}
    for b in blocks:
        assert len(b["ids"]) == b["n"] and b["ids"] == sorted(b["ids"]) and b["most_tf"] == max(b["tf"]) and b["least_dl"] == min(b["dl"])
        got.update({(b["term"], i): t for i, t in zip(b["ids"], b["tf"], strict=True)})
    want = {(r["term"], r["doc_id"]): r["tf"] for r in retrieval.postings(docs.where("doc_id IS NOT NULL")).collect()}
    assert got == want


def test_a_document_of_many_rows_is_added_up(spark, monkeypatch):
    monkeypatch.setattr(inverted_index, "HELD", 50)
    import pyarrow as pa

    held = inverted_index._Shard()
    for i in range(200):
        held.add(np.array([7, 7], np.int64), pa.array([["a", "b", f"w{i % 9}"], ["a"]]))
        assert held.held <= 50 + 4
    assert held.n == 1
    blocks = {b["term"]: b for b in held.blocks(3).to_pylist()}
    assert blocks["a"]["tf"] == [400] and blocks["b"]["tf"] == [200] and blocks["a"]["dl"] == [3] and blocks[None]["ids"] == [7] and len(blocks) == 12


def test_inverted_index_of_nothing(spark):
    path = scratch(spark, "words")
    inverted_index.build(spark.createDataFrame([], "doc_id bigint, text string"), path)
    asked = spark.createDataFrame([(1, "a")], "query_id bigint, text string")
    assert inverted_index.Index(spark, path).search(asked, 3).collect() == []


def test_postings_are_counted_in_parts_by_bytes(spark):
    docs = corpus(spark)
    got = retrieval.postings(docs, piece=1000)
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0]
    assert got.rdd.getNumPartitions() == size // 1000 > 20
    assert got.count() == docs.selectExpr("doc_id", "explode(split(lower(text), ' ')) AS w").where("w <> ''").distinct().count()
