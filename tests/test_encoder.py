"""Vectors of texts against their definition, and how lists of hits are joined."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sextant.operators import encoder


def hashed(data, seed=42):
    return np.int64(np.uint64(xxhash.xxh64_intdigest(data, seed)))


def plain(words, weights, width):
    h = [hashed(w.encode()) for w in words]
    counts = {}
    for x in h + [hashed(int(b).to_bytes(8, "little", signed=True), int(np.uint64(hashed(int(a).to_bytes(8, "little", signed=True))))) for a, b in zip(h, h[1:])]:
        counts[int(x)] = counts.get(int(x), 0) + 1
    out = np.zeros(width)
    for x, n in counts.items():
        out[((x % (1 << 64)) >> 20) % width] += (-1 if x < 0 else 1) * (1 + np.log(n)) * weights[x % encoder.BUCKETS]
    return out / np.linalg.norm(out)


TEXTS = ["One two, two three", "two three four", "ONE", "", None, "... !", "é é é two", "one two two three"] + ["common words here"] * 30


def test_vectors(spark):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "one", "")], "doc_id bigint, text string, v string")
    weights = encoder.rarity(d)
    texts = [*TEXTS, "one"]
    n = sum(t is not None for t in texts)
    two = int(hashed(b"two")) % encoder.BUCKETS
    assert abs(weights[two] - np.log(1 + n / (1 + 4))) < 1e-9
    rows = encoder.encode(d, weights, "doc_id", width=32).collect()
    got = {r["id"]: r["v"] for r in rows}
    assert len(rows) == len(texts) - 3 and not {3, 4, 5} & set(got)
    for i in (0, 1, 2, 6, 7):
        words = "".join(c.lower() if c.isalnum() else " " for c in TEXTS[i]).split()
        assert np.allclose(got[i], plain(words, weights, 32), atol=1e-5), i
    assert np.allclose(got[0], got[7]) and np.allclose(got[None], got[2])


def test_texts_are_taken_apart_once(spark):
    """Pairs are hashed as Spark does, and no plan has the words' expression twice."""
    d = spark.createDataFrame([(1, "a b c b"), (2, "one"), (3, None)], "doc_id bigint, text string")
    w = {r.doc_id: r.w for r in d.select("doc_id", encoder.words_of(F.col("text")).alias("w")).collect()}
    want = [r.h for r in spark.createDataFrame(list(zip(w[1], w[1][1:])), "a bigint, b bigint").select(F.xxhash64("a", "b").alias("h")).collect()]
    assert encoder.features(np.array(w[1])).tolist() == w[1] + want and encoder.features(np.array(w[2])).tolist() == w[2]
    plan = encoder.encode(d, encoder.rarity(d), "doc_id").where("id > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_empty_corpus(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    weights = encoder.rarity(d)
    assert len(set(weights.tolist())) == 1 and encoder.encode(d, weights, "doc_id").collect() == []


def test_fused_ranks(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 9, 1)], "query_id bigint, doc_id bigint, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id bigint, doc_id bigint, rank int")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in encoder.fused(2, a, b).collect()}
    assert got == {(1, 1): 11, (1, 2): 10, (2, 1): 9}


def test_similar_texts_are_near(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    weights = encoder.rarity(d)
    part = d.where("doc_id < 20").withColumn("text", F.concat_ws(" ", F.slice(F.split("text", " "), 10, 25)))
    vectors = {r["id"]: np.array(r["v"]) for r in encoder.encode(d, weights, "doc_id").collect()}
    for r in encoder.encode(part, weights, "doc_id").collect():
        assert max(vectors, key=lambda i: vectors[i] @ np.array(r["v"])) == r["id"]
