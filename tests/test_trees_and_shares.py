"""Trees of digests, dealing by length over a whole table, digests of large files."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from sextant.operators import balance, merkle
from sextant.sources import archives, corpus


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_root(texts, fanout):
    level = [sha("null" if t is None else "leaf:" + t) for t in texts]
    while len(level) > 1:
        level = [sha("node:" + ",".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0] if level else None


def table(spark, texts):
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id bigint, text string, digest string").repartition(3)


@pytest.mark.parametrize(("n", "fanout"), [(0, 4), (1, 4), (4, 4), (5, 4), (65, 4), (200, 16)])
def test_roots(spark, n, fanout):
    texts = [None if i % 9 == 4 else f"t{i % 50}" for i in range(n)]
    tree = merkle.build(table(spark, texts), "id", F.col("text"), fanout)
    assert tree.root() == plain_root(texts, fanout)
    assert all(level.groupBy("number").count().where("count > 1").isEmpty() for level in tree.levels)


def test_changes_are_located(spark):
    texts = [f"text {i}" for i in range(150)]
    a = merkle.build(table(spark, texts), "id", F.col("text"), 4)
    other = list(texts)
    other[7], other[8], other[149] = "changed", None, "x"
    b = merkle.build(table(spark, other), "id", F.col("text"), 4)
    assert sorted(tuple(r) for r in merkle.differences(a, b).collect()) == [(7, 21, 21), (8, 24, 24), (149, 447, 447)]
    assert merkle.differences(a, a).isEmpty()
    longer = merkle.build(table(spark, [*texts, *(f"more {i}" for i in range(200))]), "id", F.col("text"), 4)
    assert sorted(r["number"] for r in merkle.differences(a, longer).collect()) == list(range(150, 350))
    empty = merkle.build(table(spark, []), "id", F.col("text"), 4)
    assert merkle.differences(a, empty).count() == 150


def test_paths_hold_for_what_is_there_only(spark):
    texts = [f"text {i}" for i in range(70)]
    tree = merkle.build(table(spark, texts), "id", F.col("text"), 4)
    chosen = merkle.paths(tree, spark.createDataFrame([(0,), (17,), (69,)], "number bigint"))
    good = chosen.select("number", merkle.holds(F.col("number"), F.col("digest"), F.col("path"), tree.root(), 4).alias("ok")).collect()
    assert sorted(tuple(r) for r in good) == [(0, True), (17, True), (69, True)]
    wrong = [merkle.holds(F.col("number"), merkle.leaf(F.lit("other")), F.col("path"), tree.root(), 4), merkle.holds(F.col("number") + 1, F.col("digest"), F.col("path"), tree.root(), 4), merkle.holds(F.col("number"), F.col("digest"), F.col("path"), "0" * 64, 4), merkle.holds(F.col("number"), F.col("digest"), F.slice("path", 1, 1), tree.root(), 4)]
    assert not any(r[k] for r in chosen.select(*wrong).collect() for k in range(4))


@pytest.mark.parametrize(("n", "k"), [(1000, 7), (997, 8), (5, 9), (0, 3), (300, 1)])
def test_dealing_balances_the_whole_table(spark, n, k):
    rng = random.Random(n)
    lengths = [None if i % 50 == 7 else rng.choice([0, 5, 5, rng.randint(1, 40), rng.randint(1, 20_000)]) for i in range(n)]
    d = spark.createDataFrame(list(enumerate(lengths)), "id bigint, n bigint").repartition(4)
    got = balance.deal(d, "n", "id", k).collect()
    assert sorted(r["id"] for r in got) == list(range(n))
    totals, sizes = [0] * k, [0] * k
    for r in got:
        totals[r["part"]] += r["n"] or 0
        sizes[r["part"]] += 1
    assert max(totals) - min(totals) <= max([x or 0 for x in lengths], default=0) and max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError):
        balance.deal(d, "n", "id", 0)


def test_digests_of_large_files(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"abc")
    with open(tmp_path / "large", "wb") as f:  # sparse, above two gigabytes
        f.truncate((2 << 30) + 5)
    want = hashlib.sha256()
    for _ in range(2 << 10):
        want.update(bytes(1 << 20))
    want.update(bytes(5))
    got = {os.path.basename(r["path"]): (r["length"], r["digest"]) for r in corpus.files(spark, str(tmp_path)).collect()}
    assert got == {"small": (3, hashlib.sha256(b"abc").hexdigest()), "large": ((2 << 30) + 5, want.hexdigest())}
    assert archives.digest_of(str(tmp_path / "none")) is None


def test_batches_that_do_not_make_equal_parts(spark):
    """A last batch of 2, of 10 and of 41 rows, and one whose lengths are null."""
    rows = [(b, i, None if b == 4 else (i * 37) % 23 + 1) for b, n in enumerate((2, 10, 41, 40, 5)) for i in range(n)]
    d = spark.createDataFrame(rows, "batch bigint, idx bigint, seqlen bigint")
    for equal in (True, False):
        parts = {}
        got = balance.partition(d, 4, equal).collect()
        for r in got:
            parts.setdefault(r.batch, {}).setdefault(r.part, []).append(r.seqlen or 0)
        assert sorted((r.batch, r.idx, r.seqlen) for r in got if r.batch != 4) == [r for r in rows if r[0] != 4] and len(got) == len(rows)
        for batch, n in enumerate((2, 10, 41, 40, 5)):
            sizes = [len(parts[batch].get(p, [])) for p in range(4)]
            assert not equal or (sum(sizes) == n and max(sizes) == -(-n // 4) and (n != 40 or min(sizes) == 10))
        sums = [sum(parts[3].get(p, [])) for p in range(4)]
        assert max(sums) - min(sums) <= 23
