"""What filters do to each other in every order they could run in.

A document has a mask of the filters it fails.  Documents are counted by part and
mask; each such count contributes to every edge (filters already applied, next
filter) of the lattice of subsets: 5 * 2^4 = 80 edges.  An order of the filters is
a path through the lattice, so its steps are edges: the 120 * 5 steps join the
aggregated edges, and a filter's sum over all orders weighs each edge by the number
of orders that use it.

The filters: ``A`` under 50 words, ``B`` few distinct words, ``C`` many capitals,
``D`` odd characters, ``E`` a text that a smaller doc_id has.  Texts are compared by
128-bit digests.  Rows alike are counted before they move, and the least doc_id of
a text is found among counts by text, part and label, so that a text that a third of
all rows have is neither joined nor ranked row by row.

Defined cases: null texts are empty, and equal to empty ones; a null source and an
empty one are the same part; without words only A (and no B) fails, of an empty text
C does not fail; a row without an id neither fails E nor makes others fail it, and
has no label; rows that share id and text do not make each other fail E; of several
labels of an id the larger counts, null as 0; no documents give no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.base import table, texts_of

FILTERS = "ABCDE"
DUPLICATE = FILTERS.index("E")
LEAST_WORDS = 50
_UPPER = bytes(range(65, 91))
_ODD = re.compile(rb"[#$%&*|]")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failed_alone(data: bytes) -> int:
    """Bits of the filters that a text fails by itself."""
    words = data.split()  # bytes split at exactly \x20 and \x09-\x0D
    points = len(data) if data.isascii() else len(data.decode("utf-8", "replace"))
    upper = len(data) - len(data.translate(None, _UPPER))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * upper > 5 * points) << 2 | (_ODD.search(data) is not None) << 3


def judged(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, doc_id, failed (bits of A to D) and digest of the text for each row."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            failed = pa.array([failed_alone(x) for x in texts], pa.int32())
            digest = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), failed, digest], ["part", "doc_id", "failed", "digest"])

    rows = docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(go, "part string, doc_id bigint, failed int, digest binary")


def masks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("key")).agg(*(F.coalesce(F.max(c), F.lit(0)).cast("int").alias(c) for c in ("quality", "toxic"))).withColumn("has_id", F.lit(True))
    alike = rows.groupBy("doc_id", "digest", "part", "failed").agg(F.count(F.lit(1)).alias("n"))
    keyed = alike.withColumn("key", F.coalesce("doc_id", F.xxhash64("digest"))).withColumn("has_id", F.col("doc_id").isNotNull())  # rows without an id are spread
    told = keyed.join(marks, ["key", "has_id"], "left").select("doc_id", "digest", "part", "failed", "n", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).na.fill(False)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    same = told.groupBy("digest", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"), first.alias("first"))
    # The rows of a text here are at most its parts times its labels.
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passes = F.col("free") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    split = same.select("part", "failed", "good", "toxic", "n", passes.alias("passes"))
    both = F.explode(F.array(F.struct(F.col("failed").alias("mask"), F.col("passes").alias("n")), F.struct(F.col("failed").bitwiseOR(1 << DUPLICATE).alias("mask"), (F.col("n") - F.col("passes")).alias("n"))))
    return split.select("part", "good", "toxic", both.alias("of")).select("part", "of.mask", "of.n", "good", "toxic").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def edges(counts: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """(part, applied, next, ``COUNTS``, shapley): every edge of the lattice."""
    all_edges = [(applied, f) for applied in range(1 << n_filters) for f in range(n_filters) if not applied >> f & 1]
    edge = F.explode(F.array(*(F.struct(F.lit(applied).alias("applied"), F.lit(f).alias("next"), F.lit(1 << f).alias("bit"), F.lit(factorial(k := applied.bit_count()) * factorial(n_filters - 1 - k)).cast("bigint").alias("orders")) for applied, f in all_edges)))
    at = counts.select("*", edge.alias("e")).select("*", "e.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    out = at.groupBy("part", "applied", "next", "orders").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "next")))


def steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, step, applied, next) of all orders: 600 rows of five filters."""
    rows = []
    for order in permutations(range(len(filters))):
        applied = 0
        for k, f in enumerate(order):
            rows.append(("".join(filters[x] for x in order), k + 1, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """A row for each part, order of the filters and step."""
    on = steps(docs.sparkSession)  # 600 rows whatever the input
    found = edges(masks(judged(docs, part), labels)).join(F.broadcast(on), ["applied", "next"])
    return found.select("part", "filter_order", "step", *(F.col(c).cast("bigint").alias(c) for c in [*COUNTS, "shapley"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract ``op13``: five filters over ``documents``, by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
    CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
b AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
o AS (SELECT p.f AS p, q.f AS q, r.f AS r, s.f AS s, 10 - p.f - q.f - r.f - s.f AS u FROM b p, b q, b r, b s WHERE p.f NOT IN (q.f, r.f, s.f) AND q.f NOT IN (r.f, s.f) AND r.f <> s.f),
s AS (
  SELECT chr(65 + p) || chr(65 + q) || chr(65 + r) || chr(65 + s) || chr(65 + u) AS filter_order, x.step, x.applied, x.next FROM o,
    LATERAL (SELECT unnest([{'step': 1, 'applied': 0, 'next': p}, {'step': 2, 'applied': 1 << p, 'next': q}, {'step': 3, 'applied': (1 << p) + (1 << q), 'next': r},
      {'step': 4, 'applied': (1 << p) + (1 << q) + (1 << r), 'next': s}, {'step': 5, 'applied': 31 - (1 << u), 'next': u}]) AS x)),
r AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, next,
    CAST(sum(n) FILTER (mask & (applied | (1 << next)) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & applied = 0 AND mask & (1 << next) <> 0) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (mask & applied <> 0 AND mask & (1 << next) <> 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (mask = 1 << next) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (mask & applied = 0 AND mask & (1 << next) <> 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (mask & applied = 0 AND mask & (1 << next) <> 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, next)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
  coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, next), 0) AS BIGINT) AS shapley
FROM r
"""
