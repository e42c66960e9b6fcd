"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words.  Each window of ``window`` words has as fingerprint the
smallest hash of its ``k``-grams, so that equal windows have equal
fingerprints: whatever span of ``window`` words a text shares with an item is
found.  Fingerprints of all documents meet those of the benchmark; only the
documents hit are read again, and there the hits are extended to whole windows
and compared word by word.

Defined cases: a null text has no words, is never hit, and gives the digest of
the empty string; an item without words has no window; an item of fewer words
than ``window`` is one window of its own length; repeated items each count;
every document is judged by its own text and has its own row, also where rows
share an id or have none; a null item id counts as an item named by the empty
string; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.llm.base import join_rows, small_enough, table, text_hash, written

WINDOW = 10
K = 4
#: What separates words, and the letters that are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many fingerprints of the benchmark are broadcast (16 bytes each), and
#: up to so many bytes of its windows' texts and items.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 48 << 20
#: Up to so many ids of documents that are hit are broadcast.
BROADCAST_DOCS = 200_000
#: Copies of the benchmark's side in a shuffled join, so that one very frequent
#: fingerprint is spread over so many tasks.
SALT = 16
#: What a decision on a document holds for: equal texts under one id share it.
KEY = ["doc", "text_hash"]


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none of a null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, SEPARATORS), "")


def rough_words(text: Column) -> Column:
    """As ``words``, but all letters in lower case, which is faster: equal words
    stay equal and separators stay where they are, so it serves for a search
    whose hits are compared exactly.  Sigma goes first: its lower case depends on
    what follows."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("Σ"), F.lit("σ"))), SEPARATORS), "")


def _shift(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def _pairwise(df: DataFrame, to: str, a: str, by: int, f) -> DataFrame:
    """to[i] = f(a[i], a[i + by]); the last ``by`` elements stay as they are."""
    return df.withColumn(to, F.zip_with(F.col(a), _shift(F.col(a), by), f))


def fingerprints(df: DataFrame, words_column: str, window: int = WINDOW, k: int = K) -> DataFrame:
    """Adds ``fp``: at i the smallest hash of a k-gram in the window of words from
    i on.  Only complete windows have one."""

    def gram(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b)

    df = df.withColumn("fp", F.transform(F.col(words_column), lambda w: F.xxhash64(w)))
    width = 1
    while width < k:
        df = _pairwise(df, "fp", "fp", width, gram)
        width *= 2
    reach = 1
    while reach < window - k + 1:
        step = min(reach, window - k + 1 - reach)
        df = _pairwise(df, "fp", "fp", step, lambda a, b: F.least(a, b))
        reach += step
    return df.withColumn("fp", F.slice("fp", F.lit(1), F.greatest(F.size(words_column) - (window - 1), F.lit(0))))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each distinct window: its number of words, its words joined by
    a space, and the ids of the items that hold it."""
    base = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(window))
    each = base.select("item", width.alias("len"), F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.array_join(F.slice("w", i, width), " "))).alias("gram"))
    return each.distinct()


def _hit_join(left: DataFrame, right: DataFrame, on: list[str], broadcast: bool) -> DataFrame:
    """left_outer-free inner join on ``on``; unless broadcast, the left side is
    salted and the right side copied, so that no key is one task's alone."""
    if broadcast:
        return left.join(F.broadcast(right), on)
    left = left.withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(SALT)))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    return left.join(right, [*on, "salt"]).drop("salt")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: ``id_col``, text_hash, n_words, n_hit, n_items, items (ids as
    strings, sorted), hits (array of [start, end) in words), contaminated."""
    k = min(K, window)
    grams = written(item_windows(items, item_id, item_text, window), "windows")
    total = grams.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("gram") + F.octet_length("item") + 48), F.lit(0)).alias("b")).collect()[0]  # one row
    few, light = total.n <= BROADCAST_WINDOWS, total.b <= BROADCAST_BYTES
    texts = grams.select("len", "gram").distinct()
    short = [r.len for r in texts.where(F.col("len") < window).select("len").distinct().collect()]  # at most window - 1 rows

    full = texts.where(F.col("len") == window).select(rough_words(F.col("gram")).alias("w"))
    # The outer form: a filter inferred from the other one repeats all of ``fingerprints``.
    item_fps = fingerprints(full, "w", window, k).select(F.explode_outer("fp").alias("fp"))
    for n in short:
        words_n = texts.where(F.col("len") == n).select(rough_words(F.col("gram")).alias("w"))
        item_fps = item_fps.unionByName(_runs(words_n, [n]).select(F.explode_outer(f"run{n}").alias("fp")))
    item_fps = item_fps.where("fp IS NOT NULL").distinct().select("fp", F.lit(1).alias("hit"))

    text = F.col(text_col).cast("string")
    keys = [F.col(id_col).alias("doc"), text_hash(text).alias("text_hash")]
    base = docs.select(*keys, rough_words(text).alias("w"))
    marked = _runs(fingerprints(base, "w", window, k), short)
    found = F.array_distinct(F.flatten(F.array("fp", *(f"run{n}" for n in short))))
    # Counted before fingerprints become rows, so that no row carries all words.
    counted = marked.select(*KEY, F.size("w").cast("bigint").alias("n_words"), found.alias("found"))
    seen = counted.select(*KEY, "n_words", F.greatest(F.size("found"), F.lit(1)).alias("size"), F.explode_outer("found").alias("fp"))
    if few:
        seen = seen.join(F.broadcast(item_fps), "fp", "left")
    else:
        seen = seen.withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(SALT)))
        copies = item_fps.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
        seen = seen.join(copies, ["fp", "salt"], "left")
    # Each of the documents of a key made ``size`` rows.
    copies = (F.count(F.lit(1)) / F.max("size")).cast("bigint")
    stats = written(seen.groupBy(*KEY).agg(F.max("n_words").alias("n_words"), F.max("hit").alias("maybe"), copies.alias("copies")), "fingerprinted")

    suspects = stats.where(F.col("maybe") == 1).select(*KEY)
    again = join_rows(docs.select(*keys, text.alias("t")), suspects, KEY, "left_semi", BROADCAST_DOCS)
    again = again.select(*KEY, words(F.col("t")).alias("w"))
    spans = None
    for n in [window, *short]:
        each = again.where(F.size("w") >= n).select(*KEY, F.explode_outer(_located(F.col("w"), n)).alias("x")).select(*KEY, F.lit(n).alias("len"), "x.*")
        spans = each if spans is None else spans.unionByName(each)
    hits = written(_hit_join(spans, texts, ["len", "gram"], light).select(*KEY, "at", "len", "gram").distinct(), "hits")

    order = W.partitionBy(*KEY).orderBy("at", "len")
    before = F.max(F.col("at") + F.col("len")).over(order.rowsBetween(W.unboundedPreceding, -1))
    covered = hits.select(*KEY, "at", "len").withColumn("before", F.coalesce(before, F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("at") + F.col("len") - F.greatest(F.col("at"), F.col("before")))
    counted = covered.groupBy(*KEY).agg(F.sum(fresh).cast("bigint").alias("n_hit"), F.array_sort(F.collect_list(F.struct((F.col("at") - 1).alias("start"), (F.col("at") + F.col("len") - 1).alias("end")))).alias("hits"))
    owners = _hit_join(hits.select(*KEY, "len", "gram").distinct(), grams, ["len", "gram"], light).select(*KEY, "item")
    listed = owners.groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = counted.join(listed.select(F.col("doc").alias("__d"), F.col("text_hash").alias("__h"), "items"), F.col("doc").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h"))).select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), "n_hit", "hits", "items")
    none = F.array().cast("array<string>")
    alone = stats.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return (
        alone.join(hit, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash")), "left")
        .select(F.col("doc").alias(id_col), "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("items", none).alias("items"), "hits")
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def _located(w: Column, n: int) -> Column:
    """Each run of ``n`` words with where it starts, counted from 1."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i, F.lit(n)), " ").alias("gram")))


def _runs(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``runN`` for each N of ``lengths``: hashes of all runs of N words of
    ``w``, apart from the fingerprints of windows; each length grows by a word."""
    if not lengths:
        return df
    df = df.withColumn("each", F.transform("w", lambda w: F.xxhash64(w, F.lit(7)))).withColumn("run", F.col("each"))
    for n in range(1, max(lengths) + 1):
        if n > 1:
            whole = F.slice("run", F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(0)))
            df = df.withColumn("run", F.zip_with(whole, F.slice("each", F.lit(n), F.greatest(F.size("w") - (n - 1), F.lit(0))), lambda a, b: F.xxhash64(a, b)))
        if n in lengths:
            df = df.withColumn(f"run{n}", F.col("run"))
    return df


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract ``op4``: whole documents against the whole benchmark."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""
