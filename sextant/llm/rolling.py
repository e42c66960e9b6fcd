"""Features of the rows of a source in the time before each row.

Times are whole minutes.  A pane is what a source has in one minute: number of
rows, sum and sorted histogram of lengths, rows of each language.  Panes are
aggregated with what shares a minute, language and length counted before it moves.
They are dealt into blocks of the longest window: the window of any row of a block
ends in the block and begins in the one before, so a pane goes to its own block and
to the next one, and no task has more than two windows of one source, however long
the source lives or large it is.  Within a block the windows' panes are merged: as
the window moves on, histograms of panes that enter are added to its counts by
length and those of panes that leave are taken off; the ranks are read off the
cumulated counts.

Defined cases: a null text has no length, and an empty one length 0; a null source
is a source; a null language counts as a row only; a row without an id, or with one
whose time does not fit 64 bits, has no time: it is in no window, and its own is
empty; rows that share an id keep a row each; no documents give no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.base import by_runs, table

MINUTE = 60
WINDOWS = (600, 43_200)
#: Shares of a window's lengths that are reported, in percent.
RANKS = (50, 90)
_FEATURES = ["n_events", "sum_chars", "n_langs", "median_chars", "high_chars"]
_PANE = "source string, block bigint, minute bigint, own boolean, n bigint, chars bigint, langs array<struct<lang:string,n:bigint>>, lengths array<struct<length:bigint,n:bigint>>"
_FOUND = "source string, minute bigint, window_s bigint, n_events bigint, sum_chars bigint, n_langs bigint, median_chars bigint, high_chars bigint"
_SCHEMA = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _FOUND.split(", ")])


def panes(rows: DataFrame) -> DataFrame:
    """(source, minute, n, chars, langs, lengths) from rows of source, minute, lang
    and length: one row for each source and minute."""
    alike = rows.where("minute IS NOT NULL").groupBy("source", "minute", "lang", "length").agg(F.count(F.lit(1)).alias("n"))
    return alike.groupBy("source", "minute").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.col("length") * F.col("n")), F.lit(0)).cast("bigint").alias("chars"),
        F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "n"))).alias("langs"), F.collect_list(F.when(F.col("length").isNotNull(), F.struct("length", "n"))).alias("lengths"),
    )


def _flat(lists: pa.ChunkedArray, field: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bounds of each list in the flattened ones, counts and values."""
    lists = lists.combine_chunks()
    flat = lists.flatten()
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    return np.concatenate([[0], np.cumsum(sizes)]), flat.field("n").to_numpy(zero_copy_only=False), flat.field(field)


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def slide(group: pa.Table, width: int) -> dict[str, list]:
    """The features of the window of ``width`` minutes before each own pane, from
    panes sorted by minute."""
    minute, own = group["minute"].to_numpy(), group["own"].to_numpy(zero_copy_only=False)
    at = np.flatnonzero(own)
    lo, hi = np.searchsorted(minute, minute[at] - width), np.searchsorted(minute, minute[at])
    sums = [np.concatenate([[0], np.cumsum(group[c].to_numpy())]) for c in ("n", "chars")]
    of_length, n_length, length = _flat(group["lengths"], "length")
    values, rank_of = np.unique(length.to_numpy(zero_copy_only=False), return_inverse=True)
    of_lang, n_lang, lang = _flat(group["langs"], "lang")
    lang_of, langs = _codes(lang)
    lengths, spoken = np.zeros(len(values), np.int64), np.zeros(len(langs), np.int64)
    kinds, ranked = [], []
    begin = end = 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        for counts, of, n, bounds in ((lengths, rank_of, n_length, of_length), (spoken, lang_of, n_lang, of_lang)):
            enter, leave = slice(bounds[end], bounds[b]), slice(bounds[begin], bounds[a])
            np.add.at(counts, of[enter], n[enter])
            np.subtract.at(counts, of[leave], n[leave])
        begin, end = a, b
        kinds.append(int(np.count_nonzero(spoken)))
        below = np.cumsum(lengths)
        m = int(below[-1]) if len(below) else 0
        ranked.append([int(values[np.searchsorted(below, -(-share * m // 100))]) if m else None for share in RANKS])
    counted = [(s[hi] - s[lo]).tolist() for s in sums]
    return {"minute": minute[at].tolist(), "n_events": counted[0], "sum_chars": counted[1], "n_langs": kinds, "median_chars": [x[0] for x in ranked], "high_chars": [x[1] for x in ranked]}


def windows(found: DataFrame, widths: Sequence[int] = WINDOWS) -> DataFrame:
    """Features of each pane's source and minute, for each width in seconds."""
    block = max(widths) // MINUTE

    def go(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if not any(group["own"].to_pylist()):
            return
        source = group["source"][0].as_py()
        for width in widths:
            cols = slide(group, width // MINUTE)
            n = len(cols["minute"])
            yield pa.RecordBatch.from_pydict({"source": [source] * n, "window_s": [width] * n, **cols}, _SCHEMA)

    own = F.expr(f"(minute - pmod(minute, {block})) DIV {block}")
    dealt = found.select("*", F.explode(F.array(F.struct(own.alias("block"), F.lit(True).alias("own")), F.struct((own + 1).alias("block"), F.lit(False).alias("own")))).alias("to"))
    dealt = dealt.select("source", F.col("to.block").alias("block"), "minute", F.col("to.own").alias("own"), "n", "chars", "langs", "lengths")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return by_runs(dealt, parts, ["block", "source"], ["minute"], go, _FOUND)


def rolling_features(rows: DataFrame, minute: Column, widths: Sequence[int] = WINDOWS) -> DataFrame:
    """``rows`` (with source, lang and length) with the features of the windows of
    ``widths`` seconds that end before their minute: a row for each width."""
    timed = rows.withColumn("minute", minute)
    found = windows(panes(timed), widths).select(F.col("source").alias("s"), F.col("minute").alias("m"), F.col("window_s").alias("w"), *_FEATURES)
    wanted = timed.withColumn("window_s", F.explode(F.array(*(F.lit(w).cast("bigint") for w in widths))))
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("minute") == F.col("m")) & (F.col("window_s") == F.col("w"))
    return wanted.join(found, on, "left").drop("s", "m", "w").na.fill(0, _FEATURES[:3])


def event_minute(doc_id: Column) -> Column:
    """floor((doc_id + (crc32(doc_id) mod 10000)) / 6); null where that leaves 64 bits
    once it is in seconds."""
    drift = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10_000))
    late = F.try_add(doc_id, drift)
    minute = F.call_function("div", late, F.lit(6)) - F.when(F.signum(F.call_function("mod", late, F.lit(6))) < 0, 1).otherwise(0)
    return F.when(F.try_multiply(minute, F.lit(MINUTE)).isNotNull(), minute)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract ``op12``: two windows before each row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.char_length("text").cast("bigint").alias("length"))
    out = rolling_features(rows, event_minute(F.col("doc_id")))
    return out.select("doc_id", "window_s", (F.col("minute") * MINUTE).alias("event_s"), *_FEATURES)


SQL = """
WITH k AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc FROM (SELECT unnest(range(256)) AS n)),
c AS (
  SELECT doc_id, source, lang, length(text) AS n,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, k),
t AS (SELECT row_number() OVER () AS r, doc_id, source, lang, n, CAST(60 * floor((doc_id + h % 10000) / 6.0) AS BIGINT) AS event_s FROM c),
w AS (SELECT t.*, w.s AS window_s FROM t, (VALUES (600), (43200)) AS w(s)),
j AS (
  SELECT w.r, any_value(w.doc_id) AS doc_id, w.window_s, any_value(w.event_s) AS event_s, count(o.r) AS n_events, coalesce(sum(o.n), 0) AS sum_chars, count(DISTINCT o.lang) AS n_langs,
    list(o.n ORDER BY o.n) FILTER (o.n IS NOT NULL) AS l
  FROM w LEFT JOIN t o ON o.source IS NOT DISTINCT FROM w.source AND o.event_s >= w.event_s - w.window_s AND o.event_s < w.event_s GROUP BY w.r, w.window_s)
SELECT doc_id, CAST(window_s AS BIGINT) AS window_s, event_s, n_events, CAST(sum_chars AS BIGINT) AS sum_chars, n_langs,
  l[(len(l) + 1) // 2] AS median_chars, l[(90 * len(l) + 99) // 100] AS high_chars
FROM j
"""
