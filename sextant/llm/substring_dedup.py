"""Removal of passages that an earlier document has.

Documents are parsed relative to all documents of smaller id.  The reference is
indexed in blocks: the windows of ``width`` words, by hash range, each with its
first place in the reference (the smallest id of a document that holds it, and
the word it starts at).  A document meets every block that shares an anchor with
it (see ``repeats``) and no other, as a block without a common anchor cannot hold
a window of it.  The parse is greedy: a factor begins at the first word whose
window the reference has, copies from that window's place, and goes on as long as
the next window lies at the next word of the same source.  At its boundary the
windows that reach over it are looked up as well, so that a factor from another
source may begin within it.  Factors are ``width`` words or longer; the words of
all factors are duplicate spans.

Defined cases: a null text has no words; a document shorter than ``width``
keeps all; of equal documents the one of smallest id keeps all; documents with
equal ids never remove from each other; a null id counts as larger than all
others; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sextant.llm import exchange as X
from sextant.llm.base import table, texts_of
from sextant.llm.kernels import Words
from sextant.llm.repeats import View

WIDTH = 50
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
LAST = np.iinfo(np.int64).max


def _view(group: pa.Table, width: int) -> tuple[list[bytes], View, np.ndarray]:
    """Texts, their words' view, and the id of the document of each word."""
    texts = texts_of(group["text"])
    words = Words(texts)
    ids = group["doc_id"].fill_null(LAST).to_numpy()
    return texts, View(words.hash, words.first, width, max(1, width // 2)), np.repeat(ids, words.counts())


def _candidates(view: View, replies: X.Replies, buckets: int) -> np.ndarray:
    anchors, of, count = np.unique(X.even(view.anchor), return_inverse=True, return_counts=True)
    return np.flatnonzero(view.windows((replies.read("anchor", X.wide(anchors), buckets)[0] | (count > 1))[of]))


def _lookups(view: View, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unique hashes of the windows at ``at``, which is each one's, and the first
    place that this batch has it at."""
    hashes, _, of, _ = X.unique(view.hashes(at))
    where = at - view.first[np.searchsorted(view.first, at, "right") - 1]
    order = np.lexsort((where, ids[at], of))
    least = np.zeros(len(hashes), X.PLACE)
    if len(order):
        first = order[np.searchsorted(of[order], np.arange(len(hashes)))]
        least["id"], least["at"] = ids[at[first]], where[first]
    return hashes, of, least


def factors(known: np.ndarray, source: np.ndarray, width: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy parse: start, end and source of the factors, given for each position
    whether the reference holds the window that starts there, and at which place,
    and where texts begin."""
    goes_on = np.zeros(len(known), bool)
    goes_on[1:] = known[1:] & known[:-1] & (source["id"][1:] == source["id"][:-1]) & (source["at"][1:] == source["at"][:-1] + 1)
    goes_on[first[(first > 0) & (first < len(known))]] = False
    begin = known & ~goes_on
    stop = known.copy()
    stop[:-1] &= ~goes_on[1:]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + width, source[starts]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep: bool = False) -> DataFrame:
    """``SCHEMA`` for each document; with ``keep`` also ``kept``, the words left,
    and ``spans``, the factors as [start, end, source id, source start) in words."""
    dealt, buckets = X.batched(docs, id_col, text_col)

    def first_ask(batch: int, group: pa.Table) -> pa.Table:
        return X.request("anchor", batch, X.wide(np.unique(X.even(_view(group, width)[1].anchor))), buckets)

    def second_ask(batch: int, group: pa.Table, replies: X.Replies) -> pa.Table:
        _, view, ids = _view(group, width)
        hashes, _, least = _lookups(view, ids, _candidates(view, replies, buckets))
        return X.request("window", batch, hashes, buckets, least)

    def finish(_: int, group: pa.Table, replies: X.Replies) -> pa.Table:
        texts, view, ids = _view(group, width)
        at = _candidates(view, replies, buckets)
        hashes, of, least = _lookups(view, ids, at)
        elsewhere = replies.read("window", hashes, buckets)[0]
        places = np.where(elsewhere, replies.sources("window", hashes, buckets), least)
        known, source = np.zeros(view.n, bool), np.zeros(view.n, X.PLACE)
        known[at[elsewhere[of] | (ids[at] > least["id"][of])]] = True
        source[at] = places[of]
        starts, ends, sources = factors(known, source, width, view.first)
        gone = np.zeros(view.n + 1, np.int32)
        np.add.at(gone, starts, 1)
        np.add.at(gone, ends, -1)
        gone = np.cumsum(gone[:-1]) > 0
        rows = []
        for text, lo, hi in zip(texts, view.first[:-1], view.first[1:], strict=True):
            n = int(np.count_nonzero(gone[lo:hi]))
            words = text.split()
            left = b" ".join(compress(words, ~gone[lo:hi]) if n else words)
            rows.append((int(hi - lo), n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
        cols = list(zip(*rows, strict=True))
        out = [group["doc_id"].combine_chunks(), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if not keep:
            return pa.table(out, names)
        spans: list[list[list[int]]] = [[] for _ in texts]
        owner = np.searchsorted(view.first, starts, "right") - 1
        for a, b, s, k in zip((starts - view.first[owner]).tolist(), (ends - view.first[owner]).tolist(), sources.tolist(), owner.tolist(), strict=True):
            spans[k].append([a, b, *s])
        return pa.table([*out, pa.array(cols[3], pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], [*names, "kept", "spans"])

    replies = X.ask(dealt, first_ask)
    more = X.exchange(X.with_replies(dealt, replies, second_ask, X.REQUEST))
    return X.with_replies(dealt, replies.unionByName(more), finish, SCHEMA + (", kept string, spans array<array<bigint>>" if keep else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract ``op9``: passages of 50 words over whole documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (h) WHERE first < doc_id),
a AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM a ANTI JOIN r USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
