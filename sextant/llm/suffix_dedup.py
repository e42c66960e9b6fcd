"""Exact removal of repeated byte strings.

A byte goes if a string of ``width`` bytes covers it that also starts anywhere
else in the corpus.  Suffixes count as equal when their first ``width`` bytes
are, which is as deep as the contract asks; they are ranked through a cover
sample: each window's anchor (see ``repeats``) and, for anchors, the hash of
the context that all windows of the anchor lie in.  Anchors that occur once are
dropped, anchors whose whole context occurs again settle all their windows at
once, and only one of each such class stands for them where the rest is
compared, bucket by bucket, by hashes of whole windows.  Hashes that decide have 96
bits (see ``repeats``).  Passages of a number of words, which
may take fewer bytes than ``width``, are found in the same way with words in the
place of bytes; they can go as well, or be counted apart.

Defined cases: a null text is empty; texts shorter than ``width`` keep all;
equal texts of at least ``width`` bytes all go; rows with equal or null ids are
separate documents, each with a row of its own; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sextant.llm import exchange as X
from sextant.llm.base import table, texts_of
from sextant.llm.kernels import Words
from sextant.llm.repeats import View

WIDTH = 400
#: Bytes of an anchor: the longer, the fewer false candidates and the more anchors.
GRAM = 200
#: Words of a passage that is reported whatever its bytes: of over 50 words.
PASSAGE = 51
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _view(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, View]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
    return data, View(data, first, width, gram)


class _Plan:
    """What a batch asks and, with the replies, which windows repeat; ``kind``
    tells apart what is asked about bytes and about words."""

    def __init__(self, view: View, buckets: int, kind: str = "") -> None:
        self.view, self.buckets, self.kind = view, buckets, kind
        anchors, self.of, self.count = np.unique(X.even(view.anchor), return_inverse=True, return_counts=True)
        self.anchors = X.wide(anchors)
        self.classes, self.leader, self.class_of, self.class_count = X.unique(view.contexts())

    def first_ask(self, batch: int) -> list[pa.Table]:
        return [X.request(self.kind + "anchor", batch, self.anchors, self.buckets), X.request(self.kind + "context", batch, self.classes, self.buckets)]

    def second_ask(self, batch: int, replies: X.Replies) -> pa.Table:
        return X.request(self.kind + "window", batch, X.unique(self.view.hashes(self.settle(replies)[1]))[0], self.buckets)

    def settle(self, replies: X.Replies) -> tuple[np.ndarray, np.ndarray]:
        """Windows settled by their anchor's context; positions to compare."""
        again = (replies.read(self.kind + "anchor", self.anchors, self.buckets)[0] | (self.count > 1))[self.of]
        shared, first = replies.read(self.kind + "context", self.classes, self.buckets)
        twin = (shared | (self.class_count > 1))[self.class_of]
        leads = np.zeros(len(twin), bool)
        leads[self.leader[first]] = True
        view = self.view
        return view.windows(twin), np.flatnonzero(view.windows(again & (~twin | leads)))

    def starts(self, replies: X.Replies) -> np.ndarray:
        """Where windows start that occur again."""
        settled, compared = self.settle(replies)
        hashes, _, of, count = X.unique(self.view.hashes(compared))
        settled[compared[(replies.read(self.kind + "window", hashes, self.buckets)[0] | (count > 1))[of]]] = True
        return np.flatnonzero(settled)


def _passages(words: Words, starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """For each of ``n`` bytes of the texts end to end, whether a passage of
    ``width`` words that starts at one of ``starts`` covers it."""
    text = np.searchsorted(words.first, starts, "right") - 1  # the words' buffer has a separator after each text
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, words.start[starts] - text, 1)
    np.add.at(mark, words.end[starts + width - 1] - text, -1)
    return np.cumsum(mark[:n]) > 0


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep: bool = False, carry: list[str] | None = None, words: int = 0, count_only: bool = False) -> DataFrame:
    """``SCHEMA`` for each document; with ``keep`` also ``kept``, the text left
    (less what remains of a character that was cut);
    with ``carry`` also a struct of these columns of ``docs``; with ``words``
    passages of so many words that start anywhere else go too, whatever their bytes
    and separators, and ``passage_bytes`` has how many bytes such passages cover;
    with ``count_only`` they are counted there and not removed."""
    gram = max(1, width // 2)
    dealt, buckets = X.batched(docs, id_col, text_col, carry)

    def worded(texts: list[bytes]) -> tuple[Words, _Plan]:
        found = Words(texts)
        return found, _Plan(View(found.hash, found.first, words, max(1, words // 2)), buckets, "word ")

    def plans(group: pa.Table) -> Iterator[_Plan]:
        texts = texts_of(group["text"])
        yield _Plan(_view(texts, width, gram)[1], buckets)
        if words:
            yield worded(texts)[1]

    def first_ask(batch: int, group: pa.Table) -> pa.Table:
        return pa.concat_tables([asked for plan in plans(group) for asked in plan.first_ask(batch)])

    def second_ask(batch: int, group: pa.Table, replies: X.Replies) -> pa.Table:
        return pa.concat_tables([plan.second_ask(batch, replies) for plan in plans(group)])

    def finish(_: int, group: pa.Table, replies: X.Replies) -> pa.Table:
        texts = texts_of(group["text"])
        data, view = _view(texts, width, gram)
        gone = view.covered(_Plan(view, buckets).starts(replies))
        if words:
            found, plan = worded(texts)
            passages = _passages(found, plan.starts(replies), words, len(data))
            inside = np.concatenate([[0], np.cumsum(passages)])[view.first]
            gone = gone if count_only else gone | passages
        rows = []
        for text, lo, hi in zip(texts, view.first[:-1], view.first[1:], strict=True):
            g = gone[lo:hi]
            n = int(g.sum())
            left = text if not n else data[lo:hi][~g].tobytes()
            rows.append((len(text), n, int(np.count_nonzero(g[1:] & ~g[:-1])) + int(n > 0 and g[0]), hashlib.sha256(left).hexdigest(), left))
        cols = list(zip(*rows, strict=True))
        out = [group["doc_id"].combine_chunks(), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if words:
            out, names = [*out, pa.array(np.diff(inside), pa.int64())], [*names, "passage_bytes"]
        if keep:
            out, names = [*out, pa.array([x.decode("utf-8", "ignore") for x in cols[4]], pa.string())], [*names, "kept"]
        if carry:
            out, names = [*out, group["carry"].combine_chunks()], [*names, "carry"]
        return pa.table(out, names)

    replies = X.ask(dealt, first_ask)
    more = X.exchange(X.with_replies(dealt, replies, second_ask, X.REQUEST))
    return X.with_replies(dealt, replies.unionByName(more), finish, SCHEMA + ", passage_bytes bigint" * bool(words) + ", kept string" * keep + (f", carry {dealt.schema['carry'].dataType.simpleString()}" if carry else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract ``op7``: strings of 400 bytes over whole documents; ``passage_bytes``
    reports passages of over 50 words that start anywhere else, most of which take
    fewer bytes than that and so stay."""
    return repeated_bytes(table(spark, sf_dir, "documents"), words=PASSAGE, count_only=True)
