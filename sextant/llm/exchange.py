"""Batched set membership between documents.

Documents are dealt into batches of about equal size.  A batch turns what it
wants compared (fingerprints of windows, say) into sorted unique hashes of 96 bits;
slices of these go to buckets by hash range; a bucket answers each slice with
bits, and if asked for sources with the first of them for what is shared; and the
batch, computed anew from its documents, reads the answers in the order of its
hashes.  Rows of the shuffles are packed arrays, a hash that occurs
in a third of all documents is sent once by each batch, and buckets are even
because hashes are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.base import row_bytes
from sextant.llm.kernels import WIDE, mix, unique_wide

U = np.uint64
REQUEST = "kind string, bucket int, batch bigint, hashes binary, extra binary"
REPLY = "batch bigint, kind string, bucket int, shared binary, first binary, source binary"
_REQUEST = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("extra", pa.binary())])
_REPLY = pa.schema([("batch", pa.int64()), ("kind", pa.string()), ("bucket", pa.int32()), ("shared", pa.binary()), ("first", pa.binary()), ("source", pa.binary())])
#: Where something lies: a document and a position in it.
PLACE = np.dtype([("id", "<i8"), ("at", "<i8")])
#: Bytes of a batch of documents, batches for one bucket, and buckets at least.  A
#: batch sends a slice to each bucket, so buckets are as large as memory allows
#: (some 100 bytes of text for a hash: 12 MB of hashes), and their number as low.
BATCH_BYTES, BATCHES_A_BUCKET, BUCKETS = 600_000, 256, 64
#: Hashes of a bucket that are compared at a time.
RANGE = 1 << 19


def batched(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> tuple[DataFrame, int]:
    """(batch, doc_id, text), and ``carry`` columns as a struct if any; and the
    number of buckets for this many documents.  Dealt by id and text, so that rows
    without an id, or with the same one, are spread unless they are equal."""
    n = max(8, -(-row_bytes(docs.select(id_col, text_col)) // BATCH_BYTES))
    more = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carry")] if carry else []
    out = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).alias("batch"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return out, max(BUCKETS, n // BATCHES_A_BUCKET)


def even(anchors: np.ndarray) -> np.ndarray:
    """Anchors are the least of many hashes and so small numbers, nearly all of which
    would lie in the first bucket; mixed, they are even."""
    return mix(anchors)


def wide(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes as ``WIDE`` ones."""
    out = np.zeros(len(hashes), WIDE)
    out["hi"] = hashes
    return out


def unique(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted unique hashes, the place of the first of each, which one each is, and
    how many are like it."""
    order, new, of = unique_wide(hashes)
    start = np.flatnonzero(new)
    which = np.empty(len(of), np.int64)
    which[order] = of
    return hashes[order[start]], order[start], which, np.diff(np.append(start, len(of)))


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes: the first bytes of all steps from one to the next, which are
    zeros and compress well, then the second bytes, and so on; and the low bits."""
    steps = np.diff(hashes["hi"], prepend=U(0))
    return steps.view(np.uint8).reshape(-1, 8).T[::-1].tobytes() + np.ascontiguousarray(hashes["lo"]).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    n = len(packed) // 12
    out = np.empty(n, WIDE)
    planes = np.frombuffer(packed, np.uint8, 8 * n).reshape(8, n)
    out["hi"] = np.cumsum(np.ascontiguousarray(planes[::-1].T).view(np.uint64)[:, 0], dtype=np.uint64) if n else 0
    out["lo"] = np.frombuffer(packed, np.uint32, n, 8 * n)
    return out


def bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the slice of each bucket begins in sorted hashes, and their number."""
    number = ((hashes["hi"] >> U(32)) * U(buckets)) >> U(32)
    return np.searchsorted(number, np.arange(buckets + 1, dtype=np.uint64))


def request(kind: str, batch: int, hashes: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> pa.Table:
    """Slices of sorted unique ``hashes``; ``extra`` has a ``PLACE`` for each."""
    cut = bounds(hashes, buckets)
    some = np.flatnonzero(np.diff(cut))
    rows = [[kind] * len(some), some, [batch] * len(some), [pack(hashes[cut[i] : cut[i + 1]]) for i in some], [None if extra is None else extra[cut[i] : cut[i + 1]].tobytes() for i in some]]
    return pa.table([pa.array(x, f.type) for x, f in zip(rows, _REQUEST, strict=True)], schema=_REQUEST)


def answer(group: pa.Table) -> pa.Table:
    """Of each hash of each slice of a bucket: ``shared``, whether another batch
    has it (with places: whether one has it in a document of smaller id), and
    ``first``, whether no batch of a smaller number has it; with places also
    ``source``, the smallest one of each hash that is shared.  Hashes are compared in
    ranges of about ``RANGE``, so that beside the slices little is held."""
    order = np.argsort(group["batch"].to_numpy(), kind="stable")
    held = lambda name: [x.as_buffer() for x in group[name]]
    packed, places = held("hashes"), held("extra") if group["extra"][0].is_valid else None
    ends = np.cumsum([packed[i].size // WIDE.itemsize for i in order])
    hashes = np.empty(ends[-1], WIDE)
    place = np.empty(ends[-1], PLACE) if places else None
    at = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    for i, (lo, hi) in zip(order.tolist(), at, strict=True):
        hashes[lo:hi] = unpack(packed[i])
        if places:
            place[lo:hi] = np.frombuffer(places[i], PLACE)
    shared, first = np.empty(len(hashes), bool), np.empty(len(hashes), bool)
    for some in _ranges(hashes, at):
        shared[some], first[some], least = _compared(hashes[some], place[some] if places else None)
        if places:
            place[some] = least
    bits = lambda x: pa.array([np.packbits(x[lo:hi]).tobytes() for lo, hi in at], pa.binary())
    sources = pa.array([place[lo:hi][shared[lo:hi]].tobytes() if places else None for lo, hi in at], pa.binary())
    take = lambda name: group[name].combine_chunks().take(pa.array(order))
    return pa.table([take("batch"), take("kind"), take("bucket"), bits(shared), bits(first), sources], schema=_REPLY)


def _ranges(hashes: np.ndarray, slices: list[tuple[int, int]]) -> Iterator[slice | np.ndarray]:
    """Where the hashes of each range lie in sorted slices, in the order of slices."""
    n = -(-len(hashes) // RANGE)
    if n <= 1:
        yield slice(None)
        return
    least, most = int(hashes["hi"].min()), int(hashes["hi"].max())
    edges = np.array([least + (most - least) * i // n for i in range(1, n)], np.uint64)
    cuts = np.array([[lo, *(lo + np.searchsorted(hashes["hi"][lo:hi], edges)).tolist(), hi] for lo, hi in slices])
    for start, stop in zip(cuts.T[:-1], cuts.T[1:], strict=True):
        count = stop - start
        if count.any():
            yield np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


def _compared(hashes: np.ndarray, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """``shared``, ``first`` and the least place of each of the hashes of all slices."""
    order, new, of = unique_wide(hashes)
    start = np.flatnonzero(new)
    shared, first, source = np.empty(len(hashes), bool), np.empty(len(hashes), bool), None
    if place is not None:
        place = place[order]
        rank = np.lexsort((place["at"], place["id"], of))  # a hash's places keep to its stretch
        least = place[rank[start]][of]
        shared[order] = least["id"] < place["id"]
        source = np.empty(len(hashes), PLACE)
        source[order] = least
    else:
        shared[order] = np.diff(np.append(start, len(order)))[of] > 1
    first[order] = new
    return shared, first, source


class Replies:
    """The answers to one batch."""

    def __init__(self, replies: pa.Table) -> None:
        self._by = {(r["kind"], r["bucket"]): (r["shared"], r["first"], r["source"]) for r in replies.to_pylist()}

    def read(self, kind: str, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(shared, first) for the sorted unique hashes that were asked about."""
        out = np.zeros((2, len(hashes)), bool)
        for part, answers in self._parts(kind, hashes, buckets):
            for to, packed in zip(out, answers[:2], strict=True):
                to[part] = np.unpackbits(np.frombuffer(packed, np.uint8), count=part.stop - part.start)
        return out[0], out[1]

    def sources(self, kind: str, hashes: np.ndarray, buckets: int) -> np.ndarray:
        """The smallest place of each hash that is shared."""
        shared, _ = self.read(kind, hashes, buckets)
        out = np.zeros(len(hashes), PLACE)
        for part, answers in self._parts(kind, hashes, buckets):
            out[part.start + np.flatnonzero(shared[part])] = np.frombuffer(answers[2], PLACE)
        return out

    def _parts(self, kind: str, hashes: np.ndarray, buckets: int) -> Iterator[tuple[slice, tuple]]:
        cut = bounds(hashes, buckets)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            yield slice(int(cut[i]), int(cut[i + 1])), self._by[kind, i]


def exchange(requests: DataFrame) -> DataFrame:
    return requests.groupBy("kind", "bucket").applyInArrow(answer, REPLY)


def ask(docs: DataFrame, f: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    """Replies to what ``f`` asks for each batch."""

    def go(group: pa.Table) -> pa.Table:
        return f(group["batch"][0].as_py(), group)

    return exchange(docs.groupBy("batch").applyInArrow(go, REQUEST))


def with_replies(docs: DataFrame, replies: DataFrame, f: Callable[[int, pa.Table, Replies], pa.Table], schema: str) -> DataFrame:
    """``f`` over each batch of documents with the replies to it."""
    empty = _empty(schema)

    def go(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return empty
        return f(group["batch"][0].as_py(), group, Replies(answers))

    return docs.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(go, schema)


def _empty(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


def empty_request() -> pa.Table:
    return _REQUEST.empty_table()


def joined(tables: Iterator[pa.Table]) -> pa.Table:
    return pa.concat_tables(list(tables))
