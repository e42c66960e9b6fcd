"""Sampled token ids of episodes: slices, budgets, padding, without tokenising again.

A vocabulary is a table of the bytes of each id.  Where an action or a character ends is
found in the bytes of a sequence, and the first id whose bytes reach it by a search in
their prefix sums: ids are never turned to text and back.

Defined cases: null ids are null; ids that the vocabulary does not have are an error; no
ids have no bytes; bytes that are no UTF-8 are replaced in texts, and an incomplete
character at an end counts as cut."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

IDS = "array<int>"
SLICE = "struct<n_ids:int,n_text:int,boundary:string,text:string>"
SHOWN = "struct<n_ids:int,cut:boolean,text:string>"
OPENED = "struct<n:int,n_ids:int,cut:boolean,text:string>"
#: Bytes of texts, or ids, that are Python's or the encoder's objects at a time; a row of
#: more is a piece of its own.
PIECE = 1 << 18


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand
    for themselves, the others for letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each id of a byte-level vocabulary, and its encoder."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True  # what looks like one in a text is text
        letters, added = _byte_letters(), self.encoder.get_added_tokens_decoder()
        pieces = [b""] * self.encoder.get_vocab_size()
        for token, i in self.encoder.get_vocab().items():
            pieces[i] = added[i].content.encode() if i in added else bytes(letters[c] for c in token)
        self.pieces = pieces
        self.lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))

    def bytes_of(self, ids: list[int]) -> bytes:
        if ids and min(ids) < 0:
            raise ValueError(f"no id {min(ids)}")
        return b"".join(map(self.pieces.__getitem__, ids))

    def ends(self, ids: list[int]) -> list[int]:
        """How many bytes the sequence has behind each id."""
        return list(accumulate(self.lengths[ids].tolist())) if ids else []

    def slice(self, ids: list[int], closers: dict[str, bytes], opened: bytes = b"", eos: int | None = None, pad: int | None = None) -> tuple[int, int, str, str]:
        """Ids up to the first whose bytes complete an action: how many there are, how
        many of them are text, what ends them (a closer's name, eos or length), and
        their text.  Only closers behind ``opened`` count, if that is given.  The
        sequence itself ends with the first ``eos``, or before the first ``pad``."""
        n = next((k for k, i in enumerate(ids) if i in (eos, pad)), len(ids))
        text = ids[:n]
        ended = n < len(ids) and ids[n] == eos
        data = self.bytes_of(text)
        begin = data.find(opened) + len(opened) if opened else 0
        found = [] if opened and begin < len(opened) else [(data.find(c, begin) + len(c), name) for name, c in closers.items() if data.find(c, begin) >= 0]
        if not found:
            return n + ended, n, "eos" if ended else "length", data.decode("utf-8", "replace")
        end, name = min(found)
        n = int(np.searchsorted(self.ends(text), end)) + 1
        return n, n, name, self.bytes_of(text[:n]).decode("utf-8", "replace")

    def within(self, ids: list[int], most: int) -> tuple[int, bool, str]:
        """At most ``most`` ids, fewer where those would end within a character: how
        many, whether the rest is cut off, and their text."""
        data, ends = self.bytes_of(ids), self.ends(ids)
        k = min(most, len(ids))
        while k > 0 and not whole(data, ends[k - 1]):
            k -= 1
        return k, k < len(ids), data[: ends[k - 1] if k > 0 else 0].decode("utf-8", "replace")


def whole(data: bytes, end: int) -> bool:
    """Whether no character goes over ``end``."""
    if end < len(data):
        return data[end] & 0xC0 != 0x80
    for back in range(1, min(4, end + 1)):
        b = data[end - back]
        if b & 0xC0 != 0x80:
            return b < 0xC0 or back >= (2 if b < 0xE0 else 3 if b < 0xF0 else 4)
    return True


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def by_pieces(f: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``f`` over slices of the columns with at most ``PIECE`` bytes or ids in the first:
    what is made of a batch grows with its result only."""
    first = columns[0]
    lengths = pc.list_value_length(first) if pa.types.is_list(first.type) or pa.types.is_large_list(first.type) else pc.binary_length(first)
    ends = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(first) or not out:
        before = ends[at - 1] if at else 0
        stop = min(len(first), max(at + 1, int(np.searchsorted(ends, before + PIECE, "right"))))
        out.append(f(*(c.slice(at, stop - at) for c in columns)))
        at = stop
    return pa.concat_arrays(out)


def encoded(c: Column, path: str) -> Column:
    """Ids of texts, without special ones."""

    def piece(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        found = iter(vocabulary(path).encoder.encode_batch([x for x in rows if x is not None], add_special_tokens=False))
        return pa.array([None if x is None else np.array(next(found).ids, np.int32) for x in rows], pa.list_(pa.int32()))

    @F.arrow_udf(IDS)
    def f(texts: pa.Array) -> pa.Array:
        return by_pieces(piece, texts)

    return f(c)


def byte_lengths(c: Column, path: str) -> Column:
    """Bytes of each id."""

    def piece(ids: pa.Array) -> pa.Array:
        lengths = vocabulary(path).lengths
        return pa.array([None if x is None else lengths[x].tolist() if x else [] for x in ids.to_pylist()], pa.list_(pa.int32()))

    @F.arrow_udf(IDS)
    def f(ids: pa.Array) -> pa.Array:
        return by_pieces(piece, ids)

    return f(c)


def decoded(c: Column, path: str) -> Column:
    """Text of ids."""

    def piece(ids: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([None if x is None else v.bytes_of(x).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def f(ids: pa.Array) -> pa.Array:
        return by_pieces(piece, ids)

    return f(c)


def action_slices(c: Column, path: str, closers: tuple[str, ...], opened: str = "", eos: int | None = None, pad: int | None = None) -> Column:
    """``SLICE`` of each sequence of sampled ids: see ``Vocabulary.slice``."""
    tags = {x.strip("</>"): x.encode() for x in closers}

    def piece(ids: pa.Array) -> pa.Array:
        v = vocabulary(path)
        rows = [None if x is None else dict(zip(("n_ids", "n_text", "boundary", "text"), v.slice(x, tags, opened.encode(), eos, pad), strict=True)) for x in ids.to_pylist()]
        return pa.array(rows, pa.struct([("n_ids", pa.int32()), ("n_text", pa.int32()), ("boundary", pa.string()), ("text", pa.string())]))

    @F.arrow_udf(SLICE)
    def f(ids: pa.Array) -> pa.Array:
        return by_pieces(piece, ids)

    return f(c)


_SHOWN = [("n_ids", pa.int32()), ("cut", pa.bool_()), ("text", pa.string())]


def shown_within(c: Column, most: Column, path: str) -> Column:
    """``SHOWN`` of each sequence under a budget of ids: see ``Vocabulary.within``."""

    def piece(ids: pa.Array, most: pa.Array) -> pa.Array:
        v = vocabulary(path)
        rows = [None if x is None else dict(zip(("n_ids", "cut", "text"), v.within(x, m or 0), strict=True)) for x, m in zip(ids.to_pylist(), most.to_pylist(), strict=True)]
        return pa.array(rows, pa.struct(_SHOWN))

    @F.arrow_udf(SHOWN)
    def f(ids: pa.Array, most: pa.Array) -> pa.Array:
        return by_pieces(piece, ids, most)

    return f(c, most)


def encoded_within(c: Column, most: Column, path: str) -> Column:
    """``OPENED`` of each text: how many ids it has, and what ``shown_within`` says of
    them, by one function, so that ids stay in its worker."""

    def piece(texts: pa.Array, most: pa.Array) -> pa.Array:
        v, rows = vocabulary(path), texts.to_pylist()
        found = iter(v.encoder.encode_batch([x for x in rows if x is not None], add_special_tokens=False))
        out = []
        for x, m in zip(rows, most.to_pylist(), strict=True):
            ids = None if x is None else next(found).ids
            out.append(None if ids is None else dict(zip(("n", "n_ids", "cut", "text"), (len(ids), *v.within(ids, m or 0)), strict=True)))
        return pa.array(out, pa.struct([("n", pa.int32()), *_SHOWN]))

    @F.arrow_udf(OPENED)
    def f(texts: pa.Array, most: pa.Array) -> pa.Array:
        return by_pieces(piece, texts, most)

    return f(c, most)


def padded(c: Column, width: Column, pad: int, left: bool = False) -> Column:
    """ids, mask and positions of sequences in ``width`` places; what does not fit is cut
    where it would be padded: on the right, or with ``left`` on the left."""
    kept = F.when(F.size(c) <= width, c).otherwise(F.slice(c, F.size(c) - width + 1, width) if left else F.slice(c, F.lit(1), width))
    n = F.least(F.size(c), width)
    fill = lambda x: F.array_repeat(F.lit(x).cast("int"), (width - n).cast("int"))
    sides = lambda a, x: F.concat(fill(x), a) if left else F.concat(a, fill(x))
    ones = F.array_repeat(F.lit(1), n.cast("int"))
    # Positions count what is not padding; padding has that of what is before it, or 0.
    steps = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda x: (x - 1).cast("int"))).otherwise(F.array().cast(IDS))
    after = F.array_repeat(F.greatest(n - 1, F.lit(0)).cast("int"), (width - n).cast("int"))
    return F.struct(sides(kept, pad).alias("ids"), sides(ones, 0).alias("mask"), (F.concat(fill(0), steps) if left else F.concat(steps, after)).alias("positions"))
