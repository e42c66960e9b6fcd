"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the model's compiled character map: at each position
the longest prefix that the map's double-array trie holds is replaced, and each
byte of the result is recorded with the byte of the source it came from.  The
trie is walked only where a byte has an edge at its root, and what lies between
is copied in one piece: a model without a map has an empty trie.  White space is
handled as the model says and escaped.  What is then segmented by the library is
this normalised text, by the model with its own normalisation taken out; its
pieces tile the text, so that the recorded alignment projects each piece to a
span of source bytes.  Ids decode with the model as it is.

Defined cases: a null text is empty, which leaves the begin and end ids; control
pieces and inserted spaces have empty spans; rows that share an id keep a row
each; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.base import table

#: Fixed values of the model format: the escaped space, what stands for a
#: malformed byte, and the types of pieces.
SPACE, MALFORMED = "▁".encode(), "�".encode()
UNKNOWN, CONTROL, USER, BYTE = 2, 3, 4, 6
#: Bytes of text that go to the library at once.
AT_ONCE = 1_000_000


class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 and the
    replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]
        #: Bytes with an edge at the root of the trie.
        self.edges = np.zeros(256, bool)
        if self.units:
            root = self._child(self.units[0])
            for b in range(256):
                self.edges[b] = root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b

    @staticmethod
    def _child(unit: int) -> int:
        """Distance to the children of a unit."""
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of data[at:] in the map."""
        if not self.units:
            return None
        found, node = None, self._child(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.replacements[start : self.replacements.index(b"\0", start)]


def _character(data: bytes, at: int) -> tuple[int, bytes]:
    """Length and bytes of the character at a position; a malformed byte counts
    as one."""
    lead = data[at]
    n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    piece = data[at : at + n]
    try:
        if n and piece.decode():
            return n, piece
    except UnicodeDecodeError:
        pass
    return 1, MALFORMED


@dataclass
class Encoded:
    """Ids with the span of source bytes of each."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Normaliser:
    """Applies a model's rules (a ModelProto), keeping the alignment."""

    def __init__(self, proto) -> None:
        rules = proto.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.user = sorted((p.piece.encode() for p in proto.pieces if p.type == USER), key=len, reverse=True)
        self.edges = self.map.edges.copy()
        self.edges[[u[0] for u in self.user if u]] = True

    def _replaced(self, data: bytes) -> tuple[bytes, np.ndarray, list[tuple[int, int]]]:
        """The text after the character map, the source byte of each byte, and
        where replacements lie in it."""
        raw = np.frombuffer(data, np.uint8)
        look = self.edges[raw] & (raw & 0xC0 != 0x80)
        try:
            data.decode()
        except UnicodeDecodeError:
            look |= raw >= 0x80
        out: list[bytes] = []
        align: list[np.ndarray] = []
        pieces, at, size = [], 0, 0
        for k in np.flatnonzero(look).tolist():
            if k < at:
                continue
            user = next((u for u in self.user if data.startswith(u, k)), None)
            n, piece = (len(user), user) if user else self.map.longest(data, k) or _character(data, k)
            if k + n > at and piece != data[k : k + n]:
                out += [data[at:k], piece]
                align += [np.arange(at, k), np.full(len(piece), k)]
                size += k - at
                pieces.append((size, size + len(piece)))
                size += len(piece)
                at = k + n
            elif user or n > 1:  # stays as it is, but nothing in it is looked at again
                out.append(data[at : k + n])
                align.append(np.arange(at, k + n))
                size += k + n - at
                at = k + n
        out.append(data[at:])
        align.append(np.arange(at, len(data)))
        return b"".join(out), np.concatenate(align), pieces

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the source
        byte it came from."""
        text, align, pieces = self._replaced(data)
        raw, end = np.frombuffer(text, np.uint8), len(data)
        blank = raw == 0x20
        if self.squeeze:
            lead = len(raw) - len(text.lstrip(b" "))
            again = blank.copy()
            again[1:] &= blank[:-1]
            again[:1] = False
            for lo, hi in pieces:  # a replacement loses only what it begins with
                first = hi - len(text[lo:hi].lstrip(b" "))
                again[first:hi] = False
                if lo < lead < hi and not (self.dummy and not self.suffix):
                    lead = lo
            again[:lead] = True
            raw, align, blank = raw[~again], align[~again], blank[~again]
        if not len(raw):
            return b"", np.array([len(data)])
        space = SPACE if self.escape else b" "
        start = align[0]
        times = np.where(blank, len(space), 1)
        text, align = raw.tobytes().replace(b" ", space), np.repeat(align, times)
        if self.dummy and not self.suffix:
            text, align = space + text, np.concatenate([np.full(len(space), start), align])
        if self.squeeze:
            while text.endswith(space):
                end = align[-len(space)]
                text, align = text[: -len(space)], align[: -len(space)]
        if self.dummy and self.suffix:
            text, align = text + space, np.concatenate([align, np.full(len(space), end)])
        return text, np.append(align, end)


class Codec:
    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        with open(path, "rb") as f:
            blob = f.read()
        proto = model.ModelProto()
        proto.ParseFromString(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.normaliser = Normaliser(proto)
        rules = proto.normalizer_spec
        rules.name, rules.precompiled_charsmap = "identity", b""
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
        #: Segments text that is normalised already.
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        #: Normalised bytes of each piece; -1 where it depends on the text.
        self.size = np.array([1 if p.type == BYTE else 0 if p.type == CONTROL else -1 if p.type == UNKNOWN else len(p.piece.encode()) for p in proto.pieces])

    def encode(self, texts: list[str]) -> list[Encoded]:
        """Ids with begin and end, each with its span."""
        out = []
        ready = [self.normaliser.normalise(t.encode()) for t in texts]
        plain = [norm.decode() for norm, _ in ready]
        for text, (norm, align), ids in zip(plain, ready, self.segmenter.encode(plain, add_bos=True, add_eos=True, num_threads=1), strict=True):
            number = np.array(ids, np.int64)
            size = self.size[number]
            if (size < 0).any():
                pieces = self.segmenter.encode(text, out_type=str)
                size[1:-1] = [len(p.encode()) if n < 0 else n for p, n in zip(pieces, size[1:-1], strict=True)]
            ends = np.cumsum(size)
            if ends[-1] != len(norm):
                raise ValueError(f"pieces cover {ends[-1]} bytes of {len(norm)}")
            starts = ends - size
            out.append(Encoded(number.astype("<u4"), align[starts], align[ends]))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > AT_ONCE:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts and ends (spans of source bytes), decoded text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for batch in batches:
            at = 0
            for texts in _groups(_texts(batch)):
                got = code.encode(texts)
                part = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([part, *(pa.array([getattr(e, k).astype(np.int64) for e in got], pa.list_(pa.int64())) for k in ("ids", "start", "end")), pa.array(code.decode([e.ids.tolist() for e in got]), pa.string())], ["doc_id", "ids", "starts", "ends", "decoded"])

    return _input(docs, id_col, text_col).mapInArrow(go, "doc_id bigint, ids array<bigint>, starts array<bigint>, ends array<bigint>, decoded string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same as digests: doc_id, n_tokens, ids_sha256, decoded_sha256, and
    spans_sha256 of the starts and ends as 64-bit integers."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for texts in _groups(_texts(batch)):
                got = code.encode(texts)
                for e, text in zip(got, code.decode([e.ids.tolist() for e in got]), strict=True):
                    spans = e.start.astype("<i8").tobytes() + e.end.astype("<i8").tobytes()
                    for to, x in zip(rows, (len(e.ids), *(hashlib.sha256(b).hexdigest() for b in (e.ids.tobytes(), text.encode(), spans))), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), *(pa.array(r, pa.string()) for r in rows[1:])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return _input(docs, id_col, text_col).mapInArrow(go, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def query(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Contract ``op6``: whole ``documents``."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"))
