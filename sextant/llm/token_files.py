"""Token ids as flat binary files.

Format of a shard: ``NAME.bin`` has the ids, little-endian unsigned integers of
2 bytes if the vocabulary allows, else 4; ``NAME.idx`` has the magic, the bytes
of an id, the number of documents, then as 64-bit integers the offsets of the
documents (one more than there are, counted in ids from the shard's start) and
their ids.  Shards are ranges of doc_id; a shard's base in the whole stream is
the prefix sum of the shards before it, made in two levels of a DataFrame.

Defined cases: a null text is empty, which leaves just the end id; rows that
share an id follow each other, in the order of a hash of their texts, and may
take several shards; a null id comes first; an empty table makes no shard;
further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.llm.base import parts_for, scratch, table, text_hash, written
from sextant.llm.files import attempt_name, place

MAGIC = b"SXTOKEN1"
END_ID = 2
#: Bytes of text for one shard.
SHARD_BYTES = 20_000_000
#: Shards whose sizes one task sums.
GROUP = 1024
#: Pieces that a worker remembers the ids of, at about 200 bytes each, in each of
#: two generations: what was not used in the younger one is forgotten first.
REMEMBER = 700_000
#: Fixed value: how byte-level BPE of this family splits a text (letters, digits
#: and the rest, each with a space before), for texts without ``UNUSUAL``.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters that another library may put in another class.
UNUSUAL = re.compile(r"[^\t-\r -~\u00a0-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f\u2010-\u2027]")
#: Pieces that split as before when they are laid end to end.
CHAINS = re.compile(r" [^\W\d_]+")


def _nones(values: list) -> list[int]:
    """Where a list has None."""
    at, k = [], -1
    try:
        while True:
            k = values.index(None, k + 1)
            at.append(k)
    except ValueError:
        return at


class Encoder:
    """Encodes texts exactly as ``tokenizers`` does.  Pieces between splits are
    independent in byte-level BPE, so each distinct piece is encoded once; texts
    with special tokens or unusual characters go to the library whole."""

    def __init__(self, path: str) -> None:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.dtype, self.code = (np.dtype("<u2"), "H") if self.model.get_vocab_size() <= 1 << 16 else (np.dtype("<u4"), "I")
        #: Bytes of each token, whose spelling has a character for each byte.
        self.length = np.zeros(self.model.get_vocab_size(), np.int64)
        for token, i in self.model.get_vocab().items():
            self.length[i] = len(token)
        special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        pre = str(self.model.pre_tokenizer)
        self.splits = self.model.normalizer is None and pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pack(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces.  Most are a space and letters: a chain of them is
        encoded in one call and cut where the pieces' bytes end."""
        chained = list(filter(CHAINS.fullmatch, pieces))
        for at in range(0, len(chained), 2000):
            some = chained[at : at + 2000]
            text = "".join(some)
            ids = self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids
            packed, size = array(self.code, ids).tobytes(), self.dtype.itemsize
            ends = np.cumsum(self.length[ids])
            cuts = np.cumsum(list(map(len, some if text.isascii() else map(str.encode, some))))
            after = np.searchsorted(ends, cuts) + 1
            if ends[-1] != cuts[-1] or (ends[after - 1] != cuts).any():
                raise ValueError("a token goes over the end of a piece")
            before = np.concatenate([[0], after[:-1]]) * size
            self.known.update((p, packed[a:b]) for p, a, b in zip(some, before.tolist(), (after * size).tolist(), strict=True))
        rest = list(set(pieces).difference(chained))
        self.known.update(zip(rest, self._pack(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.splits or UNUSUAL.search(t) or (self.special and self.special.search(t))]
        for at in range(0, len(whole), 16):
            for i, ids in zip(whole[at : at + 16], self._pack([texts[i] for i in whole[at : at + 16]]), strict=True):
                out[i] = ids
        todo = [i for i in range(len(texts)) if out[i] is None]
        for at in range(0, len(todo), 64):
            split = [SPLIT.findall(texts[i]) for i in todo[at : at + 64]]
            found = [list(map(self.known.get, pieces)) for pieces in split]
            gaps = [_nones(ids) for ids in found]
            if new := {pieces[k] for pieces, at_ in zip(split, gaps, strict=True) for k in at_}:
                if len(self.known) + len(new) > REMEMBER:
                    self.older, self.known = self.known, {}
                again = {p: x for p in new if (x := self.older.get(p)) is not None}
                self.known.update(again)
                self._learn(list(new.difference(again)))
            for i, pieces, ids, at_ in zip(todo[at : at + 64], split, found, gaps, strict=True):
                for k in at_:
                    ids[k] = self.known[pieces[k]]
                out[i] = b"".join(ids)
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def index_bytes(width: int, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    return MAGIC + np.array([width, len(ids)], "<i8").tobytes() + offsets.astype("<i8").tobytes() + ids.astype("<i8").tobytes()


def read_index(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Bytes of an id, offsets, doc ids."""
    if data[:8] != MAGIC:
        raise ValueError("not an index of token ids")
    width, n = np.frombuffer(data, "<i8", 2, 8)
    numbers = np.frombuffer(data, "<i8", -1, 24)
    return int(width), numbers[: n + 1], numbers[n + 1 :]


#: Stands for a null id in an index.
NO_ID = np.iinfo(np.int64).min


def write(docs: DataFrame, folder: str, model: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of ``docs`` in ascending id order; the manifest: shard, file,
    n_docs, n_tokens, base (ids of all shards before it)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, out, lengths, ids = encoder(model), None, [], []
        end = np.array([end_id], code.dtype).tobytes()
        name = attempt_name("tokens", "")
        store, path = place(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(path)
                out = store.open_output_stream(f"{path}/{name}.bin", compression=None)
            for packed in code.encode([t or "" for t in batch.column("text").to_pylist()]):
                out.write(packed + end)
                lengths.append(len(packed) // code.dtype.itemsize + 1)
            ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy())
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        with store.open_output_stream(f"{path}/{name}.idx", compression=None) as to:
            to.write(index_bytes(code.dtype.itemsize, offsets, np.concatenate(ids)))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "n_docs": [len(lengths)], "n_tokens": [int(offsets[-1])]})

    n = parts_for(rows, shard_bytes)
    # A range by id alone would put all rows without an id into one shard.
    ranged = rows.withColumn("__h", text_hash(F.col("text"))).repartitionByRange(n, "doc_id", "__h").sortWithinPartitions("doc_id", "__h", "text").drop("__h")
    shards = written(ranged.mapInArrow(go, "shard int, file string, n_docs bigint, n_tokens bigint"), "shards")
    group = F.floor(F.col("shard") / GROUP)
    before = W.orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    starts = shards.groupBy(group.alias("group")).agg(F.sum("n_tokens").alias("n")).select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("group").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("group", group).withColumn("within", within).join(starts, "group").select("shard", "file", "n_docs", "n_tokens", (F.col("start") + F.col("within")).cast("bigint").alias("base"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_stream(f"{path}/{file}.idx", compression=None) as f:
                    width, offsets, ids = read_index(f.read())
                if store.type_name == "local":
                    data = np.memmap(f"{path}/{file}.bin", f"<u{width}", "r")
                else:
                    with store.open_input_file(f"{path}/{file}.bin") as f:
                        data = np.frombuffer(f.read(), f"<u{width}")
                crc = [zlib.crc32(data[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                start = pa.array(offsets[:-1] + base)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), start, pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = written(manifest, "manifest")
    n = max(1, min(4096, manifest.count()))
    return manifest.select("file", "base").repartition(n, "file").mapInArrow(go, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Contract ``op8``: whole ``documents``."""
    import public_tokenizers

    folder = scratch(spark, "tokens")
    return read(write(table(spark, sf_dir, "documents"), folder, model or public_tokenizers.path("byte_bpe_50k.json")), folder)
