"""Archives of lines as a data source, in streams; extracted files with offsets, read
by position.

``archive_lines`` reads tar archives (plain or compressed) and compressed files of
lines: one partition for each archive, since their formats allow no other way, each read
in pieces, so that an archive's size does not matter.  ``extract`` writes the members of
archives as files of lines, each with a file of 64-bit offsets, and a manifest with the
digests of both.  ``positional_rows`` reads extracted files by ranges of rows: filters on
``row`` and ``file`` become byte ranges, so a look-up reads the lines it asks for.

Defined cases: a line ends with its line feed or with the file; a last line without one
counts; empty members have no lines; a blank line is a line; bytes that are no UTF-8 are
replaced; files that are no archives fail; what an attempt that failed has written is
never read, since only the manifest's files are."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import json
import lzma
import tarfile
import uuid
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Lines and bytes of a batch at most, bytes read at once, rows of a partition.
LINES, BYTES, PIECE, ROWS = 4096, 4 << 20, 1 << 20, 100_000
#: Bytes of lines that a task compresses at a time, about.
PIECE_BYTES = 64 << 20
_LINES = pa.schema([("archive", pa.string()), ("member", pa.string()), ("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("line", pa.string())])
_ROWS = pa.schema([("file", pa.string()), ("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("line", pa.string())])
MANIFEST = "archive string, member string, file string, offsets string, rows bigint, bytes bigint, sha256 string, offsets_sha256 string"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path: ``file:`` and the stores Arrow knows."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def opened(uri: str) -> BinaryIO:
    store, path = place(uri)
    return io.BufferedReader(store.open_input_stream(path, compression=None), PIECE)


def listed(uri: str) -> list[str]:
    """Paths of a file, of the files below a folder, or of those that a pattern fits, as
    they can be opened."""
    store, path = place(uri)
    head = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    if any(c in path for c in "*?["):
        plain = path[: min(path.find(c) for c in "*?[" if c in path)].rpartition("/")[0]
        found = store.get_file_info(fs.FileSelector(plain, recursive=True))
        found = [f for f in found if f.path.count("/") == path.count("/") and fnmatchcase(f.path, path)]
    elif store.get_file_info(path).type == fs.FileType.File:
        return [uri]
    else:
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def unpacked(raw: io.BufferedReader) -> BinaryIO:
    """The stream without its compression, told by its first bytes.  In pieces of what
    comes out, not of what goes in: a piece may be a thousand times as large unpacked."""
    head = raw.peek(6)[:6]
    if head[:2] == b"\x1f\x8b":
        return gzip.open(raw)  # several gzip members too
    if head[:3] == b"BZh":
        return bz2.open(raw)
    return lzma.open(raw) if head == b"\xfd7zXZ\x00" else raw


def members(uri: str, ending: str) -> Iterator[tuple[str, BinaryIO]]:
    """Name and stream of each member of lines, in order; a compressed file that is no
    tar archive is its only member."""
    if uri.endswith(".gz") and not uri.endswith(".tar.gz"):
        with opened(uri) as raw, unpacked(raw) as stream:
            yield uri.rsplit("/", 1)[-1].removesuffix(".gz"), stream
        return
    with opened(uri) as raw, unpacked(raw) as stream, tarfile.open(fileobj=stream, mode="r|") as archive:
        for info in archive:
            if info.isfile() and info.name.endswith(ending):
                yield info.name, archive.extractfile(info)


class _Batches:
    """Rows gathered into batches that are bounded in lines and bytes."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) == LINES or self.size >= BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
            self.rows, self.size = [], 0


def _text(raw: bytes) -> str:
    return raw.rstrip(b"\r\n").decode("utf-8", "replace")


class _Archive(InputPartition):
    def __init__(self, uri: str) -> None:
        super().__init__(uri)


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.ending = options["path"], options.get("member", ".jsonl")

    def partitions(self) -> Sequence[InputPartition]:
        return [_Archive(uri) for uri in listed(self.path)] or [_Archive("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        out = _Batches(_LINES)
        for name, stream in members(partition.value, self.ending) if partition.value else ():
            at = 0
            for row, raw in enumerate(stream):
                yield from out.add((partition.value, name, row, at, at + len(raw), _text(raw)), len(raw))
                at += len(raw)
        yield from out.flush()


class ArchiveLines(DataSource):
    """``spark.read.format("archive_lines").load(path)``; option ``member``: what names
    of members end with."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "archive string, member string, row bigint, start bigint, stop bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


def extract(spark: SparkSession, path: str, out: str, ending: str = ".jsonl") -> DataFrame:
    """Extract the members of the archives below ``path`` to files below ``out``, with
    offsets: n + 1 numbers of 64 bits, from 0 to the file's length.  Returns the
    manifest, written to ``out``/manifest."""
    uris = spark.createDataFrame([(u,) for u in listed(path)], "uri string")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for name, stream in members(uri, ending):
                    yield _extracted(uri, name, stream, out)

    found = uris.repartition(max(1, min(10_000, uris.count())), "uri").mapInArrow(go, MANIFEST)
    found.write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def _extracted(uri: str, name: str, stream: BinaryIO, out: str) -> pa.RecordBatch:
    store, top = place(f"{out}/data")
    store.create_dir(top, recursive=True)
    stem = f"{uuid.uuid4().hex}"
    digests, rows, at, ends = (hashlib.sha256(), hashlib.sha256()), 0, 0, [0]

    def put(to: BinaryIO, digest, data: bytes) -> None:
        to.write(data)
        digest.update(data)

    with store.open_output_stream(f"{top}/{stem}.jsonl") as lines, store.open_output_stream(f"{top}/{stem}.offsets") as offsets:
        for raw in stream:
            put(lines, digests[0], raw)
            rows, at = rows + 1, at + len(raw)
            ends.append(at)
            if len(ends) == 1 << 16:
                put(offsets, digests[1], np.array(ends, "<u8").tobytes())
                ends = []
        put(offsets, digests[1], np.array(ends, "<u8").tobytes())
    row = (uri, name, f"{out}/data/{stem}.jsonl", f"{out}/data/{stem}.offsets", rows, at, *(d.hexdigest() for d in digests))
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row, strict=True)})


class _Range(InputPartition):
    def __init__(self, file: str, offsets: str, first: int, last: int) -> None:
        super().__init__((file, offsets, first, last))


class _RowReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = [tuple(x) for x in json.loads(options["files"])]
        self.rows_each = int(options.get("rows", ROWS))
        self.lo, self.hi, self.rows, self.names = 0, 1 << 62, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("row",) and isinstance(f, EqualTo | In):
                wanted = set(f.value if isinstance(f, In) else [f.value]) - {None}
                self.rows = wanted if self.rows is None else self.rows & wanted
            elif column == ("row",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
            elif column == ("row",) and isinstance(f, LessThan | LessThanOrEqual):
                self.hi = min(self.hi, f.value + isinstance(f, LessThanOrEqual))
            elif column == ("file",) and isinstance(f, EqualTo | In):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for file, offsets, n in self.files:
            if self.names is not None and file not in self.names:
                continue
            lo, hi = self.lo, min(self.hi, n)
            if self.rows is None:
                spans = [(lo, hi)]
            else:  # neighbouring rows are one span
                some = np.array(sorted(r for r in self.rows if lo <= r < hi), np.int64)
                cuts = np.flatnonzero(np.diff(some) > 1) + 1
                spans = [(int(s[0]), int(s[-1]) + 1) for s in np.split(some, cuts) if len(s)]
            out += [_Range(file, offsets, a, min(a + self.rows_each, b)) for lo, b in spans for a in range(lo, b, self.rows_each)]
        return out or [_Range("", "", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        file, offsets, first, last = partition.value
        if first >= last:
            return
        store, path = place(offsets)
        with store.open_input_file(path) as f:
            f.seek(8 * first)
            ends = np.frombuffer(f.read(8 * (last - first + 1)), "<u8").astype(np.int64)
        out = _Batches(_ROWS)
        store, path = place(file)
        with store.open_input_file(path) as f:
            f.seek(int(ends[0]))
            for row, a, b in zip(range(first, last), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield from out.add((file, row, a, b, _text(f.read(b - a))), b - a)
        yield from out.flush()


class PositionalRows(DataSource):
    """Rows of extracted files by position: (file, row, start, stop, line)."""

    @classmethod
    def name(cls) -> str:
        return "positional_rows"

    def schema(self) -> str:
        return "file string, row bigint, start bigint, stop bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return _RowReader(self.options)


def lines(spark: SparkSession, path: str, ending: str = ".jsonl") -> DataFrame:
    """archive, member, row, start, stop, line of the archives below ``path``."""
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").option("member", ending).load(path)


def rows(spark: SparkSession, manifest: DataFrame, rows_each: int = ROWS) -> DataFrame:
    """file, row, start, stop, line of the files of a manifest (a row for each file)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PositionalRows)
    files = [(r["file"], r["offsets"], r["rows"]) for r in manifest.select("file", "offsets", "rows").collect()]
    return spark.read.format("positional_rows").option("files", json.dumps(files)).option("rows", rows_each).load()


def digest_of(uri: str) -> tuple[int, str] | None:
    """Length and digest of a file, read in pieces; none if there is no such file."""
    store, path = place(uri)
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    digest, size = hashlib.sha256(), 0
    with store.open_input_stream(path, compression=None) as f:
        while piece := f.read(PIECE):
            digest.update(piece)
            size += len(piece)
    return size, digest.hexdigest()


def verified(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The manifest with ``problem``: a file that is missing, or whose length or digest
    is another (null: none).  Files are read in pieces, each by one task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problems = []
            for r in batch.to_pylist():
                data, offsets = digest_of(r["file"]), digest_of(r["offsets"])
                problems.append("missing" if data is None or offsets is None else "size" if (data[0], offsets[0]) != (r["bytes"], 8 * (r["rows"] + 1)) else "digest" if (data[1], offsets[1]) != (r["sha256"], r["offsets_sha256"]) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(problems, pa.string())], [*batch.schema.names, "problem"])

    n = max(1, min(10_000, manifest.count()))
    return manifest.repartition(n, "file").mapInArrow(go, MANIFEST + ", problem string")


def write_archives(docs: DataFrame, path: str, key: str, order: str, line: str, piece: int = PIECE_BYTES) -> None:
    """Write ``line`` of each row, in ``order``, to a compressed tar archive for each
    value of ``key`` (few values: one file each), in streams.

    Tasks compress ranges of rows of about ``piece`` bytes, each as a gzip member of its
    own; one task for each archive then strings compressed pieces together, and no row
    moves to it."""
    spark = docs.sparkSession
    lines = docs.select(F.col(key).alias("k"), F.col(line).alias("line"), F.col(order).alias("o"))
    lengths = {r.k: r.n for r in lines.groupBy("k").agg(F.sum(F.octet_length("line") + 1).alias("n")).collect()}  # a row for each archive
    parts = max(1, len(lengths), min(65_536, sum(n or 0 for n in lengths.values()) // piece))
    store, top = place(path)
    store.create_dir(top, recursive=True)
    aside = f"{path.rstrip('/')}-pieces"
    store.create_dir(place(aside)[1], recursive=True)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = place(aside)
        part, now, raw, packed = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if packed is None or k != now:
                    if packed is not None:
                        packed.close()
                        raw.close()
                    now, name = k, f"{uuid.uuid4().hex}.gz"  # an attempt that failed leaves a file nobody names
                    raw = store.open_output_stream(f"{top}/{name}", compression=None)
                    packed = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, compresslevel=1)
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "part": pa.array([part], pa.int32()), "name": [name]})
                packed.write(text.encode() + b"\n")
        if packed is not None:
            packed.close()
            raw.close()

    dealt = lines.withColumn("k", F.col("k").cast("bigint")).repartitionByRange(parts, "k", "o").sortWithinPartitions("k", "o")
    dealt.select("k", "line").mapInArrow(compress, "k bigint, part int, name string").write.parquet(f"{aside}/names")
    pieces = spark.read.schema("k bigint, part int, name string").parquet(f"{aside}/names")
    named = pieces.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "name"))), lambda x: x["name"]).alias("names"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, top), (_, of) = place(path), place(aside)
        for batch in batches:
            for k, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                info = tarfile.TarInfo(f"part-{k}.jsonl")
                info.size = lengths[k]
                with store.open_output_stream(f"{top}/part-{k}.tar.gz", compression=None) as out:
                    out.write(gzip.compress(info.tobuf(tarfile.GNU_FORMAT), 1, mtime=0))
                    for name in names:
                        with store.open_input_stream(f"{of}/{name}", compression=None) as packed:
                            while some := packed.read(PIECE):
                                out.write(some)
                    out.write(gzip.compress(bytes(-info.size % tarfile.BLOCKSIZE + 2 * tarfile.BLOCKSIZE), 1, mtime=0))
        yield from ()

    named.repartition(max(1, len(lengths)), "k").mapInArrow(join, "k bigint").write.format("noop").mode("overwrite").save()
    store.delete_dir(place(aside)[1])
