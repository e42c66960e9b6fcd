"""Archives as a data source: streams, extraction, look-ups by position."""

import gzip
import io
import json
import os
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.session import scratch
from sextant.sources import archives


def lines_of(n, seed=1):
    rng = random.Random(seed)
    return [b"" if i == 3 else json.dumps({"id": i, "contents": "é" * rng.randint(0, 40)}).encode() for i in range(n)]


def packed(path, members, mode="w:gz"):
    with tarfile.open(path, mode) as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    packed(at / "a.tar.gz", [("x.jsonl", b"\n".join(lines_of(9000)) + b"\n"), ("notes.txt", b"no"), ("empty.jsonl", b"")])
    packed(at / "b.tar", [("dir/y.jsonl", b"one\r\ntwo\n\nlast without end")], "w")
    with open(at / "c.jsonl.gz", "wb") as f:  # two compressed members, cut within a line
        f.write(gzip.compress(b"first\nsec") + gzip.compress(b"ond\n\xff third\n"))
    return str(at)


def test_lines_of_archives(spark, folder):
    got = {}
    for r in archives.lines(spark, folder).collect():
        got.setdefault(r["member"], []).append(r)
    assert set(got) == {"x.jsonl", "dir/y.jsonl", "c.jsonl"}
    x = sorted(got["x.jsonl"], key=lambda r: r["row"])
    assert [r["line"].encode() for r in x] == lines_of(9000)
    assert [r["row"] for r in x] == list(range(9000)) and all(a["stop"] == b["start"] for a, b in zip(x, x[1:]))
    assert [r["line"] for r in sorted(got["dir/y.jsonl"], key=lambda r: r["row"])] == ["one", "two", "", "last without end"]
    assert [r["line"] for r in sorted(got["c.jsonl"], key=lambda r: r["row"])] == ["first", "second", "� third"]


def test_extracted_files_by_position(spark, folder):
    out = scratch(spark, "extracted")
    manifest = archives.extract(spark, folder, out)
    by = {r["member"]: r for r in manifest.collect()}
    assert {m: r["rows"] for m, r in by.items()} == {"x.jsonl": 9000, "empty.jsonl": 0, "dir/y.jsonl": 4, "c.jsonl": 3}
    data = open(by["x.jsonl"]["file"].removeprefix("file://"), "rb").read()
    offsets = np.fromfile(by["x.jsonl"]["offsets"].removeprefix("file://"), "<u8")
    assert offsets[0] == 0 and offsets[-1] == len(data) and len(offsets) == 9001
    rows = archives.rows(spark, manifest, 2000)
    assert rows.count() == 9007
    some = rows.where(F.col("row").isin(5, 6, 7, 8999) & (F.col("file") == by["x.jsonl"]["file"]))
    assert {r["row"]: r["line"].encode() for r in some.collect()} == {k: lines_of(9000)[k] for k in (5, 6, 7, 8999)}
    assert some.rdd.getNumPartitions() == 2  # two byte ranges are read, and no more
    assert rows.where("row >= 8998").count() == 2 and rows.where("row < 2 AND row > 0").count() == 3 and rows.where("row = 100000").count() == 0
    assert rows.where("row = 5 AND line LIKE '%nothing%'").count() == 0  # what is not pushed still holds
    assert {r["problem"] for r in archives.verified(spark, manifest).collect()} == {None}
    with open(by["x.jsonl"]["file"].removeprefix("file://"), "r+b") as f:
        f.seek(100)
        f.write(b"#")
    os.truncate(by["c.jsonl"]["file"].removeprefix("file://"), 5)
    os.remove(by["dir/y.jsonl"]["offsets"].removeprefix("file://"))
    assert {r["member"]: r["problem"] for r in archives.verified(spark, manifest).collect()} == {"x.jsonl": "digest", "empty.jsonl": None, "c.jsonl": "size", "dir/y.jsonl": "missing"}


def test_archives_of_nothing(spark, tmp_path):
    assert archives.lines(spark, str(tmp_path)).count() == 0
    manifest = archives.extract(spark, str(tmp_path), scratch(spark, "extracted"))
    assert manifest.count() == 0 and archives.rows(spark, manifest).count() == 0


def test_archives_are_compressed_in_pieces(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS o", "id % 2 AS k", "CAST(id AS string) || ' ' || repeat('é', CAST(id % 50 AS int)) AS line").repartition(3)
    archives.write_archives(docs, f"file://{tmp_path}/a", "k", "o", "line", piece=20_000)
    assert sorted(os.listdir(tmp_path)) == ["a"] and sorted(os.listdir(tmp_path / "a")) == ["part-0.tar.gz", "part-1.tar.gz"]
    for k in (0, 1):
        want = "".join(f"{i} {'é' * (i % 50)}\n" for i in range(k, 4000, 2)).encode()
        with tarfile.open(tmp_path / "a" / f"part-{k}.tar.gz") as archive:
            assert archive.getnames() == [f"part-{k}.jsonl"] and archive.extractfile(f"part-{k}.jsonl").read() == want
        raw = (tmp_path / "a" / f"part-{k}.tar.gz").read_bytes()
        assert raw.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") > 3  # gzip members: no task had all rows of an archive
    assert archives.lines(spark, f"file://{tmp_path}/a").count() == 4000


class Long(io.RawIOBase):
    """A file of equal lines that are made as they are read."""

    def __init__(self, size, line):
        self.left, self.piece = size, line * (archives.PIECE // len(line))

    def readable(self):
        return True

    def readinto(self, b):
        n = min(len(b), self.left, len(self.piece))
        b[:n] = self.piece[:n]
        self.left -= n
        return n


def test_archive_beyond_two_gigabytes_streams(tmp_path):
    import resource

    size, line = 2200 << 20, b"x" * ((1 << 18) - 1) + b"\n"
    path = tmp_path / "long.tar.gz"
    with tarfile.open(str(path), "w|gz", compresslevel=1) as archive:
        info = tarfile.TarInfo("long.jsonl")
        info.size = size
        archive.addfile(info, io.BufferedReader(Long(size, line), archives.PIECE))
    reader = archives.ArchiveLines({"path": str(path)}).reader(None)
    (partition,) = reader.partitions()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows, most, stop = 0, 0, 0
    for batch in reader.read(partition):
        rows, most, stop = rows + batch.num_rows, max(most, batch.nbytes), batch.column(4)[-1].as_py()
    assert rows == size // len(line) and stop == size > 1 << 31
    assert most < 2 * archives.BYTES and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kB
