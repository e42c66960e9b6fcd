"""Records in files of other kinds: key=value lines, archives, packed vectors,
lines by position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sextant.operators.batch import row_ids


def key_values(lines: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """file, key, value, problem of ``key=value`` lines; blank ones are skipped.  A
    line without a sign, an empty key or a key seen before in its file has a
    ``problem``."""
    text = F.trim(F.col(line))
    rows = lines.where(F.length(text) > 0).select(F.col(file).alias("file"), F.col(line).alias("line"), (F.instr(text, "=") > 0).alias("signed"), F.trim(F.substring_index(text, "=", 1)).alias("key"), F.expr(f"trim(substr(trim({line}), instr(trim({line}), '=') + 1))").alias("value"))
    counts = rows.where("signed").groupBy("file", "key").agg(F.count(F.lit(1)).alias("n"))
    problem = F.when(~F.col("signed"), "no sign").when(F.col("key") == "", "empty key").when(F.col("n") > 1, "duplicate key")
    return rows.join(counts, ["file", "key"], "left").select("file", "key", F.when(F.col("signed"), F.col("value")).alias("value"), problem.alias("problem"))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value of metadata files; raises on the first problem."""
    found = key_values(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")))
    bad = F.raise_error(F.concat(F.col("problem"), F.lit(" in "), F.col("file"))).cast("string")
    return found.select("file", "key", F.when(F.col("problem").isNotNull(), bad).otherwise(F.col("value")).alias("value"))


def lines_of_archives(spark: SparkSession, path: str, member: str = ".jsonl") -> DataFrame:
    """archive, member, row, start, stop, line of the text members of tar archives
    (plain or compressed): an archive is read by one task, in a stream, as its
    format allows no other way."""
    from sextant.sources.archives import lines

    return lines(spark, path, member)


def positional(rows: DataFrame, order: str, line: str) -> DataFrame:
    """row, start, stop, line, id: where each line lies in a file of all of them, by an
    ``order`` that is unique."""
    from sextant.sources.corpus import offsets

    numbered = row_ids(rows.select(order, line), order, name="row")
    return numbered.join(offsets(rows, order, line), order).select("row", "start", (F.col("start") + F.octet_length(line) + 1).cast("bigint").alias("stop"), F.col(line).alias("line"), F.col(order).cast("string").alias("id"))


def packed_vector(v: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.arrow_udf("binary")
    def f(x: pa.Array) -> pa.Array:
        return pa.array([None if row is None else np.asarray(row, "<f4").tobytes() for row in x.to_pylist()], pa.binary())

    return f(v)


def unpacked_vectors(c: Column, width: int) -> Column:
    """Rows of 32-bit floats end to end, as arrays of ``width``; a length that does
    not divide is an error."""

    @F.arrow_udf(ArrayType(ArrayType(FloatType())))
    def f(x: pa.Array) -> pa.Array:
        out = []
        for data in x.to_pylist():
            flat = np.frombuffer(data or b"", "<f4")
            if len(flat) % width:
                raise ValueError(f"{len(flat)} numbers do not make rows of {width}")
            out.append(flat.reshape(-1, width).tolist())
        return pa.array(out, pa.list_(pa.list_(pa.float32())))

    return f(c)
