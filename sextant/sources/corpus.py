"""Passages as JSON lines, canonical JSON, byte offsets, prompt tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.operators.batch import ranged, starts
from sextant.session import scratch

PASSAGE = "id string, contents string"


def read_jsonl(spark: SparkSession, path: str, schema: str = PASSAGE) -> DataFrame:
    """Lines that do not fit the schema are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_split(spark: SparkSession, root: str, split: str, schema: str) -> DataFrame:
    return read_jsonl(spark, f"{root}/{split}.jsonl", schema)


def first_split(spark: SparkSession, root: str, schema: str, splits: tuple[str, ...] = ("test", "dev", "train")) -> DataFrame:
    """The first split that is there."""
    from pyspark.errors import AnalysisException

    for split in splits:
        try:
            return read_split(spark, root, split, schema)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"{root} has none of {splits}")


def read_prompts(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Refuses a path that exists; a job that fails leaves no result."""
    df.write.mode("errorifexists").format(kind).save(path)


def canonical(row: dict[str, Column]) -> Column:
    """JSON with sorted keys, no spaces, nulls kept."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in sorted(row.items()))), {"ignoreNullFields": "false"})


def roundtrip(passages: DataFrame) -> DataFrame:
    """Written as JSON lines and read back."""
    path = scratch(passages.sparkSession, "corpus")
    write_once(passages, path, "json")
    return read_jsonl(passages.sparkSession, path)


def offsets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Where each line begins, in bytes, when rows are written by id: sums
    within ranges of ids plus the totals of the ranges before."""
    sized = ranged(df.select(id_col, (F.octet_length(text_col) + 1).cast("bigint").alias("__n")), id_col)
    local = sized.withColumn("__o", F.coalesce(F.sum("__n").over(W.partitionBy("__p").orderBy(id_col, "__h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    base = starts(sized.groupBy("__p").agg(F.sum("__n").alias("__t")), "__t")
    return local.join(F.broadcast(base), "__p", "left").select(id_col, (F.col("__o") + F.col("__s")).cast("bigint").alias("start"))


#: Files up to so many bytes are digested from a row; larger ones are read in pieces.
IN_A_ROW = 64 << 20


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and digest of every file below a folder.  Large files are read in
    pieces through Arrow's file systems, each by one task, in constant memory."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sextant.sources.archives import digest_of

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest_of(uri)[1] for uri in batch.column(0).to_pylist()], pa.string())], ["path", "length", "digest"])

    small = read.where(F.col("length") <= IN_A_ROW).select("path", "length", F.sha2("content", 256).alias("digest"))
    large = read.where(F.col("length") > IN_A_ROW).select("path", "length").mapInArrow(go, "path string, length bigint, digest string")
    return small.unionByName(large)
