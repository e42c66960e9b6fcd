"""What runs leave behind: CSV views, summaries, digests, published folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from sextant.session import scratch


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, which CSV has no other place for."""
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    return df.select(*(F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns))


#: A quote is written twice, and all white space is kept.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; refuses a path that exists."""
    flat(df).write.mode("errorifexists").options(**_CSV).option("quoteAll", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).option("multiLine", True).csv(path)


def csv_roundtrip(df: DataFrame, schema: str) -> DataFrame:
    path = scratch(df.sparkSession, "csv")
    write_csv(df, path)
    return read_csv(df.sparkSession, path, schema)


def markdown(df: DataFrame, order: list[Column]) -> DataFrame:
    """n, line of a table in Markdown: the header, the rule and a line for each row
    of a summary, which has few."""
    cell = lambda c: F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |"))
    lines = df.agg(F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), line.alias("line")))).alias("x"))
    head = F.array(F.lit("| " + " | ".join(df.columns) + " |"), F.lit("|" + " --- |" * len(df.columns)))
    return lines.select(F.posexplode(F.concat(head, F.transform("x", lambda r: r["line"]))).alias("n", "line"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name, length, digest of the files below a folder, in the order of sidecars.
    A name is the path below the folder, so files of one name in two folders differ."""
    from sextant.sources.corpus import files

    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")
    below = F.substring(F.col("path"), len(whole) + 2, 1 << 20)
    alone = F.element_at(F.split("path", "/"), -1)
    return files(spark, path).select(F.when(F.col("path") == whole, alone).otherwise(below).alias("name"), "length", "digest")


def write_sidecar(spark: SparkSession, path: str, to: str) -> None:
    """The digests of a folder's files as lines of digest and name."""
    digests(spark, path).select(F.concat_ws("  ", "digest", "name").alias("value")).write.mode("errorifexists").text(to)


def verify_sidecar(spark: SparkSession, path: str, sidecar: str) -> DataFrame:
    """name, problem of files that changed, are missing or are not listed."""
    listed = spark.read.text(sidecar).select(F.substring("value", 67, 1 << 20).alias("name"), F.substring("value", 1, 64).alias("listed"))
    both = listed.join(digests(spark, path), "name", "full_outer")
    problem = F.when(F.col("digest").isNull(), "missing").when(F.col("listed").isNull(), "not listed").when(F.col("digest") != F.col("listed"), "changed")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def publish(spark: SparkSession, path: str, parts: dict[str, Callable[[str], None]]) -> None:
    """All parts or nothing: each writes below a folder beside ``path``, which takes
    the name once all are there; an existing ``path`` is refused.  By Hadoop's file
    systems, so that stores which only Spark reaches work."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.partial"))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    fs.delete(aside, True)
    try:
        for name, write in parts.items():
            write(f"{aside.toString()}/{name}")
        if not fs.rename(aside, target):
            raise OSError(f"{aside.toString()} could not take the name {path}")
    except BaseException:
        fs.delete(aside, True)
        raise
