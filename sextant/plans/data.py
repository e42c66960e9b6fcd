"""Inputs of the queries, derived from the driver's tables.

Expressions that both engines read are kept as SQL text once and used in the
DataFrame and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables whose rows cost much to work on.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table.  Texts that lie in fewer files than there are cores (so in one
    or few row groups) are dealt out; many files are read as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and len(df._jdf.inputFiles()) < cores else df


#: A prompt with an example answer, then an assistant's turn, well formed or not.
TRANSCRIPT = """
'Question: ' || split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || '? Like <answer>Beijing</answer>.' || chr(10) || '<|im_start|>assistant' || chr(10) ||
CASE conv_id % 7
WHEN 0 THEN '<think>' || split_part(text, ' ', 1) || '</think>' || chr(10) || '<search>' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) || '</search><information>' || text || '</information><think>so</think><answer> ' || split_part(text, ' ', 2) || ' </answer>'
WHEN 1 THEN '<think>a</think><answer>' || split_part(text, ' ', 1) || '</answer><answer>' || split_part(text, ' ', 2) || '</answer>'
WHEN 2 THEN '<think>a</think><search>' || split_part(text, ' ', 2)
WHEN 3 THEN '<answer>' || split_part(text, ' ', 1) || '</answer> tail <search>' || split_part(text, ' ', 3) || '</search>'
WHEN 4 THEN ''
WHEN 5 THEN '<think>' || text || '</think> stray <search>' || split_part(text, ' ', 2) || '</search>'
ELSE '<think>b</think> <answer>' || split_part(text, ' ', 2) || '</answer> ' END
"""
PREDICTION = "CASE conv_id % 3 WHEN 0 THEN 'The ' || split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || '!' WHEN 1 THEN text ELSE split_part(text, ' ', 3) END"
GOLDS = "array('THE ' || split_part(text, ' ', 1) || '. ' || split_part(text, ' ', 2), 'an ' || split_part(text, ' ', 2))"
#: Turns of conversations as transcripts with gold answers (DuckDB).
T_SQL = f"t AS (SELECT conv_id, turn, text, {TRANSCRIPT} AS transcript, {PREDICTION} AS prediction, [{GOLDS[6:-1]}] AS golds FROM conversations)"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text", f"{TRANSCRIPT} AS transcript", f"{PREDICTION} AS prediction", f"{GOLDS} AS golds")


#: Evaluation records: one for each labelled document (DuckDB).
R_SQL = """r AS (SELECT d.doc_id AS sample_id, d.source AS dataset, d.lang AS level, CAST(l.quality AS BIGINT) AS em, CAST(l.toxic AS BIGINT) AS clipped, d.doc_id % 5 AS searches,
 d.doc_id // 5 AS grp, d.doc_id % 5 AS slot, CAST(d.n_chars AS BIGINT) AS n_tokens, CAST(l.quality AS DOUBLE) - 0.1 * (d.doc_id % 5) / 4.0 AS utility
 FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").selectExpr(
        "doc_id AS sample_id", "source AS dataset", "lang AS level", "CAST(quality AS BIGINT) AS em", "CAST(toxic AS BIGINT) AS clipped", "doc_id % 5 AS searches",
        "doc_id div 5 AS grp", "doc_id % 5 AS slot", "n_chars AS n_tokens", "CAST(quality AS DOUBLE) - 0.1D * (doc_id % 5) / 4.0D AS utility",
    )


#: The same samples under a second policy (DuckDB; needs r).
R2_SQL = "r2 AS (SELECT sample_id, CASE WHEN sample_id % 4 IN (0, 2) THEN em ELSE 1 - em END AS em, (searches + 1) % 5 AS searches FROM r)"


def second_policy(r: DataFrame) -> DataFrame:
    return r.selectExpr("sample_id", "CASE WHEN sample_id % 4 IN (0, 2) THEN em ELSE 1 - em END AS em", "(searches + 1) % 5 AS searches")


#: Tokens of an order: reward, value, log-probabilities and mask by line (DuckDB).
K_SQL = """k AS (SELECT l_orderkey AS row_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS pos,
 CAST(l_quantity AS DOUBLE) / 50 AS reward, CAST(l_tax AS DOUBLE) * 10 AS value, -CAST(l_discount AS DOUBLE) * 10 AS logp, -CAST(l_tax AS DOUBLE) * 8 AS old_logp, -CAST(l_discount AS DOUBLE) * 9 - 0.1 AS ref_logp,
 CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS mask FROM lineitem)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), pos.alias("pos"), F.expr("CAST(l_quantity AS DOUBLE) / 50D").alias("reward"), F.expr("CAST(l_tax AS DOUBLE) * 10D").alias("value"),
        F.expr("-CAST(l_discount AS DOUBLE) * 10D").alias("logp"), F.expr("-CAST(l_tax AS DOUBLE) * 8D").alias("old_logp"), F.expr("-CAST(l_discount AS DOUBLE) * 9D - 0.1D").alias("ref_logp"),
        F.expr("CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END").alias("mask"),
    )


def sequences(t: DataFrame) -> DataFrame:
    """Tokens as one row of arrays for each sequence, in order of position."""
    cols = [c for c in t.columns if c not in ("row_id", "pos")]
    packed = t.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("x"))
    return packed.select("row_id", *(F.col(f"x.{c}").alias(c) for c in cols))


#: Passages: a quoted title line and the text (both engines).
CONTENTS = """'"' || source || ' ' || doc_id || '"' || chr(10) || text"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{CONTENTS} AS contents")
