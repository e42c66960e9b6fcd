"""Queries over responses, contracts of runs, records and reports."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sextant.functions import documents as D
from sextant.functions import scoring as S
from sextant.functions import values as V
from sextant.operators import batch as B
from sextant.operators import contracts as C
from sextant.operators import evaluation as E
from sextant.operators import responses as P
from sextant.operators import retrieval as R
from sextant.operators import token_ids as N
from sextant.plans.data import CONTENTS, R_SQL, T_SQL, passages, records, table, transcripts
from sextant.plans.retrieval_queries import BM25_SQL, bm25_top
from sextant.plans.text_queries import _EM, d_strip
from sextant.registry import register
from sextant.session import scratch
from sextant.sources import archives as A
from sextant.sources import corpus
from sextant.sources import records as K
from sextant.sources import reports as O

# Responses.
_SOURCE = "CASE conv_id % 4 WHEN 0 THEN 'nq' WHEN 1 THEN 'gsm8k' WHEN 2 THEN 'hotpotqa' ELSE 'multiply' END"
_SAID = "CASE conv_id % 4 WHEN 1 THEN 'so #### ' || CAST(conv_id * turn AS STRING) WHEN 3 THEN 'Assistant: <answer>' || CAST(conv_id * turn + turn % 2 AS STRING) || '</answer>' ELSE prediction END"
#: Which sources go to which scorer.
OPEN_QA = ("nq", "hotpotqa")


def routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    x = transcripts(spark, sf_dir).selectExpr("conv_id", "turn", "golds", "prediction", f"{_SOURCE} AS source", f"{_SAID} AS said", "conv_id * turn AS truth")
    scorers = {OPEN_QA: S.em(F.col("said"), F.col("golds")), ("gsm8k",): S.score_gsm8k(F.col("said"), F.col("truth").cast("string")), ("multiply",): S.score_multiply(F.col("said"), F.col("truth"))}
    return x, scorers


@register("score_dispatch", f"""WITH {T_SQL} SELECT conv_id, turn, {_SOURCE} AS source, CAST(CASE conv_id % 4 WHEN 1 THEN 1 WHEN 3 THEN CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.1 END ELSE {_EM} END AS DOUBLE) AS score FROM t""")
def score_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of several sources, each row by the scorer of its source."""
    x, scorers = routed(spark, sf_dir)
    return x.select("conv_id", "turn", "source", P.dispatch(F.col("source"), scorers).alias("score"))


@register("unknown_sources", "SELECT 'multiply' AS source, count(*) AS n FROM conversations WHERE conv_id % 4 = 3")
def unknown_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, scorers = routed(spark, sf_dir)
    scorers.pop(("multiply",))
    return P.unknown_sources(x, "source", scorers)


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with their responses as a column, written and read back."""
    turns = transcripts(spark, sf_dir)
    prompts = turns.where("turn = 0").select("conv_id", "golds")
    path = scratch(spark, "responses")
    corpus.write_once(P.with_responses(prompts, turns.where("turn > 0"), "conv_id", "turn", "prediction"), path)
    return corpus.read_prompts(spark, path)


@register("append_responses", f"WITH {T_SQL} SELECT p.conv_id, CAST(count(r.turn) AS INTEGER) AS n, coalesce(string_agg(r.prediction, '|' ORDER BY r.turn), '') AS joined FROM t p LEFT JOIN t r ON r.conv_id = p.conv_id AND r.turn > 0 WHERE p.turn = 0 GROUP BY p.conv_id")
def append_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir).select("conv_id", F.size("responses").alias("n"), F.array_join("responses", "|").alias("joined"))


_OFFLINE = f"s AS (SELECT p.conv_id, {_EM.replace('golds', 'p.golds').replace('prediction', 'r.prediction')} AS score, r.turn FROM t p LEFT JOIN t r ON r.conv_id = p.conv_id AND r.turn > 0 WHERE p.turn = 0), o AS (SELECT conv_id, CAST(count(turn) AS INTEGER) AS n, CAST(max(score) FILTER (turn IS NOT NULL) AS DOUBLE) AS best, avg(score) FILTER (turn IS NOT NULL) AS mean FROM s GROUP BY conv_id)"


@register("offline_scores", f"WITH {T_SQL}, {_OFFLINE} SELECT conv_id, n, best, round(mean, 6) AS mean FROM o")
def offline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of responses read from Parquet and scored in place."""
    return P.offline_scores(generated(spark, sf_dir), "conv_id", lambda r: S.em(r, F.col("golds"))).withColumn("mean", F.round("mean", 6))


@register("offline_pass_rate", f"WITH {T_SQL}, {_OFFLINE} SELECT count(*) AS prompts, round(avg(CASE WHEN best = 1 THEN 1.0 ELSE 0 END), 6) AS pass_rate FROM o")
def offline_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = P.offline_scores(generated(spark, sf_dir), "conv_id", lambda r: S.em(r, F.col("golds")))
    return P.pass_rate(best).withColumn("pass_rate", F.round("pass_rate", 6))


@register("preference_pairs", """WITH x AS (SELECT o_orderkey, list_transform(range(o_orderkey % 9), lambda i: i + 10) AS c, list_transform(range(o_custkey % 7), lambda i: i + 20) AS r FROM orders),
e AS (SELECT o_orderkey, list_append(c, 2)[1:6] AS c, list_append(r, 2)[1:6] AS r FROM x)
SELECT o_orderkey, array_to_string(list_resize(c, 6, 0), ',') AS chosen, array_to_string(list_resize(r, 6, 0), ',') AS rejected, len(c) AS chosen_tokens, len(r) AS rejected_tokens FROM e""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen and rejected answers as ids of one length, each with its own mask."""
    ids = lambda n, base: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: i + base)).otherwise(F.array().cast("array<bigint>"))
    pair = P.preference_pair(ids(F.col("o_orderkey") % 9, 10), ids(F.col("o_custkey") % 7, 20), 2, 6)
    x = table(spark, sf_dir, "orders").select("o_orderkey", pair.alias("p"))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    count = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return x.select("o_orderkey", text("p.chosen").alias("chosen"), text("p.rejected").alias("rejected"), count("p.chosen_mask").alias("chosen_tokens"), count("p.rejected_mask").alias("rejected_tokens"))


@register("sft_loss", "WITH x AS (SELECT vec_id, embedding AS e, list_transform(range(len(embedding)), lambda i: CASE WHEN (i + vec_id) % 3 = 0 THEN 1 ELSE 0 END) AS m FROM embeddings), y AS (SELECT vec_id, unnest(e[1:len(e) - 1]) AS p, unnest(m[2:]) AS m FROM x) SELECT vec_id, round(sum(-CAST(p AS DOUBLE) * m) / sum(m), 6) AS loss FROM y GROUP BY vec_id")
def sft_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of next tokens, with the embedding's numbers as log-probabilities."""
    mask = F.transform("embedding", lambda _, i: F.when((i + F.col("vec_id")) % 3 == 0, 1).otherwise(0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(P.shifted_loss(F.transform("embedding", lambda x: x.cast("double")), mask), 6).alias("loss"))


_RESPONSES = f"WITH {BM25_SQL}, x AS (SELECT query_id, rank, doc_id, score, {CONTENTS} AS contents FROM top JOIN documents USING (doc_id) WHERE rank <= 2)"


@register("retrieve_with_scores", _RESPONSES + " SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS ids, round(sum(score), 5) AS total FROM x GROUP BY query_id")
def retrieve_with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.response_rows(bm25_top(spark, sf_dir, 2), passages(spark, sf_dir).select("doc_id", "contents"), "doc_id", True)
    return found.select("query_id", F.array_join(F.transform("result", lambda r: r["id"].cast("string")), ",").alias("ids"), F.round(F.aggregate("result", F.lit(0.0), lambda a, r: a + r["score"]), 5).alias("total"))


@register("retrieve_without_scores", _RESPONSES + " SELECT query_id, string_agg(contents, chr(10) ORDER BY rank) AS contents FROM x GROUP BY query_id")
def retrieve_without_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.response_rows(bm25_top(spark, sf_dir, 2), passages(spark, sf_dir).select("doc_id", "contents"), "doc_id", False)
    return found.select("query_id", F.array_join("result.contents", "\n").alias("contents"))


@register("retriever_by_name", "SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.label = q.label")
def retriever_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense search looked up by its name, among neighbours of the same label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return P.retriever("dense")(queries, vectors, within="label").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@register("worker_apply", "SELECT event_id, user_id * 2 + 1 AS x FROM events")
def worker_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arbitrary function of Arrow tables, run by the workers."""

    def twice(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        return pa.table({"event_id": t["event_id"], "x": pc.add(pc.multiply(t["user_id"], 2), 1)})

    return P.on_workers(table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("bigint").alias("user_id")), twice, "event_id bigint, x bigint")


_O = "o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, (SELECT count(*) FROM orders) AS n FROM orders)"


@register("dispatch_chunks", f"WITH {_O} SELECT o_orderkey, CAST(CASE WHEN row_id < (n % 7) * (n // 7 + 1) THEN row_id // (n // 7 + 1) ELSE (row_id - (n % 7) * (n // 7 + 1)) // (n // 7) + n % 7 END AS INTEGER) AS worker FROM o")
def dispatch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return P.dispatched(B.row_ids(orders, "o_orderkey"), 7, orders.count(), "chunks").select("o_orderkey", "worker")


@register("dispatch_one_to_all", "SELECT n_nationkey, worker FROM nation, (SELECT unnest(range(3))::INTEGER AS worker)")
def dispatch_one_to_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dispatched(table(spark, sf_dir, "nation"), 3, 0, "one_to_all").select("n_nationkey", "worker")


# Contracts.
@register("capacity_contract", "SELECT o_orderkey, (1 + o_orderkey % 4) * (500 + 500) + 500 <= 4096 - o_custkey % 700 AS fits FROM orders")
def capacity_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders")
    return x.select("o_orderkey", C.fits(1 + F.col("o_orderkey") % 4, F.lit(500), F.lit(500), 4096 - F.col("o_custkey") % 700).alias("fits"))


_LINE = "CASE doc_id % 11 WHEN 3 THEN '  ' WHEN 5 THEN '[1]' ELSE '{\"id\": ' || CAST(doc_id AS STRING) || '}' END"


@register("position_violations", "WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents) SELECT row, 'blank' AS rule FROM l WHERE doc_id % 11 = 3 UNION ALL SELECT row, 'object' FROM l WHERE doc_id % 11 = 5 UNION ALL SELECT row, 'id' FROM l WHERE doc_id % 13 = 4 UNION ALL SELECT row, 'offset' FROM l WHERE doc_id % 17 = 6")
def position_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by position, with blank lines, lists, wrong ids and shifted starts."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_LINE} AS line")
    lines = K.positional(docs, "doc_id", "line")
    number = F.col("id").cast("bigint")
    spoilt = lines.select("row", F.when(number % 17 == 6, F.col("start") + 1).otherwise(F.col("start")).alias("start"), "stop", "line", F.when(number % 13 == 4, F.lit("x")).otherwise(F.col("row").cast("string")).alias("id"))
    return C.positions(spoilt)


_ENTRY = "CASE o_orderkey % 10 WHEN 1 THEN '{\"b\":1,\"a\":' || CAST(o_custkey AS STRING) || '}' WHEN 2 THEN '{\"a\":1}' ELSE '{\"a\":' || CAST(o_custkey AS STRING) || ',\"b\":1}' END"


@register("catalog_violations", "WITH c AS (SELECT o_custkey % 50 AS id, o_orderkey FROM orders), n AS (SELECT id, count(*) AS n FROM c GROUP BY id) SELECT DISTINCT id, 'canonical' AS rule FROM c WHERE o_orderkey % 10 IN (1, 2) UNION ALL SELECT DISTINCT id, 'keys' FROM c WHERE o_orderkey % 10 = 2 UNION ALL SELECT id, 'unique' FROM n WHERE n > 1")
def catalog_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog lines that are not canonical, lack a key or share an id."""
    x = table(spark, sf_dir, "orders").selectExpr("o_custkey % 50 AS id", f"{_ENTRY} AS line")
    parsed = F.from_json("line", "a bigint, b bigint")
    return C.catalog(x, "id", "line", corpus.canonical({"b": parsed["b"], "a": parsed["a"]}), V.has_keys(F.col("line"), ("a", "b")))


@register("stage_violations", "SELECT file, 'unique' AS rule FROM (SELECT user_id AS file, count(*) AS n, count(DISTINCT ts) AS d FROM events GROUP BY 1) WHERE n <> d UNION ALL SELECT user_id, 'stage' FROM events GROUP BY 1 HAVING count(DISTINCT event_type) <> 1 UNION ALL SELECT user_id, 'schema' FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 2) <> 1")
def stage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stages(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", F.col("event_id") % 2).withColumnRenamed("user_id", "file")


@register("lineage_violations", "WITH r AS (SELECT o_orderkey AS run, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey - 1 END AS parent FROM orders) SELECT c.run, 'parent' AS rule FROM r c LEFT JOIN r p ON c.parent = p.run WHERE c.parent IS NOT NULL AND p.run IS NULL UNION ALL SELECT c.run, 'digest' FROM r c JOIN r p ON c.parent = p.run WHERE c.run % 7 = 5 UNION ALL SELECT c.run, 'code' FROM r c JOIN r p ON c.parent = p.run WHERE (c.run // 10) % 5 <> (p.run // 10) % 5")
def lineage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children whose parent is not there, has another digest or other code."""
    key = F.col("o_orderkey")
    of = lambda c: F.sha2(c.cast("string"), 256)
    parent = F.when(key % 3 != 0, key - 1)
    runs = table(spark, sf_dir, "orders").select(key.alias("run"), parent.alias("parent"), of(key).alias("digest"), F.when(key % 7 == 5, "wrong").otherwise(of(key - 1)).alias("parent_digest"), (F.floor(key / 10) % 5).alias("code"))
    return C.lineage(runs, shared=("code",))


@register("manifest_violations", "WITH f AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), k AS (SELECT *, row_number() OVER (ORDER BY lang) AS i FROM f) SELECT lang, 'rows' AS rule FROM k WHERE i = 1 UNION ALL SELECT lang, 'digest' FROM k WHERE i = 2 UNION ALL SELECT lang, 'unknown' FROM k WHERE i = 3 UNION ALL SELECT 'zz', 'missing'")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with a wrong count, a wrong digest, a part too many and one too few."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang", "doc_id")
    found = C.content_digest(docs, "lang", "doc_id")
    place = found.select("lang", "rows", "digest", F.row_number().over(B.W.orderBy("lang")).alias("i"))  # a row for each language
    declared = place.where("i <> 3").select("lang", (F.col("rows") + (F.col("i") == 1).cast("int")).alias("rows"), F.when(F.col("i") == 2, "0").otherwise(F.col("digest")).alias("digest"))
    more = spark.createDataFrame([("zz", 1, "0")], "lang string, rows bigint, digest string")
    return C.manifest(declared.unionByName(more), docs, "lang", "doc_id")


_CONFIG = "'{\"a\":{\"n\":' || CAST(o_orderkey % 5 AS STRING) || ',\"flag\":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '1' END || '}}'"


@register("config_violations", "SELECT o_orderkey, 'a.n >= 2' AS rule FROM orders WHERE o_orderkey % 5 < 2 UNION ALL SELECT o_orderkey, 'a.flag == true' FROM orders WHERE o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, 'a.none != x' FROM orders")
def config_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_CONFIG} AS doc")
    return C.config(runs, "o_orderkey", "doc", [("a.n", ">=", "2"), ("a.flag", "==", "true"), ("a.none", "!=", "x")])


@register("split_by_index", "WITH i AS (SELECT (p * 7) % (SELECT count(*) FROM orders) AS source_index, p AS place FROM (SELECT unnest(range(50)) AS p)), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS source_index FROM orders) SELECT place, source_index, o_orderkey FROM i JOIN o USING (source_index)")
def split_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split given as a list of row numbers, in the list's order."""
    rows = B.row_ids(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", name="source_index")
    n = table(spark, sf_dir, "orders").count()
    index = spark.range(50).select(F.col("id").alias("place"), (F.col("id") * 7 % n).alias("source_index"))
    return C.by_index(rows, F.broadcast(index)).select("place", "source_index", "o_orderkey")


@register("cache_priority", "SELECT k, CASE WHEN k % 2 = 0 THEN 'test' ELSE 'train' END AS origin FROM (SELECT o_orderkey AS k FROM orders)")
def cache_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two caches; the test one wins where both have a key."""
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return C.with_priority(k.withColumn("origin", F.lit("train")), k.where("k % 2 = 0").withColumn("origin", F.lit("test")), key="k")


@register("observation_budget", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:1 + doc_id % 40], ' ') AS shown FROM documents WHERE text IS NOT NULL")
def observation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many pieces of an observation as a budget allows; pieces are words with
    the space before them where no tokenizer is plugged in."""
    pieces = F.transform(F.split("text", " ", -1), lambda w, i: F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", C.budgeted(pieces, (1 + F.col("doc_id") % 40).cast("int")).alias("shown"))


_SLICE = "'think ' || CASE conv_id % 3 WHEN 0 THEN '<search>a b</search> tail <answer>c</answer>' WHEN 1 THEN '<answer>' || text || '</answer> <search>x</search>' ELSE text END"


@register("action_slice", f"SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 3 WHEN 1 THEN len(string_split(text, ' ')) + 1 END::INTEGER AS n FROM conversations")
def action_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces up to the first complete action."""
    pieces = F.transform(F.split("s", " ", -1), lambda w, i: F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w))
    x = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_SLICE} AS s")
    return x.select("conv_id", "turn", C.first_action(pieces, ("</search>", "</answer>")).alias("n"))


@register("stop_sequences", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || '</search>' ELSE text || ' <answer>' END AS kept FROM conversations")
def stop_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("</search> more </answer>"))).otherwise(F.concat("text", F.lit(" <answer>")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.stop_at(said, ("</search>", "</answer>")).alias("kept"))


@register("trace_identity", "SELECT event_id, user_id || ':' || (event_id % 5) AS trace_key, 'eval' AS stage, CASE WHEN event_id % 3 = 0 THEN 'run-0' ELSE event_type END AS run FROM events")
def trace_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with defaults for what is not given, keyed by sample and slot."""
    x = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("run"))
    filled = C.trace_identity(x, {"run": F.lit("run-0"), "stage": F.lit("eval"), "slot": F.col("event_id") % 5})
    return filled.select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), F.col("slot").cast("string")).alias("trace_key"), "stage", "run")


# Values and records.
_LOOSE = "CASE event_id % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(event_id % 8 AS DOUBLE) / 2 END"


@register("spelt_numbers", "SELECT event_id, '{\"x\":\"' || s || '\",\"y\":[\"' || s || '\",\"1.5\"]}' AS doc FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' ELSE CAST((event_id % 8) / 2.0 AS VARCHAR) END AS s FROM events)")
def spelt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that JSON has no spelling for, as text at any depth."""
    x = table(spark, sf_dir, "events").selectExpr("event_id", f"named_struct('x', {_LOOSE}, 'y', array({_LOOSE}, 1.5D)) AS r")
    return x.select("event_id", F.to_json(V.spelt(F.col("r"), x.schema["r"].dataType)).alias("doc"))


@register("flatten_config", "SELECT o_orderkey, 'a/n' AS path, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'a/s', '\"x\"' FROM orders UNION ALL SELECT o_orderkey, 'l/list_len', '2' FROM orders UNION ALL SELECT o_orderkey, 'l/0', '1' FROM orders UNION ALL SELECT o_orderkey, 'l/1/k', 'null' FROM orders")
def flatten_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('{"a": {"n": '), F.col("o_custkey").cast("string"), F.lit(', "s": "x"}, "l": [1, {"k": null}]}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(V.flatten_json(doc)).alias("path", "value"))


@register("value_guards", f"""SELECT conv_id, turn, nullif({d_strip("split_part(text, ' ', 2)")}, '') AS word, CASE WHEN turn % 2 = 0 THEN true ELSE false END AS digest, conv_id % 2 = 0 AS keys, CASE WHEN turn = 1 THEN 0 ELSE 1 END::INTEGER AS listed FROM conversations""")
def value_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional text, digests by form, objects by exact keys, scalars as lists."""
    hexed = F.sha2("text", 256)
    doc = F.when(F.col("conv_id") % 2 == 0, F.lit('{"b": 1, "a": 2}')).otherwise(F.lit('{"b": 1}'))
    one = F.when(F.col("turn") != 1, F.col("turn").cast("bigint"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.optional_text(F.split_part("text", F.lit(" "), F.lit(2))).alias("word"), V.is_digest(F.when(F.col("turn") % 2 == 0, hexed).otherwise(F.upper(hexed))).alias("digest"), V.has_keys(doc, ("a", "b")).alias("keys"), F.size(V.as_list(one, LongType())).alias("listed"))


@register("repeated_queries", "SELECT user_id, CAST(count(*) - count(DISTINCT event_type) AS INTEGER) AS repeated FROM events GROUP BY user_id")
def repeated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("a")).select("user_id", V.repeated(F.col("a")).alias("repeated"))


_META = "CASE event_id % 6 WHEN 0 THEN 'seed = 7' WHEN 1 THEN 'name=a=b' WHEN 2 THEN '' WHEN 3 THEN 'no sign' WHEN 4 THEN '=empty' ELSE 'k' || CAST(event_id AS STRING) || '=1' END"


@register("run_metadata", "WITH x AS (SELECT event_type AS file, event_id, event_id % 6 AS k FROM events), y AS (SELECT file, CASE k WHEN 0 THEN 'seed' WHEN 1 THEN 'name' WHEN 3 THEN 'no sign' WHEN 4 THEN '' ELSE 'k' || event_id END AS key, CASE k WHEN 0 THEN '7' WHEN 1 THEN 'a=b' WHEN 4 THEN 'empty' WHEN 5 THEN '1' END AS value, k FROM x WHERE k <> 2) SELECT file, key, value, CASE WHEN k = 3 THEN 'no sign' WHEN k = 4 THEN 'empty key' WHEN count(*) OVER (PARTITION BY file, key) > 1 THEN 'duplicate key' END AS problem FROM y")
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.key_values(table(spark, sf_dir, "events").selectExpr("event_type AS file", f"{_META} AS line"))


@register("vectors_roundtrip", "SELECT vec_id, i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)")
def vectors_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as packed 32-bit floats, and read back."""
    path = scratch(spark, "vectors")
    table(spark, sf_dir, "embeddings").select("vec_id", K.packed_vector(F.col("embedding")).alias("data"), F.size("embedding").alias("n")).write.parquet(path)
    back = spark.read.parquet(path).select("vec_id", K.unpacked_vectors(F.col("data"), 64).alias("rows"))
    return back.select("vec_id", F.posexplode(F.col("rows")[0]).alias("i", "x")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.col("x").cast("double").alias("x"))


@register("batch_collate", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS event_id, string_agg(event_type, ',' ORDER BY event_id) AS event_type FROM events GROUP BY user_id")
def batch_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a group as one row of lists."""
    packed = B.collate(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    return packed.select("user_id", F.array_join(F.transform("event_id", lambda x: x.cast("string")), ",").alias("event_id"), F.array_join("event_type", ",").alias("event_type"))


@register("batch_bytes", "SELECT CAST(sum(strlen(text)) AS BIGINT) AS text, CAST(count(*) * 8 AS BIGINT) AS doc_id FROM documents")
def batch_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sizes(table(spark, sf_dir, "documents").select("text", F.col("doc_id").cast("bigint").alias("doc_id")))


@register("batch_int_columns", "SELECT event_id, CAST(trunc(value) AS BIGINT) AS value FROM events")
def batch_int_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.as_integers(table(spark, sf_dir, "events").select("event_id", "value"), "value")


# Reports.
@register("csv_view", "SELECT conv_id, turn, text, '[' || turn || ',2]' AS extra FROM conversations")
def csv_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view with nested values and any text, written as CSV and read back."""
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array(F.col("turn").cast("bigint"), F.lit(2).cast("bigint")).alias("extra"))
    return O.csv_roundtrip(x, "conv_id bigint, turn int, text string, extra string")


@register("markdown_summary", f"WITH {R_SQL}, s AS (SELECT dataset, count(*) AS n, sum(em) AS correct FROM r GROUP BY dataset), l AS (SELECT row_number() OVER (ORDER BY dataset) + 1 AS n, '| ' || dataset || ' | ' || n || ' | ' || correct || ' |' AS line FROM s) SELECT 0 AS n, '| dataset | n | correct |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT n, line FROM l")
def markdown_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = E.search_metrics(records(spark, sf_dir), "dataset").select("dataset", "n", "correct")
    return O.markdown(summary, [F.col("dataset")]).select(F.col("n").cast("bigint").alias("n"), "line")


@register("line_digests", "SELECT source, sha256(string_agg('{\"id\":' || doc_id || ',\"lang\":' || coalesce('\"' || lang || '\"', 'null') || '}', chr(10) ORDER BY doc_id) || chr(10)) AS digest FROM documents GROUP BY source")
def line_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the canonical lines of each file, one file for each source, as its
    sidecar would have it."""
    line = corpus.canonical({"lang": F.col("lang"), "id": F.col("doc_id")})
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("l")))), lambda x: x["l"]), "\n")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sha2(F.concat(lines, F.lit("\n")), 256).alias("digest"))



# Documents and questions.
_TITLES = ["CASE doc_id % 4 WHEN 0 THEN ' ' || source || chr(10) || 'more' WHEN 1 THEN '  ' END AS title", "CASE doc_id % 4 WHEN 1 THEN chr(10) || ' by ' || source || ' ' WHEN 2 THEN '' END AS inner_title", "text AS contents"]


@register("document_titles", f"WITH x AS (SELECT doc_id, {', '.join(_TITLES)} FROM documents), y AS (SELECT doc_id, coalesce(nullif(trim(title, chr(10) || ' '), ''), nullif(trim(inner_title, chr(10) || ' '), ''), nullif(trim(contents, chr(10) || ' '), ''), '') AS t FROM x) SELECT doc_id, trim(split_part(t, chr(10), 1)) AS title FROM y")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each document from the first place that has one."""
    x = table(spark, sf_dir, "documents").selectExpr("doc_id", *_TITLES)
    return x.select("doc_id", D.title_of(F.col("title"), F.col("inner_title"), F.col("contents")).alias("title"))


_IDS = """CASE event_id % 9 WHEN 0 THEN '{"document_id":' || event_id || '}' WHEN 1 THEN '{"document_id":"d' || event_id || '"}' WHEN 2 THEN '{"document_id":" "}' WHEN 3 THEN '{"document_id":true}'
 WHEN 4 THEN '{"document_id":null}' WHEN 5 THEN '{"title":"t"}' WHEN 6 THEN '{"document_id":1.5}' WHEN 7 THEN '{"document_id":"7"}' ELSE '[1]' END"""


@register("document_ids", "SELECT event_id, CASE event_id % 9 WHEN 0 THEN '' || event_id WHEN 1 THEN 'd' || event_id WHEN 7 THEN '7' END AS id, event_id % 9 IN (0, 1, 5, 7) AS gate, event_id % 9 IN (0, 1, 7) AS probe FROM events")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents, where they may be missing and where not."""
    x = table(spark, sf_dir, "events").selectExpr("event_id", f"{_IDS} AS document")
    x = x.select("event_id", D.document_id(F.col("document"), False).alias("g"), D.document_id(F.col("document"), True).alias("p"))
    return x.select("event_id", "g.id", F.col("g.valid").alias("gate"), F.col("p.valid").alias("probe"))


@register("question_kinds", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'comparison' WHEN 1 THEN 'bridge' END AS kind FROM events")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").selectExpr("event_id", """CASE event_id % 4 WHEN 0 THEN '{"type":"comparison"}' WHEN 1 THEN '{"type":"bridge","level":"hard"}' WHEN 2 THEN '{"type":"single"}' ELSE '{}' END AS metadata""")
    return x.select("event_id", D.question_kind(F.col("metadata")).alias("kind"))


_CONTRACT = """'{ "tools": [ 1, {"name": null, "ask": true} ],  "kind": "' || event_type || '", "id": ' || event_id || ' }'"""


@register("contract_digests", """SELECT event_id, sha256('{"id":' || event_id || ',"kind":"' || event_type || '","tools":[1,{"ask":true,"name":null}]}') AS digest FROM events""")
def contract_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of prompt and tool contracts, whatever their layout."""
    return table(spark, sf_dir, "events").select("event_id", D.contract_digest(F.expr(_CONTRACT)).alias("digest"))


# Archives.
_DOC_LINE = "doc_id || chr(9) || replace(replace(text, chr(10), ' '), chr(13), ' ')"


def archives(spark: SparkSession, sf_dir: str) -> str:
    """Documents as lines of eight compressed archives."""
    path = scratch(spark, "archives")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("doc_id", "doc_id % 8 AS k", f"{_DOC_LINE} AS line")
    A.write_archives(docs, path, "k", "doc_id", "line")
    return path


_PLACED = f"WITH l AS (SELECT doc_id, doc_id % 8 AS k, {_DOC_LINE} AS line FROM documents WHERE text IS NOT NULL), p AS (SELECT *, row_number() OVER w - 1 AS row, CAST(sum(strlen(line) + 1) OVER w AS BIGINT) AS stop FROM l WINDOW w AS (PARTITION BY k ORDER BY doc_id ROWS UNBOUNDED PRECEDING))"


@register("archive_lines", f"{_PLACED} SELECT doc_id, 'part-' || k || '.jsonl' AS member, row, stop - strlen(line) - 1 AS start, stop, md5(line) AS digest FROM p")
def archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of compressed archives, read in streams by a data source."""
    found = A.lines(spark, archives(spark, sf_dir))
    return found.select(F.split_part("line", F.lit(chr(9)), F.lit(1)).cast("bigint").alias("doc_id"), "member", "row", "start", "stop", F.md5("line").alias("digest"))


@register("archive_manifest", f"{_PLACED} SELECT 'part-' || k || '.jsonl' AS member, count(*) AS rows, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY doc_id)) AS sha256, CAST(NULL AS VARCHAR) AS problem FROM p GROUP BY k")
def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of archives that were extracted, and whether its files hold."""
    manifest = A.extract(spark, archives(spark, sf_dir), scratch(spark, "extracted"))
    return A.verified(spark, manifest).select("member", "rows", "bytes", "sha256", "problem")


@register("positional_rows", f"{_PLACED} SELECT doc_id, row, stop - strlen(line) - 1 AS start, stop FROM p WHERE row >= 5 AND row < 30")
def positional_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 5 to 29 of each extracted file, by their byte ranges."""
    manifest = A.extract(spark, archives(spark, sf_dir), scratch(spark, "extracted"))
    found = A.rows(spark, manifest).where("row >= 5 AND row < 30")
    return found.select(F.split_part("line", F.lit(chr(9)), F.lit(1)).cast("bigint").alias("doc_id"), "row", "start", "stop")


# Token ids.  The end of text is what pads.
_EOS = 50256


def _vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as sampled ids, with an end or without."""
    x = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_SLICE} AS s")
    ids = N.encoded(F.col("s"), _vocabulary())
    return x.withColumn("raw", ids).withColumn("ids", F.when(F.col("turn") % 2 == 0, F.concat("raw", F.lit([_EOS, _EOS]))).otherwise(F.col("raw")))


@register("token_bytes", f"SELECT conv_id, turn, CAST(strlen(s) AS BIGINT) AS n_bytes, s AS text FROM (SELECT conv_id, turn, {_SLICE} AS s FROM conversations)")
def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the ids of each response, and their text."""
    total = F.aggregate(N.byte_lengths(F.col("raw"), _vocabulary()), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return sampled(spark, sf_dir).select("conv_id", "turn", total.alias("n_bytes"), N.decoded(F.col("raw"), _vocabulary()).alias("text"))


@register("token_action", f"""WITH x AS (SELECT conv_id, turn, {_SLICE} AS s FROM conversations) SELECT conv_id, turn,
CASE conv_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'answer' ELSE CASE WHEN turn % 2 = 0 THEN 'eos' ELSE 'length' END END AS boundary,
CASE conv_id % 3 WHEN 0 THEN split_part(s, '</search>', 1) || '</search>' WHEN 1 THEN split_part(s, '</answer>', 1) || '</answer>' ELSE s END AS action FROM x""")
def token_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ends each response's first action, and the action's text up to it."""
    found = N.action_slices(F.col("ids"), _vocabulary(), ("</search>", "</answer>"), eos=_EOS, pad=_EOS)
    out = sampled(spark, sf_dir).select("conv_id", "turn", found.alias("a"))
    return out.select("conv_id", "turn", "a.boundary", C.stop_at(F.col("a.text"), ("</search>", "</answer>")).alias("action"))


@register("token_slices")
def token_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sampled ids each action takes; tested against decoding every prefix."""
    found = N.action_slices(F.col("ids"), _vocabulary(), ("</search>", "</answer>"), eos=_EOS, pad=_EOS)
    return sampled(spark, sf_dir).select("conv_id", "turn", F.size("ids").alias("sampled"), found.alias("a")).select("conv_id", "turn", "sampled", "a.n_ids", "a.n_text", "a.boundary")


@register("token_window")
def token_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 384 ids of each observation that end with a whole character."""
    shown = N.encoded_within(F.col("text"), F.lit(384), _vocabulary())
    found = table(spark, sf_dir, "documents").select("doc_id", shown.alias("s"))
    return found.select("doc_id", F.coalesce("s.n", F.size(F.lit(None).cast(N.IDS))).alias("n"), "s.n_ids", "s.cut", F.length("s.text").alias("visible"))


@register("token_batch", "SELECT conv_id, turn, 64 AS width, true AS together FROM conversations")
def token_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in 64 places, padded on the left: mask and ids are of one length, and
    padding is where the mask is 0."""
    x = sampled(spark, sf_dir).select("conv_id", "turn", N.padded(F.col("raw"), F.lit(64), _EOS, left=True).alias("p"))
    padding = F.forall(F.arrays_zip("p.ids", "p.mask"), lambda z: (z["mask"] == 1) | (z["ids"] == _EOS))
    same = (F.size("p.ids") == F.size("p.mask")) & (F.size("p.positions") == F.size("p.ids")) & padding
    return x.select("conv_id", "turn", F.size("p.ids").alias("width"), same.alias("together"))
