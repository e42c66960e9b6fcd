"""Queries over curation, evidence and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.functions import protocol
from sextant.functions import text as T
from sextant.operators import curation as C
from sextant.operators import episodes as P
from sextant.operators import evaluation as E
from sextant.operators import merkle as M
from sextant.operators import retrieval as R
from sextant.plans.data import T_SQL, passages, table, transcripts
from sextant.plans.retrieval_queries import BM25_SQL, bm25_top, word_index
from sextant.plans.text_queries import d_norm, d_phrase, d_strip
from sextant.registry import register
from sextant.session import scratch

_KEY = "lower(trim(regexp_replace(split_part(text, '.', 1), '\\s+', ' ', 'g')))"


def _key():
    return F.lower(T.collapse(F.split_part("text", F.lit("."), F.lit(1))))


@register("qa_records", "SELECT doc_id, source AS data_source, 'user' AS role, split_part(text, '.', 1) || '?' AS content, 'fact' AS ability, 'rule' AS style, lang AS target, 'train' AS split, doc_id AS index FROM documents")
def qa_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five fields of a record, nested, and read back flat."""
    nested = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.concat(F.split_part("text", F.lit("."), F.lit(1)), F.lit("?")).alias("content"))).alias("prompt"), F.lit("fact").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.struct(F.array("lang").alias("target")).alias("ground_truth")).alias("reward_model"), F.struct(F.lit("train").alias("split"), F.col("doc_id").alias("index")).alias("extra_info"),
    )
    return nested.select("doc_id", "data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "ability", "reward_model.style", F.col("reward_model.ground_truth.target")[0].alias("target"), "extra_info.split", "extra_info.index")


_REASON = "CASE WHEN length(text) < 200 THEN 'too_short' WHEN length(text) > 5000 THEN 'too_long' WHEN contains(text, '!!') THEN 'junk' WHEN contains(text, 'http') THEN 'link' END"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.length("text") < 200, "too_short").when(F.length("text") > 5000, "too_long").when(F.contains("text", F.lit("!!")), "junk").when(F.contains("text", F.lit("http")), "link")
    return table(spark, sf_dir, "documents").withColumn("reject_reason", reason)


@register("prescreen_candidates", f"SELECT doc_id, {_REASON} AS reject_reason FROM documents")
def prescreen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("doc_id", "reject_reason")


@register("selection_funnel", f"SELECT lang, coalesce({_REASON}, 'kept') AS outcome, count(*) AS n FROM documents GROUP BY ALL")
def selection_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("lang", F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@register("dedup_first", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", _key().alias("key"))
    return C.first_of(docs, F.col("key"), F.col("source"), F.col("doc_id")).select("doc_id")


@register("stable_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42|sample|' || doc_id)) AS n FROM documents) WHERE n <= 20")
def stable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap of 20 for each category, by a hash."""
    return C.capped(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", C.draw("sample", F.col("doc_id")), 20).select("doc_id", "lang")


_QUOTAS = [("en", 30, 10), ("de", 20, 5), ("fr", 10, 5), ("es", 5, 100000), ("it", 3, 1)]
_Q_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in _QUOTAS) + ") AS v(lang, n_train, n_val))"


def quotas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_QUOTAS, "lang string, n_train int, n_val int")


_SPLIT = f"""{_Q_SQL}, b AS (SELECT doc_id, d.lang, n_train, n_val, row_number() OVER (PARTITION BY d.lang ORDER BY n_chars % 7, sha256('42|select|' || doc_id), doc_id) AS place FROM documents d JOIN q ON d.lang = q.lang),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('42|split|' || doc_id), doc_id) AS deal FROM b WHERE place <= n_train + n_val)"""


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quota_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", F.col("n_chars") % 7, "doc_id", quotas(spark))


@register("quota_split", f"WITH {_SPLIT} SELECT doc_id, lang, CASE WHEN deal <= n_train THEN 'train' ELSE 'val' END AS split FROM s")
def quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).select("doc_id", "lang", "split")


@register("quota_shortfall", f"WITH {_Q_SQL}, a AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT q.lang, CAST(coalesce(n, 0) AS BIGINT) AS available, CAST(n_train + n_val AS BIGINT) AS required, CAST(greatest(n_train + n_val - coalesce(n, 0), 0) AS BIGINT) AS missing FROM q LEFT JOIN a ON q.lang = a.lang")
def quota_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.shortfall(table(spark, sf_dir, "documents"), "lang", quotas(spark)).select("lang", "available", "required", "missing")


@register("order_digest", f"WITH {_SPLIT} SELECT sha256(string_agg(doc_id, chr(10) ORDER BY doc_id) || chr(10)) AS digest FROM s WHERE lang <> 'es'")
def order_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.order_digest(split(spark, sf_dir).where("lang <> 'es'"), "doc_id", F.col("doc_id"))


#: A tree of eight children a node over all documents (DuckDB): levels until one is left.
_LEAVES = "l0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, sha256(coalesce('leaf:' || text, 'null')) AS d FROM documents)"
_LEVELS = ", ".join(f"l{k + 1} AS (SELECT n // 8 AS n, sha256('node:' || string_agg(d, ',' ORDER BY n)) AS d FROM l{k} GROUP BY n // 8)" for k in range(8))


def document_tree(spark: SparkSession, sf_dir: str, changed: str = "false") -> M.Tree:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.expr(changed), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return M.build(docs, "doc_id", F.col("text"), 8)


@register("merkle_levels", f"WITH {_LEAVES}, {_LEVELS}, a AS ({' UNION ALL '.join(f'SELECT {k} AS level, count(*) AS nodes, min(d) AS least FROM l{k}' for k in range(9))}) SELECT level, nodes, least FROM a WHERE level <= (SELECT min(level) FROM a WHERE nodes = 1)")
def merkle_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the documents' tree of digests; the last one is its root."""
    return R.union_all([level.agg(F.lit(k).alias("level"), F.count(F.lit(1)).alias("nodes"), F.min("digest").alias("least")) for k, level in enumerate(document_tree(spark, sf_dir).levels)])


@register("merkle_differences", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS number, doc_id AS key, doc_id AS other_key FROM documents QUALIFY doc_id % 97 = 5 AND text IS NOT NULL")
def merkle_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were changed, found from the roots of two trees down."""
    return M.differences(document_tree(spark, sf_dir), document_tree(spark, sf_dir, "doc_id % 97 = 5"))


@register("merkle_evidence", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS number, NOT (doc_id % 40 = 0) AS holds FROM documents QUALIFY doc_id % 20 = 0")
def merkle_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about single documents, held against the root: half of them are false."""
    tree = document_tree(spark, sf_dir)
    asked = tree.levels[0].where("key % 20 = 0")
    claim = F.when(F.col("key") % 40 == 0, M.leaf(F.lit("not this"))).otherwise(F.col("digest"))
    claims = M.paths(tree, asked).drop("digest").join(asked.select("number", claim.alias("claim")), "number")
    return claims.select("number", M.holds(F.col("number"), F.col("claim"), F.col("path"), tree.root(), 8).alias("holds"))


@register("decontaminate_exact", f"SELECT doc_id FROM documents WHERE {_KEY} NOT IN (SELECT {_KEY} FROM benchmark)")
def decontaminate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exclude(table(spark, sf_dir, "documents"), _key(), table(spark, sf_dir, "benchmark"), _key()).select("doc_id")


@register("split_overlap", f"WITH a AS (SELECT DISTINCT {_KEY} AS k FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT {_KEY} AS k FROM documents WHERE doc_id % 2 = 1) SELECT 'questions' AS what, count(*) AS n FROM a JOIN b USING (k) UNION ALL SELECT 'ids', 0")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _key().alias("k"))
    a, b = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    count = lambda c, name: a.select(c).intersect(b.select(c)).agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
    return count("k", "questions").unionByName(count("doc_id", "ids"))


@register("audit_join", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unaudited' WHEN l.quality = 0 THEN 'rejected' WHEN d.doc_id % 17 = 3 THEN 'changed' ELSE 'accepted' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def audit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit entries by id; the entry's copy of the row must agree with it."""
    audit = table(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("doc_id") % 17 == 3, -1).otherwise(F.col("doc_id")).alias("expected"))
    state = F.when(F.col("quality").isNull(), "unaudited").when(F.col("quality") == 0, "rejected").when(F.col("expected") != F.col("doc_id"), "changed").otherwise("accepted")
    return table(spark, sf_dir, "documents").join(audit, "doc_id", "left").select("doc_id", state.alias("state"))


@register("supporting_titles", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN source || '|' || lang ELSE source || '|' || lang END AS titles FROM documents")
def supporting_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from three layouts, each once, in order."""
    k = F.col("doc_id") % 3
    lists = F.when(k == 0, F.array("source", "lang", "source"))
    structs = F.when(k == 1, F.transform(F.array("source", "lang", "lang"), lambda t: F.struct(t.alias("title"), F.lit(0).alias("sent"))))
    nested = F.when(k == 2, F.array(F.array("source", F.lit("0")), F.array("lang", F.lit("1")), F.array("source", F.lit("2"))))
    titles = F.coalesce(lists, F.transform(structs, lambda x: x["title"]), F.transform(nested, lambda x: x[0]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(titles), "|").alias("titles"))


@register("facts_visible", "SELECT doc_id, contains(text, split_part(text, ' ', 2)) AND contains(text, 'the') AS all_visible, contains(text, 'the') OR contains(text, 'und') AS any_visible FROM documents")
def facts_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    every = F.forall(F.array(F.split_part("text", F.lit(" "), F.lit(2)), F.lit("the")), lambda f: F.contains(t, f))
    some = F.exists(F.array(F.lit("the"), F.lit("und")), lambda f: F.contains(t, f))
    return table(spark, sf_dir, "documents").select("doc_id", every.alias("all_visible"), some.alias("any_visible"))


@register("supporting_sentences", "SELECT doc_id, n, s AS sentence FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) - 1 AS n FROM documents) WHERE n = doc_id % 3")
def supporting_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact (title, sentence number) as the text of the sentence."""
    docs = table(spark, sf_dir, "documents")
    sentences = docs.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("n", "sentence"))
    facts = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("n"))
    return facts.join(sentences, ["doc_id", "n"]).select("doc_id", F.col("n").cast("bigint").alias("n"), "sentence")


_TWO = f"WITH {BM25_SQL}, one AS (SELECT query_id, doc_id, rank FROM top WHERE rank <= 3), two AS (SELECT query_id, doc_id, rank FROM top WHERE rank <= 6 AND rank >= 3)"


@register("new_documents", _TWO + " SELECT query_id, doc_id FROM two WHERE (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM one)")
def new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the second search that the first did not have."""
    hits = bm25_top(spark, sf_dir, 6)
    return hits.where("rank >= 3").select("query_id", "doc_id").join(hits.where("rank <= 3").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


@register("title_coverage", _TWO + ", t AS (SELECT query_id, source FROM one JOIN documents USING (doc_id)) SELECT item_id, 'src' || (item_id % 20) AS title FROM benchmark WHERE EXISTS (SELECT 1 FROM t WHERE query_id = item_id AND source = 'src' || (item_id % 20))")
def title_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supporting titles that the hits have."""
    titles = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("title"))
    found = table(spark, sf_dir, "documents").select("doc_id", "source").join(R.sized(bm25_top(spark, sf_dir, 3).select("query_id", "doc_id")), "doc_id")
    found = found.select(F.col("query_id").alias("item_id"), T.normalize_phrase(F.col("source")).alias("key")).distinct()
    return titles.withColumn("key", T.normalize_phrase(F.col("title"))).join(found, ["item_id", "key"], "left_semi").select("item_id", "title")


@register("replay_diff", _TWO + " SELECT query_id, doc_id, 'stored' AS side FROM one WHERE query_id % 10 = 4 AND rank = 1 UNION ALL SELECT query_id, -1, 'replayed' FROM one WHERE query_id % 10 = 4 AND rank = 1")
def replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hits against a replay in which one query in ten differs."""
    stored = bm25_top(spark, sf_dir, 3).select("query_id", "rank", "doc_id")
    again = stored.withColumn("doc_id", F.when((F.col("query_id") % 10 == 4) & (F.col("rank") == 1), F.lit(-1).cast("bigint")).otherwise(F.col("doc_id")))
    diff = lambda a, b, side: a.exceptAll(b).select("query_id", "doc_id", F.lit(side).alias("side"))
    return diff(stored, again, "stored").unionByName(diff(again, stored, "replayed"))


@register("phrase_rank", f"WITH {BM25_SQL}, f AS (SELECT query_id, min(rank) AS r FROM top JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10 AND contains(' ' || {d_phrase('d.text')} || ' ', ' ' || {d_phrase('b.text')} || ' ') GROUP BY 1) SELECT item_id AS query_id, CAST(coalesce(r, 11) AS INTEGER) AS rank FROM benchmark LEFT JOIN f ON item_id = query_id")
def phrase_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the first of ten hits that contains the item, else 11."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.normalize_phrase(F.col("text")).alias("needle"))
    hits = table(spark, sf_dir, "documents").select("doc_id", "text").join(R.sized(bm25_top(spark, sf_dir, 10)), "doc_id").join(R.sized(items), "query_id")
    first = hits.where(T.contains_phrase(T.normalize_phrase(F.col("text")), F.col("needle"))).groupBy("query_id").agg(F.min("rank").alias("r"))
    return items.join(first, "query_id", "left").select("query_id", F.coalesce("r", F.lit(11)).alias("rank"))


@register("two_hop_evidence", f"""WITH {BM25_SQL}, h AS (SELECT query_id, rank, doc_id, source FROM top JOIN documents USING (doc_id) WHERE rank <= 5), one AS (SELECT query_id, bool_or(source = 'src0') AS a, bool_or(source = 'src1') AS b FROM h WHERE rank <= 3 GROUP BY 1),
c AS (SELECT query_id, CASE WHEN a THEN 'src1' ELSE 'src0' END AS missing FROM one WHERE a <> b) SELECT c.query_id, missing, bool_or(h.source = missing) AS found FROM c JOIN h ON h.query_id = c.query_id AND h.rank > 3 GROUP BY ALL""")
def two_hop_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for which the first search finds one of two titles; whether the
    hits after it have the other."""
    hits = table(spark, sf_dir, "documents").select("doc_id", "source").join(R.sized(bm25_top(spark, sf_dir, 5).select("query_id", "rank", "doc_id")), "doc_id")
    one = hits.where("rank <= 3").groupBy("query_id").agg(F.bool_or(F.col("source") == "src0").alias("a"), F.bool_or(F.col("source") == "src1").alias("b"))
    partly = one.where("a <> b").select("query_id", F.when(F.col("a"), "src1").otherwise("src0").alias("missing"))
    return hits.where("rank > 3").join(partly, "query_id").groupBy("query_id", "missing").agg(F.bool_or(F.col("source") == F.col("missing")).alias("found"))


@register("evidence_audit", "SELECT doc_id, CASE WHEN n_chars < 300 THEN 'no_context' WHEN NOT contains(text, 'the') AND lang = 'en' THEN 'fact_not_visible' WHEN length(split_part(text, ' ', 1)) < 3 THEN 'weak_answer' WHEN doc_id % 6 = 0 THEN 'no_new_document' END AS reason, CAST(n_chars // 1000 AS BIGINT) AS quality FROM documents")
def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason to reject, and the quality of what is kept."""
    first = F.split_part("text", F.lit(" "), F.lit(1))
    reason = F.when(F.col("n_chars") < 300, "no_context").when(~F.contains("text", F.lit("the")) & (F.col("lang") == "en"), "fact_not_visible").when(F.length(first) < 3, "weak_answer").when(F.col("doc_id") % 6 == 0, "no_new_document")
    return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"), F.expr("n_chars div 1000").alias("quality"))


_W = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"
_A, _B = _W.format("prediction"), _W.format("golds[1]")


@register("jaccard_gate", f"WITH {T_SQL} SELECT conv_id, turn, round(CASE WHEN len({_A}) + len({_B}) = 0 THEN 0 ELSE len(list_intersect({_A}, {_B})) / len(list_distinct(list_concat({_A}, {_B}))) END, 6) AS similarity FROM t")
def jaccard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.array_distinct(T.phrase_tokens(F.col("prediction"))), F.array_distinct(T.phrase_tokens(F.col("golds")[0]))
    return transcripts(spark, sf_dir).select("conv_id", "turn", F.round(P.jaccard_gate(a, b), 6).alias("similarity"))


@register("jaccard_probe", f"WITH {T_SQL} SELECT conv_id, turn, round(CASE WHEN len({_A}) = 0 OR len({_B}) = 0 THEN 1 ELSE len(list_intersect({_A}, {_B})) / len(list_distinct(list_concat({_A}, {_B}))) END, 6) AS similarity FROM t")
def jaccard_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.array_distinct(T.phrase_tokens(F.col("prediction"))), F.array_distinct(T.phrase_tokens(F.col("golds")[0]))
    return transcripts(spark, sf_dir).select("conv_id", "turn", F.round(P.jaccard_probe(a, b), 6).alias("similarity"))


@register("query_relevance", f"WITH {T_SQL} SELECT conv_id, turn, len(list_filter(list_intersect({_A}, {_B}), lambda w: w NOT IN ('the', 'of', 'de', 'der', 'und'))) > 0 AS relevant FROM t")
def query_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether query and question share a word that is no stop word."""
    stop = F.array(*map(F.lit, ("the", "of", "de", "der", "und")))
    return transcripts(spark, sf_dir).select("conv_id", "turn", F.arrays_overlap(F.array_except(T.phrase_tokens(F.col("prediction")), stop), T.phrase_tokens(F.col("golds")[0])).alias("relevant"))


_EVENTS = "e AS (SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text FROM conversations WHERE role <> 'system')"


@register("redundant_search", rf"""WITH {_EVENTS}, w AS (SELECT id, n, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w, list_distinct([length(text) % 5, length(text) % 3]) AS d FROM e WHERE n <= 3),
x AS (SELECT a.id, max(CASE WHEN len(a.w) + len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END) AS s, list_distinct(flatten(list(b.d))) AS ds, any_value(a.d) AS d3 FROM w a JOIN w b ON a.id = b.id AND b.n < 3 WHERE a.n = 3 GROUP BY a.id),
f AS (SELECT id, s, len(list_filter(d3, lambda v: NOT list_contains(ds, v))) AS fresh, len(d3) AS k FROM x)
SELECT id, round(s, 6) AS similarity, fresh = 0 AS no_new_document, round(fresh / k, 6) AS novelty, CASE WHEN id % 2 = 1 AND id % 3 = 0 AND (s >= 0.8 OR fresh = 0) THEN 'strong' WHEN (id % 2 = 1 AND id % 3 = 0 AND fresh / k <= 1.0 / 3) OR (id % 2 = 0 AND s >= 0.8 AND fresh = 0) THEN 'medium' ELSE 'review' END AS classification FROM f""")
def redundant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).where("n <= 3")
    length = F.length("text")
    e = events.select(F.col("conv_id").alias("id"), "n", F.array_distinct(T.phrase_tokens(F.col("text"))).alias("words"), F.array_distinct(F.array(length % 5, length % 3)).alias("docs"))
    r = P.redundancy(e)
    kind = P.redundancy_class(F.col("id") % 2, F.col("id") % 3 == 0, F.col("duplicate_query"), F.col("no_new_document"), F.col("novelty"))
    return r.select("id", F.round("similarity", 6).alias("similarity"), "no_new_document", F.round("novelty", 6).alias("novelty"), kind.alias("classification"))


@register("visible_window", "SELECT doc_id, substr(text, 1, 384) AS visible, length(text) > 384 AS cut FROM documents")
def visible_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of an observation is shown, by characters where no tokenizer is
    plugged in."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 384).alias("visible"), (F.length("text") > 384).alias("cut"))


@register("hit_violations", f"WITH {BM25_SQL}, h AS (SELECT query_id, CASE WHEN query_id % 7 = 2 THEN rank + 1 ELSE rank END AS rank, score FROM top WHERE rank <= 5) SELECT query_id, 'ranks' AS rule FROM h GROUP BY query_id HAVING min(rank) <> 1 OR max(rank) <> count(*)")
def hit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit lists whose ranks are not 1..n or whose scores are not finite."""
    hits = bm25_top(spark, sf_dir, 5).withColumn("rank", F.when(F.col("query_id") % 7 == 2, F.col("rank") + 1).otherwise(F.col("rank")))
    lists = hits.groupBy("query_id").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count(F.lit(1)).alias("n"), F.bool_and(~F.isnan("score") & (F.abs("score") < float("inf"))).alias("finite"))
    return E.violations(lists, "query_id", {"ranks": (F.col("lo") == 1) & (F.col("hi") == F.col("n")), "scores": F.col("finite")})


# Traces.
def _step(case: int, step: int, think: str, action: str, content: str = "NULL", observation: str = "NULL", loose: str = "''") -> str:
    return f"SELECT conv_id, turn, {step} AS step, {think} AS think, '{action}' AS action, {content} AS content, {observation} AS observation, {loose} AS invalid_text, {'false' if action == 'invalid' else 'true'} AS valid FROM w WHERE conv_id % 7 = {case}"


_TURNS = " UNION ALL ".join([
    _step(0, 0, "a", "search", "bc", "s"), _step(0, 1, "'so'", "answer", "b"), _step(1, 0, "'a'", "answer", "a"), _step(1, 1, "NULL", "answer", "b"), _step(2, 0, "'a'", "invalid", loose="'<search>' || b"),
    _step(3, 0, "NULL", "answer", "a", loose="'tail'"), _step(3, 1, "NULL", "search", "c"), _step(5, 0, "s", "search", "b", loose="'stray'"), _step(6, 0, "'b'", "answer", "b"),
])


@register("parse_transcript", f"""WITH {T_SQL}, w AS (SELECT conv_id, turn, {d_strip("split_part(text, ' ', 1)")} AS a, {d_strip("split_part(text, ' ', 2)")} AS b, {d_strip("split_part(text, ' ', 3)")} AS c, {d_strip("split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)")} AS bc, {d_strip("text")} AS s FROM t) {_TURNS}""")
def parse_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of every transcript; the state machine is tested case by case."""
    x = T.assistant_text(F.col("transcript"), "<|im_start|>assistant", "<|im_end|>")
    turns = transcripts(spark, sf_dir).select("conv_id", "turn", F.explode(protocol.turns_of(x)).alias("t"))
    return turns.select("conv_id", "turn", F.col("t.turn").alias("step"), "t.think", "t.action", "t.content", "t.observation", F.array_join("t.invalid_text", "|").alias("invalid_text"), "t.valid")


_CALL = "r</think><tool_call><function=search><parameter=query>%s</parameter></function></tool_call>"
_ODD_CALL = "r</think><tool_call><function=%s><parameter=%s>{1}</parameter></function></tool_call>"
#: Shapes of responses, with the action, its content and the error each has; {1} and {2}
#: stand for the first words of a turn, {n} for a line's end.
_SHAPES = [
    (_CALL % "{1}" + " tail", "search", "{1}", None), ("r</think> so <answer>{1}</answer>", "answer", "{1}", None), ("no reasoning", None, "", "invalid_thinking_prefix"), ("r</think>", None, "", "missing_native_action"),
    ('r</think>{"name": 1}', None, "", "json_tool_call_not_supported"), ("r</think><answer> </answer>", None, "", "empty_answer"), (_CALL % "<search>{1}</search>", None, "", "nested_protocol_marker"),
    (_CALL % "{1} <information b", None, "", "nested_protocol_marker"), (_CALL % "{1}<|im_end|>", None, "", "nested_protocol_marker"), ("r</think><answer><|im_start|></answer>", None, "", "nested_protocol_marker"),
    ("r</think> <search>{1}</search> <answer>b</answer>", None, "", "invalid_action_prefix"), ("r</think>{1} with <search> and no action", None, "", "multiple_or_unbalanced_tool_calls"),
    (_ODD_CALL % ("a b", "query"), None, "", "malformed_tool_call"), (_ODD_CALL % ("search", "1q"), None, "", "malformed_tool_call"), (_ODD_CALL % ("find", "query"), None, "", "unknown_tool"), (_ODD_CALL % ("search", "q"), None, "", "invalid_search_parameter"),
    (_CALL % "{n} {1} {2}{n}" + "<|im_end|>", "search", "{1} {2}", None), ("", None, "", "empty_response"), ("r</think><answer>{1}", None, "", "multiple_or_unbalanced_answers"), ("r</think>{1}{n}<answer>{1} {2}{n}</answer>", "answer", "{1} {2}", None),
]


def _of_shape(i: int) -> str:
    """The shapes' ``i``-th values by a number of the row (both engines)."""
    cases = " ".join(f"WHEN {n} THEN {'NULL' if x[i] is None else f"'{x[i]}'"}" for n, x in enumerate(_SHAPES))
    return f"replace(replace(replace(CASE (conv_id * 5 + turn) % {len(_SHAPES)} {cases} END, '{{1}}', split_part(text, ' ', 1)), '{{2}}', split_part(text, ' ', 2)), '{{n}}', chr(10))"


_RESPONSE = _of_shape(0)


@register("native_action", f"SELECT conv_id, turn, {_of_shape(1)} AS action, {d_strip(_of_shape(2))} AS content, {_of_shape(3)} AS error FROM conversations")
def native_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = protocol.native_actions(table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_RESPONSE} AS r"), F.col("r"))
    return out.select("conv_id", "turn", "parsed.action", "parsed.content", "parsed.error")


@register("action_boundary", f"WITH x AS (SELECT conv_id, turn, {_RESPONSE} AS r FROM conversations), y AS (SELECT *, instr(r, '</tool_call>') AS a, instr(r, '</answer>') AS b FROM x) SELECT conv_id, turn, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN b = 0 OR (a > 0 AND a < b) THEN 'tool_call' ELSE 'answer' END AS closer FROM y WHERE contains(r, '</think>')")
def action_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = protocol.boundaries(table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_RESPONSE} AS r"), F.col("r"), name="b")
    return x.where("b IS NOT NULL").select("conv_id", "turn", "b.closer")


@register("trace_violations", "SELECT conv_id, 'role' AS rule FROM conversations WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT conv_id, 'length' FROM conversations WHERE length(text) >= 300 UNION ALL SELECT conv_id, 'turn' FROM conversations WHERE turn >= 6")
def trace_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"role": F.col("role").isin("user", "assistant"), "length": F.length("text") < 300, "turn": F.col("turn") < 6}
    return E.violations(table(spark, sf_dir, "conversations"), "conv_id", rules)


@register("trace_manifest", "SELECT role AS stage, count(*) AS n, count(DISTINCT conv_id) AS ids, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY role")
def trace_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("ids"), F.sum(F.length("text")).alias("characters"))


@register("trace_diagnostics", "WITH a AS (SELECT conv_id, turn, [length(text), turn, 7] AS raw, [length(text), CASE WHEN conv_id % 5 = 0 THEN -1 ELSE turn END] AS act FROM conversations) SELECT conv_id, turn, raw[1:2] = act AS prefix_intact, CAST(len(raw) - len(act) AS INTEGER) AS dropped FROM a")
def trace_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an action's tokens are what the raw generation begins with."""
    n = F.length("text").cast("bigint")
    raw, act = F.array(n, "turn", F.lit(7).cast("bigint")), F.array(n, F.when(F.col("conv_id") % 5 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.slice(raw, F.lit(1), F.size(act)) == act).alias("prefix_intact"), (F.size(raw) - F.size(act)).alias("dropped"))


@register("event_alignment", "WITH g AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'), r AS (SELECT conv_id, turn FROM conversations WHERE role = 'user') SELECT g.conv_id, CAST(count(*) AS BIGINT) AS generations, CAST(count(r.turn) AS BIGINT) AS aligned FROM g LEFT JOIN r ON r.conv_id = g.conv_id AND r.turn + 1 = g.turn GROUP BY 1")
def event_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations and the retrievals right before them."""
    turns = table(spark, sf_dir, "conversations")
    g = turns.where("role = 'assistant'").select("conv_id", "turn")
    r = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(1).alias("x"))
    return g.join(r, ["conv_id", "turn"], "left").groupBy("conv_id").agg(F.count(F.lit(1)).alias("generations"), F.count("x").alias("aligned"))


@register("retrieval_alignment", "SELECT conv_id, 'first turn' AS rule FROM conversations GROUP BY conv_id HAVING min(turn) <> 0 UNION ALL SELECT conv_id, 'turns in sequence' FROM conversations GROUP BY conv_id HAVING max(turn) - min(turn) + 1 <> count(*) UNION ALL SELECT conv_id, 'turns differ' FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn) <> count(*)")
def retrieval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("turn").alias("d"))
    return E.violations(c, "conv_id", {"first turn": F.col("lo") == 0, "turns in sequence": F.col("hi") - F.col("lo") + 1 == F.col("n"), "turns differ": F.col("d") == F.col("n")})


@register("mode_alignment", "SELECT conv_id, max(CASE WHEN turn = 0 THEN length(text) END) AS direct, max(CASE WHEN turn = 1 THEN length(text) END) AS managed FROM conversations GROUP BY conv_id")
def mode_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modes of one sample side by side."""
    n = F.length("text").cast("bigint")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, n)).alias("direct"), F.max(F.when(F.col("turn") == 1, n)).alias("managed"))


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select(F.col("conv_id").alias("id"), "turn", T.assistant_text(F.col("transcript"), "<|im_start|>assistant", "<|im_end|>").alias("response"))


#: Episodes that are played (DuckDB).
_PLAYED = f"""WITH {T_SQL}, a AS (SELECT conv_id AS id, turn, conv_id % 7 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, text FROM t),
ep AS (SELECT id, turn, CAST(step AS INTEGER) AS step, CASE WHEN k IN (0, 5) THEN 'search' WHEN k IN (1, 3, 6) THEN 'answer' ELSE 'invalid' END AS action,
 CASE k WHEN 0 THEN {d_strip("split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)")} WHEN 1 THEN {d_strip("split_part(text, ' ', 1)")} WHEN 3 THEN {d_strip("split_part(text, ' ', 1)")} WHEN 5 THEN {d_strip("split_part(text, ' ', 2)")} WHEN 6 THEN {d_strip("split_part(text, ' ', 2)")} ELSE '' END AS content,
 k IN (1, 3, 6) AS done, k NOT IN (2, 4) AS valid FROM a WHERE step < CASE WHEN k IN (1, 3, 6) THEN 1 ELSE 4 END)"""
#: Steps of a replay, with what a search shows: the best document of its query.
_SHOWN = BM25_SQL.replace("(SELECT item_id, unnest(", "(SELECT id * 100 + turn AS item_id, unnest(").replace("FROM benchmark)", "FROM (SELECT id, turn, content AS text FROM ep WHERE action = 'search'))")
_STEPS = f"{_PLAYED}, {_SHOWN} SELECT ep.id, ep.turn, ep.action, ep.content, CASE ep.action WHEN 'search' THEN coalesce(CAST(top.doc_id AS VARCHAR), '') WHEN 'answer' THEN '' ELSE 'retry' END AS observation, ep.done, ep.valid FROM ep LEFT JOIN top ON top.query_id = ep.id * 100 + ep.turn AND top.rank = 1"


@register("episode_replay", _STEPS)
def episode_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripted episodes with retrieval over all documents; tested step by step."""
    return P.replay(policy(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text"), 4)


#: Every turn as a step of its own, none left out (DuckDB).
_ACTED = _PLAYED.replace(" WHERE step < CASE WHEN k IN (1, 3, 6) THEN 1 ELSE 4 END", "")
_FOUND = _SHOWN.replace("id * 100 + turn AS item_id", "struct_pack(id := id, turn := turn) AS item_id")


@register("env_step", f"{_ACTED}, {_FOUND} SELECT ep.id, ep.turn, ep.action, ep.content, CASE ep.action WHEN 'search' THEN coalesce(CAST(top.doc_id AS VARCHAR), '') WHEN 'answer' THEN '' ELSE 'retry' END AS observation, ep.done, ep.valid FROM ep LEFT JOIN top ON top.query_id = struct_pack(id := ep.id, turn := ep.turn) AND top.rank = 1")
def env_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step for every turn, with what its search shows."""
    turns = policy(spark, sf_dir).select(F.struct("id", "turn").alias("id"), "response")
    steps = P.env_step(turns, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return steps.select("id.id", "id.turn", "action", "content", "observation", "done", "valid")


@register("canonical_json", """SELECT doc_id, '{"index":' || doc_id || ',"lang":"' || lang || '","missing":null,"source":"' || source || '"}' AS line FROM documents""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys sorted, no spaces, nulls kept."""
    from sextant.sources.corpus import canonical

    row = {"source": F.col("source"), "lang": F.col("lang"), "index": F.col("doc_id"), "missing": F.lit(None).cast("string")}
    return table(spark, sf_dir, "documents").select("doc_id", canonical(row).alias("line"))


@register("corpus_roundtrip", "SELECT doc_id AS id, md5('\"' || source || ' ' || doc_id || '\"' || chr(10) || text) AS digest FROM documents")
def corpus_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages written as JSON lines and read back with their schema."""
    from sextant.sources import corpus

    back = corpus.roundtrip(passages(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "contents"))
    return back.select(F.col("id").cast("bigint").alias("id"), F.md5("contents").alias("digest"))


@register("corpus_offsets", "SELECT doc_id, CAST(coalesce(sum(octet_length(encode(text)) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents")
def corpus_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offset of each document's line in one file: sums within ranges plus
    the ranges' totals."""
    from sextant.sources.corpus import offsets

    return offsets(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@register("summary_norm", f"SELECT doc_id, length({d_norm('text')}) AS n FROM documents")
def summary_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every document as a normalised answer."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.normalize_answer(F.col("text"))).cast("bigint").alias("n"))


# Streams over events.
@register("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.streaming import events as V

    out = V.drain(V.windowed(V.source(spark, sf_dir), "1 hour", None), "tumbling", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("events_sliding", "SELECT b AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS b FROM events) GROUP BY ALL")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.streaming import events as V

    batch = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = V.windowed(batch, "1 hour", "30 minutes")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("events_session", "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY user_id, s")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.streaming import events as V

    out = V.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes")
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@register("events_dedup_watermark", "SELECT event_id, user_id FROM events")
def events_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which every event comes twice, with each kept once."""
    from sextant.streaming import events as V

    twice = V.source(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return V.drain(V.once(twice, "event_id", "365 days").select("event_id", "user_id"), "dedup")


@register("trace_stream", "SELECT event_id, 'trace:' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 24) AS record_id, event_type FROM events")
def trace_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended exactly once: stream, deduplicate by id, write files."""
    from sextant.streaming import events as V

    r = V.source(spark, sf_dir).withColumn("record_id", T.record_id(F.col("event_id").cast("string")))
    return V.drain(V.once(r, "record_id", "365 days").select("event_id", "record_id", "event_type"), "trace")


def played_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of all conversations, played from a stream in two runs on one
    checkpoint: turns up to the middle of the time, then the others.  Each run is one
    micro-batch, since files that are written together come in any order of time, and
    those behind the watermark would lose their turns."""
    from sextant.streaming import episodes as S

    at = scratch(spark, "episode-stream")
    turns = policy(spark, sf_dir).select("id", "turn", "response", F.timestamp_seconds(1_704_067_200 + F.col("id") * 60 + F.col("turn") * 10).alias("ts"))
    middle = turns.agg(F.timestamp_seconds(F.avg(F.unix_timestamp("ts"))).alias("m"))  # one row
    turns = turns.crossJoin(F.broadcast(middle))
    for part in ("ts <= m", "ts > m"):
        turns.where(part).drop("m").write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("id bigint, turn bigint, response string, ts timestamp").parquet(f"{at}/in")
        S.run(S.steps(stream, 4, F.col("response")), f"{at}/out", f"{at}/state")
    return S.read(spark, f"{at}/out")


@register("episode_stream", f"{_PLAYED} SELECT * FROM ep")
def episode_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that a stream with state writes: those of a replay in one batch."""
    return played_stream(spark, sf_dir)


@register("episode_stream_totals", f"{_PLAYED} SELECT count(DISTINCT id) AS episodes, count(*) AS steps, CAST(count(*) FILTER (done) AS BIGINT) AS answers, CAST(0 AS BIGINT) AS broken FROM ep")
def episode_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a finished stream sums up to, with no rule broken."""
    from sextant.streaming import episodes as S

    return S.finish(played_stream(spark, sf_dir)).select("episodes", "steps", "answers", "broken")


@register("episode_steps", _STEPS)
def episode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``episode_replay``, searched in the stored index of words."""
    done = played_stream(spark, sf_dir)
    asked = done.where("action = 'search'").select((F.col("id") * 100 + F.col("turn")).alias("query_id"), F.col("content").alias("text"))
    found = word_index(spark, sf_dir).search(asked, 1).select("query_id", F.col("doc_id").cast("string").alias("found"))
    out = done.withColumn("query_id", F.col("id") * 100 + F.col("turn")).join(found, "query_id", "left")
    shown = F.when(F.col("action") == "search", F.coalesce("found", F.lit(""))).when(F.col("action") == "answer", "").otherwise("retry")
    return out.select("id", "turn", "action", "content", shown.alias("observation"), "done", "valid")
