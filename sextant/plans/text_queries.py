"""Queries over text functions and answer scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import html as H
from sextant.functions import scoring as S
from sextant.functions import text as T
from sextant.plans.data import CONTENTS, T_SQL, passages, table, transcripts
from sextant.registry import register


# The same in DuckDB, whose regular expressions know ASCII words only.
def d_norm(x: str) -> str:
    return rf"array_to_string(list_filter(string_split_regex(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


def d_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def d_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def d_phrase(x: str) -> str:
    return rf"array_to_string(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), ' ')"


def d_ascii(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^0-9a-z]+', ' ', 'g'))"




def _turns(name: str, column, sql: str, alias: str):
    """A query of one computed column over all transcripts."""

    @register(name, f"WITH {T_SQL} SELECT conv_id, turn, {sql} AS {alias} FROM t")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return transcripts(spark, sf_dir).select("conv_id", "turn", column().alias(alias))

    return query


_turns("normalize_answer", lambda: T.normalize_answer(F.col("prediction")), d_norm("prediction"), "normalized")
_turns("normalize_phrase", lambda: T.normalize_phrase(F.col("text")), d_phrase("text"), "phrase")
_KEY = d_collapse("text || ' ?'")
_turns("question_key", lambda: T.question_key(F.concat(F.col("text"), F.lit(" ?"))), d_strip(rf"regexp_replace(lower({_KEY}), '\?$', '')"), "question_key")
_turns("clean_question", lambda: T.clean_question(F.col("text")), f"CASE WHEN {d_collapse('text')} LIKE '%?' THEN {d_collapse('text')} ELSE {d_collapse('text')} || '?' END", "question")
_turns("usable_answers", lambda: T.usable_answers(F.array(F.substring("text", 1, 2), F.lit("yes"), F.split_part("text", F.lit(" "), F.lit(1)))), f"len(list_filter([{d_phrase('substr(text, 1, 2)')}, 'yes', {d_phrase('split_part(text, chr(32), 1)')}], lambda a: length(a) >= 3 AND a NOT IN ('yes', 'no', 'true', 'false', 'unknown'))) > 0", "usable")
_turns("sanitize_query", lambda: T.sanitize_query(F.col("text")), d_collapse(r"regexp_replace(text, '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g')"), "query")
_turns("degenerate_query", lambda: T.degenerate_query(F.col("prediction")), f"coalesce(lower({d_strip('prediction')}), '') IN ('', 'query', 'and')", "degenerate")
_turns("truncate_response", lambda: T.truncate_response(F.col("transcript")), "CASE WHEN contains(transcript, '</search>') THEN split_part(transcript, '</search>', 1) || '</search>' WHEN contains(transcript, '</answer>') THEN split_part(transcript, '</answer>', 1) || '</answer>' ELSE transcript END", "response")
_turns("assistant_text", lambda: T.assistant_text(F.col("transcript"), "<|im_start|>assistant", "<|im_end|>"), "string_split(transcript, '<|im_start|>assistant')[-1]", "reply")
_turns("question_from_prompt", lambda: T.question_from_prompt(F.substring_index("transcript", "?", 1)), d_strip("string_split(split_part(transcript, '?', 1), 'Question:')[-1]"), "question")
_ANSWERS = "regexp_extract_all(transcript, '(?s)<answer>(.*?)</answer>', 1)"
_EXTRACT = f"CASE WHEN len({_ANSWERS}) >= 2 THEN {d_strip(f'{_ANSWERS}[-1]')} END"
_turns("extract_answer", lambda: T.extract_answer(F.col("transcript")), _EXTRACT, "answer")
_EM = f"CASE WHEN len(list_filter(golds, lambda g: {d_norm('g')} = {d_norm('prediction')})) > 0 THEN 1 ELSE 0 END"
_turns("em_check", lambda: S.em(F.col("prediction"), F.col("golds")), _EM, "em")
_SUB = f"CASE WHEN len(list_filter(golds, lambda g: contains({d_norm('prediction')}, {d_norm('g')}))) > 0 THEN 1 ELSE 0 END"
_turns("subem_check", lambda: S.sub_em(F.col("prediction"), F.col("golds")), _SUB, "sub_em")
_EM_T = f"len(list_filter(golds, lambda g: {d_norm('g')} = {d_norm(f'({_EXTRACT})')})) > 0"
_turns("score_em", lambda: S.score_em(F.col("transcript"), F.col("golds"), 0.1), f"CASE WHEN {_EXTRACT} IS NULL THEN 0.0::DOUBLE WHEN {_EM_T} THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END", "score")
_BLOCKS = "regexp_extract_all(transcript, '(?s)<information>(.*?)</information>', 1)"
_RETRIEVED = f"len(list_filter({_BLOCKS}, lambda b: len(list_filter(golds, lambda g: contains({d_norm('b')}, {d_norm('g')}))) > 0)) > 0"
_turns("retrieval_correct", lambda: T.retrieval_correct(F.col("transcript"), F.col("golds")), _RETRIEVED, "found")
_CONTENT = r"regexp_replace(transcript, '(?s)^.*?<\|im_start\|>assistant\s*', '')"
_COUNT = lambda tag: f"len(string_split({_CONTENT}, '{tag}'))"
_LETTERS = f"array_to_string(list_transform(regexp_extract_all({_CONTENT}, '(</?(?:think|search|information|answer)>)', 1), lambda g: CASE WHEN g LIKE '</%' THEN '/' || g[3] ELSE g[2] END), '')"
_PROBLEM = (
    "CASE " + " ".join(f"WHEN {_COUNT(f'<{x}>')} <> {_COUNT(f'</{x}>')} THEN 'unbalanced {x}'" for x in T.TAGS)
    + f" WHEN NOT regexp_matches({_LETTERS}, '^t/t(s/si/it/t)*a/a$') THEN 'order of tags'"
    + rf" WHEN regexp_matches({_CONTENT}, '(?s)(</(?:think|search|information)>)\s*[^\s<]') OR regexp_matches({_CONTENT}, '(?s)^\s*[^\s<]') OR regexp_matches({_CONTENT}, '(?s)</answer>\s*\S') THEN 'text between tags' END"
)
_turns("valid_sequence", lambda: T.tag_problem(F.col("transcript")), _PROBLEM, "problem")
_PARTIAL = f"(CASE WHEN {_RETRIEVED} THEN 0.2 + 0.1 ELSE 0.2 END)"
_turns(
    "score_em_format", lambda: F.round(S.score_em_format(F.col("transcript"), F.col("golds")), 6),
    f"round(CAST(CASE WHEN {_EXTRACT} IS NULL THEN CASE WHEN ({_PROBLEM}) IS NULL THEN {_PARTIAL} ELSE 0 END WHEN {_EM_T} AND ({_PROBLEM}) IS NULL THEN 1 WHEN {_EM_T} THEN 0.8 WHEN ({_PROBLEM}) IS NULL THEN {_PARTIAL} ELSE 0.1 END AS DOUBLE), 6)", "score",
)


@register("parse_action", rf"""WITH {T_SQL}, a AS (SELECT conv_id, turn, string_split(transcript, '<|im_start|>assistant')[-1] AS x FROM t),
f AS (SELECT *, regexp_extract(x, '(?s)^.*?<(?:search)>(.*?)</search>', 0) AS s, regexp_extract(x, '(?s)^.*?<answer>(.*?)</answer>', 0) AS w FROM a),
p AS (SELECT *, CASE WHEN s = '' AND w = '' THEN 'invalid' WHEN w = '' OR (s <> '' AND instr(x, '<search>') < instr(x, '<answer>')) THEN 'search' ELSE 'answer' END AS action FROM f)
SELECT conv_id, turn, action, CASE action WHEN 'search' THEN {d_strip("regexp_extract(x, '(?s)<search>(.*?)</search>', 1)")} WHEN 'answer' THEN {d_strip("regexp_extract(x, '(?s)<answer>(.*?)</answer>', 1)")} ELSE '' END AS content FROM p""")
def parse_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.assistant_text(F.col("transcript"), "<|im_start|>assistant", "<|im_end|>")
    return transcripts(spark, sf_dir).select("conv_id", "turn", T.action_of(x).alias("action"), T.action_content(x).alias("content"))


@register("clean_answers", f"""WITH {T_SQL} SELECT conv_id, turn, array_to_string(CASE WHEN lower({d_strip("text")}) = lower({d_strip("split_part(text, ' ', 1)")}) THEN [{d_strip("text")}] ELSE [{d_strip("text")}, {d_strip("split_part(text, ' ', 1)")}] END, '|') AS answers FROM t""")
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.concat(F.lit(" "), "text"), F.lit(""), F.split_part("text", F.lit(" "), F.lit(1)), F.lit("  "), F.lower("text"))
    return transcripts(spark, sf_dir).select("conv_id", "turn", F.array_join(T.clean_answers(raw), "|").alias("answers"))


def d_fold(x: str) -> str:
    """What ``fold`` gives for Latin letters: an accent becomes a character of its
    own, which is no letter (DuckDB)."""
    apart = f"list_aggregate(list_transform(string_split(lower({x}), ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || ' ' ELSE replace(c, 'ß', 'ss') END), 'string_agg', '')"
    return f"trim(regexp_replace({apart}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@register("normalize_text", f"SELECT doc_id, {d_fold('text')} AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other scripts than Latin ones are tested against Python."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@register("cover_em", f"""WITH {T_SQL}, x AS (SELECT conv_id, turn, {d_fold('prediction')} AS p, list_filter(list_transform(golds, lambda g: {d_fold('g')}), lambda g: g <> '') AS gs FROM t)
SELECT conv_id, turn, CASE WHEN p <> '' AND len(list_filter(gs, lambda g: contains(' ' || p || ' ', ' ' || g || ' ') OR contains(' ' || g || ' ', ' ' || p || ' '))) > 0 THEN 1 ELSE 0 END AS cover_em FROM x""")
def cover_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select("conv_id", "turn", S.cover_em("prediction", "golds").alias("cover_em"))


@register("em_replay", f"WITH {T_SQL} SELECT conv_id, turn, CASE WHEN coalesce({d_strip('answer')}, '') = '' THEN 0 ELSE {_EM.replace('prediction', 'answer')} END AS em FROM (SELECT *, CASE WHEN turn % 4 = 3 THEN '  ' WHEN turn % 4 = 2 THEN NULL ELSE prediction END AS answer FROM t)")
def em_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank and null answers score 0, whatever gold answers normalise to."""
    answer = F.when(F.col("turn") % 4 == 3, "  ").when(F.col("turn") % 4 != 2, F.col("prediction"))
    blank = F.coalesce(T.strip(answer), F.lit("")) == ""
    return transcripts(spark, sf_dir).select("conv_id", "turn", F.when(blank, 0).otherwise(S.em(answer, F.col("golds"))).alias("em"))


_NUMBERS = "'Total ' || conv_id || ',000 then ' || turn || '.5 . ' || CASE WHEN conv_id % 2 = 0 THEN '#### ' || conv_id || ',' || turn ELSE '' END"


@register("score_gsm8k", rf"""WITH x AS (SELECT conv_id, turn, {_NUMBERS} AS s FROM conversations), y AS (SELECT *, regexp_extract(s, '#### (-?[0-9.,]+)', 1) AS g, list_filter(regexp_extract_all(s, '-?[0-9.,]+'), lambda v: v NOT IN ('', '.')) AS n FROM x)
SELECT conv_id, turn, CASE WHEN g = '' THEN 0.0::DOUBLE WHEN replace(g, ',', '') = conv_id || '' || turn THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS strict, CASE WHEN n[-1] = turn || '.5' THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS flexible FROM y""")
def score_gsm8k(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_NUMBERS} AS s")
    return x.select("conv_id", "turn", S.score_gsm8k(F.col("s"), F.concat(F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("strict"), S.score_gsm8k(F.col("s"), F.concat(F.col("turn").cast("string"), F.lit(".5")), False, 0.25).alias("flexible"))


@register("score_multiply", """SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 0.0::DOUBLE WHEN conv_id % 4 = 3 THEN 0.0::DOUBLE WHEN conv_id % 4 = 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM conversations""")
def score_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = "CASE conv_id % 4 WHEN 0 THEN '<answer>' || conv_id || '</answer>' WHEN 1 THEN 'Assistant: <answer>7</answer> <answer> ' || conv_id * turn || ' </answer>' WHEN 2 THEN 'Assistant: <answer>' || (conv_id * turn + 1) || '</answer>' ELSE 'Assistant: <answer>many</answer>' END"
    x = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{s} AS s", "conv_id * turn AS truth")
    return x.select("conv_id", "turn", S.score_multiply(F.col("s"), F.col("truth")).cast("double").alias("score"))


@register("score_math", r"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 0.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM orders""")
def score_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxed answers that are equal in other spelling, wrong, or not boxed."""
    s = r"CASE o_orderkey % 5 WHEN 0 THEN 'so $\\boxed{\\dfrac{' || o_custkey || '}{7}}$' WHEN 1 THEN '\\boxed{x=\\frac{' || o_custkey || '}7} ok' WHEN 2 THEN 'a \\boxed{1} then \\fbox{2} \\boxed{' || o_custkey || '/7}' WHEN 3 THEN '\\boxed{\\frac{' || (o_custkey + 1) || '}{7}}' ELSE 'none' END"
    s = s.replace(r"x=\\frac{' || o_custkey || '}7}", r"x=\\frac{' || o_custkey || '}{7}}")
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{s} AS s", r"'\\frac{' || o_custkey || '}{7}' AS truth").select("o_orderkey", S.score_math("s", "truth").alias("score"))


@register("score_countdown", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 4 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM orders""")
def score_countdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = "CASE o_orderkey % 5 WHEN 0 THEN 'Assistant: <answer>(' || o_custkey || ' + 3) * 2</answer>' WHEN 1 THEN 'Assistant: <answer>' || o_custkey || ' + 3</answer>' WHEN 2 THEN 'Assistant: <answer>' || o_custkey || ' - 3 - 2</answer>' WHEN 3 THEN 'Assistant: <answer>' || o_custkey || ' / (3 - 3) + 2</answer>' ELSE '<answer>1</answer>' END"
    x = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{s} AS s", "CAST((o_custkey + 3) * 2 AS DOUBLE) AS target", "array(CAST(o_custkey AS BIGINT), 3L, 2L) AS numbers")
    return x.select("o_orderkey", S.score_countdown("s", "target", "numbers").alias("score"))


@register("split_title_text", f"""SELECT doc_id, source || ' ' || doc_id AS title, substr(c, instr(c, chr(10)) + 1) AS body FROM (SELECT *, {CONTENTS} AS c FROM documents)""")
def split_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("doc_id", T.title_of(F.col("contents")).alias("title"), T.text_of(F.col("contents")).alias("body"))


@register("title_format_roundtrip", """SELECT doc_id, source AS title, text AS body FROM documents""")
def title_format_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "documents").select("doc_id", T.title_format(F.col("source"), F.col("text")).alias("s"))
    title, body = T.from_title_format(F.col("s"))
    return shown.select("doc_id", title.alias("title"), body.alias("body"))


@register("passages_to_string", """SELECT doc_id // 4 AS bundle, string_agg('Doc ' || n || '(Title: ' || source || ' ' || doc_id || ') ' || text || chr(10), '' ORDER BY n) AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS n FROM documents) GROUP BY 1""")
def passages_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = passages(spark, sf_dir).groupBy(F.expr("doc_id div 4").alias("bundle")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "contents"))).alias("x"))
    return grouped.select("bundle", T.passages_to_string(F.col("x.contents")).alias("shown"))


@register("parse_snippet", r"""SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, '. '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: len(string_split_regex(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')) > 5)) AS INTEGER) AS parts FROM documents""")
def parse_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.snippet_parts(F.replace("text", F.lit(". "), F.lit("...")))).alias("parts"))


@register("collect_context", """SELECT doc_id, array_to_string(list_distinct_in_order, chr(10)) AS context FROM (
SELECT doc_id, list(p ORDER BY i) AS list_distinct_in_order FROM (SELECT doc_id, p, min(i) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i, text FROM documents) WHERE contains(p, split_part(text, ' ', 2)) OR contains(p, 'und') GROUP BY doc_id, p) GROUP BY doc_id)
UNION ALL SELECT doc_id, '' FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda p: contains(p, split_part(text, ' ', 2)) OR contains(p, 'und'))) = 0""")
def collect_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.collect_context(F.col("text"), F.array(F.split_part("text", F.lit(" "), F.lit(2)), F.lit("und"))).alias("context"))


@register("html_paragraphs", r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x: replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')), chr(10)) AS body FROM pages""")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.html_paragraphs(F.col("html")), "\n").alias("body"))


@register("page_texts")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and text of each page's paragraphs, by the tokenizer; tested against the
    standard library's parser."""
    found = table(spark, sf_dir, "pages").select("page_id", H.paragraph_texts(F.col("html")).alias("p"))
    return found.select("page_id", F.size("p").alias("paragraphs"), F.array_join("p", "\n").alias("body"))


@register("filter_links", r"""SELECT page_id, url FROM (SELECT *, lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '(\.[^./]*)$', 1)) AS e FROM pages) WHERE e IN ('', '.html', '.htm', '.shtml')""")
def filter_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    return table(spark, sf_dir, "pages").where(F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin("", ".html", ".htm", ".shtml")).select("page_id", "url")


@register("online_contexts", """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE '"' || CASE WHEN page_id % 4 = 1 THEN 'No title.' ELSE url END || '"' || chr(10) || CASE WHEN page_id % 4 = 2 THEN 'No snippet available.' ELSE 'page ' || page_id END END AS context FROM pages""")
def online_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    title = F.when(k.isin(1, 3), " ").otherwise(F.col("url"))
    snippet = F.when(~k.isin(2, 3), F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", T.online_context(title, snippet).alias("context"))


@register("sample_id", """SELECT doc_id, CASE WHEN doc_id % 9 <> 4 THEN source || ':' || lang || ':' || doc_id END AS sample_id FROM documents""")
def sample_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("doc_id") % 9 == 4, F.concat("source", F.lit(" x"))).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", T.sample_id(source, F.col("lang"), F.col("doc_id")).alias("sample_id"))


@register("record_id", """SELECT doc_id, 'trace:' || substr(sha256('{"index":' || doc_id || ',"source":"' || source || '"}'), 1, 24) AS record_id FROM documents""")
def record_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = F.to_json(F.struct(F.col("doc_id").alias("index"), "source"), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "documents").select("doc_id", T.record_id(identity).alias("record_id"))


@register("content_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@register("render_prompt", """SELECT item_id, 'Think inside think tags, search inside search tags, and answer inside answer tags.' || chr(10) || 'Question: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || '?' AS prompt FROM benchmark""".replace("\\\\", "\\"))
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "Think inside think tags, search inside search tags, and answer inside answer tags.\nQuestion: "
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit(head), T.clean_question(F.col("text"))).alias("prompt"))


@register("phrase_join", f"""WITH b AS (SELECT item_id, {d_phrase("text")} AS p FROM benchmark), d AS (SELECT doc_id, {d_phrase("text")} AS p FROM documents)
SELECT item_id, doc_id FROM b JOIN d ON contains(' ' || d.p || ' ', ' ' || b.p || ' ') WHERE b.p <> ''""")
def phrase_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items contained in documents.  Candidates share the hash of an item's
    first words, so documents and items meet in an equi-join; the containment is
    tested on those only."""
    width = 4
    items = table(spark, sf_dir, "benchmark").select("item_id", T.phrase_tokens(F.col("text")).alias("q")).where(F.size("q") > 0)
    items = items.select("item_id", F.array_join("q", " ").alias("needle"), F.least(F.size("q"), F.lit(width)).alias("n"), F.xxhash64(F.array_join(F.slice("q", 1, width), " ")).alias("k"))
    lengths = [r.n for r in items.select("n").distinct().collect()]  # at most ``width`` values
    docs = table(spark, sf_dir, "documents").select("doc_id", T.phrase_tokens(F.col("text")).alias("w"))
    keys = None
    for n in lengths:
        part = docs.select("doc_id", F.explode(F.array_distinct(_grams(n))).alias("k"), F.lit(n).alias("n"))
        keys = part if keys is None else keys.unionByName(part)
    if keys is None:
        return items.select("item_id", F.lit(0).cast("bigint").alias("doc_id")).where("false")
    pairs = keys.join(items, ["k", "n"]).select("item_id", "needle", "doc_id")
    full = docs.select("doc_id", F.array_join("w", " ").alias("hay"))
    return pairs.join(full, "doc_id").where(T.contains_phrase(F.col("hay"), F.col("needle"))).select("item_id", "doc_id")


def _grams(n: int):
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))
