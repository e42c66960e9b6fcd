"""Text normalisers, tag and document shaping, as Column functions.

White space here is Unicode white space, as ``str.strip`` has it: Spark's trim
takes spaces only.  There are several normalisers on purpose: they differ in
what they keep, and results depend on it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: ASCII punctuation, articles, words that are no usable answer,
#: and queries that ask for nothing.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"\b(a|an|the)\b"
USELESS = ("yes", "no", "true", "false", "unknown")
DEGENERATE = ("", "query", "and")
TAGS = ("think", "search", "information", "answer")
WORDS = r"[\p{L}\p{N}]+"
#: A character of white space, for patterns without the Unicode flag.
SPACES = r"[\s\x85\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_answer(c: Column) -> Column:
    """Lower case; punctuation goes; articles go; white space collapses.  The
    order matters: U.S.A. becomes usa."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(c), PUNCTUATION, ""), ARTICLES, " "))


def fold(text: str | None) -> str | None:
    """NFKD, case folding, everything but letters and digits to one space."""
    if text is None:
        return None
    decomposed = unicodedata.normalize("NFKD", text).casefold()
    return " ".join("".join(ch if ch.isalnum() else " " for ch in decomposed).split())


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


def normalize_text(c: Column) -> Column:
    """As ``fold``; texts in ASCII do not leave the JVM."""
    ascii_only = F.trim(F.regexp_replace(F.lower(c), r"[^0-9a-z]+", " "))
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), ascii_only).otherwise(_fold(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)))


def phrase_tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case; accents stay."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0))


def normalize_phrase(c: Column) -> Column:
    return F.array_join(phrase_tokens(c), " ")


def question_key(c: Column) -> Column:
    """Collapsed lower case without one question mark at the end."""
    return strip(F.regexp_replace(F.lower(collapse(c)), r"\?$", ""))


def clean_question(c: Column, mark: bool = True) -> Column:
    """Collapsed; with ``mark`` it ends with a question mark."""
    base = collapse(c)
    return F.when(base.endswith("?"), base).otherwise(F.concat(base, F.lit("?"))) if mark else base


def clean_answers(answers: Column) -> Column:
    """Stripped, without blanks, the first of each folded spelling."""
    kept = F.filter(F.transform(answers, lambda x: strip(x)), lambda x: F.length(x) > 0)
    pairs = F.transform(kept, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))
    empty = F.lit(None).cast("array<struct<k:string,v:string>>")
    first = F.aggregate(pairs, F.coalesce(empty, F.array().cast("array<struct<k:string,v:string>>")), lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(first, lambda x: x["v"])


def usable_answers(answers: Column) -> Column:
    """Whether an answer says something: three characters and no yes or no."""
    return F.exists(F.transform(answers, lambda x: normalize_phrase(x)), lambda x: (F.length(x) >= 3) & ~x.isin(*USELESS))


def contains_phrase(hay: Column, needle: Column) -> Column:
    """Whether normalised ``needle`` occurs in ``hay`` at word boundaries."""
    return (F.length(needle) > 0) & F.contains(F.concat(F.lit(" "), hay, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def title_of(contents: Column) -> Column:
    """Title of a passage: its first line without the quotes around it."""
    return F.regexp_replace(F.substring_index(contents, "\n", 1), r'^"+|"+$', "")


def text_of(contents: Column) -> Column:
    """What follows the first line; empty if there is one line only."""
    at = F.instr(contents, "\n")
    return F.when(at > 0, F.substr(contents, at + 1)).otherwise("")


def passages_to_string(contents: Column) -> Column:
    """Doc 1(Title: ...) text, one line for each passage."""
    return F.array_join(F.transform(contents, lambda c, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), title_of(c), F.lit(") "), text_of(c), F.lit("\n"))), "")


def title_format(title: Column, text: Column) -> Column:
    return F.concat(F.lit("(Title: "), title, F.lit(") "), text)


def from_title_format(c: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^\(Title: ([^)]*)\) (.*)$"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)


ACTION = r"(?s)<(search|answer)>(.*?)</\1>"


def action_of(c: Column) -> Column:
    """search, answer or invalid: what the first complete block is."""
    found = F.regexp_extract(c, ACTION, 1)
    return F.when(found == "", "invalid").otherwise(found)


def action_content(c: Column) -> Column:
    return strip(F.regexp_extract(c, ACTION, 2))


def truncate_response(c: Column) -> Column:
    """Up to the first </search>, or else the first </answer>.  A search counts
    even if an answer ends before it."""
    up_to = lambda tag: F.concat(F.substring_index(c, tag, 1), F.lit(tag))
    return F.when(F.contains(c, F.lit("</search>")), up_to("</search>")).when(F.contains(c, F.lit("</answer>")), up_to("</answer>")).otherwise(c)


def extract_answer(c: Column) -> Column:
    """The last answer block, if there are two or more: the prompt holds one."""
    found = F.regexp_extract_all(c, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return F.when(F.size(found) >= 2, strip(F.element_at(found, -1)))


def information_blocks(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?s)<information>(.*?)</information>"), F.lit(1)), lambda x: strip(x))


def retrieval_correct(c: Column, golds: Column) -> Column:
    """Whether a normalised gold answer is part of an information block."""
    blocks = F.transform(information_blocks(c), lambda b: normalize_answer(b))
    wanted = F.transform(golds, lambda g: normalize_answer(g))
    return F.exists(blocks, lambda b: F.exists(wanted, lambda g: F.contains(b, g)))


def snippet_parts(c: Column) -> Column:
    """Parts between dots of omission that have more than five words."""
    return F.filter(F.transform(F.split(c, r"\.\.\."), lambda x: strip(x)), lambda x: F.size(F.split(collapse(x), " ")) > 5)


def sanitize_query(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"(?U)[^\w\s]", " "))


def collect_context(document: Column, snippets: Column) -> Column:
    """Distinct paragraphs that hold one of the snippets, in order."""
    kept = F.filter(F.split(document, "\n"), lambda p: F.exists(snippets, lambda s: F.contains(p, s)))
    return F.array_join(F.array_distinct(kept), "\n")


def html_paragraphs(c: Column) -> Column:
    """Text of the p elements, without tags, the usual entities resolved."""
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(F.regexp_replace(x, "<[^>]*>", ""), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)), plain)


def online_context(title: Column, snippet: Column) -> Column:
    """A result as passage; null where it has neither title nor snippet."""
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    shown = F.concat(F.lit('"'), F.when(blank(title), "No title.").otherwise(title), F.lit('"\n'), F.when(blank(snippet), "No snippet available.").otherwise(snippet))
    return F.when(~(blank(title) & blank(snippet)), shown)


def assistant_text(c: Column, marker: str, end: str) -> Column:
    """What follows the last ``marker``, up to ``end``."""
    return F.substring_index(F.substring_index(c, marker, -1), end, 1)


def question_from_prompt(c: Column) -> Column:
    """What follows the last ``Question:``, stripped."""
    return F.when(F.contains(c, F.lit("Question:")), strip(F.substring_index(c, "Question:", -1)))


def degenerate_query(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)), F.lit("")).isin(*DEGENERATE)


def sample_id(source: Column, split: Column, index: Column) -> Column:
    """source:split:index; null where a component has other characters."""
    ok = source.rlike(r"^[A-Za-z0-9_.-]+$") & split.rlike(r"^[A-Za-z0-9_.-]+$") & (index >= 0)
    return F.when(ok, F.concat_ws(":", source, split, index.cast("string")))


def record_id(identity: Column) -> Column:
    """trace: and 24 hex digits of the digest of an identity's canonical text."""
    return F.concat(F.lit("trace:"), F.substring(F.sha2(identity, 256), 1, 24))


def tag_problem(c: Column) -> Column:
    """Why a transcript's tags are not a valid sequence; null if they are.

    After the assistant marker: think, then any number of search, information,
    think, then answer; only white space between blocks.  The order of tags is
    checked as one pattern over one letter for each tag, texts between tags as
    patterns on the content."""
    marker = r"(?s)^.*?<\|im_start\|>assistant(?U:\s*)"
    content = F.regexp_replace(c, marker, "")
    counts = [F.regexp_count(content, F.lit(f"<{t}>")) != F.regexp_count(content, F.lit(f"</{t}>")) for t in TAGS]
    letters = F.concat(*(F.lit("") for _ in range(1)), F.array_join(F.transform(F.regexp_extract_all(content, F.lit(r"(</?(?:think|search|information|answer)>)"), F.lit(1)), lambda t: F.concat(F.when(F.startswith(t, F.lit("</")), "/").otherwise(""), F.substring(F.regexp_replace(t, "[</>]", ""), 1, 1))), ""))
    order = letters.rlike(r"^t/t(s/si/it/t)*a/a$")
    between = content.rlike(r"(?s)(</(?:think|search|information)>)(?U:\s*)[^\s<]") | content.rlike(r"(?s)^(?U:\s*)[^\s<]") | content.rlike(r"(?s)</answer>(?U:\s*)\S")
    problem = F.when(~c.rlike(marker), "missing marker")
    for tag, off in zip(TAGS, counts, strict=True):
        problem = problem.when(off, f"unbalanced {tag}")
    return problem.when(~order, "order of tags").when(between, "text between tags")
