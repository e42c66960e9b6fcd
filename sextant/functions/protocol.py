"""Grammar of native tool calls, in steps of expressions, and of transcripts (plain
Python, run on Arrow batches)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from sextant.functions.text import SPACES, strip

#: Fixed values of the protocol: markers that may not be nested, and the keys that
#: make JSON look like a tool call.
MARKERS = (
    "<tool_call", "</tool_call>", "<function=", "</function>", "<parameter=", "</parameter>", "<tool_response", "</tool_response>", "<search", "</search>",
    "<answer", "</answer>", "<information", "</information>", "<think", "</think>", "<|im_start|>", "<|im_end|>",
)
JSON_KEYS = ("name", "function", "tool", "tool_calls", "arguments", "query")
#: Names of functions and parameters.
NAME = "[A-Za-z_][A-Za-z0-9_.-]*"
_MARKED = "|".join(map(re.escape, MARKERS))
_JSON_KEY = '"(?:' + "|".join(JSON_KEYS) + ')"' + SPACES + "*:"


def _times(c: Column, tag: str) -> Column:
    return F.regexp_count(c, F.lit(tag))


def _marked(c: Column) -> Column:
    return F.rlike(c, F.lit(_MARKED))


def _has(c: Column, tag: str) -> Column:
    return F.contains(c, F.lit(tag))


class _Parts:
    """Columns of a frame that hold parts of what is worked out, by name."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.name, self.own = name, [F.col(f"`{c}`") for c in df.columns]

    def __getitem__(self, part: str) -> Column:
        return F.col(f"`__{self.name}_{part}`")

    def step(self, df: DataFrame, **parts: Column) -> DataFrame:
        """A select of its own for ``parts``.  Columns, since the optimiser would put
        the fields of a struct back where they are used."""
        return df.select(*self.own, *(c.alias(f"__{self.name}_{k}") for k, c in parts.items()))


def boundaries(df: DataFrame, text: Column, continued: bool = True, name: str = "boundary") -> DataFrame:
    """``df`` with a struct of where each response's action is: ``reasoning``, the
    ``tail`` behind it, its ``body`` up to the first closer, and the ``closer``
    (tool_call, answer or null); null as a whole if the reasoning is not one
    well-formed block.  If ``continued``, the prompt has opened the reasoning already."""
    at = _Parts(df, name)
    opening = "" if continued else SPACES + "*<think>"
    whole, upto = f"(?s)^{opening}(.*?)</think>(.*)$", "(?s)^(.*?</(tool_call|answer)>)"
    d = at.step(df, text=text)
    d = at.step(d, begun=F.rlike(at["text"], F.lit(whole)), reasoning=F.regexp_extract(at["text"], whole, 1), tail=F.regexp_extract(at["text"], whole, 2))
    d = at.step(d, begun=at["begun"], reasoning=at["reasoning"], tail=at["tail"], closer=F.nullif(F.regexp_extract(at["tail"], upto, 2), F.lit("")), upto=F.regexp_extract(at["tail"], upto, 1))
    d = at.step(d, begun=at["begun"], reasoning=at["reasoning"], tail=at["tail"], closer=at["closer"], body=F.when(at["closer"].isNull(), at["tail"]).otherwise(at["upto"]))
    formed = at["begun"] & ~_has(F.concat(at["reasoning"], at["body"]), "<think") & ~_has(at["body"], "</think>")
    found = F.struct(strip(at["reasoning"]).alias("reasoning"), at["tail"].alias("tail"), strip(at["body"]).alias("body"), at["closer"].alias("closer"))
    return d.select(*at.own, F.when(formed, found).alias(name))


def _json_call(body: Column) -> Column:
    """An object with one of the keys; or, if it is no JSON, what looks like it."""
    keys = F.json_object_keys(body)
    there = F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, JSON_KEYS))), F.lit(False))
    return F.startswith(body, F.lit("{")) & F.when(F.try_parse_json(body).isNotNull(), there).otherwise(F.rlike(body, F.lit(_JSON_KEY)))


#: Tags that an action of each kind has once each.
_REPLY_TAGS = ("<answer>", "</answer>")
_CALL_TAGS = ("<tool_call>", "</tool_call>", "<function=", "</function>", "<parameter=", "</parameter>")


def _once(c: Column, tags: tuple[str, ...]) -> Column:
    found = F.regexp_extract_all(c, F.lit("|".join(tags)), F.lit(0))
    return F.array_join(F.array_sort(found), "") == "".join(sorted(tags))


def native_actions(df: DataFrame, text: Column, continued: bool = True, answer_only: bool = False, name: str = "parsed") -> DataFrame:
    """``df`` with a struct of action, content and error of each response: the first
    rule that is broken names the error.  With ``answer_only``, after the last search,
    a search is an error and an answer must stand alone.

    Parts that many rules ask for are columns of a select of their own, which the
    optimiser leaves apart as they are used more than once: each expression is evaluated
    once, and the plan compiles."""
    s = SPACES + "*"
    call = f"(?s)^(.*?)<tool_call>{s}<function=({NAME})>{s}<parameter=({NAME})>(.*?)</parameter>{s}</function>{s}</tool_call>$"
    at = _Parts(df, name)
    d = boundaries(at.step(df, text=F.coalesce(text, F.lit(""))), at["text"], continued, f"__{name}_found")
    found = at["found"]
    kept = {"blank": strip(at["text"]) == "", "lost": found.isNull(), "tail": found["tail"], "body": found["body"], "open": found["closer"].isNull(), "answers": F.coalesce(found["closer"] == "answer", F.lit(False))}
    d = at.step(d, **kept)
    # A body that closes an answer ends there, so that two cuts split it.
    parts = {
        "single": F.when(at["answers"], _once(at["body"], _REPLY_TAGS)).otherwise(_once(at["body"], _CALL_TAGS)), "tool": F.regexp_extract(at["body"], call, 2), "key": F.regexp_extract(at["body"], call, 3),
        "before": F.when(at["answers"], F.substring_index(at["body"], "<answer>", 1)).otherwise(F.regexp_extract(at["body"], call, 1)),
        "content": strip(F.when(at["answers"], F.substring_index(F.substring_index(at["body"], "<answer>", -1), "</answer>", 1)).otherwise(F.regexp_extract(at["body"], call, 4))),
        "marked": at["open"] & _marked(at["body"]), "json": at["open"] & _json_call(at["body"]), "answer_tag": at["open"] & (_has(at["body"], "<answer") | _has(at["body"], "</answer>")),
    }
    d = at.step(d, **{k: at[k] for k in kept}, **parts)
    answers, calls = at["answers"], ~at["answers"]
    d = at.step(d, **{k: at[k] for k in [*kept, *parts]}, odd_before=_marked(at["before"]), odd_content=_marked(at["content"]))
    rules = [
        (at["blank"], "empty_response"),
        (at["lost"], "invalid_thinking_prefix"),
        (at["body"] == "", "missing_native_action"),
        (at["answer_tag"], "multiple_or_unbalanced_answers"),
        (at["marked"], "multiple_or_unbalanced_tool_calls"),
        (at["json"], "json_tool_call_not_supported"),
        (at["open"], "missing_native_action"),
        (~at["single"], F.when(answers, "multiple_or_unbalanced_answers").otherwise("multiple_or_unbalanced_tool_calls")),
        (calls & (at["tool"] == ""), "malformed_tool_call"),
        (calls & (at["tool"] != "search"), "unknown_tool"),
        (calls & (at["key"] != "query"), "invalid_search_parameter"),
        (answers & at["odd_before"], "invalid_action_prefix"),
        (at["content"] == "", F.when(answers, "empty_answer").otherwise("empty_search_query")),
        (at["odd_content"], "nested_protocol_marker"),
        (at["odd_before"], "invalid_action_prefix"),
    ]
    d = at.step(d, tail=at["tail"], answers=answers, content=at["content"], broken=F.coalesce(*(F.when(rule, code) for rule, code in rules)))
    action = F.when(at["broken"].isNull(), F.when(answers, "answer").otherwise("search"))
    late = F.lit(None).cast("string")
    if answer_only:
        alone = (_times(at["tail"], "<answer>") == 1) & (_times(at["tail"], "</answer>") == 1) & F.rlike(at["tail"], F.lit(f"(?s)^{s}<answer>.*</answer>{s}$"))
        late = F.when(action == "search", "search_disallowed_after_budget").when((action == "answer") & ~alone, "invalid_terminal_answer_format")
    out = F.struct(action.alias("action"), F.when(action.isNotNull(), at["content"]).otherwise("").alias("content"), F.coalesce(at["broken"], late).alias("error"))
    return d.select(*at.own, out.alias(name))


BLOCK = re.compile(r"(?s)<(think|search|answer|information)>(.*?)</\1>")


def transcript_turns(text: str) -> list[dict]:
    """Turns of a transcript, in order.  A think begins a turn; a search or an
    answer is its action; information belongs to the search before it.  What
    fits nowhere is kept as invalid text of the turn it is in."""
    turns: list[dict] = []

    def new() -> dict:
        turns.append({"turn": len(turns), "think": None, "action": None, "content": None, "observation": None, "invalid_text": [], "valid": False})
        return turns[-1]

    open_turn: dict | None = None
    at = 0
    for m in [*BLOCK.finditer(text), None]:
        loose = text[at : m.start() if m else len(text)].strip()
        if loose:
            open_turn = open_turn or new()
            open_turn["invalid_text"].append(loose)
        if m is None:
            break
        tag, content, at = m[1], m[2].strip(), m.end()
        if tag == "think":
            open_turn = new()
            open_turn["think"] = content
        elif tag == "information":
            if not open_turn or open_turn["action"] != "search" or open_turn["observation"] is not None:
                open_turn = new()
                open_turn["action"] = "invalid"
            open_turn["observation"] = content
        else:
            if not open_turn or open_turn["action"] is not None:
                open_turn = new()
            open_turn.update(action=tag, content=content, valid=True)
    for t in turns:
        t["action"] = t["action"] or "invalid"
    return turns


TURN_TYPE = ArrayType(StructType([
    StructField("turn", IntegerType()), StructField("think", StringType()), StructField("action", StringType()), StructField("content", StringType()),
    StructField("observation", StringType()), StructField("invalid_text", ArrayType(StringType())), StructField("valid", BooleanType()),
]))


@F.pandas_udf(TURN_TYPE)
def turns_of(s: pd.Series) -> pd.Series:
    return s.map(lambda x: transcript_turns(x or ""))
