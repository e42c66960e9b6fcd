"""Answer scores and rewards, as Column functions (pandas where braces or
arithmetic have to be read)."""

from __future__ import annotations

import ast
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from sextant.functions.text import extract_answer, fold, normalize_answer, retrieval_correct, strip, tag_problem


def em(prediction: Column, golds: Column) -> Column:
    """1 if a gold answer equals the prediction, both normalised."""
    p = normalize_answer(prediction)
    return F.coalesce(F.exists(golds, lambda g: normalize_answer(g) == p), F.lit(False)).cast("int")


def sub_em(prediction: Column, golds: Column) -> Column:
    """1 if a gold answer is part of the prediction.  A gold answer of nothing
    but articles is part of everything."""
    p = normalize_answer(prediction)
    return F.coalesce(F.exists(golds, lambda g: F.contains(p, normalize_answer(g))), F.lit(False)).cast("int")


def score_em(solution: Column, golds: Column, format_score: float = 0.0, score: float = 1.0) -> Column:
    """0 without an answer, ``score`` for a match, else ``format_score``."""
    answer = extract_answer(solution)
    return F.when(answer.isNull(), 0.0).when(em(answer, golds) == 1, score).otherwise(format_score)


def score_em_format(solution: Column, golds: Column, structure: float = 0.2, final: float = 0.1, retrieval: float = 0.1, score: float = 1.0) -> Column:
    """The eight outcomes of answer, match, valid tags and retrieval."""
    answer, valid = extract_answer(solution), tag_problem(solution).isNull()
    partial = F.when(retrieval_correct(solution, golds), structure + retrieval).otherwise(structure)
    hit = em(answer, golds) == 1
    return F.when(answer.isNull(), F.when(valid, partial).otherwise(0.0)).when(hit & valid, score).when(hit, score - structure).when(valid, partial).otherwise(final)


def covers(prediction: str | None, golds: list[str] | None) -> int:
    """1 if one of prediction and a gold answer holds the other as a phrase."""
    p = fold(prediction) or ""
    pairs = [(p, g) for x in golds if (g := fold(x) or "")] if golds is not None and p else []
    return int(any(f" {a} " in f" {b} " or f" {b} " in f" {a} " for a, b in pairs))


@F.pandas_udf(IntegerType())
def cover_em(prediction: pd.Series, golds: pd.Series) -> pd.Series:
    return pd.Series([covers(p, g) for p, g in zip(prediction, golds, strict=True)], dtype="int32")


def gsm8k_answer(c: Column, strict: bool = True) -> Column:
    """The number after ####, or (not strict) the last number of the text."""
    if strict:
        found = F.regexp_extract(c, r"#### (-?[0-9.,]+)", 1)
        return F.when(found != "", F.replace(found, F.lit(","), F.lit("")))
    numbers = F.regexp_extract_all(c, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    good = F.filter(numbers, lambda x: ~x.isin("", "."))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at(numbers, F.lit(1)))


def score_gsm8k(c: Column, truth: Column, strict: bool = True, format_score: float = 0.0) -> Column:
    answer = gsm8k_answer(c, strict)
    return F.when(answer.isNull(), 0.0).when(answer == truth, 1.0).otherwise(format_score)


def score_multiply(c: Column, truth: Column, format_score: float = 0.1) -> Column:
    """The last answer after the first ``Assistant:``, as an integer."""
    rest = F.when(F.contains(c, F.lit("Assistant:")), F.substr(c, F.instr(c, "Assistant:") + len("Assistant:")))
    found = F.regexp_extract_all(rest, F.lit(r"<answer>(.*?)</answer>"), F.lit(1))
    number = F.try_to_number(F.regexp_extract(strip(F.try_element_at(found, F.lit(-1))), r"^[+-]?\d{1,18}$", 0), F.lit("S999999999999999999"))
    return F.when(number.isNull(), 0.0).when(number == truth, 1.0).otherwise(format_score)


# Mathematical answers.

def last_boxed(text: str) -> str | None:
    """Content of the last boxed expression, by matching braces."""
    if "\\boxed " in text:
        return text.rsplit("\\boxed ", 1)[1].split("$", 1)[0]
    at = max(text.rfind("\\boxed"), -1)
    at = at if at >= 0 else text.rfind("\\fbox")
    if at < 0:
        return None
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return text[text.index("{", at) + 1 : m.start()]
    return None


#: What is dropped or rewritten before answers are compared.
_REWRITES = (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))
_AFTER_UNITS = (("\\%", ""), (" .", " 0."), ("{.", "{0."))


def canonical_math(text: str) -> str:
    """One spelling for answers that are written differently."""
    for old, new in _REWRITES:
        text = text.replace(old, new)
    text = text.split("\\text{ ", 1)[0]
    for old, new in _AFTER_UNITS:
        text = text.replace(old, new)
    if text.startswith("."):
        text = "0" + text
    sides = text.split("=")
    if len(sides) == 2 and len(sides[0]) <= 2:
        text = sides[1]
    text = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", text).replace(" ", "")
    text = re.sub(r"\\frac([^{])([^{])", r"\\frac{\1}{\2}", text)
    text = re.sub(r"\\frac([^{])\{", r"\\frac{\1}{", text)
    if text == "0.5":
        return "\\frac{1}{2}"
    m = re.fullmatch(r"(0|-?[1-9]\d*)/(0|-?[1-9]\d*)", text)
    return f"\\frac{{{m[1]}}}{{{m[2]}}}" if m else text


def math_score(solution: str | None, truth: str | None) -> float:
    if solution is None or truth is None or (found := last_boxed(solution)) is None:
        return 0.0
    return float(canonical_math(found) == canonical_math(truth))


@F.pandas_udf(DoubleType())
def score_math(solution: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([math_score(s, t) for s, t in zip(solution, truth, strict=True)], dtype="float64")


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.UAdd: operator.pos, ast.USub: operator.neg}


def arithmetic(text: str) -> float | None:
    """Value of an expression of numbers, + - * / // and parentheses."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        raise ValueError("not arithmetic")

    try:
        return value(ast.parse(text.strip(), mode="eval").body)
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def countdown_score(solution: str | None, target: float, numbers: list[int], format_score: float = 0.1) -> float:
    """1 for an expression that uses each number once and makes the target."""
    for mark in ("Assistant:", "<|im_start|>assistant"):
        if solution is not None and mark in solution:
            found = re.findall(r"<answer>(.*?)</answer>", solution.split(mark, 1)[1].split("\n")[-1])
            break
    else:
        return 0.0
    if not found:
        return 0.0
    if sorted(map(int, re.findall(r"\d+", found[-1]))) != sorted(numbers):
        return format_score
    result = arithmetic(found[-1])
    return 1.0 if result is not None and abs(result - target) < 1e-5 else format_score


@F.pandas_udf(DoubleType())
def score_countdown(solution: pd.Series, target: pd.Series, numbers: pd.Series) -> pd.Series:
    return pd.Series([countdown_score(s, t, list(n)) for s, t, n in zip(solution, target, numbers, strict=True)], dtype="float64")


# Rewards.

def utility(score: Column, searches: Column, lam: float, most: int) -> Column:
    """Score less the cost of the searches."""
    return score - lam * searches / float(most)


def cost_aware_reward(score: Column, searches: Column, lam: float, most: int, mode: str = "linear") -> Column:
    """linear: score - cost; correct_only: score * (1 - cost)."""
    if mode not in ("linear", "correct_only") or not 0 <= lam <= 1 or most < 1:
        raise ValueError("a cost-aware reward needs a known mode, 0 <= lambda <= 1 and a budget")
    cost = lam * searches / float(most)
    return score - cost if mode == "linear" else score * (1 - cost)


def reward_to_token(reward: Column, length: Column) -> Column:
    """The reward on the last token, zeros before."""
    return F.transform(F.sequence(F.lit(1), length), lambda i: F.when(i == length, reward).otherwise(0.0))
