"""Operators 11, 12 and 13 against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from sextant.llm import filter_audit, rolling

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, mask int, digest string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 0, 7, "clash") for r in rows], SCHEMA)


# 13 filter audit
def brute_audit(rows, labels):
    texts = {}
    for i, t, _, _ in rows:
        if i is not None:
            texts[t or ""] = min(texts.get(t or "", i), i)
    good, toxic = Counter(), Counter()
    for i, q, x in labels:
        good[i] |= q == 1
        toxic[i] |= x == 1
    parts = defaultdict(list)
    for i, t, _, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), i is not None and i > texts[t]), strict=True) if bad}
        parts[s or ""].append((fails, good.get(i, 0) if i is not None else 0, toxic.get(i, 0) if i is not None else 0))
    out = {}
    for part, members in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                here = [m for m in members if f in m[0] and not m[0] & before]
                shapley[f] += len(here)
                out[part, "".join(order), step + 1] = [
                    sum(not m[0] & (before | {f}) for m in members), len(here), sum(f in m[0] and bool(m[0] & before) for m in members), sum(m[0] == {f} for m in members), sum(m[1] for m in here), sum(m[2] for m in here)
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_filter_audit(llm_spark):
    many = " ".join(f"w{i}" for i in range(60))
    rows = [(0, many, "en", "a"), (1, many, "en", "b"), (1, many, "en", "a"), (2, many + " $", "en", None), (3, None, None, ""), (4, "", "en", "a"), (None, many, "en", "a"), (None, "", None, None)]
    rows += [(5, "X " * 80, "en", "b"), (6, "few words É", "en", "b"), (6, "other words", "en", "a"), (7, "AB cd\x0b" * 400_000, "en", "a"), (8, many.upper(), "en", "b"), (-1, "few words É", "en", "c"), (9, "é" * 19 + "A", "x", "c"), (10, "é" * 18 + "A", "x", "c")]
    rows += [(20 + i, many, "en", "a") for i in range(40)]
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (6, None, 1), (25, 1, 1), (None, 1, 1), (99, 1, 1)]
    labelled = llm_spark.createDataFrame([(*x, "clash") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in [*filter_audit.COUNTS, "shapley"]] for r in filter_audit.audit(docs_of(llm_spark, rows), labelled, F.col("source")).collect()}
    assert got == brute_audit(rows, labels)
    assert len(got) == 4 * 600


def test_filter_audit_of_nothing(llm_spark):
    labels = llm_spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs_of(llm_spark, []), labels, F.col("source")).collect() == []
    one = filter_audit.audit(docs_of(llm_spark, [(1, "x", "en", "s")]), labels, F.col("source")).collect()
    assert len(one) == 600 and sum(r["removed"] for r in one) == 120


# 12 rolling windows
def brute_windows(rows, widths=rolling.WINDOWS):
    timed = [(None if i is None else 60 * ((i + zlib.crc32(str(i).encode()) % 10_000) // 6), i, t, lang, s) for i, t, lang, s in rows]
    out = []
    for at, i, _, _, s in timed:
        for w in widths:
            held = [r for r in timed if at is not None and r[0] is not None and r[4] == s and at - w <= r[0] < at]
            lengths = sorted(len(r[2]) for r in held if r[2] is not None)
            m = len(lengths)
            ranks = [lengths[-(-m // 2) - 1], lengths[-(-90 * m // 100) - 1]] if m else [None, None]
            out.append((i, w, at, len(held), sum(lengths), len({r[3] for r in held} - {None}), *ranks))
    return out


def windows_of(spark, rows):
    docs = docs_of(spark, rows)
    timed = docs.select("doc_id", "source", "lang", F.char_length("text").cast("bigint").alias("length"), "digest")
    found = rolling.rolling_features(timed, rolling.event_minute(F.col("doc_id")))
    return [tuple(r) for r in found.select("doc_id", "window_s", (F.col("minute") * 60).alias("event_s"), "n_events", "sum_chars", "n_langs", "median_chars", "high_chars").collect()]


def in_order(rows):
    return sorted(rows, key=str)


def test_rolling_windows(llm_spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        text = None if rng.random() < 0.1 else "é" * rng.choice([0, 1, 5, 5, 40, rng.randint(0, 300)])
        rows.append((rng.randint(-3000, 30_000) if i % 3 else rng.randint(0, 60), text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", None, "", "b"])))
    rows += [(77, "x" * 2_000_000, "en", "a"), (None, "no id", "en", "a"), (None, None, None, None), (78, None, None, "lone")] + [(100, "same", "en", "a")] * 50
    assert in_order(windows_of(llm_spark, rows)) == in_order(brute_windows(rows))


def test_rolling_windows_of_nothing(llm_spark):
    assert windows_of(llm_spark, []) == []
    assert [r[2:] for r in windows_of(llm_spark, [((1 << 63) - 2, "x", "en", "a")])] == [(None, 0, 0, 0, None, None)] * 2


def test_windows_meet_across_blocks(llm_spark):
    """Rows on both sides of a block's edge, in every minute around it."""
    ids = [i for i in range(20_000) if abs((i + zlib.crc32(str(i).encode()) % 10_000) // 6 - 720) <= 12 or (i + zlib.crc32(str(i).encode()) % 10_000) // 6 in (0, 719, 720, 1439, 1440)]
    rows = [(i, "x" * (i % 50), "en", "a") for i in ids]
    assert in_order(windows_of(llm_spark, rows)) == in_order(brute_windows(rows))
