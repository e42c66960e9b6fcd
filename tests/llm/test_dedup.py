"""Operators 5, 7 and 9 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import components, exchange, kernels, near_dedup, repeats, substring_dedup, suffix_dedup
from sextant.llm.base import written

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, batch string, salt int"


def corpus(seed=3, n=60):
    """Documents with copies, near copies, shared passages and odd rows; the last
    two columns clash with names that operators use."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(1, 260))) for _ in range(n)]
    passage = " ".join(word() for _ in range(70))
    texts = base + base[:6]
    for t in base[:20]:
        w = t.split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    for t in base[20:32]:
        w = t.split(" ")
        w.insert(rng.randrange(len(w) + 1), passage)
        texts.append(" ".join(w))
    texts += [None, "", "   ", "x", "x", "A b C d", "a B c d", "ab " * 900, "z" * 3000, "é" * 500, " ".join(word() for _ in range(3000))]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i, t, None, "s", 0, "b", 1) for i, t in zip(ids, texts)]


def test_sliding_and_hashes():
    x = np.random.default_rng(0).integers(0, 50, 300, dtype=np.uint64)
    for w in (1, 2, 7, 300):
        assert kernels.sliding(x, w, np.minimum).tolist() == [x[i : i + w].min() for i in range(301 - w)]
        assert kernels.sliding(x, w, np.maximum).tolist() == [x[i : i + w].max() for i in range(301 - w)]
    h = kernels.rolling(kernels.prefix(x % np.uint64(2)), 4)
    for i in range(297):
        for j in range(297):
            assert (h[i] == h[j]) == ((x[i : i + 4] % 2).tolist() == (x[j : j + 4] % 2).tolist())


def test_words():
    texts = [b"", b" ", b"a", b" a  b\tc\n", b"x\x0by\x0c", " é".encode()]
    words = kernels.Words(texts)
    assert words.counts().tolist() == [len(t.split()) for t in texts]
    flat = [w for t in texts for w in t.split()]
    assert len(words.hash) == len(flat)


def thue_morse(n, a="ab", b="ba"):
    """A string and the one with its symbols exchanged: sums over powers of one
    multiplier modulo 2^64 cannot tell them apart once they are long."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_long_words_differ():
    for n in (8, 16, 32, 64, 256, 512, 1024, 2048, 8192):
        for pair in (thue_morse(n), thue_morse(n, "x", "y")):
            h = kernels.Words([w.encode() for w in pair]).hash
            assert h[0] != h[1]
            for values in (np.frombuffer(w.encode(), np.uint8) for w in pair):
                assert len(values) == len(pair[0])
            for which in (0, 1):
                sums = [kernels.prefix(kernels.mixed_bytes(np.frombuffer(w.encode(), np.uint8)), which) for w in pair]
                if len(pair[0]) > 8:
                    assert sums[0][len(pair[0]) - 7] != sums[1][len(pair[0]) - 7]


def test_windows_of_exchanged_symbols_differ():
    for n, symbols in ((4096, "bytes"), (4096, "words")):
        first, second = thue_morse(n, "x", "y")
        if symbols == "words":
            first, second = (kernels.Words([" ".join(w).encode()]).hash for w in (first, second))
        else:
            first, second = (np.frombuffer(w.encode(), np.uint8) for w in (first, second))
        bounds = np.array([0, n])
        for width in (64, 400, 1024, 4096):
            a, b = (repeats.View(x, bounds, width, width // 2) for x in (first, second))
            at = np.arange(n - width + 1)
            whole = lambda x: {bytes(x[i : i + width].tobytes()) for i in at}
            assert len({*a.hashes(at).tolist(), *b.hashes(at).tolist()}) == len(whole(first) | whole(second))


def test_packed_hashes():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 1000):
        h = np.empty(n, kernels.WIDE)
        h["hi"], h["lo"] = rng.integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(rng.integers(0, 62)), rng.integers(0, 3, n)
        u, at, of, count = exchange.unique(np.concatenate([h, h[: n // 2]]))
        assert sorted(set(h.tolist())) == u.tolist() and count.sum() == n + n // 2
        assert (u[of] == np.concatenate([h, h[: n // 2]])).all() and (np.concatenate([h, h])[at] == u).all()
        assert (exchange.unpack(exchange.pack(u)) == u).all()


def test_anchors_are_even_over_buckets():
    """No bucket gets most anchors, which are the least of many hashes."""
    rng = np.random.default_rng(9)
    data = rng.integers(97, 123, 400_000).astype(np.uint8).tobytes()
    plan = suffix_dedup._Plan(suffix_dedup._view([data], 400, 200)[1], 64)
    share = np.diff(exchange.bounds(plan.anchors, 64)) / len(plan.anchors)
    assert len(plan.anchors) > 3000 and share.max() < 0.05


@pytest.mark.parametrize("sourced", [False, True])
def test_a_bucket_is_compared_in_ranges(sourced, monkeypatch):
    """As at once, and with little held beside the slices."""
    rng = np.random.default_rng(5)
    seen, compared = [], exchange._compared
    monkeypatch.setattr(exchange, "_compared", lambda h, p: (seen.append(len(h)), compared(h, p))[1])
    rows = []
    for batch in rng.permutation(40).tolist():
        hashes = np.zeros(int(rng.integers(1, 300)), exchange.WIDE)
        hashes["hi"], hashes["lo"] = rng.integers(0, 900, len(hashes)).astype(np.uint64) << np.uint64(40), rng.integers(0, 2, len(hashes))
        hashes = np.unique(hashes)
        place = np.zeros(len(hashes), exchange.PLACE)
        place["id"], place["at"] = rng.integers(0, 30, len(hashes)), rng.integers(0, 9, len(hashes))
        rows.append(("w", 3, batch, exchange.pack(hashes), place.tobytes() if sourced else None))
    group = exchange.pa.table([exchange.pa.array(c, f.type) for c, f in zip(zip(*rows), exchange._REQUEST)], schema=exchange._REQUEST)
    whole = exchange.answer(group).to_pylist()
    n = seen[-1]
    monkeypatch.setattr(exchange, "RANGE", 200)
    assert exchange.answer(group).to_pylist() == whole and len(whole) == 40
    assert sum(seen[1:]) == n and max(seen[1:]) < 400


def test_exchanged_words_are_no_repeats(llm_spark):
    """Texts of 49 common words and one of two long words that sums would confuse."""
    common = " ".join(f"w{i}" for i in range(49))
    for n in (512, 1024, 2048):
        pair = thue_morse(n)
        texts = [f"{common} {w}" for w in pair]
        docs = llm_spark.createDataFrame(list(enumerate([*texts, *pair])), "doc_id bigint, text string")
        assert [r["n_removed"] for r in substring_dedup.repeated_passages(docs).collect()] == [0] * 4
        near = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs.where("doc_id > 1")).collect()}
        assert near[3]["kept"] and near[3]["component_id"] == 3
        found = suffix_dedup.repeated_bytes(docs, words=50, count_only=True).collect()
        assert [r["passage_bytes"] for r in found] == [0] * 4
        for r in found:
            data = [x.encode() for x in [*texts, *pair]]
            seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
            own = data[r["doc_id"]]
            mask = np.zeros(len(own), bool)
            for i in range(len(own) - 399):
                if seen[own[i : i + 400]] > 1:
                    mask[i : i + 400] = True
            assert r["n_removed"] == mask.sum()


def removed(mask, symbols):
    kept = [s for s, m in zip(symbols, mask) if not m]
    runs = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
    return sum(mask), runs, kept


@pytest.mark.parametrize("width", [400, 40, 7])
def test_repeated_bytes(llm_spark, width):
    rows = corpus()
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(t[s : s + width] for _, t in data for s in range(len(t) - width + 1))
    want = {}
    for i, t in data:
        mask = [0] * len(t)
        for s in range(len(t) - width + 1):
            if count[t[s : s + width]] > 1:
                mask[s : s + width] = [1] * width
        n, runs, kept = removed(mask, t)
        want[i] = (len(t), n, runs, hashlib.sha256(bytes(kept)).hexdigest())
    got = suffix_dedup.repeated_bytes(llm_spark.createDataFrame(rows, SCHEMA).repartition(3), width=width, carry=["batch"], keep=True)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == want
    assert got.select("carry.batch").distinct().collect()[0][0] == "b"


@pytest.mark.parametrize("width", [50, 5, 1])
def test_repeated_passages(llm_spark, width):
    rows = corpus(4)
    data = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in data:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, i), i)
    want = {}
    for i, w in data:
        mask = [0] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < i:
                mask[s : s + width] = [1] * width
        n, _, kept = removed(mask, w)
        want[i] = (len(w), n, hashlib.sha256(b" ".join(kept)).hexdigest())
    got = substring_dedup.repeated_passages(llm_spark.createDataFrame(rows, SCHEMA), width=width, keep=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    texts = {i: w for i, w in data}
    for r in got:
        mask = [0] * r.n_words
        for a, b, source, at in r.spans:  # each factor is what its source has there
            assert b - a >= width and source < r.doc_id and texts[source][at : at + b - a] == texts[r.doc_id][a:b]
            mask[a:b] = [1] * (b - a)
        assert r.kept.split() == [x.decode() for x, m in zip(texts[r.doc_id], mask) if not m]


def test_factors_change_their_source(llm_spark):
    """A passage that goes on from one source into another is two factors that meet
    or overlap, each from its own place."""
    a, b, c = ([f"{x}{i}" for i in range(80)] for x in "abc")
    rows = [(1, [*c[:5], *a]), (2, [*b, *a[:3]]), (3, [*a[20:], *b[:60], "z"]), (4, [*a[20:], *b[:60], *c])]
    docs = llm_spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substring_dedup.repeated_passages(docs, keep=True).collect()}
    assert got[1] == got[2] == [] and got[3] == [(0, 60, 1, 25), (60, 120, 2, 0)]
    assert got[4] == [(0, 60, 1, 25), (11, 109, 3, 11), (60, 120, 2, 0)]


def test_repeats_between_equal_and_null_ids(llm_spark):
    text = " ".join(f"w{i}" for i in range(120))
    docs = llm_spark.createDataFrame([(5, text), (5, text), (None, text)], "doc_id bigint, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in substring_dedup.repeated_passages(docs).collect()) == [(False, 0), (False, 0), (True, 120)]
    assert all(r.n_removed == r.n_bytes for r in suffix_dedup.repeated_bytes(docs).collect())


def shingles(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute_components(sets, threshold=85):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates(llm_spark):
    rng = random.Random(9)
    rows = [r[:2] for r in corpus(5)]
    cloud = [f"c{rng.randrange(10**6)}" for _ in range(150)]  # near copies of one text, around the threshold
    for i in range(120):
        w = list(cloud)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    root = brute_components(sets)
    docs = llm_spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit("clash"))
    for tile, leaf in ((512, 4096), (16, 20)):
        got = near_dedup.near_duplicates(docs, tile=tile, leaf=leaf).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


def test_large_sets_without_bits():
    rng = np.random.default_rng(1)
    rows, cols = np.repeat(np.arange(6), 40), np.concatenate([np.sort(rng.choice(100, 40, False)) for _ in range(6)])
    a, b = near_dedup._Common(rows, cols, 6, 100), near_dedup._Common(rows, cols, 6, 100, most=0)
    assert b.bits is None
    for i in range(6):
        assert a.sizes(i, np.arange(6)).tolist() == b.sizes(i, np.arange(6)).tolist()


def test_components(llm_spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 400 + i) for i in range(50)]
    got = {r.id: r.root for r in components.components(llm_spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert got == {x: find(x) for x in up if find(x) != x}


@pytest.mark.parametrize("f", [suffix_dedup.repeated_bytes, substring_dedup.repeated_passages, near_dedup.near_duplicates])
def test_empty_tables(llm_spark, f):
    assert f(llm_spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_and_repeated_ids(llm_spark):
    """Each row is judged by its own text; of equal rows one is kept."""
    long = [f"w{i}" for i in range(60)]
    near, text = " ".join([*long[:30], "other", *long[31:]]), " ".join(long)
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, None), (7, text), (7, near), (9, near), (None, near), (None, "alone in this table"), (None, "alone in this table"), (5, "five"), (5, "five"), (5, "six"), *[(None, "m " * 9)] * 40]
    docs = llm_spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for tile, leaf in ((512, 4096), (2, 2)):
        got = near_dedup.near_duplicates(docs, threshold=80, tile=tile, leaf=leaf).collect()
        seen = Counter((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in got)
        want = Counter({(None, 1, False, 2): 1, (1, 1, True, 2): 1, (2, 2, True, 0): 1, (3, 3, True, 0): 1, (None, None, True, 0): 1, (9, 7, False, 56): 1, (None, 7, False, 56): 1, (7, 7, True, 56): 1, (7, 7, False, 56): 1})
        want += Counter({(None, None, True, 1): 2, (None, None, False, 1): 40, (5, 5, True, 1): 2, (5, 5, False, 1): 1})
        assert seen == want


def test_large_clusters_in_blocks(llm_spark):
    """Clusters of many blocks, in which many documents are linked only through others."""
    rng = random.Random(31)
    rows = []
    for c in range(2):
        w = [f"c{c}w{i}" for i in range(120)]
        for i in range(90):  # drifts away from the first one step by step
            w = list(w)
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
            rows.append((100 * c + i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    root = brute_components(sets, 80)
    docs = llm_spark.createDataFrame(rows, "doc_id bigint, text string")
    for tile, leaf in ((8, 4096), (8, 3), (512, 3)):
        got = near_dedup.near_duplicates(docs, threshold=80, tile=tile, leaf=leaf).collect()
        assert {r.doc_id: (r.component_id, r.kept) for r in got} == {i: (root[i], root[i] == i) for i in root}


def test_written_keeps_nothing_local(llm_spark):
    assert written(llm_spark.range(3).toDF("x"), "t").count() == 3


def test_near_duplicates_at_another_threshold(llm_spark):
    """Many pairs on both sides of 0.80, none of which the bound of 0.85 may decide."""
    rng = random.Random(17)
    rows = []
    for i in range(300):  # a word changed and some added: similarity about 0.81
        w = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((2 * i, " ".join(w)))
        w[50] = f"e{rng.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join([*w, *(f"e{rng.randrange(10**6)}" for _ in range(rng.randint(9, 13)))])))
    sets = {i: shingles(t) for i, t in rows}
    near = sum(80 <= 100 * len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 85 for i in range(0, 600, 2))
    root = brute_components(sets, 80)
    assert near >= 100 and any(root[i] == i for i in range(1, 600, 2))
    docs = llm_spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, threshold=80).collect()} == root
    assert (near_dedup.needed(85), near_dedup.needed(80)) == (93, 85)


@pytest.mark.parametrize(("width", "words"), [(400, 51), (40, 5), (400, 1)])
def test_repeated_bytes_and_passages(llm_spark, width, words):
    rows = [(i, t) for i, t, *_ in corpus(6)]
    rng = random.Random(8)
    for n in (50, 51, 60):  # shared passages of short words, their separators differing
        w = [rng.choice("abcdefgé") + str(rng.randrange(10)) for _ in range(n)]
        rows += [(1000 + 10 * n + k, f"{'x' * (k + 1)} {gap.join(w)}\n{'yz' * (k + 1)} \t") for k, gap in enumerate((" ", "\n", " \t "))]
    byte, word = Counter(), Counter()
    for _, t in rows:
        b = (t or "").encode()
        byte.update(b[s : s + width] for s in range(len(b) - width + 1))
        w = b.split()
        word.update(tuple(w[s : s + words]) for s in range(len(w) - words + 1))
    want, inside = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        mask = [0] * len(b)
        for s in range(len(b) - width + 1):
            if byte[b[s : s + width]] > 1:
                mask[s : s + width] = [1] * width
        passages = [0] * len(b)
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        for s in range(len(at) - words + 1):
            if word[tuple(b[x:y] for x, y in at[s : s + words])] > 1:
                lo, hi = at[s][0], at[s + words - 1][1]
                passages[lo:hi] = mask[lo:hi] = [1] * (hi - lo)
        n, runs, kept = removed(mask, b)
        want[i] = (len(b), n, runs, hashlib.sha256(bytes(kept)).hexdigest())
        inside[i] = sum(passages)
    docs = llm_spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = suffix_dedup.repeated_bytes(docs, width=width, words=words).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert {r.doc_id: r.passage_bytes for r in got} == inside
    plain = {r.doc_id: tuple(r) for r in suffix_dedup.repeated_bytes(docs, width=width).collect()}
    assert {r.doc_id: (*plain[r.doc_id], inside[r.doc_id]) for r in got} == {r.doc_id: tuple(r) for r in suffix_dedup.repeated_bytes(docs, width=width, words=words, count_only=True).collect()}
