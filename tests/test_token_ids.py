"""Operators on sampled ids against decoding every prefix."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sextant.operators import token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
CLOSERS = {"search": b"</search>", "answer": b"</answer>"}


@pytest.fixture(scope="module")
def vocabulary():
    return token_ids.vocabulary(PATH)


def texts():
    rng = random.Random(6)
    parts = ["word ", "</search>", "<search>", "</answer>", "é", "日本", "😀", "\n", "</", "search>", "think</think>", "<|endoftext|>", " x", "​", "ﬁ"]
    return ["", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(400))]


def sampled(vocabulary, text, rng):
    """Ids as a model might sample them: pieces that encoding would have joined."""
    out, at = [], 0
    while at < len(text):
        step = rng.randint(1, 9)
        out += vocabulary.encoder.encode(text[at : at + step], add_special_tokens=False).ids
        at += step
    return out


def test_bytes_are_those_of_the_text(vocabulary):
    rng = random.Random(1)
    for text in texts():
        for ids in (vocabulary.encoder.encode(text, add_special_tokens=False).ids, sampled(vocabulary, text, rng)):
            assert vocabulary.bytes_of(ids) == text.encode() and vocabulary.ends(ids)[-1:] == [len(text.encode())][: len(ids)]
    assert vocabulary.bytes_of([50256]) == b"<|endoftext|>"
    with pytest.raises((ValueError, IndexError)):
        vocabulary.bytes_of([-1])


@pytest.mark.parametrize("opened", [b"", b"</think>"])
def test_slices_are_the_shortest_prefixes(vocabulary, opened):
    rng = random.Random(2)

    def boundary(data):
        at = data.find(opened) + len(opened) if opened else 0
        if opened and opened not in data:
            return None
        found = [(data.find(c, at), n) for n, c in CLOSERS.items() if c in data[at:]]
        return min(found)[1] if found else None

    for text in texts():
        ids = sampled(vocabulary, text, rng)
        want = next(((k, boundary(vocabulary.bytes_of(ids[:k]))) for k in range(1, len(ids) + 1) if boundary(vocabulary.bytes_of(ids[:k]))), None)
        n, n_text, kind, said = vocabulary.slice(ids, CLOSERS, opened)
        assert (n, kind) == (want or (len(ids), "length")) and n_text == n
        assert said == vocabulary.bytes_of(ids[:n]).decode("utf-8", "replace")
        ended = vocabulary.slice([*ids, 50256, 50256, 7], CLOSERS, opened, eos=50256, pad=50256)
        assert ended[:3] == ((want[0], want[0], want[1]) if want else (len(ids) + 1, len(ids), "eos"))
        assert vocabulary.slice([*ids, 50256, 9], CLOSERS, opened, pad=50256)[:3] == ((want[0], want[0], want[1]) if want else (len(ids), len(ids), "length"))


def test_budgets_never_split_a_character(vocabulary):
    rng = random.Random(3)
    for text in texts()[:150]:
        ids = sampled(vocabulary, text, rng)
        for most in {0, 1, 2, 5, len(ids) - 1, len(ids), len(ids) + 3} - {-1}:
            k, cut, said = vocabulary.within(ids, most)
            good = [j for j in range(min(most, len(ids)) + 1) if text.encode().startswith(vocabulary.bytes_of(ids[:j])) and vocabulary.bytes_of(ids[:j]).decode("utf-8", "ignore").encode() == vocabulary.bytes_of(ids[:j])]
            assert k == max(good) and text.startswith(said) and cut == (k < len(ids))
    half = vocabulary.encoder.encode("😀", add_special_tokens=False).ids
    assert len(half) > 1 and vocabulary.within(half[:-1], 9) == (0, True, "")


def test_ids_on_spark(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(-1, None)]
    d = spark.createDataFrame(rows, "i int, t string").withColumn("ids", token_ids.encoded(F.col("t"), PATH))
    out = d.select("i", "t", "ids", token_ids.decoded(F.col("ids"), PATH).alias("back"), token_ids.action_slices(F.col("ids"), PATH, ("</search>", "</answer>")).alias("a"), token_ids.shown_within(F.col("ids"), F.col("i") % 7, PATH).alias("s"))
    for r in out.collect():
        if r.t is None:
            assert (r.ids, r.back, r.a, r.s) == (None,) * 4
            continue
        assert r.back == r.t and tuple(r.a) == vocabulary.slice(r.ids, CLOSERS) and tuple(r.s) == vocabulary.within(r.ids, r.i % 7)


def test_padding(spark):
    d = spark.createDataFrame([([5, 6, 7],), ([],), ([1, 2, 3, 4, 5, 6],)], "ids array<int>")
    right = [tuple(r[0]) for r in d.select(token_ids.padded(F.col("ids"), F.lit(4), 0)).collect()]
    assert right == [([5, 6, 7, 0], [1, 1, 1, 0], [0, 1, 2, 2]), ([0] * 4, [0] * 4, [0] * 4), ([1, 2, 3, 4], [1] * 4, [0, 1, 2, 3])]
    left = [tuple(r[0]) for r in d.select(token_ids.padded(F.col("ids"), F.lit(4), 0, left=True)).collect()]
    assert left == [([0, 5, 6, 7], [0, 1, 1, 1], [0, 0, 1, 2]), ([0] * 4, [0] * 4, [0] * 4), ([3, 4, 5, 6], [1] * 4, [0, 1, 2, 3])]


def test_batches_are_encoded_in_pieces(vocabulary, monkeypatch):
    """No piece has more bytes than ``PIECE`` unless it is one row; rows keep their order."""
    import pyarrow as pa

    monkeypatch.setattr(token_ids, "PIECE", 40)
    column = pa.array([*texts()[:80], None, "x" * 90, None, ""])
    seen = []

    def piece(x):
        seen.append((len(x), sum(len((t or "").encode()) for t in x.to_pylist())))
        return x

    assert token_ids.by_pieces(piece, column).to_pylist() == column.to_pylist()
    assert len(seen) > 20 and all(rows == 1 or n <= 40 for rows, n in seen)
    assert token_ids.by_pieces(lambda x: x, column.slice(5, 7)).to_pylist() == column.slice(5, 7).to_pylist()
    assert token_ids.by_pieces(lambda x: x, column.slice(0, 0)).to_pylist() == []


def test_encoding_with_a_budget_equals_its_two_steps(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(-1, None)]
    d = spark.createDataFrame(rows, "i int, t string").withColumn("ids", token_ids.encoded(F.col("t"), PATH))
    for r in d.select("ids", token_ids.encoded_within(F.col("t"), F.col("i") % 7, PATH).alias("a"), token_ids.shown_within(F.col("ids"), F.col("i") % 7, PATH).alias("b")).collect():
        assert (r.a, r.b) == (None, None) if r.ids is None else tuple(r.a) == (len(r.ids), *r.b)
