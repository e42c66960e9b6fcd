"""Operator 11: base patterns against plain regular expressions, decoding against
all paths, and what the field finds in lines that it has not seen."""

import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest

from sextant.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                doubled = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(digits))))
                if not 12 <= len(digits) <= 19 or doubled % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


@pytest.fixture(scope="module")
def model():
    return pii.train()


def odd_texts():
    rng = random.Random(2)
    parts = ["a", "Z9", "@", "@@", ".", "..", "b.c", "+", "%", "-", " ", "  ", "1", "22", "255", "256", "0.", "1.2.3.4", "001.02.3.4", "4242", "4242424242424242", "(", ")", "+1", "é", "日", "\n", "+49 30 1234567", "x@y.de", "\xa0", "١"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    texts += ["a@b.c@d.e", "@b.c", "a@b", "a@.c", "a@b..c", "a@b.", "+1 ( ", "+12", "+123", "1.2.3.4.5.6.7.8", "4242 4242 4242 4242 4242 4242 4242 4242", "0" * 16, "+0" + " " * 50 + "12345678 "]
    return texts


def test_base_spans_are_those_of_the_patterns():
    for text in odd_texts():
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "+1 " + " " * 300_000, "a@" * 100_000, "4242 " * 60_000, "+1" * 100_000):
        pii.base_spans(text)


def test_decoding_is_the_best_of_all_paths(model):
    texts = ["x 1 2", "+1 (826)", "a@b.c 9", "4242-4242", "é1 2.2"]
    tokens = pii.Tokens(texts)
    unary = model.unary(tokens.features(model.cues), tokens.islands)
    got = model.decode(tokens)
    bounds = np.append(tokens.islands, len(tokens.start))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 5:
            continue
        def score(path, a=a):
            s = unary[a, path[0]]
            for t in range(1, len(path)):
                s += unary[a + t, path[t]] + (-1e9 if model.barred[path[t - 1], path[t]] else model.steps[path[t - 1], path[t]])
            return s
        best = max(product(range(len(pii.LABELS)), repeat=b - a), key=score)
        assert abs(score(best) - score(tuple(got[a:b]))) < 1e-6


def test_forward_backward_sums_to_one(model):
    tokens = pii.Tokens([pii.unmarked(x)[0] for x in pii.LABELLED])
    share, pairs = model._expected(tokens.features(model.cues), tokens.islands, len(tokens.start))
    assert np.allclose(share.sum(1), 1) and abs(pairs.sum() - (len(tokens.start) - len(tokens.islands))) < 1e-6


HELD_OUT = """\
bitte unter <phone>(743) 555-6824</phone> melden
<card>4012888888881881</card> <card>5555555555554444</card> abgelehnt
<phone>+1 (555) 555-2824</phone> <ip>212.5.31.7</ip> in the log
<ip>212.5.31.7</ip> <card>4012888888881881</card> both
<phone>+1 (555) 555-2824</phone> <card>4012888888881881</card> both
line <phone>312-555-0177</phone> is busy
contact <email>someone.else@mail.example.net</email> and wait 3 days
nothing here in 2018, 2.5 or 17:45
build 7.2.1 of 2022-11-30 took 99 s
number 9807915762804491 again
token = "254ca002228af484f240146ffd26ba4415598ee8" enhast
version 3. Then 4.0. End
@someone said 5 or 6
""".splitlines()


def test_field_finds_held_out_spans(model):
    for line in HELD_OUT:
        text, spans = pii.unmarked(line)
        base, more = pii.all_spans([text], model)[0]
        assert set(spans) <= set(base) | set(more), line
        assert set(more) <= set(spans), line
        assert base == plain_spans(text)


def test_texts_do_not_depend_on_their_batch(model):
    texts = [pii.unmarked(x)[0] for x in pii.LABELLED] + odd_texts()[:300] + ["", "\n", " "]
    assert pii.all_spans(texts, model) == [pii.all_spans([t], model)[0] for t in texts]


def test_personal_data(llm_spark, model):
    rows = [(1, "+1 (826) 555-4081 190.137.223.204 é jane@example.com"), (2, None), (3, ""), (3, "4242424242424242 4242424242424242"), (None, "x " * 500_000 + "é@é a@b.cd"), (5, "plain words only"), (5, "plain words only")]
    docs = llm_spark.createDataFrame([(*r, 9, "clash") for r in rows], "doc_id bigint, text string, n_ip int, spans string")
    got = {(r["doc_id"], r["spans"]): r for r in pii.personal_data(docs, model, redact=True).collect()}
    assert len(got) == 6
    first = got[1, "phone:0:17,ip:18:33,email:36:52"]
    assert (first["n_email"], first["n_ip"], first["n_card"], first["n_phone"], first["n_added"]) == (1, 1, 0, 0, 1)
    assert first["base_sha256"] == hashlib.sha256(b"ip:18:33,email:36:52").hexdigest() and first["redacted"] == "[PHONE] [IP] é [EMAIL]"
    assert got[3, "card:0:16,card:17:33"]["redacted"] == "[CARD] [CARD]" and got[3, "card:0:16,card:17:33"]["n_card"] == 0
    assert got[2, ""]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[2, ""]["redacted"] == ""
    assert got[None, "email:1000004:1000010"]["n_email"] == 1
    assert pii.personal_data(docs.where("false"), model).collect() == []
