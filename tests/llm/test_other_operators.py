"""Operators 1, 2, 3, 4, 6, 8 and 10 against brute force, round trips and
held-out accuracy."""

import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sextant.llm import decontaminate, language_id, quality, sentencepiece_codec, token_files, topk, warc
from sextant.llm.base import scratch, written

TEXTS = [None, "", " ", "  a  b ", "don't I'LL we've", "x y", "<|endoftext|> hi </s>", "tab\t\t x\r\n\r\n  z   ", "\x1c\x1d a\x85b", "œuvre ½ ² ª", "日本語 ▁ text", "a b ​", "é ñ ﬁ", "end ", "long " * 4000, "12 3,4!? ***"]


# 1 language id
def languages(spark, n=240, seed=1):
    rng = random.Random(seed)
    parts = {"aa": ["th", "er", "in", "ly"], "bb": ["ué", "ço", "ñar", "el"], "cc": ["sch", "üb", "keit", "z"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80))), lang, "clash", 1.0))
    rows += [(n, None, "aa", "", 0.0), (n + 1, "123 !!", None, "", 0.0), (n + 2, "", "bb", "", 0.0), (None, rows[0][1], rows[0][2], "", 0.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score double")


def test_language_id(llm_spark):
    docs = languages(llm_spark)
    out = language_id.held_out("doc_id", 5, 0)
    model = language_id.train(docs.where(F.col("lang").isNotNull() & ~out), "doc_id", "text", "lang")
    got = language_id.identify(docs, model, [F.col("doc_id"), out.alias("held_out"), F.col("lang")]).collect()
    assert len(got) == 244
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    real = [r for r in got if r.doc_id is None or r.doc_id < 240]
    assert np.mean([r.lang == r.lang_pred for r in real]) > 0.99
    assert {r.lang_pred for r in got if r.doc_id is not None and r.doc_id >= 240} == {"und"}


def test_language_id_without_labels(llm_spark):
    docs = languages(llm_spark, 5)
    assert language_id.train(docs.where("false"), "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in language_id.identify(docs, None, [F.col("doc_id")]).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), None, [F.col("doc_id")]).collect() == []


def test_rare_languages_are_learned(llm_spark):
    rng = random.Random(3)
    langs = {f"l{i:03}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 3)) for i in range(230)}
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(40)), lang) for i, (lang, letters) in enumerate(x for x in langs.items() for _ in range(3))]
    docs = llm_spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(docs, "doc_id", "text", "lang")
    assert len(model.langs) == 230 and model.marks.shape[1] >= 230
    got = language_id.identify(docs, model, [F.col("doc_id"), F.col("lang")]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9


def test_presence_kernel_is_the_kernel():
    rows = [np.array([1, 2, 5, 9]), np.array([2, 5]), np.array([3, 70, 71])]
    model = language_id.Model(rows, ["a", "a", "b"])
    kernel = model._kernel(model._presence(rows), np.array([4.0, 2, 3]))
    sets = [set(r.tolist()) for r in rows]
    want = np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in sets] for x in sets])
    columns = sorted(np.round(c, 4).tolist() for c in kernel.T)  # landmarks come in an order of their own
    assert np.allclose(columns, sorted(np.round(c, 4).tolist() for c in want.T))


# 2 quality
def test_quality(llm_spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:5] * 20), 9.0))
        labels.append((i, int(good)))
    rows += [(400, None, 0.0), (401, "", 0.0), (None, "x", 0.0), (0, rows[0][1], 0.0)]
    labels += [(1, None), (None, 1), (5000, 1), (0, labels[0][1])]
    docs = llm_spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    marks = llm_spark.createDataFrame(labels, "doc_id bigint, quality int")
    out = language_id.held_out("doc_id", 3, 1)
    stats = quality.measured(docs)
    got = quality.scored(stats, quality.train(stats, marks.where(~out))).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels[:400])
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_quality_without_two_labels(llm_spark):
    docs = llm_spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    stats = quality.measured(docs)
    none = llm_spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.scored(stats, quality.train(stats, none)).collect()} == {0.5}
    ones = llm_spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert all(r.score > 0.9 for r in quality.scored(stats, quality.train(stats, ones)).collect())


def test_boosted_traversal_matches_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.Boosted(x, y, rounds=30)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    for row, s in zip(x[:20], model.score(x[:20]), strict=True):  # one row at a time, by plain walking
        margin = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            margin += leaf[node - len(f)]
        assert abs(1 / (1 + np.exp(-margin)) - s) < 1e-12


# 3 WARC
PAGES = [(1, "http://a/b c\r\n", "x" * 200, "z"), (2, "http://b", "x" * 200, "z"), (3, None, "short", "z"), (4, "u", "short", "z"), (5, "u", None, "z"), (6, "u", "", "z"), (7, "u", "é" * 60, "z"), (0, "u", "é" * 60, "z"), (8, "u", "WARC/1.1\r\n\r\n" * 20, "z"), (1, "http://a", "x" * 200, "z"), (9, "u", "y" * 300000, "z"), (None, "u", "x" * 200, "z")]


def test_warc(llm_spark):
    pages = llm_spark.createDataFrame(PAGES, "page_id bigint, url string, html string, refers_to string").repartition(3)
    found = written(warc.revisits(warc.headers(pages)), "revisits")
    folder = scratch(llm_spark, "warc")
    manifest = warc.write(pages, found, folder)
    got = warc.read(manifest, folder).collect()
    assert len(got) == len(PAGES)
    seen = sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = []
    for i, _, html, _ in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h, _ in PAGES if p is not None and (h or "").encode() == data]
        refers = min(same) if i is not None and len(data) >= 100 and min(same) != i else None
        want.append((-1 if i is None else i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert seen == sorted(want, key=lambda x: x[:4])


def test_warc_records_stand_alone():
    data = warc.member(warc.record(3, "http://x\n", b"p" * 10, "d" * 64, None, "2024-01-01T00:00:00Z")) + warc.member(warc.record(4, None, b"p" * 10, "d" * 64, 3, "2024-01-01T00:00:00Z"))
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        (a, block), (b, other) = warc.records(f)
    assert a["warc-type"] == "response" and block.endswith(b"p" * 10) and b["warc-type"] == "revisit" and b["warc-refers-to"] == a["warc-record-id"] and b"pp" not in other


def test_warc_empty(llm_spark):
    pages = llm_spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = scratch(llm_spark, "warc")
    assert warc.read(warc.write(pages, written(warc.revisits(warc.headers(pages)), "r"), folder), folder).collect() == []


# 4 decontamination
def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = {}
    windows = {i: {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)} for i, t in items if (w := words(t))}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, ws in windows.items():
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit.update(range(k, k + len(x)))
                        found.add(str(i))
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return want


def digest(out):
    return {r.doc_id: tuple(r[1:]) for r in out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()}


def test_decontaminate(llm_spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: rng.choice(["Alpha", "beta", "ÉTÉ", "ΣΑΣ", "x1", "İz", "Kelvin", "Kelvin", "no"])
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 30)))) for i in range(12)] + [(20, "only three words"), (21, "Solo"), (22, None), (23, "..."), (10, "again"), (24, "solo"), (25, "n " * 10)]
    docs = []
    for d in range(60):
        w = [rng.choice("abcdefghijkl") + str(rng.randrange(99)) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            t = items[d % 12][1].split(" ")
            k = rng.randrange(max(1, len(t) - 9))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.lower() if x.isascii() else x for x in t[k : k + rng.randint(8, 14)]]
        docs.append((d, rng.choice([" ", ", ", "_"]).join(w)))
    docs += [(100, None), (101, ""), (102, "SOLO solo only THREE words"), (103, "n " * 40), (104, "only three"), (105, "w " * 5000 + items[1][1])]
    df = llm_spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, fp int")
    bench = llm_spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, hit string")
    want = brute_hits(docs, items)
    assert digest(decontaminate.decontaminate(df, bench)) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)  # the way for a large benchmark
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert digest(decontaminate.decontaminate(df, bench)) == want
    assert digest(decontaminate.decontaminate(df, bench.where("false"))) == {d: (v[0], 0, 0, hashlib.sha256(b"").hexdigest(), False) for d, v in want.items()}
    assert digest(decontaminate.decontaminate(df.where("false"), bench)) == {}


def test_decontaminate_rows_without_an_id_of_their_own(llm_spark, monkeypatch):
    w = " ".join(f"w{i}" for i in range(12))
    docs = llm_spark.createDataFrame([(None, w), (None, "zz " + w), (None, "zz " + w), (None, "clean"), (None, None), (1, w), (1, "clean"), (1, "clean"), (2, "x " * 60000 + w)], "doc_id bigint, text string")
    bench = llm_spark.createDataFrame([(5, w), (None, w)], "item_id bigint, text string")
    for limit in (1 << 20, 0):
        for name in ("BROADCAST_WINDOWS", "BROADCAST_DOCS", "BROADCAST_BYTES"):
            monkeypatch.setattr(decontaminate, name, limit)
        got = decontaminate.decontaminate(docs, bench).collect()
        seen = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got)
        assert seen == [(0, 0, 0, 0, False), (0, 1, 0, 0, False), (0, 12, 12, 2, True), (0, 13, 12, 2, True), (0, 13, 12, 2, True), (1, 1, 0, 0, False), (1, 1, 0, 0, False), (1, 12, 12, 2, True), (2, 60012, 12, 2, True)]


def test_decontaminate_is_native(llm_spark):
    df = llm_spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = decontaminate.decontaminate(df, df.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 6 SentencePiece
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_sentencepiece(llm_spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = llm_spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 1)], "doc_id bigint, text string, ids int")
    full = {r.doc_id: r for r in sentencepiece_codec.encoded(docs, MODEL).collect()}
    short = {r.doc_id: r for r in sentencepiece_codec.digests(docs, MODEL).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        r, data = full[i], (t or "").encode()
        assert r.ids == ids and r.decoded == library.decode(ids)
        assert short[i].n_tokens == len(ids) and short[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        for piece, a, b in zip(ids, r.starts, r.ends, strict=True):
            if not library.is_control(piece) and not library.is_byte(piece):
                name = library.id_to_piece(piece)
                assert data[a:b].decode().replace(" ", "▁") in (name, name.removeprefix("▁"))
        assert r.ends[-1] == len(data)
    assert sentencepiece_codec.digests(docs.where("false"), MODEL).collect() == []


def test_normaliser_keeps_what_is_malformed_apart():
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.remove_extra_whitespaces = False
    proto.normalizer_spec.escape_whitespaces = True
    norm, align = sentencepiece_codec.Normaliser(proto).normalise(b"a\xff \xc3\xa9\xe2\x82")
    assert norm.decode() == "a\ufffd▁é\ufffd\ufffd"
    assert align.tolist() == [0, 1, 1, 1, 2, 2, 2, 3, 4, 5, 5, 5, 6, 6, 6, 7]


def test_segments_the_text_its_own_normaliser_made(monkeypatch):
    """Also with a model whose map changes texts, of which the library knows nothing."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model

    with open(MODEL, "rb") as f:
        proto = model.ModelProto.FromString(f.read())
    rules = model.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).normalizer_spec
    proto.normalizer_spec.precompiled_charsmap = rules.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    blob = proto.SerializeToString()
    library = sentencepiece.SentencePieceProcessor(model_proto=blob)
    import builtins

    monkeypatch.setattr(builtins, "open", lambda *a, **k: io.BytesIO(blob))
    code = sentencepiece_codec.Codec("mapped")
    monkeypatch.undo()
    texts = [t or "" for t in TEXTS] + ["ＡＢＣ ﬁ ½ ｶﾞ", "  lead  and  trail  ", "　wide　"]
    for t, e in zip(texts, code.encode(texts), strict=True):
        assert e.ids.tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert (np.diff(e.start) >= 0).all() and (e.end >= e.start).all() and e.end[-1] <= len(t.encode())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "identity"])
def test_character_map_matches_the_library(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = model.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = sentencepiece_codec.Normaliser(proto)
    assert own.edges.any() == (rule != "identity")
    for text in [t or "" for t in TEXTS] + ["ＡＢＣ ﬁ ½ ｶﾞ", "  lead  and  trail  ", "　wide　", "é Å Straße", "­ soft"]:
        norm, align = own.normalise(text.encode())
        assert norm.decode() == library.normalize(text)
        assert len(align) == len(norm) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(text.encode())


# 8 token files
def test_token_files(llm_spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i * 7 % 101, t, "x") for i, t in enumerate(TEXTS)] + [(3, "same id", "x"), (3, "same id", "x")]
    docs = llm_spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(3)
    for shard_bytes in (1 << 30, 2000):
        folder = scratch(llm_spark, "tokens")
        got = token_files.read(token_files.write(docs, folder, path, shard_bytes=shard_bytes), folder).collect()
        at, want = 0, []
        for i, t, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_token_files_without_rows_or_ids(llm_spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = llm_spark.createDataFrame([(None, "a"), (2, "b")], "doc_id bigint, text string")
    folder = scratch(llm_spark, "tokens")
    assert [(r.doc_id, r.start) for r in token_files.read(token_files.write(docs, folder, path), folder).orderBy("start").collect()] == [(None, 0), (2, 2)]
    many = llm_spark.range(300).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('text ', id) AS text")
    folder = scratch(llm_spark, "tokens")
    shards = token_files.write(many, folder, path, shard_bytes=500).collect()
    assert len(shards) > 4 and max(r.n_docs for r in shards) < 150
    assert [r.base for r in sorted(shards, key=lambda r: r.shard)] == [sum(s.n_tokens for s in shards if s.shard < r.shard) for r in sorted(shards, key=lambda r: r.shard)]
    got = token_files.read(token_files.write(many, folder, path, shard_bytes=500), folder).collect()
    assert len(got) == 300 and sorted(r.start for r in got)[0] == 0
    folder = scratch(llm_spark, "tokens")
    assert token_files.read(token_files.write(docs.where("false"), folder, path), folder).collect() == []


# 10 top-k
@pytest.mark.parametrize("large", [1.0, 1e6])
def test_topk(llm_spark, monkeypatch, large):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 3]) * large).tolist(), "c") for i in range(300)]
    rows += [(300 + i, rows[i][1], "c") for i in range(40)] + [(400, None, "c"), (420, [1.0, None], "c"), (440, [float("nan")] * 8, "c"), (460, [float("inf")] * 8, "c"), (480, [1.0, 2.0], "c"), (500, [], "c"), (20, rows[5][1], "c")]
    docs = llm_spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    good = [(i, np.array([int(np.floor(x * 64)) for x in v], object)) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(good):
        if q % 20 == 0:
            scores = sorted((-int(sum(a * b for a, b in zip(v, w, strict=False))), i) for m, (i, w) in enumerate(good) if m != n)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:20])]
    for head, block in ((1024, 16384), (30, 64)):
        monkeypatch.setattr(topk, "HEAD", head)
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "QUERY_BLOCK", 5 if block == 64 else 2048)
        monkeypatch.setattr(topk, "CHUNK", 16 if block == 64 else 1024)
        got = topk.topk(docs, F.col("vec_id") % 20 == 0).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_topk_prunes_by_partial_sums():
    """Most pairs go before the last step where few axes carry the products, and
    only contenders get an exact product."""
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(3000, 64)) * np.geomspace(64, 1, 64))
    axes = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])
    full = x[:50] @ x.T
    scan = topk.Scan(x[:50], np.arange(50), axes, 20, np.full(50, -np.inf))
    qi, xi, score = scan.run(x, np.arange(3000))
    full[np.arange(50), np.arange(50)] = -np.inf
    for q in range(50):
        assert sorted(score[qi == q], reverse=True)[:20] == sorted(full[q], reverse=True)[:20]
    assert (score == full[qi, xi]).all()
    assert scan.pairs[0] <= 50 * 3000 and (np.diff(scan.pairs) <= 0).all()
    assert scan.pairs[1] < 0.7 * scan.pairs[0] and scan.pairs[-1] < 0.5 * scan.pairs[0]


def test_topk_skips_blocks_that_are_too_short(llm_spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "HEAD", 64)
    rows = [(i, [float((i % 7 + 1) * (100 if i < 200 else 1)), 1.0]) for i in range(2000)]
    docs = llm_spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = topk.topk(docs, F.col("vec_id") % 20 == 0)
    want = [(q, i) for q, v in rows if q % 20 == 0 for _, i in sorted((-int(sum(64 * a * 64 * b for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q)[:20]]
    assert sorted((r.query_id, r.vec_id) for r in found.collect()) == sorted(want)


def test_topk_few_and_none(llm_spark):
    docs = llm_spark.createDataFrame([(20, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in topk.topk(docs, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 1, 64 * 128)]
    assert topk.topk(docs.where("false"), F.col("vec_id") % 20 == 0).collect() == []
