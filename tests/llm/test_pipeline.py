"""The pipeline against brute force, and the registered queries on test tables."""

import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_dedup import brute_components, shingles
from test_other_operators import brute_hits

import __spark_entry__
import corpus_pipeline
from sextant.llm import decontaminate, quality, sentencepiece_codec

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")


def fixture(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7)))
    texts = []
    for i in range(90):
        words = [word() for _ in range(rng.randint(30, 160))]
        texts.append(" ".join(words) if i % 5 else " ".join(w.upper() + "!!" for w in words[:4] * 20))
    passage = " ".join(word() for _ in range(120))
    item = " ".join(word() for _ in range(25))
    for i in range(1, 9):
        texts.append(texts[i])
        w = texts[i + 10].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
        texts.append(" ".join(word() for _ in range(40)) + " é" + passage + "é " + " ".join(word() for _ in range(40)))
    texts += [" ".join(word() for _ in range(30)) + " " + item + " " + word() for _ in range(3)] + ["", None]
    docs = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(90)]
    bench = [(0, item), (1, " ".join(word() for _ in range(20)))]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, labels, bench


def test_pipeline_against_brute_force(llm_spark, tmp_path):
    import sentencepiece

    docs, labels, bench = fixture(llm_spark, str(tmp_path))
    texts = {i: t for i, t, *_ in docs}
    # quality
    stats = dict(zip(texts, quality.statistics([(t or "").encode() for t in texts.values()]), strict=True))
    learn = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    model = quality.Boosted(np.stack([stats[i] for i, _ in learn]), np.array([q for _, q in learn], float))
    good = {i: t for i, t in texts.items() if model.score(stats[i][None])[0] >= 0.5}
    assert {i for i, q, _ in labels if q} <= set(good) and not {i for i, q, _ in labels if not q} & set(good)
    # near-duplicates
    root = brute_components({i: shingles(t) for i, t in good.items()})
    kept = {i: t for i, t in good.items() if root[i] == i}
    assert len(kept) < len(good)
    # repeated strings
    count = Counter()
    for t in kept.values():
        b = (t or "").encode()
        count.update(b[s : s + 400] for s in range(len(b) - 399))
    left = {}
    for i, t in kept.items():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        left[i] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    assert sum(map(len, left.values())) < sum(len(t or "") for t in kept.values())
    # benchmark
    hits = brute_hits(list(left.items()), bench)
    clean = {i: t for i, t in left.items() if not hits[i][-1]}
    assert len(clean) < len(left)
    # tokens
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in clean.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = corpus_pipeline.run(llm_spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_stages_keep_the_columns_of_documents(llm_spark, tmp_path):
    fixture(llm_spark, str(tmp_path))
    docs = llm_spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 AS digest")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(llm_spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS
        assert stage(llm_spark, docs.where("false"), str(tmp_path)).collect() == []
    assert corpus_pipeline.STAGES[-1][1](llm_spark, docs.where("false"), str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op3_warc_revisits", "op4_decontaminate", "op5_near_dedup", "op9_substring_dedup", "op10_topk"])
def test_query_matches_sql(llm_spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, rel = __spark_entry__.queries()[name](llm_spark, DATA), con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    place = [rel.columns.index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[i] for i in place)) for r in rel.fetchall())


def test_near_dedup_stage_takes_four_fifths(llm_spark):
    rng = random.Random(23)
    texts = []
    for n in range(50, 64):  # a word changed in the middle: similarity (n - 9) / (n + 1)
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(w), " ".join([*w[: n // 2], "changed", *w[n // 2 + 1 :]])]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    root = brute_components(sets, 80)
    assert len(set(root.values())) < len(set(brute_components(sets).values()))
    docs = llm_spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(llm_spark, docs, "").collect()} == {i for i in root if root[i] == i}


def test_suffix_stage_takes_passages_of_over_50_words(llm_spark):
    rng = random.Random(29)
    word = lambda: rng.choice("abcdeß") + str(rng.randrange(100))
    short, long = (" ".join(word() for _ in range(n)) for n in (50, 51))
    texts = [f"one {short} two", f"three {short} four", f"five {long} six", f"seven {long} eight"]
    assert len(long.encode()) < 250
    docs = llm_spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup_stage(llm_spark, docs, "").collect()}
    assert left == {0: texts[0], 1: texts[1], 2: "five  six", 3: "seven  eight"}


def test_stages_judge_rows_without_an_id(llm_spark, tmp_path):
    """Low quality, copies and benchmark passages go, whether or not rows have an id of their own."""
    docs, _, bench = fixture(llm_spark, str(tmp_path))
    item, texts = bench[0][1], [t for _, t, *_ in docs]
    row = lambda i, t: (i, t, "en", "s", len(t))
    frame = lambda rows: llm_spark.createDataFrame([row(*r) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2)
    seen = lambda stage, rows: Counter((r.doc_id, r.text) for r in stage(llm_spark, frame(rows), str(tmp_path)).collect())
    good, bad = texts[1], texts[0]
    rows = docs[:90] + [row(None, good), row(None, bad), row(1, bad)]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.quality_stage(llm_spark, llm_spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), str(tmp_path)).collect())
    assert got[None, good] == 1 and got[1, good] == 1 and not got[None, bad] and not got[1, bad]
    near = good.split(" ")
    near[len(near) // 2] = "changed"
    near = " ".join(near)
    others = [(4, texts[2]), (4, texts[2]), (4, texts[3]), (None, texts[4])]
    left = seen(corpus_pipeline.near_dedup_stage, [(None, good), (None, near), (None, near), *others])
    assert left - Counter(set(others)) in (Counter([(None, good)]), Counter([(None, near)])) and all(left[k] == 1 for k in set(others))
    assert sum(seen(corpus_pipeline.near_dedup_stage, [(None, good), (None, near), (None, near)]).values()) == 1
    assert seen(corpus_pipeline.decontaminate_stage, [(None, good), (None, f"{good} {item}"), (1, f"{item} {good}"), (1, near)]) == Counter({(None, good): 1, (1, near): 1})


@pytest.fixture(scope="module")
def odd_tables(llm_spark, tmp_path_factory):
    """Null ids and texts, ties, repeated rows, a text of two megabytes, odd characters."""
    to = str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"word{i % 5003}" for i in range(220_000))
    item = " ".join(f"item{i}" for i in range(14))
    texts = [None, "", " ", "x", long, long, f"{item} and more", f"é \x00 ｆｕｌｌ {item}", "a b c d e f", "a b c d e f", "🙂 " * 300]
    rows = [(i, t, "en" if i % 2 else "de", None, None, "clash") for i, t in enumerate(texts)] + [(None, texts[6], "en", "s", 1, ""), (None, None, None, None, None, None), (8, texts[8], "de", None, None, "clash")]
    llm_spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, text_hash string").write.parquet(f"{to}/documents.parquet")
    llm_spark.createDataFrame([(1, 1, 0), (4, 1, 0), (3, 0, 1), (None, 0, None), (6, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    llm_spark.createDataFrame([(1, item), (1, item), (None, "x"), (3, None)], "item_id bigint, text string").write.parquet(f"{to}/benchmark.parquet")
    llm_spark.createDataFrame([(i, None if i == 3 else "u", t) for i, t in enumerate(texts)] + [(None, "u", texts[4])], "page_id bigint, url string, html string").write.parquet(f"{to}/pages.parquet")
    llm_spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(60)] + [(None, [1.0, 2.0]), (20, None), (40, [None, 1.0])], "vec_id bigint, embedding array<double>").write.parquet(f"{to}/embeddings.parquet")
    return to


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op")])
def test_odd_tables(llm_spark, odd_tables, name):
    """Each query returns a row for each row of its table, whatever is in it."""
    got = __spark_entry__.queries()[name](llm_spark, odd_tables).collect()
    if name == "op10_topk":
        assert Counter(r.query_id for r in got) == {0: 20, 20: 20, 40: 20}
    elif name == "op3_warc_revisits":
        assert sorted(-1 if r.page_id is None else r.page_id for r in got) == [-1, *range(11)]
    elif name == "op13_filter_audit":
        assert Counter(r.part for r in got) == {"": 600, "s": 600}
    else:
        each = 2 if name == "op12_rolling_windows" else 1
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == sorted([-1, -1, *range(9), 8, 9, 10] * each)
    check = DECISIONS.get(name.split("_")[0])
    if check:
        check([r for r in got if r.doc_id is not None], got)


def _near(rows, _):
    of = {r.doc_id: r for r in rows}
    assert [(of[i].component_id, of[i].kept) for i in (4, 5, 9, 10)] == [(4, True), (4, False), (8, False), (10, True)]
    assert all(of[i].n_shingles == 0 and of[i].kept for i in (0, 1, 2)) and of[3].n_shingles == 1


def _suffixes(rows, _):
    of = {r.doc_id: r for r in rows}
    assert all(of[i].n_removed == of[i].n_bytes > 1_900_000 and of[i].n_spans == 1 for i in (4, 5))
    assert (of[10].n_bytes, of[10].n_removed, of[10].n_spans) == (1500, 1500, 1) and not any(of[i].n_removed for i in (0, 1, 2, 3, 6, 7, 8, 9))


def _passages(rows, _):
    of = {r.doc_id: r for r in rows}
    assert (of[4].n_removed, of[5].n_removed, of[5].kept_sha256) == (0, 220_000, hashlib.sha256(b"").hexdigest())
    assert not any(of[i].n_removed for i in (0, 1, 2, 3, 6, 7, 8, 9, 10))


def _hits(rows, _):
    of = {r.doc_id: r for r in rows}
    assert {i for i, r in of.items() if r.contaminated} == {3, 6, 7} and (of[6].n_hit, of[7].n_hit, of[3].n_hit, of[6].n_words) == (14, 14, 1, 16)


def _starts(_, got):
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert [r.doc_id for r in rows if r.doc_id is not None] == [*range(9), 8, 9, 10] and all(r.n_tokens == 1 for r in rows if r.doc_id in (0, 1))


def _clean(rows, got):
    assert {r.spans for r in got} == {""}


def _windows(rows, got):
    assert all(r.event_s % 60 == 0 for r in rows) and {(r.event_s, r.n_events, r.sum_chars, r.median_chars) for r in got if r.doc_id is None} == {(None, 0, 0, None)}


DECISIONS = {"op4": _hits, "op5": _near, "op7": _suffixes, "op8": _starts, "op9": _passages, "op11": _clean, "op12": _windows}


def test_operators_over_empty_tables(llm_spark):
    """Ops 2, 4 and 6 (the others' tests have their own)."""
    none = llm_spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stats = quality.measured(none)
    labels = llm_spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.scored(stats, quality.train(stats, labels)).collect() == []
    items = llm_spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.decontaminate(none, items).collect() == []
    one = llm_spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.decontaminate(one, items.where("false")).collect()] == [(3, 0, False)]
    assert sentencepiece_codec.digests(none, public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_pipeline_over_odd_tables(llm_spark, odd_tables):
    assert set(corpus_pipeline.run(llm_spark, odd_tables).columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    docs = llm_spark.read.parquet(f"{odd_tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(llm_spark, docs, odd_tables).columns == corpus_pipeline.COLUMNS
