"""Functions and operators whose results SQL does not check, against plain
Python or known values."""

import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.functions import protocol, scoring, text
from sextant.operators import balance, batch, episodes, evaluation, retrieval, sequences
from sextant.plans import curation_queries, retrieval_queries
from sextant.sources import corpus, runlog

ODD = ["", " ", "The U.S.A.!", "an apple, a day", "naïve  café", "ïan an", "Straße ﬁ", "a b\tc\n", "＋５", "日本 の 本", "x_y", None]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_normalize_text_is_nfkd_and_casefold(spark):
    def spec(t):
        if t is None:
            return None
        t = unicodedata.normalize("NFKD", t).casefold()
        return " ".join("".join(c if c.isalnum() else " " for c in t).split())

    assert column(spark, ODD, text.normalize_text) == [spec(t) for t in ODD]


def test_normalize_answer_order(spark):
    assert column(spark, ["The U.S.A.!", "an apple, a day", "A"], text.normalize_answer) == ["usa", "apple day", ""]


def test_strip_is_unicode(spark):
    assert column(spark, ["  Paris\n"], text.strip) == ["Paris"]


@pytest.mark.parametrize(("t", "want"), [
    ("<search>a</search><answer>b</answer>", ("search", "a")), ("<answer> b\n</answer>", ("answer", "b")), ("<search>a</answer>", ("invalid", "")), ("", ("invalid", "")),
    ("<search>x <answer>y</answer>", ("answer", "y")),
])
def test_first_action(spark, t, want):
    df = spark.createDataFrame([(t,)], "s string")
    assert tuple(df.select(text.action_of(F.col("s")), text.action_content(F.col("s"))).collect()[0]) == want


@pytest.mark.parametrize(("body", "want"), [
    ("<think>a</think><answer>b</answer>", None), ("<think>a</think> <search>q</search>\n<information>i</information><think>c</think><answer>b</answer>", None),
    ("<think>a</think><answer>b</answer> tail", "text between tags"), ("<answer>b</answer>", "order of tags"), ("<think>a<answer>b</answer>", "unbalanced think"), ("lead <think>a</think><answer>b</answer>", "text between tags"),
])
def test_tag_automaton(spark, body, want):
    df = spark.createDataFrame([("p <answer>x</answer><|im_start|>assistant\n" + body,)], "s string")
    assert df.select(text.tag_problem(F.col("s"))).collect()[0][0] == want


def test_cost_aware_rewards(spark):
    df = spark.createDataFrame([(0, 1.0, 4), (1, 0.0, 1)], "i int, score double, n int")
    for mode, want in (("linear", [0.9, -0.025]), ("correct_only", [0.9, 0.0])):
        got = [r[0] for r in df.orderBy("i").select(scoring.cost_aware_reward(F.col("score"), F.col("n"), 0.1, 4, mode)).collect()]
        assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        scoring.cost_aware_reward(F.col("score"), F.col("n"), 0.1, 0)


@pytest.mark.parametrize(("a", "b", "same"), [
    (r"\boxed{\frac{1}{2}}", "0.5", True), (r"\boxed{\dfrac12}", r"\frac{1}{2}", True), (r"\boxed{x=3}", "3", True), (r"so \boxed{1} and \boxed{\sqrt2}", r"\sqrt{2}", True),
    (r"\boxed{.5}", "0.5", True), (r"\boxed{10\%}", "10", True), (r"\boxed{3 \text{ cm}}", "3", True), (r"\boxed{1/2}", r"\frac{1}{2}", True), ("none", "1", False), (r"\boxed{2}", "3", False), (r"\boxed{1", "1", False),
])
def test_math(a, b, same):
    assert scoring.math_score(a, b) == float(same)


@pytest.mark.parametrize(("s", "want"), [
    ("Assistant: <answer>(1 + 2) * 3</answer>", 1.0), ("Assistant: <answer>1 + 2 * 3</answer>", 0.1), ("Assistant: <answer>1 + 2</answer>", 0.1), ("Assistant: <answer>(1 + 2) * 3 / (3-3)</answer>", 0.1),
    ("Assistant: none", 0.0), ("<answer>9</answer>", 0.0), ("Assistant: <answer>1+2)*3</answer>", 0.1),
])
def test_countdown(s, want):
    assert scoring.countdown_score(s, 9, [1, 2, 3]) == want


def test_arithmetic_is_not_code():
    assert scoring.arithmetic("__import__('os')") is None and scoring.arithmetic("2**9") is None and scoring.arithmetic("1/0") is None and scoring.arithmetic("-(2+3)*4") == -20


def native(spark, t, **how):
    return tuple(protocol.native_actions(spark.createDataFrame([(t,)], "t string"), F.col("t"), **how).collect()[0].parsed)


CALL = "r</think> <tool_call><function=search><parameter=query>{}</parameter></function></tool_call>"
NATIVE = [
    ('r</think>{"a": {"name": 1}}', (None, "", "missing_native_action")), ('r</think>{"a": 1, "name" : ', (None, "", "json_tool_call_not_supported")), ("r</think>{x}", (None, "", "missing_native_action")), ("r</think><tool_call <answer>a</answer>", (None, "", "invalid_action_prefix")),
    ("r</think><tool_call><function=search><parameter=query>q</parameter></tool_call>", (None, "", "multiple_or_unbalanced_tool_calls")), ("r</think><tool_call><parameter=query><function=search>q</parameter></function></tool_call>", (None, "", "malformed_tool_call")), ("  \u00a0 ", (None, "", "empty_response")), (None, (None, "", "empty_response")),
    ("r</think>x </answer><answer>a", (None, "", "multiple_or_unbalanced_answers")), ("r <think</think><answer>a</answer>", (None, "", "invalid_thinking_prefix")),
    ("", (None, "", "empty_response")), ("x", (None, "", "invalid_thinking_prefix")), ("r</think>", (None, "", "missing_native_action")), ("r</think><answer>a</answer> tail", ("answer", "a", None)),
    ("r</think>go <tool_call><function=search><parameter=query> q </parameter></function></tool_call>", ("search", "q", None)), ("r</think><tool_call><function=find><parameter=query>q</parameter></function></tool_call>", (None, "", "unknown_tool")),
    ("r</think><tool_call><function=search><parameter=k>q</parameter></function></tool_call>", (None, "", "invalid_search_parameter")), ("r</think><tool_call><function=search><parameter=query> </parameter></function></tool_call>", (None, "", "empty_search_query")),
    ("r</think><answer>a", (None, "", "multiple_or_unbalanced_answers")), ("r</think><tool_call>", (None, "", "multiple_or_unbalanced_tool_calls")), ('r</think>{"query": 1}', (None, "", "json_tool_call_not_supported")),
    ("r</think></think><answer>a</answer>", (None, "", "invalid_thinking_prefix")), ("r</think><answer>a <tool_call b</answer>", (None, "", "nested_protocol_marker")), ("r</think><think>x<answer>a</answer>", (None, "", "invalid_thinking_prefix")),
    ("r</think><answer><search>x</search></answer>", (None, "", "nested_protocol_marker")), ("r</think><answer>a <information b</answer>", (None, "", "nested_protocol_marker")),
    (CALL.format("<search>x</search>"), (None, "", "nested_protocol_marker")), (CALL.format("a <information b"), (None, "", "nested_protocol_marker")), (CALL.format("a<|im_end|>"), (None, "", "nested_protocol_marker")), (CALL.format("a|b im_end"), ("search", "a|b im_end", None)),
    ("r</think><answer><|im_start|></answer>", (None, "", "nested_protocol_marker")), ("r</think> <search>z</search> <answer>b</answer>", (None, "", "invalid_action_prefix")), ("r</think>prose with <search> and no action", (None, "", "multiple_or_unbalanced_tool_calls")),
    ("r</think>so </information> " + CALL[10:].format("q"), (None, "", "invalid_action_prefix")), ("r</think><tool_call><function=a b><parameter=query>q</parameter></function></tool_call>", (None, "", "malformed_tool_call")),
    ("r</think><tool_call><function=search><parameter=1q>q</parameter></function></tool_call>", (None, "", "malformed_tool_call")), ("r</think><tool_call><function=s.e-a_1><parameter=query>q</parameter></function></tool_call>", (None, "", "unknown_tool")),
    ("r</think><tool_call>\n<function=search>\n<parameter=query>\nwho\nis it\n</parameter>\n</function>\n</tool_call><|im_end|>\n", ("search", "who\nis it", None)), ("r</think>" + CALL[10:].format("q") + CALL[10:].format("r"), ("search", "q", None)),
    ("r</think><tool_call>" + CALL[10:].format("q"), (None, "", "multiple_or_unbalanced_tool_calls")), ("r</think><answer>a</answer><answer>b</answer>", ("answer", "a", None)), ("r</think><answer><answer>a</answer>", (None, "", "multiple_or_unbalanced_answers")),
    ("r</think>plain </answer", (None, "", "missing_native_action")), ("r</think>x</answer>", (None, "", "multiple_or_unbalanced_answers")), ("r</think>[1]", (None, "", "missing_native_action")), ("r</think><answer> \n</answer>", (None, "", "empty_answer")),
]


def test_native_grammar(spark):
    rows = protocol.native_actions(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NATIVE)], "i int, t string").repartition(2), F.col("t"))
    assert {r.i: tuple(r.parsed) for r in rows.collect()} == {i: want for i, (_, want) in enumerate(NATIVE)}


def test_native_grammar_compiles(spark):
    """With fallback off a plan that does not compile fails."""
    d = spark.createDataFrame([(t,) for t, _ in NATIVE], "t string")
    try:
        spark.conf.set("spark.sql.codegen.fallback", "false")
        spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
        for how in ({}, {"answer_only": True}, {"continued": False}):
            assert protocol.native_actions(d.repartition(3), F.col("t"), **how).where("parsed.error IS NULL").count() >= 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.factoryMode")


def test_native_terminal(spark):
    assert native(spark, "r</think>so <answer>a</answer>", answer_only=True)[2] == "invalid_terminal_answer_format"
    assert native(spark, "r</think> <answer>a</answer>", answer_only=True) == ("answer", "a", None)
    assert native(spark, "<think>r</think><answer>a</answer>", continued=False) == ("answer", "a", None)


def test_transcript_turns():
    turns = protocol.transcript_turns("<think>a</think><search>q</search><information>i</information>loose<answer>x</answer><think>b</think>")
    assert [(t["action"], t["content"], t["observation"], t["invalid_text"]) for t in turns] == [("search", "q", "i", ["loose"]), ("answer", "x", None, []), ("invalid", None, None, [])]
    assert protocol.transcript_turns("") == [] and protocol.transcript_turns("<search>q")[0]["invalid_text"] == ["<search>q"]
    assert [t["action"] for t in protocol.transcript_turns("<information>i</information>")] == ["invalid"]


@pytest.mark.parametrize("k", [2, 4, 8])
def test_balanced_partitions(k):
    rng = random.Random(k)
    lengths = [rng.randint(1, 2000) for _ in range(8 * k)]
    for equal in (True, False):
        parts = balance.differencing(lengths, k, equal)
        assert sorted(i for p in parts for i in p) == list(range(len(lengths))) and all(parts)
        assert not equal or {len(p) for p in parts} == {8}
        sums = [sum(lengths[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= max(lengths)
    assert sorted(i for p in balance.greedy(lengths, k) for i in p) == list(range(len(lengths)))
    with pytest.raises(ValueError):
        balance.differencing([1], 2, False)


def test_gae_and_eos(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0], [0.5, 0.4, 0.3], [0, 0, 2, 42, 3, 5, 1, 0, 0])], "r array<double>, v array<double>, ids array<int>")
    row = df.select(sequences.gae(F.col("r"), F.col("v"), 0.9, 0.8), sequences.eos_mask(F.col("ids"), 1)).collect()[0]
    last, after, want = 0.0, 0.0, []
    for r, v in zip([2.0, 0.0, 1.0], [0.3, 0.4, 0.5], strict=True):
        last = r + 0.9 * after - v + 0.9 * 0.8 * last
        after = v
        want.insert(0, last)
    assert row[0] == pytest.approx(want) and row[1] == [1, 1, 1, 1, 1, 1, 1, 0, 0]


def test_group_of_one_and_equal_scores(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 1.0)], "g string, s double")
    got = sorted((r.g, round(r.advantage, 4)) for r in sequences.group_advantage(df, "s", "g").collect())
    assert got == [("a", 2.0), ("b", 0.0), ("b", 0.0)]


def test_bootstrap_moments(spark):
    df = spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") % 2).alias("x"))
    r = evaluation.bootstrap(df, 500, 42, F.col("x")).collect()[0]
    assert r.resamples == 500 and abs(r.mean - 0.5) < 0.01 and 0.43 < r.low < 0.47 and 0.53 < r.high < 0.57


def test_violations_and_enforce(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    found = evaluation.violations(df, "k", {"small": F.col("v") < 9})
    assert [tuple(r) for r in found.collect()] == [(2, "small")]
    with pytest.raises(ValueError):
        evaluation.enforce(found)


def test_row_ids_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    for n in (1, 5):
        assert {r.k: r.row_id for r in batch.row_ids(df.repartition(n), "k").collect()} == {i: i for i in range(1000)}
    with pytest.raises(ValueError):
        batch.chunk(df, 3, 1000)


def test_padding_more_than_the_rows(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "row_id bigint, v string")
    assert [r.v for r in batch.pad_to_divisor(df, 7, 2).orderBy("row_id").collect()] == ["a", "b", "a", "b", "a", "b", "a"]


def test_bm25_without_terms(spark):
    docs = spark.createDataFrame([(0, "The harbour opened"), (1, "The mill closed")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(0, "harbour"), (1, "  "), (2, "absent")], "query_id bigint, text string")
    assert [(r.query_id, r.doc_id) for r in retrieval.bm25(queries, docs).collect()] == [(0, 0)]


def test_episode_stops_at_the_answer(spark):
    docs = spark.createDataFrame([(5, "harbour opened")], "doc_id bigint, text string")
    rows = [(1, 0, "<search>harbour</search>"), (1, 1, "nothing"), (1, 2, "<answer>x</answer>"), (1, 3, "<search>harbour</search>"), (2, 0, "<answer>y</answer>")]
    steps = episodes.replay(spark.createDataFrame(rows, "id bigint, turn bigint, response string"), docs, 4)
    assert sorted((r.id, r.turn, r.action, r.observation, r.done) for r in steps.collect()) == [(1, 0, "search", "5", False), (1, 1, "invalid", "retry", False), (1, 2, "answer", "", True), (2, 0, "answer", "", True)]
    assert {(r.id, r.turns, r.searches, r.invalid) for r in episodes.episode_totals(steps).collect()} == {(1, 3, 1, 1), (2, 1, 0, 0)}


def test_every_turn_is_a_step_with_its_search(spark):
    """No turn is left out, and the search is not pruned from the plan."""
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    turns = {(r.conv_id, r.turn) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()}
    steps = curation_queries.env_step(spark, data).collect()
    assert sorted((r.id, r.turn) for r in steps) == sorted(turns) and any(turn > 0 for _, turn in turns)
    assert any(r.observation for r in steps if r.action == "search") and all(r.content for r in steps if r.action == "answer")


def test_run_log(spark):
    lines = spark.createDataFrame([(0, "\x1b[36mstep:3 - a/b:0.25 - c:x - d:e:2\x1b[0m"), (1, "no step - a:1"), (2, "step:4 - a/b:1.5")], "line_no bigint, line string")
    m = runlog.metrics(lines)
    assert {(r.step, r.key, r.value) for r in m.collect()} == {(3, "a/b", 0.25), (3, "d:e", 2.0), (4, "a/b", 1.5)}
    assert runlog.prefix_mean(m, "a").collect()[0].mean == 0.875
    assert [tuple(r) for r in runlog.gaps(spark.createDataFrame([(1,), (2,), (5,), (6,), (9,)], "step bigint")).orderBy("step").collect()] == [(5, 3), (9, 3)]


def test_corpus_files(spark, tmp_path):
    passages = spark.createDataFrame([("0", '"Mill"\nclosed'), ("1", "one line")], corpus.PASSAGE)
    corpus.write_once(passages, f"{tmp_path}/dev.jsonl", "json")
    assert corpus.first_split(spark, str(tmp_path), corpus.PASSAGE).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        corpus.write_once(passages, f"{tmp_path}/dev.jsonl", "json")
    assert corpus.files(spark, str(tmp_path)).where("length > 0").count() >= 1


def test_pooling_and_normalising(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0], [3.0, 4.0], [0.0, 0.0])], "v array<array<double>>, m array<int>, w array<double>, z array<double>")
    assert list(df.select(retrieval.mean_pool(F.col("v"), F.col("m")), retrieval.l2_normalize(F.col("w")), retrieval.l2_normalize(F.col("z"))).collect()[0]) == [[2.0, 3.0], [0.6, 0.8], [0.0, 0.0]]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_ann_recall_of_every_twentieth_vector(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    found = {}
    for r in retrieval_queries.ann_top(spark, folder, 10).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        want[int(ids[q])] = set(ids[np.lexsort((ids, -np.round(vectors @ vectors[q], 6)))[:10]].tolist())
    recall = {q: len(want[q] & found[q]) / 10 for q in want}
    assert set(found) == set(want) and np.mean(list(recall.values())) >= 0.9
    assert {r.query_id: round(r.recall, 6) for r in retrieval_queries.ann_recall(spark, folder).collect()} == recall
    print(sf, len(recall), np.mean(list(recall.values())), min(recall.values()))


def test_wide_rows_keep_their_numbers(spark, tmp_path):
    """Every row once and no number twice, also with ties and when columns are many."""
    df = spark.range(120_000).selectExpr("id", "id % 5 AS tie", "repeat('x', 200) AS a", "sha2(CAST(id AS STRING), 256) AS b")
    got = batch.row_ids(df, "tie")
    got.write.parquet(f"{tmp_path}/rows")
    back = spark.read.parquet(f"{tmp_path}/rows")
    r = back.agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("d"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.count_distinct("id").alias("ids")).collect()[0]
    assert (r.n, r.d, r.lo, r.hi, r.ids) == (120_000, 120_000, 0, 119_999, 120_000)
    assert back.groupBy("tie").agg(F.min("row_id").alias("m")).orderBy("tie").collect() == [(k, 24_000 * k) for k in range(5)]


def test_long_sequences(spark):
    n = 20_000
    df = spark.createDataFrame([(1, [1.0] * n, [0.0] * n, [0] + [1] * (n - 1)), (2, [], [], []), (3, [2.0], [1.0], [1])], "id int, r array<double>, v array<double>, m array<int>")
    got = {x.id: x for x in df.select("id", sequences.gae(F.col("r"), F.col("v"), 1.0, 1.0).alias("g"), sequences.position_ids(F.col("m")).alias("p"), sequences.presence_penalty(F.col("r"), F.array(F.lit(0), F.lit(0), F.lit(n)), 0.5).alias("x")).collect()}
    assert got[1].g[0] == n and got[1].g[-1] == 1 and got[1].p[:3] == [0, 0, 1] and got[1].p[-1] == n - 2 and got[1].x[:2] == [0.5, 1.0]
    assert (got[2].g, got[2].p, got[2].x) == ([], [], []) and (got[3].g, got[3].p, got[3].x) == ([1.0], [0], [1.5])
