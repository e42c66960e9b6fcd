"""Contracts, records and reports: errors, files and cases that SQL does not show."""

import hashlib
import io
import os
import tarfile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from sextant.functions import documents, values
from sextant.operators import batch, contracts, responses
from sextant.session import clean, folder, one_machine, written
from sextant.sources import corpus, records, reports


def test_unknown_sources_are_errors(spark):
    df = spark.createDataFrame([("nq", 1.0), ("other", 0.5), (None, 0.1)], "source string, s double")
    scorers = {("nq", "triviaqa"): F.col("s")}
    with pytest.raises(Exception, match="no scorer for source other"):
        df.where("source = 'other'").select(responses.dispatch(F.col("source"), scorers)).collect()
    assert [r[0] for r in df.select(responses.dispatch(F.col("source"), scorers, strict=False)).collect()] == [1.0, None, None]
    assert {(r.source, r.n) for r in responses.unknown_sources(df, "source", scorers).collect()} == {("other", 1), (None, 1)}


def test_offline_scores_without_responses(spark):
    prompts = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, responses array<string>")
    got = responses.offline_scores(prompts, "id", lambda r: (r == "a").cast("int"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1.0, 0.5), (2, 0, None, None)}
    assert tuple(responses.pass_rate(got).collect()[0]) == (2, 0.5)


def test_preference_pairs_are_cut_and_masked(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], [9])], "c array<bigint>, r array<bigint>")
    p = df.select(responses.preference_pair(F.col("c"), F.col("r"), 2, 3).alias("p")).collect()[0].p
    assert (p.chosen, p.chosen_mask, p.rejected, p.rejected_mask) == ([5, 6, 7], [1, 1, 1], [9, 2, 0], [1, 1, 0])


def test_names_that_are_not_there():
    with pytest.raises(ValueError, match="no retriever x"):
        responses.retriever("x")


def test_dispatch_modes(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    got = [r.worker for r in responses.dispatched(df, 4, 10, "chunks").orderBy("row_id").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert [r.worker for r in responses.dispatched(df.limit(2), 4, 2, "chunks").orderBy("row_id").collect()] == [0, 1]
    assert responses.dispatched(df, 3, 10, "one_to_all").count() == 30
    for mode in ("all_to_all", "none"):
        with pytest.raises(ValueError):
            responses.dispatched(df, 3, 10, mode)


def test_parameters():
    assert contracts.threshold("x", 2) == 2.0 and contracts.threshold("x", 1, ratio=True) == 1.0
    for bad in (float("nan"), float("inf"), True, "1"):
        with pytest.raises(ValueError):
            contracts.threshold("x", bad)
    with pytest.raises(ValueError):
        contracts.threshold("x", 1.5, ratio=True)
    assert contracts.expected_rows(130, 5, 64) == 640 and contracts.expected_rows(130, 5, 64, drop_last=False) == 650
    with pytest.raises(ValueError):
        contracts.expected_rows(1, 0, 1)


def test_positions_of_a_good_file(spark):
    rows = spark.createDataFrame([(i, f'{{"id": {i}}}') for i in range(30)], "k int, line string").repartition(4)
    lines = records.positional(rows, "k", "line").withColumn("id", F.col("row").cast("string"))
    assert contracts.positions(lines).collect() == []
    assert [r.start for r in lines.orderBy("row").limit(3).collect()] == [0, 10, 20]


def test_archives(spark, tmp_path):
    def pack(name, mode, members):
        with tarfile.open(f"{tmp_path}/{name}", mode) as t:
            for member, data in members.items():
                info = tarfile.TarInfo(member)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))

    pack("a.tar.gz", "w:gz", {"x/c.jsonl": b'{"id": 0}\n{"id": 1}\r\n\n', "readme.txt": b"no"})
    pack("b.tar", "w", {"d.jsonl": "é\n".encode() * 5000})
    got = records.lines_of_archives(spark, f"{tmp_path}/*.tar*")
    first = got.where("member = 'x/c.jsonl'").orderBy("row").collect()
    assert [(r.row, r.start, r.stop, r.line) for r in first] == [(0, 0, 10, '{"id": 0}'), (1, 10, 21, '{"id": 1}'), (2, 21, 22, "")]
    r = got.where("member = 'd.jsonl'").agg(F.count("*").alias("n"), F.max("stop").alias("stop")).collect()[0]
    assert (r.n, r.stop) == (5000, 15000) and got.count() == 5003


def test_key_values(spark, tmp_path):
    (tmp_path / "good").write_text("a = 1\n\nb=x=y\n")
    (tmp_path / "bad").write_text("a=1\na=2\n")
    assert {(r.key, r.value) for r in records.read_key_values(spark, f"{tmp_path}/good").collect()} == {("a", "1"), ("b", "x=y")}
    with pytest.raises(Exception, match="duplicate key"):
        records.read_key_values(spark, f"{tmp_path}/bad").collect()


def test_vectors_must_divide(spark):
    df = spark.createDataFrame([(bytearray(b"\0" * 12),)], "b binary")
    with pytest.raises(PythonException, match="do not make rows"):
        df.select(records.unpacked_vectors(F.col("b"), 2)).collect()
    assert df.select(records.unpacked_vectors(F.col("b"), 1).alias("v")).collect()[0].v == [[0.0]] * 3


def test_spelt_numbers_keep_nulls_and_maps(spark):
    df = spark.sql("SELECT named_struct('m', map('k', CAST('NaN' AS DOUBLE)), 'n', CAST(NULL AS DOUBLE), 'i', 3) AS r UNION ALL SELECT NULL")
    got = [r[0] for r in df.select(values.spelt(F.col("r"), df.schema["r"].dataType)).collect()]
    assert got[0].m == {"k": "NaN"} and got[0].n is None and got[0].i == 3 and got[1] is None


def test_flatten_json_of_odd_texts(spark):
    df = spark.createDataFrame([("",), (None,), ("[1]",), ('{"a": {}}',), ('{"a": [true, "x"]}',)], "t string")
    assert [r[0] for r in df.select(values.flatten_json("t")).collect()] == [{}, {}, {}, {}, {"a/list_len": "2", "a/0": "true", "a/1": '"x"'}]


def test_sidecars(spark, tmp_path):
    os.makedirs(f"{tmp_path}/data")
    for n in "abc":
        (tmp_path / "data" / n).write_text(n)
    reports.write_sidecar(spark, f"{tmp_path}/data", f"{tmp_path}/side")
    assert reports.verify_sidecar(spark, f"{tmp_path}/data", f"{tmp_path}/side").collect() == []
    (tmp_path / "data" / "a").write_text("changed")
    os.remove(f"{tmp_path}/data/b")
    (tmp_path / "data" / "d").write_text("new")
    assert {tuple(r) for r in reports.verify_sidecar(spark, f"{tmp_path}/data", f"{tmp_path}/side").collect()} == {("a", "changed"), ("b", "missing"), ("d", "not listed")}


def test_sidecars_of_nested_folders(spark, tmp_path):
    for d in ("a b", "c"):
        os.makedirs(f"{tmp_path}/data/{d}")
        (tmp_path / "data" / d / "part").write_text(d)
    assert {(r.name, r.length) for r in reports.digests(spark, f"{tmp_path}/data/").collect()} == {("a b/part", 3), ("c/part", 1)}
    assert [r.name for r in reports.digests(spark, f"{tmp_path}/data/c/part").collect()] == ["part"]
    reports.write_sidecar(spark, f"{tmp_path}/data", f"{tmp_path}/side")
    assert reports.verify_sidecar(spark, f"{tmp_path}/data", f"{tmp_path}/side").collect() == []
    (tmp_path / "data" / "c" / "part").write_text("x")
    assert [tuple(r) for r in reports.verify_sidecar(spark, f"{tmp_path}/data", f"{tmp_path}/side").collect()] == [("c/part", "changed")]


def test_contract_digests(spark):
    df = spark.createDataFrame([('{"b":1, "a":[]}',), ('{"a" : [],"b":1}',), ("{",), (None,)], "d string")
    got = [r[0] for r in df.select(documents.contract_digest(F.col("d"))).collect()]
    assert got == [hashlib.sha256(b'{"a":[],"b":1}').hexdigest()] * 2 + [None, None]


def test_publish_is_all_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.range(3)

    def broken(to):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        reports.publish(spark, path, {"rows": df.write.parquet, "more": broken})
    assert os.listdir(tmp_path) == []
    reports.publish(spark, path, {"rows": df.write.parquet, "csv": lambda to: reports.write_csv(df, to)})
    assert spark.read.parquet(f"{path}/rows").count() == 3 and sorted(os.listdir(path)) == ["csv", "rows"]
    with pytest.raises(FileExistsError):
        reports.publish(spark, path, {"rows": df.write.parquet})


def test_csv_keeps_any_text(spark):
    rows = [(1, 'a "b", c\n\\d'), (2, "é\r\n"), (3, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    assert sorted((r.id, r.t or "") for r in reports.csv_roundtrip(df, "id int, t string").collect()) == rows


def test_markdown_escapes_bars(spark):
    df = spark.createDataFrame([("b|c", 1), ("a", None)], "x string, n int")
    assert [r.line for r in reports.markdown(df, [F.col("x")]).orderBy("n").collect()] == ["| x | n |", "| --- | --- |", "| a |  |", "| b\\|c | 1 |"]


def test_columns_of_one_length(spark):
    assert batch.from_columns(spark, {"a": [1, 2], "b": ["x", "y"]}, "a int, b string").count() == 2
    with pytest.raises(ValueError, match="differ in length"):
        batch.from_columns(spark, {"a": [1], "b": []}, "a int, b string")


def test_splits_fall_back_and_prompts_concatenate(spark, tmp_path):
    for split in ("dev", "train"):
        spark.createDataFrame([(split, "c")], corpus.PASSAGE).coalesce(1).write.json(f"{tmp_path}/{split}.jsonl")
    assert corpus.first_split(spark, str(tmp_path), corpus.PASSAGE).collect()[0].id == "dev"
    assert corpus.read_split(spark, str(tmp_path), "train", corpus.PASSAGE).collect()[0].id == "train"
    with pytest.raises(FileNotFoundError):
        corpus.first_split(spark, f"{tmp_path}/none", corpus.PASSAGE)
    for n in "ab":
        corpus.write_once(spark.range(2), f"{tmp_path}/{n}.parquet")
    assert corpus.read_prompts(spark, f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet").count() == 4
    with pytest.raises(Exception, match="(?i)exists"):
        corpus.write_once(spark.range(2), f"{tmp_path}/a.parquet")
    assert corpus.files(spark, f"{tmp_path}/a.parquet").where("length > 0").count() >= 1


def test_identity_defaults_and_latest(spark):
    df = spark.createDataFrame([("r", None), (None, 2)], "run string, slot int")
    got = contracts.trace_identity(df, {"run": F.lit("d"), "slot": F.lit(0), "stage": F.lit("s")}).collect()
    assert {tuple(r) for r in got} == {("r", 0, "s"), ("d", 2, "s")}
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (None, 3), (None, 1), (3, None)], "k int, o int")
    assert sorted(map(tuple, contracts.latest(rows, "k", "o").collect()), key=str) == [(1, 2), (1, 2), (2, 1), (None, 3)]


def test_first_action_and_stops(spark):
    df = spark.createDataFrame([(["a ", "<sea", "rch>q</sea", "rch>", " tail"],), (["no"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(contracts.first_action(F.col("p"), ("</search>", "</answer>"))).collect()] == [4, None, None]
    text = spark.createDataFrame([("a</x>b</y>",), ("a</y>b</x>",), ("none",)], "t string")
    assert [r[0] for r in text.select(contracts.stop_at(F.col("t"), ("</x>", "</y>"))).collect()] == ["a</x>", "a</y>", "none"]


def test_first_action_looks_for_its_end_once(spark):
    rows = spark.range(1).select(F.concat(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.lit("word ")), F.array(F.lit("</x>"), F.lit("tail"))).alias("p"))
    found = rows.select(contracts.first_action(F.col("p"), ("</x>", "</y>")).alias("n"))
    assert found.collect()[0]["n"] == 20_001
    assert found._jdf.queryExecution().analyzed().toString().lower().count("instr(") == 4  # two for each closer, none within the lambda


def test_tests_run_on_one_machine(spark):
    assert one_machine(spark)


def test_clean_deletes_what_was_written_aside(spark):
    here = folder(spark).removeprefix("file://")
    assert written(spark.range(3), "rows").count() == 3 and os.listdir(here)
    clean(spark)
    assert not os.path.exists(here)
    assert written(spark.range(3), "rows").count() == 3


def test_titles_fall_back(spark):
    df = spark.createDataFrame([(None, "", " a\u2028b"), ("\r\n x \r\ny", "z", "c"), (None, None, " "), ("t\x85u", None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(documents.title_of(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["a", "x", "", "t"]


def test_document_ids(spark):
    cases = {'{"document_id":12345678901234567890}': ("12345678901234567890", True, True), '{"document_id":12.0}': (None, False, False), '{"document_id":"\\u00e9"}': ("é", True, True), '{"document_id":{}}': (None, False, False), "{": (None, False, False), "{}": (None, True, False)}
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "d string")
    got = df.select("d", documents.document_id(F.col("d"), False).alias("g"), documents.document_id(F.col("d"), True).alias("p")).collect()
    assert {r.d: (r.g.id, r.g.valid, r.p.valid) for r in got} == cases | {None: (None, False, False)}
