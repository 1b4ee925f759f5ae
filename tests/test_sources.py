import json
import random

import pytest
from pyspark.sql import functions as F

from lmprep.functions.templates import DEFAULT_PROMPTS
from lmprep.functions.tokenizers import CodepointTokenizer
from lmprep.plans.datasets import DatasetOptions, build_dataset, build_validation
from lmprep.plans.prompts import build_prompts
from lmprep.sources import readers, schemas, specs, writers

TOK = CodepointTokenizer()


def put(path, data):
    path.write_text(json.dumps(data), encoding="utf-8")
    return str(path)


def test_json_records(spark, tmp_path):
    path = put(tmp_path / "a.json", [{"instruction": "õ", "output": "x"}, {"instruction": "b", "input": None, "output": "y"}])
    got = readers.read_json_records(spark, path, schemas.ALPACA).collect()
    assert [tuple(r) for r in got] == [("õ", None, "x"), ("b", None, "y")]
    assert readers.read_source(spark, path, schema=schemas.ALPACA).count() == 2
    assert readers.read_prompts(spark, path, schemas.ALPACA).count() == 2
    bad = tmp_path / "bad.json"
    bad.write_text('[{"instruction": ')
    with pytest.raises(Exception):
        readers.read_json_records(spark, str(bad), schemas.ALPACA).collect()


def test_spec_grammars():
    parse = specs.parse_source_spec
    assert parse("corpus") == [specs.SourceSpec("corpus")]
    assert parse("corpus:de", "validation") == [specs.SourceSpec("corpus", "de", "validation")]
    assert [s.subset for s in parse("a:x,b,c:y", many=True)] == ["x", None, "y"]
    assert parse("f.json", exists=lambda p: True)[0].is_file
    for bad in ("a:b:c", ""):
        with pytest.raises(ValueError):
            parse(bad)
    prompt = specs.parse_prompt_spec
    assert prompt("a:test") == specs.SourceSpec("a", None, "test")
    assert prompt("a:de:test") == specs.SourceSpec("a", "de", "test")
    for bad in (None, "a", "a:b:c:d"):
        with pytest.raises(ValueError):
            prompt(bad)
    valid = specs.parse_validation_spec
    assert valid("one:path") == [(None, "one:path")]
    assert valid("a:x:de,b:y") == [("a", "x:de"), ("b", "y")]
    for bad in ("a:x,y", "a:x,a:y"):
        with pytest.raises(ValueError):
            valid(bad)


@pytest.mark.parametrize(
    "place", ["s3a://bucket/corpus.parquet", "hdfs://host:8020/a/corpus", "file:///data/corpus", "file:/data/corpus", "/data/corpus"]
)
def test_specs_with_addresses(place):
    spec = specs.SourceSpec
    assert specs.parse_source_spec(place) == [spec(place)]
    assert specs.parse_source_spec(f"{place}:et") == [spec(place, "et")]
    assert specs.parse_source_spec(f"{place},{place}:et", many=True) == [spec(place), spec(place, "et")]
    assert specs.parse_prompt_spec(f"{place}:test") == spec(place, None, "test")
    assert specs.parse_prompt_spec(f"{place}:et:test") == spec(place, "et", "test")
    assert specs.parse_validation_spec(f"a:{place}:et,b:{place}") == [("a", f"{place}:et"), ("b", place)]
    with pytest.raises(ValueError):
        specs.parse_prompt_spec(place)


def test_validation_addresses_need_names():
    with pytest.raises(ValueError):
        specs.parse_validation_spec("s3a://bucket/a,s3a://bucket/b")


def test_folders_and_lines_are_told_apart(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", "de") for i in range(10)], "doc_id long, text string, lang string")
    rows.write.parquet(str(tmp_path / "bare"))
    assert readers.read_source(spark, str(tmp_path / "bare")).count() == 10
    assert readers.read_source(spark, f"file:{tmp_path}/bare:de").count() == 10
    assert readers.read_source(spark, f"file:{tmp_path}/bare:fr").count() == 0
    lines = tmp_path / "r.jsonl"
    lines.write_text("".join(f'{{"text": "t{i}"}}\n' for i in range(10)))
    assert readers.read_source(spark, str(lines)).count() == 10
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "one.json").write_text('[{"text": "a"}, {"text": "b"}]')
    assert readers.read_source(spark, f"file:{folder}").count() == 2


@pytest.mark.parametrize("block", ["40", "700", "134217728"])
def test_json_arrays_in_blocks(spark, tmp_path, block):
    rng = random.Random(3)
    odd = ["}", "{", "[", "]", '"', "\\", '\\"', "\n", "õ", "},{", "]}", "long " * 20, ""]
    records = [{"id": i, "t": "".join(rng.choice(odd) for _ in range(i % 9)), "n": {"x": [{"y": i}]}} for i in range(40)]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "b.json").write_text("\ufeff " + json.dumps(records, ensure_ascii=False) + "\n", encoding="utf-8")
    (tmp_path / "none.json").write_text(" [ ]\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for path, times in ((tmp_path / "a.json", 1), (tmp_path, 2)):
            got = readers.read_json_records(spark, str(path), "id long, t string, n struct<x: array<struct<y: long>>>").collect()
            assert sorted((r.id, r.t, r.n.x[0].y) for r in got) == sorted([(r["id"], r["t"], r["id"]) for r in records] * times)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(
    "text",
    ['[{"a": 1}, {"a": 2}]\n[{"a": 3}]', '{"a": 1}\n{"a": 2}', '[{"a": 1}', '[1, {"a": 1}]', '[{"a": 1} {"a": 2}]', '[{"a": 1}]]',
     '[{"a": 1}] x', '[{"a": 1},]', '[{"a": "}]'],
)
def test_json_that_is_not_one_array(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(ValueError, match="not one JSON array"):
        readers.read_json_records(spark, str(tmp_path / "bad.json"), "a int")


def test_written_predictions_are_a_source(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", "c")] * 3, "input string, raw_output string, output string")
    writers.write_predictions_json(df, str(tmp_path / "out"))
    got = readers.read_source(spark, str(tmp_path / "out"))
    assert got.select(df.columns).exceptAll(df).count() == 0 and got.count() == 3


def test_prompt_formats(spark, tmp_path):
    assert specs.load_prompt_format() == DEFAULT_PROMPTS
    own = {"prompt_input": "{input}->{instruction}:", "prompt_no_input": "{instruction}:"}
    assert specs.load_prompt_format(spark, put(tmp_path / "p.json", own)) == own
    with pytest.raises(ValueError):
        specs.load_prompt_format(spark, put(tmp_path / "q.json", {"prompt_input": ""}))


@pytest.fixture
def corpus(spark):
    rows = [(i, "de" if i % 3 else "en", "validation" if i % 5 == 0 else "train", "text " * (i + 1)) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, lang string, split string, text string").createOrReplaceTempView("corpus")
    return "corpus"


def test_datasets_and_pushdown(spark, corpus, tmp_path):
    assert readers.read_dataset(spark, corpus, "de", "train").count() == 16
    path = str(tmp_path / "t.parquet")
    spark.table(corpus).drop("split").write.parquet(path)
    assert readers.read_dataset(spark, path, "en").count() == 10
    with pytest.raises(ValueError, match="no split column"):
        readers.read_dataset(spark, path, split="test")
    laid_out = str(tmp_path / "laid_out")
    spark.table(corpus).write.partitionBy("lang", "split").parquet(laid_out)
    scan = readers.read_dataset(spark, laid_out, "de", "train").select("text")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan and scan.count() == 16
    scans = readers.scan_raw_text(spark, f"{path}:de,{path}:en,{path}:de")
    assert list(scans) == ["t:de", "t:en", "t:de#2"]
    plan = scans["t:de"]._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,de)" in plan and "[doc_id#" in plan and "n_chars" not in plan


def test_validation_sets(spark, corpus):
    sets = readers.read_validation_sets(spark, "a:corpus:de,b:corpus")
    assert {n: d.count() for n, d in sets.items()} == {"a": 4, "b": 6}
    assert {r.eval_name: r.n_examples for r in readers.dataset_info(sets).collect()} == {"a": 4, "b": 6}
    assert list(readers.read_validation_sets(spark, "corpus:de")) == [None]
    assert readers.dataset_info(spark.table(corpus)).first().n_examples == 30


def test_sinks(spark, tmp_path):
    rows = [(i, f"in{i}", "a\nõ", f"out {i}" if i else "") for i in range(20)]
    df = spark.createDataFrame(rows, "k int, input string, raw_output string, output string").repartition(4)
    writers.write_predictions_json(df.drop("k"), str(tmp_path / "j"))
    assert spark.read.schema(schemas.PREDICTIONS).json(str(tmp_path / "j")).exceptAll(df.drop("k")).count() == 0
    writers.write_predictions_text(df, str(tmp_path / "t"), "k")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*"))).split("\n")
    assert lines == [r[3] for r in rows] + [""]
    with pytest.raises(ValueError, match="missing columns"):
        writers.write_predictions_json(df.drop("output"), str(tmp_path / "x"))
    assert writers.materialize(df, str(tmp_path / "m")).count() == 20


def test_build_dataset(spark, corpus, tmp_path):
    options = DatasetOptions(max_seq_length=64)
    records = put(tmp_path / "i.json", [{"instruction": "a", "output": "b"}])
    row = build_dataset(spark, "alpaca", records, TOK, options).first()
    assert len(row.input_ids) == 64
    loose = DatasetOptions(max_seq_length=512, disable_padding=True)
    assert 64 < len(build_dataset(spark, "alpaca", records, TOK, loose).first().input_ids) < 512
    chats = put(tmp_path / "c.json", [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}])
    with pytest.raises(ValueError, match="padded per batch"):
        build_dataset(spark, "chat", chats, TOK, options)
    chat = build_dataset(spark, "chat", chats, TOK, DatasetOptions(use_dynamic_padding=True)).first()
    assert -100 in chat.labels and chat.labels[-1] == TOK.eos_id
    packed = build_dataset(spark, "culturax", "corpus:de,corpus:en", TOK, DatasetOptions(max_seq_length=64, interleave_probs="0.5,0.5"))
    assert packed.select(F.size("input_ids")).distinct().collect()[0][0] == 64 and "chunk_pos" in packed.columns
    stored = DatasetOptions(max_seq_length=64, materialize_to=str(tmp_path / "packed"))
    one = build_dataset(spark, "culturax", "corpus", TOK, stored)
    again = build_dataset(spark, "pretokenized", str(tmp_path / "packed"), TOK)
    assert again.exceptAll(one).count() == 0 and again.count() > 0
    named = build_validation(spark, "culturax", "x:corpus:de,y:corpus:en", TOK, DatasetOptions(max_seq_length=16))
    assert list(named) == ["x", "y"] and "chunk_pos" not in named["x"].columns
    with pytest.raises(ValueError, match="Unknown dataset type"):
        build_dataset(spark, "other", "corpus", TOK)


def test_build_prompts(spark):
    df = spark.createDataFrame([("7", "do", "in")], "id string, instruction string, input string")
    row = build_prompts(spark, df, "alpaca", task="EstQA").first()
    assert row.ids == "7" and "### Input:\nin" in row.prompts
    assert build_prompts(spark, df, "alpaca").columns == ["prompts"]
    with pytest.raises(NotImplementedError):
        build_prompts(spark, df, "alpaca", task="estqa", prompt_format_path="x")
    with pytest.raises(ValueError, match="Unknown task"):
        build_prompts(spark, df, "alpaca", task="other")
    with pytest.raises(ValueError, match="Invalid input format"):
        build_prompts(spark, df, "other")
    texts = spark.createDataFrame([("t",)], "text string")
    assert build_prompts(spark, texts, "simple").first().prompts == "t"
    chats = spark.createDataFrame([([(0, "user", "hi")],)], schemas.CHAT)
    for kind in ("chat", "hfchat"):
        assert build_prompts(spark, chats, kind).first().prompts == "<|user|>\nhi\n<|assistant|>\n"


def test_lines_of_records_are_not_an_array(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(10).selectExpr("cast(id as string) AS input", "'r' AS raw_output", "'o' AS output").write.json(path)
    assert readers.read_json_lines(spark, path).count() == 10
    with pytest.raises(ValueError, match="read_json_lines"):
        readers.read_json_records(spark, path)


def test_rows_are_numbered_as_they_were_written(spark, tmp_path):
    df = spark.range(5000).withColumn("_start", F.lit("clash")).repartition(7, F.xxhash64("id"))
    path = str(tmp_path / "sorted")
    df.orderBy(F.xxhash64("id")).write.option("maxRecordsPerFile", 400).parquet(path)
    got = {r.id: r.place for r in readers.read_in_order(spark, path).collect()}
    want = [r.id for r in spark.range(5000).orderBy(F.xxhash64("id")).collect()]
    assert [got[i] for i in want] == list(range(5000))
    with pytest.raises(ValueError, match="already"):
        readers.read_in_order(spark, path, "id")


def test_mix_is_stored_in_step_order(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 9), "ab"[i % 2]) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "docs"))
    tok = TOK
    options = DatasetOptions(max_seq_length=32, num_sequences=4, order_key="doc_id", shuffle_packed=False)
    one = build_dataset(spark, "culturax", f"{tmp_path}/docs:a", tok, options)
    two = build_dataset(spark, "culturax", f"{tmp_path}/docs:a,{tmp_path}/docs:b", tok, options)
    assert 0 < one.count() < two.count() and two.where(F.size("input_ids") != 32).count() == 0
    assert any("/stored-" in f for f in two.inputFiles()) and not any("/docs" in f for f in two.inputFiles())


def test_windows_over_pieces_carry_one_text(spark, tmp_path):
    """A piece passes the windows as it is, without the copy that its numbers are told from."""
    from lmprep.sources.json_arrays import json_array_lines

    (tmp_path / "a.json").write_text('[{"a": "}"}, {"a": 2}]')
    found = json_array_lines(spark, str(tmp_path / "a.json"))
    assert [r.value for r in found.collect()] == ['{"a": "}"}', '{"a": 2}']

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    windows = [n.output().mkString(" ") for n in nodes(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    assert windows and not any("bare#" in w for w in windows)
