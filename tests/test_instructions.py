import models
import pytest
from pyspark.sql import functions as F

from lmprep.functions.templates import (
    DEFAULT_PROMPTS, READING_CHOICES, TOPICS, has_input, instruction_example, instruction_prompt, language_name,
    render_slots, render_template, render_translation_prompt, target_index, decontamination_query, render_topic_prompt,
)
from lmprep.functions.tokenizers import CodepointTokenizer
from lmprep.operators.labels import mask_instruction_labels

TOK = CodepointTokenizer()


def reference_prompt(record):
    chosen = "prompt_no_input" if record.get("input", "") == "" else "prompt_input"
    return DEFAULT_PROMPTS[chosen].format_map(record)


def test_prompts(spark):
    records = [
        {"instruction": "a {b} %s", "input": "x", "output": "o"},
        {"instruction": " i ", "input": "", "output": "o"},
        {"instruction": "$1 \\n", "input": " ", "output": "{input}"},
        {"instruction": "n", "input": None, "output": "o"},
    ]
    df = spark.createDataFrame([(r["instruction"], r["input"], r["output"]) for r in records], "instruction string, input string, output string")
    got = df.select(instruction_prompt(df, py_null=True), instruction_example(df, py_null=True)).collect()
    for row, record in zip(got, records):
        assert row[0] == reference_prompt(record)
        assert row[1] == reference_prompt(record) + record["output"]
    assert [r[0] for r in df.select(has_input(df)).collect()] == [True, False, True, False]
    bare = df.drop("input")
    assert bare.select(instruction_prompt(bare)).first()[0] == reference_prompt({"instruction": "a {b} %s"})


def test_template_forms(spark):
    df = spark.createDataFrame([("v　", 3)], "a string, n int")
    assert df.select(render_template("{{x}} {a}|{n}%d", df)).first()[0] == "{x} v　|3%d"
    assert df.select(render_slots("[{{a.strip()}}|{{ n }}] {n}", df)).first()[0] == "[v|3] {n}"
    with pytest.raises(KeyError):
        render_template("{missing}", df)
    with pytest.raises(ValueError):
        render_template("{n:>5}", df)


def test_targets_and_names(spark):
    df = spark.createDataFrame([("2",), ("4",)], "g string")
    assert [r[0] for r in df.select(target_index(F.col("g"), ("1", "2", "3", "4"))).collect()] == [1, 3]
    with pytest.raises(Exception, match="label is not a choice: [24]"):
        df.select(target_index(F.col("g"), READING_CHOICES)).collect()
    names = spark.createDataFrame([("vro_Latn",), ("xx",)], "c string").select(language_name(F.col("c"))).collect()
    assert [r[0] for r in names] == ["Võro", None]
    pair = spark.createDataFrame([("hello", "tere")], "sentence_eng_Latn string, sentence_est_Latn string")
    assert pair.select(render_translation_prompt(pair, "eng_Latn", "est_Latn")).first()[0] == "English: hello\nEstonian:"
    assert pair.select(decontamination_query(pair, "translation", "eng_Latn", "est_Latn")).first()[0] == "hello\ttere"
    topic = spark.createDataFrame([(" s ",)], "sentence string")
    expected = "Topic Classification: science/technology, travel, politics, sports, health, entertainment, geography.\n\nThe label of [s] is"
    assert topic.select(render_topic_prompt(topic)).first()[0] == expected and len(TOPICS) == 7


def model_triple(prompt, output, limit, padding):
    ids = models.encode(prompt + output)[:limit]
    n = len(models.encode(prompt)[:limit])
    if len(ids) < limit:
        ids.append(2)
    real = len(ids)
    labels = [-100] * min(n, real) + ids[n:]
    fill = limit - real if padding else 0
    return ids + [0] * fill, labels + [-100] * fill, [1.0] * real + [0.0] * fill


@pytest.mark.parametrize("padding", [True, False])
def test_instruction_labels(spark, padding):
    limit = 16
    cases = [("p" * i, "o" * j) for i in (0, 3, 15, 16, 20) for j in (0, 1, 11, 12, 13, 30)] + [("a</s>b", "c</s>")]
    df = spark.createDataFrame(cases, "prompt string, output string").coalesce(1)
    got = mask_instruction_labels(df, TOK, limit, padding=padding).collect()
    for row, (prompt, output) in zip(got, cases):
        assert (row.input_ids, row.labels, row.attention_mask) == model_triple(prompt, output, limit, padding)
    assert df.sparkSession.createDataFrame([("p", "o")], "prompt string, output string").transform(
        lambda d: mask_instruction_labels(d, TOK, limit)
    ).schema["attention_mask"].dataType.simpleString() == "array<float>"
