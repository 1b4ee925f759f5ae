import random

import models
import pytest
from pyspark.sql import functions as F

from lmprep.functions import chat
from lmprep.functions.tokenizers import CodepointTokenizer
from lmprep.operators.conversations import messages_from_turns
from lmprep.operators.labels import mask_chat_labels
from lmprep.operators.validation import validate_nonempty, validate_roles, validate_turns

TOK = CodepointTokenizer()
SCHEMA = "i int, messages array<struct<turn:bigint,role:string,content:string>>"


def frame(spark, conversations):
    rows = [(i, [(t, r, c) for t, (r, c) in enumerate(m)]) for i, m in enumerate(conversations)]
    return spark.createDataFrame(rows, SCHEMA)


CASES = [
    [("user", " \thi　"), ("assistant", "\nyo ")],
    [("system", "be"), ("user", "a"), ("assistant", "b"), ("user", "")],
    [("assistant", "first"), ("user", "u")],
    [("user", "x"), ("assistant", "1"), ("assistant", "2")],
    [("user", "x"), ("user", "y"), ("assistant", "😀 z")],
    [("user", "say </s> and <s> now"), ("assistant", "</s>")],
    [("user", "   "), ("assistant", "")],
    [("system", "only")],
]


def test_rendering(spark):
    df = frame(spark, CASES)
    got = df.select(
        "i", chat.render_chat(F.col("messages")), chat.chat_training_text(F.col("messages")), chat.chat_generation_prompt(F.col("messages"))
    ).orderBy("i").collect()
    for row, case in zip(got, CASES):
        text = models.render(case)
        assert (row[1], row[2], row[3]) == (text, text.strip(), text + "<|assistant|>\n")


def test_prefixes(spark):
    got = frame(spark, CASES[1:2]).select(F.explode(chat.chat_prefixes(F.col("messages"))).alias("p")).select("p.*").collect()
    case = CASES[1]
    assert [r.text for r in got] == [models.render(case[: i + 1]) for i in range(4)]
    assert [r.text_to_answer.endswith("<|assistant|>\n") for r in got] == [False, True, False, False]


def test_templates(spark):
    df = frame(spark, CASES[:1])
    same = df.select(chat.apply_chat_template(F.col("messages"), chat.CHAT_TEMPLATES["headers"]), chat.chat_generation_prompt(F.col("messages"))).first()
    assert same[0] == same[1]
    with pytest.raises(Exception, match="No layout for role"):
        frame(spark, [[("tool", "x")]]).select(chat.apply_chat_template(F.col("messages"), chat.CHAT_TEMPLATES["chatml"])).collect()


def random_conversations(n, seed):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant"]
    pieces = ["", " ", "a", "bc\n", "</s>", "<s>x", "é😀", "longer text here", "　z\t"]
    return [
        [(rng.choice(roles), "".join(rng.choices(pieces, k=rng.randint(0, 4)))) for _ in range(rng.randint(1, 7))]
        for _ in range(n)
    ]


@pytest.mark.parametrize("limit", [1, 9, 17, 40, 400])
def test_labels_equal_prefix_rule(spark, limit):
    cases = CASES + random_conversations(300, limit)
    got = mask_chat_labels(frame(spark, cases), TOK, limit).orderBy("i").collect()
    for row, case in zip(got, cases):
        ids, labels = models.chat_labels(case, limit)
        assert row.input_ids == ids, case
        assert row.labels == labels, case
        assert row.attention_mask == [1] * len(ids)


def test_labels_at_span_ends(spark):
    case = [("user", "abc"), ("assistant", "de"), ("user", "f"), ("assistant", "g")]
    ends = [len(models.encode(models.render(case[:i]) + h)) for i in range(1, 5) for h in ("", "<|assistant|>\n")]
    for limit in sorted({end + d for end in ends for d in (-1, 0, 1)})[::2]:
        row = mask_chat_labels(frame(spark, [case]), TOK, limit).first()
        assert (row.input_ids, row.labels) == models.chat_labels(case, limit)


def test_first_turns_suffice_for_a_cut_row(spark):
    turns = [(0, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(500)] + [(1, 0, "user", "u")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").repartition(5)
    whole = mask_chat_labels(messages_from_turns(df), TOK, 64).drop("messages")
    bounded = messages_from_turns(df, max_len=64)
    assert bounded.select(F.max(F.size("messages"))).first()[0] == 64
    assert mask_chat_labels(bounded, TOK, 64).drop("messages").exceptAll(whole).count() == 0


def test_hot_conversation_is_dealt_out_before_the_cut(spark):
    turns = [(0, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(5000)] + [(1, 0, "user", "u"), (None, 3, "user", "n")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").repartition(5)
    bounded = messages_from_turns(df, max_len=2048, check_roles=True)
    got = {r.conv_id: [m.turn for m in r.messages] for r in bounded.collect()}
    assert got == {0: list(range(2048)), 1: [0], None: [3]}
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(conv_id" in plan and "_salt" in plan.split("hashpartitioning(conv_id")[1]
    late = df.union(spark.createDataFrame([(0, 9000, "moderator", "x")], df.schema))
    with pytest.raises(Exception, match="Invalid role"):
        messages_from_turns(late, max_len=2048, check_roles=True).collect()


BAD = [[("user", "a")], [("moderator", "x"), ("user", "y")], [], [(None, "x")]]


def test_validation(spark):
    df = frame(spark, BAD)
    assert [r.i for r in validate_roles(df, "quarantine").orderBy("i").collect()] == [1, 3]
    assert [r.i for r in validate_roles(df, "keep").orderBy("i").collect()] == [0, 2]
    assert [r.i for r in validate_nonempty(df, "quarantine").collect()] == [2]
    assert [r.invalid for r in validate_roles(df, "flag").orderBy("i").collect()] == [False, True, False, True]
    with pytest.raises(Exception, match="Invalid role"):
        validate_roles(df).collect()
    with pytest.raises(Exception, match="messages field is empty"):
        validate_nonempty(df).collect()
    with pytest.raises(Exception, match="Invalid role"):
        df.where("i = 1").select(chat.render_chat(F.col("messages"))).collect()
    with pytest.raises(ValueError):
        validate_roles(df, "other")


def test_turn_validation(spark):
    df = spark.createDataFrame([(0, "user"), (0, "x"), (1, "user"), (2, None)], "conv_id int, role string")
    assert {r.conv_id: r.invalid for r in validate_turns(df, ["conv_id"]).collect()} == {0: True, 1: False, 2: True}
    assert [r.conv_id for r in validate_turns(df, ["conv_id"], mode="keep").collect()] == [1]
