import models
import pytest
from pyspark.sql import functions as F

from lmprep.functions.tokenizers import (
    CodepointTokenizer, ModelTokenizer, SentencePieceLoader, decode, special_token_policy, token_count, tokenize,
)
from lmprep.operators.inference import generate, postprocess
from lmprep.operators.labels import mask_chat_labels, mask_instruction_labels
from lmprep.operators.packing import pack_sequences

TOK = CodepointTokenizer()
TEXTS = ["", "abc", "é😀 ﻿z", "﻿", "x</s>y<s>", "</s</s>", "<</s>>", "a\nb\x00c", "<s", "\U0010ffff"]


@pytest.mark.parametrize("max_len", [None, 1, 3, 100])
def test_codepoints(spark, max_len):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").coalesce(1)
    got = df.select(tokenize(F.col("t"), TOK, max_len), token_count(F.col("t"), TOK, max_len)).collect()
    for row, text in zip(got, TEXTS):
        assert row[0] == models.encode(text)[:max_len] and row[1] == len(row[0])
    assert got[-1][0] is None


def test_decode_drops_specials(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1)
    got = [r[0] for r in df.select(decode(tokenize(F.col("t"), TOK), TOK)).collect()]
    assert got == [t.replace("</s>", "").replace("<s>", "") for t in TEXTS]


def test_special_ids():
    assert special_token_policy(2, 5, 100) == {"pad_id": 5, "concat_id": 2}
    assert special_token_policy(None, None, 100, new_pad=True) == {"pad_id": 100, "concat_id": 0}
    assert special_token_policy(0, None, 100, default_concat=9) == {"pad_id": 0, "concat_id": 9}


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    import sentencepiece

    folder = tmp_path_factory.mktemp("sp")
    lines = folder / "lines.txt"
    lines.write_text("\n".join(f"the quick brown fox {i} jumps over user assistant system dogs" for i in range(300)))
    sentencepiece.SentencePieceTrainer.train(
        input=str(lines), model_prefix=str(folder / "m"), vocab_size=60, byte_fallback=False, hard_vocab_limit=False
    )
    loader = SentencePieceLoader(str(folder / "m.model"))
    ready = SentencePieceLoader(loader.path)()
    return ModelTokenizer(loader, "</s>", ready.model.eos_id(), ready.model.bos_id()), ready


def test_model_tokenizer(spark, model):
    tok, ready = model
    texts = ["the fox", "jumps</s>over", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = df.select(tok.encode(F.col("t")), tok.count(F.col("t"), 3), tok.decode(tok.encode(F.col("t")))).collect()
    for row, text in list(zip(got, texts))[:3]:
        assert row[0] == ready.encode([text])[0] and row[1] == min(3, len(row[0]))
    assert ready.model.eos_id() in got[1][0] and got[0][2] == "the fox" and got[3][0] is None


@pytest.mark.parametrize("limit", [6, 25, 200])
def test_model_labels_by_prefixes(spark, model, limit):
    tok, ready = model
    cases = [
        [("system", "quick"), ("user", "the fox "), ("assistant", "jumps"), ("user", "over"), ("assistant", "dogs")],
        [("assistant", "brown"), ("assistant", "fox"), ("user", "")],
        [("user", "the")],
    ]
    rows = [(i, [(t, r, c) for t, (r, c) in enumerate(m)]) for i, m in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, messages array<struct<turn:bigint,role:string,content:string>>")
    enc = lambda text: ready.encode([text])[0]
    for row in mask_chat_labels(df, tok, limit).collect():
        assert (row.input_ids, row.labels) == models.chat_labels(cases[row.i], limit, enc)


def test_model_packing_and_instructions(spark, model):
    tok, ready = model
    texts = [f"the quick fox {i}" * (i % 4) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pack_sequences(df, tok, 8, num_sequences=4, chars_per_token=2.0)
    enc = lambda text: ready.encode([text])[0]
    want = models.chunks(texts, 8, 64, enc, ready.model.eos_id())
    assert {(r.buffer_id, r.chunk_id): tuple(r.input_ids) for r in got.collect()} == want
    row = mask_instruction_labels(spark.createDataFrame([("the", " fox")], "prompt string, output string"), tok, 32).first()
    n = len(enc("the"))
    assert row.labels[:n] == [-100] * n and row.labels[n] == row.input_ids[n] and len(row.labels) == 32


class Shouting:
    """Stand-in model with a load hook."""

    def load(self):
        self.suffix = "!"

    def __call__(self, prompts, max_new_tokens, **options):
        assert len(prompts) <= 3 and options["top_k"] == 50
        return [p.upper()[:max_new_tokens] + self.suffix for p in prompts]


def test_generate(spark):
    df = spark.createDataFrame([(i, f"prompt {i}") for i in range(10)], "i int, prompts string").coalesce(1)
    got = generate(df, Shouting(), batch_size=3, max_new_tokens=6).orderBy("i").collect()
    assert [r.raw_output for r in got] == ["PROMPT!"] * 10
    with pytest.raises(Exception, match="one output per prompt"):
        generate(df, lambda prompts, **_: ["x"], batch_size=3).collect()


def test_postprocess(spark):
    ids = models.encode("in put")
    rows = [("in put", [0, 0, *ids, *models.encode(" a \n b ", False), 2, 0], len(ids) + 2)]
    df = spark.createDataFrame(rows, "prompts string, generated array<int>, prompt_len int")
    row = postprocess(df, TOK).first()
    assert (row.input, row.raw_output, row.output) == ("in put", " a \n b ", "a b")
