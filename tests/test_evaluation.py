import pytest
from pyspark.sql import functions as F

from lmprep.operators.decontaminate import _bloom_filter, contaminated_keys, decontaminate
from lmprep.operators.fewshot import add_fewshot
from lmprep.operators.pairs import add_reverse, language_pairs, pair_sentences
from lmprep.plans.evaltasks import build_eval_tasks, build_language_tasks, read_eval_docs


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def corpus(spark):
    return spark.createDataFrame(
        [
            (0, words(0, 40)),
            (1, "intro " + words(100, 113) + " outro"),
            (2, words(100, 112) + " other"),
            (3, "W100, w101. (w102) " + words(103, 113).upper()),
            (4, "short"),
            (5, ""),
        ],
        "doc_id int, text string",
    )


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_planted_copies_are_found_both_ways(spark, limit):
    train, queries = corpus(spark), spark.createDataFrame([(words(100, 120),), ("tiny",)], "query string")
    assert {r.doc_id for r in contaminated_keys(train, queries, limit=limit).collect()} == {1, 3}
    assert {r.doc_id for r in decontaminate(train, queries, limit=limit).collect()} == {0, 2, 4, 5}
    assert {r.doc_id for r in decontaminate(train, queries, limit=limit, mode="only").collect()} == {1, 3}
    flags = {r.doc_id: r.contaminated for r in decontaminate(train, queries, limit=limit, mode="flag").collect()}
    assert flags == {i: i in (1, 3) for i in range(6)}
    assert {r.doc_id for r in contaminated_keys(train, queries, n=12, limit=limit).collect()} == {1, 2, 3}
    with pytest.raises(ValueError):
        decontaminate(train, queries, mode="other")


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_short_queries_are_found_as_whole_phrases(spark, limit):
    train = corpus(spark).union(spark.createDataFrame([(6, "so w1 W2, w3 w4 w5"), (7, "w1 w2 w3 w4 w55"), (8, None)], "doc_id int, text string"))
    queries = spark.createDataFrame([("w1 w2 w3 w4 w5",), ("w9 w1",), (words(100, 113),), (None,), ("",)], "query string")
    found = lambda **x: {r.doc_id for r in contaminated_keys(train, queries, limit=limit, **x).collect()}
    assert found() == {1, 3} and found(min_words=5) == {0, 1, 3, 6} and found(min_words=6) == {1, 3}
    assert contaminated_keys(train, queries.where("false"), limit=limit, min_words=1).count() == 0
    assert contaminated_keys(train.where("false"), queries, limit=limit, min_words=1).count() == 0


def test_few_hashes_pass_the_filter(spark):
    hashes = spark.range(2000).select(F.xxhash64("id").alias("hash"))
    passes = _bloom_filter(hashes, 2000)
    assert hashes.where(passes(F.col("hash"))).count() == 2000
    others = spark.range(10_000, 60_000).select(F.xxhash64("id").alias("hash"))
    assert others.where(passes(F.col("hash"))).count() < 1500


def test_pairs_and_tasks(spark):
    src = ["eng_Latn", "est_Latn", "rus_Cyrl"]
    tgt = ["vro_Latn", "liv_Latn", "kpv_Cyrl", "est_Latn", "fin_Latn"]
    one_way = language_pairs(spark.createDataFrame([(src, tgt)], "src_langs array<string>, tgt_langs array<string>"))
    both = add_reverse(one_way)
    assert (one_way.count(), both.count(), both.distinct().count()) == (14, 28, 28)
    tasks = {r.task: r for r in build_eval_tasks(both, {"dataset_path": "pairs", "group": "flores_x"}).collect()}
    assert len(tasks) == 28
    t = tasks["flores_x_eng_Latn-vro_Latn"]
    assert t.prompt_template == "English: {{sentence_eng_Latn}}\nVõro:"
    assert t.decontamination_query == "{{sentence_eng_Latn}}\t{{sentence_vro_Latn}}"
    assert (t.target_template, t.dataset_name, t.group) == ("{{sentence_vro_Latn}}", "eng_Latn-vro_Latn", "flores_x")
    assert (t.test_split, t.metrics, t.should_decontaminate, t.dataset_path) == ("devtest", "chrf,bleu", True, "pairs")
    langs = spark.createDataFrame([("vro_Latn",)], "lang string")
    reading = build_language_tasks(langs, "reading").first()
    assert (reading.task, reading.fewshot_split, reading.sampler) == ("belebele_vro_Latn", "test", "first_n")
    topic = build_language_tasks(langs, "topic", {"dataset_path": "topics"}).first()
    assert (topic.task, topic.fewshot_split, topic.sampler) == ("sib200_vro_Latn", "validation", None)


def test_eval_docs(spark):
    spark.createDataFrame(
        [("vro", "test", 1), ("vro", "validation", 2), ("liv", "test", 3)], "lang string, split string, id int"
    ).createOrReplaceTempView("eval_table")
    task = {"dataset_path": "eval_table", "dataset_name": "vro", "test_split": "test", "fewshot_split": "validation"}
    test, pool = read_eval_docs(spark, task, ["id"])
    assert ([r.id for r in test.collect()], [r.id for r in pool.collect()]) == ([1], [2])
    same, again = read_eval_docs(spark, {**task, "fewshot_split": None}, ["id"])
    assert same.collect() == again.collect()


def test_fewshot(spark):
    df = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(6)], "id int, prompt string, target string")
    got = {r.id: r.fewshot_prompt for r in add_fewshot(df, df, 2, "id").collect()}
    assert got[5] == "q0 a0\n\nq1 a1\n\nq5"
    assert got[0] == "q1 a1\n\nq2 a2\n\nq0"
    assert got[1] == "q0 a0\n\nq2 a2\n\nq1"
    assert {r.fewshot_prompt for r in add_fewshot(df, df, 0, "id").collect()} == {f"q{i}" for i in range(6)}
    few = {r.id: r.fewshot_prompt for r in add_fewshot(df, df.where("id < 1"), 3, "id").collect()}
    assert few[0] == "q0" and few[3] == "q0 a0\n\nq3"
    seeded = {r.id: r.fewshot_prompt for r in add_fewshot(df, df, 2, "id", sampler="seeded", seed=1).collect()}
    assert all(p.count("\n\n") == 2 and f"q{i} a{i}" not in p for i, p in seeded.items())
    with pytest.raises(ValueError):
        add_fewshot(df, df, 1, "id", sampler="other")


def test_parallel(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "item int, text string")
    b = a.select("item", F.upper("text").alias("text"))
    got = pair_sentences(a, b, "item", names=("en", "de")).orderBy("item").collect()
    assert [(r.sentence_en, r.sentence_de) for r in got] == [("x", "X"), ("y", "Y")]


def test_fewshot_from_another_split(spark):
    pool = spark.createDataFrame([(i, f"p{i}", f"a{i}") for i in range(5)], "id int, prompt string, target string")
    docs = spark.createDataFrame([(0, "q0", ""), (1, "q1", ""), (9, "q9", ""), (None, "qn", "")], "id int, prompt string, target string")
    got = {r.fewshot_prompt for r in add_fewshot(docs, pool, 2, "id", pool_is_test=False).collect()}
    assert got == {f"p0 a0\n\np1 a1\n\n{q}" for q in ("q0", "q1", "q9", "qn")}
    own = {r.id: r.fewshot_prompt for r in add_fewshot(docs, pool, 1, "id").collect()}
    assert own[0].startswith("p1") and own[None].startswith("p0")
