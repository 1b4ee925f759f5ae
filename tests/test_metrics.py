import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lmprep.operators.metrics import accuracy, accuracy_norm, corpus_bleu, corpus_chrf, group_scores, tokenize_13a


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "grp string, prediction string, target string")


def counts(units, n):
    return Counter(tuple(units[i : i + n]) for i in range(len(units) - n + 1))


def bleu(pairs):
    m, t, c, r = [0] * 4, [0] * 4, 0, 0
    for p, g in pairs:
        p, g = (p or "").split(), (g or "").split()
        c, r = c + len(p), r + len(g)
        for n in range(1, 5):
            a, b = counts(p, n), counts(g, n)
            m[n - 1] += sum((a & b).values())
            t[n - 1] += sum(a.values())
    if not any(m) or not all(t):
        return 0.0
    logs, k = 0.0, 0
    for x, n in zip(m, t):
        k += x == 0
        logs += math.log(x / n if x else 1 / (2**k * n))
    return 100 * (1 if c > r else math.exp(1 - r / c)) * math.exp(logs / 4)


def chrf(pairs):
    sums = [[0, 0, 0] for _ in range(6)]
    for p, g in pairs:
        p, g = "".join((p or "").split()), "".join((g or "").split())
        for n in range(1, 7):
            a, b = counts(p, n), counts(g, n)
            for i, v in enumerate((sum((a & b).values()), sum(a.values()) if b else 0, sum(b.values()))):
                sums[n - 1][i] += v
    used = [(m / p, m / t) for m, p, t in sums if p and t]
    if not used:
        return 0.0
    pr, re = (sum(x) / len(used) for x in zip(*used))
    return 100 * 5 * pr * re / (4 * pr + re) if pr + re else 0.0


CASES = {
    "same": [("the cat sat on the mat", "the cat sat on the mat")],
    "none": [("aa bb cc dd", "xx yy zz ww")],
    "empty": [("", "something here"), (None, "x")],
    "short": [("one two", "one two three")],
    "clip": [("the the the the the the the", "the cat is on the mat")],
    "mixed": [("a b c d e f", "a b c x e f"), ("g h i j", "g h i j k"), ("", "q")],
}


def test_against_counts(spark):
    rng = random.Random(4)
    cases = dict(CASES)
    for i in range(20):
        cases[f"r{i}"] = [
            (" ".join(rng.choices("abcde", k=rng.randint(0, 9))), " ".join(rng.choices("abcde", k=rng.randint(0, 9))))
            for _ in range(rng.randint(1, 4))
        ]
    df = frame(spark, [(g, p, t) for g, pairs in cases.items() for p, t in pairs]).repartition(5)
    got_bleu = {r.grp: r.bleu for r in corpus_bleu(df, ["grp"]).collect()}
    got_chrf = {r.grp: r.chrf for r in corpus_chrf(df, ["grp"]).collect()}
    for g, pairs in cases.items():
        assert got_bleu[g] == pytest.approx(bleu(pairs), abs=1e-9), g
        assert got_chrf[g] == pytest.approx(chrf(pairs), abs=1e-9), g


def test_goldens_worked_by_hand(spark):
    one = corpus_bleu(frame(spark, [("g", "a b c d e", "a b c d f")])).first().bleu
    # matches 4/5, 3/4, 2/3, 1/2; equal lengths, so no penalty
    assert one == pytest.approx(100 * (4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25)
    short = corpus_bleu(frame(spark, [("g", "a b c d", "a b c d e f g h")])).first().bleu
    assert short == pytest.approx(100 * math.exp(1 - 8 / 4))
    # order 1: 2/3 and 2/3; order 2: 1/2 and 1/2; order 3: 0
    c = corpus_chrf(frame(spark, [("g", "ab x", "ab y")])).first().chrf
    mean = (2 / 3 + 1 / 2 + 0) / 3
    assert c == pytest.approx(100 * mean)
    assert corpus_chrf(frame(spark, [("g", "same", "same")])).first().chrf == pytest.approx(100)


def test_13a(spark):
    texts = ["Hello, world!", "1,000.5 and x.y", "a-b 3-4", "say &quot;hi&quot; &amp; go", "end-\nline\nnext", "it's (ok)/fine"]
    want = [
        ["Hello", ",", "world", "!"], ["1,000.5", "and", "x", ".", "y"], ["a-b", "3", "-", "4"],
        ["say", '"', "hi", '"', "&", "go"], ["endline", "next"], ["it's", "(", "ok", ")", "/", "fine"],
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(tokenize_13a(F.col("t"))).collect()] == want


def test_accuracy_ties_and_length(spark):
    rows = [
        ("t", 1, 0, "aa", -2.0, 0), ("t", 1, 1, "b", -2.0, 0),  # tie: lowest index; by length: index 0 as well
        ("t", 2, 0, "a", -2.0, 1), ("t", 2, 1, "bbbb", -4.0, 1),  # raw picks 0, per character 1
        ("u", 3, 0, "a", -1.0, 1), ("u", 3, 1, "b", -1.0, 1),
    ]
    df = spark.createDataFrame(rows, "task string, item_id int, choice_idx int, choice string, loglik double, gold int")
    assert {r.task: r.acc for r in accuracy(df.repartition(3)).collect()} == {"t": 0.5, "u": 0.0}
    assert {r.task: r.acc_norm for r in accuracy_norm(df).collect()} == {"t": 1.0, "u": 0.0}


def test_group_mean_is_of_tasks(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 0.0), ("h", "c", 0.5)], "group string, task string, value double")
    got = {(r.group, r.task): r.value for r in group_scores(df).collect()}
    assert got == {("g", "a"): 1.0, ("g", "b"): 0.0, ("h", "c"): 0.5, ("g", None): 0.5, ("h", None): 0.5}


def test_chrf_of_short_targets(spark):
    rows = [("g", "abcdefgh", "abcdefgh"), ("g", "abcdefghij", "ab")]
    assert corpus_chrf(frame(spark, rows)).first().chrf == pytest.approx(96.40, abs=0.005)
