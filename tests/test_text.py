import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechtab.functions.text import basic_normalize, clean_prompt, word_edits, words, segment_file_name


def dp(a, b):
    prev = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        cur = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (a[i - 1] != b[j - 1]))
        prev = cur
    return prev[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=15), st.lists(st.sampled_from("abcde"), max_size=15))
def test_word_edits_equal_dynamic_programming(a, b):
    assert word_edits(a, b) == dp(a, b)
    assert word_edits(a, b) == word_edits(b, a)
    assert (word_edits(a, b) == 0) == (a == b)


def test_word_edits_long_sequences():
    rnd = random.Random(2)
    a = [rnd.randint(0, 40) for _ in range(300)]
    b = [w for i, w in enumerate(a) if i % 7] + [1, 2, 3]
    assert word_edits(a, b) == dp(a, b)


def test_basic_normalize_and_words(spark):
    df = spark.createDataFrame([("Hello, [noise] World (aside)!  Don't\nstop",), ("",)], "t string")
    r = df.select(basic_normalize(F.col("t")).alias("n")).select("n", words(F.col("n")).alias("w")).collect()
    assert r[0]["w"] == ["hello", "world", "don", "t", "stop"]
    assert r[1]["w"] == []


def test_clean_prompt(spark):
    df = spark.createDataFrame([("a\nb  \t ",)], "t string")
    assert df.select(clean_prompt(F.col("t"))).collect()[0][0] == "a b"


def test_segment_file_name(spark):
    df = spark.createDataFrame([("f", "channel1", 0.5, 2.0)], "f string, c string, s double, e double")
    got = df.select(segment_file_name(F.col("f"), F.col("c"), F.col("s"), F.col("e"))).collect()[0][0]
    assert got == "f_channel1_segment_0.5_2.0.wav"
