"""Normalisation by language: folding, English rules, per-row choice."""

import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from speechtab.functions import normalize as N

CASES = [
    ("I won't pay, Mr. Smith!", "i will not pay mister smith"),
    ("She's gonna say they'd [noise] leave (laughs)", "she is going to say they would leave"),
    ("um, three hundred twenty one apples", "321 apples"),
    ("twenty thirty", "20 30"),
    ("two thousand five", "2005"),
    ("one million two hundred thousand and seven", "1200000 and 7"),
    ("ninety nine hundred", "9900"),
    ("nineteen eighty four", "19 84"),
    ("zero one", "0 1"),
    ("a hundred thousand", "a 100000"),
    ("hundred", "100"),
    ("someone often tenses", "someone often tenses"),
    ("costs $1,250.50 or 20%. Done.", "costs $1250.50 or 20% done"),
    ("it’s Dr. Who's", "it is doctor who is"),
    ("Ｆｕｌｌ １２ oﬃce", "full 12 office"),
    ("café ①", "café 1"),
    ("", ""),
    (None, None),
]


@pytest.fixture(scope="module")
def normalised(spark):
    df = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(CASES)], "i int, t string, lang string")
    out = df.select("i", N.normalize_by_language(F.col("t"), F.col("lang")).alias("n"))
    return {r.i: r.n for r in out.collect()}


def test_english_rules(normalised):
    assert {CASES[i][0]: n for i, n in normalised.items()} == dict(CASES)


def test_rules_by_row_and_folding(spark):
    rows = [(0, "Won't, two!", "en"), (1, "Won't, two!", "de"), (2, "Won't, two!", None), (3, "Ｗir ﬁnden", "de"), (4, "Été", "fr")]
    df = spark.createDataFrame(rows, "i int, t string, lang string")
    got = [r.n for r in df.select("i", N.normalize_by_language(F.col("t"), F.col("lang")).alias("n")).orderBy("i").collect()]
    assert got == ["will not 2", "won t two", "won t two", "wir finden", "été"]
    plain = [r.n for r in df.select("i", N.normalize_by_language(F.col("t"), F.col("lang"), fold=False).alias("n")).orderBy("i").collect()]
    assert plain[3] == "ｗir ﬁnden"


def test_folding_equals_unicode(spark):
    texts = [chr(c) + "á" + chr(c) for c in range(0x20, 0x3000, 7)] + [chr(c) for c in range(0xF900, 0xFFFD, 5)] + ["\U0001d400\U0001d7d8", "각", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", N.compatibility_fold(F.col("t")).alias("n")).collect()}
    assert got == {i: unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}


def test_plain_characters_cost_little(spark):
    """A plain character is held against few bounds of the class, not against every range of it."""
    df = spark.createDataFrame([("plain words " * 20_000,)] * 8, "t string").repartition(1).cache()
    df.count()

    def seconds(pattern):
        def once():
            start = time.perf_counter()
            assert df.where(F.col("t").rlike(pattern)).count() == 0
            return time.perf_counter() - start

        return min(once() for _ in range(3))

    flat = "[\\x{80}-\\x{10FFFF}]"
    assert seconds(N._folded_class()) < 5 * seconds(flat) + 0.2
    df.unpersist()
