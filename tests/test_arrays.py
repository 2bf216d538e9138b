import random

from pyspark.sql import functions as F

from speechtab.functions import arrays as A
from speechtab.functions.audio import eval_crops, peak_normalize


def delay_rule(codes, k_n, bos, eos):
    """Row k: k begin ids, the T codes, K-k end ids; all end ids if T < K-2."""
    t = len(codes[0]) if codes else 0
    if t < k_n - 2:
        return [[eos] * (t + k_n) for _ in range(k_n)]
    return [[bos] * k + row + [eos] * (k_n - k) for k, row in enumerate(codes)]


def test_delay_then_undelay(spark):
    rnd = random.Random(0)
    rows = []
    for k_n in range(1, 6):
        for t in range(0, 9):
            codes = [[rnd.randint(0, 99) for _ in range(t)] for _ in range(k_n)]
            rows.append((k_n, t, codes))
    for k_n in range(1, 6):
        sub = [(t, c) for kk, t, c in rows if kk == k_n]
        df = spark.createDataFrame(sub, "t int, codes array<array<int>>")
        d = df.select("t", "codes", A.delay_pattern(F.col("codes"), k_n, 1025, 1024).alias("d"))
        u = d.select("t", "codes", "d", A.undelay(F.col("d"), k_n, 1000).alias("u")).collect()
        for r in u:
            assert r["d"] == delay_rule(r["codes"], k_n, 1025, 1024)
            if r["t"] >= k_n - 2 and r["t"] > 0:
                assert r["u"] == r["codes"]


def test_undelay_drops_out_of_range_frames(spark):
    df = spark.createDataFrame([([[1, 5000, 3], [4, 5, 6000]],)], "c array<array<int>>")
    d = A.delay_pattern(F.col("c"), 2, 7, 8)
    assert df.select(A.undelay(d, 2, 1000)).collect()[0][0] == [[1], [4]]


def test_shift_right(spark):
    df = spark.createDataFrame([([5, -100, 7],)], "x array<int>")
    assert df.select(A.shift_right(F.col("x"), 0, 9)).collect()[0][0] == [9, 5, 0]


def test_pad_to_sides(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "x array<int>")
    r = df.select(A.pad_to(F.col("x"), F.lit(5), -100, "right"), A.pad_to(F.col("x"), F.lit(2), -100, "left")).collect()[0]
    assert r[0] == [1, 2, 3, -100, -100] and r[1] == [2, 3]


def test_cut_ms(spark):
    df = spark.createDataFrame([(list(range(32)), 16)], "s array<int>, r int")
    got = df.select(A.cut_ms(F.col("s"), F.col("r"), F.lit(0.5), F.lit(1.25))).collect()[0][0]
    assert got == list(range(8, 20))


def test_peak_normalize_and_zero_clip(spark):
    df = spark.createDataFrame([([0.5, -1.0],), ([0.0, 0.0],)], "s array<double>")
    r = df.select(peak_normalize(F.col("s"))).collect()
    peak = 10 ** (-0.1 / 20)
    assert abs(r[0][0][1] + peak) < 1e-12 and r[1][0] == [0.0, 0.0]


def test_eval_crops_wrap(spark):
    import numpy as np

    clip = [float(i) for i in range(50)]
    df = spark.createDataFrame([(clip,)], "s array<double>")
    crops = df.select(eval_crops(F.col("s"), 1, 4)).collect()[0][0]
    max_audio = 400
    a = np.pad(np.array(clip), (0, max_audio - 50 + 1), "wrap")
    starts = np.linspace(0, len(a) - max_audio, num=4)
    want = [list(a[int(s): int(s) + max_audio]) for s in starts]
    assert crops == want
