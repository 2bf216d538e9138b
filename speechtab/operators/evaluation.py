"""Evaluation: word error rate per row and per corpus (STR4, AGG10, AGG11),
paired cosine (AGG12), metric means (AGG14), accept-first-else-best
(WIN4), top-k accuracy (AGG19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize_by_language
from ..functions.text import basic_normalize, text_edit_distance, words
from ..functions.vectors import as_double_array, cosine
from ..schema import require_columns


def word_error_rows(
    df: DataFrame,
    ref_col: str = "reference",
    hyp_col: str = "prediction",
    normalize: bool = True,
    language_col: str | None = None,
) -> DataFrame:
    """STR3 + STR4: per row the word edits and reference word count.  With
    ``language_col`` texts are normalised by the rules of their row's language,
    else by the basic ones.

    Rows whose normalised reference has no words are dropped (they cannot
    be scored)."""
    require_columns(df, [ref_col, hyp_col])
    ref, hyp = F.col(ref_col), F.coalesce(F.col(hyp_col), F.lit(""))
    if normalize and language_col is not None:
        ref, hyp = (normalize_by_language(c, F.col(language_col)) for c in (ref, hyp))
    elif normalize:
        ref, hyp = basic_normalize(ref), basic_normalize(hyp)
    # words are split in the JVM; the filter uses only native expressions so
    # it never re-runs the Python step wherever Catalyst moves it
    out = df.withColumn("_r", ref).withColumn("_h", hyp)
    out = out.withColumn("edits", text_edit_distance(F.col("_r"), F.col("_h")))
    out = out.withColumn("ref_words", F.size(words(F.col("_r"))).cast("bigint")).where(F.col("ref_words") > 0)
    return out.withColumn("hyp_words", F.size(words(F.col("_h"))).cast("bigint")).drop("_r", "_h")


def corpus_wer(rows: DataFrame) -> DataFrame:
    """AGG10: 100 * total edits / total reference words; 100 when nothing
    can be scored."""
    return rows.agg(
        F.coalesce(100.0 * F.sum("edits") / F.sum("ref_words"), F.lit(100.0)).alias("wer"),
        F.count(F.lit(1)).alias("scored"),
    )


def clean_noisy_wer(rows: DataFrame, quality_col: str = "si_sdr", clean_limit: float | None = 25.0) -> DataFrame:
    """AGG11: error rate over clean rows (quality >= limit) and noisy rows,
    share of clean rows.  Clean is NULL when no row is clean, noisy is 0
    when every row is clean.  Rows without a quality are in neither rate and
    not in the share, only in ``wer`` and in ``unrated``.  ``clean_limit=None``: rows are not told apart,
    only ``wer`` is a number.  One pass, conditional sums."""
    if clean_limit is None:
        none = F.lit(None).cast("double")
        return corpus_wer(rows).select("wer", none.alias("clean_wer"), none.alias("noisy_wer"), none.alias("percent_clean"), F.col("scored").alias("unrated"))
    clean = F.col(quality_col) >= F.lit(float(clean_limit))
    agg = rows.agg(
        F.sum(F.when(clean, F.col("edits"))).alias("ce"),
        F.sum(F.when(clean, F.col("ref_words"))).alias("cw"),
        F.sum(F.when(~clean, F.col("edits"))).alias("ne"),
        F.sum(F.when(~clean, F.col("ref_words"))).alias("nw"),
        F.count(F.when(clean, F.lit(1))).alias("nc"),
        F.count(clean).alias("n"),
        F.count(F.when(clean.isNull(), F.lit(1))).alias("unrated"),
        F.sum("edits").alias("te"),
        F.sum("ref_words").alias("tw"),
    )
    return agg.select(
        F.coalesce(100.0 * F.col("te") / F.col("tw"), F.lit(100.0)).alias("wer"),
        F.when(F.col("nc") > 0, 100.0 * F.col("ce") / F.col("cw")).alias("clean_wer"),
        F.when(F.col("nc") == 0, F.lit(None).cast("double"))
        .when(F.col("nc") == F.col("n"), F.lit(0.0))
        .otherwise(100.0 * F.col("ne") / F.col("nw"))
        .alias("noisy_wer"),
        F.when(F.col("nc") > 0, F.col("nc") / F.col("n")).otherwise(F.lit(0.0)).alias("percent_clean"),
        "unrated",
    )


def paired_cosine(df: DataFrame, a_col: str, b_col: str, eps: float = 1e-8) -> DataFrame:
    """AGG12: mean cosine similarity of paired vectors."""
    c = cosine(as_double_array(F.col(a_col)), as_double_array(F.col(b_col)), eps)
    return df.agg(F.avg(c).alias("cosine"))


def metric_name(key_col: str, prefix: str) -> F.Column:
    k = F.col(key_col)
    return F.when(k.contains("codebook"), F.concat(F.lit(f"codebook_{prefix}/"), k)).otherwise(
        F.concat(F.lit(f"{prefix}/"), k)
    )


def metric_means(df: DataFrame, step_col: str = "step", key_col: str = "key", value_col: str = "value", prefix: str = "eval") -> DataFrame:
    """AGG14: mean of each metric over evaluation batches, with logged names."""
    return df.groupBy(step_col, key_col).agg(F.avg(value_col).alias("value")).select(
        step_col, metric_name(key_col, prefix).alias("name"), "value"
    )


def best_attempt(
    df: DataFrame,
    item_col: str = "item",
    attempt_col: str = "attempt",
    err_col: str = "wer",
    threshold: float = 20.0,
    retries: int = 3,
) -> DataFrame:
    """WIN4: per item the first attempt (within ``retries``) whose error is
    below ``threshold``; otherwise the lowest error, earliest on ties.  One
    aggregate (``min_by`` on a composite key): partial aggregation, no sort."""
    a = F.col(attempt_col)
    e = F.col(err_col)
    ok = e < F.lit(float(threshold))
    key = F.when(ok, F.struct(F.lit(0).alias("c"), a.alias("a"), F.lit(0.0).alias("e"), a.alias("t"))).otherwise(
        F.struct(F.lit(1).alias("c"), F.lit(0).alias("a"), e.cast("double").alias("e"), a.alias("t"))
    )
    pick = F.min_by(F.struct(a.alias("attempt"), e.alias("wer"), ok.alias("accepted")), key)
    return (
        df.where((a >= 1) & (a <= retries))
        .groupBy(item_col)
        .agg(pick.alias("_p"))
        .select(item_col, F.col("_p.attempt").alias(attempt_col), F.col("_p.wer").alias(err_col), F.col("_p.accepted").alias("accepted"))
    )


def topk_accuracy(df: DataFrame, scores_col: str, target_col: str, ks=(1,)) -> DataFrame:
    """AGG19: percent of rows whose target class is among the k best scores
    (ties broken by lower class index)."""
    s = F.col(scores_col)
    t = F.col(target_col)
    st = F.element_at(s, t + 1)
    better = F.size(F.filter(s, lambda x, i: (x > st) | ((x == st) & (i < t))))
    out = df.select(better.alias("_better"))
    return out.agg(*[(100.0 * F.avg(F.when(F.col("_better") < k, 1.0).otherwise(0.0))).alias(f"top{k}") for k in ks])
