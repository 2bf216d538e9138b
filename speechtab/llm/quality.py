"""Quality rules: a threshold table compiled into one Spark projection.

``METRICS`` names the per-document figures and ``THRESHOLDS`` the bounds on
them.  Both are expressions of the same projection, so judging a document is a
map over its row: no user function, no shuffle, nothing gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import SPACE_CLASS, flat, ids_and_text, pick, require

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"

#: Short function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was by at from this are an or which"
    " der die und das ist von den mit zu im des nicht auf ein eine es dem sich"
    " le la les de des et en un une du que qui dans pour au sur par avec est"
    " el los las del y se por con su para una no al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; ``None`` leaves a side open."""

    metric: str
    low: float | None = None
    high: float | None = None

    def passed(self, value: Column) -> Column:
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= F.lit(float(self.low)))
        if self.high is not None:
            ok = ok & (value <= F.lit(float(self.high)))
        return ok


#: Default threshold table.
THRESHOLDS = (
    Rule("n_words", 20),
    Rule("mean_word_chars", 2, 14),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.04),
    Rule("upper_ratio", high=0.5),
    Rule("dup_line_ratio", high=0.4),
    Rule("repeat_word_ratio", high=0.3),
)


def _ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0 where the denominator is 0."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


#: Words inside windows that occur twice, from ``sorted``, the (hash, position)
#: pairs in order: equal windows are neighbours there, their positions are
#: sorted again, and each adds the words up to the next one, eight at most.
COVERED = f"""
    aggregate(
        array_sort(transform(filter(
            zip_with(
                zip_with(sorted, slice(sorted, 2, size(sorted)), (a, q) -> struct(a.h AS h, a.i AS i, coalesce(a.h = q.h, false) AS after)),
                concat(slice(CAST(array(NULL) AS array<bigint>), 1, least(1, size(sorted))), transform(slice(sorted, 1, greatest(size(sorted) - 1, 0)), p -> p.h)),
                (a, p) -> struct(a.i AS i, a.after OR coalesce(a.h = p, false) AS hit)),
            x -> x.hit), x -> x.i)),
        struct(0L AS n, -{WINDOW} AS last),
        (acc, i) -> struct(acc.n + least({WINDOW}, i - acc.last) AS n, i AS last),
        acc -> acc.n)"""


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """One row per row of ``docs`` with ``doc_id`` and the figures.

    NULL text counts as empty (all figures 0); rows that repeat are each
    measured; other columns are dropped, save the one named in ``carry``.
    Equality of windows is judged on 64-bit hashes within one text."""
    if carry is None:
        df = ids_and_text(docs, id_col, text_col)
    else:
        df = pick(docs, id=id_col, text=text_col, carry=carry).withColumn("text", F.coalesce("text", F.lit("")))
    keep = ["id"] + (["carry"] if carry else [])
    df = df.withColumns({"body": F.btrim("text", F.lit(SPACES)), "tight": F.translate("text", SPACES, "")})
    df = df.withColumn("words", F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", SPACE_CLASS)))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    # hashes of two and of four words in a row; where no four recur, no eight do
    df = df.withColumn("h2", F.expr("zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, size(words)), (a, b) -> xxhash64(a, b))"))
    df = df.withColumn("h4", F.expr("zip_with(slice(h2, 1, greatest(size(h2) - 2, 0)), slice(h2, 3, size(h2)), (a, b) -> xxhash64(a, b))"))
    df = df.withColumn(
        "win",
        F.expr("CASE WHEN size(array_distinct(h4)) < size(h4) THEN zip_with(slice(h4, 1, greatest(size(h4) - 4, 0)), slice(h4, 5, size(h4)), (a, b) -> xxhash64(a, b)) ELSE CAST(array() AS array<bigint>) END"),
    )
    df = df.withColumn("sorted", F.expr("CASE WHEN size(array_distinct(win)) < size(win) THEN array_sort(transform(win, (h, i) -> struct(h AS h, i AS i))) ELSE CAST(array() AS array<struct<h: bigint, i: int>>) END"))
    stop = sorted(set(STOP_WORDS))
    df = df.select(
        *keep,
        "n_words",
        F.length("tight").cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(COVERED).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )
    return df.withColumns(
        {
            "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
            "stop_word_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
            "upper_ratio": _ratio(F.col("n_upper"), F.col("word_chars")),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_word_ratio": _ratio(F.col("n_repeat_words"), F.col("n_words")),
        }
    )


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of them inside repeated windows."""
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """Add ``base_failed``, ``failed`` (names of the rules not met) and
    ``kept``.  An empty table gives an empty table."""
    require(measured, [r.metric for r in rules])
    failed = F.filter(F.array(*[F.when(~r.passed(F.col(r.metric)), F.lit(r.metric)) for r in rules]), lambda x: x.isNotNull())
    return measured.withColumns({"base_failed": base_failed(), "failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures and verdict of every row: ``id_col`` and the columns of
    :func:`measure` and :func:`judge`."""
    return judge(measure(docs, id_col, text_col), rules).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were."""
    plain, (ident, text) = flat(docs, id_col, text_col)
    whole = plain.withColumn("row", F.struct(*plain.columns))
    # a filter on "kept" alone would be pushed below the projections and there
    # spell out every figure again, many times over; one on the row's number
    # as well stays above them
    judged = judge(measure(whole, ident, text, carry="row"), rules).withColumn("number", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("number") >= 0)).select("carry.*").toDF(*docs.columns)


def oracle_sql(rules: tuple[Rule, ...] = THRESHOLDS) -> str:
    """DuckDB SQL for the contract query with the same threshold table."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    conds = []
    for r in rules:
        sides = ([f"{r.metric} < {float(r.low)}"] if r.low is not None else []) + ([f"{r.metric} > {float(r.high)}"] if r.high is not None else [])
        conds.append(f"CASE WHEN {' OR '.join(sides)} THEN '{r.metric}' END")
    ratio = "CASE WHEN {1} > 0 THEN {0}::DOUBLE / {1} ELSE 0.0 END AS {2}".format
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, sum(least({WINDOW}, i - coalesce(p, -{WINDOW}))) AS n
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rep) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: list_contains([{stop}], x))) AS n_stop_words,
             length(text) - length(regexp_replace(text, '\\p{{Lu}}+', '', 'g')) AS n_upper
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
m AS (SELECT *, {ratio('word_chars', 'n_words', 'mean_word_chars')}, {ratio('n_symbols', 'n_words', 'symbol_ratio')},
             {ratio('n_stop_words', 'n_words', 'stop_word_ratio')}, {ratio('n_upper', 'word_chars', 'upper_ratio')},
             {ratio('n_dup_lines', 'n_lines', 'dup_line_ratio')}, {ratio('n_repeat_words', 'n_words', 'repeat_word_ratio')} FROM f),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(array_to_string([{', '.join(conds)}], ','), '') AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM j"""
