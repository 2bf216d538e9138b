"""Contract queries for evaluation (transcript error rates, similarity,
metric tables, generation retry choice)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import ENDS, HESITATIONS, WORDS, normalize_by_language
from ..functions.text import basic_normalize
from ..operators import evaluation as EV
from ..session import spread
from . import bindings as bd
from . import oracle as O


def _duck_norm(x: str) -> str:
    s = f"lower({x})"
    s = f"regexp_replace({s}, '[<\\[][^>\\]]*[>\\]]', '', 'g')"
    s = f"regexp_replace({s}, '\\(([^)]+?)\\)', '', 'g')"
    s = f"regexp_replace({s}, '[\\p{{M}}\\p{{S}}\\p{{P}}]', ' ', 'g')"
    s = f"lower({s})"
    return f"regexp_replace({s}, '\\s+', ' ', 'g')"


def text_normalised(spark: SparkSession, d: str) -> DataFrame:
    t = spread(bd.transcripts(spark, d))
    return t.select("id", basic_normalize(F.col("transcription")).alias("normalised"))


TEXT_NORM_SQL = f"SELECT doc_id AS id, {_duck_norm('text')} AS normalised FROM documents"

#: Ends put to the transcripts, one for each remainder of the id.
SAID = [
    "I won't pay $1,250.50, Mr. Smith!",
    "Ｆｕｌｌ oﬃce [noise] 20%",
    "three hundred twenty one (laughs) uh apples",
    "café she's café",
]


def normalised_by_language(spark: SparkSession, d: str) -> DataFrame:
    """STR3 by each row's language, over whole transcripts that end in a
    sentence with something to normalise."""
    t = spread(bd.transcripts(spark, d))
    said = F.get(F.array(*[F.lit(s) for s in SAID]), (F.col("id") % len(SAID)).cast("int"))
    text = F.concat(F.col("transcription"), F.lit(" |\n"), said)
    return t.select("id", "lang", normalize_by_language(text, F.col("lang")).alias("normalised"))


def _by_language_sql() -> str:
    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def every(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"

    said = " ".join(f"WHEN doc_id % {len(SAID)} = {i} THEN {q(unicodedata.normalize('NFKC', x))}" for i, x in enumerate(SAID))
    s = every(every(every("lower(t)", r"[<\[][^>\]]*[>\]]", ""), r"\(([^)]+?)\)", ""), r"\s*[‘’']", "'")
    for _ in range(2):  # neighbouring matches share a digit
        s = every(every(s, r"(\d),(\d)", r"\1\2"), r"(\d)\.(\d)", "\\1\ue000\\2")
    s = f"replace({s}, '.', ' ')"
    kept = {"'": "\ue001", "%": "\ue002"}
    for c, x in kept.items():
        s = f"replace({s}, {q(c)}, {q(x)})"
    s = every(s, r"[\p{M}\p{P}\p{Sm}\p{Sk}\p{So}\p{Z}\x09-\x0D\x1C-\x1F\x{85}]+", " ")
    for c, x in (kept | {".": "\ue000"}).items():
        s = f"replace({s}, {q(x)}, {q(c)})"
    full = ", ".join(f"{q(w)}: {q(x)}" for w, x in (WORDS | dict.fromkeys(HESITATIONS, "")).items())
    s = f"list_aggregate(list_transform(string_split({s}, ' '), lambda w: coalesce(MAP {{{full}}}[w], w)), 'string_agg', ' ')"
    for end, word in ENDS.items():
        s = every(s, end + r"\b", word)
    s = f"trim({every(s, chr(91) + chr(39) + ' ]+', ' ')})"
    return (
        f"WITH d AS (SELECT doc_id AS id, lang, text || ' |' || chr(10) || CASE {said} END AS t FROM documents) "
        f"SELECT id, lang, CASE WHEN lower(lang) = 'en' THEN replace({s}, 'three hundred twenty one', '321') ELSE trim({_duck_norm('t')}) END AS normalised FROM d"
    )


# word counts of the normalised reference; the prediction drops every fifth
# word, so its word-level distance to the reference is exactly that many
# deletions -- the oracle counts them.
_WORDS_CTE = (
    "w AS (SELECT doc_id AS id, nullif(doc_id % 50, 49) AS si_sdr, "
    f"CASE WHEN trim({_duck_norm('text')}) = '' THEN 0 ELSE len(string_split_regex(trim({_duck_norm('text')}), '\\s+')) END AS ref_words "
    "FROM documents),\nwe AS (SELECT id, si_sdr, ref_words, (CASE WHEN id % 3 = 1 THEN 2 ELSE 1 END) * (ref_words // 5) AS edits FROM w WHERE ref_words > 0)"
)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return EV.word_error_rows(bd.predictions(spark, d))


def word_error_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("id", "edits", "ref_words")


WER_ROWS_SQL = O.with_(_WORDS_CTE) + "SELECT id, CAST(edits AS BIGINT) AS edits, CAST(ref_words AS BIGINT) AS ref_words FROM we"


def corpus_wer(spark: SparkSession, d: str) -> DataFrame:
    r = EV.corpus_wer(_rows(spark, d))
    return r.select(F.round("wer", 6).alias("wer"), "scored")


CORPUS_WER_SQL = O.with_(_WORDS_CTE) + (
    "SELECT round(coalesce(100.0 * sum(edits) / sum(ref_words), 100.0), 6) AS wer, count(*) AS scored FROM we"
)


def clean_noisy_wer(spark: SparkSession, d: str) -> DataFrame:
    r = EV.clean_noisy_wer(_rows(spark, d), "si_sdr", bd.CLEAN_LIMIT)
    return r.select(*[F.round(c, 6).alias(c) for c in ("wer", "clean_wer", "noisy_wer", "percent_clean")], "unrated")


CLEAN_NOISY_SQL = O.with_(
    _WORDS_CTE,
    f"""a AS (SELECT sum(edits) AS te, sum(ref_words) AS tw,
  sum(CASE WHEN si_sdr >= {bd.CLEAN_LIMIT} THEN edits END) AS ce, sum(CASE WHEN si_sdr >= {bd.CLEAN_LIMIT} THEN ref_words END) AS cw,
  sum(CASE WHEN si_sdr < {bd.CLEAN_LIMIT} THEN edits END) AS ne, sum(CASE WHEN si_sdr < {bd.CLEAN_LIMIT} THEN ref_words END) AS nw,
  count(CASE WHEN si_sdr >= {bd.CLEAN_LIMIT} THEN 1 END) AS nc, count(si_sdr) AS n, count(*) AS every FROM we)""",
) + (
    "SELECT round(coalesce(100.0 * te / tw, 100.0), 6) AS wer, "
    "round(CASE WHEN nc > 0 THEN 100.0 * ce / cw END, 6) AS clean_wer, "
    "round(CASE WHEN nc = 0 THEN NULL WHEN nc = n THEN 0.0 ELSE 100.0 * ne / nw END, 6) AS noisy_wer, "
    "round(CASE WHEN nc > 0 THEN nc / n ELSE 0.0 END, 6) AS percent_clean, every - n AS unrated FROM a"
)


def paired_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = bd.table(spark, d, "embeddings").select("vec_id", "embedding")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("a_id"), F.col("embedding").alias("b"))
    return EV.paired_cosine(a.join(b, ["a_id"], "inner"), "a", "b").select(F.round("cosine", 6).alias("cosine"))


PAIRED_COSINE_SQL = """WITH p AS (SELECT CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT round(avg(list_dot_product(x, y) / (greatest(sqrt(list_dot_product(x, x)), 1e-8) * greatest(sqrt(list_dot_product(y, y)), 1e-8))), 6) AS cosine FROM p"""


def metric_means(spark: SparkSession, d: str) -> DataFrame:
    e = bd.table(spark, d, "events").select(
        F.expr("event_id div 1000").alias("step"), F.col("event_type").alias("key"), "value"
    )
    m = EV.metric_means(e, "step", "key", "value", prefix="eval")
    return m.select("step", "name", F.round("value", 6).alias("value"))


METRIC_MEANS_SQL = (
    "SELECT event_id // 1000 AS step, CASE WHEN contains(event_type, 'codebook') THEN 'codebook_eval/' || event_type "
    "ELSE 'eval/' || event_type END AS name, round(avg(value), 6) AS value FROM events GROUP BY 1, 2"
)


def best_attempt(spark: SparkSession, d: str) -> DataFrame:
    b = EV.best_attempt(bd.attempts(spark, d), threshold=bd.ATTEMPT_LIMIT, retries=bd.ATTEMPT_RETRIES)
    return b.select("item", F.col("attempt").cast("bigint").alias("attempt"), F.round("wer", 6).alias("wer"), "accepted")


BEST_ATTEMPT_SQL = f"""WITH att AS (SELECT l_orderkey AS item, l_linenumber AS attempt, min(l_quantity) AS wer FROM lineitem GROUP BY 1, 2),
a AS (SELECT * FROM att WHERE attempt BETWEEN 1 AND {bd.ATTEMPT_RETRIES})
SELECT item,
  CAST(arg_min(attempt, CASE WHEN wer < {bd.ATTEMPT_LIMIT} THEN (0, attempt, 0.0, attempt) ELSE (1, 0, wer, attempt) END) AS BIGINT) AS attempt,
  round(arg_min(wer, CASE WHEN wer < {bd.ATTEMPT_LIMIT} THEN (0, attempt, 0.0, attempt) ELSE (1, 0, wer, attempt) END), 6) AS wer,
  arg_min(wer < {bd.ATTEMPT_LIMIT}, CASE WHEN wer < {bd.ATTEMPT_LIMIT} THEN (0, attempt, 0.0, attempt) ELSE (1, 0, wer, attempt) END) AS accepted
FROM a GROUP BY item"""


def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = bd.table(spark, d, "embeddings")
    r = EV.topk_accuracy(e, "embedding", "label", ks=(1, 5))
    return r.select(F.round("top1", 6).alias("top1"), F.round("top5", 6).alias("top5"))


TOPK_SQL = """WITH b AS (SELECT len(list_filter(embedding, lambda x, i: x > embedding[label + 1] OR (x = embedding[label + 1] AND i - 1 < label))) AS better FROM embeddings)
SELECT round(100.0 * avg(CASE WHEN better < 1 THEN 1.0 ELSE 0.0 END), 6) AS top1,
       round(100.0 * avg(CASE WHEN better < 5 THEN 1.0 ELSE 0.0 END), 6) AS top5 FROM b"""


QUERIES = {
    "text_normalised": (text_normalised, TEXT_NORM_SQL),
    "normalised_by_language": (normalised_by_language, _by_language_sql()),
    "word_error_rows": (word_error_rows, WER_ROWS_SQL),
    "corpus_wer": (corpus_wer, CORPUS_WER_SQL),
    "clean_noisy_wer": (clean_noisy_wer, CLEAN_NOISY_SQL),
    "paired_cosine": (paired_cosine, PAIRED_COSINE_SQL),
    "metric_means": (metric_means, METRIC_MEANS_SQL),
    "best_attempt": (best_attempt, BEST_ATTEMPT_SQL),
    "topk_accuracy": (topk_accuracy, TOPK_SQL),
}
