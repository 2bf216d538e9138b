"""Contract queries for training-table preparation (L3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_prompt, count_tokens
from ..operators import prepare as P
from ..operators import speakers as SPK
from ..session import spread
from . import bindings as bd
from . import oracle as O

# ---------------------------------------------------------------------------
# Fixed values of these contract queries.
# ---------------------------------------------------------------------------
PATH_SOURCES = ["signup", "click", "error", "purchase", "view"]
PATH_ROOTS = ["/corpora/signup", "/corpora/click/", "/corpora//error", "/corpora/./purchase", "/corpora/view"]
# every source takes part, the first ones with more weight
MIX_PROBABILITIES = {f"src{k}": 4.0 if k == 0 else 3.0 if k == 1 else 2.0 if k < 6 else 1.0 for k in range(20)}
SAMPLE_RATE = 16000
SPLITS = ["dev", "holdout", "train_base", "train_scaled"]
# ---------------------------------------------------------------------------


def _with_paths(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances(spark, d).withColumn(
        "relative_audio_path", F.concat(F.col("speakerid").cast("string"), F.lit("/"), F.col("utterance_id").cast("string"), F.lit(".wav"))
    )
    return P.add_audio_paths(u, PATH_SOURCES, PATH_ROOTS)


def audio_paths(spark: SparkSession, d: str) -> DataFrame:
    return _with_paths(spark, d).select("utterance_id", "audio_path")


def _paths_sql_expr() -> str:
    branches = []
    for s, r in zip(PATH_SOURCES, PATH_ROOTS):
        root = r.rstrip("/") or "/"
        branches.append(f"WHEN source = '{s}' THEN '{root}/' || rel")
    raw = "CASE " + " ".join(branches) + " END"
    return (
        "regexp_replace(regexp_replace(regexp_replace(" + raw + ", '/(\\./)+', '/', 'g'), '/+', '/', 'g'), '(.)/$', '\\1')"
    )


PATHS_CTE = (
    "paths AS (SELECT utterance_id, value, "
    + _paths_sql_expr()
    + " AS audio_path FROM (SELECT *, CAST(speakerid AS VARCHAR) || '/' || CAST(utterance_id AS VARCHAR) || '.wav' AS rel FROM utterances JOIN events ON event_id = utterance_id))"
)
AUDIO_PATHS_SQL = O.with_(O.UTTERANCES, PATHS_CTE) + "SELECT utterance_id, audio_path FROM paths"


def missing_paths(spark: SparkSession, d: str) -> DataFrame:
    p = _with_paths(spark, d)
    # the file listing: clips whose value is above 5 exist on disk
    listing = bd.utterances(spark, d).where(F.col("snr") > 5).withColumn(
        "relative_audio_path", F.concat(F.col("speakerid").cast("string"), F.lit("/"), F.col("utterance_id").cast("string"), F.lit(".wav"))
    )
    listing = P.add_audio_paths(listing, PATH_SOURCES, PATH_ROOTS).select(F.col("audio_path").alias("path"))
    return P.missing_paths(p, listing).select("utterance_id", "audio_path")


MISSING_PATHS_SQL = O.with_(O.UTTERANCES, PATHS_CTE) + (
    "SELECT utterance_id, audio_path FROM paths WHERE audio_path NOT IN (SELECT audio_path FROM paths WHERE value > 5)"
)


def pending_work(spark: SparkSession, d: str) -> DataFrame:
    docs = bd.transcripts(spark, d).select("id", "source")
    done = bd.metadata(spark, d).select("id")
    return P.pending_work(docs, done, "id")


PENDING_SQL = "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def _metadata_with_clash(spark: SparkSession, d: str) -> DataFrame:
    return bd.metadata(spark, d).withColumn("source", F.concat(F.lit("label_v"), F.col("quality").cast("string")))


def merge_metadata(spark: SparkSession, d: str) -> DataFrame:
    ds = bd.transcripts(spark, d).select("id", "source", "lang", "n_chars")
    merged = P.merge_metadata(ds, _metadata_with_clash(spark, d), "id", on_mismatch="inner")
    from ..schema import keep_columns

    return keep_columns(merged, ["id", "metadata_id", "source", "lang", "quality", "toxic"])


MERGE_SQL = (
    "SELECT d.doc_id AS id, l.doc_id AS metadata_id, d.source, d.lang, l.quality, l.toxic "
    "FROM documents d JOIN labels l ON l.doc_id = d.doc_id"
)


def merge_metadata_agreeing(spark: SparkSession, d: str) -> DataFrame:
    """Metadata for every id, as the default rule asks."""
    ds = bd.transcripts(spark, d).select("id", "source", "lang")
    md = bd.transcripts(spark, d).select("id", "n_chars", F.upper("lang").alias("lang"))
    return P.merge_metadata(ds, md, "id", prefer="metadata").select("id", "metadata_id", "source", "lang", "n_chars")


MERGE_AGREEING_SQL = "SELECT doc_id AS id, doc_id AS metadata_id, source, upper(lang) AS lang, n_chars FROM documents"


def prepared_table(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(bd.transcripts(spark, d))
    t = docs.select(
        "id",
        clean_prompt(F.col("transcription")).alias("prompt"),
        clean_prompt(F.concat_ws(" ", F.col("source"), F.lit("speaker,\n"), F.col("lang"), F.lit("accent \n"))).alias("description"),
        (F.col("n_chars") * 160).alias("target_length"),
    )
    t = P.text_shorter_than(t, "description", 500)
    t = P.length_in_range(t, "target_length", 2.0, 30.0, SAMPLE_RATE)
    t = t.withColumn("prompt_tokens", count_tokens(F.col("prompt")))
    t = P.tokens_below(t, "prompt_tokens", 600)
    return t.select(
        "id",
        F.length("prompt").cast("bigint").alias("prompt_chars"),
        F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.length("description").cast("bigint").alias("description_chars"),
        F.col("target_length").cast("bigint").alias("target_length"),
    )


_TOKEN = r"([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\x09-\x0D\x1C-\x20\x{85}\p{Z}])"

PREPARED_SQL = """WITH t AS (
  SELECT doc_id AS id,
         regexp_replace(replace(text, chr(10), ' '), '\\s+$', '') AS prompt,
         regexp_replace(replace(source || ' speaker,' || chr(10) || ' ' || lang || ' accent ' || chr(10), chr(10), ' '), '\\s+$', '') AS description,
         n_chars * 160 AS target_length
  FROM documents),
t2 AS (SELECT *, regexp_extract_all(prompt, '{TOKEN}', 1) AS toks FROM t
       WHERE length(description) < 500)
SELECT id, CAST(length(prompt) AS BIGINT) AS prompt_chars, CAST(len(toks) AS BIGINT) AS prompt_tokens,
       CAST(length(description) AS BIGINT) AS description_chars, CAST(target_length AS BIGINT) AS target_length
FROM t2 WHERE target_length > 32000 AND target_length < 480000 AND len(toks) < 600""".replace("{TOKEN}", _TOKEN)


def explode_descriptions(spark: SparkSession, d: str) -> DataFrame:
    c = bd.table(spark, d, "conversations")
    per = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    per = per.select("conv_id", F.transform("_t", lambda x: x["text"]).alias("text_description"))
    # some conversations have no description, some an empty list
    r = F.col("conv_id") % 10
    per = per.withColumn("text_description", F.when(r == 3, F.lit(None)).when(r == 4, F.slice("text_description", 1, 0)).otherwise(F.col("text_description")))
    out = P.explode_descriptions(per, "text_description", "description", keep_empty=True)
    return out.select("conv_id", F.col("description_index").cast("bigint").alias("description_index"), "description")


EXPLODE_SQL = (
    "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS description_index, text AS description FROM conversations WHERE conv_id % 10 NOT IN (3, 4) "
    "UNION ALL SELECT DISTINCT conv_id, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM conversations WHERE conv_id % 10 IN (3, 4)"
)


def mixed_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = bd.transcripts(spark, d).select("id", "source")
    return P.mix_sources(docs, MIX_PROBABILITIES, "source", "id", seed=42)


def _mix_sql() -> str:
    total = float(sum(MIX_PROBABILITIES.values()))
    p = " ".join(f"WHEN source = '{k}' THEN {v / total!r}" for k, v in MIX_PROBABILITIES.items())
    names = ", ".join(f"'{k}'" for k in MIX_PROBABILITIES)
    return f"""WITH part AS (SELECT doc_id AS id, source FROM documents WHERE source IN ({names})),
sizes AS (SELECT source, count(*) AS r, CASE {p} END AS p FROM part GROUP BY source),
nn AS (SELECT CASE WHEN count(*) = {len(MIX_PROBABILITIES)} THEN min(r / p) ELSE 0.0 END AS n FROM sizes)
SELECT id, source, md5('42:order:' || CAST(id AS VARCHAR)) AS mix_key
FROM part JOIN sizes USING (source), nn
WHERE CAST(('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < p * n / r"""


def eval_subset(spark: SparkSession, d: str) -> DataFrame:
    docs = bd.transcripts(spark, d).select("id", "source")
    return P.seeded_subset(docs, 100, "id", seed=42)


EVAL_SUBSET_SQL = (
    "SELECT doc_id AS id, source FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100"
)


def length_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = bd.transcripts(spark, d).select(
        "id", (F.col("n_chars") + F.length("lang") + F.length("source")).alias("length")
    )
    out = P.length_batches(docs, "id", "length", batch_size=8, megabatch_rows=64, seed=42)
    return out.select("id", "length", "megabatch", F.col("position").cast("bigint").alias("position"), "batch")


LENGTH_BATCHES_SQL = """WITH docs AS (SELECT doc_id AS id, n_chars + length(lang) + length(source) AS length FROM documents),
nm AS (SELECT greatest(1, CAST(ceil(count(*) / 64.0) AS BIGINT)) AS n_mb FROM docs),
sh AS (SELECT id, length, CAST(('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % n_mb AS megabatch FROM docs, nm),
ps AS (SELECT *, row_number() OVER (PARTITION BY megabatch ORDER BY length DESC, id) AS position FROM sh)
SELECT id, length, megabatch, position, (position - 1) // 8 AS batch FROM ps"""


def first_seen_names(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances(spark, d)
    return SPK.first_seen(u, "speakerid", "utterance_id")


FIRST_SEEN_SQL = O.with_(O.UTTERANCES) + "SELECT speakerid, min(utterance_id) AS first_seen FROM utterances GROUP BY speakerid"


def concatenated_splits(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances(spark, d).select("utterance_id", "split", "duration")
    parts = [u.where(F.col("split") == s).drop("split") for s in SPLITS]
    return P.concat_tables(parts, SPLITS, "part")


CONCAT_SQL = O.with_(O.UTTERANCES) + (
    "SELECT utterance_id, duration, split AS part FROM utterances"
)


def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances(spark, d).select("utterance_id")
    return P.epoch_order(u, "utterance_id", [0, 1], seed=42)


EPOCH_SQL = O.with_(O.UTTERANCES) + (
    "SELECT utterance_id, epoch, md5('42:' || CAST(epoch AS VARCHAR) || ':' || CAST(utterance_id AS VARCHAR)) AS order_key "
    "FROM utterances, (SELECT unnest([0, 1]) AS epoch)"
)


def reattached_columns(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances(spark, d)
    base = u.select("utterance_id", "speakerid")
    computed = u.select("utterance_id", "snr", "c50")
    return P.reattach(base, computed, "utterance_id", {"snr": "noise_db", "c50": "reverb_db"})


REATTACH_SQL = O.with_(O.UTTERANCES) + "SELECT utterance_id, speakerid, snr AS noise_db, c50 AS reverb_db FROM utterances"


def speaking_rate(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.audio import speaking_rate as rate

    docs = bd.transcripts(spark, d)
    n_samples = (F.col("id") % 97 + 1) * SAMPLE_RATE
    return docs.select("id", F.round(rate(F.col("transcription"), n_samples, F.lit(SAMPLE_RATE)), 6).alias("speaking_rate"))


SPEAKING_RATE_SQL = (
    f"SELECT doc_id AS id, round(length(text) / ((doc_id % 97 + 1) * {SAMPLE_RATE} / {float(SAMPLE_RATE)}), 6) AS speaking_rate FROM documents"
)


def gender_from_scores(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.audio import gender_from_probs

    e = bd.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), gender_from_probs(F.slice("embedding", 1, 3)).alias("gender"))


GENDER_SQL = "SELECT vec_id AS id, CASE WHEN embedding[2] > embedding[1] THEN 'male' ELSE 'female' END AS gender FROM embeddings"


QUERIES = {
    "audio_paths": (audio_paths, AUDIO_PATHS_SQL),
    "missing_paths": (missing_paths, MISSING_PATHS_SQL),
    "pending_work": (pending_work, PENDING_SQL),
    "merge_metadata": (merge_metadata, MERGE_SQL),
    "merge_metadata_agreeing": (merge_metadata_agreeing, MERGE_AGREEING_SQL),
    "prepared_table": (prepared_table, PREPARED_SQL),
    "explode_descriptions": (explode_descriptions, EXPLODE_SQL),
    "mixed_sources": (mixed_sources, _mix_sql()),
    "eval_subset": (eval_subset, EVAL_SUBSET_SQL),
    "length_batches": (length_batches, LENGTH_BATCHES_SQL),
    "first_seen_names": (first_seen_names, FIRST_SEEN_SQL),
    "concatenated_splits": (concatenated_splits, CONCAT_SQL),
    "epoch_order": (epoch_order, EPOCH_SQL),
    "reattached_columns": (reattached_columns, REATTACH_SQL),
    "speaking_rate": (speaking_rate, SPEAKING_RATE_SQL),
    "gender_from_scores": (gender_from_scores, GENDER_SQL),
}
