"""Bindings of the library's table shapes to the driver's test tables.

Each function reads one or two parquet tables and derives the shape the
operators expect, using existing columns only (no randomness).  The DuckDB
mirror of every binding lives in :mod:`speechtab.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the test bindings.
# ---------------------------------------------------------------------------
# embeddings.label 0..9 -> annotation tag (the last two are not propagatable)
LABEL_TAGS = ["Shrill", "Nasal", "Deep", "Silky", "Husky", "Raspy", "Guttural", "Booming", "Slurred", "Crisp"]
UTTS_PER_SPEAKER = 10  # embeddings: speaker = vec_id div 10
SOURCE_EVERY = 4  # speaker % 4 = 0 -> annotated source speaker
RATING_THRESHOLD = 2.0  # test threshold (random vectors never reach 5.0)
CODEBOOKS = 4
FRAMES = 16
BOS_ID = 1025
EOS_ID = 1024
CROPS = 3  # crops of a file, numbered from 0 to CROPS or CROPS - 1
CROP_WIDTH = 32
CROP_HOP = 10
CLIP_RATE = 16  # embedding as a 64-sample clip at 16 samples per second
ATTEMPT_RETRIES = 3
ATTEMPT_LIMIT = 20.0
CLEAN_LIMIT = 25.0
FOREIGN_WORD = "xqzforeign"  # in no document
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(event_id) -> F.Column:
    r = event_id % 10
    return (
        F.when(r == 0, "dev")
        .when(r == 1, "holdout")
        .when(r.between(2, 4), "train_base")
        .otherwise("train_scaled")
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> utterances (one row per clip)."""
    return utterances_from(table(spark, sf_dir, "events"))


def utterances_from(e: DataFrame) -> DataFrame:
    """The utterance binding over an events frame (batch or stream)."""
    v = F.col("value")
    return e.select(
        F.col("event_id").alias("utterance_id"),
        F.col("user_id").alias("speakerid"),
        F.col("event_type").alias("source"),
        (v / 10).alias("duration"),
        v.alias("snr"),
        (v + 95).alias("utterance_pitch_mean"),
        (v / 4).alias("utterance_pitch_std"),
        (v / 2 + 10).alias("c50"),
        (v / 5).alias("speaking_rate_value"),
        # some speakers have no gender, some one without edges
        F.when(F.col("user_id") % 7 == 3, F.lit(None)).when(F.col("user_id") % 7 == 5, "other").when(F.col("user_id") % 2 == 0, "male").otherwise("female").alias("gender"),
        split_of(F.col("event_id")).alias("split"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("transcription"), "lang", "source", "n_chars"
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")


def speaker_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("utterance_id"),
        F.expr(f"vec_id div {UTTS_PER_SPEAKER}").alias("speaker"),
        "embedding",
        "label",
    )


def is_source(speaker_col: F.Column) -> F.Column:
    return speaker_col % SOURCE_EVERY == 0


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, tag) votes: every utterance of a source speaker is one vote."""
    e = speaker_embeddings(spark, sf_dir).where(is_source(F.col("speaker")))
    tags = F.array(*[F.lit(t) for t in LABEL_TAGS])
    return e.select(F.col("speaker").alias("name"), F.element_at(tags, F.col("label") + 1).alias("tag"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored utterance pairs (vec_id, vec_id + 1) with a 1..6 human rating."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    a = e.alias("a")
    b = e.alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1, "inner").select(
        F.col("a.vec_id").alias("wav1"),
        F.col("b.vec_id").alias("wav2"),
        ((F.col("a.label") + F.col("b.label")) % 6 + 1).cast("double").alias("label"),
    )


def crop_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, embedding): several overlapping crops of every file, as windows
    of its vector; files of an even label have one crop more."""
    e = table(spark, sf_dir, "embeddings")
    starts = F.sequence(F.lit(0), F.lit(CROPS) - F.col("label").cast("int") % 2)
    crops = e.select(F.col("vec_id").alias("file"), "embedding", F.explode(starts).alias("c"))
    return crops.select("file", F.slice("embedding", F.col("c") * CROP_HOP + 1, F.lit(CROP_WIDTH)).alias("embedding"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """codebooks x frames int codes from an embedding, row-major."""
    e = table(spark, sf_dir, "embeddings")
    q = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 512).cast("int"))
    rows = F.array(*[F.slice(q, k * FRAMES + 1, FRAMES) for k in range(CODEBOOKS)])
    return e.select(F.col("vec_id").alias("id"), rows.alias("labels"), F.col("label"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.format_string("clip%d", F.expr("vec_id div 2")).alias("filename"),
        F.format_string("channel%d", F.col("vec_id") % 2 + 1).alias("channel"),
        F.col("embedding").alias("samples"),
        F.lit(CLIP_RATE).alias("sampling_rate"),
        F.col("label"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("attempt")).agg(
        F.min("l_quantity").alias("wer")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as references.  By turns a prediction is the normalised
    reference without every fifth word, without it and with the second of
    the five replaced by a word that no document has, or with that word added
    after every fifth.

    Fewest edits of five words: one, two, one.  A word that the reference does
    not have costs an edit each time it is there (it is put in for another word or
    added), and as many words are left out, beyond those added, as the prediction
    is shorter; no alignment does with less."""
    from ..functions.text import basic_normalize
    from ..session import spread

    d = spread(table(spark, sf_dir, "documents"))
    # normalised text has single spaces between words; each match covers five words
    joined = F.trim(basic_normalize(F.col("text")))
    dropped = F.rtrim(F.regexp_replace(joined, "(\\S+ \\S+ \\S+ \\S+ )\\S+( |$)", "$1"))
    replaced = F.rtrim(F.regexp_replace(joined, "(\\S+) \\S+ (\\S+ \\S+ )\\S+( |$)", f"$1 {FOREIGN_WORD} $2"))
    added = F.regexp_replace(joined, "(\\S+ \\S+ \\S+ \\S+ \\S+)( |$)", f"$1 {FOREIGN_WORD}$2")
    turn = F.col("doc_id") % 3
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("reference"),
        F.when(turn == 1, replaced).when(turn == 2, added).otherwise(dropped).alias("prediction"),
        F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 50 != 49, (F.col("doc_id") % 50).cast("double")).alias("si_sdr"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("utterance_id"), F.col("l_quantity").alias("pitch"), F.col("l_tax").alias("snr"), F.col("l_discount").alias("c50"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        # some snapshots belong to no run, some steps do not fit 63 bits
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("run"),
        F.when(F.col("o_orderkey") % 17 == 0, F.format_string("checkpoint-99999999999999999999%d", F.col("o_orderkey")))
        .when(F.col("o_orderkey") % 11 == 0, F.format_string("notes-%d", F.col("o_orderkey")))
        .when(F.col("o_orderkey") % 3 == 0, F.format_string("checkpoint-%d", F.col("o_orderkey")))
        .otherwise(F.format_string("checkpoint-%d-epoch-%d", F.col("o_orderkey"), F.col("o_custkey") % 10))
        .alias("name"),
    )


def utterances_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utterances plus intrinsic / situational tag arrays (NULL when none)."""
    u = utterances(spark, sf_dir)
    tags = F.array(*[F.lit(t) for t in LABEL_TAGS])
    return u.withColumn(
        "intrinsic_tags",
        F.when(F.col("speakerid") % 3 == 0, F.array(F.element_at(tags, (F.col("speakerid") % 10 + 1).cast("int")))),
    ).withColumn("situational_tags", F.when(F.col("utterance_id") % 7 == 0, F.array(F.col("source"))))


#: Number of the (file, channel) pair that a segment line names.
SEGMENT_KEY = "CASE WHEN vec_id % 5 = 4 THEN vec_id - 4 ELSE vec_id END"


def vad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment-file lines derived from embeddings (line_no = vec_id): comments
    (label 8), blanks and ``longform`` lines (label 9), otherwise 1-3
    segments for a clip.  Every fifth line names the (file, channel) pair of
    the line four before it; keys grow with the table."""
    e = table(spark, sf_dir, "embeddings")
    v, lab = F.col("vec_id"), F.col("label")
    clip = F.format_string("clip%d/channel%d", F.expr(f"({SEGMENT_KEY}) div 2"), v % 2 + 1)
    segs = F.transform(
        F.sequence(F.lit(0), lab % 3),
        lambda i: F.concat(
            F.lit("("),
            (i.cast("double") * 1.25 + (v % 4).cast("double") * 0.25).cast("string"),
            F.lit(", "),
            (i.cast("double") * 1.25 + (v % 4).cast("double") * 0.25 + 0.5 + (lab % 4).cast("double") * 0.125).cast("string"),
            F.lit(")"),
        ),
    )
    line = (
        F.when(lab == 8, F.concat(F.lit("# note "), v.cast("string")))
        .when((lab == 9) & (v % 2 == 0), F.lit(""))
        .when(lab == 9, F.concat(clip, F.lit("\t(0.0, 1.0) longform")))
        .otherwise(F.concat(clip, F.lit("\t"), F.array_join(segs, " ")))
    )
    return e.select(v.alias("line_no"), line.alias("line"))
