"""Intrinsic tag propagation (L2) as one Spark plan, plus its contract queries.

manifest (AGG4, WIN1) -> median vectors (AGG5) -> votes (AGG6) -> similarity
join with per-source top-k (JN4, WIN2) -> best source (WIN3) -> parent tags
(JN6).  No files between the steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import SHIPPED_BIN_EDGES, SHIPPED_TEXT_BINS, bin_label
from ..functions.vectors import round_array
from ..operators import similarity as SIM
from ..operators import speakers as SPK
from ..operators import stats as ST
from ..operators import tags as TG
from ..session import materialize
from ..sources import io as IO
from . import bindings as bd
from . import oracle as O


def propagate_intrinsic_tags(
    source_medians: DataFrame,
    target_medians: DataFrame,
    annotations: DataFrame,
    source_order: DataFrame,
    threshold: float = 5.0,
    max_similar: int | None = 1000,
    min_annotations: int = 2,
):
    """L2 core.  ``*_medians``: (speaker, median) normalised; ``annotations``:
    (name, tag) votes; ``source_order``: (name, first_seen), where each source
    first appears in the manifest, which decides ties.  Returns (pairs, best-with-tags, votes, sources).

    Hand over medians that are stored (``session.materialize``): the similarity
    join reads both sides for its pivots, its blocks and its cells."""
    votes = TG.tag_votes(annotations, min_annotations)
    sources = TG.restrict_to(
        source_medians.select(F.col("speaker").alias("name"), F.col("median").alias("vec")), votes.select("name"), "name"
    ).join(source_order.select("name", "first_seen"), "name").select(
        F.col("name").alias("source"), F.col("first_seen").alias("source_order"), "vec"
    )
    targets = target_medians.select(F.col("speaker").alias("target"), F.col("median").alias("vec"))
    pairs = SIM.similar_pairs(sources, targets, threshold, max_similar)
    best = SIM.best_source(pairs)
    tagged = TG.attach_parent_tags(best, votes)
    return pairs, tagged, votes, sources


def propagate_from_rows(
    source_utterances: DataFrame,
    target_utterances: DataFrame,
    embeddings: DataFrame,
    annotations: DataFrame,
    threshold: float = 5.0,
    max_similar: int | None = 1000,
    min_annotations: int = 2,
    min_duration: float = 300.0,
    n_per_speaker: int = 10,
    seed: int | str = 42,
):
    """L2 from raw rows: for either side the manifest of speakers with enough
    speech and a seeded sample of their utterances (AGG4, WIN1), the sample's
    embeddings by id (SRC5), a median vector a speaker (AGG5), then
    :func:`propagate_intrinsic_tags`, with its results.

    ``*_utterances``: (speaker, utterance_id, duration); ``embeddings``:
    (utterance_id, embedding) of both sides; ``annotations``: (name, tag).  A
    manifest is ordered by speaker, so that is the order that decides ties.  An
    utterance without an embedding is left out of the median; a speaker without
    any is on neither side.  Only sampled rows meet the embeddings."""

    def medians(utterances: DataFrame) -> DataFrame:
        manifest = SPK.build_manifest(utterances, "speaker", "utterance_id", "duration", min_duration, n_per_speaker, seed)
        sampled = IO.align_embeddings(manifest, embeddings).where(F.col("embedding").isNotNull())
        return materialize(SIM.median_vectors(sampled, "speaker", "embedding"), reliable=True)

    sources = medians(source_utterances)
    order = sources.select(F.col("speaker").alias("name"), F.col("speaker").alias("first_seen"))
    return propagate_intrinsic_tags(sources, medians(target_utterances), annotations, order, threshold, max_similar, min_annotations)


def _medians(spark: SparkSession, d: str) -> DataFrame:
    return SIM.median_vectors(bd.speaker_embeddings(spark, d), "speaker", "embedding")


def _run(spark: SparkSession, d: str):
    med = materialize(_medians(spark, d), reliable=True)
    src = med.where(bd.is_source(F.col("speaker")))
    tgt = med.where(~bd.is_source(F.col("speaker")))
    order = SPK.first_seen(bd.speaker_embeddings(spark, d), "speaker", "utterance_id").withColumnRenamed("speaker", "name")
    return propagate_intrinsic_tags(src, tgt, bd.annotations(spark, d), order, threshold=bd.RATING_THRESHOLD)


# ----------------------------------------------------------------- queries --


def manifest_sample(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances(spark, d)
    m = SPK.build_manifest(u, "speakerid", "utterance_id", "duration", min_duration=300.0, n_per_speaker=10, seed=42)
    return m.select(F.col("speakerid").alias("speaker"), "utterance_id", "duration")


MANIFEST_SAMPLE_SQL = O.with_(
    O.UTTERANCES,
    "tot AS (SELECT speakerid FROM utterances GROUP BY speakerid HAVING sum(CAST(duration AS DECIMAL(38,9))) >= 300.0)",
    "r AS (SELECT speakerid, utterance_id, duration, row_number() OVER (PARTITION BY speakerid ORDER BY md5('42:' || CAST(utterance_id AS VARCHAR)), utterance_id) AS rn FROM utterances)",
) + "SELECT speakerid AS speaker, utterance_id, duration FROM r WHERE rn <= 10 AND speakerid IN (SELECT speakerid FROM tot)"


def manifest_integrity(spark: SparkSession, d: str) -> DataFrame:
    e = bd.speaker_embeddings(spark, d)
    summary = ST.manifest_summary(e, "speaker")
    bad = ST.speakers_not_n(e, bd.UTTS_PER_SPEAKER, "speaker").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return summary.select("rows", "speakers", bad.alias("speakers_not_n"))


MANIFEST_INTEGRITY_SQL = O.with_(O.SPEAKER_EMBEDDINGS) + (
    "SELECT count(*) AS rows, count(DISTINCT speaker) AS speakers, "
    f"(SELECT count(*) FROM (SELECT speaker FROM speaker_embeddings GROUP BY speaker HAVING count(*) <> {bd.UTTS_PER_SPEAKER})) AS speakers_not_n "
    "FROM speaker_embeddings"
)


def speaker_median_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _medians(spark, d).select("speaker", round_array(F.col("median")).alias("median"))


MEDIANS = """dims AS (SELECT speaker, i, median(x) AS m FROM (
    SELECT speaker, unnest(range(1, len(embedding) + 1)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM speaker_embeddings)
  GROUP BY speaker, i),
med0 AS (SELECT speaker, list(m ORDER BY i) AS v FROM dims GROUP BY speaker),
med1 AS (SELECT speaker, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS nr FROM med0),
nrm AS (SELECT speaker, CASE WHEN nr > 0 THEN list_transform(v, lambda x: x / nr) ELSE list_transform(v, lambda x: x * 0.0) END AS v FROM med1)"""

SPEAKER_MEDIANS_SQL = O.with_(O.SPEAKER_EMBEDDINGS, MEDIANS) + (
    "SELECT speaker, list_transform(v, lambda x: round(x, 6)) AS median FROM nrm"
)

VOTES = (
    "votes AS (SELECT name, list(tag ORDER BY tag) AS tags FROM ("
    f"SELECT name, tag FROM annotations WHERE tag IN {tuple(TG.INTRINSIC_TAGS_EXPANDABLE)} "
    "GROUP BY name, tag HAVING count(*) >= 2) GROUP BY name)"
)


def tag_votes(spark: SparkSession, d: str) -> DataFrame:
    return TG.tag_votes(bd.annotations(spark, d), 2)


TAG_VOTES_SQL = O.with_(O.SPEAKER_EMBEDDINGS, O.ANNOTATIONS, VOTES) + "SELECT name, tags FROM votes"

PAIRS = f"""src AS (SELECT n.speaker AS source, (SELECT min(utterance_id) FROM speaker_embeddings e WHERE e.speaker = n.speaker) AS source_order, n.v FROM nrm n JOIN votes ON votes.name = n.speaker WHERE n.speaker % {bd.SOURCE_EVERY} = 0),
tgt AS (SELECT speaker AS target, v FROM nrm WHERE speaker % {bd.SOURCE_EVERY} <> 0),
allp AS (SELECT source, source_order, target, 5.0 * list_dot_product(s.v, t.v) + 1.0 AS score FROM src s, tgt t),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM allp WHERE score > {bd.RATING_THRESHOLD}),
pairs AS (SELECT * FROM ranked WHERE rank <= 1000)"""

_L2_CTES = (O.SPEAKER_EMBEDDINGS, O.ANNOTATIONS, VOTES, MEDIANS, PAIRS)


def similar_speakers(spark: SparkSession, d: str) -> DataFrame:
    pairs = _run(spark, d)[0]
    return pairs.select("source", "target", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


SIMILAR_SQL = O.with_(*_L2_CTES) + "SELECT source, target, round(score, 6) AS score, rank FROM pairs"


def similar_speakers_all(spark: SparkSession, d: str) -> DataFrame:
    """Without the cap: every target above the threshold, ranked."""
    med = materialize(_medians(spark, d), reliable=True)
    s = med.where(bd.is_source(F.col("speaker"))).select(F.col("speaker").alias("source"), F.col("speaker").alias("source_order"), F.col("median").alias("vec"))
    t = med.where(~bd.is_source(F.col("speaker"))).select(F.col("speaker").alias("target"), F.col("median").alias("vec"))
    pairs = SIM.similar_pairs(s, t, bd.RATING_THRESHOLD, top_k=None)
    return pairs.select("source", "target", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


SIMILAR_ALL_SQL = O.with_(
    O.SPEAKER_EMBEDDINGS,
    MEDIANS,
    f"allp AS (SELECT s.speaker AS source, t.speaker AS target, 5.0 * list_dot_product(s.v, t.v) + 1.0 AS score FROM nrm s, nrm t WHERE s.speaker % {bd.SOURCE_EVERY} = 0 AND t.speaker % {bd.SOURCE_EVERY} <> 0)",
) + f"SELECT source, target, round(score, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM allp WHERE score > {bd.RATING_THRESHOLD}"


def propagated_tags(spark: SparkSession, d: str) -> DataFrame:
    tagged = _run(spark, d)[1]
    return tagged.select("target", "parent", F.round("score", 6).alias("score"), "tags")


PROPAGATED_SQL = O.with_(
    *_L2_CTES,
    "best AS (SELECT target, arg_min(source, (-score, source_order)) AS parent, max(score) AS score FROM pairs GROUP BY target)",
) + "SELECT b.target, b.parent, round(b.score, 6) AS score, v.tags FROM best b JOIN votes v ON v.name = b.parent"


SAMPLE_OF, LEAST_SPEECH = 6, 300.0


def propagated_from_rows(spark: SparkSession, d: str) -> DataFrame:
    """Raw utterances -> manifests -> their embeddings -> medians -> tags."""
    e = bd.speaker_embeddings(spark, d)
    u = e.select("speaker", "utterance_id", ((F.col("label") + 1) * 6.5).alias("duration"))
    tagged = propagate_from_rows(
        u.where(bd.is_source(F.col("speaker"))), u.where(~bd.is_source(F.col("speaker"))), e.select("utterance_id", "embedding"),
        bd.annotations(spark, d), bd.RATING_THRESHOLD, min_duration=LEAST_SPEECH, n_per_speaker=SAMPLE_OF,
    )[1]
    return tagged.select("target", "parent", F.round("score", 6).alias("score"), "tags")


FROM_ROWS_SQL = O.with_(
    O.SPEAKER_EMBEDDINGS,
    O.ANNOTATIONS,
    VOTES,
    f"tot AS (SELECT speaker FROM speaker_embeddings GROUP BY speaker HAVING sum((label + 1) * 6.5) >= {LEAST_SPEECH})",
    "rn AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY md5('42:' || CAST(utterance_id AS VARCHAR)), utterance_id) AS r FROM speaker_embeddings)",
    f"sampled AS (SELECT * FROM rn WHERE r <= {SAMPLE_OF} AND speaker IN (SELECT speaker FROM tot))",
    MEDIANS.replace("FROM speaker_embeddings", "FROM sampled"),
    PAIRS,
    "best AS (SELECT target, arg_min(source, (-score, source_order)) AS parent, max(score) AS score FROM pairs GROUP BY target)",
) + "SELECT b.target, b.parent, round(b.score, 6) AS score, v.tags FROM best b JOIN votes v ON v.name = b.parent"


def match_statistics(spark: SparkSession, d: str) -> DataFrame:
    pairs, _, _, sources = _run(spark, d)
    # several aggregates read the pairs: materialise them once
    m = SIM.match_statistics(materialize(pairs, reliable=True), sources)
    return m.select(
        "annotated_sources",
        "sources_with_matches",
        F.round(F.col("mean_matches").cast("double"), 6).alias("mean_matches"),
        F.round(F.col("median_matches").cast("double"), 6).alias("median_matches"),
        "targets_matched",
    )


MATCH_STATS_SQL = O.with_(*_L2_CTES, "per AS (SELECT source, count(*) AS matches FROM pairs GROUP BY source)") + (
    "SELECT (SELECT count(*) FROM src) AS annotated_sources, (SELECT count(*) FROM per) AS sources_with_matches, "
    "(SELECT round(CAST(avg(matches) AS DOUBLE), 6) FROM per) AS mean_matches, "
    "(SELECT round(CAST(median(matches) AS DOUBLE), 6) FROM per) AS median_matches, "
    "(SELECT count(DISTINCT target) FROM pairs) AS targets_matched"
)


PAIR_BATCH = 50


def _scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = bd.table(spark, d, "embeddings").select(F.col("vec_id").alias("file"), "embedding")
    return SIM.pair_scores(bd.pairs(spark, d), bd.crop_embeddings(spark, d), e)


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _scored_pairs(spark, d)
    return s.select("wav1", "wav2", "label", F.round("score", 6).alias("score"))


# every crop of one file with every crop of the other
PAIR_CTE = f"""cr AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
  list_transform(range({bd.CROPS + 1} - label % 2), lambda c: CAST(list_slice(embedding, c * {bd.CROP_HOP} + 1, c * {bd.CROP_HOP} + {bd.CROP_WIDTH}) AS DOUBLE[])) AS crops
  FROM embeddings),
sp AS (SELECT a.vec_id AS wav1, b.vec_id AS wav2, CAST((a.label + b.label) % 6 + 1 AS DOUBLE) AS label,
  5.0 * ((list_avg(flatten(list_transform(a.crops, lambda x: list_transform(b.crops, lambda y: list_dot_product(x, y)))))
          + list_dot_product(a.v, b.v)) / 2.0) + 1.0 AS score
  FROM cr a JOIN cr b ON b.vec_id = a.vec_id + 1)"""
PAIR_SCORES_SQL = O.with_(PAIR_CTE) + "SELECT wav1, wav2, label, round(score, 6) AS score FROM sp"


def pair_correlation(spark: SparkSession, d: str) -> DataFrame:
    return SIM.pair_correlation(_scored_pairs(spark, d)).select(F.round("pearson", 6).alias("pearson"))


PAIR_CORR_SQL = O.with_(PAIR_CTE) + "SELECT round(corr(score, label), 6) AS pearson FROM sp"


def pair_correlation_batched(spark: SparkSession, d: str) -> DataFrame:
    """AGG13, the running figure: the mean of the correlations of batches of
    consecutive pairs."""
    scored = _scored_pairs(spark, d).withColumn("batch", F.expr(f"wav1 div {PAIR_BATCH}"))
    return SIM.pair_correlation(scored, "batch").select(F.round("pearson", 6).alias("pearson"))


PAIR_BATCHED_SQL = O.with_(
    PAIR_CTE,
    f"r AS (SELECT CASE WHEN count(*) > 1 AND stddev_pop(label) > 0 THEN corr(score, label) END AS r FROM sp GROUP BY wav1 // {PAIR_BATCH})",
) + "SELECT round(avg(r), 6) AS pearson FROM r"


def all_tags(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances_tagged(spark, d)
    noise = bin_label(F.col("snr"), SHIPPED_BIN_EDGES["noise"], SHIPPED_TEXT_BINS["snr_bins"])
    return u.select("utterance_id", TG.all_tags(F.array(noise), F.col("intrinsic_tags"), F.col("situational_tags")).alias("all_tags"))


def _all_tags_sql() -> str:
    noise = O.case_label("snr", SHIPPED_BIN_EDGES["noise"], SHIPPED_TEXT_BINS["snr_bins"])
    tags = O.sql_list(bd.LABEL_TAGS)
    return O.with_(O.UTTERANCES) + (
        f"SELECT utterance_id, list_sort(list_distinct(list_concat([{noise}], "
        f"CASE WHEN speakerid % 3 = 0 THEN [{tags}[speakerid % 10 + 1]] ELSE [] END, "
        "CASE WHEN utterance_id % 7 = 0 THEN [source] ELSE [] END))) AS all_tags FROM utterances"
    )


QUERIES = {
    "manifest_sample": (manifest_sample, MANIFEST_SAMPLE_SQL),
    "manifest_integrity": (manifest_integrity, MANIFEST_INTEGRITY_SQL),
    "speaker_median_vectors": (speaker_median_vectors, SPEAKER_MEDIANS_SQL),
    "tag_votes": (tag_votes, TAG_VOTES_SQL),
    "similar_speakers": (similar_speakers, SIMILAR_SQL),
    "similar_speakers_all": (similar_speakers_all, SIMILAR_ALL_SQL),
    "propagated_tags": (propagated_tags, PROPAGATED_SQL),
    "propagated_from_rows": (propagated_from_rows, FROM_ROWS_SQL),
    "match_statistics": (match_statistics, MATCH_STATS_SQL),
    "pair_scores": (pair_scores, PAIR_SCORES_SQL),
    "pair_correlation": (pair_correlation, PAIR_CORR_SQL),
    "pair_correlation_batched": (pair_correlation_batched, PAIR_BATCHED_SQL),
    "all_tags": (all_tags, _all_tags_sql()),
}
