"""Contract queries for segments, sample arrays, training codes and
snapshot bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import audio as AU
from ..functions.vectors import round_array
from ..operators import codes as C
from ..operators import segments as SG
from . import bindings as bd
from . import oracle as O

# ---------------------------------------------------------------------------
# Fixed values of these contract queries.
# ---------------------------------------------------------------------------
CODEBOOK_SIZE = 560  # small on purpose: some frames fall out of range
CROP_FRAMES = 1
CROP_COUNT = 10
LEADING_SECONDS = 2.5
BATCH_ROWS = 8
PAD_MULTIPLE = 4
MASK_ABOVE = 900
KEEP_SNAPSHOTS = 3
# ---------------------------------------------------------------------------


def _sum(arr) -> F.Column:
    return F.round(F.aggregate(arr.cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x), 6)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    parsed = SG.parse_segment_lines(bd.vad_lines(spark, d))
    kept, _ = SG.first_per_key(parsed)
    return kept


def segments_parsed(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("filename", "channel", "segment_no", "start", "end", "line_no")


VAD_SQL = f"""vad AS (
  SELECT vec_id AS line_no,
    CASE WHEN label = 8 THEN '# note ' || CAST(vec_id AS VARCHAR)
         WHEN label = 9 AND vec_id % 2 = 0 THEN ''
         WHEN label = 9 THEN 'clip' || CAST(({bd.SEGMENT_KEY}) // 2 AS VARCHAR) || '/channel' || CAST(vec_id % 2 + 1 AS VARCHAR) || chr(9) || '(0.0, 1.0) longform'
         ELSE 'clip' || CAST(({bd.SEGMENT_KEY}) // 2 AS VARCHAR) || '/channel' || CAST(vec_id % 2 + 1 AS VARCHAR) || chr(9) ||
              array_to_string(list_transform(range(0, label % 3 + 1), lambda i:
                 '(' || CAST(CAST(i AS DOUBLE) * 1.25 + CAST(vec_id % 4 AS DOUBLE) * 0.25 AS VARCHAR) || ', ' ||
                 CAST(CAST(i AS DOUBLE) * 1.25 + CAST(vec_id % 4 AS DOUBLE) * 0.25 + 0.5 + CAST(label % 4 AS DOUBLE) * 0.125 AS VARCHAR) || ')'), ' ')
    END AS line
  FROM embeddings),
segs AS (
  SELECT line_no, split_part(split_part(line, chr(9), 1), '/', 1) AS filename, split_part(split_part(line, chr(9), 1), '/', 2) AS channel,
         CAST(i AS DOUBLE) * 1.25 + CAST(line_no % 4 AS DOUBLE) * 0.25 AS start,
         CAST(i AS DOUBLE) * 1.25 + CAST(line_no % 4 AS DOUBLE) * 0.25 + 0.5 + CAST(label % 4 AS DOUBLE) * 0.125 AS "end",
         CAST(i AS INTEGER) AS segment_no
  FROM vad JOIN embeddings ON vec_id = line_no, range(0, label % 3 + 1) t(i)
  WHERE label < 8),
firsts AS (SELECT filename, channel, min(line_no) AS line_no FROM segs GROUP BY 1, 2),
kept AS (SELECT s.* FROM segs s JOIN firsts f USING (filename, channel, line_no))"""

SEGMENTS_PARSED_SQL = O.with_(VAD_SQL) + 'SELECT filename, channel, segment_no, start, "end", line_no FROM kept'


def segment_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Segments of lines that name a pair an earlier line has named."""
    _, rejects = SG.first_per_key(SG.parse_segment_lines(bd.vad_lines(spark, d)))
    return rejects.select("filename", "channel", "segment_no", "line_no")


SEGMENT_REJECTS_SQL = O.with_(VAD_SQL) + (
    "SELECT filename, channel, segment_no, line_no FROM segs s "
    "WHERE line_no > (SELECT f.line_no FROM firsts f WHERE f.filename = s.filename AND f.channel = s.channel)"
)


def clips_without_segments(spark: SparkSession, d: str) -> DataFrame:
    _, missing = SG.cut_segments(bd.clips(spark, d), _segments(spark, d))
    return missing.select("filename", "channel")


CLIPS_WITHOUT_SQL = O.with_(VAD_SQL) + (
    "SELECT filename, channel FROM (SELECT 'clip' || CAST(vec_id // 2 AS VARCHAR) AS filename, 'channel' || CAST(vec_id % 2 + 1 AS VARCHAR) AS channel FROM embeddings) c "
    "WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.filename = c.filename AND k.channel = c.channel)"
)


def segment_cut(spark: SparkSession, d: str) -> DataFrame:
    clips = bd.clips(spark, d)
    cut, _ = SG.cut_segments(clips, _segments(spark, d))
    return cut.select(
        "filename", "channel", "segment_no", "segment_name",
        F.size("samples").cast("bigint").alias("n_samples"), _sum(F.col("samples")).alias("total"),
    )


SEGMENT_CUT_SQL = O.with_(
    VAD_SQL,
    f"""clips AS (SELECT 'clip' || CAST(vec_id // 2 AS VARCHAR) AS filename, 'channel' || CAST(vec_id % 2 + 1 AS VARCHAR) AS channel,
   CAST(embedding AS DOUBLE[]) AS samples, {bd.CLIP_RATE} AS rate FROM embeddings),
j AS (SELECT k.*, c.samples, len(c.samples) AS n,
   CAST(floor(CAST(floor(k.start * 1000) AS INTEGER) * c.rate / 1000.0) AS INTEGER) AS a0,
   CAST(floor(CAST(floor(k."end" * 1000) AS INTEGER) * c.rate / 1000.0) AS INTEGER) AS b0
  FROM kept k JOIN clips c USING (filename, channel)),
j2 AS (SELECT *, least(greatest(a0, 0), n) AS a FROM j),
j3 AS (SELECT *, least(greatest(b0, a), n) AS b FROM j2)""",
) + (
    "SELECT filename, channel, segment_no, "
    "filename || '_' || channel || '_segment_' || CAST(start AS VARCHAR) || '_' || CAST(\"end\" AS VARCHAR) || '.wav' AS segment_name, "
    "CAST(b - a AS BIGINT) AS n_samples, round(coalesce(list_sum(list_slice(samples, a + 1, b)), 0.0), 6) AS total FROM j3"
)


def peak_normalised(spark: SparkSession, d: str) -> DataFrame:
    c = bd.clips(spark, d)
    return c.select("id", round_array(AU.peak_normalize(F.col("samples").cast("array<double>"))).alias("samples"))


_PEAK = 10 ** (-0.1 / 20.0)
PEAK_SQL = f"""WITH c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS s FROM embeddings),
p AS (SELECT id, s, list_max(list_transform(s, lambda x: abs(x))) AS peak FROM c)
SELECT id, CASE WHEN peak > 0 THEN list_transform(s, lambda x: round(x * CAST({_PEAK!r} AS DOUBLE) / peak, 6))
                ELSE list_transform(s, lambda x: round(x * 0.0, 6)) END AS samples FROM p"""


def clip_crops(spark: SparkSession, d: str) -> DataFrame:
    c = AU.crops_table(bd.clips(spark, d), "samples", CROP_FRAMES, CROP_COUNT)
    crops = c.select("id", F.posexplode("crops").alias("crop_no", "crop"))
    return crops.select(
        "id", F.col("crop_no").cast("bigint").alias("crop_no"), F.size("crop").cast("bigint").alias("n"), _sum(F.col("crop")).alias("total")
    )


def _crops_sql() -> str:
    max_audio = CROP_FRAMES * 160 + 240
    n = CROP_COUNT
    return f"""WITH c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS s FROM embeddings),
p AS (SELECT id, CASE WHEN len(s) <= {max_audio} THEN list_transform(range(0, {max_audio + 1}), lambda i: s[i % len(s) + 1]) ELSE s END AS padded FROM c),
st AS (SELECT id, padded, i AS crop_no,
   CASE WHEN i = {n - 1} THEN len(padded) - {max_audio} ELSE CAST(floor(CAST(i AS DOUBLE) * (CAST(len(padded) - {max_audio} AS DOUBLE) / {float(n - 1)})) AS INTEGER) END AS s0
   FROM p, range(0, {n}) t(i))
SELECT id, crop_no, CAST(len(list_slice(padded, s0 + 1, s0 + {max_audio})) AS BIGINT) AS n,
       round(list_sum(list_slice(padded, s0 + 1, s0 + {max_audio})), 6) AS total FROM st"""


def leading_slice(spark: SparkSession, d: str) -> DataFrame:
    c = bd.clips(spark, d)
    s = AU.leading_slice(F.col("samples"), LEADING_SECONDS, F.col("sampling_rate"))
    return c.select("id", F.size(s).cast("bigint").alias("n"), _sum(s).alias("total"))


LEADING_SQL = (
    f"SELECT vec_id AS id, CAST(len(list_slice(embedding, 1, {int(LEADING_SECONDS * bd.CLIP_RATE)})) AS BIGINT) AS n, "
    f"round(list_sum(list_slice(CAST(embedding AS DOUBLE[]), 1, {int(LEADING_SECONDS * bd.CLIP_RATE)})), 6) AS total FROM embeddings"
)


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return bd.codes(spark, d)


def delay_labels(spark: SparkSession, d: str) -> DataFrame:
    c = _codes(spark, d)
    return c.select("id", A.delay_pattern(F.col("labels"), bd.CODEBOOKS, bd.BOS_ID, bd.EOS_ID).alias("labels"))


DELAY_SQL = O.with_(O.CODES) + (
    f"SELECT id, list_transform(labels, lambda row, k: list_concat(list_concat(list_transform(range(0, k - 1), lambda z: {bd.BOS_ID}), row), "
    f"list_transform(range(0, {bd.CODEBOOKS} - k + 1), lambda z: {bd.EOS_ID}))) AS labels FROM codes"
)


def undelay_codes(spark: SparkSession, d: str) -> DataFrame:
    c = C.delayed_labels(_codes(spark, d), "labels", bd.CODEBOOKS, bd.BOS_ID, bd.EOS_ID, "delayed")
    u = C.undelayed_codes(c, "delayed", bd.CODEBOOKS, CODEBOOK_SIZE, "codes")
    return u.select("id", "codes", F.size(F.element_at("codes", 1)).cast("bigint").alias("n_frames"))


def _undelay_sql() -> str:
    cond = " AND ".join(f"labels[{k + 1}][j] < {CODEBOOK_SIZE}" for k in range(bd.CODEBOOKS))
    return O.with_(O.CODES, f"kf AS (SELECT id, labels, list_filter(range(1, {bd.FRAMES + 1}), lambda j: {cond}) AS keep FROM codes)") + (
        "SELECT id, list_transform(labels, lambda r: list_transform(keep, lambda j: r[j])) AS codes, CAST(len(keep) AS BIGINT) AS n_frames FROM kf"
    )


def shift_right(spark: SparkSession, d: str) -> DataFrame:
    c = _codes(spark, d)
    row = c.select("id", F.posexplode("labels").alias("codebook", "row"))
    ids = F.transform("row", lambda x: F.when(x > MASK_ABOVE, F.lit(-100)).otherwise(x))
    return row.select("id", F.col("codebook").cast("bigint").alias("codebook"), A.shift_right(ids, bd.EOS_ID, bd.BOS_ID).alias("ids"))


SHIFT_SQL = O.with_(O.CODES) + (
    f"SELECT id, k - 1 AS codebook, list_transform(list_concat([{bd.BOS_ID}], list_slice(list_transform(labels[k], lambda x: CASE WHEN x > {MASK_ABOVE} THEN -100 ELSE x END), 1, {bd.FRAMES - 1})), "
    f"lambda x: CASE WHEN x = -100 THEN {bd.EOS_ID} ELSE x END) AS ids FROM codes, range(1, {bd.CODEBOOKS + 1}) r(k)"
)


def _with_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d).withColumn("target_length", (F.lit(640) + (F.col("id") % 7) * 100).cast("int")).withColumn(
        "batch", F.expr(f"id div {BATCH_ROWS}")
    )


def trimmed_codes(spark: SparkSession, d: str) -> DataFrame:
    t = C.trim_codes(_with_lengths(spark, d), "labels", "target_length", "batch")
    return t.select("id", "batch", F.size(F.element_at("trimmed", 1)).cast("bigint").alias("n_frames"), "trimmed")


TRIM_SQL = O.with_(
    O.CODES,
    f"cl AS (SELECT *, 640 + (id % 7) * 100 AS target_length, id // {BATCH_ROWS} AS batch FROM codes)",
    "ml AS (SELECT batch, max(target_length) AS maxlen FROM cl GROUP BY batch)",
    f"k AS (SELECT cl.*, CAST(floor(({bd.FRAMES} / maxlen) * target_length) AS INTEGER) AS keep FROM cl JOIN ml USING (batch))",
) + "SELECT id, batch, CAST(len(list_slice(labels[1], 1, keep)) AS BIGINT) AS n_frames, list_transform(labels, lambda r: list_slice(r, 1, keep)) AS trimmed FROM k"


def longest_clip(spark: SparkSession, d: str) -> DataFrame:
    c = _with_lengths(spark, d).withColumn(
        "labels", F.transform("labels", lambda r: F.slice(r, 1, F.col("id") % 16 + 1))
    )
    r = C.longest_clip(c, "target_length", "labels")
    return r.select(F.col("target_length").cast("bigint").alias("target_length"), F.col("label_length").cast("bigint").alias("label_length"))


LONGEST_SQL = O.with_(O.CODES) + (
    "SELECT CAST(max(640 + (id % 7) * 100) AS BIGINT) AS target_length, "
    "CAST(max(id % 16 + 1) FILTER (WHERE 640 + (id % 7) * 100 = (SELECT max(640 + (id % 7) * 100) FROM codes)) AS BIGINT) AS label_length FROM codes"
)


def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    # a batch holds all codebooks of its clips; some clips have no batch
    c = _codes(spark, d).select("id", F.expr(f"CASE WHEN id % 9 <> 8 THEN id div {BATCH_ROWS} END").alias("batch"), F.posexplode("labels").alias("codebook", "row"))
    c = c.select("id", "batch", F.col("codebook").cast("bigint").alias("codebook"), F.slice("row", 1, ((F.col("id") + F.col("codebook")) % 16 + 1).cast("int")).alias("seq"))
    p = C.pad_batches(c, "seq", "batch", pad_value=-100, multiple_of=PAD_MULTIPLE)
    return p.select("id", "batch", "codebook", "padded")


PADDED_SQL = O.with_(
    O.CODES,
    f"s AS (SELECT id, CASE WHEN id % 9 <> 8 THEN id // {BATCH_ROWS} END AS batch, k AS codebook, list_slice(labels[k + 1], 1, (id + k) % 16 + 1) AS seq FROM codes, range({bd.CODEBOOKS}) r(k))",
    f"t AS (SELECT batch, CAST(ceil(max(len(seq)) / {float(PAD_MULTIPLE)}) * {PAD_MULTIPLE} AS INTEGER) AS target FROM s GROUP BY batch)",
) + (
    "SELECT id, s.batch, codebook, list_concat(seq, list_transform(range(0, greatest(target - len(seq), 0)), lambda z: -100)) AS padded FROM s JOIN t ON s.batch IS NOT DISTINCT FROM t.batch"
)


def snapshot_retention(spark: SparkSession, d: str) -> DataFrame:
    return C.snapshot_retention(bd.snapshots(spark, d), "name", "run", KEEP_SNAPSHOTS)


SNAPSHOT_SQL = f"""WITH s AS (SELECT DISTINCT CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS run, CASE WHEN o_orderkey % 17 = 0 THEN 'checkpoint-99999999999999999999' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 11 = 0 THEN 'notes-' || CAST(o_orderkey AS VARCHAR)
    WHEN o_orderkey % 3 = 0 THEN 'checkpoint-' || CAST(o_orderkey AS VARCHAR)
    ELSE 'checkpoint-' || CAST(o_orderkey AS VARCHAR) || '-epoch-' || CAST(o_custkey % 10 AS VARCHAR) END AS name FROM orders),
p AS (SELECT run, name, TRY_CAST(nullif(regexp_extract(name, '^checkpoint-(\\d+)(?:-epoch-(\\d+))?$', 1), '') AS BIGINT) AS step,
             TRY_CAST(nullif(regexp_extract(name, '^checkpoint-(\\d+)(?:-epoch-(\\d+))?$', 2), '') AS BIGINT) AS epoch FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY run, step IS NULL ORDER BY step DESC, name DESC) AS rn FROM p)
SELECT run, name, step, epoch, step IS NULL OR rn <= {KEEP_SNAPSHOTS} AS keep, step IS NOT NULL AND rn = 1 AS latest FROM r"""


QUERIES = {
    "segments_parsed": (segments_parsed, SEGMENTS_PARSED_SQL),
    "segment_rejects": (segment_rejects, SEGMENT_REJECTS_SQL),
    "clips_without_segments": (clips_without_segments, CLIPS_WITHOUT_SQL),
    "segment_cut": (segment_cut, SEGMENT_CUT_SQL),
    "peak_normalised": (peak_normalised, PEAK_SQL),
    "clip_crops": (clip_crops, _crops_sql()),
    "leading_slice": (leading_slice, LEADING_SQL),
    "delay_labels": (delay_labels, DELAY_SQL),
    "undelay_codes": (undelay_codes, _undelay_sql()),
    "shift_right": (shift_right, SHIFT_SQL),
    "trimmed_codes": (trimmed_codes, TRIM_SQL),
    "longest_clip": (longest_clip, LONGEST_SQL),
    "padded_batches": (padded_batches, PADDED_SQL),
    "snapshot_retention": (snapshot_retention, SNAPSHOT_SQL),
}
