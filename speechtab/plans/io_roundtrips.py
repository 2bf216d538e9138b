"""Contract queries that go through the readers and writers: each writes a
table derived from the test data into a fresh folder under the session's
checkpoint directory, reads it back with the library reader and continues
the computation, so the oracle sees the same values as without the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import SPEAKER_RATE_BINS
from ..operators import binning as B
from ..operators import enrich as EN
from ..operators import prepare as P
from ..operators import reports as R
from ..operators import segments as SG
from ..operators import speakers as SPK
from ..operators import tags as TG
from ..operators import training as TR
from ..schema import MANIFEST
from ..sources import clustered as CL
from ..sources import io as IO
from ..streaming import scratch_dir
from . import basic_tags as BT
from . import bindings as bd
from . import oracle as O
from . import preparation as PR
from . import propagation as PP
from . import signals as PS
from . import streams as ST

CHUNK_IDS = 64  # ids to a chunk
TRAINING_LAYOUT = TR.CodeLayout(bd.CODEBOOKS, bd.BOS_ID, bd.EOS_ID)
TRAINING_LIMITS = TR.TrainingLimits(500, 6.5, 12.3, 100, max_description_tokens=20, max_prompt_tokens=600)


def manifest_tsv(spark: SparkSession, d: str) -> DataFrame:
    """AGG4 + WIN1 -> SNK2 (TSV) -> SRC2 -> AGG8."""
    u = bd.utterances(spark, d)
    m = SPK.build_manifest(u, "speakerid", "utterance_id", "duration", min_duration=300.0, n_per_speaker=10, seed=42)
    m = m.select(
        F.format_string("clips/%d.wav", F.col("utterance_id")).alias("audio_path"),
        F.col("speakerid").cast("string").alias("speaker"),
        F.concat(F.lit("speaker_"), F.col("speakerid").cast("string")).alias("name"),
        "duration",
    )
    path = scratch_dir(spark, "manifest-tsv")
    IO.write_tsv(m, path, ["audio_path", "speaker", "name", "duration"])
    back = IO.read_tsv(spark, path, MANIFEST)
    return back.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("speaker").alias("speakers"),
        F.round(F.sum(F.col("duration").cast("decimal(38,9)")).cast("double"), 6).alias("total_duration"),
    )


MANIFEST_TSV_SQL = PP.MANIFEST_SAMPLE_SQL.replace(
    "SELECT speakerid AS speaker, utterance_id, duration FROM r WHERE rn <= 10 AND speakerid IN (SELECT speakerid FROM tot)",
    "SELECT count(*) AS rows, count(DISTINCT speakerid) AS speakers, "
    "round(CAST(sum(CAST(duration AS DECIMAL(38,9))) AS DOUBLE), 6) AS total_duration "
    "FROM r WHERE rn <= 10 AND speakerid IN (SELECT speakerid FROM tot)",
)


def annotation_votes_json(spark: SparkSession, d: str) -> DataFrame:
    """Annotations written as JSON lines (name, tags with repeats) -> SRC3
    reader -> AGG6 votes."""
    ann = bd.annotations(spark, d)
    per_name = ann.groupBy("name").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    path = scratch_dir(spark, "annotations-json")
    IO.write_json_rows(per_name.select(F.col("name").cast("string").alias("name"), "tags"), path)
    votes = TG.tag_votes(IO.read_annotation_lines(spark, path), 2)
    return votes.select(F.col("name").cast("bigint").alias("name"), "tags")


ANNOTATION_JSON_SQL = PP.TAG_VOTES_SQL


def annotation_map_json(spark: SparkSession, d: str) -> DataFrame:
    """Annotations as JSON objects ``{name: [tag, ...]}``, one file for each of
    a number of name buckets that grows with the names -> SRC3 map reader -> AGG6 votes."""
    ann = bd.annotations(spark, d)
    per_name = ann.groupBy("name").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    per_name = per_name.withColumn("bucket", F.expr("name div 64"))  # at most 64 names to an object
    maps = per_name.groupBy("bucket").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("name").cast("string"), "tags")))).alias("value"))
    path = scratch_dir(spark, "annotation-map")
    maps.write.partitionBy("bucket").text(path)
    votes = TG.tag_votes(IO.read_annotation_map(spark, path), 2)
    return votes.select(F.col("name").cast("bigint").alias("name"), "tags")


def aligned_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Sampled manifest rows with their embeddings, joined by id (SRC5)."""
    e = bd.speaker_embeddings(spark, d).select("utterance_id", "embedding")
    a = IO.align_embeddings(PP.manifest_sample(spark, d), e)
    return a.select("utterance_id", "speaker", F.size("embedding").cast("bigint").alias("n"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


ALIGNED_SQL = f"""WITH m AS ({PP.MANIFEST_SAMPLE_SQL})
SELECT m.utterance_id, m.speaker, CAST(len(e.embedding) AS BIGINT) AS n, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first
FROM m JOIN embeddings e ON e.vec_id = m.utterance_id"""

#: Folder -> its languages; every other language, NULL among them, goes to the last.
LOADED = {"en": ["en"], "de": ["de"], "fr": ["fr"], "rest": None}
LOADED_SPLITS = ["train", "dev"]


def loaded_sources(spark: SparkSession, d: str) -> DataFrame:
    """One folder and one metadata folder for each language -> SRC7 loader, all
    splits, metadata by id."""
    docs = bd.transcripts(spark, d).select("id", "lang", "n_chars", F.when(F.col("id") % 10 < 8, "train").otherwise("dev").alias("split"))
    root = scratch_dir(spark, "sources")
    folder = F.lit(list(LOADED)[-1])
    for name, langs in LOADED.items():
        folder = F.when(F.col("lang").isin(langs), name).otherwise(folder) if langs else folder
    # all folders in one pass each: the loader reads <folder>/<config>
    docs = docs.withColumn("folder", folder).withColumn("config", F.lit("base"))
    docs.select("id", "split", "n_chars", "folder", "config").write.partitionBy("folder", "config").parquet(f"{root}/data")
    docs.select("id", "split", (F.col("n_chars") * 2).alias("doubled"), "folder", "config").write.partitionBy("folder", "config").parquet(f"{root}/md")
    names = [(f, s) for f in LOADED for s in LOADED_SPLITS if IO.exists(spark, f"{root}/data/folder={f}")]
    specs = IO.parse_sources(
        "+".join(f"data/folder={f}" for f, _ in names), config="+".join(["config=base"] * len(names)),
        split="+".join(s for _, s in names), metadata="+".join(f"md/folder={f}" for f, _ in names),
    )
    out = IO.load_many(spark, specs, root)
    return out.select("id", F.regexp_extract("source", "folder=(.*)", 1).alias("source"), "split", "n_chars", "doubled")


LOADED_SQL = """SELECT doc_id AS id, CASE WHEN lang IN ('en', 'de', 'fr') THEN lang ELSE 'rest' END AS source,
  CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'dev' END AS split, n_chars, n_chars * 2 AS doubled FROM documents"""


def segment_lines_file(spark: SparkSession, d: str) -> DataFrame:
    """Segment lines as text files -> SRC8 reader -> STR1, counted by channel."""
    path = scratch_dir(spark, "segment-lines")
    bd.vad_lines(spark, d).select("line").write.text(path)
    parsed = SG.parse_segment_lines(SG.read_lines(spark, path))
    return parsed.groupBy("filename", "channel").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("end"), 6).alias("ends"))


SEGMENT_LINES_SQL = O.with_(PS.VAD_SQL) + 'SELECT filename, channel, count(*) AS segments, round(sum("end"), 6) AS ends FROM segs GROUP BY 1, 2'


def segments_from_files(spark: SparkSession, d: str) -> DataFrame:
    """Segment lines as several text files in line order -> SRC8 reader ->
    STR1 -> WIN7: which line comes first is known from the files alone."""
    path = scratch_dir(spark, "segment-files")
    lines = bd.vad_lines(spark, d).repartitionByRange(4, "line_no").sortWithinPartitions("line_no")
    lines.select("line").write.text(path)
    kept, _ = SG.first_per_key(SG.parse_segment_lines(SG.read_lines(spark, path)))
    return kept.select("filename", "channel", "segment_no", "start", "end")


SEGMENTS_FILES_SQL = O.with_(PS.VAD_SQL) + 'SELECT filename, channel, segment_no, start, "end" FROM kept'


def listed_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC6 + FLT1: clips saved in a folder for every ten speakers, some of
    them left out; the listing of the files says which folders are there."""
    e = bd.speaker_embeddings(spark, d).select("utterance_id", F.expr("speaker div 10").alias("shelf"))
    root = scratch_dir(spark, "listing")
    e.where(F.col("shelf") % 4 != 3).write.partitionBy("shelf").parquet(root)
    files = IO.list_files(spark, root, "*.parquet", exclude_like=["%/_temporary/%"]).where(F.col("length") > 0)
    listing = files.select(F.regexp_extract("path", "(shelf=\\d+)/[^/]+$", 1).alias("path")).distinct()
    wanted = e.select("utterance_id", F.concat(F.lit("shelf="), F.col("shelf").cast("string")).alias("path"))
    return P.missing_paths(wanted, listing, "path", "path")


LISTED_SQL = O.with_(O.SPEAKER_EMBEDDINGS) + (
    "SELECT utterance_id, 'shelf=' || CAST(speaker // 10 AS VARCHAR) AS path FROM speaker_embeddings WHERE (speaker // 10) % 4 = 3"
)


def saved_edges_labels(spark: SparkSession, d: str) -> DataFrame:
    """AGG2 -> SNK4 (edges JSON) -> reload -> BIN1 with the saved edges."""
    u = bd.utterances(spark, d)
    learned = B.learn_edges(u, "speaking_rate_value", len(SPEAKER_RATE_BINS), 4.0, split_col="split", leading_split="train")
    path = scratch_dir(spark, "edges")
    IO.save_edges(IO.edges_table({"speaking_rate": learned}), path)
    edges = IO.load_edges(spark, path)["speaking_rate"]
    return B.apply_bins(u, "speaking_rate_value", "speaking_rate", SPEAKER_RATE_BINS, edges).select("utterance_id", "speaking_rate")


SAVED_EDGES_SQL = BT.QUERIES["rate_labels_learned"][1]


def split_table_reuse(spark: SparkSession, d: str) -> DataFrame:
    """SNK1 (partitioned by split, reused when present) -> SRC1 one split."""
    u = bd.utterances(spark, d).select("utterance_id", "speakerid", "duration", "split")
    path = scratch_dir(spark, "split-table")
    IO.save_or_reuse(spark, u, path)
    dev = IO.load_table(spark, path, split="dev")
    return dev.groupBy("speakerid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("duration").cast("decimal(38,9)")).cast("double"), 6).alias("duration"))


SPLIT_REUSE_SQL = O.with_(O.UTTERANCES) + (
    "SELECT speakerid, count(*) AS n, round(CAST(sum(CAST(duration AS DECIMAL(38,9))) AS DOUBLE), 6) AS duration FROM utterances WHERE split = 'dev' GROUP BY speakerid"
)


def chunked_codes(spark: SparkSession, d: str) -> DataFrame:
    """SNK5 + STM3: codes written in chunks of 64 ids; a first run got as far
    as every third chunk, a second one writes the rest in one pass.  The folder
    is read back as one table."""
    c = bd.codes(spark, d).select("id", F.size(F.element_at("labels", 1)).alias("frames"), F.expr(f"id div {CHUNK_IDS}").alias("chunk_id"))
    path = scratch_dir(spark, "chunks")
    IO.write_chunks(c.where(F.col("chunk_id") % 3 == 0), path)
    done = IO.write_chunks(c, path)
    back = spark.read.parquet(path).withColumn("run", F.when(F.col("chunk_id").isin(done), 1).otherwise(2))
    return back.groupBy(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("run").cast("bigint").alias("run")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("frames").alias("frames")
    )


CHUNKED_SQL = (
    f"SELECT vec_id // {CHUNK_IDS} AS chunk_id, CAST(CASE WHEN vec_id // {CHUNK_IDS} % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS run, "
    "count(*) AS rows, CAST(sum(16) AS BIGINT) AS frames FROM embeddings GROUP BY 1, 2"
)


def training_table(spark: SparkSession, d: str) -> DataFrame:
    """Texts, their metadata and their codes -> the training table as one plan
    -> chunks in one pass -> batches of similar length over the saved table."""
    dataset = bd.transcripts(spark, d).select("id", F.col("transcription").alias("prompt"), "lang", "source")
    metadata = bd.metadata(spark, d).withColumn(
        "description", F.concat_ws(" ", F.lit("a clip of quality"), F.col("quality").cast("string"), F.lit("\n"))
    )
    codes = bd.codes(spark, d).select(
        "id", F.col("labels").alias("codes"), (F.lit(640) + (F.col("id") % 7) * 100).cast("int").alias("target_length"),
        F.expr(f"id div {PS.BATCH_ROWS}").alias("batch"),
    )
    t = TR.training_table(dataset, metadata, codes, TRAINING_LAYOUT, TRAINING_LIMITS, on_mismatch="inner")
    t = t.select("id", "source", "quality", "prompt_tokens", "description_tokens", "target_length", "labels", F.expr(f"id div {CHUNK_IDS}").alias("chunk_id"))
    path = scratch_dir(spark, "training-table")
    IO.write_chunks(t, path)
    saved = spark.read.schema(t.schema).parquet(path)
    b = P.length_batches(saved, "id", "target_length", batch_size=8, megabatch_rows=64, seed=42)
    numbers = ["prompt_tokens", "description_tokens", "target_length", "chunk_id", "position"]
    return b.select("id", "source", "quality", "labels", "megabatch", "batch", *[F.col(c).cast("bigint").alias(c) for c in numbers])


TRAINING_SQL = O.with_(
    O.CODES,
    f"cl AS (SELECT *, 640 + (id % 7) * 100 AS target_length, id // {PS.BATCH_ROWS} AS enc FROM codes)",
    "ml AS (SELECT enc, max(target_length) AS maxlen FROM cl GROUP BY enc)",
    f"k AS (SELECT cl.*, CAST(floor(({bd.FRAMES} / maxlen) * target_length) AS INTEGER) AS keep FROM cl JOIN ml USING (enc))",
    "lab AS (SELECT id, target_length, ["
    + ", ".join(
        f"list_concat(list_concat(list_transform(range({c}), lambda z: {bd.BOS_ID}), list_slice(labels[{c + 1}], 1, keep)), list_transform(range({bd.CODEBOOKS - c}), lambda z: {bd.EOS_ID}))"
        for c in range(bd.CODEBOOKS)
    )
    + "] AS labels FROM k WHERE target_length > 650 AND target_length < 1230)",
    f"""txt AS (SELECT d.doc_id AS id, d.source, l.quality,
  len(regexp_extract_all(regexp_replace(replace(d.text, chr(10), ' '), '\\s+$', ''), '{PR._TOKEN}', 1)) AS prompt_tokens,
  len(regexp_extract_all('a clip of quality ' || CAST(l.quality AS VARCHAR), '{PR._TOKEN}', 1)) AS description_tokens
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)""",
    f"t AS (SELECT txt.*, target_length, labels, id // {CHUNK_IDS} AS chunk_id FROM txt JOIN lab USING (id) WHERE prompt_tokens < 600 AND description_tokens < 20)",
    "nm AS (SELECT greatest(1, CAST(ceil(count(*) / 64.0) AS BIGINT)) AS n_mb FROM t)",
    "sh AS (SELECT t.*, CAST(('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % n_mb AS megabatch FROM t, nm)",
    "ps AS (SELECT *, row_number() OVER (PARTITION BY megabatch ORDER BY target_length DESC, id) AS position FROM sh)",
) + "SELECT id, source, quality, labels, megabatch, (position - 1) // 8 AS batch, prompt_tokens, description_tokens, target_length, chunk_id, position FROM ps"


PART_ROWS = 40  # rows to a part of a clustered table
BUCKETS = 8
TIE = 1e-9  # means that lie between two rounded values go up in both engines


def clustered_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Utterances clustered by speaker (SRT1) -> mean pitch by speaker (AGG1),
    saved beside them -> read back in speaker order with the mean (JN3); the
    last step moves no row."""
    u = bd.utterances(spark, d).select("utterance_id", "speakerid", "utterance_pitch_mean", "gender")
    root = scratch_dir(spark, "clustered")
    name = "speechtab_" + root.rsplit("-", 1)[-1]
    rows = CL.save_clustered(u, name, f"{root}/rows", "speakerid", "utterance_id", BUCKETS, PART_ROWS)
    means = B.speaker_means(rows, "speakerid", "utterance_pitch_mean", "gender", "utterance_id")
    means = means.select("speakerid", F.col("utterance_pitch_mean").alias("speaker_pitch"))
    beside = CL.save_beside(means, rows, f"{name}_means", f"{root}/means", "speakerid", BUCKETS)
    out = CL.attach(rows, beside, "speakerid", "utterance_id")
    return out.select("utterance_id", "speakerid", "part", "position", F.round(F.col("speaker_pitch") + TIE, 6).alias("speaker_pitch"))


CLUSTERED_SQL = O.with_(
    O.UTTERANCES,
    f"n AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY speakerid) / {PART_ROWS}.0) AS BIGINT) AS parts FROM utterances)",
    "p AS (SELECT *, CAST(CASE WHEN parts = 1 THEN 0 ELSE CAST(('0x' || substr(md5('42:' || CAST(utterance_id AS VARCHAR)), 1, 8)) AS BIGINT) % parts END AS INTEGER) AS part FROM n)",
) + (
    "SELECT utterance_id, speakerid, part, row_number() OVER (PARTITION BY speakerid ORDER BY part, utterance_id) - 1 AS position, "
    f"CASE WHEN speakerid IS NOT NULL THEN round(avg(utterance_pitch_mean) OVER (PARTITION BY speakerid) + {TIE}, 6) END AS speaker_pitch FROM p"
)


def clustered_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts clustered by source, of which a few hold most rows -> total
    length by source, saved beside them -> read back in order with the total."""
    t = bd.transcripts(spark, d).select("id", "source", "n_chars")
    root = scratch_dir(spark, "clustered")
    name = "speechtab_" + root.rsplit("-", 1)[-1]
    rows = CL.save_clustered(t, name, f"{root}/rows", "source", "id", BUCKETS, PART_ROWS)
    totals = rows.groupBy("source").agg(F.sum("n_chars").alias("source_chars"))
    beside = CL.save_beside(totals, rows, f"{name}_totals", f"{root}/totals", "source", BUCKETS)
    return CL.attach(rows, beside, "source", "id").select("id", "source", "part", "position", "source_chars")


CLUSTERED_TRANSCRIPTS_SQL = O.with_(
    f"n AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY source) / {PART_ROWS}.0) AS BIGINT) AS parts FROM documents)",
    "p AS (SELECT *, CAST(CASE WHEN parts = 1 THEN 0 ELSE CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % parts END AS INTEGER) AS part FROM n)",
) + (
    "SELECT doc_id AS id, source, part, CASE WHEN source IS NOT NULL THEN row_number() OVER (PARTITION BY source ORDER BY part, doc_id) - 1 END AS position, "
    "CASE WHEN source IS NOT NULL THEN CAST(sum(n_chars) OVER (PARTITION BY source) AS BIGINT) END AS source_chars FROM p"
)


def observed_reports(spark: SparkSession, d: str) -> DataFrame:
    """Merge (JN1), first segment lines (WIN7), cut clips (JN9) and captured
    failures (UDF3), each written once; what did not match, was rejected or
    failed is counted by the write itself."""
    lines = SG.parse_segment_lines(bd.vad_lines(spark, d))
    first, rejected = R.first_per_key_counted(lines)
    root = scratch_dir(spark, "reports")
    merged, unmatched = R.merge_counted(bd.transcripts(spark, d).select("id", "source", "lang"), PR._metadata_with_clash(spark, d))
    merged.write.parquet(f"{root}/merged")
    first.write.parquet(f"{root}/first")
    cut, missing = R.cut_segments_counted(bd.clips(spark, d), spark.read.schema(first.schema).parquet(f"{root}/first"))
    cut.write.parquet(f"{root}/cut")
    scored = EN.enrich(bd.transcripts(spark, d), ST._density_scorer_factory, ["transcription"], ST.SCORE, keep_cols=["id"], on_error="capture")
    scored, failed = R.enriched_counted(scored)
    scored.write.parquet(f"{root}/scored")
    counts = {"merge": unmatched.get, "segments": rejected.get, "clips": missing.get, "scores": failed.get}
    rows = [(report, what, n) for report, seen in counts.items() for what, n in seen.items()]
    return spark.createDataFrame(rows, "report string, what string, n bigint")


OBSERVED_SQL = O.with_(
    PS.VAD_SQL,
    "clips AS (SELECT 'clip' || CAST(vec_id // 2 AS VARCHAR) AS filename, 'channel' || CAST(vec_id % 2 + 1 AS VARCHAR) AS channel FROM embeddings)",
    "mj AS (SELECT d.doc_id AS a, l.doc_id AS b, count(l.doc_id) OVER (PARTITION BY l.doc_id) AS times FROM documents d FULL OUTER JOIN labels l ON l.doc_id = d.doc_id)",
    "cj AS (SELECT c.filename, k.filename AS found FROM clips c LEFT JOIN kept k ON k.filename = c.filename AND k.channel = c.channel)",
) + """SELECT 'merge' AS report, 'rows' AS what, count(*) AS n FROM mj
UNION ALL SELECT 'merge', 'dataset_only', count(*) FROM mj WHERE b IS NULL
UNION ALL SELECT 'merge', 'metadata_only', count(*) FROM mj WHERE a IS NULL
UNION ALL SELECT 'merge', 'repeated', count(*) FROM mj WHERE a IS NOT NULL AND b IS NOT NULL AND times > 1
UNION ALL SELECT 'segments', 'rows', count(*) FROM segs
UNION ALL SELECT 'segments', 'rejected', (SELECT count(*) FROM segs) - (SELECT count(*) FROM kept)
UNION ALL SELECT 'clips', 'rows', count(*) FROM cj
UNION ALL SELECT 'clips', 'without_segments', count(*) FROM cj WHERE found IS NULL
UNION ALL SELECT 'scores', 'rows', count(*) FROM documents
UNION ALL SELECT 'scores', 'failed', count(*) FROM documents WHERE contains(text, 'secret')"""


def resumed_manifest(spark: SparkSession, d: str) -> DataFrame:
    """SNK6: a run's arguments saved beside its output; a later run takes the
    manifest's rules from them (AGG4, WIN1)."""
    path = scratch_dir(spark, "run-arguments")
    IO.write_run_arguments(spark, {"min_duration": 300.0, "n_per_speaker": 10, "seed": 42, "resume": None}, path)
    a = IO.read_run_arguments(spark, path)
    u = bd.utterances(spark, d)
    m = SPK.build_manifest(
        u, "speakerid", "utterance_id", "duration", min_duration=float(a["min_duration"]), n_per_speaker=int(a["n_per_speaker"]), seed=a["seed"]
    )
    return m.select(F.col("speakerid").alias("speaker"), "utterance_id", "duration")


QUERIES = {
    "manifest_tsv": (manifest_tsv, MANIFEST_TSV_SQL),
    "annotation_votes_json": (annotation_votes_json, ANNOTATION_JSON_SQL),
    "annotation_map_json": (annotation_map_json, ANNOTATION_JSON_SQL),
    "aligned_embeddings": (aligned_embeddings, ALIGNED_SQL),
    "loaded_sources": (loaded_sources, LOADED_SQL),
    "segment_lines_file": (segment_lines_file, SEGMENT_LINES_SQL),
    "segments_from_files": (segments_from_files, SEGMENTS_FILES_SQL),
    "listed_files": (listed_files, LISTED_SQL),
    "saved_edges_labels": (saved_edges_labels, SAVED_EDGES_SQL),
    "split_table_reuse": (split_table_reuse, SPLIT_REUSE_SQL),
    "chunked_codes": (chunked_codes, CHUNKED_SQL),
    "training_table": (training_table, TRAINING_SQL),
    "clustered_speakers": (clustered_speakers, CLUSTERED_SQL),
    "clustered_transcripts": (clustered_transcripts, CLUSTERED_TRANSCRIPTS_SQL),
    "observed_reports": (observed_reports, OBSERVED_SQL),
    "resumed_manifest": (resumed_manifest, PP.MANIFEST_SAMPLE_SQL),
}
