"""Schemas of the tables the library works on, and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """Fail early (driver side, no job) when a needed column is absent."""
    have = set(df.columns)
    missing = [c for c in columns if c not in have]
    if missing:
        raise MissingColumnsError(f"{what} lacks column(s) {missing}; has {sorted(have)}")
    return df


def keep_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """PRJ1: keep only the named columns, failing if one is missing."""
    cols = list(columns)
    require_columns(df, cols)
    return df.select(*cols)


UTTERANCES = T.StructType(
    [
        T.StructField("utterance_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("relative_audio_path", T.StringType()),
        T.StructField("audio_path", T.StringType()),
        T.StructField("text_description", T.ArrayType(T.StringType())),
        T.StructField("transcription", T.StringType()),
        T.StructField("intrinsic_tags", T.ArrayType(T.StringType())),
        T.StructField("situational_tags", T.ArrayType(T.StringType())),
        T.StructField("basic_tags", T.ArrayType(T.StringType())),
        T.StructField("speakerid", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("gender", T.StringType()),
        T.StructField("accent", T.StringType()),
        T.StructField("utterance_pitch_mean", T.DoubleType()),
        T.StructField("utterance_pitch_std", T.DoubleType()),
        T.StructField("snr", T.DoubleType()),
        T.StructField("c50", T.DoubleType()),
        T.StructField("speaking_rate_value", T.DoubleType()),
        T.StructField("phonemes", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("audio_path", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("duration", T.DoubleType()),
    ]
)

EMBEDDINGS = T.StructType(
    [
        T.StructField("utterance_id", T.LongType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

ANNOTATIONS = T.StructType([T.StructField("name", T.StringType()), T.StructField("tag", T.StringType())])

PAIRS = T.StructType(
    [
        T.StructField("wav1", T.StringType()),
        T.StructField("wav2", T.StringType()),
        T.StructField("gt", T.StringType()),
        T.StructField("unused", T.StringType()),
        T.StructField("label", T.DoubleType()),
    ]
)

CODES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("labels", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("target_length", T.IntegerType()),
    ]
)

ATTEMPTS = T.StructType(
    [
        T.StructField("item", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("wer", T.DoubleType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("reference", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("si_sdr", T.DoubleType()),
    ]
)

CLIPS = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("samples", T.ArrayType(T.FloatType())),
        T.StructField("sampling_rate", T.IntegerType()),
    ]
)
