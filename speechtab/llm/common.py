"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab.session import ensure_checkpoint_dir

#: Word separators: space and U+0009..U+000D, and nothing else.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the session's ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the
    lineage, and survives the loss of any executor."""
    path = f"{shared_folder(df.sparkSession)}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise ``ValueError`` unless every name occurs once among the columns
    (case-sensitively)."""
    for c in columns:
        n = df.columns.count(c)
        if n != 1:
            raise ValueError(f"column {c!r} occurs {n} times in {df.columns}")


def flat(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ... by position, and the new names
    of the given ones: whatever else a table has, upper and lower case of one
    name among it, cannot clash with an operator's columns.  Undo with
    ``toDF(*df.columns)``."""
    require(df, names)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(n)}" for n in names]


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The named columns alone, under the keywords' names."""
    plain, found = flat(df, *names.values())
    return plain.select(*[F.col(c).alias(k) for k, c in zip(names, found)])


def ids_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just ``id`` and ``text`` (NULL text: empty string) of ``docs``; other
    columns, whatever their names, never reach an operator."""
    return pick(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
