"""Structured Streaming forms of the stateless enrichment (STM1), growing
speaker statistics (STM4) and chunked emission with hold-back (STM2), plus
a runner that drives a stream to completion into a table (STM3: the
checkpoint makes a restarted run skip what is done)."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, folder: str, name_glob: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """STM1 source: parquet files landing in ``folder`` (names matching
    ``name_glob``), with a fixed schema."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def interleave_streams(streams: list[DataFrame], names: list[str] | None = None, name_col: str = "source") -> DataFrame:
    """STM1: several sources read as one stream (union by column name), each
    row tagged with its source; rows interleave as their files arrive."""
    parts = list(streams)
    if names is not None:
        if len(names) != len(parts):
            raise ValueError("one name per stream")
        parts = [s.withColumn(name_col, F.lit(n)) for s, n in zip(parts, names)]
    out = parts[0]
    for s in parts[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def run_append(stream: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Drive an append-mode stream to completion (available data) into parquet."""
    q = (
        stream.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def run_update(stream: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Drive an aggregate to completion in update mode: a micro-batch writes
    the rows it changed, and nothing else, to a partition of its own, which a
    retried batch replaces.  :func:`latest` reads the current result."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={epoch_id}")

    q = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def latest(spark: SparkSession, out_dir: str, key: str | list[str]) -> DataFrame:
    """The current rows of a table written by :func:`run_update`: per key (one
    column or several) the last batch that changed it."""
    t = spark.read.option("basePath", out_dir).parquet(out_dir)
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in t.columns if c not in (*keys, "batch_id")]
    last = t.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_r"))
    return last.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def running_totals(stream: DataFrame, key: str, duration_col: str) -> DataFrame:
    """STM4: per speaker total duration (exact decimal) and clip count as data
    arrives.  Totals are over all time, so no row is ever too late, and state
    holds one row for every key."""
    return stream.groupBy(key).agg(
        F.sum(F.col(duration_col).cast("decimal(38,9)")).alias("total_duration"),
        F.count(F.lit(1)).alias("n"),
    )


# --- STM2: chunked emission with hold-back -----------------------------------

def chunk_of(position, total, play_steps: int, stride: int):
    """Batch twin: chunk (1-based) in which item ``position`` (0-based) of a
    stream of ``total`` items is emitted.  After every ``play_steps`` items
    everything new except the last ``stride`` is emitted; the end flushes
    the rest as chunk J+1, J = total div play_steps."""
    full = F.floor((position + stride) / F.lit(play_steps)) + 1
    return F.least(full, F.floor(total / F.lit(play_steps)) + 1).cast("bigint")


def _check_steps(play_steps: int, stride: int) -> None:
    if not (0 < stride < play_steps):
        raise ValueError("need 0 < stride < play_steps")


def chunk_emission(df: DataFrame, key: str, order_cols: list[str], item_col: str, play_steps: int = 10, stride: int = 3,
                   segments: int | None = None) -> DataFrame:
    """STM2 batch twin: (key, item, position, chunk).  Positions come from
    :func:`positions_within_key`, so a key holding most rows is still
    numbered by many tasks."""
    from ..operators.ordering import positions_within_key

    _check_steps(play_steps, stride)
    base = df.select(key, *dict.fromkeys([item_col, *order_cols]))
    pos = positions_within_key(base, key, order_cols, "position", "_total", segments)
    return pos.select(key, item_col, "position", chunk_of(F.col("position"), F.col("_total"), play_steps, stride).alias("chunk"))


def _chunk_fn(key: str, item_col: str, order_cols: list[str], end_col: str, play_steps: int, stride: int, timeout_ms: int | None):
    def fn(keys, pdfs, state):
        if state.exists:
            n, pend_items, pend_pos = state.get
            pend_items, pend_pos = list(pend_items), list(pend_pos)
        else:
            n, pend_items, pend_pos = 0, [], []
        ended = bool(state.hasTimedOut)
        # rows of a key may come in several frames, in any order
        new = pd.concat(list(pdfs)) if not ended else None
        if new is not None and len(new):
            new = new.sort_values(order_cols, kind="mergesort")
            closing = new[end_col].fillna(False).astype(bool)
            ended = bool(closing.any())
            items = new.loc[~closing, item_col].tolist()
            pend_items.extend(items)
            pend_pos.extend(range(n, n + len(items)))
            n += len(items)
        bound = (n // play_steps) * play_steps - stride
        out = [(i, p) for i, p in zip(pend_items, pend_pos) if ended or p < bound]
        if ended:
            state.remove()
        else:
            state.update((n, pend_items[len(out):], pend_pos[len(out):]))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        if out:
            last = n // play_steps + 1
            yield pd.DataFrame(
                {
                    key: [keys[0]] * len(out),
                    item_col: [i for i, _ in out],
                    "position": [p for _, p in out],
                    "chunk": [min((p + stride) // play_steps + 1, last) for _, p in out],
                }
            )

    return fn


def stream_chunks(stream: DataFrame, key: str, item_col: str, order_cols: list[str], end_col: str = "is_end",
                  play_steps: int = 10, stride: int = 3, timeout_ms: int | None = None) -> DataFrame:
    """STM2 on a stream: per key, items (of any type) whose chunk is final are
    emitted as soon as a multiple of ``play_steps`` items has arrived; the rest
    (fewer than play_steps + stride items) wait in state until a row with
    ``end_col`` true closes the key and flushes them, or, with ``timeout_ms``,
    until no row of the key has come for so long (processing time).  Items are
    ordered within a micro-batch; micro-batches follow each other."""
    _check_steps(play_steps, stride)
    item = stream.schema[item_col].dataType
    out = T.StructType(
        [
            T.StructField(key, stream.schema[key].dataType),
            T.StructField(item_col, item),
            T.StructField("position", T.LongType()),
            T.StructField("chunk", T.LongType()),
        ]
    )
    kept = T.StructType(
        [
            T.StructField("n", T.LongType()),
            T.StructField("pend_items", T.ArrayType(item)),
            T.StructField("pend_pos", T.ArrayType(T.LongType())),
        ]
    )
    cols = list(dict.fromkeys([key, item_col, *order_cols, end_col]))
    return stream.select(*cols).groupBy(key).applyInPandasWithState(
        _chunk_fn(key, item_col, order_cols, end_col, play_steps, stride, timeout_ms),
        outputStructType=out,
        stateStructType=kept,
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
