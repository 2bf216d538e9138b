"""STM2 on ``transformWithStateInPandas``: held-back items in list state, to
which a micro-batch appends, and timers that close keys gone silent."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from . import _check_steps

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def list_state_store(spark: SparkSession):
    """List state and timers need the RocksDB store.  A session that names a
    store keeps it; otherwise RocksDB is set for the streams started within."""
    if spark.conf.get(_PROVIDER, None) is not None and "RocksDB" in spark.conf.get(_PROVIDER):
        yield
        return
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER)


class ChunkProcessor(StatefulProcessor):
    """State of a key: ``counts`` (items seen, items emitted) and ``held`` (the
    items between the two, fewer than play_steps + stride after a batch)."""

    def __init__(self, key: str, item_col: str, item_type: T.DataType, order_cols: list[str], end_col: str,
                 play_steps: int, stride: int, timeout_ms: int | None):
        self.key, self.item_col, self.item_type = key, item_col, item_type
        self.order_cols, self.end_col = order_cols, end_col
        self.play_steps, self.stride, self.timeout_ms = play_steps, stride, timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "seen long, emitted long")
        self.held = handle.getListState("held", T.StructType([T.StructField("item", self.item_type)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # rows of a key may come in several frames, in any order
        new = pd.concat(list(rows)).sort_values(self.order_cols, kind="mergesort")
        closing = new[self.end_col].fillna(False).astype(bool)
        items = [(x,) for x in new.loc[~closing, self.item_col].tolist()]
        seen, emitted = self.counts.get() if self.counts.exists() else (0, 0)
        seen += len(items)
        if closing.any():
            return self._flush(key, items, seen, emitted)
        out = []
        bound = seen // self.play_steps * self.play_steps - self.stride
        if bound > emitted:
            every = [*self.held.get(), *items] if self.held.exists() else items
            out = every[:bound - emitted]
            self.held.clear()
            items = every[bound - emitted:]
        if items:
            self.held.appendList(items)
        self.counts.update((seen, emitted + len(out)))
        if self.timeout_ms is not None:
            self._drop_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        return self._frames(key, out, emitted, seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.counts.exists():
            return iter(())
        return self._flush(key, [], *self.counts.get())

    def _flush(self, key, items: list, seen: int, emitted: int) -> Iterator[pd.DataFrame]:
        every = [*self.held.get(), *items] if self.held.exists() else items
        self.held.clear()
        self.counts.clear()
        if self.timeout_ms is not None:
            self._drop_timers()
        return self._frames(key, every, emitted, seen)

    def _drop_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def _frames(self, key, out: list, start: int, seen: int) -> Iterator[pd.DataFrame]:
        if not out:
            return iter(())
        last = seen // self.play_steps + 1
        at = range(start, start + len(out))
        frame = {
            self.key: [key[0]] * len(out),
            self.item_col: [x[0] for x in out],
            "position": list(at),
            "chunk": [min((p + self.stride) // self.play_steps + 1, last) for p in at],
        }
        return iter([pd.DataFrame(frame)])


def stream_chunks_listed(stream: DataFrame, key: str, item_col: str, order_cols: list[str], end_col: str = "is_end",
                         play_steps: int = 10, stride: int = 3, timeout_ms: int | None = None) -> DataFrame:
    """The rows of :func:`speechtab.streaming.stream_chunks`.  A micro-batch
    appends its items to those held back, and reads them only when a multiple of
    ``play_steps`` has been passed, a row with ``end_col`` true closes the key, or
    (``timeout_ms``) its timer fires.  Start the query within
    :func:`list_state_store`; with ``timeout_ms`` give it a periodic trigger, as
    a run over the available data does not end while timers may fire."""
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
    cols = list(dict.fromkeys([key, item_col, *order_cols, end_col]))
    return stream.select(*cols).groupBy(key).transformWithStateInPandas(
        ChunkProcessor(key, item_col, item, order_cols, end_col, play_steps, stride, timeout_ms),
        outputStructType=out,
        outputMode="append",
        timeMode="None" if timeout_ms is None else "ProcessingTime",
    )
