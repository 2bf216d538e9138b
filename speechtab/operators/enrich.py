"""Batched enrichment with a pluggable scorer (UDF1) and failure capture
(UDF3).

A scorer is built by a user ``factory()`` once per worker process (a model
loads once per worker, not per task or row) and called on Arrow batches of only the
columns it needs, plus the columns the caller wants to carry through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..schema import require_columns

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


# Scorers that a worker process has built, by the call of enrich they belong to.
_LOADED: dict = {}


def enrich(
    df: DataFrame,
    factory: Callable[[], Scorer],
    input_cols: Sequence[str],
    output_schema: T.StructType,
    keep_cols: Sequence[str] = (),
    batch_rows: int = 1024,
    on_error: str = "raise",
    with_context: bool = False,
) -> DataFrame:
    """UDF1 (+ UDF3): ``keep_cols`` + scorer outputs for every row.

    ``factory`` is called once per worker process, which keeps the scorer for
    its later tasks.  With ``with_context=True`` it is called once per task
    with the task's ``TaskContext`` (partition id, assigned resources such as
    GPUs).

    ``factory()`` returns a callable mapping a pandas batch of
    ``input_cols`` to a pandas DataFrame with the ``output_schema`` columns
    (same row count).  ``on_error="capture"`` adds a string ``error`` column:
    a failing batch is retried row by row and rows that still fail get NULL
    outputs and the error text, instead of failing the job.
    """
    if on_error not in ("raise", "capture"):
        raise ValueError("on_error is 'raise' or 'capture'")
    inputs = list(dict.fromkeys(input_cols))
    keep = list(dict.fromkeys(keep_cols))
    selected = list(dict.fromkeys([*inputs, *keep]))
    require_columns(df, selected)
    out_fields = list(output_schema.fields)
    names = [f.name for f in out_fields]
    fields = [df.schema[c] for c in keep] + out_fields
    if on_error == "capture":
        fields.append(T.StructField("error", T.StringType()))
    schema = T.StructType(fields)
    carry = [c for c in keep]

    token = uuid.uuid4().hex

    def run(batches):
        if with_context:
            # the task's context: partition id and the resources (e.g. GPU
            # addresses) Spark assigned to this task, for device placement
            from pyspark import TaskContext

            scorer = factory(TaskContext.get())
        else:
            # the module's own table: this function travels as a copy
            from speechtab.operators import enrich as here

            if token not in here._LOADED:
                here._LOADED.clear()  # one model at a time
                here._LOADED[token] = factory()
            scorer = here._LOADED[token]
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                part = pdf.iloc[start : start + batch_rows]
                x = part[inputs].reset_index(drop=True)
                if on_error == "raise":
                    y = scorer(x)
                    err = None
                else:
                    try:
                        y = scorer(x)
                        err = [None] * len(x)
                    except Exception:  # noqa: BLE001 - isolate the bad rows
                        rows, err = [], []
                        for i in range(len(x)):
                            try:
                                rows.append(scorer(x.iloc[i : i + 1].reset_index(drop=True)).iloc[0])
                                err.append(None)
                            except Exception as ex:  # noqa: BLE001
                                rows.append(pd.Series({n: None for n in names}))
                                err.append(f"{type(ex).__name__}: {ex}")
                        y = pd.DataFrame(rows).reset_index(drop=True)
                res = part[carry].reset_index(drop=True)
                for n in names:
                    res[n] = y[n].to_numpy() if n in y else None
                if err is not None:
                    res["error"] = err
                yield res

    return df.select(*selected).mapInPandas(run, schema=schema)
