"""Registry of contract queries: name -> (spark_fn(spark, sf_dir), oracle_sql or None)."""

from __future__ import annotations

import importlib

_MODULES = [
    "basic_tags",
    "propagation",
    "preparation",
    "evaluation",
    "signals",
    "streams",
    "io_roundtrips",
]


def registry() -> dict:
    out: dict = {}
    for m in _MODULES:
        mod = importlib.import_module(f"{__package__}.{m}")
        for name, spec in mod.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate contract query {name}")
            out[name] = spec
    return out
