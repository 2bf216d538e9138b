"""DuckDB mirrors of the test bindings, for the contract oracle SQL.

Only the base tables are registered in the oracle, so every query inlines the
binding views it needs as CTEs.  Helpers here generate SQL text from the same
fixed values the Spark side uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from .bindings import (
    CODEBOOKS,
    FRAMES,
    LABEL_TAGS,
    SOURCE_EVERY,
    UTTS_PER_SPEAKER,
)

UTTERANCES = """utterances AS (
  SELECT event_id AS utterance_id, user_id AS speakerid, event_type AS source,
         value / 10 AS duration, value AS snr, value + 95 AS utterance_pitch_mean,
         value / 4 AS utterance_pitch_std, value / 2 + 10 AS c50, value / 5 AS speaking_rate_value,
         CASE WHEN user_id % 7 = 3 THEN NULL WHEN user_id % 7 = 5 THEN 'other' WHEN user_id % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
         CASE WHEN event_id % 10 = 0 THEN 'dev' WHEN event_id % 10 = 1 THEN 'holdout'
              WHEN event_id % 10 BETWEEN 2 AND 4 THEN 'train_base' ELSE 'train_scaled' END AS split,
         ts
  FROM events)"""

SPEAKER_EMBEDDINGS = f"""speaker_embeddings AS (
  SELECT vec_id AS utterance_id, vec_id // {UTTS_PER_SPEAKER} AS speaker, embedding, label FROM embeddings)"""


def sql_list(values: Sequence[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ANNOTATIONS = f"""annotations AS (
  SELECT speaker AS name, {sql_list(LABEL_TAGS)}[label + 1] AS tag
  FROM speaker_embeddings WHERE speaker % {SOURCE_EVERY} = 0)"""

CODES = (
    "codes AS (SELECT vec_id AS id, label, ["
    + ", ".join(
        f"list_slice(list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 512) AS INTEGER)), {k * FRAMES + 1}, {(k + 1) * FRAMES})"
        for k in range(CODEBOOKS)
    )
    + "] AS labels FROM embeddings)"
)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def case_label(value: str, edges: Sequence[float] | Sequence[str], labels: Sequence[str]) -> str:
    """Right-closed, clamped bin label as a CASE chain (edges may be SQL text)."""
    parts = [f"CASE WHEN {value} IS NULL THEN NULL"]
    for k in range(len(labels) - 1):
        e = edges[k + 1]
        e = repr(float(e)) if not isinstance(e, str) else e
        parts.append(f"WHEN {value} <= {e} THEN '{labels[k]}'")
    parts.append(f"ELSE '{labels[-1]}' END")
    return " ".join(parts)


def learned_edge(k: int, n: int, lo: str = "lo", hi: str = "hi") -> str:
    if k == n:
        return hi
    return f"({k} * (({hi} - {lo}) / {float(n)}) + {lo})"


def bounds_sql(values_cte: str, tol: float | None, group: str | None = None, name: str = "bounds", stats: str = "st") -> str:
    """SQL for min/max of kept values with the histogram range rules; defines
    the CTEs ``stats`` (mean, std) and ``name`` (lo, hi)."""
    g = f"{group}, " if group else ""
    if tol is None:
        kept = f"SELECT {g}v FROM {values_cte}"
    else:
        join = f"JOIN {stats} USING ({group})" if group else f", {stats}"
        kept = f"SELECT {g}v FROM {values_cte} {join} WHERE abs(v - m) < {float(tol)} * s"
    stats_cte = f"{stats} AS (SELECT {g}avg(v) AS m, stddev_pop(v) AS s FROM {values_cte} {'GROUP BY ' + group if group else ''})"
    grp = f"GROUP BY {group}" if group else ""
    raw = f"SELECT {g}min(v) AS lo0, max(v) AS hi0, count(*) AS n FROM ({kept}) {grp}"
    if group:
        raw = f"SELECT g.{group}, r.lo0, r.hi0, coalesce(r.n, 0) AS n FROM (SELECT DISTINCT {group} FROM {values_cte}) g LEFT JOIN ({raw}) r USING ({group})"
    b = f"SELECT {g}CASE WHEN n = 0 THEN 0.0 ELSE lo0 END AS lo1, CASE WHEN n = 0 THEN 1.0 ELSE hi0 END AS hi1 FROM ({raw})"
    final = (
        f"{name} AS (SELECT {g}CASE WHEN lo1 = hi1 THEN lo1 - 0.5 ELSE lo1 END AS lo, "
        f"CASE WHEN lo1 = hi1 THEN hi1 + 0.5 ELSE hi1 END AS hi FROM ({b}))"
    )
    return stats_cte + ",\n" + final


__all__ = [
    "UTTERANCES",
    "SPEAKER_EMBEDDINGS",
    "ANNOTATIONS",
    "CODES",
    "with_",
    "case_label",
    "learned_edge",
    "bounds_sql",
    "sql_list",
]
