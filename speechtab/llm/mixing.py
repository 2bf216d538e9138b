"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domains, languages and sources by the
siblings' weights.  A child that cannot use its share (its subtree holds fewer
tokens, epochs counted) takes what it has, and its siblings share the shortage
by their weights; only what all siblings together cannot use was never given to
their parent, so shortages reach ancestors last.  Each leaf then takes whole
epochs and, of one more, the prefix of a seeded order that its budget allows.

Everything runs as DataFrame aggregates and windows over one row per leaf or
per (leaf, hash bucket).  Choosing rows is a comparison with the leaf's last
key: texts are neither sorted nor shuffled, and a leaf with a third of all rows
is aggregated in the map and ranked within one bucket of 4,096.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechtab.llm.common import SPACE_CLASS, flat, pick, written

LEVELS = ("domain", "language", "source")
#: Leading hex digits of a row's key that make its bucket.
DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Whole-number weights by node, ``default`` where none is given: a domain
    by its name, a language by (domain, language), a source by (domain,
    language, source).  ``domains`` maps a source to its domain, ``rest`` those
    not named.  The budget is ``total`` tokens, or ``share`` of all there are."""

    weights: dict = field(default_factory=dict)
    domains: dict = field(default_factory=dict)
    rest: str = "other"
    default: int = 1
    total: int | None = None
    share: float = 0.8
    epochs: int = 1
    seed: int = 17


def n_words(text: Column) -> Column:
    """Words of a text, the default measure of its tokens."""
    body = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, SPACE_CLASS))).cast("long")


def _cases(value: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == F.lit(k), F.lit(v)).otherwise(out)
    return out


def leaf_columns(mix: Mix, lang_col: str = "lang", source_col: str = "source") -> dict[str, Column]:
    """The three levels of a row; a NULL language or source is a node of its
    own, named by the empty string."""
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    return {"domain": _cases(source, mix.domains, mix.rest), "language": F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")), "source": source}


def _weight(mix: Mix, depth: int) -> Column:
    path = F.concat_ws("\x1f", *[F.col(c) for c in LEVELS[: depth + 1]])
    table = {}
    for k, w in mix.weights.items():
        parts = k if isinstance(k, tuple) else (k,)
        if len(parts) == depth + 1:
            table["\x1f".join(parts)] = int(w)
    return _cases(path, table, mix.default).cast("long")


def _pour(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Share each parent's ``budget`` among its children (rows with ``cap`` and
    ``w``): ``budget`` becomes the child's.

    Children in order of cap / w fill up one after the other as the common
    level rises; the level they reach is the greatest of (budget - caps before)
    / (weights from here on)."""
    siblings = Window.partitionBy(*(parent or [F.lit(0)]))
    ranked = siblings.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))), *LEVELS[: len(parent) + 1])
    before = F.coalesce(F.sum("cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("w").over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.when(weights > 0, (F.col("budget") - before) / weights).otherwise(F.lit(0.0))
    out = nodes.withColumn("level", level).withColumn("level", F.max("level").over(siblings))
    return out.withColumn("budget", F.least(F.col("cap"), F.greatest(F.lit(0), F.floor(F.col("w") * F.col("level")))).cast("long")).drop("level")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``domain, language, source, supply, budget`` from the leaves' supply."""
    caps = leaves.withColumn("cap", (F.col("supply") * mix.epochs).cast("long"))
    total = F.lit(mix.total) if mix.total is not None else F.floor(F.sum("supply").over(Window.partitionBy(F.lit(0))) * F.lit(float(mix.share)))
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    domains = _pour(domains.withColumn("budget", total.cast("long")).withColumn("w", _weight(mix, 0)), [])
    languages = caps.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).join(domains.select("domain", "budget"), "domain")
    languages = _pour(languages.withColumn("w", _weight(mix, 1)), ["domain"])
    sources = caps.join(languages.select("domain", "language", "budget"), ["domain", "language"])
    return _pour(sources.withColumn("w", _weight(mix, 2)), ["domain", "language"]).select(*LEVELS, "supply", "budget")


def _key(mix: Mix, epoch: Column, row_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(row_id.cast("string"), F.lit(""))))


def plan(docs: DataFrame, mix: Mix, tokens: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per leaf: ``supply``, ``budget``, whole epochs ``full``, the
    ``left`` of the budget and the last key ``cutoff`` of the next epoch's
    prefix (NULL: none of it).  ``tokens`` names a column with the rows' token
    counts; without, the words of the text are counted."""
    names = {"id": id_col, "lang": lang_col, "from": source_col, "n": tokens or text_col}
    rows = pick(docs, **names)
    n = F.coalesce("n", F.lit(0)).cast("long") if tokens else n_words(F.coalesce("n", F.lit("")))
    slim = rows.select("id", n.alias("n"), *[c.alias(k) for k, c in leaf_columns(mix, "lang", "from").items()])
    slim = written(slim, "tokens")
    leaves = budgets(slim.groupBy(*LEVELS).agg(F.sum("n").alias("supply")), mix)
    full = F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(F.lit(0)).cast("long")
    leaves = leaves.withColumn("full", full).withColumn("left", F.col("budget") - F.col("full") * F.col("supply"))
    leaves = written(leaves, "leaves")
    asked = leaves.where("left > 0").select(*LEVELS, "full", "left")
    rows = slim.join(asked, list(LEVELS)).withColumn("key", _key(mix, F.col("full"), F.col("id"))).withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = rows.groupBy(*LEVELS, "left", "bucket").agg(F.sum("n").alias("n"), F.max("key").alias("top"))
    upto = Window.partitionBy(*LEVELS).orderBy("bucket")
    sums = sums.withColumn("through", F.sum("n").over(upto))
    state = sums.groupBy(*LEVELS).agg(
        F.max(F.when(F.col("through") <= F.col("left"), F.col("top"))).alias("below"),
        F.min(F.when(F.col("through") > F.col("left"), F.struct("bucket", (F.col("through") - F.col("n")).alias("before")))).alias("edge"),
    )
    state = written(state, "edges")
    edge = rows.join(state.where("edge IS NOT NULL").select(*LEVELS, F.col("edge.bucket").alias("bucket"), F.col("edge.before").alias("before")), [*LEVELS, "bucket"])
    # equal keys are peers: all or none of them
    edge = edge.withColumn("through", F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key")))
    inside = edge.where("through <= left").groupBy(*LEVELS).agg(F.max("key").alias("inside"))
    cut = state.join(inside, list(LEVELS), "left").select(*LEVELS, F.coalesce("inside", "below").alias("cutoff"))
    return written(leaves.join(cut, list(LEVELS), "left"), "mix")


def select(docs: DataFrame, mix: Mix, tokens: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", epoch_col: str | None = "epoch") -> DataFrame:
    """The rows of ``docs`` that the mix selects, once for every epoch they are
    in (``epoch_col``, an additional column; None: not added).

    NULL and empty texts have no tokens: they cost nothing and are selected if
    their key is inside the prefix or their leaf has a whole epoch.  Rows with
    equal ids (NULL ids too) of a leaf have equal keys and are selected
    together.  Other columns stay as they were; an empty table gives an empty
    table."""
    leaves = plan(docs, mix, tokens, id_col, text_col, lang_col, source_col)
    plain, (ident, lang, source) = flat(docs, id_col, lang_col, source_col)
    both = plain.join(leaves, [c == F.col(k) for k, c in leaf_columns(mix, lang, source).items()])
    full, cutoff = F.col("full"), F.col("cutoff")
    extra = F.when(cutoff.isNotNull() & (_key(mix, full, F.col(ident)) <= cutoff), F.array(full)).otherwise(F.array().cast("array<bigint>"))
    whole = F.when(full > 0, F.sequence(F.lit(0).cast("long"), full - 1)).otherwise(F.array().cast("array<bigint>"))
    out = both.select(*plain.columns, F.explode(F.concat(whole, extra)).alias("epoch"))
    return out.toDF(*docs.columns, epoch_col) if epoch_col else out.drop("epoch").toDF(*docs.columns)


def oracle_sql(mix: Mix) -> str:
    """DuckDB SQL for ``doc_id, epoch, domain, language, source, n_tokens``."""

    def case(expr: str, table: dict, default) -> str:
        whens = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items())
        return f"CASE {expr} {whens} ELSE {default!r} END" if whens else repr(default)

    def weight(depth: int) -> str:
        table = {}
        for k, w in mix.weights.items():
            parts = k if isinstance(k, tuple) else (k,)
            if len(parts) == depth + 1:
                table["|".join(parts)] = int(w)
        return case(" || '|' || ".join(LEVELS[: depth + 1]), table, mix.default)

    def pour(name: str, source: str, parent: str, order: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_l AS (SELECT *, CASE WHEN ws > 0 THEN (budget - before) / ws::DOUBLE ELSE 0.0 END AS lv FROM (
  SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(wt) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM ({source}) WINDOW w AS ({part} ORDER BY CASE WHEN wt > 0 THEN cap::DOUBLE / wt ELSE 'infinity'::DOUBLE END, {order}))),
{name} AS (SELECT * EXCLUDE (budget), least(cap, greatest(0, floor(wt * max(lv) OVER ({part}))))::BIGINT AS budget FROM {name}_l)"""

    total = str(mix.total) if mix.total is not None else f"(SELECT floor(sum(supply) * {float(mix.share)!r}::DOUBLE) FROM leaf)::BIGINT"
    return f"""
WITH d AS (SELECT *, {case('source', mix.domains, mix.rest)} AS domain FROM (
  SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents)),
leaf AS (SELECT domain, language, source, sum(n)::BIGINT AS supply, (sum(n) * {mix.epochs})::BIGINT AS cap FROM d GROUP BY ALL),
{pour('l1', f"SELECT domain, sum(cap)::BIGINT AS cap, {total} AS budget, {weight(0)} AS wt FROM leaf GROUP BY domain", "", "domain")},
{pour('l2', f"SELECT x.*, l1.budget, {weight(1).replace('domain', 'x.domain')} AS wt FROM (SELECT domain, language, sum(cap)::BIGINT AS cap FROM leaf GROUP BY ALL) x JOIN l1 ON l1.domain = x.domain", "domain", "domain, language")},
{pour('l3', f"SELECT leaf.*, l2.budget, {weight(2).replace('domain', 'leaf.domain').replace('language', 'leaf.language').replace('source', 'leaf.source')} AS wt FROM leaf JOIN l2 ON l2.domain = leaf.domain AND l2.language = leaf.language", "domain, language", "domain, language, source")},
f AS (SELECT domain, language, source, supply, budget, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS full_epochs FROM l3),
k AS (SELECT d.*, f.full_epochs, f.budget - f.full_epochs * f.supply AS remaining,
             md5('{mix.seed}:' || f.full_epochs::VARCHAR || ':' || coalesce(d.doc_id::VARCHAR, '')) AS key
      FROM d JOIN f ON f.domain = d.domain AND f.language = d.language AND f.source = d.source),
c AS (SELECT *, sum(n) OVER (PARTITION BY domain, language, source ORDER BY key) AS through FROM k)
SELECT doc_id, epoch::BIGINT AS epoch, domain, language, source, n AS n_tokens FROM (
  SELECT *, unnest(generate_series(0, full_epochs - 1)) AS epoch FROM c
  UNION ALL SELECT *, full_epochs FROM c WHERE remaining > 0 AND through <= remaining)"""
