"""Secret scans through a trigram inverted index.

From each rule's regex a Boolean trigram query is derived: an OR of clauses,
each an AND of trigrams that every match must contain.  The index holds, for
every trigram that some rule asks for, the rows whose lower-cased text contains
it.  Intersecting postings gives each rule's candidate rows, and only those are
searched with its regex.  A rule without a mandatory trigram scans all rows.

All of it is DataFrame work: postings come from one map over the texts, the
intersection is a count of distinct trigrams per row and clause, and texts are
never shuffled while candidates are few.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import flat, ids_and_text, written

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    import re._constants as _c
    import re._parser as _p

#: Clauses a query may have before it is widened to "no mandatory trigram".
MAX_CLAUSES = 64


@dataclass(frozen=True)
class Rule:
    """``regex`` (Java and Python syntax alike) finds spans of ``kind``; the
    ``group`` must have ``at_least`` characters, else the match is dropped.
    Matches are leftmost and do not overlap within a rule."""

    kind: str
    regex: str
    group: int = 0
    at_least: int = 1


#: The three base kinds, in their order, then those the method adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of 24 and more: the same spans as dropping shorter ones
)
RULES = BASE + (
    # to its END line, if that is the next line of five dashes; a body has up to 100 shorter dashes
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+){0,100}-----END [A-Z ]*PRIVATE KEY-----)?"),
    # bounded where a match may begin anywhere in a long word, or the time is quadratic in its length
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{1,512}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("live_key", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("url_password", r"[a-z][a-z0-9+.-]{0,30}://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
)


def _grams(s: str) -> frozenset[str]:
    s = s.lower()
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _and(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    """Both queries; too many clauses are widened to the shorter side."""
    both = {x | y for x in a for y in b}
    if len(both) > MAX_CLAUSES:
        return min(a, b, key=len)
    # a clause that asks for more than another is implied by it
    return [x for x in both if not any(y < x for y in both)]


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Clauses of which one holds for every text with a match: each a set of
    lower-case trigrams.  ``[frozenset()]`` asks for nothing."""

    def walk(seq) -> tuple[list[frozenset], set[str] | None]:
        """(query, the few strings the sequence stands for, or None)"""
        query: list[frozenset] = [frozenset()]
        run: set[str] = {""}  # literal strings that end here

        def close() -> None:
            nonlocal query, run
            query = _and(query, [_grams(r) for r in run])
            run = {""}

        exact = True
        for op, arg in seq:
            if op is _c.LITERAL:
                run = {r + chr(arg) for r in run}
                continue
            if op is _c.IN and len(arg) <= 8 and all(k is _c.LITERAL for k, _ in arg) and len(run) * len(arg) <= 16:
                run = {r + chr(c) for r in run for _, c in arg}
                continue
            if op is _c.AT:
                continue
            if op is _c.SUBPATTERN or op is _c.BRANCH:
                branches = [walk(arg[-1])] if op is _c.SUBPATTERN else [walk(b) for b in arg[1]]
                strings = None if any(s is None for _, s in branches) else set().union(*(s for _, s in branches))
                if strings is not None and len(run) * len(strings) <= 32:
                    run = {r + s for r in run for s in strings}
                    continue
                exact = False
                close()
                query = _and(query, list({c for q, s in branches for c in (q if s is None else map(_grams, s))}))
                continue
            exact = False
            close()
            if op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT) and arg[0] > 0:
                inner, strings = walk(arg[2])
                query = _and(query, inner if strings is None else [_grams(s) for s in strings])
        if exact:
            return [frozenset()], run
        close()
        return query, None

    query, strings = walk(_p.parse(regex))
    if strings is not None:
        query = [_grams(s) for s in strings]
    return [x for x in set(query) if not any(y < x for y in query)]


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's matches, in code points:
    what lies between matches (split) and the matches give all offsets."""
    pattern = F.lit(rule.regex)
    whole = F.regexp_extract_all(text, pattern, 0)
    measured = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, rule.group)
    gaps = F.split(text, rule.regex, -1)
    steps = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), measured, lambda s, x: F.struct(s["g"].alias("g"), s["m"].alias("m"), F.length(x).alias("x")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"))

    def step(acc, s):
        start, end = acc["at"] + s["g"], acc["at"] + s["g"] + s["m"]
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(s["x"] >= rule.at_least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    # the last gap has no match beside it
    found = F.aggregate(F.filter(steps, lambda s: s["m"].isNotNull()), zero, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` and ``rk``, which with the id names a row by its content:
    rows alike in both have the same spans."""
    return ids_and_text(docs, id_col, text_col).withColumn("rk", F.xxhash64("text"))


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The postings ``gram, id, rk``: the rows whose text, in lower case, has
    each of the given trigrams."""
    low = docs.withColumn("low", F.lower("text"))
    has = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in sorted(trigrams)])
    return low.select("id", "rk", F.explode(F.filter(has, lambda g: g.isNotNull())).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``id, rk, kinds``: rows that meet some rule's trigram query."""
    terms = []
    for rule in rules:
        for k, clause in enumerate(trigram_query(rule.regex)):
            terms += [(g, rule.kind, k, len(clause)) for g in sorted(clause)]
    postings = index(docs, sorted({t[0] for t in terms}))
    # the terms are as many as the rules have: a literal, not a table
    asked = F.lit(None).cast("array<struct<kind:string,clause:int,need:int>>")
    for g in sorted({t[0] for t in terms}):
        uses = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("clause"), F.lit(need).alias("need")) for x, kind, k, need in terms if x == g])
        asked = F.when(F.col("gram") == g, uses).otherwise(asked)
    met = postings.select("id", "rk", "gram", F.explode(asked).alias("u"))
    met = met.groupBy("id", "rk", F.col("u.kind").alias("kind"), F.col("u.clause").alias("clause"), F.col("u.need").alias("need")).agg(F.count_distinct("gram").alias("n"))
    return met.where("n >= need").groupBy("id", "rk").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, rk, spans`` for every row of ``docs``: spans sorted by start, then
    by the rules' order.

    NULL and empty texts have none; rows that repeat are each returned; NULL
    ids are kept; other columns are dropped; an empty table gives an empty
    table."""
    indexed = tuple(r for r in rules if all(trigram_query(r.regex)))
    everywhere = tuple(r for r in rules if r not in indexed)
    df = _keyed(docs, id_col, text_col)
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    rows = df.select("id", "rk", F.concat(empty, *[_spans(F.col("text"), r) for r in everywhere]).alias("spans"))
    if indexed:
        some = written(candidates(df, indexed), "candidates")  # its size decides how the join is done
        pairs = some.select(F.col("id").alias("cid"), F.col("rk").alias("crk"), "kinds")
        hit = df.join(pairs, F.col("id").eqNullSafe(F.col("cid")) & (F.col("rk") == F.col("crk")))
        verified = hit.select("cid", "crk", F.concat(empty, *[F.when(F.array_contains("kinds", r.kind), _spans(F.col("text"), r)).otherwise(empty) for r in indexed]).alias("more"))
        verified = written(verified.where(F.size("more") > 0).dropDuplicates(["cid", "crk"]), "verified")
        rows = rows.join(verified, F.col("id").eqNullSafe(F.col("cid")) & (F.col("rk") == F.col("crk")), "left")
        rows = rows.select("id", "rk", F.concat("spans", F.coalesce("more", empty)).alias("spans"))
    rank = {r.kind: k for k, r in enumerate(rules)}

    def place(kind: Column) -> Column:
        out = F.lit(len(rank))
        for name, k in rank.items():
            out = F.when(kind == name, F.lit(k)).otherwise(out)
        return out

    ranked = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return rows.select("id", "rk", ranked.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts and digest of the base kinds, and all spans as
    ``kind:start:end`` joined by commas."""
    df = scan(docs, rules, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    counts = [F.size(F.filter("spans", _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return df.select(F.col("id").alias(id_col), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one
    mark); rows without a span, and all other columns, stay as they were.
    ``length_col``, if there is such a column, follows the new text."""
    plain, (ident, text) = flat(docs, id_col, text_col)
    found = scan(plain, rules, ident, text).where(F.size("spans") > 0).dropDuplicates(["id", "rk"])
    found = written(found.select(F.col("id").alias("cid"), F.col("rk").alias("crk"), "spans"), "spans")
    on = F.col(ident).eqNullSafe(F.col("cid")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("crk"))
    both = plain.join(found, on, "left").drop("cid", "crk")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substr(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate(F.col("spans"), zero, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1, F.length(text))))
    both = both.withColumn(text, F.when(F.col("spans").isNotNull(), clean).otherwise(F.col(text)))
    if length_col is not None and docs.columns.count(length_col) == 1:
        k = docs.columns.index(length_col)
        n = F.length(text).cast(docs.schema.fields[k].dataType)
        both = both.withColumn(f"c{k}", F.when(F.col("spans").isNotNull(), n).otherwise(F.col(f"c{k}")))
    return both.select(*plain.columns).toDF(*docs.columns)


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the contract query: every rule over every text."""

    def spans(k: int, rule: Rule) -> str:
        rx = rule.regex.replace("'", "''")
        return f"""SELECT r, {k} AS k, '{rule.kind}' AS kind, a, a + length(m[i]) AS b FROM (
  SELECT *, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM (
    SELECT *, unnest(generate_series(1, len(m))) AS i FROM (
      SELECT r, regexp_extract_all(t, '{rx}') AS m, regexp_extract_all(t, '{rx}', {rule.group}) AS g, string_split_regex(t, '{rx}') AS gaps
      FROM d WHERE regexp_matches(t, '{rx}'))))
  WHERE length(g[i]) >= {rule.at_least}"""

    def joined(where: str) -> str:
        return f"coalesce(string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, k){where}, '')"

    base = f"FILTER (WHERE k < {len(BASE)})"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{x.kind}') AS n_{x.kind}" for x in BASE)
    every = "\nUNION ALL ".join(spans(k, rule) for k, rule in enumerate(rules))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({every}),
f AS (SELECT r, {counts}, {joined(" " + base)} AS base, {joined("")} AS spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0)::BIGINT AS n_{x.kind}" for x in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f ON f.r = d.r"""
