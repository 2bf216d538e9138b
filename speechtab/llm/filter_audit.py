"""Filter interaction audit: what each filter removes in every order of the
filters, from one number a document.

A document's failures decide which of the 2**n sets of filters let it pass.
They become its *survival word*, the truth table whose bit S is 1 if the
document survives the set S.  Adding up the words bit by bit gives the
survivors of every set, and every order's figures are differences of those
sums, so the documents are read once, not once for each order.

The words are added by carry-save adders: three words of one weight become a
word of that weight and a carry word of twice the weight, all 32 bit columns at
once.  A task keeps at most two words of each weight for each part and label
and sends 32 counts, whatever the number of its documents.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtab.llm.common import pick, require, written

#: Sets of filters that fit a survival word of 32 bits: five filters.
MOST = 5
#: Groups (part and labels) whose words a task holds; beyond, it sends the
#: counts it has and starts anew.
GROUPS = 65_536


#: A filter's failure condition: of a text's bytes (UTF-8) and its words.
Fails = Callable[[bytes, list[bytes]], bool]

_CAPITALS = string.ascii_uppercase.encode()
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#$%&*|"


def _without(text: bytes, some: bytes) -> int:
    return len(text.translate(None, some))


#: Letter -> failure condition of the row filters.  ``bytes.split`` cuts at
#: space and U+0009..U+000D, and nothing else.
ROW_FILTERS: dict[str, Fails] = {
    "A": lambda text, words: len(words) < 100,
    "B": lambda text, words: 100 * len(set(words)) < 80 * len(words),
    "C": lambda text, words: 100 * (len(text) - _without(text, _CAPITALS)) > 10 * _without(text, _CONTINUED),
    "D": lambda text, words: _without(text, _SYMBOLS) < len(text),
}
#: The filter that removes repeated texts.
DUPLICATES = "E"


def truth_table(n: int) -> list[int]:
    """For each set of failed filters, the word of the sets that a document
    with these failures survives."""
    return [sum(1 << s for s in range(1 << n) if s & failed == 0) for failed in range(1 << n)]


class Counter:
    """Sums of the bit columns of many words, kept as carry-save pairs."""

    def __init__(self) -> None:
        self.pending: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        weight = 0
        while len(words):
            if weight == len(self.pending):
                self.pending.append(np.empty(0, np.uint32))
            words = np.concatenate([self.pending[weight], words])
            carries = []
            while len(words) > 2:
                k = len(words) // 3
                a, b, c = words[:k], words[k : 2 * k], words[2 * k : 3 * k]
                half = a ^ b
                carries.append((a & b) | (half & c))
                words = np.concatenate([half ^ c, words[3 * k :]])
            self.pending[weight] = words
            words = np.concatenate(carries) if carries else words[:0]
            weight += 1

    def counts(self) -> list[int]:
        """How many words have each bit."""
        total = np.zeros(32, np.int64)
        for weight, words in enumerate(self.pending):
            for w in words:
                total += ((int(w) >> np.arange(32)) & 1).astype(np.int64) << weight
        return total.tolist()


_COUNTED = "part string, good boolean, toxic boolean, n array<bigint>"
_ARROW = pa.schema([("part", pa.string()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.list_(pa.int64()))])


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, Counter] = {}

    def sent() -> pa.RecordBatch:
        rows = [dict(zip(_ARROW.names, (*key, c.counts()))) for key, c in held.items()]
        held.clear()
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        code = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4
        code += 2 * batch.column("good").to_numpy(zero_copy_only=False).astype(np.int64) + batch.column("toxic").to_numpy(zero_copy_only=False)
        words = batch.column("word").to_numpy(zero_copy_only=False).astype(np.uint32)
        order = np.argsort(code, kind="stable")
        groups, first = np.unique(code[order], return_index=True)
        for g, ws in zip(groups.tolist(), np.split(words[order], first[1:])):
            key = (parts.dictionary[g // 4].as_py(), bool(g & 2), bool(g & 1))
            held.setdefault(key, Counter()).add(ws)
        if len(held) > GROUPS:
            yield sent()
    if held:
        yield sent()


def survival_words(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Fails] = ROW_FILTERS,
    duplicates: str | None = DUPLICATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """``part, good, toxic, word``: one row per document; bit S of ``word``
    says that the document survives the set S of filters, where bit k of S
    stands for the k-th filter (``filters`` in their order, then
    ``duplicates``).

    Texts are whole; a NULL text is the empty one, a NULL part the empty
    string.  A text is a duplicate if a row with a smaller id has the same one
    (by SHA-256); rows that share the smallest id all stay, and a row with a
    NULL id neither is a duplicate nor makes one, nor has labels.  A document
    is good (toxic) if any of its label rows has quality (toxic) 1, so repeated
    rows and NULLs in ``labels`` do no harm.  Other columns are not looked at.

    Texts are not shuffled: their rows shrink to a digest and a bit set first.
    Both joins are on ids, so a large group of copies is spread over all tasks;
    what they join is written, so that Spark can split a frequent id."""
    names = [*filters, *([duplicates] if duplicates else [])]
    if not 0 < len(names) <= MOST:
        raise ValueError(f"{len(names)} filters: from 1 to {MOST} make a survival word")
    rows = pick(docs, id=id_col, text=text_col, part=part_col).select("id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    id_field = rows.schema["id"]
    fails = list(filters.values())

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, failed = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = text.split()
                digests.append(sha256(text).digest())
                failed.append(sum(1 << k for k, f in enumerate(fails) if f(text, words)))
            columns = [batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(failed, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "digest", "failed"])

    schema = T.StructType([id_field, T.StructField("part", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("failed", T.IntegerType())])
    rows = written(rows.mapInArrow(judged, schema), "failed")
    known, rest = rows.where("id IS NOT NULL"), rows.where("id IS NULL")

    lab = pick(labels, id=id_col, quality="quality", toxic="toxic").where("id IS NOT NULL")
    lab = lab.groupBy("id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = known.join(written(lab, "labels"), "id", "left")
    if duplicates:
        bit = 1 << len(filters)
        known = known.join(written(first, "first"), ["id", "digest"], "left").withColumn("failed", F.col("failed") + F.when(F.col("first"), 0).otherwise(bit))
    no = F.lit(False)
    table = F.array(*[F.lit(w).cast("bigint") for w in truth_table(len(names))])
    out = known.select("part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "failed")
    out = out.unionAll(rest.select("part", no, no, "failed"))
    return out.select("part", "good", "toxic", F.get(table, F.col("failed")).alias("word"))


def survivors(words: DataFrame) -> DataFrame:
    """``part, n, n_good, n_toxic``: for every set of filters (32 places, those
    of sets that do not exist are 0) the documents of the part that survive
    it, all of them and by label."""
    require(words, ["part", "good", "toxic", "word"])
    counted = words.select("part", "good", "toxic", "word").mapInArrow(_popcounts, _COUNTED)

    def added(only: str = "true") -> Column:
        return F.expr("array(" + ", ".join(f"sum(if({only}, n[{s}], 0))" for s in range(32)) + ")")

    return counted.groupBy("part").agg(added().alias("n"), added("good").alias("n_good"), added("toxic").alias("n_toxic"))


def audit(words: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, from the survival
    words: ``part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley`` (counts, see the columns'
    names; ``shapley`` is the filter's ``removed`` summed over all orders).
    Parts without documents have no rows; an empty table gives none."""
    n, every = len(names), (1 << len(names)) - 1
    if not 0 < n <= MOST:
        raise ValueError(f"{n} filters: from 1 to {MOST} make a survival word")
    orders = F.from_json(F.lit(json.dumps(list(permutations(range(n))))), "array<array<int>>")
    letters = F.array(*[F.lit(x) for x in names])
    after = F.col("before").bitwiseOR(F.col("bit"))

    def lost(counts: str) -> Column:
        return F.get(counts, F.col("before")) - F.get(counts, after)

    # the orders in which exactly the set S comes before a filter: |S|! (n-1-|S|)!
    weights = F.array(*[F.lit(factorial(s.bit_count()) * factorial(max(0, n - 1 - s.bit_count()))).cast("bigint") for s in range(1 << n)])
    sets = F.filter(F.sequence(F.lit(0), F.lit(every)), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    shapley = F.aggregate(sets, F.lit(0).cast("bigint"), lambda acc, s: acc + F.get(weights, s) * (F.get("n", s) - F.get("n", s.bitwiseOR(F.col("bit")))))
    counts = ["n", "n_good", "n_toxic"]
    rows = survivors(words).select("part", *counts, F.explode(orders).alias("order"))
    rows = rows.select("part", *counts, "order", F.posexplode("order").alias("earlier", "k"))
    rows = rows.select(
        "part",
        *counts,
        F.array_join(F.transform("order", lambda k: F.get(letters, k)), "").alias("order"),
        (F.col("earlier") + 1).alias("step"),
        F.get(letters, F.col("k")).alias("filter"),
        F.expr("aggregate(slice(order, 1, earlier), 0, (acc, x) -> acc | (1 << x))").alias("before"),
        F.expr("1 << k").alias("bit"),
    )
    return rows.select(
        "part",
        F.col("order").alias("filter_order"),
        "step",
        "filter",
        F.get("n", after).alias("kept"),
        lost("n").alias("removed"),
        (F.get("n", F.lit(0)) - F.get("n", F.col("bit")) - lost("n")).alias("redundant"),
        (F.get("n", F.lit(every) - F.col("bit")) - F.get("n", F.lit(every))).alias("unique_fails"),
        lost("n_good").alias("good_lost"),
        lost("n_toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Fails] = ROW_FILTERS, duplicates: str | None = DUPLICATES, **columns: str) -> DataFrame:
    """``audit`` of the ``survival_words`` of ``docs``."""
    return audit(survival_words(docs, labels, filters, duplicates, **columns), [*filters, *([duplicates] if duplicates else [])])


def oracle_sql() -> str:
    """DuckDB SQL for the audit of ``documents`` by the five filters."""
    return r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed
  FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM f GROUP BY part, failed),
k AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT list_aggregate(list_transform(o, lambda i: chr(CAST(65 + i AS INTEGER))), 'string_agg', '') AS filter_order, o, unnest(range(1, 6)) AS step FROM o),
b AS (SELECT filter_order, CAST(step AS INTEGER) AS step, CAST(1 << o[step] AS INTEGER) AS bit, CAST(coalesce(list_sum(list_transform(o[1:step - 1], lambda i: 1 << i)), 0) AS INTEGER) AS earlier FROM s),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN failed & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & earlier = 0 AND failed & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & earlier <> 0 AND failed & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & earlier = 0 AND failed & bit <> 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & earlier = 0 AND failed & bit <> 0 THEN x ELSE 0 END) AS toxic_lost
  FROM m, b GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""
