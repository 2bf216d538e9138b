"""SimHash near-dedup over a byte-position inverted index.

Two 64-bit fingerprints that differ in at most four bits agree in at least four
of their eight bytes, at the same positions: the guaranteed minimum of matches.
A posting therefore holds fingerprints that share three bytes at given
positions; twenty sets of three positions are enough for every set of four to
contain one of them, so no qualifying pair is missed.  Pairs that meet in a
posting have their shared positional bytes tallied, and those that reach the
minimum are verified on their bits.

Only distinct fingerprints enter the index.  A posting yields a spanning
forest of its links, never all of its pairs; one that grows past a bound is
split by a further byte and then by half bytes, after which the bytes left
open bound it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechtab.llm.common import flat, ids_and_text, written
from speechtab.llm.components import components

SHINGLE = 4
MAX_BITS = 4
#: Distinct fingerprints of a posting that one task links by itself.
POSTING = 16_384


def _byte_masks(sets) -> list[int]:
    return [sum(0xFF << (8 * p) for p in s) for s in sets]


def _triples() -> list[tuple[int, ...]]:
    """Twenty triples of the eight positions such that any four positions
    contain one: positions in a ring of three classes, triples within a class
    or with two of one class and one of the next."""
    ring = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for c in ring for t in combinations(c, 3)]
    for k, c in enumerate(ring):
        out += [(*two, one) for two in combinations(c, 2) for one in ring[(k + 1) % 3]]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


TRIPLES = _triples()
#: Index levels: what a posting's fingerprints have in common.
LEVEL_MASKS = [_byte_masks(TRIPLES), _byte_masks(combinations(range(8), 4))]


def _nibble_masks(mask: int) -> list[int]:
    """``mask`` (four bytes) with four of the eight half bytes outside it: at
    most four bits differ there, so four half bytes agree."""
    free = [h for h in range(16) if not mask >> (4 * h) & 0xF]
    return [mask | sum(0xF << (4 * h) for h in c) for c in combinations(free, 4)]


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text's word shingles (A-Z lower-cased)."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    body = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        h = np.array([digest(body, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        ends = ends.tolist()
        h = np.fromiter((digest(body[s:e], 42) for s, e in zip(starts, ends[size - 1 :])), np.uint64, len(words) - size + 1)
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        part = h[k : k + 65536].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(count * 2 > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """``id, fp`` (bigint holding the 64 bits) of every row, and if ``hashed``
    also ``h``, the text's hash."""
    df = ids_and_text(docs, id_col, text_col)
    kept = {"id": df.schema["id"].dataType.simpleString()} | ({"h": "long"} if hashed else {})
    df = df.select("text", "id", *([F.xxhash64("text").alias("h")] if hashed else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array((fingerprint(t.as_py(), size) for t in batch.column(0)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], fps], names=[*kept, "fp"])

    return df.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kept.items()) + ", fp long")


def forest(fps: np.ndarray, bits: int = MAX_BITS, shared: int = 8 - MAX_BITS) -> list[tuple[int, int]]:
    """Links that join what is connected within a posting: tallies the shared
    positional bytes of a fingerprint with all that are not reached yet, keeps
    those with the minimum of matches, and verifies their bits."""
    fps = np.unique(fps).view(np.uint64)
    links: list[tuple[int, int]] = []
    rest = fps
    queue: list = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        x = queue.pop()
        diff = rest ^ x
        near = np.zeros(len(rest), bool)
        tally = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        some = np.flatnonzero(tally >= shared)
        near[some] = np.bitwise_count(diff[some]) <= bits
        found = rest[near]
        if len(found):
            links += [(_signed(int(x)), int(y)) for y in found.view(np.int64)]
            queue += list(found)
            rest = rest[~near]
    return links


def _postings(keyed: DataFrame, bound: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Links of the postings of ``keyed`` (mask, key, fp) and, if there is a
    bound, the rows of postings beyond it."""
    sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    sizes = written(sizes, "postings")
    two = sizes.where(f"n = 2 AND bit_count(lo ^ hi) <= {MAX_BITS}").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    more = keyed.join(sizes.where("n > 2" if bound is None else f"n > 2 AND n <= {bound}").select("mask", "key"), ["mask", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [x for row in batch.column(0) for x in forest(row.values.to_numpy(zero_copy_only=False).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    links = two.unionAll(more.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(run, "a long, b long"))
    if bound is None:
        return links, None
    return links, keyed.join(sizes.where(f"n > {bound}").select("mask", "key"), ["mask", "key"])


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    masked = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    return masked.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def links(fps: DataFrame, posting: int = POSTING) -> DataFrame:
    """``a, b`` links that connect all distinct ``fp`` (non-NULL, each once) at
    :data:`MAX_BITS` or fewer differing bits, directly or over others."""
    found, hot = _postings(_keyed(fps, LEVEL_MASKS[0]), posting)
    hot = written(hot, "hot")
    if hot.isEmpty():
        return found
    more, hot = _postings(_keyed(hot.select("fp").distinct(), LEVEL_MASKS[1]), posting)
    found, hot = found.unionAll(more), written(hot, "hotter")
    if hot.isEmpty():
        return found
    # four bytes and four half bytes fixed: at most 2**16 distinct fingerprints
    finer = F.lit(None).cast("array<bigint>")
    for m in LEVEL_MASKS[1]:
        finer = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(x)) for x in _nibble_masks(m)])).otherwise(finer)
    keyed = hot.select("fp", F.explode(finer).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    return found.unionAll(_postings(keyed.distinct(), None)[0])


def _tied(distinct: DataFrame, posting: int) -> DataFrame:
    """``distinct`` (each ``fp`` once, and other columns) with the component of
    each fingerprint."""
    distinct = written(distinct, "distinct")
    comps = components(links(distinct.select("fp"), posting))
    return written(distinct.join(comps, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp")), "tied")


def near_dups(docs: DataFrame, size: int = SHINGLE, posting: int = POSTING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp, component_id, leader`` for every row: the smallest
    non-NULL id among the rows whose fingerprints are connected, and whether
    the row has that id.

    NULL, empty and wordless texts have fingerprint zero, which links like any
    other.  Rows that repeat are each returned.  A row with a NULL id belongs
    to its component too; where no id is known ``component_id`` is NULL.
    Other columns are dropped; an empty table gives an empty table."""
    rows = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    tied = _tied(rows.groupBy("fp").agg(F.min("id").alias("low")), posting)
    # written, so that the join reads two plain shuffles and a large component can be split
    low = written(tied.groupBy("component").agg(F.min("low").alias("component_id")), "smallest")
    by_fp = tied.select("fp", "component").join(low, "component").select("fp", "component_id")
    out = rows.join(by_fp, "fp").select("id", "fp", "component_id")
    return out.withColumn("leader", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, size: int = SHINGLE, posting: int = POSTING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each connected group, all columns as they were:
    the one with the smallest id, a NULL id after all others, and of those with
    one id the one whose text has the least hash.  Of rows alike in both one
    stays."""
    plain, (ident, text) = flat(docs, id_col, text_col)
    rows = written(fingerprints(plain, size, ident, text, hashed=True), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("low")
    tied = _tied(rows.groupBy("fp").agg(first), posting)
    # id and text hash decide the fingerprint, so no two components have one leader
    leaders = written(tied.groupBy("component").agg(F.min("low").alias("low")).select(F.col("low.id").alias("key"), F.col("low.h").alias("lead")), "leaders")
    hashed = plain.withColumn("h", F.xxhash64(F.coalesce(text, F.lit(""))))
    kept = hashed.join(leaders, F.col(ident).eqNullSafe(F.col("key")) & (F.col("h") == F.col("lead")), "left_semi")
    order = Window.partitionBy(ident, "h").orderBy(F.col(text).isNull())
    return kept.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "h").toDF(*docs.columns)
