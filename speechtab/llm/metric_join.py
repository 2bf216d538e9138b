"""Embedding near-dedup as an exact metric range join.

Cosine >= c on unit vectors is Euclidean distance <= r.  Pivots split the
distinct vectors into cells, and a cell into blocks of a bounded number of
vectors.  The triangle inequality says which blocks a vector may have a partner
in; it is copied to those (boundary replication) and to no other.  Each pair of
blocks is then joined independently, in one bounded matrix product that yields
counts and a spanning forest of the links, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import pick, written
from speechtab.llm.components import components

#: Vectors of a block; a task holds two blocks.
BLOCK = 4096
#: At most this many pivots, taken in hash order.
PIVOTS = 1024
#: Cosines this close to the bound are computed again, exactly rounded.
EDGE = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # against overflow and underflow of squares
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def _linked(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` (units ``u`` and ``v``) are linked."""
    c = u @ v.T
    hit = c >= cosine
    for i, j in zip(*np.nonzero(np.abs(c - cosine) <= EDGE)):
        hit[i, j] = _exact(x[i], y[j]) >= cosine
    return hit


class Cells:
    """Pivots with the radius and the number of blocks of each cell."""

    def __init__(self, pivots: np.ndarray, cosine: float, blocks: list[int] | None = None, radius: np.ndarray | None = None):
        self.pivots, self.r = pivots, math.sqrt(max(0.0, 2 - 2 * cosine))
        self.blocks, self.radius = blocks, radius
        self.first = np.cumsum([0, *blocks]) if blocks else None
        gram = pivots @ pivots.T
        self.apart = np.sqrt(np.maximum(2 - 2 * gram, 0))

    def distances(self, u: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (u @ self.pivots.T), 0))

    def home(self, d: np.ndarray) -> np.ndarray:
        return d.argmin(axis=1)

    def reach(self, d: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Cells that can hold a vector within ``r``: the triangle inequality
        for the cell's ball, and for the plane midway between the pivots, which
        such a vector lies at most ``r`` beyond.  A small slack absorbs
        rounding."""
        own = d[np.arange(len(d)), home][:, None]
        ball = d <= self.radius[None, :] + self.r + 1e-6
        apart = self.apart[home]
        plane = d * d - own * own <= 2 * apart * self.r + 1e-6
        return ball & plane


def _valid(vectors: DataFrame, vec_col: str, emb_col: str) -> DataFrame:
    rows = pick(vectors, id=vec_col, emb=emb_col)
    e = F.col("emb")
    good = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return rows.select(F.col("id").cast("long").alias("id"), F.when(good, F.transform(e, lambda x: x.cast("double") + 0.0)).alias("emb"))


def _forest(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to connect what ``hit`` connects between the ids ``a`` and
    ``b``: to a row's first partner, and a partner to its first row."""
    links = []
    seen_a, seen_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for i in np.flatnonzero(hit.any(axis=1)):
        if seen_a[i]:
            continue
        rows = [i]
        seen_a[i] = True
        while rows:  # breadth first; every row and column is visited once
            cols = np.flatnonzero(hit[rows].any(axis=0) & ~seen_b)
            seen_b[cols] = True
            for c in cols:
                links.append((int(a[rows[int(hit[rows, c].argmax())]]), int(b[c])))
            new = np.flatnonzero(hit[:, cols].any(axis=1) & ~seen_a) if len(cols) else np.array([], int)
            seen_a[new] = True
            for n in new:
                links.append((int(a[n]), int(b[cols[int(hit[n, cols].argmax())]])))
            rows = list(new)
    return links


def near_vectors(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK, pivots: int = PIVOTS, id_col: str = "vec_id", emb_col: str = "embedding") -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row.

    Vectors that are NULL, empty, zero or hold a NULL or non-finite component
    link with nothing and form a component of their own.  Vectors of different
    lengths do not link.  Equal vectors are joined once and counted as often as
    they occur.  Other columns are dropped; an empty table gives an empty
    table; ids are taken to be distinct integers, and rows with a NULL id
    neither link nor count."""
    spark = vectors.sparkSession
    rows = written(_valid(vectors, id_col, emb_col), "vectors")
    # one representative for equal vectors
    reps = written(rows.where("id IS NOT NULL AND emb IS NOT NULL").groupBy("emb").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "distinct")
    parts = []
    for dim in sorted(r[0] for r in reps.select(F.size("emb")).distinct().collect()):  # a handful of lengths
        parts.append(_join(reps.where(F.size("emb") == dim), cosine, block, pivots))
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionAll(p)
        found = written(found, "found")
        counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
        comps = components(found.where("kind = 1").select("a", "b"))
    else:
        counts = spark.createDataFrame([], "rep long, others long")
        comps = spark.createDataFrame([], "node long, component long")
    tied = reps.join(counts, F.col("id") == F.col("rep"), "left").join(comps, F.col("id") == F.col("node"), "left")
    tied = tied.select(F.col("emb").alias("key"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(tied, (F.col("emb") == F.col("key")) & F.col("id").isNotNull(), "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def _join(reps: DataFrame, cosine: float, block: int, pivots: int) -> DataFrame:
    """``kind, a, b``: kind 0, the rows (b) that a representative (a) links to
    in some block; kind 1, links that connect representatives."""
    n = reps.count()
    chosen = reps.orderBy(F.xxhash64("emb"), "id").limit(max(1, min(pivots, math.ceil(n / block) * 2))).select("emb").toArrow()
    units = _unit(_matrix(chosen.column(0).combine_chunks()))
    plain = Cells(units, cosine)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, radius = np.zeros(len(units), np.int64), np.zeros(len(units))
        for batch in batches:
            if batch.num_rows:
                d = plain.distances(_unit(_matrix(batch.column("emb"))))
                home = plain.home(d)
                np.add.at(count, home, 1)
                np.maximum.at(radius, home, d[np.arange(len(d)), home])
        yield pa.RecordBatch.from_pydict({"cell": np.arange(len(units)), "n": count, "radius": radius})

    sizes = reps.select("emb").mapInArrow(measure, "cell long, n long, radius double").groupBy("cell").agg(F.sum("n"), F.max("radius")).orderBy("cell").toArrow()
    blocks = [max(1, -(-c // block)) for c in sizes.column(1).to_pylist()]
    cells = Cells(units, cosine, blocks, np.array(sizes.column(2).to_pylist()))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, per = cells.first, np.array(cells.blocks)
        step = max(1, 65_536 // int(first[-1]))  # bounds what a slice expands to
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                x = _matrix(batch.column("emb"))
                d = cells.distances(_unit(x))
                home = cells.home(d)
                reach = cells.reach(d, home)
                own = first[home] + batch.column("h").to_numpy() % per[home]
                where = np.repeat(reach, per, axis=1)  # cell -> block
                where[np.arange(len(x)), own] = True
                row, other = np.nonzero(where)
                mine = own[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other)), pa.array(mine)] + [batch.column(c).take(pa.array(row)) for c in ("id", "n", "emb")],
                    names=["p", "q", "own", "id", "n", "emb"],
                )

    schema = "p long, q long, own long, id long, n long, emb array<double>"
    keyed = reps.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).select("id", "n", "emb", "h").mapInArrow(replicate, schema)

    def match(key: tuple, group: pa.Table) -> pa.Table:
        p, q = key[0].as_py(), key[1].as_py()
        own, ids, n = (group.column(c).to_numpy() for c in ("own", "id", "n"))
        x = _matrix(group.column("emb").combine_chunks())
        u = _unit(x)
        left = np.flatnonzero(own == p)
        right = left if p == q else np.flatnonzero(own == q)
        kind, a, b = [], [], []
        if len(left) and len(right):
            hit = _linked(x[left], x[right], u[left], u[right], cosine)
            if p == q:
                np.fill_diagonal(hit, False)
            for side, other, h in ((left, right, hit), (right, left, hit.T))[: 1 if p == q else 2]:
                total = h @ n[other]
                some = np.flatnonzero(total)
                kind += [0] * len(some)
                a += ids[side[some]].tolist()
                b += total[some].tolist()
            for s, t in _forest(hit, ids[left], ids[right]):
                kind.append(1)
                a.append(s)
                b.append(t)
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return keyed.groupBy("p", "q").applyInArrow(match, "kind int, a long, b long")


def oracle_sql(cosine: float = 0.95) -> str:
    """DuckDB SQL for the contract query: brute force over all pairs."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
r(id, seen) AS (SELECT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT id, min(seen) AS component FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(c.component, e.vec_id)::BIGINT AS component_id,
       coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.id = e.vec_id"""
