"""Toxicity scores by a factorization machine over hashed terms.

A term is a word or a word's beginning; its feature says whether the text has
it.  Besides a weight, each feature has a short factor vector, and the product
of two features' vectors weighs their meeting in one text: an insult together
with a mention of a group counts for more than either adds up to.

The machine is fitted on a bounded sample of labelled rows; scoring is a map
over all documents and their whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import ids_and_text, pick, written

#: Labelled rows that the machine is fitted on at most, in hash order.
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 18
RANK = 4
#: A feature takes part if its share among toxic texts differs from that among
#: the others by so many standard errors, and if it occurs often enough.
MIN_Z, MIN_ROWS = 6.0, 8
#: The least lean to toxic texts of features that pairs are looked for among,
#: and how many of them.
PAIR_Z, PAIRED = 1.5, 1500
#: Features that take part where none stands out.
FEW = 10
#: Gradient steps at least.
STEPS = 1500
PREFIXES = (4, 5)
CUT = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000


def features(word: str) -> list[int]:
    """Hashed terms of a lower-case word: itself and its beginnings."""
    terms = ["=" + word] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n]
    return [zlib.crc32(t.encode()) % BUCKETS for t in terms]


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Machine:
    """``index`` maps a hashed term to its row in ``weights`` and ``factors``."""

    index: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, texts: Iterable[str]) -> Iterator[float]:
        cache: dict[str, tuple] = {}
        plain = 1 / (1 + np.exp(-self.bias))
        for text in texts:
            rows: set[int] = set()
            for w in words(text):
                got = cache.get(w)
                if got is None:
                    got = tuple(r for r in map(self.index.get, features(w)) if r is not None)
                    if len(cache) < _CACHE:
                        cache[w] = got
                if got:
                    rows.update(got)
            yield float(self.score(np.fromiter(sorted(rows), np.int64, len(rows)))) if rows else float(plain)

    def score(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        total = v.sum(axis=0)
        pairs = 0.5 * (total @ total - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(self.bias + self.weights[rows].sum() + pairs, -30, 30)))


def _chance(hits: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """How likely at least ``toxic`` of ``hits`` texts are toxic if each is
    with probability ``share`` (the binomial tail, summed down from all)."""
    hits, toxic = hits.astype(int), toxic.astype(int)
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, max(1, hits.max(initial=0)) + 1)))])
    total = np.zeros(len(hits))
    share = min(share, 1 - 1e-9)
    for k in range(int((hits - toxic).max(initial=0)) + 1):
        n = hits - k  # toxic ones of the term with k others
        ok = n >= toxic
        h, m = hits[ok], n[ok]
        total[ok] += np.exp(log[h] - log[m] - log[h - m] + m * np.log(share) + k * np.log1p(-share))
    return total


def screened(hit: np.ndarray, toxic: np.ndarray, ones: float, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(features that take part by themselves, those that may by pairs).

    A feature takes part if its share among toxic texts differs from that among
    the others by ``MIN_Z`` standard errors in ``MIN_ROWS`` texts, or if fewer
    than one such feature is expected to be as one-sidedly toxic by chance,
    whatever the number of rows; if none does, the ``FEW`` least likely ones
    do.  Pairs are looked for among the others that
    lean to toxic texts (``PAIR_Z``, and two of them), the ``PAIRED`` with the
    clearest lean."""
    share = hit / rows
    spread = np.sqrt(np.maximum(share * (1 - share) * (1 / ones + 1 / (rows - ones)), 1e-12))
    z = (toxic / ones - (hit - toxic) / (rows - ones)) / spread
    taken = (np.abs(z) >= MIN_Z) & (hit >= MIN_ROWS)
    few = np.flatnonzero((toxic >= 2) & (hit < 200) & (z > PAIR_Z) & ~taken)
    rare = few[_chance(hit[few], toxic[few], ones / rows) * max(1, np.count_nonzero(hit)) < 1]
    taken[rare] = True
    if not taken.any():
        taken[few[np.argsort(_chance(hit[few], toxic[few], ones / rows), kind="stable")[:FEW]]] = True
    lean = np.flatnonzero((toxic >= 2) & (z >= PAIR_Z) & ~taken)
    lean = lean[np.argsort(-z[lean], kind="stable")[:PAIRED]]
    return np.flatnonzero(taken), np.sort(lean)


def toxic_pairs(data: list[np.ndarray], labels: np.ndarray, taken: np.ndarray, lean: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of features, one of them at least in ``lean`` and the other there
    or in ``taken``, whose meetings are toxic more often than the base rate, or
    the rate of the one that is taken, allows for any of all pairs that met (a
    tenth in expectation).  Features of one text are counted together by a
    matrix product."""
    if not len(lean):
        return []
    every = np.concatenate([taken[:PAIRED], lean])
    first = len(every) - len(lean)
    place = np.full(BUCKETS, -1)
    place[every] = np.arange(len(every))
    met = {0: np.zeros((len(every), len(lean))), 1: np.zeros((len(every), len(lean)))}
    alone = {0: np.zeros(len(every)), 1: np.zeros(len(every))}
    for y in (0, 1):
        rows = [place[d] for d, label in zip(data, labels) if label == y]
        for at in range(0, len(rows), 1024):
            m = np.zeros((len(rows[at : at + 1024]), len(every)), np.float32)
            for k, r in enumerate(rows[at : at + 1024]):
                m[k, r[r >= 0]] = 1
            met[y] += m.T @ m[:, first:]
            alone[y] += m.sum(axis=0)
    below = np.arange(len(every))[:, None] < first + np.arange(len(lean))[None, :]  # each pair once
    out = []
    for some in (np.arange(len(every)) < first, np.arange(len(every)) >= first):
        shown = below & some[:, None] & (met[0] + met[1] > 0)
        i, j = np.nonzero(shown & (met[1] >= 4))
        toxic, hits = met[1][i, j], met[0][i, j] + met[1][i, j]
        base = np.full(len(i), labels.mean())
        if some[:first].any():
            base = np.maximum(base, alone[1][i] / (alone[0][i] + alone[1][i]))
        for k in np.flatnonzero(toxic / hits > np.minimum(2 * base, (1 + base) / 2)):
            if _chance(hits[k : k + 1], toxic[k : k + 1], float(base[k]))[0] * np.count_nonzero(shown) < 0.1:
                out.append((int(every[i[k]]), int(lean[j[k]])))
    return out


def fit(samples: list[tuple[np.ndarray, int]], epochs: int = 30, rate: float = 0.1, decay: float = 1e-4, seed: int = 11, screen: tuple[np.ndarray, np.ndarray] | None = None) -> Machine:
    """Fit on (feature ids, label) pairs by adaptive gradient steps: ``epochs``
    passes, and more over few rows, so that there are ``STEPS`` steps.  With no
    samples, or one label only, the score is the (smoothed) share of ones.

    Features take part by themselves or in pairs (``screened``, computed from
    the samples unless given; ``toxic_pairs``); the factors of a pair start
    alike, so that its meeting weighs from the start."""
    labels = np.array([y for _, y in samples], float)
    ones, rows = labels.sum(), len(samples)
    bias = float(np.log((ones + 0.5) / (rows - ones + 0.5)))
    if not 0 < ones < rows:
        return Machine({}, bias, np.zeros(0), np.zeros((0, RANK)))
    if screen is None:
        hit, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for ids, y in samples:
            hit[ids] += 1
            if y:
                toxic[ids] += 1
        screen = screened(hit, toxic, ones, rows)
    pairs = toxic_pairs([ids for ids, _ in samples], labels, *screen)
    chosen = np.unique(np.concatenate([screen[0], np.array([f for p in pairs for f in p], np.int64)]))
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    data = [place[ids] for ids, _ in samples]
    data = [np.sort(d[d >= 0]) for d in data]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), RANK))
    for a, b in pairs:
        u = rng.normal(size=RANK)
        u *= 0.7 / np.linalg.norm(u)
        v[place[a]] += u
        v[place[b]] += u
    gb, gw, gv = 1e-8, np.full(w.shape, 1e-8), np.full(v.shape, 1e-8)
    starts = np.cumsum([0] + [len(d) for d in data])
    flat = np.concatenate(data)
    n, batches = len(chosen), max(1, rows // 256)
    for _ in range(max(epochs, -(-STEPS // batches))):
        for part in np.array_split(rng.permutation(rows), batches):
            # the part's features end to end, and the row each belongs to
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in part])
            f, row = flat[at], np.repeat(np.arange(len(part)), starts[part + 1] - starts[part])
            vf = v[f]
            total = np.stack([np.bincount(row, vf[:, r], len(part)) for r in range(RANK)], axis=1)
            pairs = 0.5 * ((total * total).sum(axis=1) - np.bincount(row, (vf * vf).sum(axis=1), len(part)))
            y = bias + np.bincount(row, w[f], len(part)) + pairs
            e = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[part]) / len(part)
            db, dw = e.sum(), decay * w + np.bincount(f, e[row], n)
            push = e[row][:, None] * (total[row] - vf)
            dv = decay * v + np.stack([np.bincount(f, push[:, r], n) for r in range(RANK)], axis=1)
            gb += db * db
            gw += dw * dw
            gv += dv * dv
            bias -= rate * db / np.sqrt(gb)
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
    return Machine({int(c): k for k, c in enumerate(chosen)}, float(bias), w, v)


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id's text mod 3 is 1."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit on at most ``rows`` labelled ids, in hash order, not held out.  Rows
    without an id or label are passed over.  Of rows that share an id, the one
    whose text has the least hash is learned from.

    Features are counted on Spark (at most ``BUCKETS`` counts come to the
    driver) and screened; then the screened features of each sampled id come,
    however long its text is.  With fewer than some 50 toxic rows single terms
    rarely show clearly enough, and scores tell little."""
    some = pick(labels, key=id_col, y=label_col).select("key", F.col("y").cast("int").alias("y"))
    some = some.where(F.col("key").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("key")))
    some = some.groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = ids_and_text(docs, id_col, text_col).join(F.broadcast(some), F.col("id") == F.col("key"))
    texts = texts.groupBy("key").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("least")).select("least.text", "least.y")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [sorted({f for w in words(t.as_py()) for f in features(w)}) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), batch.column(1)], names=["ids", "y"])

    found = written(texts.mapInArrow(extract, "ids array<int>, y int"), "features")
    sizes = found.agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("ones")).first()
    n, ones = sizes["rows"], float(sizes["ones"] or 0)
    screen = None
    if 0 < ones < n:
        counts = found.select("y", F.explode("ids").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("hit"), F.sum("y").alias("toxic")).toArrow()
        hit, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        at = counts.column("f").to_numpy()
        hit[at], toxic[at] = counts.column("hit").to_numpy(), counts.column("toxic").to_numpy()
        screen = screened(hit, toxic, ones, n)
        wanted = np.zeros(BUCKETS, bool)
        wanted[np.concatenate(screen)] = True

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [x[wanted[x]] for x in (np.asarray(i.values, np.int64) for i in batch.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), batch.column(1)], names=["ids", "y"])

        found = found.mapInArrow(kept, "ids array<int>, y int")
    else:
        found = found.select(F.array().cast("array<int>").alias("ids"), "y")
    table = found.toArrow()
    samples = [(np.asarray(i.values, dtype=np.int64), y) for i, y in zip(table.column("ids"), table.column("y").to_pylist())]
    samples.sort(key=lambda s: (s[1], len(s[0]), s[0].tobytes()))  # the same order however Spark returns them
    return fit(samples, screen=screen)


def toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``docs``.

    NULL and empty texts get the score of a text without terms.  Rows that
    repeat are each scored; a NULL id is not held out; other columns are
    dropped; an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pa.array(shared.value.scores(t.as_py() for t in batch.column(1)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), s], names=["id", "score"])

    df = ids_and_text(docs, id_col, text_col)
    out = df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
