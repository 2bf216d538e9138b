"""Suffix-array dedup: remove every byte covered by a long string that also
starts elsewhere.

A full suffix array holds one suffix per byte.  This one is sparse: a window of
``LENGTH`` bytes names its anchor, the position inside it with the least hash
of the next ``GRAM`` bytes, so equal windows have their anchors at the same
place.  The suffixes at anchors, about one in 150 bytes, stand for all windows;
the windows of an anchor together cover its span.

Anchors are grouped by the hash of their first bytes.  A gram that occurs once
repeats nothing, and equal spans are counted without being looked at.  What is
left, different spans with one gram, is ordered by deep-shallow sorting:
multikey quicksort to a shallow depth, then blind tries for the groups that
still have a common prefix there.  Merging neighbours in decreasing order of
their common prefix, together with the order of what precedes the anchors,
gives each span the windows that it shares with any other.

A gram with very many different spans is partitioned further before it is
ordered: a window that begins ``p`` to ``q`` bytes before the anchor holds the
``p`` bytes before it and the ``length - q`` after it, so the range of ``p`` to
``q`` is halved, and pieces of spans that agree on those bytes form the parts.
Equal pieces are counted like equal spans, the different ones that are left
are ordered, or halved again.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import ids_and_text, written

LENGTH = 400
GRAM = 100
#: Bytes after the gram that multikey quicksort looks at.
SHALLOW = 32
#: Different spans with one gram that a task orders; beyond, they are
#: partitioned by more of their bytes.
GROUP = 16_384
#: Windows whose anchors are looked for at once in a long text.
CHUNK = 1 << 22

_POS = np.uint64((1 << 24) - 1)
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of ``base`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


_BYTE = np.frombuffer(hashlib.shake_256(b"bytes").digest(256 * 8), np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at every position: differences of
    prefix sums, brought to a common power and mixed."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_INVERSE, n), out=sums[1:])
    h = (sums[gram:] - sums[: n + 1 - gram]) * _power(_MULT, n + 1 - gram)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` values in a row: blockwise running minima from both
    sides."""
    n = len(v)
    pad = -n % w
    blocks = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """``(anchor, first, last, key)``: the windows starting at ``first`` to
    ``last`` have this anchor, and ``key`` is its gram's (signed) hash."""
    whole = np.frombuffer(text, np.uint8)
    for start in range(0, len(text) - length + 1, CHUNK):
        data = whole[start : start + CHUNK + length - 1]
        h = gram_hashes(data, gram)
        v = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        at = (_window_min(v, length - gram + 1) & _POS).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut - 1, [len(at) - 1]])
        a = at[first]
        key = h[a].view(np.int64)
        yield from zip((a + start).tolist(), (first + start).tolist(), (last + start).tolist(), key.tolist())


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def multikey_quicksort(items: list[int], strings: list[bytes], depth: int, limit: int, out: list[int]) -> None:
    """Append ``items`` in order of their strings to ``out``: three-way
    partitions by the byte at ``depth``, and blind tries from ``limit`` on."""
    stack = [(items, depth)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2:
            out += items
        elif depth < 0:
            out += items  # strings that ended: all equal
        elif depth >= limit:
            out += blind_trie(items, strings, depth)
        else:
            byte = [strings[i][depth] if depth < len(strings[i]) else -1 for i in items]
            sample = sorted(byte[:: max(1, len(byte) // 9)])
            pivot = sample[len(sample) // 2]
            parts: tuple[list, list, list] = ([], [], [])
            for i, c in zip(items, byte):
                parts[1 if c == pivot else 2 if c > pivot else 0].append(i)
            # the least on top of the stack
            stack.append((parts[2], depth))
            stack.append((parts[1], depth + 1 if pivot >= 0 else -1))
            stack.append((parts[0], depth))


class _Node:
    __slots__ = ("children", "depth", "some")

    def __init__(self, depth: int, some: int):
        self.depth, self.some, self.children = depth, some, {}


def blind_trie(items: list[int], strings: list[bytes], depth: int) -> list[int]:
    """Order strings that agree before ``depth``: a trie whose nodes hold only
    the depth at which their strings part.  An insertion walks down blindly by
    the branching bytes, compares with one string it meets there, and branches
    at the depth found."""

    def byte(i: int, at: int) -> int:
        s = strings[i]
        return s[at] if at < len(s) else -1

    ends: dict[int, list[int]] = {items[0]: [items[0]]}  # equal strings share a leaf
    root: _Node | int = items[0]
    for i in items[1:]:
        node = root
        while isinstance(node, _Node):
            node = node.children.get(byte(i, node.depth), node.some)
        s, t = strings[i], strings[node]
        at = depth + _common(s[depth:], t[depth:])
        if at == len(s) == len(t):
            ends[node].append(i)
            continue
        ends[i] = [i]
        above, node = None, root
        while isinstance(node, _Node) and node.depth < at:
            above, node = node, node.children[byte(i, node.depth)]
        if isinstance(node, _Node) and node.depth == at:
            node.children[byte(i, at)] = i
            continue
        some = node.some if isinstance(node, _Node) else node
        new = _Node(at, some)
        new.children = {byte(some, at): node, byte(i, at): i}
        if above is None:
            root = new
        else:
            above.children[byte(i, above.depth)] = new
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack += [node.children[c] for c in sorted(node.children, reverse=True)]
        else:
            out += ends[node]
    return out


def shared_windows(spans: list[tuple[bytes, int]], length: int = LENGTH, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """For each of different spans (content, anchor's place in it) the first
    and last starts, counted from the span's, of windows that some other of
    them has at the same distance from its anchor."""
    out: list[list[tuple[int, int]]] = [[] for _ in spans]
    by_gram: dict[bytes, list[int]] = {}
    for i, (s, a) in enumerate(spans):
        by_gram.setdefault(s[a : a + gram], []).append(i)
    for group in by_gram.values():  # one, unless hashes collide
        if len(group) < 2:
            continue
        after = {i: spans[i][0][spans[i][1] :] for i in group}
        before = {i: spans[i][0][: spans[i][1]][::-1] for i in group}
        order: list[int] = []
        strings = [after.get(i, b"") for i in range(len(spans))]
        multikey_quicksort(group, strings, gram, gram + SHALLOW, order)
        lcp = sorted(((_common(after[i], after[j]), k) for k, (i, j) in enumerate(zip(order, order[1:]))), reverse=True)
        rank = {i: k for k, i in enumerate(sorted(group, key=before.__getitem__))}
        by_rank = {k: i for i, k in rank.items()}
        head = list(range(len(order)))  # union-find over places in the order
        sets: list[list[int]] = [[rank[i]] for i in order]

        def find(k: int) -> int:
            while head[k] != k:
                head[k] = head[head[k]]
                k = head[k]
            return k

        def pair(x: int, y: int, right: int) -> None:
            left = _common(before[x], before[y])
            if left + right >= length:
                for i in (x, y):
                    a = spans[i][1]
                    out[i].append((a - left, a + right - length))

        for right, k in lcp:  # decreasing: whatever is merged now agrees on so many bytes
            one, two = find(k), find(k + 1)
            if len(sets[one]) < len(sets[two]):
                one, two = two, one
            big = sets[one]
            for r in sets[two]:
                at = bisect_left(big, r)
                for near in big[max(0, at - 1) : at + 1]:  # who agrees most on what precedes
                    pair(by_rank[r], by_rank[near], right)
                insort(big, r)
            head[two] = one
            sets[two] = []
    return out


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive intervals joined where they overlap or touch."""
    out: list[list[int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with one key, in a partition sorted by it."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and run[0]["key"] != row["key"]:
                yield run[0]["key"], run
                run = []
            run.append(row)
    if run:
        yield run[0]["key"], run


def halved(width: int, length: int, gram: int):
    """Arrow function: spans ``id, rk, n, p, lo, off, body``, whose windows begin
    ``p`` to ``p + width - 1`` bytes before the anchor (at ``off`` in the body),
    to the pieces with the nearer and the farther half of these windows.
    ``key`` is the hash of the bytes that every window of a half holds, ``piece``
    that of the whole piece."""
    half = (width + 1) // 2

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, body, cols = [], [], ([], [], [], [], [], [])
                for k, (n, p, lo, off, span) in enumerate(zip(*(part.column(c).to_pylist() for c in range(2, 7)))):
                    least = off + length - len(span)
                    for start, end in ((p, p + half - 1), (p + half, p + width - 1)):
                        near, far = max(start, least), min(end, off)
                        if near > far:
                            continue
                        piece = span[off - far : off - near + length]
                        held = span[off - start : off + max(gram, length - end)]
                        row.append(k)
                        body.append(piece)
                        key = xxhash.xxh3_64_intdigest(held, start << 32 | half) - (1 << 63)
                        whole = xxhash.xxh3_64_intdigest(piece, far) - (1 << 63)
                        for c, x in zip(cols, (n, start, lo + off - far, far, key, whole)):
                            c.append(x)
                take = pa.array(row, pa.int32())
                n, start, lo, off, key, whole = (pa.array(c, pa.int64()) for c in cols)
                ids = [part.column(0).take(take), part.column(1).take(take)]
                yield pa.RecordBatch.from_arrays(
                    ids + [n, start, lo, off, pa.array(body, pa.binary()), key, whole], names=["id", "rk", "n", "p", "lo", "off", "body", "key", "piece"]
                )

    return split


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``id, rk, lo, hi``: starts of windows of the texts ``id, rk, text`` that
    also start elsewhere, as inclusive ranges."""
    kind = docs.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, cols = [], ([], [], [], [], [])
                for k, text in enumerate(part.column(2)):
                    body = text.as_py().encode("utf-8")
                    for a, lo, hi, key in anchors(body, length, gram):
                        row.append(k)
                        for c, x in zip(cols, (a, lo, hi, key, xxhash.xxh3_64_intdigest(body[lo : hi + length], a - lo) - (1 << 63))):
                            c.append(x)
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take)] + [pa.array(c, pa.int64()) for c in cols], names=["id", "rk", "a", "lo", "hi", "key", "span"]
                )

    spans = written(docs.select("id", "rk", "text").mapInArrow(find, f"id {kind}, rk long, a long, lo long, hi long, key long, span long"), "anchors")
    # grams that occur once end here; the counts are written, so that the join
    # is one of two plain shuffles and Spark can split a gram that very many have
    grams = spans.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("span") == F.max("span")).alias("alike")).where("n > 1")
    grams = written(grams.select("key", "alike"), "grams")
    shared = written(spans.join(grams, "key"), "shared")
    # different spans of a gram, each once, with how often it occurs
    unlike = shared.where("NOT alike").groupBy("key", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "rk", "a", "lo", "hi")).alias("at"))
    unlike = written(unlike, "unlike")
    whole = shared.where("alike").select("id", "rk", "lo", "hi").unionAll(
        shared.where("NOT alike").join(unlike.where("n > 1").select("key", "span"), ["key", "span"], "left_semi").select("id", "rk", "lo", "hi")
    )
    # the content of one of each
    places = unlike.groupBy(F.col("at.id").alias("pid"), F.col("at.rk").alias("prk")).agg(F.collect_list(F.struct("key", "n", F.col("at.a").alias("a"), F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"))).alias("places"))
    held = docs.join(places, F.col("id").eqNullSafe(F.col("pid")) & (F.col("rk") == F.col("prk"))).select("id", "rk", "text", "places")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                row, cols, body = [], ([], [], [], []), []
                for k, (text, places) in enumerate(zip(part.column(2), part.column(3))):
                    data = text.as_py().encode("utf-8")
                    for p in places.as_py():
                        row.append(k)
                        for c, x in zip(cols, (p["key"], p["n"], p["lo"], p["a"] - p["lo"])):
                            c.append(x)
                        body.append(data[p["lo"] : p["hi"] + length])
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take)] + [pa.array(c, pa.int64()) for c in cols] + [pa.array(body, pa.binary())], names=["id", "rk", "key", "n", "lo", "off", "body"])

    first = held.mapInArrow(read, f"id {kind}, rk long, key long, n long, lo long, off long, body binary").dropDuplicates(["id", "rk", "key", "lo"])
    content, width = written(first.withColumn("p", F.lit(0).cast("long")), "content"), length - gram + 1
    found, ordered = [whole], []
    while width > 1:
        sizes = content.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        large = written(sizes.where(F.col("size") > group).select("key"), "large")
        if large.isEmpty():
            break
        ordered.append(content.join(large, "key", "left_anti"))
        crowded = content.join(large, "key", "left_semi").select("id", "rk", "n", "p", "lo", "off", "body")
        halves = crowded.mapInArrow(halved(width, length, gram), f"id {kind}, rk long, n long, p long, lo long, off long, body binary, key long, piece long")
        pieces = written(halves, "pieces")
        width = (width + 1) // 2
        alike = pieces.groupBy("key", "piece").agg(F.sum("n").alias("n"), F.min(F.struct("id", "rk", "p", "lo", "off", "body")).alias("at"))
        content = written(alike.select("key", "piece", "n", "at.*"), "content")
        # spans that were single until here and have a piece that another has too
        again = pieces.where("n = 1").join(content.where("n > 1").select("key", "piece"), ["key", "piece"], "left_semi")
        found.append(again.select("id", "rk", "lo", (F.col("lo") + F.length("body") - length).alias("hi")))
    ordered.append(content)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = (id_type, pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["id", "rk", "lo", "hi"])

        id_type, rows = pa.null(), []

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in source:
                id_type = b.schema.field("id").type
                yield b

        for _, run in _collected(typed(batches)):
            if len(run) > 1:
                for r, found in zip(run, shared_windows([(r["body"], r["off"]) for r in run], length, gram)):
                    if r["n"] == 1:  # the others repeat as a whole
                        rows += [(r["id"], r["rk"], r["lo"] + lo, r["lo"] + hi) for lo, hi in merged(found)]
                if len(rows) > 10_000:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    out = f"id {kind}, rk long, lo long, hi long"
    for part in ordered:
        runs = part.select("id", "rk", "key", "n", "lo", "off", "body").repartition("key").sortWithinPartitions("key")
        found.append(runs.mapInArrow(order, out))
    return reduce(DataFrame.unionAll, found)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the
    remaining bytes) for every row: each byte of the UTF-8 text covered by a
    string of ``length`` bytes that also starts anywhere else is removed.

    NULL counts as empty; texts shorter than ``length`` are left as they are;
    rows that repeat are copies of each other and so removed, every one.  Other
    columns are dropped; an empty table gives an empty table.  Equal spans are
    told by two 64-bit hashes."""
    if not 0 < gram < length:
        raise ValueError("the gram must be shorter than the window")
    df = ids_and_text(docs, id_col, text_col).withColumn("rk", F.xxhash64("text"))
    ranges = repeated_windows(df, length, gram, group)
    ranges = ranges.groupBy(F.col("id").alias("rid"), F.col("rk").alias("rrk")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    both = df.join(ranges, F.col("id").eqNullSafe(F.col("rid")) & (F.col("rk") == F.col("rrk")), "left").select("id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for text, ranges in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode("utf-8")
                covered = merged([(r["lo"], r["hi"] + length - 1) for r in ranges.as_py() or ()])
                kept, at = [], 0
                for lo, hi in covered:
                    kept.append(data[at:lo])
                    at = hi + 1
                rest = b"".join(kept) + data[at:]
                for c, x in zip(cols, (len(data), len(data) - len(rest), len(covered), hashlib.sha256(rest).hexdigest(), rest if with_text else None)):
                    c.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, types)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = df.schema["id"].dataType.simpleString()
    out = both.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept")
