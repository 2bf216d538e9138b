"""Best-fit packing with swap-based local search.

Tokenising is a map over documents that leaves one small row per piece.  The
pieces are dealt out in blocks of a bounded number; each block is packed by
itself: best fit in decreasing order of length, then a local search that moves
pieces between underfull sequences, or exchanges one for one and two for one,
whenever that increases the sum of squared fills, until sequences run empty.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import ids_and_text, written

CAPACITY = 2048
#: Pieces packed together.  Sequences lost to block borders: about one a block.
BLOCK_PIECES = 32_768
#: Distinct words whose ids a worker remembers, and characters tokenised at once.
CACHE = 400_000
BLOCK_CHARS = 1 << 20

# White space as the pre-tokeniser sees it.  No pre-token holds white space
# after other characters, so a text may be cut wherever a run of it begins.
_WS = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: The fixed pattern of the byte-level pre-tokeniser.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORKER: dict = {}


class IdEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal
    to ``tokenizers`` on the whole text with ``add_special_tokens=False``."""

    def __init__(self, tokenizer_file: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _by_rank(tokenizer_file)
        self.known: dict[str, bytes] = {}
        self.room = cache

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        known = self.known
        units = [_UNIT.findall(t) for t in texts]
        found = [list(map(known.get, row)) for row in units]
        new = list({u for row, got in zip(units, found) if None in got for u, b in zip(row, got) if b is None})
        fresh = dict(zip(new, self._ids(new)))
        room = self.room - len(known)
        if room > 0:
            known.update(fresh if len(fresh) <= room else dict(list(fresh.items())[:room]))
        for row, got in zip(units, found):
            if None in got:
                got = [fresh[u] if b is None else b for u, b in zip(row, got)]
            yield b"".join(got)


    def _ids(self, units: list[str]) -> Iterator[bytes]:
        if self.ranked is None or any(s in u for s in self.special for u in units):
            rows: Iterable = (e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False))
        else:
            rows = map(self.ranked.encode_ordinary, units)
        return (struct.pack(f"<{len(ids)}I", *ids) for ids in rows)


def _by_rank(tokenizer_file: str):
    """The same encoder by merge ranks, some three times faster for a single
    word, where the file is a plain byte-level BPE whose ids follow its
    merges; otherwise None."""
    import tiktoken

    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model["type"] == "BPE"
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and not spec.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    )
    if not plain:
        return None
    # byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merged)) or len(ranks) != 256 + len(merged):
        return None
    return tiktoken.Encoding("words", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoder(tokenizer_file: str) -> IdEncoder:
    if tokenizer_file not in _WORKER:
        _WORKER.clear()
        _WORKER[tokenizer_file] = IdEncoder(tokenizer_file)
    return _WORKER[tokenizer_file]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: only what exceeds the
    capacity is cut, and only the first piece may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of every piece of every row; a
    document's ids end with ``end_id``, so an empty or NULL text is one token."""
    end = struct.pack("<I", end_id)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        for batch in batches:
            ids, rows = batch.column(0), ([], [], [], [], [])
            for i, body in enumerate(encoder.encode(t.as_py() for t in batch.column(1))):
                body += end
                for k, (start, length) in enumerate(cut(len(body) // 4, capacity)):
                    for column, value in zip(rows, (i, k, start, length, zlib.crc32(body[4 * start : 4 * (start + length)]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows[0], pa.int32())), pa.array(rows[1], pa.int32())] + [pa.array(c, pa.int64()) for c in rows[2:]],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    df = ids_and_text(docs, id_col, text_col)
    return df.mapInArrow(tokenise, f"id {df.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


#: Bins of up to so many pieces offer and give pairs of them; in fuller ones
#: pieces are so small that single ones do.
PAIRED = 48
#: Partners of one sum that are compared.
LOOKS = 8
#: Sums that are tried for what a bin gives, from the one that fills it down.
TRIED = 128
#: Underfull bins that exchange with each other.
TOGETHER = 256
#: Passes over the underfull bins.
PASSES = 40


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices by best fit in decreasing order (ties: input order)."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: a bin with room r exists
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= n
        if room:
            by_room[room].append(b)
            open_rooms |= 1 << room
    return bins


class _Index:
    """Exchange partners in the underfull bins: one or two pieces of a bin by
    the sum of their lengths.  Entries are checked when they are used, so a
    change only adds those that are new."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.where = lengths, {}
        self.sums: list[list[tuple[int, ...]]] = [[] for _ in range(capacity + 1)]
        self.there = 0  # bit s: some entry has sum s

    def add(self, k: int, bin_: list[int], new: list[int]) -> None:
        """Pieces ``new`` of bin ``k`` and their pairs with its other pieces."""
        for i in new:
            self.where[i] = k
        for i in new:
            self._put(self.lengths[i], (i,))
            if len(bin_) <= PAIRED:
                for j in bin_:
                    if j != i:
                        self._put(self.lengths[i] + self.lengths[j], (i, j))

    def _put(self, total: int, pieces: tuple[int, ...]) -> None:
        if total < len(self.sums):
            self.sums[total].append(pieces)
            self.there |= 1 << total

    def largest(self, most: int) -> int:
        """The largest sum of up to ``most`` that has entries, or 0."""
        return (self.there & ((2 << most) - 1)).bit_length() - 1 if most > 0 else 0

    def partners(self, total: int, not_in: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(bin, pieces) with that sum, from any bin but one; entries whose
        pieces have parted since go."""
        entries, kept, looked = self.sums[total], [], 0
        while entries and looked < LOOKS:
            pieces = entries.pop()
            k = self.where.get(pieces[0])
            if k is None or self.where.get(pieces[-1]) != k:
                continue
            kept.append(pieces)
            looked += 1
            if k != not_in:
                yield k, pieces
        entries.extend(kept)
        if not entries:
            self.there &= ~(1 << total)


def local_search(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY, passes: int = PASSES) -> list[list[int]]:
    """Exchange up to two pieces for up to two between underfull bins as long
    as the sum of squared fills grows, which empties bins; never more bins than
    before.

    A bin with room r gives none, one or two pieces of sum y and takes one or
    two of another bin, found by sum: y + r, which fills it, or else the largest
    sum below with which it becomes fuller than the other bin was.  Of partners
    with one sum that in the least filled bin is taken.  The search ends at
    the least possible number of bins, after a pass over the underfull bins
    without an exchange, or after ``passes``.

    ``TOGETHER`` underfull bins at a time exchange with each other (every
    n-th by fill, so that all parts hold full and less full ones), which makes
    the work grow with the number of bins; the bins that are underfull after
    that are dealt anew, as long as a round empties any."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    done = [b for b, f in zip(bins, fill) if f == capacity]
    under = [b for b, f in sorted(zip(bins, fill), key=lambda x: -x[1]) if 0 < f < capacity]
    least = -(-sum(fill) // capacity)
    while under and len(done) + len(under) > least:
        before, parts = len(under), -(-len(under) // TOGETHER)
        out = [x for k in range(parts) for x in _exchanged(under[k::parts], lengths, capacity, passes)]
        done += [b for f, b in out if f == capacity]
        under = [b for f, b in sorted(out, key=lambda x: -x[0]) if f < capacity]
        if parts == 1 or len(under) + sum(f == capacity for f, _ in out) == before:
            break
    return done + under


def _exchanged(bins: list[list[int]], lengths: list[int], capacity: int, passes: int) -> list[tuple[int, list[int]]]:
    """(fill, bin) of what exchanges among ``bins`` leave."""
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    count = len(bins)
    if count <= least:
        return list(zip(fill, bins))
    index = _Index(lengths, capacity)
    for k, b in enumerate(bins):
        if fill[k] < capacity:
            index.add(k, b, list(b))

    def exchange(k: int) -> bool:
        """The best exchange that makes bin ``k`` fuller, if there is one."""
        b, room = bins[k], capacity - fill[k]
        gives: dict[int, tuple[int, ...]] = {0: ()}
        for x, i in enumerate(b):
            gives.setdefault(lengths[i], (i,))
            if len(b) <= PAIRED:
                for j in b[:x]:
                    gives.setdefault(lengths[i] + lengths[j], (i, j))
        best: tuple[int, int, tuple, tuple] | None = None
        for y, out in gives.items():
            total, tried = index.largest(min(y + room, capacity)), 0
            while total > y and tried < TRIED and (best is None or total - y > best[0]):
                tried += 1
                found = [(fill[a], a, taken) for a, taken in index.partners(total, k) if fill[k] + total - y > fill[a]]
                if found:
                    _, a, taken = min(found)
                    best = (total - y, a, taken, out)
                    break
                total = index.largest(total - 1)
            if best and best[0] == room:
                break
        if best is None:
            return False
        gain, a, taken, out = best
        for i in taken:
            bins[a].remove(i)
        for i in out:
            b.remove(i)
        b.extend(taken)
        bins[a].extend(out)
        fill[k] += gain
        fill[a] -= gain
        if fill[k] == capacity:  # full bins take no more part
            for i in b:
                index.where.pop(i, None)
        else:
            index.add(k, b, list(taken))
        index.add(a, bins[a], list(out))
        return True

    for _ in range(passes):
        changed = False
        for k in sorted((k for k, f in enumerate(fill) if 0 < f < capacity), key=lambda k: -fill[k]):
            while 0 < fill[k] < capacity and exchange(k):
                changed = True
        count = sum(1 for f in fill if f)
        if not changed or count <= least:
            break
    return [(f, b) for f, b in zip(fill, bins) if f]


def pack_pieces(table: DataFrame, capacity: int = CAPACITY, block: int = BLOCK_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces.

    Rows are dealt round-robin, so equal documents or lengths never meet in
    one task; a task packs ``block`` rows at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, held
            rows = pa.Table.from_batches(held).combine_chunks()
            held = []
            lengths = rows.column("length").to_pylist()
            where, sequence, offset = [], [], []
            for b in local_search(best_fit(lengths, capacity), lengths, capacity):
                at = 0
                for i in b:
                    where.append(i)
                    sequence.append(base)
                    offset.append(at)
                    at += lengths[i]
                base += 1
            out = rows.take(pa.array(where, pa.int64()))
            out = out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            yield from out.to_batches()

        for batch in batches:
            while batch.num_rows:
                n = block - sum(b.num_rows for b in held)
                held.append(batch.slice(0, n))
                batch = batch.slice(n)
                if sum(b.num_rows for b in held) == block:
                    yield from flush()
        if held:
            yield from flush()

    n = max(1, math.ceil(table.count() / block))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.repartition(n).mapInArrow(pack, f"{kind}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset`` of every
    piece.

    NULL and empty texts are a document of the end token alone; rows that
    repeat are packed each; NULL ids stay NULL; other columns are dropped; an
    empty table gives an empty table."""
    table = written(pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col), "pieces")
    return pack_pieces(table, capacity).withColumnRenamed("id", id_col)
