"""Token counts with a two-tier map-side lookup.

A text is cut into pre-tokens at which the vocabulary can never merge across:
a run of spaces starts one, and a line feed is one.  A broadcast table holds
the token counts of frequent pre-tokens (tier one); a pre-token it lacks is
encoded once and remembered in the worker's bounded cache (tier two).  Counting
is therefore a map over documents: no pre-token is ever shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import ids_and_text

#: Rows whose pre-tokens choose the broadcast table.  The table only decides
#: what is looked up instead of encoded: counts are the same without it.
SAMPLE_ROWS = 4_000
#: Entries of the broadcast table and of each worker's cache.
FREQUENT = 50_000
CACHE = 400_000
#: Characters whose pre-tokens are looked up together.
BLOCK = 1 << 20

_UNIT = re.compile(r" +[^ ]*|[^ ]+")
_WORKER: dict = {}


class PieceCounter:
    """Token counts of whole texts for a SentencePiece BPE model without text
    normalisation, with a dummy space in front of a non-empty text."""

    def __init__(self, model_file: str, frequent: dict[str, int] | None = None, cache: int = CACHE):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        joins = [p.piece for p in model.pieces if p.type in (1, 4) and ("▁" in p.piece.lstrip("▁") or ("\n" in p.piece and p.piece != "\n"))]
        # else a merge could cross the cuts
        self.cuts = not joins and spec.name == "identity" and not spec.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.whole = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.prefix = spec.add_dummy_prefix
        spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.known = dict(frequent or {})
        self.room = len(self.known) + cache
        self.feed = len(self.bare.encode("\n"))

    def keys(self, text: str) -> list[str]:
        """The pre-tokens of a text: a word stands for itself after one space,
        ``"\\n" + word`` for itself at the start of a line, and ``"\\n\\n" + unit``
        for a unit of a line that has several spaces in a row.  Line feeds
        themselves are not among them."""
        if "▁" in text:  # the model's own sign for a space
            text = text.replace("▁", " ")
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            spaced = not k and self.prefix
            words = line.split(" ")
            if "" in words:
                out += ["\n\n" + u for u in _UNIT.findall(" " + line if spaced else line)]
                continue
            if not spaced:
                words[0] = "\n" + words[0]
            out += words
        return out

    @staticmethod
    def unit(key: str) -> str:
        """The pre-token that a key stands for."""
        if key.startswith("\n\n"):
            return key[2:]
        return key[1:] if key[:1] == "\n" else " " + key

    def counts(self, texts: Iterable[str]) -> Iterator[int]:
        """The number of tokens of each text, worked off in blocks of about
        ``BLOCK`` characters: what a block lacks is encoded in one call."""
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> Iterator[int]:
        if not self.cuts:
            yield from (len(self.whole.encode(t)) if t else 0 for t in texts)
            return
        keys = [self.keys(t) if t else [] for t in texts]
        known = self.known
        found = [list(map(known.get, row)) for row in keys]
        new = list({k for row, got in zip(keys, found) if None in got for k, n in zip(row, got) if n is None})
        fresh = dict(zip(new, map(len, self.bare.encode([self.unit(k) for k in new], num_threads=1))))
        room = self.room - len(known)
        if room > 0:
            known.update(fresh if len(fresh) <= room else dict(list(fresh.items())[:room]))
        for text, row, got in zip(texts, keys, found):
            if None in got:
                got = [fresh[k] if n is None else n for k, n in zip(row, got)]
            yield text.count("\n") * self.feed + sum(got)


def _counter(model_file: str, frequent: dict[str, int], key: str) -> PieceCounter:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = PieceCounter(model_file, frequent)
    return _WORKER[key]


def frequent_lengths(docs: DataFrame, model_file: str, text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_ROWS, entries: int = FREQUENT) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of ``rows`` documents:
    ``entries`` at most, each of 64 characters at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        counter = PieceCounter(model_file)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(u for u in counter.keys(text) if len(u) <= 64)
                if len(seen) > 20 * entries:
                    seen = Counter(dict(seen.most_common(10 * entries)))
        top = [u for u, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]]
        yield pa.RecordBatch.from_pydict({"unit": pa.array(top, pa.string()), "n": pa.array([len(counter.bare.encode(counter.unit(u))) for u in top], pa.int32())})

    # a hash picks about that many before limit(), which alone would shuffle as many of each split
    one_in = max(1, docs.count() // rows)
    some = ids_and_text(docs, id_col, text_col).where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).select("text").limit(rows).repartition(1)
    table = some.mapInArrow(count, "unit string, n int").toArrow()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    NULL and empty texts have 0 bytes and 0 tokens; texts are never cut off;
    rows that repeat are each counted; other columns are dropped; an empty
    table gives an empty table.  A model under which merges could cross the
    cuts is applied to whole texts instead."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_file, text_col, id_col))
    key = f"{model_file}:{uuid.uuid4().hex}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_file, frequent.value, key)
        for batch in batches:
            n = pa.array(counter.counts(t.as_py() for t in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=["id", "n_bytes", "n_tokens"])

    df = ids_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
