"""Merkle dataset manifest by time-forward processing.

The nodes of the hash trees have labels that ascend in the order in which they
can be computed: the last leaf below a node, then its level.  A node's digest
is a message to its parent, kept in a priority queue ordered by label until the
parent's turn comes; at any time at most one unfinished run of each level
waits.  A second sweep, in descending order, hands each node the proof suffix
of its parent, to which it adds its own siblings.

A tree is cut into blocks of ``ARITY ** LEVELS`` neighbouring leaves.  Inside a
block the queue is a heap; what passes between blocks (a block's digest on the
way up, its proof suffix on the way down) are rows that Spark shuffles and
sorts by the label of the block they are for, on disk where need be.  Each
round leaves one row of 256, and the number of rounds grows with the
logarithm of the largest tree."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtab.llm.common import pick, written

ARITY = 16
#: Levels of a tree that one block holds: 256 leaves.
LEVELS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hex(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    up = 0
    while ARITY**up < n:
        up += 1
    return up


def lifted(digests: Sequence[str], up: int) -> list[list[str]]:
    """The nodes of ``up`` levels over a block's leaves, level by level:
    digests travel to their parents through a queue ordered by label."""
    nodes: list[list[str]] = [[] for _ in range(up + 1)]
    queue: list[tuple[int, int, int, str]] = []

    def done(level: int, index: int, digest: str) -> None:
        nodes[level].append(digest)
        if level < up:
            parent = index // ARITY
            last = min((parent + 1) * ARITY ** (level + 1), len(digests)) - 1
            heapq.heappush(queue, (last, level + 1, index, digest))

    for leaf, digest in enumerate(digests):
        done(0, leaf, digest)
        while queue and queue[0][0] == leaf:
            last, level, index, _ = queue[0]
            run = []
            while queue and queue[0][:2] == (last, level):
                run.append(heapq.heappop(queue)[3])
            done(level, index // ARITY, _hex("".join(run)))
    return nodes


def lowered(nodes: list[list[str]]) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """For each leaf of a block its siblings to the left and right, level by
    level: suffixes travel down in descending order of label."""
    up, n = len(nodes) - 1, len(nodes[0])
    queue: list[tuple[int, int, int, list]] = [(-(n - 1), -up, 0, [])]
    while queue:
        _, level, index, suffix = heapq.heappop(queue)
        level = -level
        if level == 0:
            yield index, suffix
            continue
        first = index * ARITY
        run = "".join(nodes[level - 1][first : first + ARITY])
        for j in range(len(run) // 64):
            own = [(run[: 64 * j], run[64 * j + 64 :]), *suffix]
            last = min((first + j + 1) * ARITY ** (level - 1), n) - 1
            heapq.heappush(queue, (-last, 1 - level, first + j, own))


def _numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` (a written table with a column ``tree``) with ``rank``, a row's
    place (from 0) in its tree by ``order``, and ``n``, the tree's rows.  Rows
    are sorted by range, so that a large tree lies in many tasks; each numbers
    its own and the sums before it are added."""
    names = [f.name for f in df.schema.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, at = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(names.index("tree")).dictionary_encode("encode")
            code = tree.indices.to_numpy(zero_copy_only=False)
            place = np.arange(len(code), dtype=np.int64)
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            place -= np.repeat(starts, np.diff(np.r_[starts, len(code)]))
            if (tree.dictionary[int(code[0])].as_py(),) == last:
                place[: starts[1] if len(starts) > 1 else len(code)] += at
            last, at = (tree.dictionary[int(code[-1])].as_py(),), int(place[-1]) + 1
            columns = [*batch.columns, pa.array(np.full(len(code), task, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "part", "local"])

    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])
    by = ["tree", *order]
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(count, schema), "numbered")
    sizes = rows.groupBy("tree", "part").agg(F.max("local").alias("most"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("tree").alias("t"),
        F.col("part").alias("p"),
        F.coalesce(F.sum(F.col("most") + 1).over(earlier), F.lit(0)).alias("before"),
        F.sum(F.col("most") + 1).over(Window.partitionBy("tree")).alias("n"),
    )
    out = rows.join(written(sizes, "sizes"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return out.select(*names, (F.col("local") + F.col("before")).alias("rank"), "n")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block, which lie side by side."""
    block: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if block and (row["tree"], row["block"]) != (block[0]["tree"], block[0]["block"]):
                yield block
                block = []
            block.append(row)
    if block:
        yield block


def _with_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("rank") / F.lit(ARITY**LEVELS)))


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _up(nodes: DataFrame) -> DataFrame:
    """One round up: ``tree, rank, digest, n`` of the blocks' topmost nodes."""
    kind = {f.name: f.dataType for f in nodes.schema.fields}["tree"]
    arrow = pa.schema([("tree", pa.string() if isinstance(kind, T.StringType) else pa.int64()), ("rank", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tops() -> Iterator[dict]:
            for block in _blocks(batches):
                n = block[0]["n"]
                top = lifted([r["digest"] for r in block], min(LEVELS, height(n)))[-1][0]
                yield {"tree": block[0]["tree"], "rank": block[0]["block"], "digest": top, "n": -(-n // ARITY**LEVELS)}

        return _batches(tops(), arrow)

    rows = _with_blocks(nodes.select("tree", "rank", "digest", "n")).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
    return rows.mapInArrow(lift, T.StructType([T.StructField("tree", kind), T.StructField("rank", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("n", T.LongType())]))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the rounds above them, the last of one node a tree.  A
    tree that is down to one node is in no later round."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(written(_up(rounds[-1].where("n > 1")), "round"))
    return rounds


_PROOF = "lefts array<string>, rights array<string>, subroot string, root string"
_PROOF_COLUMNS = ["lefts", "rights", "subroot", "root"]
_TEXTS = pa.list_(pa.string())


def _meet(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes and the messages (``tree, block`` and a proof) of their blocks in
    the order of their labels, a message before the nodes it is for."""
    rows = _with_blocks(nodes)
    for c, kind in (f.split() for f in _PROOF.split(", ")):
        rows = rows.withColumn(c, F.lit(None).cast(kind))
    told = messages
    for f in rows.schema.fields:
        if f.name not in messages.columns:
            told = told.withColumn(f.name, F.lit(-1).cast(f.dataType) if f.name == "rank" else F.lit(None).cast(f.dataType))
    return rows.unionByName(told).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")


def _down(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """One round down: the messages of the blocks below, one for each node."""
    kind = {f.name: f.dataType for f in nodes.schema.fields}["tree"]
    arrow = pa.schema([("tree", pa.string() if isinstance(kind, T.StringType) else pa.int64()), ("block", pa.int64()), ("lefts", _TEXTS), ("rights", _TEXTS), ("subroot", pa.string()), ("root", pa.string())])

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[dict]:
            for message, *block in _blocks(batches):
                nodes = lifted([r["digest"] for r in block], min(LEVELS, height(block[0]["n"])))
                for index, own in lowered(nodes):
                    yield {
                        "tree": message["tree"],
                        "block": block[index]["rank"],
                        "lefts": [a for a, _ in own] + message["lefts"],
                        "rights": [b for _, b in own] + message["rights"],
                        "subroot": message["subroot"],
                        "root": message["root"],
                    }

        return _batches(told(), arrow, 512)

    schema = T.StructType([T.StructField("tree", kind), T.StructField("block", T.LongType()), *T._parse_datatype_string(_PROOF).fields])
    return _meet(nodes.select("tree", "rank", "digest", "n"), messages).mapInArrow(lower, schema)


def _sent_down(rounds: list[DataFrame], finished: DataFrame) -> DataFrame:
    """The messages for the blocks of the lowest round; ``finished`` has those
    of the trees' last nodes (``tree, round``, a proof)."""
    told = None
    for k in range(len(rounds) - 1, -1, -1):
        now = finished.where(F.col("round") == k).select("tree", F.lit(0).cast("long").alias("block"), *_PROOF_COLUMNS)
        told = now if told is None else now.unionByName(written(_down(rounds[k + 1], told), "told"))
    return told


def _last_nodes(rounds: list[DataFrame]) -> DataFrame:
    """``tree, digest, round``: each tree's only node of its last round."""
    out = None
    for k, nodes in enumerate(rounds):
        one = nodes.where("n = 1").select("tree", "digest", F.lit(k).alias("round"))
        out = one if out is None else out.unionAll(one)
    return out


_RESULT = pa.schema([(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")] + [("verified", pa.bool_())])


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each leaf: its proof's digest, and the root folded from the
    claimed leaf."""
    schema = None

    def rows(first: pa.RecordBatch) -> Iterator[dict]:
        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for message, *block in _blocks(all_batches()):
            above = list(zip(message["lefts"], message["rights"]))
            nodes = lifted([r["digest"] for r in block], min(LEVELS, height(block[0]["n"])))
            tail: dict[int, bytes] = {}  # of the proofs of one run, which ends alike
            for index, own in lowered(nodes):
                run = index // ARITY
                if run not in tail:
                    tail = {run: "".join(a + b for a, b in own[1:] + above).encode()}
                proof = sha256("".join(own[0]).encode() if own else b"")
                proof.update(tail[run])
                row = block[index]
                folded = row["claimed"]
                for a, b in own + above:
                    folded = _hex(a + folded + b)
                yield {
                    "id": row["id"],
                    "leaf": row["digest"],
                    "subroot": message["subroot"],
                    "root": message["root"],
                    "proof_sha256": proof.hexdigest(),
                    "folded_root": folded,
                    "verified": folded == message["root"],
                }

    for first in batches:
        if first.num_rows:
            schema = schema or pa.schema([first.schema.field("id"), *_RESULT])
            yield from _batches(rows(first), schema)


def manifest(leaves: DataFrame) -> DataFrame:
    """For each row of ``leaves`` (``id, tree, digest, claimed``): ``id, leaf,
    subroot, root, proof_sha256, folded_root, verified``.

    A tree's leaves ascend by id, NULL first, and by digest where ids are
    equal (equal digests change places without effect); 16 neighbours at a
    time become a node until one is left, the subroot.  Subroots, ordered by
    tree (NULL first, then bytewise), become the root alike.  The proof is all
    siblings on the way up; ``folded_root`` follows it from the ``claimed``
    digest.  No leaves give no rows."""
    tree_kind = {f.name: f.dataType for f in leaves.schema.fields}["tree"]
    if not isinstance(tree_kind, T.StringType):
        raise ValueError(f"tree is {tree_kind.simpleString()}, not string")
    rows = written(leaves.select("id", "tree", "digest", "claimed").withColumn("row", F.monotonically_increasing_id()), "leaves")
    rows = written(_numbered(rows, ["id", "digest", "row"]).drop("row"), "ranked")
    rounds = _rounds(rows.select("tree", "rank", "digest", "n"))
    ends = written(_last_nodes(rounds), "subroots")

    # the same over the subroots: one tree
    tops = written(_numbered(ends.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("source"), "digest", "round"), ["source"]), "tops")
    top_rounds = _rounds(tops.select("tree", "rank", "digest", "n"))
    root = _last_nodes(top_rounds)
    none = F.array().cast("array<string>")
    start = root.select("tree", "round", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    told = _down(top_rounds[0], _sent_down(top_rounds, start)).withColumnRenamed("block", "rank").drop("tree", "subroot")
    finished = tops.join(told, "rank").select(F.col("source").alias("tree"), "round", "lefts", "rights", F.col("digest").alias("subroot"), "root")

    told = _sent_down(rounds, written(finished, "finished"))
    id_field = rows.schema["id"]
    schema = T.StructType([id_field, *[T.StructField(f.name, T.BooleanType() if f.name == "verified" else T.StringType()) for f in _RESULT]])
    return _meet(rows, told).mapInArrow(_proved, schema)


def encoded(values: Sequence[Column]) -> Column:
    """The bytes a leaf's digest is taken of: each value as ``-`` if NULL, else
    its UTF-8 byte count, a colon and the value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.concat(*parts)


def lower_case(text: Column) -> Column:
    """``text`` with A-Z alone in lower case."""
    return F.translate(text, UPPER, LOWER)


def document_leaves(docs: DataFrame, tampered: Column, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", others: Sequence[str] = ("lang", "n_chars")) -> DataFrame:
    """``id, tree, digest, claimed`` of documents: a leaf is the digest of id,
    source, the ``others`` and the text; where ``tampered`` (a condition on
    ``id``) holds, the claimed leaf is that of the text in lower case.  Texts
    are whole and are not shuffled; NULLs count as such; rows that repeat are
    leaves each; other columns are not looked at."""
    rows = pick(docs, id=id_col, tree=source_col, text=text_col, **{f"o{i}": c for i, c in enumerate(others)})
    rest = [F.col(f"o{i}") for i in range(len(others))]

    def digest(text: Column) -> Column:
        return F.sha2(encoded([F.col("id"), F.col("tree"), *rest, text]), 256)

    out = rows.select("id", F.col("tree").cast("string").alias("tree"), digest(F.col("text")).alias("digest"), F.when(F.coalesce(tampered, F.lit(False)), digest(lower_case(F.col("text")))).alias("other"))
    return out.select("id", "tree", "digest", F.coalesce("other", "digest").alias("claimed"))


def every_fifth() -> Column:
    """Whether a row's proof is checked against a changed text."""
    return F.crc32(F.col("id").cast("string")) % 5 == 0


def oracle_sql(source_levels: int = 6, top_levels: int = 3) -> str:
    """DuckDB SQL for the manifest of ``documents``, of up to 16**6 rows a
    source and 16**3 sources."""
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(t: str) -> str:
        parts = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", t]
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen({p}) AS VARCHAR) || ':' || {p}, '-')" for p in parts) + ")"

    bits = "flatten(list_transform(CAST(range(1, length(s) + 1) AS BIGINT[]), lambda i: [CAST(ascii(s[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    ctes = [
        f"d AS (SELECT row_number() OVER () AS row, doc_id, source, {leaf('text')} AS leaf, {leaf(text)} AS low, CAST(doc_id AS VARCHAR) AS s FROM documents)",
        f"c AS (SELECT row, doc_id, source, leaf, low, xor(list_reduce(list_concat([4294967295], {bits}), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) AS crc FROM d)",
        "s0 AS (SELECT row, coalesce('=' || source, '') AS tree, leaf AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM c)",
    ]

    def sides(table: str, name: str) -> str:
        run = "PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN"
        return (
            f"{name} AS (SELECT *, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {table})"
        )

    def climb(prefix: str, levels: int) -> None:
        for k in range(levels):
            ctes.append(sides(f"{prefix}{k}", f"{prefix}x{k}"))
            ctes.append(
                f"{prefix}{k + 1} AS (SELECT tree, idx // 16 AS idx, CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE min(digest) END AS digest, "
                f"CAST(ceil(max(n) / 16.0) AS BIGINT) AS n FROM {prefix}{k} GROUP BY tree, idx // 16)"
            )

    climb("s", source_levels)
    ctes.append(f"t0 AS (SELECT 0 AS tree, tree AS source, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM s{source_levels})")
    climb("t", top_levels)
    ctes.append("p0 AS (SELECT c.row, c.doc_id, c.leaf, coalesce('=' || c.source, '') AS tree, s0.idx, '' AS proof, CASE WHEN crc % 5 = 0 THEN low ELSE leaf END AS fold FROM c JOIN s0 USING (row))")
    step = "proof || l || r AS proof, CASE WHEN n > 1 THEN sha256(l || fold || r) ELSE fold END AS fold"
    for k in range(source_levels):
        ctes.append(f"p{k + 1} AS (SELECT p.row, doc_id, leaf, p.tree, p.idx // 16 AS idx, {step} FROM p{k} p JOIN sx{k} x ON x.tree = p.tree AND x.idx = p.idx)")
    ctes.append(f"q0 AS (SELECT p.doc_id, p.leaf, t0.digest AS subroot, t0.idx AS idx, proof, fold FROM p{source_levels} p JOIN t0 ON t0.source = p.tree)")
    for k in range(top_levels):
        ctes.append(f"q{k + 1} AS (SELECT doc_id, leaf, subroot, p.idx // 16 AS idx, {step} FROM q{k} p JOIN tx{k} x ON x.idx = p.idx)")
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"\nSELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.digest AS verified FROM q{top_levels}, t{top_levels} t"
    )
