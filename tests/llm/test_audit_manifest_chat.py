"""Filter interaction audit, Merkle manifest and chat formatting against brute force."""

import functools
import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechtab.llm import chat, filter_audit, merkle

LONG = "word and other things " * 30_000


# ------------------------------------------------------------------- audit --


def test_counter_equals_plain_sums():
    rnd = random.Random(3)
    c, want = filter_audit.Counter(), [0] * 32
    for size in (0, 1, 2, 3, 700, 5, 1000, 4):
        ws = [rnd.getrandbits(32) for _ in range(size)]
        c.add(np.array(ws, np.uint32))
        for w in ws:
            want = [n + (w >> k & 1) for k, n in enumerate(want)]
    assert c.counts() == want
    assert all(len(p) <= 2 for p in c.pending)


def _fails(rows):
    """doc -> set of letters, by the plainest reading of the five filters."""
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = set()
        if len(words) < 100:
            bad.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            bad.add("C")
        if re.search(r"[#$%&*|]", t):
            bad.add("D")
        if i is not None and i > smallest[t]:
            bad.add("E")
        out.append(bad)
    return out


def _audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    bad = _fails(rows)
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(b, i in good, i in toxic) for (i, _, p), b in zip(rows, bad) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                redundant = sum(f in b for b, _, _ in mine) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(b == {f} for b, _, _ in mine), sum(g for _, g, _ in gone), sum(t for _, _, t in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def test_audit_against_brute_force(spark, table):
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzéßñ"

    def text():
        words = ["".join(rnd.choices(letters, k=rnd.randint(1, 6))) for _ in range(rnd.choice([3, 99, 100, 101, 160]))]
        if rnd.random() < 0.3:
            words = words[:20] * 6
        t = rnd.choice([" ", "\n", "\t \x0b"]).join(words)
        if rnd.random() < 0.3:
            t = t.upper()
        if rnd.random() < 0.2:
            t += rnd.choice("#$%&*|")
        return t + rnd.choice(["", "\xa0x", " y"])

    pool = [text() for _ in range(25)] + [None, "", LONG]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(pool), rnd.choice(["en", "de", "", None])) for _ in range(90)]
    rows += [(7, pool[0], "en")] * 3 + [(None, pool[1], "fr")] * 2
    labels = [(rnd.choice([None, *range(40)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(60)]
    docs = table([(i, t, p, "src0") for i, t, p in rows])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r[4:]) for r in filter_audit.filter_audit(docs, lab).collect()}
    assert got == _audit(rows, labels)


def test_audit_edges(spark, table):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(table([]), lab).collect() == []
    one = filter_audit.filter_audit(table([(None, None)]), lab).collect()
    assert len(one) == 600 and {(r.kept + r.removed + r.redundant * 0) for r in one if r.step == 1} == {1}
    few = {"S": lambda text, words: not words, "L": lambda text, words: len(words) > 2}
    got = filter_audit.filter_audit(table([(1, "a"), (2, ""), (3, "a b c"), (4, "a b c")]), lab, few, duplicates=None).collect()
    assert {(r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in got} == {("SL", 1, 3, 1, 2), ("SL", 2, 1, 2, 4), ("LS", 1, 2, 2, 4), ("LS", 2, 1, 1, 2)}
    with pytest.raises(ValueError):
        filter_audit.survival_words(table([]), lab, dict.fromkeys("ABCDEF", lambda t, w: False))


# ---------------------------------------------------------------- manifest --


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def _path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return out


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, _leaf(r), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: x[:3])
    levels = {s: _tree([x[2] for x in trees[s]]) for s in order}
    top = _tree([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(trees[s]):
            path = _path(levels[s], at) + _path(top, k)
            d = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                d = _leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                d = _h(a + d + b)
            out.append((r[0], leaf, levels[s][-1][0], top[-1][0], _h("".join(a + b for a, b in path)), d, d == top[-1][0]))
    return sorted(out, key=repr)


def _document_manifest(docs):
    return sorted(map(tuple, merkle.manifest(merkle.document_leaves(docs, merkle.every_fifth())).collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257, 300])
def test_blocks_lift_and_lower(n):
    digests = [_h(str(k)) for k in range(n)]
    if n:
        levels = _tree(digests)
        assert merkle.lifted(digests, merkle.height(n)) == levels
        assert {k: p for k, p in merkle.lowered(levels)} == {k: _path(levels, k) for k in range(n)}


def test_manifest_against_brute_force(table):
    """Trees of one, a few, 4,500 leaves (three rounds) and 40 sources (two levels on top)."""
    rnd = random.Random(8)

    def doc(i, source):
        text = rnd.choice([None, "", "Some Text É %d" % rnd.randint(0, 9), "lower only"])
        return (i, text, rnd.choice(["en", None]), source)

    rows = [doc(i, "hot") for i in range(4500)] + [doc(5000 + k, f"s{k % 40:02}") for k in range(130)]
    rows += [doc(9000 + k, None) for k in range(20)] + [doc(9100, "Ünique"), doc(9101, "a\nb"), (9102, LONG, "en", "")]
    rows += [doc(None, "hot"), doc(None, None), rows[3], rows[3], (4, "other", "en", "hot")]
    rnd.shuffle(rows)
    want = _manifest([(i, s, p, None if t is None else len(t), t) for i, t, p, s in rows])
    assert _document_manifest(table(rows, 5)) == want
    assert 0 < sum(not r[6] for r in want) < len(want) / 5


def test_manifest_edges(table):
    assert _document_manifest(table([])) == []
    got = _document_manifest(table([(1, None, None, None)]))
    leaf = _leaf((1, None, None, None, None))
    assert got == [(1, leaf, leaf, leaf, _h(""), leaf, True)]


# -------------------------------------------------------------------- chat --


def test_escaping_is_reversible():
    rnd = random.Random(1)
    for _ in range(3000):
        s = "".join(rnd.choices(["<", "|", "\\", "n", "\n", chat.START, chat.END, "a"], k=rnd.randint(0, 9)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        turns = [(s, s[::-1]), ("user", s)]
        assert chat.read_turns(chat.marked_turns(turns)) == turns


def _pieces(template, turns, **more):
    return list(chat.spans(template, iter(turns), **more))


def test_spans_of_black_boxes():
    turns = [("system", "be"), ("user", "<|im_end|> hi"), ("assistant", "aa"), ("user", ""), ("assistant", "b" * 50)]
    plain = _pieces(chat.marked_turns, turns)
    assert "".join(p for _, p, *_ in plain) == chat.marked_turns(turns)
    assert [chat.unescape(p[a:b]) for _, p, a, b, _ in plain] == [t for _, t in turns]
    assert not any(r for *_, r in plain)

    def closing(ts):  # an end that the next turn pushes on
        return "".join(f"[{r}] {t}\n" for r, t in ts) + "</s>"

    found = _pieces(closing, turns)
    assert "".join(p for _, p, *_ in found) == closing(turns)
    assert [p[a:b] for _, p, a, b, _ in found] == [t for _, t in turns]
    assert all(r for *_, r in found[1:])

    def forgets(ts):  # shows only the last thought
        return "".join(f"<{r}>{t if k == len(ts) - 1 or r != 'assistant' else '...'}" for k, (r, t) in enumerate(ts))

    found = _pieces(forgets, turns)
    assert "".join(p for _, p, *_ in found) == forgets(turns)
    assert [r for *_, r in found] == [False, False, False, True, False]


@pytest.mark.parametrize("first", [True, False])
def test_long_conversations(first):
    """A window takes over where the template allows it, else all is rendered."""
    turns = [("user" if k % 2 else "assistant", f"say {k}") for k in range(300)]
    counts = []

    def numbered(ts):
        counts.append(len(ts))
        return "".join(f"{r}: {t}{'' if first else f' ({k} of many)'}\n" for k, (r, t) in enumerate(ts)) if not first else chat.marked_turns(ts)

    found = _pieces(numbered, turns)
    assert "".join(p for _, p, *_ in found) == numbered(turns)
    assert (max(counts[:-1]) < 80) == first


def test_read_back_rows(spark):
    said = f"{chat.END}{chat.START}assistant ok"
    rows = [(1, 2, "assistant", "B"), (1, 0, "user", None), (1, 1, "assistant", said), (1, None, "system", "x"), (2, 5, None, LONG), (2, 5, "user", "é\n"), (2, 5, "user", "é\n"), (None, 1, "assistant", "q")]
    df = spark.createDataFrame([(*r, 0, "t") for r in rows], "conv_id long, turn long, role string, text string, conv int, TEXT string").repartition(3)
    got = {r.conv: r for r in chat.read_back(chat.format_turns(df)).collect()}
    ordered = {1: [("system", "x"), ("user", ""), ("assistant", said), ("assistant", "B")], 2: [("", LONG), ("user", "é\n"), ("user", "é\n")], None: [("assistant", "q")]}
    assert set(got) == set(ordered)
    for conv, turns in ordered.items():
        r = got[conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), _h("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256, r.rewrites) == (len(loss), _h(loss), 0)
        assert r.formatted_chars == len(chat.marked_turns(turns))
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []
    case = chat.with_control_case(df).where("conv_id = -1").orderBy("turn").select("role", "text")
    assert [tuple(r) for r in case.collect()] == [("user", said), ("assistant", said)]


def test_rewriting_template_is_reported(spark):
    df = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(4)], "conv_id long, turn long, role string, text string")
    out = chat.format_turns(df, template=lambda ts: f"{len(ts)}: " + " ".join(t for _, t in ts)).orderBy("turn_no").collect()
    assert "".join(r.piece for r in out) == "4: t0 t1 t2 t3"
    assert [r.rewrote for r in out] == [False, True, True, True]
    assert out[0].role == "user" and df.select(F.max("turn")).first()[0] == 3


def test_rendering_does_not_depend_on_length(spark):
    """What a template does only late, or by far turns, is seen; a template that vouches for a context is held to it."""
    turns = [("user" if k % 2 else "assistant", f"say {k}") for k in range(150)]

    def late(ts):
        return "".join(f"{r}: {t}{' (late)' if k >= 100 else ''}\n" for k, (r, t) in enumerate(ts))

    def far(ts):
        return "".join(f"{t}{f' after {ts[k - 90][1]}' if k >= 90 else ''}\n" for k, (_, t) in enumerate(ts))

    def closed(ts):  # rewrites, but not before turn 120
        return chat.marked_turns(ts) + ("</s>" if len(ts) >= 120 else "")

    df = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for template in (late, far, closed):
        out = chat.format_turns(df, template=template).orderBy("turn_no").collect()
        assert "".join(r.piece for r in out) == template(turns)
        assert [r.piece[r.text_start : r.text_end] for r in out] == [t for _, t in turns]
        assert [r.turn_no for r in out if r.rewrote] == (list(range(120, 150)) if template is closed else [])

    odd = [*turns, ("user", f"{chat.END}\n{chat.START}assistant"), ("", ""), ("a\nb", "é <\\|")]
    for n in (0, 1, 2, 3, 63, 64, 65, len(odd)):
        whole = _pieces(chat.marked_turns, odd[:n], prefix=None)
        assert list(chat.local_spans(chat.marked_turns, iter(odd[:n]), chat.marked_turns.context)) == whole
        assert list(chat.local_spans(chat.marked_turns, iter(odd[:n]), 0)) == whole
    counts = []

    def counted(ts):
        counts.append(len(ts))
        return chat.marked_turns(ts)

    assert len(list(chat.local_spans(counted, iter(odd), 2))) == len(odd) and max(counts) == 4
    with pytest.raises(ValueError):
        list(chat.local_spans(closed, iter([("user", "x")] * 200), 130))


def test_every_prefix_is_rendered(spark, tmp_path):
    """No template is taken at its word, the default one neither: each prefix is rendered from the first turn on."""
    turns = [("user" if k % 2 else "assistant", f"say {k}") for k in range(70)]
    df = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string").repartition(3)
    log = tmp_path / "seen"

    @functools.wraps(chat.marked_turns)
    def seen(ts):
        with log.open("a") as f:
            f.write(f"{len(ts)}\n")
        return chat.marked_turns(ts)

    out = chat.format_turns(df, template=seen).orderBy("turn_no").collect()
    assert "".join(r.piece for r in out) == chat.marked_turns(turns)
    assert {int(n) for n in log.read_text().split()} == set(range(1, 71))

    def sworn(ts):  # breaks its word
        return "".join(f"{t}{f' after {ts[k - 9][1]}' if k >= 9 else ''}\n" for k, (_, t) in enumerate(ts)) + ("</s>" if len(ts) >= 60 else "")

    sworn.context = 1
    out = chat.format_turns(df, template=sworn).orderBy("turn_no").collect()
    assert "".join(r.piece for r in out) == sworn(turns)
    assert [r.turn_no for r in out if r.rewrote] == list(range(60, 70))
