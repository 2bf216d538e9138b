"""Quality rules, token counts, toxicity, licences: per-row operators."""

import random
import re
import zlib

import pytest

from speechtab.llm import licenses, quality, tokens, toxicity
from speechtab.llm.queries import tokenizer_path

LONG = "word and other things " * 30_000


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = {}
    for i in range(len(w) - 7):
        wins.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for v in wins.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_matches_brute_force(table):
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "one", LONG, "é\xa0ü \x0b x|y\n\nx|y\nx|y"]
    for _ in range(150):
        texts.append("".join(rnd.choice(["a ", "b ", "the ", "c\n", "d\t", "#", "é "]) for _ in range(rnd.randint(0, 120))))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "two words")]
    out = quality.quality_rules(table(rows)).collect()
    got = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed) for r in out), key=repr)
    want = []
    for i, t in rows:
        b = brute_quality(t)
        want.append((i, b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    assert got == sorted(want, key=repr)
    assert not any(r.kept and r.base_failed for r in out)


def test_quality_keeps_rows_as_they_were(table):
    good = "The mixture of these words is plain and it says that the rules were met by all of them, as they should be.\nOne more line."
    df = table([(1, good), (2, "x $$$ %%%"), (None, good), (1, good), (3, None)])
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted((r[0] is None, r[1]) for r in kept.collect()) == [(False, good), (False, good), (True, good)]
    assert quality.keep_good(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality.quality_rules(df.drop("doc_id"))


def test_token_counts_match_the_library(table):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=model)
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "▁", "é", "😀", "<s>", "<unk>", "\x00", "\r", "\xa0", "中", "ing", "   ", "<0x0A>"]
    texts = [None, "", LONG, " ", "\n"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(2000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "twice"), (None, "twice")]
    out = tokens.token_counts(table(rows), model, limit=9).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in out)
    want = [(len((t or "").encode()), len(whole.encode(t)) if t else 0) for _, t in rows]
    assert got == sorted((i if i is not None else -1, b, n, n > 9) for (i, _), (b, n) in zip(rows, want))
    # a full cache or another frequent table changes nothing
    tiny = tokens.PieceCounter(model, {"the": 1}, cache=2)
    assert list(tiny.counts(t or "" for t in texts)) == [n for _, n in want[: len(texts)]]
    assert tokens.token_counts(table([(1, "x")]).limit(0), model).count() == 0


def test_factorization_machine_learns_a_meeting():
    """Two words that are harmless apart and toxic together: no sum of weights
    gets them right, a product of factors does."""
    rnd = random.Random(4)
    samples = []
    for _ in range(3000):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        words = [w for w, on in (("insult", a), ("group", b)) if on] + [f"w{rnd.randint(0, 50)}q" for _ in range(5)]
        ids = sorted({f for w in words for f in toxicity.features(w)})
        samples.append((toxicity.np.array(ids), int(a and b)))
    machine = toxicity.fit(samples, epochs=30)
    scores = list(machine.scores(["an insult", "a group", "an insult to a group", "nothing", ""]))
    assert scores[2] > 0.7 and max(scores[0], scores[1], scores[3], scores[4]) < 0.5


@pytest.mark.parametrize("rows", [2000, 20_000])
def test_rare_words_toxic_only_together(rows):
    """Two words of 2 % of the rows each, neither of which stands out by
    itself, and one that does."""
    rnd = random.Random(rows)
    samples = []
    for _ in range(rows):
        words = {f"w{rnd.randint(0, 3000):04}" for _ in range(80)}
        for w, share in (("groupterm", 0.02), ("oddword", 0.02), ("badword", 0.08)):
            if rnd.random() < share:
                words.add(w)
        if rnd.random() < 0.006:
            words |= {"groupterm", "oddword"}
        toxic = "badword" in words or {"groupterm", "oddword"} <= words
        samples.append((toxicity.np.array(sorted({f for w in words for f in toxicity.features(w)})), int(toxic)))
    machine = toxicity.fit(samples)
    both, one, other, bad, none = machine.scores(["an oddword w0001 groupterm", "oddword w0001", "groupterm w0002", "badword", "w0003 w0004"])
    assert both >= 0.7 and bad >= 0.7 and max(one, other, none) < 0.2


def test_chance_is_the_binomial_tail():
    hits, toxic = toxicity.np.array([5, 5, 10, 40]), toxicity.np.array([5, 3, 0, 10])
    from math import comb

    want = [sum(comb(h, k) * 0.1**k * 0.9 ** (h - k) for k in range(t, h + 1)) for h, t in zip(hits.tolist(), toxic.tolist())]
    assert toxicity.np.allclose(toxicity._chance(hits, toxic, 0.1), want)


def test_toxicity_rows(spark, table):
    rows = [(i, ("you vile person " if i % 3 == 0 else "a kind person ") + "of many plain words") for i in range(300)] + [(None, None), (7, ""), (7, ""), (9, LONG)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    df = table(rows)
    machine = toxicity.train(df, labels)
    out = toxicity.toxicity(df, machine)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows)
    for r in out.where("doc_id < 300 AND held_out AND doc_id NOT IN (7, 9)").collect():
        assert r.predicted == int(r.doc_id % 3 == 0)
    assert out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.toxicity(df.limit(0), machine).count() == 0
    none = toxicity.train(df, labels.limit(0))
    assert none.index == {} and 0 < next(none.scores([""])) < 1


def test_toxicity_learns_one_row_an_id(spark, table, monkeypatch):
    """Repeated document rows neither add samples nor push a label out."""
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:30]
    rows = [(i, f"you vile person {k}" if i == ids[0] else f"a kind person {k}") for i in ids for k in range(5)] + [(ids[1], "a kind person")] * 100
    labels = spark.createDataFrame([(i, int(i == ids[0])) for i in ids], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda samples, **how: seen.append(samples))
    toxicity.train(table(rows), labels, rows=30)
    assert [y for _, y in seen[0]] == [0] * 29 + [1]


def test_license_sql_knows_the_same_texts(table):
    import duckdb
    import pyarrow as pa

    rows = [(k, t + "\n") for k, (_, t) in enumerate(licenses.known_texts())] + [(-1, "GNU GENERAL PUBLIC LICENSE"), (None, None)]
    df = table(rows)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    con.execute(licenses.oracle_sql())
    want = sorted(con.fetchall(), key=repr)
    got = sorted((tuple(r) for r in licenses.license_scan(df).collect()), key=repr)
    assert got == want and sum(r[2] is not None for r in got) == len(rows) - 2


def test_license_digests(table):
    mit = dict(reversed(licenses.KNOWN))["MIT"]
    worn = "Copyright (c) 2020 Somebody\nCopyright 2021 <else>\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(". ", " .  ").replace('"', "'")
    rows = [(1, mit), (2, worn), (3, mit[:-30]), (4, "prose\nLicensed under CC BY-NC 4.0.\nmore"), (None, None), (5, ""), (5, ""), (6, LONG)]
    out = licenses.license_scan(table(rows)).collect()
    assert sorted((r.doc_id or 0, r.license_id, r.notices) for r in out if r.license_id or r.notices) == [(1, "MIT", ""), (2, "MIT", ""), (4, None, "CC-BY-NC-4.0")]
    assert len(out) == len(rows) and all(r.digest for r in out)
    assert licenses.license_scan(table([(1, "x")]).limit(0)).count() == 0


def test_license_full_texts_and_titles(table):
    mit = dict(reversed(licenses.KNOWN))["MIT"].removeprefix("MIT License\n\n")
    title = [mit, "The MIT License (MIT)\n\nCopyright (c) 2020 Somebody\n\n" + mit, "The MIT License\n" + mit]
    isc = dict(licenses.KNOWN)["ISC"]
    texts = dict(licenses.known_texts())
    whole = {i: (licenses.files(licenses.__package__) / "license_texts" / f"{i}.txt").read_text() for i in licenses.FILES}
    apache = whole["Apache-2.0"].split("APPENDIX")[0]
    rows = [("MIT", t) for t in title] + [("ISC", "ISC License\n\n" + isc)] + list(whole.items()) + [("Apache-2.0", apache), (None, apache[:-200]), (None, "MIT License")]
    out = licenses.license_scan(table([(k, t) for k, (_, t) in enumerate(rows)])).collect()
    assert {r.doc_id: r.license_id for r in out} == {k: i for k, (i, _) in enumerate(rows)}
    assert set(licenses.FILES) <= set(texts)
