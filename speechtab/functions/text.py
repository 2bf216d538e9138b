"""Text expressions: prompt cleaning (STR2), basic normalisation (STR3),
word-level edit distance (STR4), tokens (STR5), segment names (STR6)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# White space and word characters of any script, spelled out so that every
# regex engine reads them alike.
SPACE = "[\\x09-\\x0D\\x1C-\\x20\\x85\\p{Z}]"
TOKEN = "([\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\x09-\\x0D\\x1C-\\x20\\x85\\p{Z}])"


def clean_prompt(text: Column) -> Column:
    """STR2: newlines become spaces, trailing whitespace removed."""
    return F.regexp_replace(F.regexp_replace(text, "\n", " "), SPACE + "+$", "")


def strip_both(text: Column) -> Column:
    """Both-side whitespace strip (before tokenising)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def basic_normalize(text: Column) -> Column:
    """STR3 basic rules: lower case; drop ``<...>`` / ``[...]`` spans and
    ``(...)`` spans; every mark, symbol or punctuation character becomes a
    space; whitespace runs become one space.  (Unicode NFKC folding, which
    the original applies first, has no Spark built-in and is not applied.)"""
    s = F.lower(text)
    # the bracket patterns only run on texts that hold an opening bracket
    has_open = (F.instr(s, "<") > 0) | (F.instr(s, "[") > 0)
    s = F.when(has_open, F.regexp_replace(s, "[<\\[][^>\\]]*[>\\]]", "")).otherwise(s)
    s = F.when(F.instr(s, "(") > 0, F.regexp_replace(s, "\\(([^)]+?)\\)", "")).otherwise(s)
    # marks, symbols and punctuation become spaces and whitespace runs one
    # space, in a single pass (lower-casing again in between changes nothing:
    # the text is already lower case)
    return F.regexp_replace(s, "[\\p{M}\\p{S}\\p{P}\\p{Z}\\x09-\\x0D\\x1C-\\x1F\\x85]+", " ")


def words(text: Column) -> Column:
    """Whitespace-separated words of a text (empty text -> empty array)."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def simple_tokens(text: Column) -> Column:
    """STR5 default tokeniser: runs of word characters and single other
    non-space characters.  A subword tokenizer plugs in through UDF1."""
    return F.regexp_extract_all(strip_both(text), F.lit(TOKEN), 1)


def count_tokens(text: Column) -> Column:
    """STR5 count only: how many tokens :func:`simple_tokens` would return,
    without building the token array."""
    return F.regexp_count(text, F.lit(TOKEN))


def segment_file_name(filename: Column, channel: Column, start: Column, end: Column) -> Column:
    """STR6: ``{file}_{channel}_segment_{start}_{end}.wav`` (floats as Python
    prints them, e.g. ``0.5``, ``2.0``)."""

    def num(c: Column) -> Column:
        s = c.cast("string")
        return F.when(F.instr(s, ".") == 0, F.concat(s, F.lit(".0"))).otherwise(s)

    return F.concat(filename, F.lit("_"), channel, F.lit("_segment_"), num(start), F.lit("_"), num(end), F.lit(".wav"))


# --- word-level edit distance ------------------------------------------------
# Bit-parallel edit distance (Myers 1999, in Hyyro's formulation): one
# machine-word-wide bitwise step per hypothesis word over the reference's
# position masks, so a pair costs about len(hyp) * len(ref) / 64 word
# operations.  Arbitrary-precision ints carry the bit vectors.  It runs on
# Arrow batches of one partition at a time; Spark spreads the rows.

def word_edits(ref_words: list, hyp_words: list) -> int:
    """Levenshtein distance between two word lists (unit costs)."""
    m = len(ref_words)
    if m == 0:
        return len(hyp_words)
    positions: dict = {}
    for i, w in enumerate(ref_words):
        positions[w] = positions.get(w, 0) | (1 << i)
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, dist = full, 0, m
    for w in hyp_words:
        eq = positions.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            dist += 1
        elif mh & top:
            dist -= 1
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return dist


def _split(text) -> list:
    """Words as :func:`words` splits them: Python's white space is the same set."""
    return text.split() if isinstance(text, str) else []


@F.pandas_udf(T.LongType())
def _text_edit_udf(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([word_edits(_split(r), _split(h)) for r, h in zip(ref, hyp)], dtype="int64")


_text_edit_once = _text_edit_udf.asNondeterministic()


def text_edit_distance(ref_text: Column, hyp_text: Column) -> Column:
    """STR4 on whole texts: word-level edit distance, words split on
    whitespace exactly as :func:`words` splits them (strings cross the Arrow
    boundary, which is more compact than word arrays)."""
    return _text_edit_once(ref_text, hyp_text)


@F.pandas_udf(T.LongType())
def _word_edit_udf(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    out = [
        word_edits(list(r) if r is not None else [], list(h) if h is not None else [])
        for r, h in zip(ref, hyp)
    ]
    return pd.Series(out, dtype="int64")


# Marked non-deterministic only so that Catalyst neither duplicates the call
# when collapsing projections nor pushes later filters below it.
_word_edit_once = _word_edit_udf.asNondeterministic()


def word_edit_distance(ref_words: Column, hyp_words: Column) -> Column:
    """STR4: word-level edit distance of two ``array<string>`` columns."""
    return _word_edit_once(ref_words, hyp_words)
