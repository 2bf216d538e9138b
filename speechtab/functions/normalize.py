"""Text normalisation by language (STR3): compatibility folding, the basic
rules, and the English ones (contractions, titles, numbers), chosen per row.

Each language's rules are a table of patterns and replacements that becomes one
expression.  Compatibility folding is Unicode's NFKC, for which Spark has no
built-in: texts that hold a character it may change (found by a native pattern)
go through Python in Arrow batches, all others stay where they are.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Mapping
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import basic_normalize

# --- fixed values ------------------------------------------------------------
HESITATIONS = ["hmm", "mm", "mhm", "mmm", "uh", "um"]
#: Whole words.
WORDS = {
    "won't": "will not",
    "can't": "can not",
    "let's": "let us",
    "ain't": "aint",
    "y'all": "you all",
    "wanna": "want to",
    "gotta": "got to",
    "gonna": "going to",
    "woulda": "would have",
    "coulda": "could have",
    "shoulda": "should have",
    "ma'am": "madam",
    "mr": "mister",
    "mrs": "missus",
    "dr": "doctor",
    "prof": "professor",
    "capt": "captain",
    "gen": "general",
    "sen": "senator",
    "rev": "reverend",
    "jr": "junior",
    "sr": "senior",
}
#: Word ends, in this order.
ENDS = {"n't": " not", "'re": " are", "'s": " is", "'d": " would", "'ll": " will", "'t": " not", "'ve": " have", "'m": " am"}
UNITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9}
# -----------------------------------------------------------------------------

_MARKS = "\\p{M}\\p{P}\\p{S}\\p{Z}\\x09-\\x0D\\x1C-\\x1F\\x85"
NUMBERS = {w: i for i, w in enumerate(UNITS)} | {w: 10 * i for i, w in enumerate(TENS, 2)} | SCALES


def _char_class(ranges: list[list[int]]) -> str:
    """A character class of ``ranges`` (sorted, apart) as a tree of halves, each
    behind its bounds: a character is held against a few bounds, and one outside
    of them all (plain letters) against one, where a flat class of many ranges
    holds it against every one."""
    whole = f"\\x{{{ranges[0][0]:X}}}-\\x{{{ranges[-1][1]:X}}}"
    if len(ranges) == 1:
        return f"[{whole}]"
    half = len(ranges) // 2
    return f"[{whole}&&[{_char_class(ranges[:half])}{_char_class(ranges[half:])}]]"


@cache
def _folded_class() -> str:
    """A character class of all characters that NFKC may change: those it maps
    to others, and those that may join the one before."""
    hit = []
    for c in range(0x80, 0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if unicodedata.combining(ch) or 0x1161 <= c <= 0x11C2 or unicodedata.normalize("NFKC", ch) != ch:
            hit.append(c)
    ranges: list[list[int]] = []
    for c in hit:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return _char_class(ranges)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def compatibility_fold(text: Column) -> Column:
    """``text`` in Unicode's NFKC form: full-width letters, ligatures, circled
    numbers and the like become plain ones, letters and accents one character."""
    return F.coalesce(_nfkc(F.when(text.rlike(_folded_class()), text)), text)


def _any_of(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _numbers_to_digits(text: Column) -> Column:
    """Runs of number words as digits, in a text of single spaces: ``three
    hundred twenty one`` is 321, and a word that cannot go on with the number
    before it starts one (``twenty thirty`` is 20 30)."""
    word = _any_of(list(NUMBERS))
    values = F.from_json(F.lit("{" + ", ".join(f'"{w}": {n}' for w, n in NUMBERS.items()) + "}"), "map<string,bigint>")
    begins = f"(?<!\\S)(?=(?:{word})(?!\\S))" + "".join(f"(?<!(?<!\\S){w} )" for w in NUMBERS)

    def digits(part: Column) -> Column:
        run = F.regexp_extract(part, f"^(?:{word}(?: |$))+", 0)
        rest = F.substr(part, F.length(run) + 1)
        start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("now"))

        def step(acc: Column, w: Column) -> Column:
            n = F.element_at(values, w)
            now, total = acc["now"], acc["total"]
            after_scale = (now == 0) & (total > 0)
            free = F.when(now.isNull(), True).when(n < 10, after_scale | ((now > 0) & (now % 10 == 0) & ((now % 100 >= 20) | (now % 100 == 0)))).when(n < 100, after_scale | ((now > 0) & (now % 100 == 0)))
            grows = F.when(n < 100, free).when(n == 100, now.between(1, 99)).otherwise((now > 0) & ((total == 0) | (total >= n * 1000)))
            grows = F.coalesce(grows, F.lit(False))
            value = total + F.coalesce(now, F.lit(0))
            return F.struct(
                F.when(grows | (now.isNull() & (total == 0)), acc["done"]).otherwise(F.concat(acc["done"], F.array(value))).alias("done"),
                F.when(grows & (n > 100), total + now * n).when(grows, total).otherwise(F.lit(0)).alias("total"),
                F.when(grows & (n < 100), F.coalesce(now, F.lit(0)) + n).when(grows & (n == 100), now * 100).when(grows, F.lit(0)).otherwise(n).alias("now"),
            )

        found = F.aggregate(F.split(F.rtrim(run), " "), start, step, lambda acc: F.concat(acc["done"], F.array(acc["total"] + F.coalesce(acc["now"], F.lit(0)))))
        shown = F.concat(F.array_join(found.cast("array<string>"), " "), F.when(run.endswith(" "), " ").otherwise(""))
        return F.when(run == "", part).otherwise(F.concat(shown, rest))

    return F.array_join(F.transform(F.split(text, begins), digits), "")


def english_normalize(text: Column) -> Column:
    """English rules: lower case; drop ``<...>``, ``[...]`` and ``(...)``
    spans and hesitations; write contractions and titles out; no commas inside
    numbers, points only there; other marks, symbols and punctuation (but the
    per cent sign and currencies) become spaces; number words become digits;
    single spaces, none at the ends."""
    s = F.lower(text)
    s = F.regexp_replace(s, "[<\\[][^>\\]]*[>\\]]", "")
    s = F.regexp_replace(s, "\\(([^)]+?)\\)", "")
    s = F.regexp_replace(s, "\\s*[‘’']", "'")
    s = F.regexp_replace(s, "(?<=\\d),(?=\\d)", "")
    s = F.regexp_replace(s, "\\.(?!\\d)|(?<!\\d)\\.", " ")
    s = F.regexp_replace(s, f"[{_MARKS}&&[^'.%\\p{{Sc}}]]+", " ")
    full = F.from_json(F.lit(json.dumps(WORDS | dict.fromkeys(HESITATIONS, ""))), "map<string,string>")
    s = F.array_join(F.transform(F.split(s, " "), lambda w: F.coalesce(F.element_at(full, w), w)), " ")
    for end, word in ENDS.items():
        s = F.regexp_replace(s, f"{end}\\b", word)
    return _numbers_to_digits(F.trim(F.regexp_replace(s, "[' ]+", " ")))


#: Language -> its rules; languages without any get the basic ones.
RULES = {"en": english_normalize, "english": english_normalize}


def normalize_by_language(text: Column, language: Column, rules: Mapping[str, object] = RULES, fold: bool = True) -> Column:
    """STR3: ``text`` by the rules of its row's language (a NULL or any other
    language: the basic rules, trimmed), after compatibility folding unless
    ``fold`` is off.  A NULL text stays NULL."""
    s = compatibility_fold(text) if fold else text
    out = F.trim(basic_normalize(s))
    by_rule: dict = {}
    for lang, rule in rules.items():
        by_rule.setdefault(rule, []).append(lang)
    for rule, languages in by_rule.items():
        out = F.when(F.lower(language).isin(languages), rule(s)).otherwise(out)
    return out
