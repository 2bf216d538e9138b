"""License scans by canonical digest lookup.

A text's canonical form has no case, punctuation or copyright lines, and one
spelling where several are in use; its SHA-256 is looked up, by a hash join, in
the digests of known license texts treated the same way.  Entire texts are
looked up, and also each of their lines, where notices stand.

All of it is DataFrame work.  The known digests are a small table whose size
Spark checks before it broadcasts it.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab.llm.common import ids_and_text, written

#: Words that license texts spell in more than one way, and the spelling kept
#: (fixed values).
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sub license": "sublicense",
    "sub licenses": "sublicenses",
    "non infringement": "noninfringement",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "organisation": "organization",
    "organisations": "organizations",
    "authorised": "authorized",
    "acknowledgement": "acknowledgment",
    "favour": "favor",
    "fulfil": "fulfill",
    "judgement": "judgment",
    "merchantable": "merchantability",
    "whilst": "while",
    "wilful": "willful",
    "https": "http",
}

#: A line that names a copyright holder, not one that speaks of copyright.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright[ \t]+(\(c\)|©|[0-9]{4}|<|\[|by )|\(c\)[ \t]|©|all rights reserved)[^\n]*"

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Known texts (fixed values): short licenses in full, and notices of longer ones.
KNOWN = (
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.\n\n" + _AS_IS,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.\n\n" + _AUTHOR,
    ),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AUTHOR),
    ("BSD-2-Clause", _BSD + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.\n" + _BSD_END,
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

#: Texts in ``license_texts`` (fixed values), by license.
FILES = ("Apache-2.0", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib")
#: Where terms end; what follows says how to apply them, and is often left out.
TERMS_END = "END OF TERMS AND CONDITIONS"
#: Lines that a text may begin with, or lack.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "BSD License", "New BSD License", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License 1.0",),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}


def known_texts() -> list[tuple[str, str]]:
    """:data:`KNOWN`, the texts of :data:`FILES` (also without what follows
    their terms), and every full text with and without each of its titles."""
    full = [(i, t) for i, t in KNOWN if "\n" in t]
    for i in FILES:
        text = files(__package__).joinpath("license_texts", f"{i}.txt").read_text(encoding="utf-8")
        head, end, rest = text.partition(TERMS_END)
        full += [(i, text)] + ([(i, head), (i, head + end)] if rest.strip() else [])
    full = [(i, t.removeprefix("MIT License\n\n")) for i, t in full]
    return [*KNOWN, *full, *((i, f"{title}\n\n{t}") for i, t in full for title in TITLES.get(i, ()))]


def canonical(text: Column) -> Column:
    """The canonical form: words in lower case, single spaces, empty for NULL."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    # a space on either side of each word, two between, so that words that
    # follow each other can both be replaced
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for word, kept in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {word.replace(' ', '  ')} "), F.lit(f" {kept.replace(' ', '  ')} "))
    return F.replace(F.trim(out), F.lit("  "), F.lit(" "))


def digest(text: Column) -> Column:
    # never NULL, and said so: else a join would first compute it in a filter
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(""))


def known_digests(spark: SparkSession, texts=None) -> DataFrame:
    """``digest, license_id`` of known texts (:func:`known_texts` if none are
    given): (id, text) pairs or a DataFrame with ``license_id`` and ``text``.  Where texts of several licenses have one
    digest the first id in order stands; empty texts are left out."""
    texts = known_texts() if texts is None else texts
    table = texts if isinstance(texts, DataFrame) else spark.createDataFrame(list(texts), "license_id string, text string")
    table = table.where(canonical(F.col("text")) != "").select(digest(F.col("text")).alias("digest"), "license_id")
    return table.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, digest, license_id, notices`` for every row of ``docs``: the
    license that the entire text is (NULL: none), and the sorted ids, joined by
    commas, of those that one of its lines is.

    NULL and empty texts have the digest of the empty form, which nothing
    matches.  Rows that repeat are each returned; NULL ids are kept; other
    columns are dropped; an empty table gives an empty table."""
    spark = docs.sparkSession
    known = written(known if known is not None else known_digests(spark), "known")
    df = ids_and_text(docs, id_col, text_col).withColumn("rk", F.xxhash64("text"))
    lines = df.select("id", "rk", F.explode(F.split("text", "\n")).alias("line")).select("id", "rk", digest(F.col("line")).alias("digest"))
    found = lines.join(known, "digest").groupBy("id", "rk").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    found = written(found.select(F.col("id").alias("nid"), F.col("rk").alias("nrk"), "notices"), "notices")
    whole = df.select("id", "rk", digest(F.col("text")).alias("digest")).join(known, "digest", "left")
    out = whole.join(found, F.col("id").eqNullSafe(F.col("nid")) & (F.col("rk") == F.col("nrk")), "left")
    return out.select(F.col("id").alias(id_col), "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def oracle_sql(texts=None) -> str:
    """DuckDB SQL for the contract query, over :func:`known_texts` like it."""
    texts = known_texts() if texts is None else texts

    def form(x: str) -> str:
        out = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', chr(10), 'g')"
        out = f"' ' || regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
        for word, kept in SPELLINGS.items():
            out = f"replace({out}, ' {word.replace(' ', '  ')} ', ' {kept.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in texts)
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256({form('text')}) AS digest FROM (VALUES {rows}) v(license_id, text)) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT r, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices
      FROM (SELECT r, sha256({form('line')}) AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)) l JOIN known USING (digest) GROUP BY r),
w AS (SELECT r, doc_id, sha256({form('text')}) AS digest FROM d)
SELECT doc_id, w.digest, known.license_id, coalesce(notices, '') AS notices
FROM w LEFT JOIN known ON known.digest = w.digest LEFT JOIN n ON n.r = w.r"""
