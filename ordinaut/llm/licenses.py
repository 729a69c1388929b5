"""License scans by canonical digest lookup.

A text is put into a canonical form (lower case, copyright statements dropped, punctuation and white space folded, one of
each pair of equivalent spellings) and its SHA-256 is hash-joined to the digests of known licences.  Whole texts are
looked up, and so is every line of a text, which finds the notices that documents carry.  All of it is Column
expressions; known texts go through the same ones, so both sides always agree.

A null text counts as empty.  What has an empty canonical form has no licence.  Every row is reported by its own text,
whether or not others have its id.  Known licences with equal canonical forms are told apart by the smallest id.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only the oracle's, which has no lookahead.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
# What follows "copyright" in running text, in capitals or as a heading, where a statement has a name.
_NO_NAME = "notices?|holders?|owners?|licen[sc]e[sd]?|laws?|acts?|treat(?:y|ies)|rights?|statements?|permissions?|protections?|interests?|infringements?|claims?|terms?|status|disclaimers?|and|or|in|is|on|of|for|to|under|as|with|that|which|may|shall|will"
_NO_ITEM = "you|your|the|this|these|that|such|any|all|each|every|no|if|in|on|a|an|for|to|under|where|when|use|it|its|every|notwithstanding|except|other"
#: The signs that begin a line of a comment in source files.
_COMMENT = r"[ \t]*(?:[#/*;%!<.-]{1,4}[ \t]*)?"
#: A line that is a copyright statement, before its case is folded, as a name shows by its capital: the word with a sign, a year or a name
#: after it, or a sign with a year or a name.  Running text may begin a line with the word as well, wherever it was wrapped, and a list with "(c)".
COPYRIGHT_STATEMENT = (
    rf"(?m)^{_COMMENT}(?:©|\([cC]\)[ \t]*(?:(?i:copyright)|(?:19|20)\d\d\b|(?!(?i:{_NO_ITEM})\b)\p{{Lu}})|(?i:copyright)[ \t:,-]*(?i:\(c\)|©|&copy;|(?:19|20)\d\d\b)"
    rf"|(?:Copyright|COPYRIGHT):?[ \t]+(?i:by[ \t]+)?(?i:the[ \t]+)?(?!(?i:{_NO_NAME})\b)[\p{{Lu}}<\[{{])[^\n]*$"
)

# Pairs of spellings that licence matching treats as equal (the first becomes the second).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalog", "catalogue"), ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

# Known licences and notices; the longer texts are the files of ``known``.
KNOWN = [
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", f"ISC License\n\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_ISC}.\n\n{_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD_1}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_1}\n\n{_BSD_3}\n\n{_BSD_END}"),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
]


#: Where the terms of some texts end; an appendix follows that is often left out.
TERMS_END = "END OF TERMS AND CONDITIONS"
RESERVED = "All rights reserved."


def known_texts() -> list[tuple[str, str]]:
    """``KNOWN``, and the texts of the files ``known/<licence>.txt``, each with and without what follows its terms.  What is
    longer than a notice is also known with the sentence that all rights are reserved, which comes with the copyright
    statement and so before the text, or after its title."""
    out = list(KNOWN)
    for file in sorted((Path(__file__).parent / "known").glob("*.txt")):
        text = file.read_text("utf-8")
        at = text.find(TERMS_END)
        out += [(file.stem, text)] + ([(file.stem, text[:at] + TERMS_END), (file.stem, text[:at])] if at >= 0 else [])
    for name, text in list(out):
        if len(text) > 200:
            title, _, rest = text.partition("\n\n")
            out += [(name, f"{RESERVED}\n{text}"), *([(name, f"{title}\n{RESERVED}\n{rest}")] if rest and len(title) < 80 else [])]
    return out


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


_PAIRS = [(_spaced(old), _spaced(new)) for old, new in SPELLINGS]
_FIRST = sorted({old[1] for old, _ in _PAIRS})
#: Any spelling to replace, by its first letter, so that most words are done with after one.
_ANY = f"  (?=[{''.join(_FIRST)}])(?:" + "|".join(f"{c}(?:" + "|".join(old.strip()[1:] for old, _ in _PAIRS if old[1] == c) + ")" for c in _FIRST) + ")  "


def with_canonical(df: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its canonical form: words that one blank separates.  Each step is a projection of its own, so
    that none is worked out again where the next one names it twice."""
    text = F.lower(F.regexp_replace(F.coalesce(column, F.lit("")), COPYRIGHT_STATEMENT, " "))
    # two blanks around each word, so that neighbouring replacements don't share one
    df = df.withColumn(column, F.concat(F.lit("  "), F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "  ")), F.lit("  ")))
    # most texts have none of the spellings, and one pattern tells them from the others
    pairs = F.array(*(F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in _PAIRS))
    found = F.col(column).rlike(_ANY)
    df = df.withColumn(column, F.when(found, F.aggregate(pairs, F.col(column), lambda t, p: F.replace(t, p["old"], p["new"]))).otherwise(F.col(column)))
    return df.withColumn(column, F.trim(F.replace(F.col(column), F.lit("  "), F.lit(" "))))


def with_digest(df: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by ``digest``: SHA-256 of its canonical form in lowercase hex; null where that is empty."""
    df = with_canonical(df, column)
    return df.withColumn("digest", F.when(F.col(column) != "", F.sha2(F.col(column).cast("binary"), 256))).drop(column)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """``digest, license_id`` of known texts, from a list or a table ``license_id, text``; those of ``known_texts`` by default."""
    table = known if isinstance(known, DataFrame) else spark.createDataFrame(known_texts() if known is None else known, "license_id string, text string")
    return with_digest(table.select("license_id", "text"), "text").where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, digest, license_id, notices`` for each row of ``docs(doc_id, text)``: the whole text's digest and
    licence, and the sorted licences whose notice is a whole line.  Only lines that are known go back to their texts, by the
    id and the text's own digest, so that a row's notices are those of its text even where ids repeat or are null.  Spark
    sends the known digests to every executor while they are small and shuffles both sides beyond that."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_mark", F.unhex(F.md5(F.col("text").cast("binary"))))
    whole = with_digest(rows, "text").join(known, "digest", "left")
    lines = rows.select(F.col("doc_id").alias("_id"), F.col("_mark").alias("_own"), F.explode(F.split("text", "\n")).alias("line"))
    # never null, or the join's test for nulls would work out every line's digest once more, below the steps
    found = with_digest(lines, "line").withColumn("digest", F.coalesce("digest", F.lit(""))).join(known, "digest")
    notices = found.groupBy("_id", "_own").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_own"))
    return whole.join(notices, same, "left").select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def _sql_canonical(text: str) -> str:
    """The same form for DuckDB."""
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', ' ', 'g')"
    out = f"'  ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || '  '"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{_spaced(old)}', '{_spaced(new)}')"
    return f"nullif(trim(replace({out}, '  ', ' ')), '')"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
    WITH known AS (SELECT sha256({_sql_canonical("t")}) AS digest, min(l) AS license_id FROM (VALUES {values}) AS k(l, t) GROUP BY 1),
    lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    found AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
              FROM (SELECT doc_id, sha256({_sql_canonical("line")}) AS digest FROM lines) l JOIN known USING (digest) GROUP BY doc_id),
    whole AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM documents)
    SELECT w.doc_id, w.digest, k.license_id, coalesce(f.notices, '') AS notices
    FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN found f ON w.doc_id = f.doc_id"""
