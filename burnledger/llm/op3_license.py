"""License scan by canonical digests, in built-in functions only.

A text is brought to a canonical form: lower case, copyright lines dropped, equivalent spellings replaced, everything
but letters and digits as one blank. The digest of a whole canonical text, and of each whole paragraph (lines up to a
blank one) and line of it, is looked up among the digests of known licence texts with an equality join. Nothing is searched for inside a line, so ordinary
prose that mentions a licence is left alone.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnledger.llm import common

# Spellings that count as the same, in the order in which they are replaced.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("sub licensing", "sublicensing"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("fulfil ", "fulfill "),
    ("judgement", "judgment"), ("merchantibility", "merchantability"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
)

# Notices and short licences, as published. The table beside this file has the others.
TABLE = Path(__file__).with_name("known_licenses.jsonl")
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
)

# A line that opens with a copyright sign or word and names a year or a holder, and the line that reserves all rights.
COPYRIGHT_LINE = "(?m)^[^a-z0-9\\n]*(copyright( ?\\(c\\)| ?©| [0-9]{4})|\\(c\\) ?[0-9]{4}|© ?[0-9]{4}|all rights reserved)[^\\n]*$"
OTHER = "[^\\p{L}\\p{N}\\n]+"


def _spelled(text: Column) -> Column:
    """Canonical but for blank lines and blanks at line ends."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, OTHER, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _closed(spelled: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(spelled, " ?\\n[ \\n]*", "\n"), "^[ \\n]+|[ \\n]+$", "")


def canonical(text: Column) -> Column:
    """Canonical form, with a line end where the text has one; a null text counts as empty."""
    return _closed(_spelled(text))


def digest(form: Column) -> Column:
    return F.sha2(F.replace(form, F.lit("\n"), F.lit(" ")).cast("binary"), 256)


def known(spark: SparkSession) -> DataFrame:
    """license_id and text of the licences and notices that are looked up: KNOWN and those of the table."""
    table = [json.loads(line) for line in TABLE.read_text(encoding="utf-8").splitlines()]
    return spark.createDataFrame([*KNOWN, *((r["license_id"], r["text"]) for r in table)], "license_id string, text string")


def digests(licenses: DataFrame, id_col: str = "license_id", text_col: str = "text") -> DataFrame:
    """license_id and digest of each known text; null ids and empty texts are left out, repeated ones count once."""
    form = licenses.select(F.col(f"`{id_col}`").alias("license_id"), canonical(F.col(f"`{text_col}`")).alias("form"))
    return form.where("license_id IS NOT NULL AND form <> ''").select("license_id", digest(F.col("form")).alias("digest")).distinct()


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, whole (the entire text is that licence) and n_lines (lines that are) of each document with any.

    Rows that share an id and a licence are counted together; a null id is a group of its own. Null and empty texts
    have no licence. A licence that only paragraphs of several lines are has n_lines 0. A text that is in the list of two licences gives a row for each.
    """
    spelled = common.keyed(docs, id_col, text_col).select("doc_id", _spelled(F.col("text")).alias("spelled"))
    forms = spelled.select("doc_id", "spelled", _closed(F.col("spelled")).alias("form")).where("form <> ''")

    def of(kind: str, form: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), digest(form).alias("digest"))

    # A paragraph of one line is that line.
    blocks = F.filter(F.transform(F.split("spelled", "\\n *\\n[ \\n]*"), _closed), lambda x: x.contains("\n"))
    units = forms.select("doc_id", F.explode(F.concat(
        F.array(of("text", F.col("form"))), F.transform(blocks, lambda x: of("paragraph", x)),
        F.transform(F.split("form", "\n"), lambda x: of("line", x)))).alias("u"))
    hits = units.select("doc_id", "u.kind", "u.digest").join(digests(licenses), "digest")
    return hits.groupBy("doc_id", "license_id").agg(F.max(F.col("kind") == "text").alias("whole"),
                                                    F.count(F.when(F.col("kind") == "line", 1)).alias("n_lines"))


def oracle() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"regexp_replace(lower(coalesce({text}, '')), {quoted(COPYRIGHT_LINE)}, '', 'g')"
        out = f"regexp_replace({out}, {quoted(OTHER)}, ' ', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quoted(old)}, {quoted(new)})"
        out = f"regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g')"
        return f"regexp_replace({out}, '^[ \\n]+|[ \\n]+$', '', 'g')"

    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    return f"""
    WITH known AS (SELECT DISTINCT license_id, sha256(replace(form, chr(10), ' ')) AS digest
                   FROM (SELECT license_id, {form('text')} AS form FROM (VALUES {rows}) k(license_id, text)) WHERE form <> ''),
    forms AS (SELECT doc_id, {form('text')} AS form FROM documents),
    units AS (SELECT doc_id, true AS whole, sha256(replace(form, chr(10), ' ')) AS digest FROM forms WHERE form <> ''
              UNION ALL
              SELECT doc_id, false, sha256(line)
              FROM (SELECT doc_id, unnest(string_split(form, chr(10))) AS line FROM forms WHERE form <> ''))
    SELECT doc_id, license_id, bool_or(whole) AS whole, count(*) FILTER (WHERE NOT whole) AS n_lines
    FROM units JOIN known USING (digest) GROUP BY doc_id, license_id"""
