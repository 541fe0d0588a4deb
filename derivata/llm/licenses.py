"""Licence scan by canonical digests.

A text is brought into a canonical form: lower case; no copyright statements; words of letters and digits alone; spellings
that mean the same made one; numbers and letters of lists gone where a sentence or clause has ended, however lines are
broken. Its digest is looked up, by hash join, among the digests of known licence texts, whole
against whole. Lines of a document are looked up in the same way among known notices.

Texts that name none of the words of :data:`ANCHORS` equal no built-in licence, as each names some; with the built-in
table they skip the canonical form and get a key that matches nothing, so that nulls don't gather in one task.

Null and empty texts match nothing. Repeated rows each give a row. Several licences of one digest are an error of the
table of licences and refused.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words spelt in two ways, and the one used here.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "favour": "favor", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "judgement": "judgment", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "modelled": "modeled",
    "noncommercial": "non commercial", "noninfringement": "non infringement", "offence": "offense", "organisation": "organization",
    "organisations": "organizations", "percent": "per cent", "practise": "practice", "programme": "program", "recognised": "recognized",
    "sublicence": "sublicense", "whilst": "while", "wilful": "willful",
}
#: Words written apart, and as one.
APART = {"sub license": "sublicense", "sub licence": "sublicense"}

#: Words of which every built-in text names at least one, before spellings are made one.
ANCHORS = "licen|permission|software|public domain"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}."""
_ISC_END = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Licence texts as published, without their titles and copyright lines.
KNOWN_TEXTS = {
    "MIT": _MIT,
    "ISC": _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies") + _ISC_END,
    "0BSD": _ISC.format("") + _ISC_END,
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_NAME + _BSD_END,
    "Zlib": _ZLIB,
}
#: Whole texts in files of the folder texts, as published; also known up to where their terms end.
FULL_TEXTS = (
    "Apache-2.0", "Artistic-1.0-Perl", "CC-BY-SA-4.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
    "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "OFL-1.1", "Unicode-3.0",
)
TERMS_END = "END OF TERMS AND CONDITIONS"
#: Titles that may stand before a text.
TITLES = {"MIT": ["The MIT License", "MIT License", "The MIT License (MIT)"], "ISC": ["ISC License"], "0BSD": ["BSD Zero Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"]}
#: Notices of one line.
KNOWN_NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
}

#: Notices are looked up in a literal table, so their number is bounded; more are refused.
MOST_NOTICES = 1000

#: So many known texts, a digest and a name each, are broadcast.
MOST_BROADCAST = 10_000

#: Lines that state a copyright: a sign or year follows the word, or a year the sign. Others that start so are text.
_SIGN, _YEAR, _GAP = r"(?:\(c\)|©)", r"(?:\d{4}\b|[\[<{](?:yyyy|year))", r"[ \t:,-]*"
_COPYRIGHT = rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright{_GAP}(?:{_SIGN}|{_YEAR})|{_SIGN}{_GAP}(?:copyright{_GAP})?{_YEAR})[^\n]*$|\ball\s+rights\s+reserved\b\.?"


#: Numbers and letters of list items: 1. (a) iv)
_MARKER = r"(?:\A\s*|(?<=[.;:])[*#/>-]*\s[\s*#/>-]*)\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)](?=\s)"


def canonical(text: Column) -> Column:
    """The canonical form, as a column."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT, " "), _MARKER, " ")
    t = F.btrim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))
    for apart, whole in APART.items():
        t = F.regexp_replace(t, rf"\b{apart}\b", whole)
    spelt = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    words = F.transform(F.split(t, " "), lambda w: F.coalesce(F.try_element_at(spelt, w), w))
    return F.array_join(words, " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark) -> DataFrame:
    """(digest, license_id, kind) of the built-in texts (with and without titles) and notices."""
    rows = [(k, "text", t) for k, t in KNOWN_TEXTS.items()] + [(k, "text", f"{title}\n{KNOWN_TEXTS[k]}") for k, titles in TITLES.items() for title in titles]
    for k in FULL_TEXTS:
        full = (Path(__file__).parent / "texts" / f"{k}.txt").read_text(encoding="utf-8")
        terms, end, _ = full.partition(TERMS_END)
        rows += [(k, "text", t) for t in ((full, terms, terms + end) if end else (full,))]
    rows += [(k, "notice", n) for k, notices in KNOWN_NOTICES.items() for n in notices]
    table = spark.createDataFrame(rows, "license_id string, kind string, text string")
    return table.select(digest(F.col("text")).alias("digest"), "license_id", "kind").distinct()


def license_scan(docs: DataFrame, text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """``docs`` with license_id (of the known text that the whole text equals, or null), text_digest (of the canonical
    form; null where no known text can match) and notice_ids (sorted licences that a whole line names).

    Columns with these names are replaced; others pass unchanged."""
    spark = docs.sparkSession
    anchors = ANCHORS if known is None else r"[\p{L}\p{N}]"  # others' texts need not name the words
    known = known if known is not None else known_digests(spark)
    texts, notices = (known.where(F.col("kind") == k).select("digest", "license_id") for k in ("text", "notice"))
    if twice := texts.groupBy("digest").agg(F.countDistinct("license_id").alias("n")).where("n > 1").limit(1).collect():
        raise ValueError(f"licences of one digest: {twice[0].digest}")
    side = texts.select(F.col("digest").alias("td"), F.col("license_id").alias("tl"))
    if texts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        side = F.broadcast(side)  # else both sides are dealt by digest
    added = ("license_id", "text_digest", "notice_ids")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in added}
    text = F.col(names[text_col])
    hint = F.lower(text).rlike(anchors)
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    lines = F.when(hint, F.array_distinct(F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(anchors))))
    df = df.select(*names.values(), F.when(hint, digest(text)).alias("d"), F.coalesce(F.transform(lines, digest), F.array().cast("array<string>")).alias("l"))
    found = df.join(side, F.coalesce("d", F.concat(F.lit("-"), F.xxhash64(*names.values()).cast("string"))) == F.col("td"), "left")
    bounded = {r.digest: r.license_id for r in notices.groupBy("digest").agg(F.min("license_id").alias("license_id")).limit(MOST_NOTICES + 1).collect()}
    if len(bounded) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_NOTICES} notices")
    lookup = F.create_map(*[F.lit(x) for pair in bounded.items() for x in pair]) if bounded else F.create_map().cast("map<string,string>")
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("l", lambda x: F.try_element_at(lookup, x)), lambda x: x.isNotNull())))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("tl").alias("license_id"), F.col("d").alias("text_digest"), ids.alias("notice_ids"))
