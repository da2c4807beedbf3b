"""Licence scan by canonical digests: a text is normalised, digested and looked up among known licence texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence texts and notices, with holders and years left out.
KNOWN = {
    "MIT": [
        "MIT License\n\nCopyright (c) holder\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        "ISC License\n\nCopyright (c) holder\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "BSD-3-Clause": [
        "Copyright (c) holder\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <http://unlicense.org/>",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
}

# The two-clause text is the three-clause one without its third condition; titles may be left out or put above.
KNOWN["BSD-2-Clause"] = [
    KNOWN["BSD-3-Clause"][0].split("\n\n3. ")[0] + "\n\nTHIS SOFTWARE" + KNOWN["BSD-3-Clause"][0].split("\n\nTHIS SOFTWARE")[1],
    "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause",
]
for _name in ("MIT", "ISC"):
    KNOWN[_name].append(KNOWN[_name][0].split("\n\n", 1)[1])
for _name in ("BSD-2-Clause", "BSD-3-Clause"):
    KNOWN[_name].append(f"{_name[:5].replace('-', ' ')}-Clause License\n\n{KNOWN[_name][0]}")

# Spellings that licence matching guidelines hold for equal, as they stand after punctuation is gone.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"),
    ("sublicence", "sublicense"), ("sublicencing", "sublicensing"), ("sub license", "sublicense"), ("sub licensing", "sublicensing"), ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("organisation", "organization"), ("favour", "favor"),
    ("merchantibility", "merchantability"), ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("https", "http"),
]

#: Short lines that name a copyright holder or reserve rights; patterns are those that Spark and DuckDB read alike.
COPYRIGHT_LINE = r"(?m)^[ \t>*#/;-]*(copyright[^\n]{0,100}([0-9]{4}|\(c\)|©)|copyright by |\(c\) |©|all rights reserved)[^\n]{0,160}$"
#: A notice of a holder with a licence behind it on the same line; the licence stays.
HOLDER = r"(copyright|\(c\)|©)[^\n]{0,160}?(permission is hereby granted|permission to use,? copy|redistribution and use in|licen[cs]ed under|released under|this program is free|this work is licen[cs]ed|spdx)"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Every known text has one of these words; a line without them can't be one.
MARKS = ("licen", "redistribution", "permission")


def _has_mark(text: F.Column) -> F.Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in MARKS])


def canonical(text: F.Column) -> F.Column:
    """Lower case, no copyright notices, runs of punctuation and white space as one space, one spelling. Null is empty.

    A text of nothing but copyright notices keeps their words.
    """
    lower = F.lower(F.coalesce(text, F.lit("")))
    noticed = lower.contains("copyright") | lower.contains("(c)") | lower.contains("©")
    open_ = F.when(noticed, F.regexp_replace(lower, HOLDER, " $2")).otherwise(lower)
    spaced = lambda t: F.trim(F.regexp_replace(t, NOT_WORD, " "))
    bare = spaced(F.regexp_replace(open_, COPYRIGHT_LINE, " "))
    words = F.concat(F.lit(" "), F.when(bare != "", bare).otherwise(spaced(lower)), F.lit(" "))
    any_spelling = " (" + "|".join(a for a, _ in SPELLINGS) + ") "
    one = reduce(lambda t, s: F.replace(t, F.lit(f" {s[0]} "), F.lit(f" {s[1]} ")), SPELLINGS, words)
    return F.trim(F.when(words.rlike(any_spelling), one).otherwise(words))


def known_digests(spark, known: DataFrame | None = None) -> DataFrame:
    """(digest, license_id) of the texts in `known` (license_id, text), or of `KNOWN`.

    Texts without words are no licence; of licences with one digest the first by name counts.
    """
    if known is None:
        known = spark.createDataFrame([(name, text) for name, texts in KNOWN.items() for text in texts], "license_id string, text string")
    words = known.where("license_id is not null").select("license_id", canonical(F.col("text")).alias("words")).where("words != ''")
    return words.groupBy(F.sha2("words", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(id, digest, license_id, notices) of every row.

    digest: SHA-256 of the canonical whole text; license_id: the licence whose text it is, else null; notices: licences
    whose text or notice is a line of its own, in order, each once. Null counts as empty, which is no licence. Rows that
    repeat id and text get equal results. `known` (license_id, text) replaces the built-in texts by a table of any size, such
    as whole texts of long licences; then every line is digested, as no word marks the lines that matter.
    """
    fixed = known is None
    known = known_digests(docs.sparkSession, known)
    if fixed:
        known = F.broadcast(known)  # some 35 rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = rows.select("id", F.xxhash64("text").alias("h"), F.sha2(canonical(F.col("text")), 256).alias("digest"))
    lines = F.split(F.lower("text"), "\n")
    marked = rows.where(_has_mark(F.lower("text"))) if fixed else rows
    lines = marked.select(
        "id", F.xxhash64("text").alias("h"), F.explode(F.array_distinct(F.filter(lines, _has_mark) if fixed else lines)).alias("line")
    )
    notices = (
        lines.select("id", "h", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(known, "digest")
        .groupBy("id", "h").agg(F.sort_array(F.collect_set("license_id")).alias("notices"))
    )
    found = whole.join(known, "digest", "left")
    near = (found["id"].eqNullSafe(notices["id"])) & (found["h"] == notices["h"])
    joined = found.join(notices, near, "left")
    return joined.select(
        found["id"].alias(id_col), "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices")
    )


def scan_sql() -> str:
    """The same scan of table documents in DuckDB SQL; notices as text, joined by commas."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    one = "words"
    for a, b in SPELLINGS:
        one = f"replace({one}, {quote(f' {a} ')}, {quote(f' {b} ')})"
    inline = f"regexp_replace(lower(text), {quote(HOLDER)}, {quote(chr(32) + chr(92) + '2')}, 'g')"
    spaced = lambda t: f"trim(regexp_replace({t}, {quote(NOT_WORD)}, ' ', 'g'))"
    bare = spaced(f"regexp_replace({inline}, {quote(COPYRIGHT_LINE)}, ' ', 'g')")
    known = ", ".join(f"({quote(name)}, {quote(text)})" for name, texts in KNOWN.items() for text in texts)
    return f"""
with known_text(license_id, text) as (values {known}),
lines as (
    select distinct doc_id, md5(coalesce(text, '')) as h, unnest(string_split(lower(text), chr(10))) as line
    from documents),
every(kind, a, b, text) as (
    select 'known', null, license_id, text from known_text
    union all select 'whole', doc_id, md5(coalesce(text, '')), coalesce(text, '') from documents
    union all select 'line', doc_id, h, line from lines),
spaced as (
    select kind, a, b, ' ' || case when {bare} != '' then {bare} else {spaced('lower(text)')} end || ' ' as words from every),
digests as (select kind, a, b, sha256(trim({one})) as digest from spaced),
known as (select digest, min(b) as license_id from digests where kind = 'known' group by 1),
notices as (
    select a, b, string_agg(distinct license_id, ',' order by license_id) as notices
    from digests join known using (digest) where kind = 'line' group by a, b)
select w.a as doc_id, w.digest, k.license_id, coalesce(n.notices, '') as notices
from digests w left join known k using (digest) left join notices n on n.a is not distinct from w.a and n.b = w.b
where w.kind = 'whole'"""
