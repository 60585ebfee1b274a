"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form - lower case, without copyright lines,
punctuation and line breaks, with one of several equivalent spellings - and the
digest of the whole form is looked up among those of known licences.  Whole
documents meet the known digests in a hash join; so do all their lines, one by one, which
find licences that are stated by name.

Texts are read once: the digests of each text and of its lines go to a table in the
shared folder, and the joins work on that.  Known digests are broadcast only up
to BROADCAST_BYTES; beyond that they are shuffled like the lines.

Nulls: a null text is empty and never matches; empty forms never match; known rows
without id or text take no part.  Rows are judged one by one, so repeated rows give
repeated results, and a line that is repeated counts each time.  Very long texts are one
row each.  Empty tables give no rows, or no matches.  Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphworks.llm._shared import written

# Known licence texts and statements, by SPDX identifier.
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")
APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
    "copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed "
    "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
    "specific language governing permissions and limitations under the License."
)
GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
    "License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n\n"
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD_3 = BSD_2.replace(
    "\n\nTHIS SOFTWARE",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n\nTHIS SOFTWARE",
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that "
    "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
    "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
    "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
    "NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
    "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
)
MPL_NOTICE = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
    "one at http://mozilla.org/MPL/2.0/."
)
TEXTS = [
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("0BSD", ZERO_BSD), ("Apache-2.0", APACHE_NOTICE), ("GPL-3.0-or-later", GPL_NOTICE),
    ("BSD-2-Clause", BSD_2), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2), ("BSD-3-Clause", BSD_3), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3), ("Unlicense", UNLICENSE), ("MPL-2.0", MPL_NOTICE),
]
#: Canonical digests of licences too long to be written out here, from the texts that Debian's base-files ships.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "b917214ddabf84a2ad21d307bf7ce49fccd382bee40298387d45bbe9aa25fcca"),
    ("Artistic-1.0-Perl", "0de0cc27abde1fd2717361f15729d546e9697a47ff741ba65e352cb66a0773db"),
    ("CC0-1.0", "0a1be2017ec8d38dbb0dfb4f86e1c257728a1669c7fe4d3aa53a1c459e1018ee"),
    ("GFDL-1.2-only", "e2ff9bf05ca2e1ebc63c4814dd7f65e571d115388b2c3f0a5ecd9804ee6589a4"),
    ("GFDL-1.3-only", "c4f2050753c38be4737f4dfdf125886a9b8b15f6046393b146831ceb38752cc7"),
    ("GPL-1.0-only", "869d156f07824e4287a2959e638586941efcb3774b5e407be30ff180ac13548b"),
    ("GPL-2.0-only", "7baad5c5936636b4202790e310f859d5160f5d94882e01a9bea97731368bb680"),
    ("GPL-3.0-only", "7effc07ab96d6529b213f14318e223d380bb1b8d121c8e9ff6805ae269a51a8b"),
    ("LGPL-2.0-only", "21fbaeb8be88e583ab343bf80bbf47d0cd99848f3f6bfcc86a2b6d0e1c9936f4"),
    ("LGPL-2.1-only", "112a6c1bd3a2dacff9929edebbcb5dba908c02e8499c391de4e7e4b05656aedd"),
    ("LGPL-3.0-only", "572947626844a56d29ace510237040204d4085696621f319533ca366aa897913"),
    ("MPL-1.1", "34f79eb282730a867c553a22dd72646e4c154690f6d51dbc88a1fbf6b3cb7a76"),
    ("MPL-2.0", "1f9b7661552309dc69cee928f7d32ed3280cbc918bfeced108b8b7d3f68f5452"),
]
STATEMENTS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
]
#: Equivalent spellings, whole words of the canonical form.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("organisation", "organization"),
    ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("favour", "favor"), ("labour", "labor"), ("colour", "color"), ("whilst", "while"),
    ("wilful", "willful"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("authorisation", "authorization"), ("behaviour", "behavior"),
]
# end of fixed values

#: Bytes of known digests up to which they are broadcast, at about KNOWN_BYTES a row.
BROADCAST_BYTES, KNOWN_BYTES = 32 << 20, 128
_COPYRIGHT = r"^[ \t\x0B\f\r*#/;-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
_NOT_WORD = r"[^\p{L}\p{N}\n]+"


def _respelled(c: Column, spellings: list[tuple[str, str]]) -> Column:
    """c: words, each between two spaces of its own."""
    for a, b in spellings:
        c = F.replace(c, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    return c


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line feeds: words with two spaces between them."""
    c = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "(?md)" + _COPYRIGHT, "")
    c = F.replace(F.regexp_replace(c, _NOT_WORD, "  "), F.lit("\n"), F.lit("  \n  "))
    return _respelled(F.concat(F.lit("  "), c, F.lit("  ")), SPELLINGS)


def joined_lines(lines: Column) -> Column:
    """The canonical form of a whole text from that with line feeds."""
    c = F.concat(F.lit("  "), F.trim(F.regexp_replace(lines, "[ \n]+", "  ")), F.lit("  "))
    return F.trim(_respelled(c, [s for s in SPELLINGS if " " in s[0]]))


def canonical(text: Column) -> Column:
    return joined_lines(canonical_lines(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the built-in licences."""
    listed = known_digests(spark.createDataFrame(TEXTS + STATEMENTS, "license_id string, text string"))
    return listed.unionByName(spark.createDataFrame(DIGESTS, "license_id string, digest string"))


def known_digests(known: DataFrame) -> DataFrame:
    """(license_id, text) -> (license_id, digest)."""
    form = known.where("license_id is not null").select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
    return form.select("license_id", F.sha2(F.col("form").cast("binary"), 256).alias("digest"))


def scan(docs: DataFrame, known: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_digest, license_id (of the whole text, or null), line_licenses (of single lines, in order), n_license_lines.

    known: (license_id, text); the smallest id wins where two texts share a form.
    """
    known = known_digests(known) if known is not None else known_licenses(docs.sparkSession)
    known = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if known.count() * KNOWN_BYTES <= broadcast_bytes:
        known = F.broadcast(known)
    short = lambda c: F.substring(F.unhex(c), 1, 16)
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.col("text")).alias("lines"))
    each = F.filter(F.transform(F.split("lines", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    # a number for each row of the written table: rows that are equal stay apart
    rows = lines.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(joined_lines(F.col("lines")).cast("binary"), 256).alias("text_digest"),
        F.transform(each, lambda x: short(F.sha2(x.cast("binary"), 256))).alias("line_digests"),
    )
    rows, _ = written(rows, "license-digests")
    stated = known.select(short(F.col("digest")).alias("line_digest"), F.col("license_id").alias("stated"))
    found = rows.select("row", F.posexplode("line_digests").alias("at", "line_digest")).join(stated, "line_digest")
    listed = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "stated"))).alias("found")).select(F.col("row").alias("hit"), F.col("found.stated").alias("found"))
    out = rows.select("row", "doc_id", "text_digest").join(known.withColumnRenamed("digest", "text_digest"), "text_digest", "left").join(listed, F.col("row") == F.col("hit"), "left")
    line_licenses = F.coalesce("found", F.array().cast("array<string>"))
    return out.select("doc_id", "text_digest", "license_id", line_licenses.alias("line_licenses"), F.size(line_licenses).cast("long").alias("n_license_lines"))


def _sql_respelled(c: str, spellings: list[tuple[str, str]]) -> str:
    for a, b in spellings:
        c = f"replace({c}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return c


def _sql_lines(text: str) -> str:
    c = f"replace(regexp_replace(regexp_replace(lower({text}), '(?m){_COPYRIGHT}', '', 'g'), '{_NOT_WORD}', '  ', 'g'), chr(10), '  ' || chr(10) || '  ')"
    return _sql_respelled(f"'  ' || {c} || '  '", SPELLINGS)


def _sql_joined(lines: str) -> str:
    c = f"'  ' || trim(regexp_replace({lines}, '[ \\n]+', '  ', 'g')) || '  '"
    return f"trim({_sql_respelled(c, [s for s in SPELLINGS if ' ' in s[0]])})"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL = f"""
with known as (select license_id, sha256({_sql_joined(_sql_lines('text'))}) as digest from (values {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in TEXTS + STATEMENTS)}) as v(license_id, text)
), every as (select * from known union all select * from (values {', '.join(f'({_quoted(i)}, {_quoted(d)})' for i, d in DIGESTS)}) as w(license_id, digest)
), k as (select digest, min(license_id) as license_id from every group by 1
), d as (select row_number() over () as row_no, doc_id, {_sql_lines("coalesce(text, '')")} as c from documents
), l as (select row_no, unnest(string_split(c, chr(10))) as line, unnest(range(len(string_split(c, chr(10))))) as i from d
), h as (select row_no, i, sha256(trim(line)) as digest from l where trim(line) <> ''
), m as (select row_no, string_agg(license_id, ',' order by i) as listed, count(*) as n from h join k using (digest) group by 1
), g as (select row_no, doc_id, sha256({_sql_joined('c')}) as text_digest from d)
select doc_id, text_digest, license_id, coalesce(listed, '') as line_licenses, coalesce(n, 0) as n_license_lines from g left join k on text_digest = digest left join m using (row_no)
"""
