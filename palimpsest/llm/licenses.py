"""License scan: canonical digest lookup of entire texts.

scan_licenses(docs, catalog) normalises each whole text once (case, punctuation, white space, copyright lines,
equivalent spellings), line by line, digests the whole and joins the digest to those of known licence texts. The
normalised lines are digested too, within their row, as licence notices mostly stand on a line of their own; a line is
digested only if its length is that of a known text.

The catalog is fixed: short texts and notices as texts, long licences as digests of their published texts (digests() makes
them). Its size is proven: it is broadcast, and looked up in a map by lines. Other catalogs can be given as a DataFrame
(license_id, text) of any size; then Catalyst chooses the join, and lines are joined by the digests of their texts.

A copyright line begins with the word or sign and a year or another sign follows; other lines that begin with the word, as in
a wrapped text, stay.

Defined cases. Null text: an empty one. A text without letters or digits (or with copyright lines only): no digest and
no licence. Two catalog texts with the same digest: the smaller license_id. Repeated rows, and rows of one or of no doc_id: each
gets its own. Very long texts are normalised whole. Other columns, whatever their names, are ignored. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import literal_table, table

# Short licence texts and standard notices, as published.
KNOWN = (
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)
# Titles that may stand above a text.
TITLES = (
    ("0BSD", "BSD Zero Clause License"),
    ("0BSD", "Zero-Clause BSD"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Zlib", "zlib License"),
)
# Digests of long licences as published, made by digests().
DIGESTS = (
    ("Apache-2.0", 8870, "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Apache-2.0", 9886, "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Artistic-1.0-Perl", 5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", 6698, "0c3e4ca5ed7ced6289d3f5d9a83e4100f9f34d87983b17dc5865376a8a0a98f3"),
    ("GFDL-1.2", 18386, "84f3c9e8cdded0036378e7e6eb92ac6570731434d2fc46027f259264dc16501e"),
    ("GFDL-1.2", 19583, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", 20821, "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90"),
    ("GFDL-1.3", 22018, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", 9415, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", 9424, "7843068060f4d9ee30736221ce49abf6cb7dafa9b775fabb47fbf0c21e05b102"),
    ("GPL-1.0", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", 14483, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", 30968, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", 22277, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22447, "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", 14354, "2d37b31e2677d81ad128e61fc173ef1c2228dd0711022682ff745f3c65afac58"),
)
# Spellings that count as the same, in lower case and with blanks for punctuation.
SAME = (
    ("licence", "license"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    (" v ", " version "),
    ("https ", "http "),
)
#: Capitals, and ASCII characters that are neither letters, digits nor line ends.
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum() and chr(c) not in " \n")
_TO = "abcdefghijklmnopqrstuvwxyz" + " " * (len(_FROM) - 26)
#: A normalised line that names a holder of rights.
COPYRIGHT = "^(copyright (c |©|by |[0-9]{4}|yyyy|year)|c (copyright|[0-9]{4}|yyyy|year)|©|all rights reserved$)"


def lines_of(text: Column) -> Column:
    """The lines that are left of a text: ASCII lower case, blanks for punctuation, one spelling, no copyright lines."""
    text = F.translate(F.coalesce(text, F.lit("")), _FROM, _TO)
    text = F.regexp_replace(text, "  +", " ")
    for other, one in SAME:
        text = F.replace(text, F.lit(other), F.lit(one))
    marked = lambda x: x.startswith("c") | x.startswith("©") | x.startswith("all")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~(marked(x) & x.rlike(COPYRIGHT)))


def digest(lines: Column) -> Column:
    whole = F.array_join(lines, " ")
    return F.when(whole != "", F.sha2(whole, 256))


def digests(catalog: DataFrame) -> DataFrame:
    """catalog: license_id, text. Returns license_id, size (characters in normal form), digest."""
    lines = catalog.select("license_id", lines_of(F.col("text")).alias("lines"))
    return lines.select("license_id", F.length(F.array_join("lines", " ")).alias("size"), digest(F.col("lines")).alias("digest")).where("digest is not null")


def fixed_catalog(spark: SparkSession) -> DataFrame:
    titled = tuple((i, f"{title}\n{text}") for i, title in TITLES for j, text in KNOWN if i == j and "\n" in text)
    long = literal_table(spark, ("license_id", "size", "digest"), DIGESTS)
    return digests(literal_table(spark, ("license_id", "text"), KNOWN + titled)).unionByName(long)


def scan_licenses(docs: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (of the whole text; null if empty), license_id (of the whole text, or null), line_licenses
    array<string> (those of single lines, sorted, distinct)."""
    known = fixed_catalog(docs.sparkSession) if catalog is None else digests(catalog)
    known = known.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.first("size").alias("size"))
    lines = docs.select("doc_id", lines_of(F.col("text")).alias("lines"))
    none = F.array().cast("array<string>")
    if catalog is None:
        # One row: a map of the fixed catalog, whose lengths say which lines are worth a digest.
        rows = sorted((r["size"], r["digest"], r["license_id"]) for r in known.collect())
        of = F.create_map(*(F.lit(x) for _, d, i in rows for x in (d, i)))
        worth = F.filter("lines", lambda x: F.length(x).isin(sorted({n for n, *_ in rows})))
        named = F.filter(F.transform(worth, lambda x: of[F.sha2(x, 256)]), lambda i: i.isNotNull())
        found = lines.select("doc_id", digest(F.col("lines")).alias("digest"), F.array_sort(F.array_distinct(named)).alias("line_licenses"))
        return found.join(F.broadcast(known.select("digest", "license_id")), "digest", "left").select("doc_id", "digest", "license_id", "line_licenses")
    whole = lines.select("doc_id", "lines", digest(F.col("lines")).alias("digest"))
    line = whole.select("digest", F.explode(F.array_distinct("lines")).alias("line")).select(F.col("digest").alias("of"), F.sha2("line", 256).alias("digest"))
    held = line.join(known, "digest").groupBy(F.col("of").alias("digest")).agg(F.sort_array(F.collect_set("license_id")).alias("line_licenses"))
    found = whole.select("doc_id", "digest").join(known.select("digest", "license_id"), "digest", "left").join(held, "digest", "left")
    return found.select("doc_id", "digest", "license_id", F.coalesce("line_licenses", none).alias("line_licenses"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license_id", F.array_join("line_licenses", ",").alias("line_licenses"))


def _sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def chars(x: str) -> str:
        return " || ".join(quoted(c) if c.isprintable() else f"chr({ord(c)})" for c in x)

    def norm(column: str) -> str:
        out = f"regexp_replace(translate(coalesce({column}, ''), {chars(_FROM)}, {quoted(_TO)}), '  +', ' ', 'g')"
        for other, one in SAME:
            out = f"replace({out}, {quoted(other)}, {quoted(one)})"
        return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, {quoted(COPYRIGHT)}))"

    texts = KNOWN + tuple((i, f"{title}\n{text}") for i, title in TITLES for j, text in KNOWN if i == j and "\n" in text)
    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in texts)
    long = ", ".join(f"({quoted(i)}, '{d}')" for i, _, d in DIGESTS)
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256(array_to_string({norm("text")}, ' ')) AS digest FROM (VALUES {known}) AS k(license_id, text)
    UNION ALL SELECT * FROM (VALUES {long}) AS k(license_id, digest)) GROUP BY 1),
whole AS (
  SELECT doc_id, lines, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END AS digest FROM (SELECT doc_id, {norm("text")} AS lines FROM documents)),
hits AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses
  FROM (SELECT doc_id, unnest(lines) AS line FROM whole) l JOIN known ON sha256(l.line) = known.digest GROUP BY doc_id)
SELECT whole.doc_id, whole.digest, license_id, coalesce(line_licenses, '') AS line_licenses
FROM whole LEFT JOIN known ON whole.digest = known.digest LEFT JOIN hits ON hits.doc_id = whole.doc_id"""


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE_SQL = {"op6_license_scan": _sql()}
