"""Licence scan: look up canonical digests of entire texts.

A text's canonical form is lower case, without lines that begin as copyright
lines, with every run of other characters than a-z and 0-9 as one space, and
with one spelling for equivalent ones. Its SHA-256 is looked up among the digests
of known licence texts by a join. The entire text of a document is looked up, and
so is the entire text of each of its lines, for notices of one line.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from importlib import resources

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, whole_text

_COPYRIGHT = r"(^|\n)[ \t/*#;<!-]*(copyright|\(c\)|©)[^\n]*"
_OTHER = "[^a-z0-9]+"
_COPYRIGHT_LINES, _OTHERS = re.compile(_COPYRIGHT), re.compile(_OTHER)
#: Spellings that count as the same.
SPELLINGS = (
    ("licenc", "licens"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authoriz", "authoris"),
    ("behaviour", "behavior"),
    ("centre", "center"),
    ("colour", "color"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("honour", "honor"),
    ("labour", "labor"),
    ("organiz", "organis"),
    ("recogniz", "recognis"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: Public licence texts and one-line notices, by SPDX identifier.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC + _AS_IS),
    ("ISC", "ISC License\n" + _ISC + _AS_IS),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "") + _AS_IS),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_NAME + _BSD_END),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0-or-later", _GNU),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

#: Short licences with the titles that stand over them.
SHORT = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), _MIT),
    ("ISC", ("ISC License", "The ISC License"), _ISC + _AS_IS),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"), _BSD_2 + _BSD_END),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License"), _BSD_2 + _BSD_NAME + _BSD_END),
)
_END, _WRAPPED = re.compile("END OF TERMS AND CONDITIONS"), re.compile(r"(?<=\S)[ \t]*\n(?=[ \t]*\S)")


def canonical(text: str) -> str:
    """Canonical form of a whole text; empty if nothing is left."""
    text = text.lower()
    if "copyright" in text or "(c)" in text or "©" in text:
        text = _COPYRIGHT_LINES.sub(r"\1", text)
    text = _OTHERS.sub(" ", text) + " "
    for spelling, same in SPELLINGS:
        text = text.replace(spelling, same)
    return text.strip(" ")


def _digest(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()


def entire_texts() -> list[tuple[str, str]]:
    """Licences as they are found in LICENSE files, by SPDX identifier.

    Long ones come from files of the package: as they stand and with paragraphs
    in one line (a wrapped line can begin with "copyright"), with and without
    what follows the terms, with http and https. Short ones come with their
    titles and with "All rights reserved." below the copyright lines. GNU texts
    don't say "only" or "or later", and so have the names without.
    """
    out = []
    for path in sorted((resources.files(__package__) / "license_texts").iterdir(), key=lambda p: p.name):
        if path.name.endswith(".txt"):
            text = path.read_text(encoding="utf-8")
            bodies = [text, text[: m.end()] if (m := _END.search(text)) else text]
            bodies += [_WRAPPED.sub(" ", b) for b in bodies]
            bodies += [b.replace(x, y) for b in bodies for x, y in (("http://", "https://"), ("https://", "http://"))]
            out += [(path.name.removesuffix(".txt"), b) for b in bodies]
    for name, titles, body in SHORT:
        out += [(name, title + "\n" + reserved + body) for title in ("", *titles) for reserved in ("", "All rights reserved.\n", "All rights reserved.\n" * 2)]
    return out


def known_digests(spark: SparkSession, texts=None) -> DataFrame:
    """``(license, text)`` pairs, or all known ones -> ``(digest, license, size)``; the first name alphabetically if a text has several."""
    forms = {(name, canonical(text)) for name, text in ((*KNOWN, *entire_texts()) if texts is None else texts)}
    rows = spark.createDataFrame([(_digest(c), name, len(c)) for name, c in forms if c], "digest string, license string, size int")
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.max("size").alias("size"))


_DIGESTS = "doc_id string, digest string, lines array<string>"


def _digests(batches: Iterator[pd.DataFrame], sizes: frozenset[int]) -> Iterator[pd.DataFrame]:
    """Digest of each text, and of its lines whose canonical form is as long as a known one."""
    least = min(sizes, default=1 << 62)
    for pdf in batches:
        out = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            # a form has at most as many letters as its line, but for the few that spellings add
            forms = (canonical(line) for line in text.split("\n") if len(line) >= least - 8)
            out.append((doc_id, _digest(canonical(text)), [_digest(c) for c in forms if c and len(c) in sizes]))
        yield pd.DataFrame(out, columns=["doc_id", "digest", "lines"])


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Licences of every row of ``docs(doc_id, text, ...)``.

    Returns doc_id, digest (of the canonical whole text), license (of the whole
    text, or null), n_notices (lines that are a known text in themselves) and
    notices (their licences, each once, sorted, comma-joined; empty if none).
    Null text counts as empty; an empty canonical form matches nothing; a null
    doc_id stays null; repeated rows each get a row; an empty table gives an empty
    result; other columns are ignored. ``known(digest, license, size)`` may be of
    any size: Spark broadcasts it only below its size limit.
    """
    bounded_batches(docs.sparkSession)
    known = known_digests(docs.sparkSession) if known is None else known
    sizes = frozenset(r["size"] for r in known.select("size").distinct().collect())  # at most the longest known text's length
    known = known.select("digest", "license")
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"))
    found = cut(texts.mapInPandas(lambda it: _digests(it, sizes), _DIGESTS)).withColumn("row", F.monotonically_increasing_id())  # stable: the checkpoint fixes rows and partitions
    lines = found.select("row", F.explode("lines").alias("digest")).join(known, "digest")
    notices = lines.groupBy("row").agg(F.count(F.lit(1)).alias("n_notices"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    return (
        found.select("row", "doc_id", "digest")
        .join(known, "digest", "left")
        .join(notices, "row", "left")
        .select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
    )


def _sql_canonical(value: str) -> str:
    out = f"regexp_replace(lower({value}), '{_COPYRIGHT}', '\\1', 'g')"
    out = f"regexp_replace({out}, '{_OTHER}', ' ', 'g') || ' '"
    for spelling, same in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{same}')"
    return f"trim({out})"


def oracle_sql() -> str:
    """The same rows over ``documents`` for DuckDB."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    titled = ", ".join(f"({quoted(name)}, {quoted(title + chr(10))}, {quoted(body)})" for name, titles, body in SHORT for title in ("", *titles))
    folder = str(resources.files(__package__) / "license_texts")
    wrapped = r"regexp_replace(body, '(\S)[ \t]*\n([ \t]*\S)', '\1 \2', 'g')"
    return f"""
WITH files AS (SELECT regexp_extract(filename, '([^/]+)[.]txt$', 1) AS license, content AS body FROM read_text('{folder}/*.txt')),
terms AS (SELECT license, body FROM files UNION ALL SELECT license, body[:strpos(body, 'END OF TERMS AND CONDITIONS') + 26] FROM files WHERE contains(body, 'END OF TERMS AND CONDITIONS')),
once AS (SELECT license, {wrapped} AS body FROM terms),
shapes AS (SELECT license, body FROM terms UNION ALL SELECT license, {wrapped} FROM once),
entire AS (
  SELECT license, unnest([body, replace(body, 'http://', 'https://'), replace(body, 'https://', 'http://')]) AS body FROM shapes
  UNION ALL SELECT license, unnest([title || body, title || 'All rights reserved.' || chr(10) || body, title || repeat('All rights reserved.' || chr(10), 2) || body]) FROM (VALUES {titled}) t(license, title, body)
  UNION ALL SELECT * FROM (VALUES {values}) t(license, body)),
known AS (SELECT sha256(c) AS digest, min(license) AS license FROM (SELECT license, {_sql_canonical("body")} AS c FROM entire) WHERE c <> '' GROUP BY 1),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
lines AS (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM docs),
hits AS (
  SELECT rid, count(*) AS n_notices, array_to_string(list_sort(list_distinct(list(k.license))), ',') AS notices
  FROM lines JOIN known k ON sha256({_sql_canonical("line")}) = k.digest GROUP BY rid)
SELECT d.doc_id, sha256({_sql_canonical("d.body")}) AS digest, k.license, coalesce(h.n_notices, 0)::BIGINT AS n_notices, coalesce(h.notices, '') AS notices
FROM docs d LEFT JOIN known k ON k.digest = sha256({_sql_canonical("d.body")}) LEFT JOIN hits h ON h.rid = d.rid
"""
