"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Everything runs as built-in column functions. A text's words (a-z, 0-9; A-Z lower-cased) give its 3-word shingles. Templates
are notices and license bodies.

* Bodies (``BODY`` words on) are retrieved by windows of ``WINDOW`` words that start every ``STEP`` words. Of a window's
  shingles, ``ROWS * BANDS`` MinHash values are taken (one seeded hash each) and joined, ``ROWS`` to a band. A template is cut
  into windows at every word, so that each window of a copy meets its like whatever the offset. Windows of Jaccard
  similarity j share a band with probability 1 - (1 - j ** ROWS) ** BANDS (``chance``): 1 for equal ones, 0.98 for j = 0.8.
  A copy of a body holds at least (BODY - WINDOW) / STEP windows, each with a chance of its own.
* Notices are shorter than two windows; for them a window is one shingle and its MinHash the shingle's hash, so a notice
  of which any shingle is left is always retrieved.

A retrieved template is verified in every region that the window may lie in: regions of 2c words that start every c words,
c being the least of ``CLASSES`` (numbers of words) that holds the template, so any run of c words lies whole in one. At
least ``PERCENT`` per cent of the template's distinct shingles must be in the region.

Defined cases: a null text counts as empty and has no license; rows that repeat an id report together; rows without
an id report under null; case (A-Z) and all characters but a-z and 0-9 are ignored; extra columns play no part; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import texts

K, PERCENT = 3, 80
CLASSES = (8, 16, 32, 64, 128, 256)
BODY, WINDOW, STEP, ROWS, BANDS = 48, 16, 8, 2, 4

#: Public license notices and license bodies.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-redistribution": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "All-rights-reserved": "All rights reserved",
    "MIT-body": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause-body": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
        TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-body": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
        OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-body": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
        marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
        source distribution.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
        to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "Unlicense-body": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
        any and all copyright interest in the software to the public domain.""",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() and c.isascii() else " " for c in text.lower()).split()


def template_shingles(text: str) -> list[str]:
    w = template_words(text)
    return sorted({" ".join(w[i : i + K]) for i in range(len(w) - K + 1)})


def least(text: str) -> int:
    """Shingles of a template that a window must hold."""
    return -(-PERCENT * len(template_shingles(text)) // 100)


def size_class(text: str) -> int:
    return next(c for c in CLASSES if len(template_words(text)) <= c)


def chance(j: float) -> float:
    """Probability that two windows of Jaccard similarity j share a band."""
    return 1 - (1 - j**ROWS) ** BANDS


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: an expression inside a lambda would be worked out for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def _shingles(words: Column) -> Column:
    at = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (K - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(K)), " "))
    return _let(words, lambda w: F.when(F.size(w) >= K, F.array_distinct(at(w))).otherwise(F.array().cast("array<string>")))


def _hashes(words: Column) -> Column:
    """Hash of the shingle at every word; words: a variable, not an expression."""
    at = F.transform(F.sequence(F.lit(0), F.size(words) - K), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(K)]))
    return F.when(F.size(words) >= K, at).otherwise(F.array().cast("array<bigint>"))


_NONE = "array<struct<pos:int,band:bigint>>"


def _noted(hashes: Column) -> Column:
    """Windows of notices: (pos, band) of every shingle."""
    return F.transform(hashes, lambda x, i: F.struct(i.alias("pos"), x.alias("band")))


def _banded(hashes: Column, step: int) -> Column:
    """Windows of bodies: (pos, band) of each band of each window of WINDOW words that starts at a multiple of step."""
    shingles = WINDOW - K + 1
    starts = F.sequence(F.lit(0), F.size(hashes) - shingles, F.lit(step))

    def least(seed: int) -> Column:
        return _let(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(seed))), lambda p: F.transform(starts, lambda s: F.array_min(F.slice(p, s + 1, F.lit(shingles)))))

    out = []
    for b in range(BANDS):
        row = F.transform(least(b * ROWS), lambda x: F.xxhash64(F.lit(b), x))  # noqa: B023
        for r in range(1, ROWS):
            row = F.zip_with(row, least(b * ROWS + r), lambda x, y: F.xxhash64(x, y))
        out.append(F.transform(row, lambda x, i: F.struct((i * step).alias("pos"), x.alias("band"))))
    return F.when(F.size(hashes) >= shingles, F.concat(*out)).otherwise(F.array().cast(_NONE))


def template_bands(table: DataFrame) -> DataFrame:
    """license, class, band: the bands of every template, a bounded list: at most BANDS for each word."""
    words = F.col("words")
    notices = table.where(F.size("words") < BODY).select("license", "class", F.explode(F.transform(_let(words, _hashes), lambda x: x)).alias("band"))
    bodies = table.where(F.size("words") >= BODY).select("license", "class", F.explode(_let(_let(words, _hashes), lambda h: _banded(h, 1))).alias("b"))
    return notices.unionByName(bodies.select("license", "class", F.col("b.band").alias("band"))).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license: doc_id, license, window_start (word from which the first region that verifies starts), n_windows (regions that do), shared (most shingles of the template in one)."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(t, size_class(x), template_words(x), template_shingles(x), least(x)) for t, x in TEMPLATES.items()], "license string, class int, words array<string>, template array<string>, least int")
    bands = template_bands(table)
    hashes = _let(_words(F.col("text")), _hashes)
    rows = texts(docs, id_col, text_col).where("text != ''")
    windows = rows.select("doc_id", "text", F.explode(_let(hashes, lambda h: F.concat(_noted(h), _banded(h, STEP)))).alias("w"))
    met = windows.select("doc_id", "text", F.col("w.pos").alias("pos"), F.col("w.band").alias("band")).join(F.broadcast(bands), "band")
    region = F.floor(F.col("pos") / F.col("class")).cast("int")
    # A region is verified once, however many of its windows meet the template; texts without a hit are gone by now.
    once = met.select("doc_id", "text", "license", F.explode(F.array(region, region - 1)).alias("region")).where("region >= 0").distinct()
    listed = once.groupBy("doc_id", "text").agg(F.collect_list(F.struct("license", "region")).alias("found"))
    cut = listed.select("doc_id", _words(F.col("text")).alias("words"), "found").select("doc_id", "words", F.explode("found").alias("f"))
    placed = cut.select("doc_id", "words", "f.license", "f.region").join(F.broadcast(table.select("license", "class", "template", "least")), "license").where(F.col("region") * F.col("class") < F.size("words"))
    start = F.col("region") * F.col("class")
    shared = F.size(F.array_intersect(_shingles(F.slice("words", start + 1, 2 * F.col("class"))), F.col("template")))
    verified = placed.select("doc_id", "license", start.alias("start"), shared.alias("shared"), "least").where("shared >= least")
    once = verified.groupBy("doc_id", "license", "start").agg(F.max("shared").alias("shared"))
    return once.groupBy("doc_id", "license").agg(F.min("start").cast("long").alias("window_start"), F.count("*").alias("n_windows"), F.max("shared").cast("long").alias("shared"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the licenses of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    rows = ", ".join(f"('{t}', {size_class(x)}, {least(x)}, [{', '.join(f"'{s}'" for s in template_shingles(x))}])" for t, x in TEMPLATES.items())
    classes = ", ".join(f"({c})" for c in CLASSES)
    return f"""
WITH templates(license, class, least, template) AS (VALUES {rows}),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') AS w FROM documents),
starts AS (SELECT doc_id, class, w, unnest(range(0, len(w), class)) AS start FROM words, (VALUES {classes}) AS c(class)),
windows AS (SELECT doc_id, class, start, w[start + 1 : start + 2 * class] AS v FROM starts),
shingled AS (SELECT doc_id, class, start, list_distinct([array_to_string(v[i : i + {K - 1}], ' ') FOR i IN range(1, len(v) - {K - 2})]) AS shingles FROM windows),
shared AS (SELECT doc_id, license, start, least, len(list_intersect(shingles, template)) AS shared FROM shingled JOIN templates USING (class))
SELECT doc_id, license, CAST(min(start) AS BIGINT) AS window_start, count(*) AS n_windows, CAST(max(shared) AS BIGINT) AS shared
FROM shared WHERE shared >= least GROUP BY doc_id, license
"""


SQL = _sql()
