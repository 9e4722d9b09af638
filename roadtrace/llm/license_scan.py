r"""Licence scans by sparse TF-IDF cosine to templates, then inheritance along paths, with SQL functions only.

The notice of a document is every line of its whole text that has a marker word (licence, copyright, SPDX, warranty).
Terms are ``[a-z0-9]+(\.[0-9]+)*`` of the lower-cased notice. Inverse frequencies are those of the templates; a term
that no template has gets the largest one, so foreign words lower the cosine. The best template from ``LEAST`` up is the
document's own licence (ties: the smaller name).

A document is a licence file if its name says so or its notice holds at least half of its words. The best licence of a
directory's licence files (highest cosine, then name) holds for the directory; a document without a licence of its own
takes that of its nearest ancestor directory. Directories, not documents, are joined with their ancestors, and each
distinct notice is scored once, so a licence line that a third of all documents share costs one scoring.

The templates are a parameter, inlined as a local table, and broadcast up to ``MAX_TERMS`` terms.

With ``pieces`` a document is scored by parts: each marker line, each paragraph with a marker and the whole text are
notices of their own, and the best one counts, so a header stands out beside copyright lines and code. ``FULL`` adds
SPDX ids, standard headers, title paragraphs and the full texts of the short licences; a name's part after a colon only
tells its templates apart.

Defined cases: null text has no notice; a null path has no directory and neither gives nor takes a licence; ids may
repeat or be null; an empty table gives no rows; other columns stay out of the result unless named in ``keep``, where one with the name
of an output is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = r"(?i)licen[cs]|copyright|spdx|warrant"
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: What parts paragraphs: a line without a letter or digit.
PARAGRAPH = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
PARAGRAPH_SQL = f"regexp_split_to_array(body, '{PARAGRAPH}')"
LEAST = 0.6
#: Template terms up to which they are broadcast; beyond, terms meet by a shuffle.
MAX_TERMS = 10_000
#: Tasks to which the rows of one notice are dealt.
SALTS = 16

#: Usual notices of common licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd-3-clause": "Redistribution and use permitted under the BSD 3-Clause License",
    "cc-by-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "mit": "Released under the MIT License",
    "mpl-2.0": "Subject to the terms of the Mozilla Public License, version 2.0",
}

_ANY_KIND = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_FULL = f"MIT License Copyright (c) {_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_ANY_KIND}"
_BSD = "Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NEITHER = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
_APACHE_END = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_SPDX = {n: [n] for n in ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc-by-4.0", "cc-by-nc-4.0", "cc-by-sa-4.0", "cc0-1.0", "isc", "mit", "mpl-2.0")} | {n: [n, f"{n}-only", f"{n}-or-later"] for n in ("gpl-2.0", "gpl-3.0", "lgpl-3.0")}

#: ``TEMPLATES`` with SPDX ids, standard headers, title paragraphs and full texts.
FULL = (
    TEMPLATES
    | {f"{name}:spdx{i}": f"SPDX-License-Identifier: {v}" for name, ids in _SPDX.items() for i, v in enumerate(ids)}
    | {
        "apache-2.0:header": _APACHE,
        "apache-2.0:notice": f"{_APACHE} http://www.apache.org/licenses/LICENSE-2.0 {_APACHE_END}",
        "apache-2.0:title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "bsd-2-clause:title": "BSD 2-Clause License",
        "bsd-2-clause:text": f"{_BSD} {_BSD_END}",
        "bsd-3-clause:title": "BSD 3-Clause License",
        "bsd-3-clause:names": _NEITHER,
        "bsd-3-clause:text": f"{_BSD} {_NEITHER} {_BSD_END}",
        "gpl-2.0:header": _GNU.format("program", "", "2"),
        "gpl-2.0:title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "gpl-3.0:header": _GNU.format("program", "", "3"),
        "gpl-3.0:title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "lgpl-3.0:header": _GNU.format("library", "Lesser ", "3"),
        "lgpl-3.0:title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "isc:title": "ISC License",
        "isc:text": f"ISC License Copyright (c) {_ISC}",
        "mit:title": "The MIT License (MIT)",
        "mit:grant": _MIT,
        "mit:text": _MIT_FULL,
        "mpl-2.0:header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mpl-2.0:title": "Mozilla Public License Version 2.0",
    }
)


def weights(templates: dict[str, str]) -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    """(term, licence, unit-length weight) rows, each term's inverse frequency, and that of a foreign term."""
    counts = {name: Counter(re.findall(TERM, text.lower())) for name, text in templates.items()}
    seen = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for name, c in counts.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(t, name, n * idf[t] / norm) for t, n in c.items()]
    return sorted(rows), idf, math.log(1 + len(counts)) + 1


def values(rows: list[tuple]) -> str:
    """A SQL VALUES list."""
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}D" for v in row) + ")" for row in rows)


def scored(spark: SparkSession, notices: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(key, licence, cosine) of the best template for each (key, notice)."""
    rows, idf, foreign = weights(templates)
    small = F.broadcast if len(rows) <= MAX_TERMS else (lambda t: t.hint("merge"))
    table = spark.sql(f"SELECT * FROM VALUES {values(rows)} AS t(term, license, weight)")
    known = spark.sql(f"SELECT * FROM VALUES {values(sorted(idf.items()))} AS t(term, idf)")
    terms = notices.select("key", F.explode(F.regexp_extract_all(F.lower("notice"), F.lit(TERM), F.lit(0))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("n"))
    terms = terms.join(small(known), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(foreign)))
    norms = terms.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(small(table), "term").groupBy("key", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosines = dots.join(norms, "key").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("cosine") >= LEAST)
    best = cosines.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best"))
    return best.select("key", F.substring_index("best.license", ":", 1).alias("license"), (-F.col("best.minus")).alias("cosine"))


def scored_pieces(spark: SparkSession, bodies: DataFrame, templates: dict[str, str]) -> DataFrame:
    """As ``scored`` for (key, body): the best of a body's marker lines, paragraphs with a marker, and whole text."""
    marked = lambda parts: F.filter(parts, lambda part: part.rlike(MARKER))
    # A line without a letter or digit ends a paragraph, also within a comment.
    paragraphs = F.split("body", PARAGRAPH)
    pieces = F.array_distinct(F.concat(marked(F.split("body", "\n", -1)), marked(paragraphs), F.array("body")))
    each = bodies.select(F.col("key").alias("__body"), F.explode(pieces).alias("notice")).withColumn("key", F.sha2("notice", 256))
    # Each distinct piece is scored once, whatever the number of texts that hold it.
    best = scored(spark, each.select("key", "notice").distinct(), templates)
    met = each.select("__body", "key").join(best, "key").groupBy("__body").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best"))
    return met.select(F.col("__body").alias("key"), F.col("best.license").alias("license"), (-F.col("best.minus")).alias("cosine"))


def scan_licenses(df: DataFrame, *, id_col: str, path: str, text: str = "text", keep: list[str] | None = None, templates: dict[str, str] = TEMPLATES, pieces: bool = False) -> DataFrame:
    """``keep`` columns (by default the id) with path, own_license, cosine, license and license_dir of each row.

    ``pieces``: the best of a text's lines, paragraphs and whole counts, not all its marker lines as one notice.
    """
    spark = df.sparkSession
    kept = [c for c in ([id_col] if keep is None else keep) if c not in ("path", "own_license", "cosine", "license", "license_dir")]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = F.when(body.rlike(MARKER), F.array_join(F.filter(F.split(body, "\n", -1), lambda line: line.rlike(MARKER)), "\n"))
    words = F.when(body.rlike(MARKER), F.size(F.filter(F.split(body, r"\s+"), lambda w: w != "")))
    scored_text = F.when(body.rlike(MARKER), body) if pieces else marked
    rows = df.select(*(F.col(c).alias(f"__keep_{i}") for i, c in enumerate(kept)), F.col(path).cast("string").alias("__path"), marked.alias("__notice"), words.alias("__words"), scored_text.alias("__scored"))
    directory = F.when(F.col("__path").contains("/"), F.regexp_replace("__path", "/[^/]*$", "")).otherwise(F.when(F.col("__path").isNotNull(), F.lit("")))
    # Rows without a notice spread over the join by a key of their own.
    rows = rows.withColumn("__dir", directory).withColumn("__key", F.when(F.col("__notice").isNotNull(), F.sha2("__scored", 256)).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id())))
    notices = rows.filter("__notice IS NOT NULL").select(F.col("__key").alias("key"), F.col("__scored").alias("body" if pieces else "notice")).distinct()
    rows = rows.drop("__scored")
    best = (scored_pieces if pieces else scored)(spark, notices, templates).select(F.col("key").alias("__key"), F.col("license").alias("own_license"), "cosine")
    # A notice that a third of all rows share is one key: it is dealt to SALTS tasks.
    best = best.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__path", *(f"__keep_{i}" for i in range(len(kept)))), F.lit(SALTS)).cast("int"))
    owned = rows.join(best, ["__key", "__salt"], "left")

    notice_words = F.size(F.filter(F.split("__notice", r"\s+"), lambda w: w != ""))
    is_file = F.col("__path").rlike(LICENSE_NAME) | (2 * notice_words >= F.col("__words"))
    files = owned.filter(F.col("own_license").isNotNull() & F.col("__dir").isNotNull() & is_file)
    held = files.groupBy("__dir").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "own_license")).alias("best"))
    held = held.select(F.col("__dir").alias("holder"), F.col("best.own_license").alias("dir_license"))
    # Each directory with itself and every ancestor, deepest first; "" is the top.
    parts = F.split("__dir", "/", -1)
    ancestors = F.expr("concat(transform(sequence(size(p), 1), k -> array_join(slice(p, 1, k), '/')), IF(__dir = '', array(), array('')))")
    above = rows.select("__dir").filter("__dir IS NOT NULL").distinct().withColumn("p", parts).select("__dir", F.posexplode(ancestors).alias("up", "holder"))
    nearest = above.join(held, "holder").groupBy("__dir").agg(F.min(F.struct("up", "dir_license", "holder")).alias("near"))
    nearest = nearest.select("__dir", F.col("near.dir_license").alias("__inherited"), F.col("near.holder").alias("__holder"))
    out = owned.join(nearest, "__dir", "left")
    return out.select(*(F.col(f"__keep_{i}").alias(c) for i, c in enumerate(kept)), F.col("__path").alias("path"), "own_license", "cosine", F.coalesce("own_license", "__inherited").alias("license"), F.when(F.col("own_license").isNull(), F.col("__holder")).alias("license_dir"))


def oracle(path_sql: str, templates: dict[str, str] = TEMPLATES, pieces: bool = False) -> str:
    """The same over ``documents`` in DuckDB."""
    rows, idf, foreign = weights(templates)
    parts = "SELECT rid, 0 AS pid, notice FROM m"
    if pieces:
        marked = lambda split: f"list_filter({split}, lambda x: regexp_matches(x, '{MARKER}'))"
        lists = rf"list_distinct({marked('string_split(body, chr(10))')} || {marked(PARAGRAPH_SQL)} || [body])"
        parts = f"SELECT rid, row_number() OVER () AS pid, notice FROM (SELECT rid, unnest({lists}) AS notice FROM d WHERE regexp_matches(body, '{MARKER}'))"
    plain = lambda r: values(r).replace("D)", ")")
    return rf"""
WITH t(term, license, weight) AS (VALUES {plain(rows)}),
k(term, idf) AS (VALUES {plain(sorted(idf.items()))}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {path_sql} AS path, coalesce(text, '') AS body FROM documents),
m AS (SELECT rid, array_to_string(list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '{MARKER}')), chr(10)) AS notice, len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')) AS words
  FROM d WHERE regexp_matches(body, '{MARKER}')),
p AS ({parts}),
terms AS (SELECT rid, pid, term, count(*) AS n FROM (SELECT rid, pid, unnest(regexp_extract_all(lower(notice), '{TERM}')) AS term FROM p) GROUP BY 1, 2, 3),
w AS (SELECT rid, pid, term, n * coalesce(idf, {foreign!r}) AS w FROM terms LEFT JOIN k USING (term)),
c AS (SELECT rid, pid, license, round(sum(w * weight) / any_value(norm), 6) AS cosine FROM w JOIN t USING (term) JOIN (SELECT rid, pid, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1, 2) USING (rid, pid) GROUP BY 1, 2, 3),
each AS (SELECT rid, string_split(license, ':')[1] AS own_license, cosine FROM c WHERE cosine >= {LEAST} QUALIFY row_number() OVER (PARTITION BY rid, pid ORDER BY cosine DESC, license) = 1),
best AS (SELECT rid, own_license, cosine FROM each QUALIFY row_number() OVER (PARTITION BY rid ORDER BY cosine DESC, own_license) = 1),
o AS (SELECT d.*, own_license, cosine, notice, words, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') WHEN path IS NOT NULL THEN '' END AS dir FROM d LEFT JOIN best USING (rid) LEFT JOIN m USING (rid)),
held AS (SELECT dir, own_license AS dir_license FROM o WHERE own_license IS NOT NULL AND dir IS NOT NULL AND (regexp_matches(path, '{LICENSE_NAME}') OR 2 * len(list_filter(regexp_split_to_array(notice, '\s+'), lambda w: w <> '')) >= words)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, own_license) = 1),
near AS (SELECT x.dir, h.dir AS license_dir, dir_license FROM (SELECT DISTINCT dir FROM o) x JOIN held h ON x.dir = h.dir OR h.dir = '' OR starts_with(x.dir, h.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY x.dir ORDER BY length(h.dir) DESC) = 1)
SELECT doc_id, path, own_license, cosine, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NULL THEN license_dir END AS license_dir
FROM o LEFT JOIN near ON near.dir = o.dir
"""
