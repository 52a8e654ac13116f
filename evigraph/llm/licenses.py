"""License scans (operator 9); DataFrame functions only.

Notices, headers and licence files are compared to license templates by the cosine of sparse TF-IDF vectors.  The units of
every whole text are its lines, its blocks (paragraphs: a comment header over several lines is one, comment marks are no
words) and, for a licence file, the whole file.  The templates are notices, headers, titles and opening paragraphs, and full
texts where they are short; further full texts can be given (``full_texts``).  Document frequencies are counted over all
documents, for the templates' words and for those of the units compared.  Texts, and then units, whose words cannot reach the
threshold with any template are passed over before they are cut into counted words; this loses nothing.

A file's own license is that of its best unit; "All rights reserved." alone is one only where no unit says more.  A file without one inherits from the nearest directory at or above its
own that holds a licence file with a license: directories (far fewer than files) are joined to their
ancestors, then files to directories.

Rows: null and empty texts have no own license; a null path inherits nothing and is no licence file; rows of one key are one
file (the best unit of all of them, each row answered); ties go to the smaller license name, and among a
directory's licence files to the higher score, then the larger license name; an empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm._store import stage

#: Notices, headers, titles and texts of public licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-2-clause", "BSD 2-Clause License"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "BSD 3-Clause License"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "ISC License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("lgpl-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "MIT License"),
    ("mit", "The MIT License (MIT)"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("proprietary", "All rights reserved."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
#: Notices that many licences carry besides their own terms: they count only where nothing else is found.
WEAK = ("proprietary",)
#: Full texts that a folder may give.
MOST_TEXTS = 1000
LICENSE_FILE = r"(?i)^(LICEN[CS]E|COPYING|NOTICE|UNLICENSE)(\.(txt|md|rst))?$"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Between two blocks: a line end and lines without letter or digit.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def full_texts(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Templates from a folder of licence texts, named by their file names; more than ``MOST_TEXTS`` are an error."""
    read = spark.read.text(folder, wholetext=True).select(F.lower(F.regexp_extract(F.input_file_name(), "([^/]+?)(?:[.](?:txt|md))?$", 1)), "value")
    rows = read.limit(MOST_TEXTS + 1).collect()
    if len(rows) > MOST_TEXTS:
        raise ValueError(f"more than {MOST_TEXTS} licence texts in {folder}")
    return sorted((name, text) for name, text in rows)


def _idf(n: int, df: Column) -> Column:
    return F.log(F.lit(n + 1) / (df + 1)) + 1


def _template_weights(df: DataFrame, text: str, templates: Sequence[tuple[str, str]]) -> tuple[list[dict[str, float]], dict[str, float], int]:
    """Unit TF-IDF vectors of the templates, the inverse frequencies of their words, and the number of documents.
    What is gathered is one number for each template word."""
    rows = df.sparkSession.createDataFrame([(i, t) for i, (_, t) in enumerate(templates)], "i int, notice string")
    counts = {(r.i, r.word): r.n for r in rows.select("i", F.explode(terms(F.col("notice"))).alias("word")).groupBy("i", "word").agg(F.count("*").alias("n")).collect()}
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, w in counts})])
    seen = df.select(F.explode(F.array_intersect(terms(F.col(text)), vocabulary)).alias("word")).groupBy("word").count()
    found = dict(seen.collect())
    n = df.count()
    idf = {w: math.log((n + 1) / (found.get(w, 0) + 1)) + 1 for _, w in counts}
    vectors: list[dict[str, float]] = [{} for _ in templates]
    for (i, word), c in sorted(counts.items()):
        vectors[i][word] = c * idf[word]
    for v in vectors:
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        v.update({w: x / norm for w, x in v.items()})
    return vectors, idf, n


def _near(text: Column, vectors: Sequence[dict[str, float]], threshold: float) -> Column:
    """Whether a text's words can be near a template: its cosine is at most the length of the template's part that it
    shares, here taken over all templates at once.  What holds for a whole text's words holds for each of its units."""
    words = sorted({w for v in vectors for w in v})
    return _worth(terms(text), words, vectors) >= threshold**2 - 1e-9


def _worth(found: Column, words: list[str], vectors: Sequence[dict[str, float]]) -> Column:
    square = F.create_map(*[F.lit(x) for w in words for x in (w, max(v.get(w, 0.0) for v in vectors) ** 2)])
    return F.aggregate(F.array_intersect(found, F.array(*map(F.lit, words))), F.lit(0.0), lambda total, w: total + F.try_element_at(square, w))


def _unit_near(found: Column, vectors: Sequence[dict[str, float]], idf: dict[str, float], threshold: float) -> Column:
    """Whether a unit can be near a template.  With p the squared length of its part of template words, and at least 1 for
    every other word (no inverse frequency is under 1), its squared cosine is at most worth x p / (p + other words)."""
    words = sorted(idf)
    known = F.array(*map(F.lit, words))
    weight = F.create_map(*[F.lit(x) for w in words for x in (w, idf[w])])
    part = F.aggregate(F.array_intersect(found, known), F.lit(0.0), lambda total, w: total + F.pow(F.size(F.filter(found, lambda x: x == w)) * F.try_element_at(weight, w), F.lit(2.0)))
    worth = F.least(F.lit(1.0), _worth(found, words, vectors))
    return worth * part >= threshold**2 * (part + F.size(F.array_except(found, known))) - 1e-6


def _units(df: DataFrame, key: str, text: str, path: str | None) -> DataFrame:
    """key, kind (line, block, file), no, of (hash), terms."""

    def as_units(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("no"), F.xxhash64(x).alias("of"), terms(x).alias("terms")))

    whole = F.col(text)
    found = [as_units("line", F.split(whole, "\n")), as_units("block", F.split(whole, BLANK))]
    if path:
        named = F.coalesce(F.regexp_extract(path, "([^/]*)$", 1).rlike(LICENSE_FILE), F.lit(False))
        found.append(as_units("file", F.when(named, F.array(whole)).otherwise(F.array().cast("array<string>"))))
    return df.where(whole.isNotNull()).select(F.col(key).alias("key"), F.explode(F.concat(*found)).alias("u")).select("key", "u.*")


def license_units(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
    templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.75,
) -> DataFrame:
    """key, kind, no, license, score: units at or above the threshold with their best template's license."""
    vectors, idf, n = _template_weights(df, text, templates)
    kept = [c for c in dict.fromkeys((key, text, path)) if c]
    units = _units(df.select(*kept).where(_near(F.col(text), vectors, threshold)), key, text, path)
    units = units.where(_unit_near(F.col("terms"), vectors, idf, threshold))
    words = units.select("key", "kind", "no", "of", F.explode("terms").alias("word"))
    unit = ["key", "kind", "no", "of"]
    counted = stage(words.groupBy(*unit, "word").agg(F.count("*").cast("double").alias("tf")), "license-words")
    weight = F.create_map(*[F.lit(x) for w, v in sorted(idf.items()) for x in (w, v)])
    others = stage(counted.where(~F.col("word").isin(*idf)).select("word").distinct(), "license-others")
    # Counted before the join: a task's words meet in its partial counts, and no single occurrence is exchanged.
    seen = df.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    seen = seen.join(others, "word").select("word", _idf(n, F.col("df")).alias("idf"))
    weighed = counted.join(seen, "word", "left").withColumn("w", F.col("tf") * F.coalesce(weight[F.col("word")], F.col("idf")))
    # One array of (template, weight) for each template word, so that a unit's products are made in its one group.
    by_word = {w: [(i, v[w]) for i, v in enumerate(vectors) if w in v] for w in idf}
    rows = df.sparkSession.createDataFrame([(w, i, x) for w, at in by_word.items() for i, x in at], "word string, template int, u double")
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.where(F.col("word").isin(*idf)).join(F.broadcast(rows), "word").groupBy(*unit, "template").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    same = F.col("d.key").eqNullSafe(F.col("n.key")) & (F.col("d.kind") == F.col("n.kind")) & (F.col("d.no") == F.col("n.no")) & (F.col("d.of") == F.col("n.of"))
    scored = dots.alias("d").join(norms.alias("n"), same).select("d.key", "d.kind", "d.no", "d.of", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    name = F.element_at(F.array(*[F.lit(x) for x, _ in templates]), F.col("template") + 1)
    best = scored.where(F.col("score") >= threshold).groupBy(*unit).agg(F.min(F.struct((-F.col("score")).alias("less"), name.alias("license"))).alias("best"))
    return best.select(F.col("key").alias(key), "kind", "no", "best.license", (-F.col("best.less")).alias("score"))


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, the root (empty) included."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scan(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str = "path",
    templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.75,
) -> DataFrame:
    """key, path, own_license, own_score, license, inherited_from (directory, null if own or none)."""
    units = license_units(df, key, text, path, templates, threshold)
    weak = F.col("license").isin(*WEAK).alias("weak")
    own = units.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(weak, (-F.col("score")).alias("less"), "license")).alias("best"))
    files = df.select(F.col(key), F.col(path).alias("path"))
    known = files.join(own, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        key, "path", F.col("best.license").alias("own_license"), (-F.col("best.less")).alias("own_score"),
        F.array_join(F.filter(F.split(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "/"), lambda x: x != ""), "/").alias("_folder"),
        F.regexp_extract("path", "([^/]*)$", 1).alias("_name"),
    )
    grants = known.where(F.col("_name").rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
    grants = grants.groupBy(F.col("_folder").alias("_above")).agg(F.max_by("own_license", F.struct("own_score", "own_license")).alias("_grant"))
    folders = known.where("own_license is null and path is not null").select("_folder").distinct()
    reach = folders.select("_folder", F.posexplode(ancestors(F.col("_folder"))).alias("_depth", "_above")).join(grants, "_above")
    nearest = reach.groupBy("_folder").agg(F.max(F.struct("_depth", "_above", "_grant")).alias("_near"))
    return known.join(nearest, "_folder", "left").select(
        key, "path", "own_license", "own_score",
        F.coalesce("own_license", F.when(F.col("path").isNotNull(), F.col("_near._grant"))).alias("license"),
        F.when(F.col("own_license").isNull() & F.col("path").isNotNull(), F.col("_near._above")).alias("inherited_from"),
    )
