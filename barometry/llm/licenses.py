"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Units of a file are its lines, blocks of up to 64 neighbouring lines (lines without terms don't
count, so comment marks and frames fall away) and the whole file, of whatever length. A unit's
terms are weighed by the corpus-wide inverse document frequency and compared with the templates'.
Frequencies of all terms are counted first. A scan of the texts then gives the units whose cosine
can reach the threshold: terms in a hundredth of the files or more are known in every task (each
file has so many distinct terms on average, so these are at most a hundred times as many), and
all others weigh as much as a term at that share at least, which bounds a unit's length from
below. Only the few units left are joined to the frequencies of all their terms.
A licence file (by its name) gives its licence to its directory; a file without a header of its
own inherits from its nearest ancestor directory that has one.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textblocks import Block, blocks, class_table, mix, take_ranges, word_hashes, words

#: Texts that name each licence; fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED 'AS IS' AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
)
#: A line that names its licence by an SPDX expression, which is taken as it stands.
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9()][A-Za-z0-9.+() \t-]*[A-Za-z0-9.+)]|[A-Za-z0-9])"
#: Where templates of about one length are in reach, the nearest decides; shorter ones, which longer texts share, don't. About: this share of the greatest likeness, which grows with the template's length.
ABOUT = 0.75
#: Lines of a block.
LINES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: A term is common from this share of the files on: one in COMMON.
COMMON = 100
#: Lines looked at at once.
PART_LINES = 1024
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
#: Terms are runs of ASCII letters (in either case) and digits.
TERM = class_table(np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B].astype(np.uint8))
_U = np.uint64


def terms(text: str) -> np.ndarray:
    """The hashes of a text's terms, in order."""
    w, low = words(next(blocks(pa.array([text]))), TERM)
    return word_hashes(w, low)


def idf(n: np.ndarray | float, files: int) -> np.ndarray | float:
    return np.log((1 + files) / (1 + np.asarray(n, float))) + 1


def frequencies(texts: DataFrame) -> DataFrame:
    """(term, n): the number of files that hold each term, by its hash; the null term stands for all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([len(batch)])], names=["term", "n"])
            for block in blocks(batch.column(0)):
                w, low = words(block, TERM)
                h = word_hashes(w, low)
                row = np.repeat(np.arange(block.stop - block.start), np.diff(w.first)).astype(_U)
                _, once = np.unique(h + mix(row + _U(1)), return_index=True)
                term, n = np.unique(h[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

    counted = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return scratch.cut(counted.filter("n > 1 or term is null"), "frequencies")


class Templates:
    """Template vectors of unit length, and what is known of all terms, for tasks."""

    def __init__(self, texts: tuple[tuple[str, str], ...], files: int, held: dict[int, int], least: float):
        """held: the frequencies of template terms and common terms, by hash; other terms are in fewer than files / COMMON files."""
        self.names, self.least = [name for name, _ in texts], least
        each = [Counter(terms(t).tolist()) for _, t in texts]
        vocabulary = np.array(sorted({h for c in each for h in c}), _U)
        self.vocabulary = vocabulary
        self.idf = idf(np.array([held.get(int(h), 1) for h in vocabulary], float), files)
        self.weights = np.zeros((len(vocabulary), len(texts)))
        for k, c in enumerate(each):
            at = np.searchsorted(vocabulary, np.array(list(c), _U))
            self.weights[at, k] = np.array(list(c.values())) * self.idf[at]
        #: Each template's length before it is made a unit.
        self.norms = np.sqrt((self.weights**2).sum(0))
        self.weights /= np.where(self.norms > 0, self.norms, 1.0)
        # A unit that says not is none of a template that doesn't.
        self.no = int(self.places(terms("not"))[0])
        self.says_no = self.weights[self.no] > 0 if self.no >= 0 else np.ones(len(texts), bool)
        # Nor is one without the version that a licence's name ends with, where its template states that.
        numbers = [set(re.findall(r"[1-9]\d*", m[0])) & set(re.findall(r"\d+", t)) if (m := re.search(r"[0-9.]+$", name)) else set() for name, t in texts]
        self.versions = [(k, self.places(terms(" ".join(sorted(x))))) for k, x in enumerate(numbers) if x]
        common = np.array(sorted(h for h, n in held.items() if n * COMMON >= files), _U)
        self.common, self.common_idf = common, idf(np.array([held[int(h)] for h in common], float), files)
        # Others are in fewer files than one in COMMON, or in one.
        self.floor = float(idf(max(1.0, files / COMMON), files))
        self.anchors = np.unique(np.concatenate([self._anchors(k) for k in range(len(texts))]))

    def _anchors(self, k: int) -> np.ndarray:
        """Terms of which every unit with a cosine of least to template k has one at least: the heaviest, until the others' share of its length is under least."""
        order = np.argsort(-self.weights[:, k], kind="stable")
        rest = np.sqrt(np.maximum(0, 1 - np.cumsum(self.weights[order, k] ** 2) + self.weights[order, k] ** 2))
        return order[rest >= self.least - 1e-9]

    def places(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary's index of each term, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    def at_least(self, h: np.ndarray) -> np.ndarray:
        """The least idf each term can have."""
        if not len(self.common):
            return np.full(len(h), self.floor)
        at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
        return np.where(self.common[at] == h, self.common_idf[at], self.floor)

    def reaching(self, line: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int, float, list[tuple[int, float]]]]:
        """The units of a file (given its terms and their lines) whose cosine may reach least: first and last term, squared length of the template terms, and (template, dot) of each template in reach."""
        known = self.places(h)
        lines, first = np.unique(line, return_index=True)
        edge = np.append(first, len(line))
        other = np.append(0, np.cumsum(np.where(known < 0, self.at_least(h) ** 2, 0.0)))
        anchored = np.append(0, np.cumsum(np.isin(known, self.anchors)))
        is_known = np.flatnonzero(known >= 0)
        row = np.searchsorted(first, is_known, "right") - 1

        def judged(tf: np.ndarray, begin: np.ndarray, end: np.ndarray):
            own = tf * self.idf
            length = (own**2).sum(1)
            dots = own @ self.weights
            hit = dots >= (self.least - 1e-9) * np.sqrt(length + other[end] - other[begin])[:, None]
            if self.no >= 0:
                hit &= self.says_no | (tf[:, self.no] == 0)[:, None]
            for k, place in self.versions:
                hit[:, k] &= (tf[:, place] > 0).all(1)
            for k in np.flatnonzero(hit.any(1)):
                yield int(begin[k]), int(end[k]), float(length[k]), [(int(t), float(dots[k, t])) for t in np.flatnonzero(hit[k])]

        for a in range(0, len(lines), PART_LINES):
            b = min(len(lines), a + PART_LINES + LINES[-1] - 1)
            if anchored[edge[b]] == anchored[edge[a]]:
                continue
            inside = (row >= a) & (row < b)
            tf = np.zeros((b - a + 1, len(self.vocabulary)), np.float32)
            np.add.at(tf, (row[inside] - a + 1, known[is_known[inside]]), 1)
            tf = np.cumsum(tf, 0)
            for n in LINES:
                # A block belongs to the part that its first line is in.
                start = np.arange(min(PART_LINES, b - a - n + 1))
                begin, end = edge[a + start], edge[a + start + n]
                start = start[anchored[end] > anchored[begin]]
                if len(start):
                    yield from judged(tf[start + n] - tf[start], edge[a + start], edge[a + start + n])
        if len(lines):
            yield from judged(np.bincount(known[is_known], minlength=len(self.vocabulary))[None].astype(float), np.array([0]), np.array([len(line)]))


_UNIT = "id {}, version long, unit int, own double, template int, dot double, terms array<struct<term:bigint,tf:bigint>>"


def candidates(rows: DataFrame, known: Templates) -> DataFrame:
    """A row for each unit of (id, version, text) and each template in its reach; terms are those outside the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for block in blocks(batch.column(2)):
                w, low = words(block, TERM)
                h = word_hashes(w, low)
                has = np.append(0, np.cumsum(np.isin(known.places(h), known.anchors)))
                line = np.searchsorted(np.flatnonzero(block.data == 10), w.begin)
                for r in np.flatnonzero(has[w.first[1:]] > has[w.first[:-1]]):
                    mine = slice(w.first[r], w.first[r + 1])
                    own_h = h[mine]
                    for k, (begin, end, length, dots) in enumerate(known.reaching(line[mine], own_h)):
                        part = own_h[begin:end]
                        term, tf = np.unique(part[known.places(part) < 0], return_counts=True)
                        others = list(zip(term.view(np.int64).tolist(), tf.tolist(), strict=True))
                        out += [(block.start + int(r), k, length, t, dot, others) for t, dot in dots]
            index, unit, own, template, dot, others = zip(*out, strict=True) if out else ((),) * 6
            at = pa.array(index, pa.int64())
            kind = pa.list_(pa.struct([("term", pa.int64()), ("tf", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(unit, pa.int32()), pa.array(own, pa.float64()), pa.array(template, pa.int32()), pa.array(dot, pa.float64()), pa.array(others, kind)], names=["id", "version", "unit", "own", "template", "dot", "terms"])

    return rows.select("id", "version", "text").mapInArrow(run, _UNIT.format(rows.schema["id"].dataType.simpleString()))


def scan(files: DataFrame, path: Column | str = "path", id_col: str = "doc_id", text_col: str = "text", least: float = 0.7, templates: tuple[tuple[str, str], ...] = TEMPLATES, licence_file: str = LICENCE_FILE) -> DataFrame:
    """Per file: id, path, license (null: none known), score (cosine to the nearest template, if own), origin (header, inherited or null) and inherited_from (a directory).

    Every term weighs by the number of files that hold it. An SPDX line decides, and gives its
    expression as it stands (score 1); else, of the templates in reach, those about as long as the
    longest, and of these the nearest. Ties go to the template listed first; GPL and BSD
    are sentences that several versions share. A unit that says "not" is none of a template that doesn't,
    and one that lacks the version number in a licence's name is none of that licence's templates that state it. Null texts are empty, a null path has no ancestors, an empty table gives an empty
    one. Rows of equal id (null or not) and text count as one file; other columns are not read.
    """
    spark = files.sparkSession
    where = F.col(path) if isinstance(path, str) else path
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = files.select(F.col(id_col).alias("id"), where.cast("string").alias("path"), F.xxhash64(text).alias("version"), text.alias("text"))
    counts = frequencies(rows.select("text"))
    total = counts.filter("term is null").select("n").first()
    total = total.n if total else 0
    wanted = spark.createDataFrame([(h,) for h in np.unique(np.concatenate([terms(t) for _, t in templates])).view(np.int64).tolist()], "term long")
    # The templates' terms, and those that one file in COMMON holds: lists of bounded length.
    some = counts.join(F.broadcast(wanted), "term", "left_semi").union(counts.filter((F.col("n") * COMMON >= total) & F.col("term").isNotNull()))
    held = {r.term % 2**64: r.n for r in some.collect()}
    known = Templates(templates, total, held, least)
    found = scratch.cut(candidates(rows, known), "licence-units")

    apart = found.select("id", "version", "unit", F.explode("terms").alias("t")).distinct().select("id", "version", "unit", "t.*")
    weight = F.log(F.lit(1.0 + total) / (1 + F.coalesce("n", F.lit(1)))) + 1
    lengths = apart.join(counts, "term", "left").withColumn("x", F.col("tf") * weight).groupBy("id", "version", "unit").agg(F.sum(F.col("x") * F.col("x")).alias("rest"))
    units, lengths = found.alias("f"), lengths.alias("l")
    same = F.col("f.id").eqNullSafe(F.col("l.id")) & (F.col("f.version") == F.col("l.version")) & (F.col("f.unit") == F.col("l.unit"))
    scored = units.join(lengths, same, "left").select("f.id", "f.version", "template", (F.col("dot") / F.sqrt(F.col("own") + F.coalesce("rest", F.lit(0.0)))).alias("score"))
    norms = F.array(*(F.lit(float(x)) for x in known.norms))
    near = scored.filter(F.col("score") >= least - 1e-9).groupBy("id", "version", "template").agg(F.max(F.round("score", 9)).alias("score"))
    each = near.groupBy("id", "version").agg(F.collect_list(F.struct("score", (-F.col("template")).alias("k"), (F.col("score") * F.get(norms, F.col("template"))).alias("like"))).alias("all"))
    about = F.filter("all", lambda x: x["like"] >= ABOUT * F.array_max(F.transform("all", lambda y: y["like"])))
    names = F.array(*(F.lit(name) for name, _ in templates))
    best = each.withColumn("b", F.array_max(F.transform(about, lambda x: F.struct(x["score"].alias("score"), x["k"].alias("k"))))).select("id", "version", F.get(names, -F.col("b.k")).alias("near"), "b.score").alias("b")
    said = F.when(F.contains("text", F.lit("SPDX-License-Identifier:")), F.regexp_extract("text", SPDX, 1))
    stated = rows.withColumn("stated", F.when(said != "", F.regexp_replace(said, r"[ \t]+", " "))).select("id", "path", "version", "stated")
    own = stated.alias("r").join(best, F.col("r.id").eqNullSafe(F.col("b.id")) & (F.col("r.version") == F.col("b.version")), "left").select("r.id", "path", F.coalesce("stated", "near").alias("license"), F.when(F.col("stated").isNotNull(), F.lit(1.0)).otherwise(F.col("score")).alias("score"))

    at = scratch.cut(own.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "licences")
    given = at.filter(F.col("license").isNotNull() & F.col("path").rlike(licence_file)).groupBy("dir").agg(F.max_by("license", F.struct("score", "path")).alias("given"))
    parts = F.split("dir", "/")
    ancestors = at.select("dir").distinct().filter("dir is not null").select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("ancestor")).distinct()
    # A table of its own: only then can the join split a directory that many files are in.
    nearest = scratch.cut(ancestors.join(given.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max_by(F.struct("given", "ancestor"), F.length("ancestor")).alias("near")), "nearest")
    out = at.join(nearest, "dir", "left")
    inherited = F.col("license").isNull() & F.col("near").isNotNull()
    return out.select(F.col("id").alias(id_col), "path", F.coalesce("license", "near.given").alias("license"), "score", F.when(F.col("license").isNotNull(), F.lit("header")).when(inherited, F.lit("inherited")).alias("origin"), F.when(inherited, F.col("near.ancestor")).alias("inherited_from"))
