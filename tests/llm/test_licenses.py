"""Licence scans against a plain TF-IDF of all units of all files."""

import math
import random
import re
from collections import Counter

from barometry.llm import licenses

BSD = """/*
 * Redistribution and use in source and binary forms, with or
 * without modification, are permitted provided that the following
 * conditions
 * are met:
 */
int main() { return 0; }
"""


def plain(rows, least=0.7, templates=licenses.TEMPLATES):
    terms = lambda t: re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = Counter(x for _, _, t in rows for x in set(terms(t)))
    weigh = lambda x: math.log((1 + len(rows)) / (1 + max(1, held[x]))) + 1

    def vector(w):
        v = {x: n * weigh(x) for x, n in Counter(w).items()}
        norm = math.sqrt(sum(a * a for a in v.values()))
        return {x: a / norm for x, a in v.items()}, norm

    known = [vector(terms(t)) for _, t in templates]
    out = {}
    for d, path, text in rows:
        if m := re.search(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)", text or ""):
            out[d, path] = " ".join(m[1].split()), 1.0
            continue
        lines = [w for w in map(terms, (text or "").split("\n")) if w]
        units = [sum(lines[i : i + n], []) for n in licenses.LINES for i in range(len(lines) - n + 1)] + ([sum(lines, [])] if lines else [])
        found = {}
        for u in units:
            v, _ = vector(u)
            for k, (t, _) in enumerate(known):
                score = round(sum(a * t.get(x, 0) for x, a in v.items()), 9)
                version = re.search(r"\d[\d.]*$", templates[k][0])
                stated = {x for x in version[0].split(".") if x != "0" and x in t} if version else set()
                if score >= least - 1e-9 and not ("not" in v and "not" not in t) and stated <= set(v):
                    found[k] = max(found.get(k, 0.0), score)
        most = max((score * known[k][1] for k, score in found.items()), default=0)
        best = max(((score, -k) for k, score in found.items() if score * known[k][1] >= 0.75 * most), default=None)
        out[d, path] = best and (templates[-best[1]][0], best[0])
    return out


GPL = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
GPL_END = "This {1} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {0}General Public License for more details."
BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
MIT = licenses.TEMPLATES[16][1]
#: Headers as files have them, and the licence of each.
HEADERS = [
    ("GPL-2.0", GPL.format(";", "", ";", 2) + "\n\n" + GPL_END.format("", "program")),
    ("GPL-2.0", GPL.format(";", "", ";", 2)),
    ("GPL-3.0", GPL.format(":", "", ",", 3) + "\n\n" + GPL_END.format("", "program")),
    ("GPL-3.0", GPL.format(":", "", ",", 3)),
    ("LGPL-2.1", GPL.format(";", "Lesser ", ";", "2.1").replace("program", "library") + "\n" + GPL_END.format("Lesser ", "library")),
    ("LGPL-3.0", GPL.format(";", "Lesser ", ";", "3").replace("program", "library") + "\n" + GPL_END.format("Lesser ", "library")),
    ("AGPL-3.0", GPL.format(":", "Affero ", ",", "3") + "\n" + GPL_END.format("Affero ", "program")),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD-2-Clause", BSD_1 + "\n" + BSD_2),
    ("BSD-3-Clause", BSD_1 + "\n" + BSD_2 + "\n" + BSD_3),
    ("BSD", BSD_1),
    ("MIT", MIT),
    ("MIT", MIT.replace(". ", ".\n * ")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is released under the MIT License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the 'License');\nyou may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "// SPDX-License-Identifier: EPL-2.0"),
    ("(MIT OR Apache-2.0)", "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */"),
    ("GPL-2.0-only WITH Classpath-exception-2.0", "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT\n" + GPL.format(":", "", ",", 3)),
    (None, "This is not released under the MIT License."),
    (None, "int main() { return 0; }"),
]


def test_headers_are_told_apart(spark):
    rng = random.Random(8)
    filler = [(100 + i, f"f{i}", " ".join(f"w{rng.randrange(900)}" for _ in range(40))) for i in range(300)]
    rows = [(i, f"h{i}", "Copyright 2020 somebody\n\n" + t + "\n\nw1 w2 w3\n") for i, (_, t) in enumerate(HEADERS)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows + filler, "doc_id long, path string, text string")).filter("doc_id < 100").collect()}
    assert got == {i: name for i, (name, _) in enumerate(HEADERS)}


def plain_inheritance(found, licence_file):
    """path -> licence from the nearest directory above with a licence file of its own."""
    given = {}
    for path, (name, score) in found.items():
        if name and re.search(licence_file, path):
            d = path.rpartition("/")[0]
            given[d] = max(given.get(d, (-1.0, "", "")), (score, path, name))
    out = {}
    for path, (name, _) in found.items():
        parts = path.split("/")[:-1]
        above = ["/".join(parts[:k]) for k in range(len(parts), -1, -1)]
        near = next((d for d in above if d in given), None)
        out[path] = (name, "header", None) if name else (given[near][2], "inherited", near) if near is not None else (None, None, None)
    return out


def test_inheritance_equals_a_plain_walk(spark):
    rng = random.Random(3)
    rows = []
    for i in range(250):
        folder = "/".join(rng.choice("ab") for _ in range(rng.randrange(5)))
        name = rng.choice(["LICENSE", "COPYING.txt", "main.c", "x.py", "notes"])
        text = rng.choice(["Released under the MIT License.", "Licensed under CC BY 4.0.", "# SPDX-License-Identifier: ISC", "w1 w2", "w3 w4 w5"])
        rows.append((i, f"{folder}/{i}-{name}".lstrip("/") if name in ("main.c", "x.py", "notes") else f"{folder}/{name}{i}".lstrip("/"), text))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    own = {p: x or (None, 0.0) for (_, p), x in plain(rows).items()}
    assert {r.path: (r.license, r.origin, r.inherited_from) for r in got} == plain_inheritance(own, licenses.LICENCE_FILE)


def test_equals_plain_tf_idf(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "license", "version", "software", "under", *(f"w{i}" for i in range(300))]
    prose = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([6, 40, 306])]) for _ in range(n))
    texts = [None, "", "\n\n", BSD, "# SPDX-License-Identifier: MIT\n" + prose(50), licenses.TEMPLATES[16][1].replace(" ", "\n// "), prose(30) + "\n" + licenses.TEMPLATES[19][1].replace(". ", ".\n") + "\n" + prose(900), "This project is released under the MIT License.\n" + "\n".join(prose(9) for _ in range(1500))]
    for name, t in licenses.TEMPLATES:
        w = t.split(" ")
        at = rng.randrange(len(w))
        texts += [prose(12) + "\n" + t + "\n" + prose(12), " ".join(w[:at]) + "\n" + prose(3) + " ".join(w[at:]), "\n".join(prose(rng.randrange(1, 15)) for _ in range(20))]
    rows = [(i if i != 5 else None, f"d{i % 3}/f{i}", t) for i, t in enumerate(texts)]
    rows += [rows[8], rows[9]]
    got = {(r.doc_id, r.path): r.license and (r.license, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").withColumnRenamed("extra", "n").repartition(3)).filter("origin = 'header' or license is null").collect()}
    want = plain(rows)
    assert {k: v and v[0] for k, v in got.items()} == {k: v and v[0] for k, v in want.items() if k in got}
    assert set(got) >= {k for k, v in want.items() if v}
    assert all(abs(v[1] - want[k][1]) < 1e-6 for k, v in got.items() if v)
    assert want[3, "d0/f3"][0] == "BSD" and want[4, "d1/f4"][0] == "MIT" and want[7, "d1/f7"][0] == "MIT"


def test_bounds_hold_where_few_terms_are_common(spark):
    """With many files most terms are rare, so most units fall to the bound."""
    rng = random.Random(6)
    rows = [(i, f"f{i}", " ".join(f"w{rng.randrange(3000)}" for _ in range(12)) + ("\nReleased under the MIT License" + " w1" * (i % 7) if i % 9 == 0 else "")) for i in range(700)]
    got = {(r.doc_id, r.path): r.license and (r.license, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = plain(rows)
    assert {k: v and v[0] for k, v in got.items()} == {k: v and v[0] for k, v in want.items()}
    assert 0 < sum(v is not None for v in want.values()) < 78


def test_empty_ties_and_clashes(spark):
    none = spark.createDataFrame([], "doc_id long, path string, text string, term long, unit int")
    assert licenses.scan(none).count() == 0
    twice = (("A", "alpha beta gamma"), ("B", "alpha beta gamma"))
    rows = spark.createDataFrame([(1, "x/LICENSE", "alpha beta gamma", 7, 7), (1, "x/LICENSE", "alpha beta gamma", 8, 8), (None, None, "alpha beta gamma", 1, 1), (2, "x/y", None, 0, 0)], none.schema)
    got = sorted((r.doc_id or 0, r.license, r.origin) for r in licenses.scan(rows, templates=twice).collect())
    assert got == [(0, "A", "header"), (1, "A", "header"), (1, "A", "header"), (2, "A", "inherited")]
