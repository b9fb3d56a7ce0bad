"""WARC archives, surrogates, licence scans and the pipeline."""

import base64
import hashlib
import re
import zlib

import brute
import corpus_pipeline
import regex
from barometry.llm import licenses, pii, warc
from pyspark.sql import functions as F


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    texts = ["<p>é</p>\r\n\r\nWARC/1.1\r\n", None, "", "same", "same", "x" * 100_000, "same", "\x00\r\n\r\n", "é" * 7]
    pages = spark.createDataFrame([(i - 2, f"http://h/{i}\r\nX: y", t, "clash") for i, t in enumerate(texts)], "page_id long, url string, html string, payload_digest string")
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=600, date="2024-02-03T04:05:06Z")
    assert len(list((tmp_path / "w").glob("archive=*/part-*.gz"))) > 2
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    warc.write_archives(pages, str(tmp_path / "plain"), compression="none")
    assert {tuple(r) for r in warc.read_archives(spark, str(tmp_path / "plain")).collect()} == {tuple(r) for r in got.values()}
    raw = b"".join(zlib.decompress(f.read_bytes(), 31) for f in (tmp_path / "w").glob("archive=*/part-*.gz"))
    assert raw.count(b"WARC-Date: 2024-02-03T04:05:06Z\r\n") == 9 and raw.count(b"WARC-Refers-To-Date: 2024-02-03T04:05:06Z\r\n") == 3
    for i, t in enumerate(texts):
        equal = [k - 2 for k, u in enumerate(texts) if (u or "") == (t or "")]
        r = got[i - 2]
        assert r.intact and r.payload_digest == digest(t) and r.payload_bytes == len((t or "").encode())
        assert (r.record_type, r.refers_to) == (("response", None) if i - 2 == max(equal) else ("revisit", max(equal)))
        assert r.payload == ((t or "") if r.record_type == "response" else None)
    least = warc.archive_table(spark, pages, least=1).filter("payload_bytes = 0").collect()
    assert {r.record_type for r in least} == {"response"}
    assert warc.archive_table(spark, pages.limit(0)).count() == 0
    assert warc.archive_table(spark, pages.union(pages)).count() == 18


def test_warc_on_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = warc.archive_table(spark, pages)
    assert got.filter("not intact").count() == 0
    want = {r.page_id: r.html for r in pages.collect()}
    assert {r.page_id: r.payload_digest for r in got.collect()} == {k: digest(t) for k, t in want.items()}


PII = ["mail a.b@mail1.example.com, A.B@MAIL1.EXAMPLE.COM!", "a.b@mail1.example.com and é c.d@mail1.example.com", "call +1 (017) 555-7713 or +1 017-555-7713", "card 4532 0151 1283 0366, 4532015112830366", "ip 144.137.247.239.", "Frau Müller met Mr. Stone and Señora Иванова", None, "", "clean 123 text", "not 99.9%", "Herr Müller"]


def test_surrogates(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(PII)] + [(0, PII[0], "k")], "doc_id long, text string, version string")
    rows = pii.pseudonymised(docs, "secret").collect()
    got = {r.doc_id: r.text for r in rows}
    assert len(rows) == len(PII) + 1 and got == {r.doc_id: r.text for r in pii.pseudonymised(docs, "secret").collect()}
    assert [got[i] for i in (6, 7, 8, 9)] == PII[6:10]
    first = re.fullmatch(r"mail (\S+@\S+\.com), (\S+)!", got[0])
    assert first[1].upper() == first[2] != "A.B@MAIL1.EXAMPLE.COM" and re.fullmatch(r"[a-z]\.[a-z]@[a-z]{4}\d\.[a-z]{7}\.com", first[1])
    # Another address of the domain is another one of the same new domain.
    assert got[1].startswith(first[1] + " and é ") and got[1].split()[-1] != first[1] and got[1].split("@")[-1] == first[1].split("@")[1]
    phone = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3}-\d{3}-\d{4})", got[2])
    assert re.sub(r"\D", "", phone[1]) == re.sub(r"\D", "", phone[2]) != "10175557713"
    card = re.fullmatch(r"card (4\d{3} \d{4} \d{4} \d{4}), (\d{16})", got[3])
    assert card[1].replace(" ", "") == card[2] != "4532015112830366"
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card[2]))) % 10 == 0
    assert re.fullmatch(r"ip (\d{1,3}\.){3}\d{1,3}\.", got[4]) and "144.137" not in got[4]
    names = re.fullmatch(r"Frau ([A-Z][a-z]+) met Mr\. ([A-Z][a-z]+) and Señora ([А-Я][а-я]+а)", got[5])
    # A surname alone stays alone, and is one name under titles of either gender.
    assert names and names[1] not in ("Müller", names[2]) and got[10] == f"Herr {names[1]}"
    assert pii.pseudonymised(docs, "other").filter("doc_id = 4").first().text != got[4]
    assert pii.pseudonymised(docs.limit(0), "k").count() == 0


def test_surrogates_stay_distinct(spark):
    # Ten thousand short addresses share few surrogates of their shape, so collisions must be resolved.
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x "), F.substring(F.md5(F.col("id").cast("string")), 1, 3), F.lit("@a.bc")).alias("text"))
    spans = pii.entities(docs)
    made = pii.surrogates(pii.gendered(spans), "k").filter("kind = 'email'")
    n = spans.select(F.explode("spans").alias("s")).select("s.norm").filter("norm like '%@%'").distinct()
    assert made.count() == n.count() == made.select("surrogate").distinct().count()
    assert made.join(n.select(F.regexp_extract("norm", "[^@]+", 0).alias("surrogate")), "surrogate").count() == 0


def test_entities_of_each_form(spark):
    forms = {
        "phone": ["+14155552671", "+1 (743) 555-3824", "+33 1 23 45 67 89", "+49 30 123456", "+49 (0)30 1234567", "0034 612 345 678", "(415) 555-2671", "415-555-2671", "415.555.2671", "01 23 45 67 89", "01.23.45.67.89", "030 1234567", "(030) 1234567", "612 345 678", "612 34 56 78", "91 234 56 78"],
        "card": ["4532 0151 1283 0366", "4532015112830366", "3782 822463 10005", "378282246310005"],
        "name": ["Dr. Smith", "Mme Dupont", "M. Dupont", "Sr. Pérez", "Sra. Gómez", "Herr Dr. Müller", "Prof. Anna Lang", "Mr. McDonald", "Mr. O'Brien", "Mr JOHN SMITH", "DR. O'NEILL-KEY", "Frau Anne-Marie Müller-Lüdenscheidt", "Mme D’Arcy", "MRS Jones"],
        "iban": ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NL91 ABNA 0417 1643 00", "FR14 2004 1010 0505 0001 3M02 606", "BE68 5390 0754 7034"],
        "ip": ["144.137.247.239"],
    }
    rows = [(kind, f) for kind, values in forms.items() for f in values]
    docs = spark.createDataFrame([(i, f"see {f}, then") for i, (_, f) in enumerate(rows)], "doc_id long, text string")
    got = {r.id: [(s.kind, s.value) for s in r.spans] for r in pii.entities(docs).collect()}
    given = {"Prof. Anna Lang": [("given", "Anna")], "Mr JOHN SMITH": [("given_m", "JOHN")], "Frau Anne-Marie Müller-Lüdenscheidt": [("given_f", "Anne-Marie")]}
    assert {rows[i]: got.get(i) for i in range(len(rows))} == {(k, v): [*given.get(v, []), (k, v.split(" ")[-1] if k == "name" else v)] for k, v in rows}
    parts = spark.createDataFrame([(0, "Mr. Smith USA"), (1, "Mr. Smith's hat"), (2, "BE68 5390 0754 7034 OR ELSE"), (3, "MR SMITH'S Hat")], "doc_id long, text string")
    assert [r.spans[0].value for r in pii.entities(parts).orderBy("id").collect()] == ["Smith", "Smith", "BE68 5390 0754 7034", "SMITH"]
    clean = ["EU27 MUST STOP THIS NOW", "AB12CD34", "on 01.02.2024 we", "in 2024 2025 2026", "at 12:30, 99.9% of 1,000,000", "pi is 3.14159265358979", "M Dupont"]
    assert pii.entities(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string")).count() == 0


def test_surrogates_link_the_parts_of_names(spark):
    texts = ["Mr. John Smith", "Mr. Smith", "Mrs Smith", "Frau Andrea Smith", "Herr Andrea Smith", "Frau Иванова", "Herr Иванов", "Prof. John Brown"]
    rows = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    john, smith = rows[0].text.split(" ")[1:]
    assert [r.n_entities for r in rows] == [1] * 8 == [r.n_name for r in rows]
    assert rows[1].text == f"Mr. {smith}" and rows[2].text == f"Mrs {smith}" and rows[7].text.startswith(f"Prof. {john} ")
    frau, herr = (rows[k].text.split(" ")[1] for k in (3, 4))
    assert rows[3].text.endswith(f" {smith}") and frau != herr and frau.endswith("a") and not herr.endswith("a") and not john.endswith("a")
    assert rows[5].text.endswith("а") and rows[6].text.endswith("в") and {"John", "Smith", "Andrea"}.isdisjoint({john, smith, frau, herr})


def test_surrogates_keep_gender_under_neutral_titles(spark):
    texts = ["Frau Anna Müller", "Dr. Anna Müller", "Prof. Dr. Anna Müller", "DR. ANNA MÜLLER", "Dr. Anna Weiß", "Frau Andrea Berg", "Herr Andrea Rossi", "Dr. Andrea Berg", "Dr. Andrea Rossi", "Dr. Andrea Kuhn", "Prof. Andrea Kuhn", "Dr. Robin Adam", "Herr Dr. Max Adam", "Prof. Max Adam"]
    got = [r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    name = [tuple(t.split(" ")[-2:]) for t in got]
    assert name[0] == name[1] == name[2] == tuple(w.capitalize() for w in name[3]) and name[3] == tuple(w.upper() for w in name[0]) and got[2].startswith("Prof. Dr. ")
    assert name[4][0] == name[0][0] and name[0][0].endswith("a") and name[4][1] != name[0][1]
    # Two persons of one given name are told apart by their surnames; one of whom nothing is told is of neither gender.
    assert name[7] == name[5] and name[8] == name[6] and name[5][0] != name[6][0] and name[9] == name[10] and name[9][0] not in (name[5][0], name[6][0])
    assert name[12] == name[13] and name[11][1] == name[12][1] and name[11][0] != name[12][0]


def test_surrogates_keep_formats(spark):
    texts = ["Mr. O'Brien", "Mr. McDonald", "Mr JOHN O'BRIEN", "Frau Anne-Marie Kurz-Lang", "John.Doe@Example.com", "john.doe@example.com", "JANE@EXAMPLE.COM", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE00370400440532013000"]
    got = [r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert re.fullmatch(r"Mr\. O'[A-Z][a-z]+", got[0]) and got[0] != texts[0] and re.fullmatch(r"Mr\. [A-Z][a-z]+", got[1]) and "Donald" not in got[1]
    assert re.fullmatch(r"Mr [A-Z]+ O'[A-Z]+", got[2]) and got[2].split(" ")[2] == got[0].split(" ")[1].upper() and re.fullmatch(r"Frau [A-Z][a-z]+a-[A-Z][a-z]+a [A-Z][a-z]+-[A-Z][a-z]+", got[3])
    assert re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}@[A-Z][a-z]{6}\.com", got[4]) and got[5] == got[4].lower() != texts[5] and got[6].split("@")[1] == got[5].split("@")[1].upper()
    rolled = [t[4:] + t[:4] for t in (t.replace(" ", "") for t in got[7:])]
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", got[7]) and got[7].replace(" ", "") == got[8] != texts[8] and re.fullmatch(r"GB\d\d [A-Z]{4}( \d{4}){3} \d\d", got[9])
    assert [int("".join(str(int(c, 36)) for c in t)) % 97 == 1 for t in rolled] == [True, True, True, False] and got[10].startswith("DE00")


def test_phones_keep_their_country(spark):
    texts = ["+49 30 123456", "0049 30 123456", "+14155552671", "+351 912 345 678", "030 1234567"]
    got = [r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert re.fullmatch(r"\+49 \d\d \d{6}", got[0]) and got[1] == "00" + got[0][1:] and got[0] != texts[0]
    assert re.fullmatch(r"\+1\d{10}", got[2]) and re.fullmatch(r"\+351( \d{3}){3}", got[3]) and re.fullmatch(r"0\d\d \d{7}", got[4])


GIVENS, SURNAMES = ("Anna", "Max", "Andrea", "Jean-Luc", "Robin"), ("Müller", "O'Brien", "McDonald", "SMITH", "Иванов", "Lang", "Kurz")
TITLES = {"Frau": "f", "Mrs.": "f", "Herr": "m", "Mr": "m", "Dr.": "", "Prof. Dr.": ""}


def plainly_found(text):
    """(start, end, kind, norm, person) of each entity, by other patterns than the library's: the forms that the table and the added lines have."""
    for m in regex.finditer(r"(?P<email>[\w.]+@[\w.]+\w)|(?<![\w.])(?P<ip>\d+\.\d+\.\d+\.\d+)(?![\w])|(?P<phone>\+1 \(\d+\) \d+-\d+)|\b(?P<card>\d{16}|\d{4}( \d{4}){3})\b|\b(?P<iban>DE\d\d( \d{4}){4} \d\d)\b|\b(?P<title>Frau|Mrs\.|Herr|Mr|Prof\. Dr\.|(?<!Prof\. )Dr\.) (?P<name>\S+( \S+)?)(?=;)", text):
        kind = next(k for k in ("email", "ip", "phone", "card", "iban", "name") if m[k])
        if kind != "name":
            yield m.start(), m.end(), kind, m[kind].lower() if kind == "email" else re.sub("[ ()-]", "", m[kind]), None
            continue
        *given, surname = m["name"].split(" ")
        for word in given:
            yield m.start("name"), m.start("name") + len(word), "given", word.lower(), (TITLES[m["title"]], surname.lower())
        yield m.end("name") - len(surname), m.end("name"), "name", surname.lower(), None


def test_surrogates_equal_a_plain_version(spark, sf):
    """What plain patterns find, replaced one by one: equal texts, counts and genders, one to one over the whole table, with a line of names added to each text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    for i in before:
        title, given, surname = list(TITLES)[i % 6], GIVENS[i // 6 % 5], SURNAMES[i // 30 % 7]
        name = surname if i % 4 == 0 else f"{given} {surname}" if surname != "SMITH" else f"{given.upper()} {surname}"
        before[i] += f"\nseen: {title} {name}; DE{i % 90 + 10} 3704 0044 0532 {i % 1000:04d} 00"
    rows = pii.pseudonymised(spark.createDataFrame(list(before.items()), "doc_id long, text string"), "k").collect()
    all_found = {i: list(plainly_found(t)) for i, t in before.items()}
    told = {(norm, p): {q[0] for f in all_found.values() for *_, k, n, q in f if k == "given" and q[0] and (n == norm) and (p is None or q[1] == p)} for f in all_found.values() for *_, k, norm, q in f if k == "given" for p in (None, q[1])}
    made = {}
    for r in rows:
        old, spans = before[r.doc_id], all_found[r.doc_id]
        assert r.n_entities == sum(k != "given" for *_, k, _, _ in spans) and (r.n_iban, r.n_name) == (1, 1) and r.n_email == sum(k == "email" for *_, k, _, _ in spans)
        between = [old[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(old)], strict=True)]
        put = re.fullmatch("(.*)".join(map(re.escape, between)), r.text, re.S)
        assert put
        for (_, _, kind, norm, person), value in zip(spans, put.groups(), strict=True):
            if kind == "given":
                sexes = [{person[0]} - {""}, told[norm, person[1]], told[norm, None]]
                kind += next((x for (x,) in (s for s in sexes if len(s) == 1)), "")
                assert (value.lower()[-1] == "a") == kind.endswith("f")
            new = value.lower() if kind in ("email", "name") or person else re.sub("[ ()-]", "", value)
            assert made.setdefault((kind, norm), new) == new != norm
            assert kind != "ip" or all(0 <= int(x) < 256 for x in new.split("."))
    word = lambda k: "name" if k.startswith("given") else k
    old, new = {(word(k), n) for k, n in made}, {(word(k), v) for (k, _), v in made.items()}
    assert len(rows) == len(before) and len(new) == len(made) > 10 and not old & new


def test_surrogates_end_without_free_values(spark):
    names = [f"Mr. {a}{b}" for a in "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ" for b in "абвгдежзиклмнопрстуфхцчшэюя"]
    docs = spark.createDataFrame(list(enumerate([*names, "Mr. Պետրոսյան"])), "doc_id long, text string")
    made = {r.norm: r.surrogate for r in pii.surrogates(pii.gendered(pii.entities(docs)), "k").collect()}
    names = [n.split(" ")[1].lower() for n in names]
    assert len(made) == len(set(made.values())) == len(names) + 1 and not set(made) & set(made.values())
    assert re.fullmatch("[a-z]{9}", made["պետրոսյան"])
    assert all(made[n][-1] == n[-1] for n in names if len(made[n]) == 2)


def test_licences(spark):
    rows = [("a/LICENSE", "MIT\n\nReleased under the MIT License.\n"), ("a/b/x.py", "code"), ("a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\ncode the version"), ("z/q.txt", "the work is free and open to any person, under the law"), ("a/b/d/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/d/e/f.c", None), ("ab/x", ""), (None, "x"), ("LICENCE", "nothing"), ("top", "Licensed under CC BY-NC 4.0.")]
    rows += [(f"n/{i}", "the license of this version is general " * 3) for i in range(30)]
    files = spark.createDataFrame([(i, p, t, 1.0) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, score double")
    got = {r.path: r for r in licenses.scan(files).collect()}
    assert (got["a/LICENSE"].license, got["a/LICENSE"].origin) == ("MIT", "header")
    assert (got["a/b/x.py"].license, got["a/b/x.py"].inherited_from) == ("MIT", "a")
    assert got["a/b/c/y.py"].license == "Apache-2.0" and got["a/b/d/e/f.c"].license == "GPL-3.0" and got["a/b/d/e/f.c"].inherited_from == "a/b/d"
    assert got["top"].license == "CC-BY-NC-4.0"
    assert all(got[p].license is None for p in ("z/q.txt", "ab/x", None, "LICENCE", "n/3")) and len(got) == len(rows)
    assert licenses.scan(files.limit(0)).count() == 0


def test_licence_terms_weigh_by_all_files(spark):
    # Words that most files hold say little, also where no template has them.
    filler = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("src/"), F.col("id").cast("string")).alias("path"), F.lit("this project and its many parts are released under the table of contents").alias("text"))
    lines = ["x" * 9] * 600
    lines[300:300] = ["Permission is hereby granted, free of", "charge, to any person obtaining a copy of", "this software and associated documentation files"]
    rows = [(3001, "a/one", "code\nThis project and its many parts are released under the MIT License.\n" + "more code of this project\n" * 200), (3002, "a/long", "\n".join(lines)), (3003, "a/none", "this project and its many parts are released under the table")]
    got = {r.doc_id: r for r in licenses.scan(filler.union(spark.createDataFrame(rows, filler.schema))).filter("doc_id > 3000").collect()}
    assert got[3001].license == got[3002].license == "MIT" and got[3003].license is None


def test_licences_inherit_at_several_depths(spark):
    lines = {"s/LICENSE-1": "Licensed under CC BY 4.0.", "s/en/LICENSE-2": "Released under the MIT License.", "s/en/0/LICENSE-3": "Licensed under the BSD 3-Clause License."}
    rows = [*lines.items(), *((f"{d}/{i}.txt", "words") for d in ("s/de/4", "s/en/1", "s/en/0", "t/en/0") for i in range(5))]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")).collect()}
    assert [(got[f"{d}/3.txt"].license, got[f"{d}/3.txt"].inherited_from) for d in ("s/de/4", "s/en/1", "s/en/0", "t/en/0")] == [("CC-BY-4.0", "s"), ("MIT", "s/en"), ("BSD-3-Clause", "s/en/0"), (None, None)]


def test_licence_lines_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id for r in licenses.scan(docs, F.col("doc_id").cast("string")).filter("origin = 'header'").collect()}
    line = r"(?m)^(This work is licensed under the GNU General Public License, version 3\.|Licensed under CC BY-NC 4\.0\.|Released under the MIT License\.|Licensed under the Apache License, Version 2\.0\.)$"
    assert got >= {r.doc_id for r in docs.filter(F.col("text").rlike(line)).collect()}
    assert len(got) < 60


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = docs
    for name in list(stages)[:4]:
        after = stages[name](spark, before, sf)
        assert after.columns == docs.columns
        rows, old = {r.doc_id: r.text for r in after.collect()}, {r.doc_id: r.text for r in before.collect()}
        if name == "near_duplicates":
            kept = {d for d, v in brute.near_duplicates(list(old.items()), 5, 80).items() if v[2]}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            kept = {d for d, v in brute.contamination(list(old.items()), items, 10).items() if not v[4]}
        elif name == "secret_scan":
            kept = set(old)
            assert all(rows[d] == old[d] or "[SECRET]" in rows[d] for d in old)
        else:
            kept = {d for d in rows if not brute.quality_counts(old[d])[5]}
            assert len(rows) >= 0.7 * len(old)
        assert set(rows) == kept
        before = spark.createDataFrame([r for r in after.collect()], docs.schema)
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == set(rows)


def test_pipeline_stages_take_nulls_repeats_and_clashing_columns(spark, sf):
    good = "\n".join(" ".join(f"word{12 * i + j}" for j in range(12)) + "." for i in range(8))
    other = good.replace("word", "term")
    schema = "doc_id long, text string, lang string, source string, n_chars long, v int, id string, version string"
    rows = [(1, good, "en", "a", 0, 7, "x", "y"), (1, good, "en", "a", 0, 7, "x", "y"), (None, other, "en", None, 0, 8, None, None), (None, other, "en", None, 0, 8, None, None), (2, None, None, None, None, None, None, None), (3, "", "en", "a", 0, 1, "", "")]
    docs = spark.createDataFrame(rows, schema)
    left = {"quality_rules": [None, None, 1, 1], "near_duplicates": [None, 1, 2, 3], "benchmark_decontamination": [None, None, 1, 1, 2, 3], "secret_scan": [None, None, 1, 1, 2, 3]}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert sorted((r.doc_id for r in out.collect()), key=lambda d: d or 0) == left[name], name
        assert stage(spark, docs.limit(0), sf).count() == 0
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert packed.count() == 6 and corpus_pipeline.STAGES[4][1](spark, docs.limit(0), sf).count() == 0
