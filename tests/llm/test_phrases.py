"""Collocations against counting every phrase."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from barometry.llm import phrases

SCHEMA = "doc_id long, text string, lang string, word string, h int"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, most):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if a >= counts[p[i : i + m]]}
        judged = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                judged.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(judged)[:most])]
    return sorted(out)


def some_rows(n, seed):
    pick = random.Random(seed)
    common = ["the", "of", "a", "Und", "é", "x\0y", "漢"]
    rare = [f"w{i}" for i in range(60)]
    fixed = ["alpha beta", "Alpha  beta\tgamma", "new york city", "one two three four five six", "ha ha ha ha", "rare1 rare2"]
    rows = []
    for i in range(n):
        words = [pick.choice(common) if pick.random() < 0.6 else pick.choice(rare) if pick.random() < 0.7 else pick.choice(fixed) for _ in range(pick.randrange(30))]
        text = "".join(x + pick.choice([" ", " ", " ", " ", "  ", ". ", ",", "\n", "\t", "? "]) for x in words)
        rows.append((i, pick.choice([text, text, text, text, None, ""]), pick.choice(["en", "en", "en", "fr", None]), "", 0))
    return rows + rows[:9]


@pytest.mark.parametrize(("least", "most", "wider"), [(3, 10, 2), (3, 10_000, 4), (12, 5, 16)])
def test_collocations_equal_counting(spark, monkeypatch, least, most, wider):
    monkeypatch.setattr(phrases, "WIDER", wider)
    rows = some_rows(260, least)
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least=least, most=most)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == plain(rows, least, most)


def test_ties_with_the_last_are_settled(spark, monkeypatch):
    """Pairs of equal scores whose first words lie in different bands; the phrase decides."""
    monkeypatch.setattr(phrases, "WIDER", 2)
    texts = [("zz yy", 4), ("bb cc", 8), ("bb. cc", 0), ("aa dd", 16), ("mm nn", 4), ("kk", 30)]
    rows = [(i, t, "en", "", 0) for t, k in texts for i in range(k)]
    rows += [(0, ". ".join(["aa"] * 16 + ["dd"] * 0), "en", "", 0)]
    for most in (1, 2, 3, 9):
        found = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=4, most=most)
        assert sorted(map(tuple, found.collect())) == plain(rows, 4, most)


def test_small_tables_and_tiny_bitmaps(spark, monkeypatch):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", 0), (2, "a b", "en", "", 0)], SCHEMA)).count() == 0
    # All words share a few bits: more is counted, the result is the same.
    monkeypatch.setattr(phrases, "FILTER_BITS", 6)
    rows = some_rows(80, 5)
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=3, most=20).collect())) == plain(rows, 3, 20)


def test_stored_rows_are_small(spark):
    """Spark's reader decodes 4096 rows at a time, each as Parquet has it: with a row for each block of text a task held its whole file."""
    docs = spark.range(300).select(F.lit("en").alias("lang"), F.expr("repeat('a b c d e ', 1000)").alias("text")).coalesce(1)
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {*root.glob("**/runs-*")}
    found = phrases.collocations(docs, least=100, most=3).collect()
    stored = [p for p in root.glob("**/runs-*") if p not in before]
    assert len(stored) == 1 and len(found) == 3
    sizes = [len(v) for v in ds.dataset(stored[0]).to_table().column("v")]
    assert sum(sizes) > 300 * 5000
    assert 4096 * 8 * max(sizes) < 20 << 20
    assert [(r.a, r.n) for r in found] == [(300 * 1000, 300 * 5000)] + [(300 * 999, 300 * 5000)] * 2


@pytest.mark.parametrize("piece", [1, 3])
def test_phrases_at_the_ends_of_stored_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(phrases, "PIECE", piece)
    monkeypatch.setattr(phrases, "SCANNED", 40)
    rows = some_rows(120, 8)
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=3, most=50)
    assert sorted(map(tuple, found.collect())) == plain(rows, 3, 50)


def test_scores_pass_64_bits(spark):
    frame = spark.createDataFrame([(10**13, 10**12, 10**12, 10**12)], "n long, a long, l long, r long")
    assert 1000 * 10**12 * 10**13 > 2**64
    assert frame.select(phrases.score_of().alias("s")).first().s == 1000 * 10**12 * 10**13 // 10**24


def test_sums_of_rows(monkeypatch):
    monkeypatch.setattr(phrases, "TALLIED", 50)
    pick = np.random.default_rng(3)
    parts = [[pick.integers(0, 90, 20), np.ones(20, np.int64)] for _ in range(40)]
    total = Counter()
    for k, v in phrases._tallied(iter(parts), 1):
        assert len(set(k.tolist())) == len(k)
        for x, y in zip(k.tolist(), v.tolist(), strict=True):
            total[x] += y
    assert total == Counter(x for k, _ in parts for x in k.tolist())
    a, b, n = np.array([2, 1, 2, 1]), np.array([0, 0, 0, 1]), np.array([1, 2, 3, 4])
    assert [x.tolist() for x in phrases._summed([a, b, n], 2)] == [[1, 1, 2], [0, 1, 0], [2, 4, 4]]
