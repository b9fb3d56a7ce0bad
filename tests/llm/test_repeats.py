"""Removal of repeated byte strings against a plain version."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from barometry.llm import repeats, suffixes
from hypothesis import given
from hypothesis import strategies as st


def make(spark, rows):
    return spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_bytes int").repartition(3)


def hard():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé fg\n") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(120)
    texts = [None, "", "x", "x" * 399, "x" * 400, "y" * 401, "z" * 3000, "ab" * 700, passage, passage, text(60) + passage + text(50), passage[:-1] + "!", passage[3:], text(20) + passage[5:] + passage[:-7]]
    for _ in range(12):
        edited = passage.split(" ")
        edited[rng.randrange(len(edited))] = word()
        texts.append(text(rng.randrange(30)) + " ".join(edited) + text(rng.randrange(30)))
    return list(enumerate([*texts, *(text(rng.randrange(200)) for _ in range(10))]))


@pytest.mark.parametrize("thin", [suffixes.THIN, 0.01])
@given(st.lists(st.integers(1, 4), max_size=40))
def test_suffix_array_and_prefixes(thin, values):
    t = np.array([*values, 0], np.uint8)
    text, before = bytes(t), suffixes.THIN
    suffixes.THIN = thin
    order = suffixes.suffix_array(t, 5)
    suffixes.THIN = before
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    left, common = suffixes.permuted_prefixes(t, order)
    for i, j in zip(order[1:], order, strict=False):
        agree = next(k for k, (x, y) in enumerate(zip(text[i:], text[j:], strict=False)) if x != y)
        assert (left[i], common[i]) == (j, agree)


def test_long_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "PART_BYTES", 1 << 10)
    data = np.random.default_rng(1).integers(97, 101, 20_000).astype(np.uint8)
    column = pa.array(["short", data.tobytes().decode(), None, "z" * 500])
    got = set()
    for first, some, offsets, base in repeats.parts(column, 100):
        text, key, _, p, n = repeats.runs(some, offsets, 100, 20)
        for t, k, a, m in zip(text, key, p, n, strict=True):
            got |= {(int(first + t), int(k), int(a - offsets[t] + base + j)) for j in range(m)}
    monkeypatch.setattr(repeats, "PART_BYTES", 1 << 20)
    ((first, some, offsets, _),) = repeats.parts(column, 100)
    text, key, _, p, n = repeats.runs(some, offsets, 100, 20)
    whole = {(int(first + t), int(k), int(a - offsets[t] + j)) for t, k, a, m in zip(text, key, p, n, strict=True) for j in range(m)}
    # Every window has the key it has in the whole text.
    assert got == whole and len(whole) == 20_000 - 99 + 401


def test_equal_windows_share_a_key():
    rng = np.random.default_rng(2)
    passage = rng.integers(97, 123, 300)
    data = np.concatenate([rng.integers(97, 123, 70), passage, rng.integers(97, 123, 90), passage]).astype(np.uint8)
    _, key, _, p, n = repeats.runs(data, np.array([0, 370, 760]), 100, 20)
    of = {int(a + j): k for a, k, m in zip(p, key, n, strict=True) for j in range(m)}
    assert all(of[70 + i] == of[460 + i] for i in range(201))


@pytest.mark.parametrize("length, crowd", [(400, 2048), (100, 2048), (37, 2048), (100, 3)])
def test_hard_cases(spark, monkeypatch, length, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = hard()
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removed(make(spark, rows), length).collect()}
    assert got == brute.repeats(rows, length)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.removed(make(spark, rows), with_kept=True).collect()}
    assert got == brute.repeats(rows, 400)
    assert sum(v[1] for v in got.values()) > 0


def test_empty_and_repeated(spark):
    assert repeats.removed(make(spark, [(1, "")]).limit(0)).count() == 0
    t = "q%d " * 150 % tuple(range(150))
    got = [tuple(r)[:3] for r in repeats.removed(make(spark, [(1, t), (1, t), (2, None)])).collect()]
    assert sorted(got) == [(1, len(t), len(t)), (1, len(t), len(t)), (2, 0, 0)]


def test_one_text_that_repeats_itself(spark):
    got = {r.doc_id: tuple(r)[1:4] for r in repeats.removed(make(spark, [(1, "x" * 3000), (2, "short"), (None, "ab" * 500), (None, None)])).collect()}
    assert got[1] == (3000, 3000, 1) and got[2] == (5, 0, 0)
