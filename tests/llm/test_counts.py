"""Token counts against the library's encoding of whole texts."""

import random

import pyarrow as pa
import pytest

from barometry.llm import counts

MODEL = counts.default_model()
ALPHABET = ["a", "aa", "the", "ing", " ", "  ", "     ", "\n", "\t", "\r\n", "▁", "▁▁", "é", "漢字", "語", "①", "😀", "\0", "<s>", "</s>", "<unk>", "<0x0A>", "Ünïcode", "qqqq", "x1", "==", ".", "　", " "]


@pytest.fixture(scope="module")
def whole():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda text: len(library.encode(text or ""))


def texts(n, longest, seed):
    pick = random.Random(seed)
    made = ["".join(pick.choice(ALPHABET) for _ in range(pick.randrange(longest))) for _ in range(n)]
    return [*made, "", None, " ", "  ", "\n", " \n ", "▁", "a", "a" * 700, " " * 700, "ab" * 400, "漢" * 500, "-" * 999 + " " + "=" * 900]


def test_counts_by_unit_equal_whole_texts(whole):
    some = texts(400, 60, 1)
    assert counts.Counter(MODEL).spliced
    assert counts.Counter(MODEL).lengths(pa.array(some)).tolist() == [whole(t) for t in some]


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 4), (64, 16), (400, 20)])
def test_spliced_chunks_equal_whole_texts(spark, whole, chunk, overlap):
    some = texts(60, 300, chunk)
    rows = [*enumerate(some), (3, some[3]), (None, some[4]), (5, some[6])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, digest int")
    got = counts.token_counts(docs, MODEL, limit=50, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), whole(t), whole(t) > 50) for i, t in rows]
    order = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_overlaps_widen_where_nothing_aligns(spark, whole):
    # A run of one letter: tokens of eight or so, whose places depend on where the chunk starts.
    runs = [(1, "a" * 5001), (2, "=" * 3003 + "b"), (3, " " * 4099 + "x")]
    got = counts.token_counts(spark.createDataFrame(runs, "doc_id long, text string"), MODEL, chunk=101, overlap=7)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: whole(t) for i, t in runs}


def test_marks_are_places_in_the_text(whole):
    counter = counts.Counter(MODEL)
    text = "the words 漢字 and  more▁ of them\nhere"
    found = counter.marks(text)
    assert found.ends[-1] == len(text) and found.tokens[-1] == whole(text)


def test_other_tokenizers_and_empty_tables(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    some = texts(30, 60, 9)
    library = Tokenizer.from_file(path)
    got = counts.token_counts(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), path, limit=10)
    assert [r.n_tokens for r in got.orderBy("doc_id").collect()] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in some]
    assert counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
    with pytest.raises(ValueError):
        counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), MODEL, chunk=10, overlap=4)
