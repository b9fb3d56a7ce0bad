"""Benchmark decontamination with suffix arrays over shards of the training words.

A shard is a block of whole documents. Its suffix array orders the word positions by the
words that follow, KEYED words deep, each word coded by its rank in the benchmark's
vocabulary. Words the benchmark lacks end every match, so only suffixes that share their first
word with some test suffix are kept: a sparse suffix array. Every test suffix (a window of
``window`` words, or a shorter item whole) is binary-searched in every shard; the positions
found are joined along diagonals to the longest verbatim matches.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textblocks import ALNUM, Block, Words, blocks, in_batches, take_ranges, word_hashes, words

#: Bytes of benchmark text that driver and tasks hold at once; a larger benchmark is taken in passes, one after another.
BENCHMARK_BYTES = 16 << 20
#: Bytes of a shard's text, at least and at most; in between, those per test suffix, so that searching a shard costs less than making it.
SHARD_BYTES, SUFFIX_BYTES = (1 << 20, 4 << 20), 64
#: Bits of a coded word, and words in one 64-bit key.
_BITS, _PER_KEY = 21, 3
_U = np.uint64


class Suffixes:
    """Test suffixes of one part of the benchmark, ready for search."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.depth = window, -(-window // _PER_KEY)
        texts = pa.array([t for _, t in items], pa.large_string())
        size = sum(len((t or "").encode()) for _, t in items)
        block = next(blocks(texts, size + 1), Block(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        w, low = words(block, ALNUM)
        self.vocabulary, coded = np.unique(word_hashes(w, low), return_inverse=True)
        if len(self.vocabulary) >= 1 << _BITS:
            raise ValueError("the benchmark's part has too many distinct words; lower BENCHMARK_BYTES")
        coded = coded.astype(_U) + _U(1)
        count = np.diff(w.first)
        n = np.where(count >= window, count - window + 1, np.minimum(count, 1))
        self.item = np.repeat(np.arange(len(items)), n)
        self.place = take_ranges(np.zeros(len(n), np.int64), n)
        self.length = np.minimum(count, window)[self.item]
        self.names = [str(k) for k, _ in items]
        at = w.first[:-1][self.item] + self.place
        self.low = np.zeros((len(at), self.depth), _U)
        self.high = np.zeros((len(at), self.depth), _U)
        for j in range(self.depth * _PER_KEY):
            inside = j < self.length
            value = np.where(inside, coded[np.minimum(at + j, len(coded) - 1)] if len(coded) else _U(0), _U(0))
            shift = _U(_BITS * (_PER_KEY - 1 - j % _PER_KEY))
            self.low[:, j // _PER_KEY] |= value << shift
            self.high[:, j // _PER_KEY] |= np.where(inside, value, _U((1 << _BITS) - 1)) << shift

    def shard_bytes(self) -> int:
        least, most = SHARD_BYTES
        return min(most, max(least, SUFFIX_BYTES * len(self.low)))

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks from 1 of the words in the vocabulary, 0 for all others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def suffix_array(coded: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of coded (0: in no test suffix) in the order of the depth * 3 words from there, and these keys; a document's end is as a 0."""
    at = np.flatnonzero(coded)
    last = np.repeat(first[1:], np.diff(first))[at]
    keys = np.zeros((len(at), depth), _U)
    padded = np.concatenate([coded, np.zeros(depth * _PER_KEY, coded.dtype)]).astype(_U)
    for j in range(depth * _PER_KEY):
        keys[:, j // _PER_KEY] |= np.where(at + j < last, padded[at + j], _U(0)) << _U(_BITS * (_PER_KEY - 1 - j % _PER_KEY))
    order = np.lexsort(keys.T[::-1])
    return at[order], keys[order]


def search(keys: np.ndarray, s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix, the range of the suffix array that starts with it."""
    begin = np.searchsorted(keys[:, 0], s.low[:, 0], "left")
    end = np.searchsorted(keys[:, 0], s.high[:, 0], "right")
    for k in np.flatnonzero(end > begin):
        a, b = begin[k], end[k]
        for level in range(1, s.depth):
            if a >= b or s.length[k] <= level * _PER_KEY:
                break
            column = keys[a:b, level]
            a, b = a + np.searchsorted(column, s.low[k, level], "left"), a + np.searchsorted(column, s.high[k, level], "right")
        begin[k], end[k] = a, b
    return begin, end


def longest(position: np.ndarray, test: np.ndarray, s: Suffixes) -> np.ndarray:
    """Rows (word, item, item's word, words): hits joined along diagonals of one item to their longest matches."""
    if not len(position):
        return np.zeros((0, 4), np.int64)
    item, place = s.item[test], s.place[test]
    order = np.lexsort((position, position - place, item))
    item, place, position = item[order], place[order], position[order]
    opens = np.ones(len(item), bool)
    opens[1:] = (np.diff(item) != 0) | (np.diff(position - place) != 0) | (np.diff(position) != 1)
    at = np.flatnonzero(opens)
    run = np.diff(np.append(at, len(item)))
    return np.stack([position[at], item[at], place[at], run + s.length[test][order][at] - 1], 1)


_MATCH = "array<struct<word:bigint,item_id:string,item_word:bigint,words:bigint>>"


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted distinct item ids) and matches, the longest verbatim matches.

    A document word counts as hit inside any occurrence of a window. Null texts have no
    words; items without words match nothing; rows of equal id give a row each; an empty table
    gives an empty one, an empty benchmark no matches; other columns are not read.
    """
    out = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast(_MATCH).alias("matches"))
    for k, part in enumerate(_parts(benchmark.select(F.col(item_col).alias("k"), F.col(item_text_col).alias("t")))):
        # Each pass is over before the next part is read, so that no task holds two.
        out = scratch.cut(out, "matches") if k else out
        out = in_batches(out).mapInArrow(_searcher(Suffixes(part, window)), out.schema)
    return out.drop("_text")


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in parts of at most BENCHMARK_BYTES (or one item); at least one part."""
    part, size, any_yet = [], 0, False
    for k, t in benchmark.toLocalIterator():
        if part and size + len(t or "") * 4 > BENCHMARK_BYTES:
            yield part
            part, size, any_yet = [], 0, True
        part.append((k, t or ""))
        size += len(t or "") * 4
    if part or not any_yet:
        yield part


def searched(block: Block, s: Suffixes) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The block's words, its shard's suffix array, and the range of it that each test suffix has."""
    w, low = words(block, ALNUM)
    at, keys = suffix_array(s.code(word_hashes(w, low)), w.first, s.depth)
    return w, at, *search(keys, s)


def _cleaner(s: Suffixes, text: int):
    """Keeps the rows whose text (the column of that number) holds no test suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text), s.shard_bytes()):
                w, at, begin, end = searched(block, s)
                clean = np.ones(block.stop - block.start, bool)
                clean[np.searchsorted(w.first, at[take_ranges(begin, end - begin)], "right") - 1] = False
                yield batch.slice(block.start, len(clean)).filter(pa.array(clean))

    return run


def _searcher(s: Suffixes):
    def one(block: Block, old_hits: list, old_items: list, old_matches: list) -> tuple:
        w, at, begin, end = searched(block, s)
        n = end - begin
        found = longest(at[take_ranges(begin, n)], np.repeat(np.arange(len(n)), n), s)
        doc = np.searchsorted(w.first, found[:, 0], "right") - 1
        order = np.lexsort((found[:, 1], found[:, 0], doc))
        found, doc = found[order], doc[order]
        rows = np.searchsorted(doc, np.arange(block.stop - block.start + 1))
        n_words, hits, items, matched = np.diff(w.first), list(old_hits), list(old_items), list(old_matches)
        for r in np.unique(doc):
            mine = found[rows[r] : rows[r + 1]]
            new = [{"word": int(p - w.first[r]), "item_id": s.names[i], "item_word": int(q), "words": int(k)} for p, i, q, k in mine]
            matched[r] = [*matched[r], *new]
            items[r] = sorted({m["item_id"] for m in matched[r]}, key=str.encode)
            cover = np.zeros(n_words[r] + 1, np.int64)
            for m in matched[r]:
                cover[m["word"]] += 1
                cover[m["word"] + m["words"]] -= 1
            hits[r] = int((np.cumsum(cover[:-1]) > 0).sum())
        return n_words, hits, items, matched

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), s.shard_bytes()):
                old = batch.slice(block.start, block.stop - block.start)
                n_words, hits, items, matched = one(block, *(old.column(k).to_pylist() for k in (3, 4, 5)))
                schema = batch.schema
                yield pa.RecordBatch.from_arrays([old.column(0), old.column(1), pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, schema.field(4).type), pa.array(matched, schema.field(5).type)], schema=schema)

    return run


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of what matches() gives."""
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a window of the benchmark.

    Every row is judged by its own text where it lies: nothing is shuffled, and null or repeated
    ids make no difference. Null texts and those of an empty benchmark stay; an empty table
    gives an empty one; all columns are kept.
    """
    out = docs
    for k, part in enumerate(_parts(benchmark.select(F.col(item_col).alias("k"), F.col(item_text_col).alias("t")))):
        out = scratch.cut(out, "clean") if k else out
        out = in_batches(out).mapInArrow(_cleaner(Suffixes(part, window), docs.columns.index(text_col)), docs.schema)
    return out
