"""Whole texts of an Arrow column as flat byte arrays, and their words, with numpy.

Texts are handled in blocks of a few MB, so a task's memory is bounded by the block
(or by the longest single text) and not by the partition.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BYTES = 2 << 20
#: Bytes of an Arrow batch that a task is sent. Spark's own limit is 64 MB, which a batch of long texts takes several times over, in the JVM and in the worker.
BATCH_BYTES = 8 << 20
_LIMIT, _SPARKS = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_U = np.uint64


class Block(NamedTuple):
    """Rows [start, stop) of a batch: their UTF-8 bytes, one after another; row i has data[offsets[i]:offsets[i + 1]]."""

    start: int
    stop: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte ranges of all words of a block; row r has words first[r] to first[r + 1]."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's texts (null: empty) in blocks of about limit bytes."""
    if not len(column):
        return
    column = pa.array(column.fill_null(""), pa.large_string()) if column.type != pa.large_string() else column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield Block(start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
        start = stop


def in_batches(rows: DataFrame) -> DataFrame:
    """rows, whose session from now on sends tasks Arrow batches of about BATCH_BYTES; a limit that the session has set stays."""
    conf = rows.sparkSession.conf
    if conf.get(_LIMIT) == _SPARKS:
        conf.set(_LIMIT, BATCH_BYTES)
    return rows


def class_table(word_bytes: np.ndarray) -> np.ndarray:
    """For each byte: 0 between words, else the byte itself, A-Z in lower case."""
    table = np.zeros(256, np.uint8)
    table[word_bytes] = word_bytes
    upper = word_bytes[(word_bytes >= 0x41) & (word_bytes <= 0x5A)]
    table[upper] = upper + 32
    return table


#: Words between ASCII white space, and words of ASCII letters and digits and all non-ASCII characters. NUL belongs to words of the first kind and so takes another byte that UTF-8 never has.
SPACED = class_table(np.setdiff1d(np.arange(256), [0x20, 9, 10, 11, 12, 13]).astype(np.uint8))
SPACED[0] = 0xFF
ALNUM = class_table(np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100].astype(np.uint8))


def words(block: Block, table: np.ndarray) -> tuple[Words, np.ndarray]:
    """The block's words, and its bytes as the table has them."""
    low = table[block.data]
    inside = low != 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = block.offsets[1:-1]
    at = edges[(edges > 0) & (edges < len(low))]
    opens[at] = inside[at]
    closes[at - 1] = inside[at - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(begin, end, np.searchsorted(begin, block.offsets)), low


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, _U) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _BASE, _U), dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit of the result depends on every bit of x."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(w: Words, low: np.ndarray, values_of: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each word's bytes (polynomial of their values, then mixed with the length)."""
    if not len(w.begin):
        return np.zeros(0, _U)
    size = w.end - w.begin
    starts = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(starts, size)
    values = values_of[low[low != 0]]
    powers = _POWERS
    if size.max() > len(powers):
        powers = np.cumprod(np.full(int(size.max()), _BASE, _U), dtype=_U)
    return mix(np.add.reduceat(values * powers[place], starts) + size.astype(_U) * _U(0xD6E8FEB86659FD93))


def take_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + length), one after another."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)
