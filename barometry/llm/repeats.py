"""Exact removal of byte strings that occur more than once in the corpus, by suffix arrays over shards.

A byte goes if some string of ``length`` bytes (a window) that covers it also starts elsewhere,
in any document. Equal windows must meet in one shard, and a shard must stay small:

1. A window's anchor is the leftmost place of the least hash of its GRAM-byte strings. Windows
   with one anchor, at most SPREAD places apart, are a run; the bytes that all windows of such a
   run share name its shard key. So equal windows have equal keys, and a key that one run of the
   corpus has holds no repeat.
2. Runs of equal bytes are counted as one (two copies or more: all their windows repeat).
3. The distinct runs of every key left are dealt to shards by key. A shard's suffix array is
   made by induced sorting (``suffixes``); a window repeats if its suffix has a common prefix of
   ``length`` bytes with a neighbour in order, as the permuted common prefixes say.
4. A key with more than CROWD distinct runs has too many for one shard: its windows are dealt
   again with the whole window as key, which is the same step with runs of one window.

Counts are aggregations with partial sums, keyed by content, so the copies of a passage meet as
counts and never as pairs or as one group of rows in a task.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .suffixes import permuted_prefixes, suffix_array
from .textblocks import blocks, mix

LENGTH = 400
#: Bytes that decide on an anchor; starts of windows in a run, at most; distinct runs of a key in one shard, at most; bytes of a shard, about.
GRAM, SPREAD, CROWD, SHARD_BYTES = 16, 97, 2048, 2 << 20
#: Bytes of a text that are looked at at once; longer texts go in overlapping parts.
PART_BYTES = 2 << 20
#: Bytes of runs that a task gives out at once.
BATCH_BYTES = 4 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(77).integers(0, 2**64, 256, _U) | _U(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, _U), np.full(n, _INVERSE, _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


class Hashed:
    """Hashes of any part of a text in constant time, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _powers(1 << max(12, n.bit_length()))
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum(_VALUE[data] * up[:n], dtype=_U, out=self.prefix[1:])

    def part(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[begin]) * self.down[begin]
        return mix(raw + (end - begin).astype(_U) * _U(0xD6E8FEB86659FD93))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the least value in each window of width values."""
    place = np.arange(len(values), dtype=np.int32)
    size = 1
    while size < width:
        step = min(size, width - size)
        right = values[step:] < values[:-step]
        place = np.where(right, place[step:], place[:-step])
        values = np.minimum(values[step:], values[:-step])
        size += step
    return place


def runs(data: np.ndarray, offsets: np.ndarray, length: int, spread: int) -> tuple[np.ndarray, ...]:
    """Runs of the windows of texts that lie one after another in data: text, key, content hash, first start in data, windows."""
    n = np.diff(offsets) - length + 1
    some = np.flatnonzero(n > 0)
    if not len(some):
        return (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    gram = min(GRAM, length)
    h = Hashed(data)
    at = np.arange(len(data) - gram + 1)
    anchors = least_places(h.part(at, at + gram), length - gram + 1)
    text = np.repeat(some, n[some])
    start = np.arange(len(text)) + np.repeat(offsets[some] - (np.cumsum(n[some]) - n[some]), n[some])
    anchor = anchors[start].astype(np.int64)
    zone = (anchor - start) // spread
    opens = np.flatnonzero(np.append(True, (np.diff(start) != 1) | (np.diff(anchor) != 0) | (np.diff(zone) != 0)))
    p, count = start[opens], np.diff(np.append(opens, len(start)))
    # What all windows of the zone share, whether or not the run has all of them.
    low, high = zone[opens] * spread, np.minimum((zone[opens] + 1) * spread - 1, length - gram)
    key = mix(h.part(anchor[opens] - low, anchor[opens] - high + length) + zone[opens].astype(_U))
    return text[opens], key, h.part(p, p + count - 1 + length), p, count


def parts(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place in the text) of some whole texts, or of a part of one long text that overlaps the next by length - 1 bytes."""
    for block in blocks(column, PART_BYTES):
        if block.stop - block.start > 1 or len(block.data) <= 2 * PART_BYTES:
            yield block.start, block.data, block.offsets, 0
            continue
        for at in range(0, len(block.data) - length + 1, PART_BYTES):
            piece = block.data[at : at + PART_BYTES + length - 1]
            yield block.start, piece, np.array([0, len(piece)]), at


def repeating(pieces: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each byte string, which of its windows occur elsewhere in the strings, its own other places included; from the strings' suffix array."""
    size = np.array([len(x) for x in pieces])
    ends = np.cumsum(size + 1)
    # UTF-8 has no bytes from 0xF5 on, so all can move up by 2: strings end with a 1, the last one with a 0 after it.
    t = np.full(int(ends[-1]) + 1, 1, np.uint8)
    t[-1] = 0
    inside = np.ones(len(t), bool)
    inside[ends - 1] = inside[-1] = False
    t[inside] = np.concatenate(pieces) + np.uint8(2)
    left, common = permuted_prefixes(t, suffix_array(t, 256))
    hit = common >= length
    found = hit.copy()
    found[left[hit]] = True
    return [found[e - n - 1 : e - length] for e, n in zip(ends, size, strict=True)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_NONE = -(2**63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ver (tells rows of equal id and different text apart) and text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"), F.xxhash64(text).alias("ver"), text.alias("text"))


_RUN = "key long, content long, id long, ver long, p int, n int"


def all_runs(rows: DataFrame, length: int) -> DataFrame:
    """The runs of all windows of (id, ver, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ver = (batch.column(k).to_numpy() for k in (0, 1))
            for first, data, offsets, base in parts(batch.column(2), length):
                text, key, content, p, n = runs(data, offsets, length, SPREAD)
                row = first + text
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_signed(key), _signed(content), ids[row], ver[row], (p - offsets[text] + base).astype(np.int32), n.astype(np.int32))], names=["key", "content", "id", "ver", "p", "n"])

    return rows.filter(F.octet_length("text") >= length).mapInArrow(run, _RUN)


def fetched(rows: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs asked for (key, id, ver, p, n, ask, crowded); of crowded ones each window on its own, with its hash as content and no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        names = ["key", "content", "id", "ver", "p", "n", "ask", "bytes"]
        parts_of, cut, size = [], [], 0

        def made() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts_of, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], names=names)

        for batch in batches:
            for r in range(len(batch)):
                data = np.frombuffer(batch.column(2)[r].as_buffer(), np.uint8)
                wanted = batch.column(3)[r].values
                key, p, n, ask, crowded = (wanted.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                p, n = p.astype(np.int64), n.astype(np.int64)
                whose = lambda k: (np.full(k, batch.column(0)[r].as_py()), np.full(k, batch.column(1)[r].as_py()))  # noqa: B023,E731
                some = np.flatnonzero(~crowded)
                parts_of.append((key[some], key[some], *whose(len(some)), p[some], n[some], ask[some]))
                cut += [data[a : a + k - 1 + length].tobytes() for a, k in zip(p[some], n[some], strict=True)]
                size += int(n[some].sum()) + len(some) * length
                for k in np.flatnonzero(crowded):
                    at = np.arange(n[k])
                    h = Hashed(data[p[k] : p[k] + n[k] - 1 + length])
                    parts_of.append((_signed(h.part(at, at + length)), _signed(h.part(at + length // 3, at + length)), *whose(len(at)), p[k] + at, np.ones(len(at)), np.full(len(at), ask[k])))
                    cut += [None] * len(at)
                    size += 60 * len(at)
                if size > BATCH_BYTES:
                    yield made()
                    parts_of, cut, size = [], [], 0
        if parts_of:
            yield made()

    wanted = asked.groupBy("id", "ver").agg(F.collect_list(F.struct("key", "p", "n", "ask", "crowded")).alias("wanted"))
    both = rows.join(wanted, ["id", "ver"]).select("id", "ver", "text", "wanted")
    return both.mapInArrow(run, "key long, content long, id long, ver long, p int, n int, ask boolean, bytes binary")


def shards(dealt: DataFrame, length: int) -> DataFrame:
    """(id, ver, p, n): the repeated windows of the runs that ask, by the suffix array of each shard of runs of some keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(shard: pa.Table) -> pa.RecordBatch:
            pieces = [np.frombuffer(x.as_buffer(), np.uint8) for x in shard.column("bytes")]
            ids, ver, p, ask = (shard.column(k).to_numpy() for k in ("id", "ver", "p", "ask"))
            row, start, count = [], [], []
            for r, hit in enumerate(repeating(pieces, length)):
                if ask[r] and hit.any():
                    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    row += [r] * len(a)
                    start += (p[r] + a).tolist()
                    count += (b - a).tolist()
            at = np.array(row, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ver[at]), pa.array(start, pa.int32()), pa.array(count, pa.int32())], names=["id", "ver", "p", "n"])

        # A shard ends where the next key begins, once it has enough bytes.
        for batch in batches:
            held.append(batch)
            whole = pa.Table.from_batches(held)
            key = whole.column("key").to_numpy()
            size = np.cumsum(np.asarray(pa.compute.binary_length(whole.column("bytes")), np.int64))
            opens = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            begin = 0
            for at in opens[1:]:
                if size[at - 1] - (size[begin - 1] if begin else 0) >= SHARD_BYTES:
                    yield done(whole.slice(begin, at - begin))
                    begin = at
            held = whole.slice(begin).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id long, ver long, p int, n int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ver, p, n) for n windows from byte p on that occur elsewhere."""
    rows = _keyed(docs, id_col, text_col)
    every = scratch.cut(all_runs(rows, length), "runs", compression="none")
    # A table of its own: only then can the join split a key that many runs have.
    shared = scratch.cut(every.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1").select("key"), "shared-keys")
    some = scratch.cut(every.join(shared, "key"), "shared-runs", compression="none")
    classes = scratch.cut(some.groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(F.struct("id", "ver", "p", "n")).alias("head")), "classes", compression="none")
    copied = some.join(classes.filter("copies > 1").select("key", "content"), ["key", "content"], "left_semi").select("id", "ver", "p", "n")
    # Of keys with several contents, of which one asks at least; a content with copies is evidence only.
    undecided = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).filter("kinds > 1 and least = 1").select("key", (F.col("kinds") > CROWD).alias("crowded"))
    asked = classes.join(undecided, "key").select("key", "head.*", (F.col("copies") == 1).alias("ask"), "crowded")
    got = scratch.cut(fetched(rows, asked, length), "pieces")
    sorted_out = shards(got.filter("bytes is not null").select("key", "id", "ver", "p", "n", "ask", "bytes"), length)
    windows = got.filter("bytes is null")
    twice = windows.groupBy("key", "content").agg(F.count("*").alias("copies")).filter("copies > 1").select("key", "content")
    single = windows.filter("ask").join(twice, ["key", "content"], "left_semi").select("id", "ver", "p", "n")
    return copied.union(sorted_out).union(single)


def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans and kept_sha256 (of the bytes left); with_kept adds the bytes themselves as kept.

    Null and short texts lose nothing; an empty table gives an empty one. Rows of equal id and
    text count as copies of one another, so do rows without an id; other columns are not read.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    marks = scratch.cut(repeated_spans(docs, length, id_col, text_col).groupBy("id", "ver").agg(F.collect_list(F.struct("p", "n")).alias("marks")), "marks")

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(len(batch)):
                data = np.frombuffer(batch.column(2)[r].as_buffer(), np.uint8)
                gone = np.zeros(len(data) + 1, np.int32)
                values = batch.column(3)[r].values
                p, n = values.field(0).to_numpy().astype(np.int64), values.field(1).to_numpy().astype(np.int64)
                np.add.at(gone, p, 1)
                np.add.at(gone, p + n - 1 + length, -1)
                struck = np.cumsum(gone[:-1]) > 0
                kept = data[~struck].tobytes()
                opens = int(struck[0]) + int((np.diff(struck.astype(np.int8)) == 1).sum())
                rows.append((len(data), int(struck.sum()), opens, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            columns = [pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    raw = _keyed(docs, id_col, text_col)
    changed = raw.join(marks, ["id", "ver"]).select("id", "ver", "text", "marks").mapInArrow(strike, schema)
    whole = raw.select("id", "ver", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept")] if with_kept else []))
    same = whole.join(marks.select("id", "ver"), ["id", "ver"], "left_anti")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else [])]
    both = same.select("id", *columns).unionByName(changed.select("id", *columns))
    return both.select(F.when(F.col("id") != _NONE, F.col("id")).alias(id_col), *columns)
