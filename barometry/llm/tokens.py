"""Token ids of whole texts, stored in Parquet list columns.

A tokenizer whose normaliser drops white space and whose merges never cross it gives a
text the ids of its white-space separated chunks, one after another. So each distinct
chunk of a batch is encoded once, by the tokenizers library, and the texts' ids are
gathered from these with numpy.

Files: one row a document, in ascending order of the id within and across files
(``part``, ``local_start``), token ids as a dictionary-encoded list column of small row
groups; Parquet's page indexes let a reader take a range of documents, or the counts
without the ids, and skip all else.
"""

import json
import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .textblocks import take_ranges

ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 64 << 10
END_ID = 1
#: Bytes of text whose chunks are encoded together, and whose ids are gathered at once; distinct chunks whose ids an encoder keeps for the next texts, at most.
CODED_BYTES, GATHERED_BYTES, KEPT = 8 << 20, 1 << 20, 1 << 19


#: Chunks of letters that lower-case and compose to themselves, and then maybe signs: the tokenizer sees one or two words in them. The apostrophe is left out, as it starts words of its own.
_SIGNS = r"[!-&(-/:-@\[-`{-~]+$"
_PLAIN = rf"^[A-Za-zÀ-ÖØ-öø-ÿ]+([!-&(-/:-@\[-`{{-~]+)?$"
_TOGETHER = 2000


class Ids(NamedTuple):
    """Ids of distinct strings, one string's after another's: string k has flat[start[k]:start[k] + size[k]]."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray


def splits_at_space(tokenizer) -> bool:
    """Whether a tokenizer composes and lower-cases text, drops white space, keeps words of letters apart from signs and marks the ends of words."""
    told = json.loads(tokenizer.to_str())
    steps = lambda name, many: (told[name] or {}).get(many, [told[name] or {}])
    first = steps("pre_tokenizer", "pretokenizers")[0]
    dropped = (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True) and first["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    return [s.get("type") for s in steps("normalizer", "normalizers")] == ["NFC", "Replace", "Lowercase"] and dropped and told["model"].get("end_of_word_suffix") == "</w>"


class Encoder:
    """Encodes batches of texts; those of tokenizers of another kind than splits_at_space() asks for, as whole texts.

    A plain chunk is a word of letters, whose case the tokenizer drops, and maybe signs. The
    distinct words, and the distinct runs of signs, are encoded many at a time, joined by
    spaces: the token that ends a word is marked as such in the vocabulary, so the ids can be
    told apart again. All other chunks are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.by_chunk = splits_at_space(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.kept, self.ids = pa.array([], pa.string()), Ids(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, some: pa.Array) -> Ids:
        """Ids of strings that the tokenizer takes as one word each; equal ones are encoded once."""
        coded = pc.dictionary_encode(some)
        n = len(coded.dictionary)
        groups = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, n, _TOGETHER), n), pa.int32()), coded.dictionary)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in self.encode(pc.binary_join(groups, " ").to_pylist()))])
        end = np.flatnonzero(self.ends[ids]) + 1
        if len(end) != n:
            raise ValueError("the tokenizer does not mark the ends of words as expected")
        start = np.append(0, end[:-1])[:n]
        index = coded.indices.to_numpy()
        return Ids(ids, start[index], (end - start)[index])

    def chunks(self, chunks: pa.Array) -> Ids:
        """Ids of distinct chunks of any kind."""
        plain = pc.match_substring_regex(chunks, _PLAIN).to_numpy(zero_copy_only=False)
        some = chunks.filter(pa.array(plain))
        word = self.words(pc.utf8_lower(pc.replace_substring_regex(some, _SIGNS, "")))
        tail = pc.replace_substring_regex(some, "^[^!-&(-/:-@\\[-`{-~]+", "")
        signed = pc.greater(pc.binary_length(tail), 0).to_numpy(zero_copy_only=False)
        sign = self.words(tail.filter(pa.array(signed)))
        rest = self.encode(chunks.filter(pa.array(~plain)).to_pylist())
        flat = np.concatenate([word.flat, sign.flat, np.array([i for x in rest for i in x], np.uint32)])
        # Each chunk is at most two pieces: its word (or all of it), then its signs.
        n = len(chunks)
        start, size = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
        start[plain, 0], size[plain, 0] = word.start, word.size
        at = np.flatnonzero(plain)[signed]
        start[at, 1], size[at, 1] = len(word.flat) + sign.start, sign.size
        own = np.array([len(x) for x in rest], np.int64)
        start[~plain, 0], size[~plain, 0] = len(word.flat) + len(sign.flat) + np.cumsum(own) - own, own
        both = size.sum(1)
        return Ids(flat[take_ranges(start.ravel(), size.ravel())], np.cumsum(both) - both, both)

    def known(self, chunks: pa.Array) -> Ids:
        """Ids of distinct chunks; those of earlier texts are remembered, and forgotten when there are too many."""
        if len(self.kept) > KEPT:
            self._forget()
        at = pc.index_in(chunks, self.kept)
        new = chunks.filter(pc.is_null(at))
        if len(new):
            more, n = self.chunks(new), len(self.kept)
            self.ids = Ids(np.concatenate([self.ids.flat, more.flat]), np.concatenate([self.ids.start, len(self.ids.flat) + more.start]), np.concatenate([self.ids.size, more.size]))
            self.kept = pa.concat_arrays([self.kept, new])
            index = at.to_numpy(zero_copy_only=False)
            place = np.empty(len(chunks), np.int64)
            is_new = np.isnan(index)
            place[~is_new], place[is_new] = index[~is_new], n + np.arange(len(new))
        else:
            place = at.to_numpy()
        return Ids(self.ids.flat, self.ids.start[place], self.ids.size[place])

    def __call__(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For some rows [a, b) after another: their ids (null: empty), end_id after each text, and the texts' offsets in them."""
        for lo, hi in slices(texts, CODED_BYTES if self.by_chunk else GATHERED_BYTES):
            if not self.by_chunk:
                ids = [[*x, end_id] for x in self.encode(texts[lo:hi].fill_null("").to_pylist())]
                yield lo, hi, np.array([i for x in ids for i in x], np.uint32), np.cumsum([0, *map(len, ids)])
                continue
            split = pc.ascii_split_whitespace(texts[lo:hi].fill_null(""))
            coded = pc.dictionary_encode(split.flatten())
            known = self.known(coded.dictionary)
            chunk_at = np.asarray(split.offsets) - split.offsets[0].as_py()
            del split
            index = coded.indices.to_numpy()
            for a, b in slices(texts[lo:hi], GATHERED_BYTES):
                own = index[chunk_at[a] : chunk_at[b]]
                length = known.size[own]
                ends = np.concatenate([[0], np.cumsum(length)])[chunk_at[a : b + 1] - chunk_at[a]]
                offsets = ends + np.arange(b - a + 1)
                out = np.full(int(offsets[-1]), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[offsets[1:] - 1] = False
                out[keep] = known.flat[take_ranges(known.start[own], length)]
                yield lo + a, lo + b, out, offsets


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes of text."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + limit, "right")))
        yield start, stop
        start = stop


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Encode every text and write the token files to the folder out.

    Null texts are empty (their only id is end_id), a null id sorts first, rows of equal id
    are ordered by text. Columns: id, part, local_start and n_tokens (long), token_ids (list of int).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = Encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, ids, offsets in encoder(batch.column(1), end_id):
                size = np.diff(offsets)
                rows = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.full(b - a, part, np.int64)), pa.array(at + offsets[:-1]), pa.array(size), rows], names=[id_col, "part", "local_start", "n_tokens", "token_ids"])
                at += int(offsets[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text_col)
    ordered.mapInArrow(encode, f"`{id_col}` {kind}, part long, local_start long, n_tokens long, token_ids array<int>").write.options(**{"compression": "zstd", "parquet.enable.dictionary": "true", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes)}).mode("overwrite").parquet(out)


def read_tokens(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """The token files' rows with start: the ids of all documents before each.

    The parts' totals come from the metadata columns alone; there is one a file, so their
    running sum is small and broadcast.
    """
    files = spark.read.parquet(out)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, at = [], 0
    for part, n in sorted(totals):
        base.append((part, at))
        at += n
    bases = spark.createDataFrame(base, "part long, base long")
    return files.join(F.broadcast(bases), "part").select(id_col, (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "token_ids")


def crc32_of(ids: pa.ListArray) -> np.ndarray:
    """Of each list, the crc32 of its ids as little-endian unsigned 32-bit integers."""
    raw = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4")).view(np.uint8)
    offsets = np.asarray(ids.offsets, np.int64) * 4
    return np.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)


def with_crc32(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 of rows that read_tokens() gave."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc32_of(batch.column(3)))], names=[*batch.schema.names[:3], "ids_crc32"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(digest, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def token_range(spark: SparkSession, out: str, low: int, high: int, id_col: str = "doc_id") -> DataFrame:
    """Token rows of the documents with ids in [low, high]; the filter reaches the files' statistics and page indexes."""
    return spark.read.parquet(out).filter(F.col(id_col).between(low, high))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_table(spark: SparkSession, docs: DataFrame, tokenizer_path: str, out: str | None = None) -> DataFrame:
    """Write docs' token files (to out, else to the scratch folder), read them back with their digests."""
    out = out or scratch.place(spark, "tokens")
    write_tokens(docs, out, tokenizer_path)
    return with_crc32(read_tokens(spark, out))
