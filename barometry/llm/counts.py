"""Token counts of whole texts of any length.

A text of at most ``chunk`` code points is encoded whole. A longer one is cut into chunks
that overlap on both sides of each cut; chunks are dealt to tasks and encoded with offsets,
and the encodings of neighbours are spliced in the overlap, behind a token that both have at
the same place.

Why a common token proves the splice: byte-pair merges are taken greedily, best first, so a
sequence of tokens is the encoding of its text if and only if no merge crosses the boundary
of any two neighbours when these two are encoded alone (merges on both sides of a boundary
that is never crossed don't influence each other). All neighbours left of the splice stand in
the left encoding, all right of it in the right one, and the pair at the splice itself, the
common token and what follows it, is a pair of the right one. Where an overlap has no common
token (a long run of one letter, say), the text is cut anew into longer chunks with wider
overlaps, at last into one.

Within a chunk, text is encoded in units: where no piece of the vocabulary holds a space
mark behind another character, no token crosses the start of a run of spaces, nor a character
that no piece has. Distinct units are encoded once.
"""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokens import slices

#: Code points of a chunk, and of text on each side of a cut that both neighbours encode; both are multiplied by WIDEN where neighbours don't align.
CHUNK, OVERLAP, WIDEN = 1 << 15, 256, 8
#: Bytes of text that are split into units at once, and units whose counts a task remembers, at most.
SPLIT_BYTES, KEPT = 4 << 20, 1 << 20
MARK = "▁"
_NORMAL, _USER, _UNUSED, _BYTE = 1, 4, 5, 6


class Marks(NamedTuple):
    """Where the symbols of a chunk's encoding end in its text (0: the mark that the library puts before it), and the tokens up to there."""

    ends: np.ndarray
    tokens: np.ndarray


class Counter:
    """Counts tokens as the file's library does: sentencepiece for .model, tokenizers for others."""

    def __init__(self, path: str):
        self.spliced, self.known = False, {}
        if not path.endswith(".model"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            self._lengths = lambda texts: [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        self._lengths = lambda texts: [len(x) for x in self.library.encode(texts, num_threads=1)]
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = [p.piece for p in model.pieces if p.type == _NORMAL]
        plain = not model.normalizer_spec.precompiled_charsmap and model.normalizer_spec.add_dummy_prefix and not model.normalizer_spec.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        merges = model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and not any(p.type in (_USER, _UNUSED) for p in model.pieces)
        #: Whether what the module's text says holds for this model: merges of plain text, space marks only before other characters.
        self.spliced = bool(plain and merges and MARK in normal and not any(MARK in p.lstrip(MARK) for p in normal))
        # A token's code points; of a character that is spelled in bytes, the first byte has it.
        self.points = np.array([len(p.piece) if p.type == _NORMAL else int(p.type == _BYTE and not 0x80 <= int(p.piece[3:-1], 16) <= 0xBF) for p in model.pieces], np.int64)
        used = set("".join(normal))
        self.breaks = np.array([chr(b) not in used and b != 0x20 for b in range(128)] + [False] * 128)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null is empty."""
        out = np.zeros(len(texts), np.int64)
        for a, b in slices(texts, SPLIT_BYTES):
            some = texts[a:b].fill_null("")
            whole = pc.match_substring(some, MARK).to_numpy(zero_copy_only=False) if self.spliced else np.ones(b - a, bool)
            whole_texts = some.filter(pa.array(whole)).to_pylist()
            if whole_texts:
                out[a:b][whole] = self._lengths(whole_texts)
            if not whole.all():
                out[a:b][~whole] = self._by_unit(some.filter(pa.array(~whole)))
        return out

    def _by_unit(self, texts: pa.Array) -> np.ndarray:
        """The library puts a space mark before a text that is not empty, so a space is put there here and each unit but those at breaks starts with one."""
        full = pc.greater(pc.binary_length(texts), 0)
        led = pc.binary_join_element_wise(pc.if_else(full, " ", ""), texts, "").cast(pa.large_string())
        offsets = np.frombuffer(led.buffers()[1], np.int64)[led.offset : led.offset + len(led) + 1]
        if offsets[-1] == offsets[0]:
            return np.zeros(len(texts), np.int64)
        data = np.frombuffer(led.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        space = data == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first |= self.breaks[data]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pc.dictionary_encode(units)
        each = self._of_units(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        upto = np.concatenate([[0], np.cumsum(each)])
        return np.diff(upto[np.searchsorted(starts, offsets)])

    def _of_units(self, units: list[str]) -> np.ndarray:
        if len(self.known) > KEPT:
            self.known.clear()
        new = [u for u in units if u not in self.known]
        # A unit that starts with a space takes the library's own mark for it; before a break the mark is a token that the unit doesn't have.
        for u, n in zip(new, self._lengths([u[1:] if u[0] == " " else u for u in new]), strict=True):
            self.known[u] = 1 if u == " " else n if u[0] == " " else n - 1
        return np.array([self.known[u] for u in units], np.int64)

    def marks(self, text: str) -> Marks | None:
        """None where the tokens don't spell the text, so that places are not known."""
        ends = np.cumsum(self.points[self.library.encode(text)]) - 1
        if not len(ends) or ends[-1] != len(text):
            return None
        last = np.append(np.flatnonzero(np.diff(ends)), len(ends) - 1)
        return Marks(ends[last], last + 1)


def _chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Of each row (id, n_bytes, text): the chunks with what they overlap of their neighbours, named by the text's digest."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                text = batch.column(2)[i].as_py()
                digest = hashlib.sha256(text.encode()).digest()
                cuts = range(0, len(text), chunk)
                for k, at in enumerate(cuts):
                    lo, hi = max(0, at - overlap), min(len(text), at + chunk + overlap)
                    part = [batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], pa.array([digest], pa.binary()), pa.array([k], pa.int64()), pa.array([k == len(cuts) - 1]), pa.array([lo], pa.int64()), pa.array([text[lo:hi]])]
                    yield pa.RecordBatch.from_arrays(part, names=["id", "n_bytes", "digest", "k", "last", "lo", "part"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(deal, f"id {kind}, n_bytes long, digest binary, k long, last boolean, lo long, part string")


def _sides(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Of each chunk and each of its cuts: the symbols in the overlap (start, end in the text) and the chunk's tokens up to each; of a last chunk, also all its tokens (cut -1)."""
    kind = chunks.schema["id"].dataType.simpleString()
    names = ["id", "n_bytes", "digest", "cut", "after", "start", "stop", "tokens"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            for i in range(len(batch)):
                k, last, lo, part = (batch.column(c)[i].as_py() for c in (3, 4, 5, 6))
                alone = last and k == 0
                found = counter.marks(part) if counter.spliced and not alone else None
                rows = [(k, True)] * (k > 0) + [(k + 1, False)] * (not last)
                made = []
                for cut, after in rows:
                    start, stop, upto = [], [], []
                    if found:
                        ends = found.ends + lo
                        a, b = np.searchsorted(ends, [cut * chunk - overlap, cut * chunk + overlap + 1])
                        a = max(a, 1)  # the first symbol's start is not known where a mark stands before it
                        start, stop, upto = ends[a - 1 : max(b - 1, a - 1)].tolist(), ends[a : max(b, a)].tolist(), found.tokens[a : max(b, a)].tolist()
                    made.append((cut, after, start, stop, upto))
                if last:
                    # A chunk before which others stand has the mark's token too; what is taken away up to the splice has it as well.
                    total = int(counter.lengths(pa.array([part]))[0]) if found is None else int(found.tokens[-1])
                    made.append((-1, False, [], [], [total]))
                if made:
                    n, col = len(made), list(zip(*made, strict=True))
                    lists = [pa.array(c, pa.list_(pa.int64())) for c in col[2:]]
                    yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([batch.column(c)[i : i + 1]] * n) for c in range(3)), pa.array(col[0], pa.int64()), pa.array(col[1]), *lists], names=names)

    return chunks.mapInArrow(encode, f"id {kind}, n_bytes long, digest binary, cut long, after boolean, start array<long>, stop array<long>, tokens array<long>")


def _spliced(sides: DataFrame) -> DataFrame:
    """id, n_bytes, digest, copies (rows that have this text), n_tokens (null where a cut has no common symbol). Rows of equal id and text have the same sides, so one of them speaks for all."""
    symbols = F.expr("transform(stop, (e, i) -> struct(start[i] as a, e as b))")
    side = F.struct(symbols.alias("symbols"), "tokens")
    cuts = sides.groupBy("id", "n_bytes", "digest", "cut").agg(F.max(F.when(~F.col("after"), side)).alias("l"), F.max(F.when(F.col("after"), side)).alias("r"), F.count(F.when(F.col("cut") < 0, 1)).alias("copies"))
    common = cuts.withColumn("both", F.array_intersect("l.symbols", "r.symbols")).withColumn("at", F.expr("if(size(both) > 0, both[size(both) div 2], null)"))
    upto = lambda s: F.expr(f"{s}.tokens[cast(array_position({s}.symbols, at) as int) - 1]")
    change = F.when(F.col("cut") < 0, F.col("l.tokens")[0]).otherwise(upto("l") - upto("r"))
    # A sum skips nulls: a cut without a symbol is counted by itself.
    each = common.select("id", "n_bytes", "digest", "copies", change.alias("change"))
    return each.groupBy("id", "n_bytes", "digest").agg(F.max("copies").alias("copies"), F.sum("change").alias("n"), F.count(F.when(F.col("change").isNull(), 1)).alias("open")).select("id", "n_bytes", "digest", "copies", F.when(F.col("open") == 0, F.col("n")).alias("n_tokens"))


def _of_long(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """id, n_bytes, n_tokens of rows (id, n_bytes, text) whose texts are longer than a chunk."""
    left, done = long, None
    while True:
        dealt = _chunks(left, chunk, overlap).repartition("id", "digest", "k")
        found = scratch.cut(_spliced(_sides(dealt, path, chunk, overlap)), "spliced")
        ready = found.filter("n_tokens is not null")
        done = ready if done is None else done.unionByName(ready)
        failed = found.filter("n_tokens is null").select(F.col("id").alias("own"), F.lower(F.hex("digest")).alias("named"))
        if failed.isEmpty():
            break
        # Wider overlaps; once a chunk holds the whole text there is no cut left, so this ends.
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
        left = long.join(failed, F.col("id").eqNullSafe(F.col("own")) & (F.sha2("text", 256) == F.col("named")), "left_semi")
    return done.select("id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("id", "n_bytes", "n_tokens")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit): one row for each row of docs.

    No begin, end or added special tokens; special strings in texts are what the library makes
    of them. A null text is empty and has no tokens. Rows of equal id are counted each by
    itself, a null id stays null; an empty table gives no rows; other columns are not read.
    """
    if not 0 < 4 * overlap <= chunk:
        raise ValueError("a chunk must be four overlaps long at least")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter.lengths(batch.column(2)))], names=["id", "n_bytes", "n_tokens"])

    size = F.octet_length("text").cast("long").alias("n_bytes")
    if not Counter(tokenizer_path).spliced:
        return _named(rows.select("id", size, "text").mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long"), id_col, limit)
    is_long = F.length("text") > chunk
    short = rows.filter(~is_long).select("id", size, "text").mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    long = _of_long(rows.filter(is_long).select("id", size, "text"), tokenizer_path, chunk, overlap)
    return _named(short.unionByName(long), id_col, limit)


def _named(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
