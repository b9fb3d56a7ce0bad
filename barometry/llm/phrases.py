"""Collocations: the phrases of each language whose words keep together far more often than chance would have it.

Phrases grow from their first words, best first. A phrase scores floor(1000 a n / (l r)) at the
cut where that is least (a, l, r: occurrences of the phrase and of its parts before and behind
the cut, n: all words). As r >= a, no phrase scores above 1000 n / f(first word): the count of
the first word, the shortest prefix, bounds all that grows from it. The frontier is the frequent words, rarest
first, in bands of counts. A band's words are grown to phrases, and these judged; a language
is settled when so many phrases survive that the last of them scores more than anything that
could grow from the words beyond the band, so no tie is missed either.

Only words, and prefixes, that occur often enough are grown. Tasks know them by a bitmap of
fixed size: a word or prefix that shares a bit with a frequent one costs a row, and counting
drops it. Words are known by 64-bit hashes, of which a second hash proves that no two frequent
ones share one; what decides is counted by the phrase's words, not by a hash of them.
"""

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .textblocks import blocks, class_table, in_batches, mix, take_ranges, word_hashes, words

#: Words of a phrase at most; bits of the bitmaps; rows that a task adds up before they are shuffled; how much wider each band is than the last.
LONGEST, FILTER_BITS, TALLIED, WIDER = 5, 27, 1 << 20, 16
#: Of a block's text, so many bytes.
BLOCK = 2 << 20
#: Words of a stored row, of which Spark's reader decodes 4096 at a time; bytes of a row group; words that are scanned at once; rows of a batch that a task gives back.
PIECE, ROW_GROUP, SCANNED, SENT = 1 << 9, 4 << 20, 1 << 18, 1 << 16
_U = np.uint64
_STEP = _U(0xD1342543DE82EF95)
_ENDS = np.frombuffer(b".,;:!?\n\v\f\r", np.uint8)
_WORD = class_table(np.setdiff1d(np.arange(256), np.append(_ENDS, [0x20, 9])).astype(np.uint8))
_WORD[0] = 0xFF  # NUL belongs to words; UTF-8 never has this byte
_IS_END = np.isin(np.arange(256), _ENDS)
_SECOND = np.random.default_rng(77001).integers(0, 2**64, 256, _U) | _U(1)
_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def _name(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{lang}".encode()).digest()[:8], "little")


def _read(batch: pa.RecordBatch, seed: int) -> Iterator[tuple]:
    """Of each block of a batch (lang, text): its words and bytes, each word's language and hash, and whether the next word follows in the same piece."""
    langs = batch.column(0).dictionary_encode()
    names = langs.dictionary.to_pylist()
    named = np.array([_name(x, seed) for x in names], _U)
    code = langs.indices.to_numpy()
    for block in blocks(batch.column(1), BLOCK):
        w, low = words(block, _WORD)
        if not len(w.begin):
            continue
        row = np.repeat(np.arange(block.start, block.stop), np.diff(w.first))
        lang = code[row]
        h = mix(word_hashes(w, low) ^ named[lang])
        h[h == 0] = 1
        piece = np.cumsum(_IS_END[block.data], dtype=np.int64)[w.begin]
        follows = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), False)
        yield w, low, names, lang, h, follows


def _summed(columns: list[np.ndarray], keys: int) -> list[np.ndarray]:
    """Rows of equal first columns as one row; the next column is added up, of others the first is kept."""
    order = np.lexsort(columns[:keys][::-1])
    columns = [c[order] for c in columns]
    new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]])) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return [c[at] for c in columns[:keys]] + ([np.add.reduceat(columns[keys], at)] if len(at) else [columns[keys]]) + [c[at] for c in columns[keys + 1 :]]


def _tallied(rows: Iterator[list[np.ndarray]], keys: int) -> Iterator[list[np.ndarray]]:
    """rows, added up over TALLIED of them."""
    held, n = [], 0
    for some in rows:
        held.append(_summed(some, keys))
        n += len(held[-1][0])
        if n >= TALLIED:
            held = [_summed([np.concatenate(c) for c in zip(*held, strict=True)], keys)]
            n = len(held[0][0])
            if n >= TALLIED // 2:
                yield held[0]
                held, n = [], 0
    if held:
        yield _summed([np.concatenate(c) for c in zip(*held, strict=True)], keys)


def _sent(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    """columns as batches of SENT rows: Spark holds each whole."""
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    yield from (batch.slice(i, SENT) for i in range(0, batch.num_rows, SENT))


def _word_counts(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """lang, h, n, and the second hash's extremes of each word of least occurrences; rows without h have the language's words in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        names: list[str] = []

        def rows() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                for w, low, own, lang, h, _ in _read(batch, seed):
                    place = []
                    for i, x in enumerate(own):
                        totals[x] = totals.get(x, 0) + int((lang == i).sum())
                        if x not in names:
                            names.append(x)
                        place.append(names.index(x))
                    second = word_hashes(w, low, _SECOND).view(np.int64)
                    yield [h.view(np.int64), second, np.ones(len(h), np.int64), np.array(place)[lang]]

        for h, second, n, lang in _tallied(rows(), 2):
            yield from _sent([pa.array(names, pa.string()).take(pa.array(lang)), pa.array(h), pa.array(second), pa.array(n)], ["lang", "h", "second", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.int64()), pa.nulls(len(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["lang", "h", "second", "n"])

    each = docs.mapInArrow(count, "lang string, h long, second long, n long")
    return each.groupBy("lang", "h").agg(F.sum("n").alias("n"), F.min("second").alias("low"), F.max("second").alias("high")).filter((F.col("n") >= least) | F.col("h").isNull())


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the first FILTER_BITS bits of a column of hashes: of fixed size, however many they are."""
    place = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words_of = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    found = words_of.toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[found["i"].to_numpy()] = found["b"].to_numpy()
    return bits


class Shared:
    """A bitmap for tasks; packed, as it is sparse where the words are few."""

    def __init__(self, frame: DataFrame, bits: np.ndarray):
        self.packed = frame.sparkSession.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))

    def bits(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.packed.value), np.int64)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = (h >> _U(65 - (64 * len(bits)).bit_length())).astype(np.int64)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def _runs(docs: DataFrame, bits: np.ndarray, seed: int) -> DataFrame:
    """Rows of v: the hashes of frequent words in order, 0 between those that don't follow each other.

    A row has PIECE of them of its own, the one before these (or 0) and the LONGEST behind (or 0), so a phrase at a row's end is whole.
    """
    shared, piece = Shared(docs, bits), PIECE

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.bits()
        for batch in batches:
            for _, _, _, _, h, follows in _read(batch, seed):
                known = _has(frequent, h)
                near = follows & known
                near[:-1] &= known[1:]
                # A word with a frequent neighbour is kept, with a 0 after the last one of a run.
                kept = near.copy()
                kept[1:] |= near[:-1]
                at = np.flatnonzero(kept)
                last = ~near[at]
                place = np.arange(len(at)) + np.cumsum(last) - last
                size = len(at) + int(last.sum())
                v = np.zeros(1 + size + LONGEST, np.int64)
                v[1 + place] = h[at].view(np.int64)
                start = np.arange(0, size, piece)
                length = np.minimum(piece, size - start) + 1 + LONGEST
                offsets = np.append(0, np.cumsum(length)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[take_ranges(start, length)]))], names=["v"])

    return docs.mapInArrow(make, "v array<long>")


def _spelled(docs: DataFrame, bits: np.ndarray, seed: int) -> DataFrame:
    """h and word of the words in the bitmap."""
    shared = Shared(docs, bits)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, wanted = set(), shared.bits()
        for batch in batches:
            for w, low, _, _, h, _ in _read(batch, seed):
                at = np.flatnonzero(_has(wanted, h))
                distinct, first = np.unique(h[at].view(np.int64), return_index=True)
                new = [(x, int(at[i])) for x, i in zip(distinct.tolist(), first.tolist(), strict=True) if x not in seen]
                if len(seen) > TALLIED:
                    seen.clear()
                seen.update(x for x, _ in new)
                spelled = [bytes(low[w.begin[i] : w.end[i]]).replace(b"\xff", b"\0").decode() for _, i in new]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.int64()), pa.array(spelled, pa.string())], names=["h", "word"])

    return docs.mapInArrow(spell, "h long, word string").dropDuplicates(["h"])


def _keys(v: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each size up to longest, the hash of the words from each place on; 0 where there are not so many."""
    keys = [v]
    for m in range(1, longest):
        last = np.append(v[m:], np.zeros(min(m, len(v)), _U))
        grown = mix(keys[-1] * _STEP + last)
        grown[(keys[-1] == 0) | (last == 0)] = 0
        keys.append(grown)
    return keys


def _pieces(column: pa.ListArray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of about limit words of the rows of _runs() at a time: their hashes, and which of them are a row's own."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(_U)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        edges = offsets[start : stop + 1] - offsets[start]
        own = np.ones(edges[-1], bool)
        own[edges[:-1]] = False
        for i in range(1, LONGEST + 1):
            own[edges[1:] - i] = False
        yield values[offsets[start] : offsets[stop]], own
        start = stop


def _scan(runs: DataFrame, bits: np.ndarray, make: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[list[np.ndarray]]], names: list[str], keys: int) -> DataFrame:
    """make's rows of the runs, what is a row's own and the bitmap, added up."""
    shared, limit = Shared(runs, bits), SCANNED

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.bits()
        rows = (found for batch in batches for v, own in _pieces(batch.column(0), limit) for found in make(v, own, known))
        for some in _tallied(rows, keys):
            yield from _sent([pa.array(c.view(np.int64) if c.dtype == _U else c) for c in some], names)

    return runs.select("v").mapInArrow(scan, ", ".join(f"{x} long" for x in names))


def _grown(runs: DataFrame, bits: np.ndarray, size: int, upto: int, least: int) -> DataFrame:
    """h and n of the phrases of more than size words, upto at most, that occur least times and whose first size words are in the bitmap."""

    def make(v: np.ndarray, own: np.ndarray, known: np.ndarray) -> Iterator[list[np.ndarray]]:
        keys = _keys(v, upto)
        start = np.flatnonzero((keys[size] != 0) & own)
        start = start[_has(known, keys[size - 1][start])]
        for m in range(size, upto):
            found = keys[m][start]
            found = found[found != 0]
            yield [found, np.ones(len(found), np.int64)]

    return _scan(runs, bits, make, ["h", "n"], 1).groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _told(runs: DataFrame, bits: np.ndarray, upto: int, around: bool) -> DataFrame:
    """Each phrase of two words to upto that is in the bitmap, by its words (w1, ...; 0: none): n, and with around whether all its occurrences have one and the same word before (behind) them."""
    names = [*_WORDS, "before", "behind", "n"] if around else [*_WORDS, "n"]

    def make(v: np.ndarray, own: np.ndarray, known: np.ndarray) -> Iterator[list[np.ndarray]]:
        keys = _keys(v, upto)
        for m in range(2, upto + 1):
            at = np.flatnonzero((keys[m - 1] != 0) & own)
            at = at[_has(known, keys[m - 1][at])]
            spelt = [v[at + i] if i < m else np.zeros(len(at), _U) for i in range(LONGEST)]
            yield [*spelt, *([v[at - 1], v[at + m]] if around else []), np.ones(len(at), np.int64)]

    rows = _scan(runs, bits, make, names, len(names) - 1)
    if not around:
        return rows.groupBy(*_WORDS).agg(F.sum("n").alias("n"))
    same = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    return rows.groupBy(*_WORDS).agg(F.sum("n").alias("n"), same("before").alias("led"), same("behind").alias("followed"))


def _listed() -> Column:
    return F.filter(F.array(*_WORDS), lambda x: x != 0)


def _hashed(phrases: DataFrame) -> DataFrame:
    """h of rows of p (arrays of two words or more), as _keys() gives it."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_keys(np.array(p.as_py(), np.int64).view(_U), len(p))[-1][0] for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, _U).view(np.int64))], names=["h"])

    return phrases.select("p").mapInArrow(key, "h long")


def score_of() -> Column:
    """floor(1000 a n / (l r)), exact: numerator and denominator may pass 64 bits."""
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    above, below = F.lit(1000).cast("decimal(38,0)") * whole("a") * whole("n"), whole("l") * whole("r")
    return ((above - above % below) / below).cast("long")


def _judged(runs: DataFrame, band: DataFrame, vocabulary: DataFrame, totals: DataFrame, least: int) -> DataFrame:
    """lang, p (words' hashes), a, l, r, n, score of the phrases that start with a word of the band and survive."""
    found, keys = [_bitmap(band)], []
    for size, upto in ((1, 2), (2, 3), (3, LONGEST)):
        keys.append(scratch.cut(_grown(runs, found[-1], size, upto, least), f"phrases-{upto}"))
        found.append(_bitmap(keys[-1]))
    every = keys[0].union(keys[1]).union(keys[2])
    told = _told(runs, _bitmap(every), LONGEST, around=True).filter(F.col("n") >= least)
    own = scratch.cut(told.join(band.select(F.col("h").alias("w1"), "lang"), "w1").select("lang", _listed().alias("p"), F.col("n").alias("a"), "led", "followed"), "candidates")
    size = F.size("p")
    cuts = own.filter(~((F.col("led") | F.col("followed")) & (size < LONGEST))).select("lang", "p", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("p", F.lit(1), F.col("k")), "right": F.slice("p", F.col("k") + 1, F.size("p") - F.col("k"))})
    behind = cuts.filter(F.size("right") > 1).select(F.col("right").alias("p")).distinct()
    ends = scratch.cut(_told(runs, _bitmap(_hashed(behind)), LONGEST - 1, around=False).select(_listed().alias("p"), F.col("n").alias("f")), "ends")
    single = vocabulary.select(F.array("h").alias("p"), F.col("n").alias("f"))
    left = single.union(own.select("p", "a")).select(F.col("p").alias("left"), F.col("f").alias("l"))
    right = single.union(ends).select(F.col("p").alias("right"), F.col("f").alias("r"))
    each = cuts.join(left, "left").join(right, "right").join(totals, "lang")
    least_cut = each.groupBy("lang", "p", "a", "n").agg(F.min(F.struct(score_of().alias("score"), "k", "l", "r")).alias("c"))
    return least_cut.select("lang", "p", "a", "c.l", "c.r", "n", "c.score")


def _first(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Each language's first rows, with rank; first those of 64 parts of it, so that one language is many tasks."""
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("p"), F.lit(64))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's most phrases of the highest score.

    Words are what spaces and tabs part in the pieces between . , ; : ! ? and line ends, A-Z in lower case;
    phrases are two to five words of one piece that occur least times. Of a phrase inside a longer
    one that occurs as often, only the longer counts. Order: score and a descending, then the
    phrase's UTF-8 bytes. A null language is und, a null text empty; repeated rows count each;
    languages without such phrases, and empty tables, give no rows.
    """
    rows = in_batches(docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    for seed in itertools.count():
        counted = scratch.cut(_word_counts(rows, least, seed), "words")
        # Two frequent words of one hash, or one whose count another's occurrences have raised: hash anew.
        known = counted.filter("h is not null")
        if known.filter("low <> high").isEmpty() and known.groupBy("h").count().filter("count > 1").isEmpty():
            break
    vocabulary, totals = known.select("h", "lang", "n"), counted.filter("h is null").select("lang", "n")
    runs = scratch.cut(_runs(rows, _bitmap(vocabulary), seed), "runs", **{"parquet.block.size": str(ROW_GROUP)})
    low, high, left, survivors = 0, least * WIDER, totals, None
    while True:
        band = vocabulary.join(left.select("lang"), "lang", "left_semi").filter((F.col("n") > low) & (F.col("n") <= high))
        if not band.isEmpty():
            found = scratch.cut(_judged(runs, band, vocabulary, totals, least), "judged")
            survivors = found if survivors is None else survivors.unionByName(found)
        # A language is open while words lie beyond the band and something grown from them might be among the first, or tie with the last of them.
        beyond = vocabulary.filter(F.col("n") > high).groupBy("lang").agg(F.min("n").alias("next"))
        left = left.select("lang", "n").join(beyond, "lang")
        if survivors is not None:
            last = _first(survivors, [F.desc("score")], most).filter(F.col("rank") == most).select("lang", F.col("score").alias("last"))
            left = left.join(last, "lang", "left").filter(F.col("last").isNull() | (F.col("last") <= F.expr("cast(cast(1000 as decimal(38,0)) * n div next as long)")))
        left = scratch.cut(left, "open")
        if left.isEmpty():
            break
        low, high = high, high * WIDER
    if survivors is None:
        return totals.select("lang", F.lit(0).alias("rank"), F.lit("").alias("phrase"), *(F.lit(0).cast("long").alias(c) for c in ("a", "l", "r", "n", "score"))).filter(F.lit(False)).withColumn("rank", F.col("rank").cast("long"))
    bar = _first(survivors, [F.desc("score")], most).groupBy("lang").agg(F.min("score").alias("bar"))
    near = survivors.join(bar, "lang").filter(F.col("score") >= F.col("bar")).drop("bar")
    texts = _spelled(rows, _bitmap(near.select(F.explode("p").alias("h"))), seed)
    spelled = near.select("lang", "p", F.posexplode("p").alias("i", "h")).join(texts, "h").groupBy("lang", "p").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("s"))
    phrase = F.array_join(F.transform("s", lambda x: x["word"]), " ")
    named = near.join(spelled.select("lang", "p", phrase.alias("phrase")), ["lang", "p"])
    ranked = _first(named, [F.desc("score"), F.desc("a"), F.col("phrase")], most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
