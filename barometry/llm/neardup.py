"""Near-duplicate documents by SetSketch registers, banded, estimated, then verified.

A document's set is its distinct word shingles. Each register holds the least of the
shingles' exponential values, on an exponentially spaced scale (base 1 + 1/1000), cut at
both ends: sketches of parts merge by the registers' maxima, and equal registers say that
sets are alike. Equal sets collapse to one representative first. Bands of registers give
candidate links: first, in each bucket, from its least member to all others; once these
are verified and joined, between members that are still of different components. No
bucket's pairs are all listed, and none that could join two components is left out. The
joint likelihood of two sketches estimates the similarity and drops hopeless candidates
(further below the threshold than the estimate can err); every link is then confirmed on
the full sets. Between components, an odd sketch (the parity of the shingles in each of many
hash groups) comes first: groups that differ in parity each hold a shingle of one set only, so
their number is a lower bound of the difference, and no pair that could be a link is lost.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .textblocks import SPACED, blocks, in_batches, mix, word_hashes, words

REGISTERS, BAND = 192, 6
#: 64-bit words of the odd sketch.
ODD_WORDS = 32
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Standard errors of the estimate below the threshold at which a candidate is given up.
SLACK = 6.0
_U = np.uint64
_ORDER = mix(np.arange(1, 65, dtype=_U))


def shingle_sets(hashes: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted. Rows with fewer words have their whole sequence as one, those without words none."""
    hashes = mix(hashes)
    n = np.diff(first)
    out = []
    rolled = np.zeros(max(0, len(hashes) - size + 1), _U)
    for j in range(size):
        rolled += hashes[j : j + len(rolled)] * (_ORDER[j] | _U(1))
    rolled = mix(rolled)
    for a, k in zip(first[:-1], n, strict=True):
        if k >= size:
            out.append(np.unique(rolled[a : a + k - size + 1]))
        elif k:
            out.append(mix((hashes[a : a + k] * (_ORDER[:k] | _U(1))).sum(dtype=_U, keepdims=True) + _ORDER[63 - k]))
        else:
            out.append(np.zeros(0, _U))
    return out


def odd_sketch(sets: list[np.ndarray], words: int = ODD_WORDS) -> np.ndarray:
    """The parity of each set's elements in each of 64 * words hash groups, as words (a row per set)."""
    size = np.array([len(s) for s in sets])
    groups = 64 * words
    at = (np.concatenate([*sets, np.zeros(0, _U)]) % _U(groups)).astype(np.int64) + np.repeat(np.arange(len(sets)), size) * groups
    odd = np.bincount(at, minlength=len(sets) * groups) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").reshape(len(sets), words)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def sketch(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """Registers (a row per set, uint16). Each element deals ascending exponential values to random registers; values that are almost surely above all minima are not generated, and rows with a register left empty are done again with more."""
    size = np.array([len(s) for s in sets])
    least = np.full((len(sets), registers), np.inf)
    todo, reach = np.flatnonzero(size), 12.0
    while len(todo):
        element = np.concatenate([sets[r] for r in todo])
        row = np.repeat(np.arange(len(todo)), size[todo])
        limit = (reach / size[todo])[row]
        value, state, flat = np.zeros(len(element)), element, np.full(len(todo) * registers, np.inf)
        step = 0
        while len(state):
            step += 1
            h = mix(state + np.array(step, _U) * _U(0x9E3779B97F4A7C15))
            value = value - np.log(_uniform(h)) / registers
            keep = value < limit
            value, state, row, limit, h = value[keep], state[keep], row[keep], limit[keep], h[keep]
            np.minimum.at(flat, row * registers + (mix(h ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(registers)).astype(np.int64), value)
        least[todo] = flat.reshape(-1, registers)
        todo, reach = todo[np.isinf(least[todo]).any(1)], reach * 2
    with np.errstate(divide="ignore"):
        scaled = np.floor(1.0 - np.log(least / RATE) / math.log(BASE))
    return np.where(size[:, None] > 0, np.clip(scaled, 0, TOP + 1), 0).astype(np.uint16)


def likely_similarity(more: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Similarity of greatest likelihood, given how many registers of a are greater and less than b's and both sizes."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    equal = registers - more - less

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(50):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        rising = likelihood(x) < likelihood(y)
        low, high = np.where(rising, x, low), np.where(rising, high, y)
    return (low + high) / 2


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for block in blocks(texts):
        w, low = words(block, SPACED)
        yield block.start, block.stop, shingle_sets(word_hashes(w, low), w.first, size)


def sketches(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", registers: int = REGISTERS) -> DataFrame:
    """id, n_shingles, digest (of the whole set), registers (little-endian uint16) and odd sketch per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch.column(1), size):
                rows = sketch(sets, registers).astype("<u2")
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(list(odd_sketch(sets)), pa.list_(pa.int64()))], names=["id", "n_shingles", "digest", "registers", "odd"])

    return in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_shingles long, digest binary, registers binary, odd array<long>")


def _estimated(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) whose sizes allow the threshold and whose likely similarity is not too far below it."""
    threshold = percent / 100
    margin = SLACK * math.sqrt(threshold * (1 - threshold) / REGISTERS)
    side = lambda k: rows.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(len(batch), -1) for k in ("r_a", "r_b"))
            estimate = likely_similarity((ra > rb).sum(1), (ra < rb).sum(1), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            keep = pa.array(estimate >= threshold - margin)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return joined.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """pairs (a, b) whose full sets are as alike as asked."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "members"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    asked = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(asked, "id", "left_semi")
    sets = scratch.cut(texts.mapInArrow(build, "id long, members binary"), "sets", compression="none")
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    return scratch.cut(joined.mapInArrow(compare, "a long, b long"), "verified")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id (the least id reachable over links, itself included) and kept (it is that document).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle
    sets. Null and empty texts have no set and link with nothing; an empty table gives an empty
    one; other columns are not read. Ids are taken as the documents' names: rows of equal id
    and text are one document listed again, ids must not be null.

    A pair of similarity t shares a band with a chance of 1 - (1 - t ** BAND) ** (REGISTERS / BAND):
    0.92 at 65 percent, 0.9999 at 80 and 0.9999997 at 85; all else is exact.
    """
    if size < 1 or not 65 <= percent <= 100:
        raise ValueError("size must be at least 1 and percent from 65 to 100: below that the bands miss more than a tenth of the pairs")
    rows = scratch.cut(sketches(docs, size, id_col, text_col), "sketches", compression="none")
    full = rows.filter("n_shingles > 0")
    classes = scratch.cut(full.groupBy("digest").agg(F.min("id").alias("representative")), "classes")
    heads = scratch.cut(full.join(classes.select(F.col("representative").alias("id")), "id", "left_semi").select("id", "n_shingles", "registers", "odd"), "heads", compression="none")

    keys = F.array(*(F.xxhash64(F.expr(f"substring(registers, {2 * BAND * k + 1}, {2 * BAND})"), F.lit(k)) for k in range(REGISTERS // BAND)))
    members = heads.select("id", F.explode(keys).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    buckets = scratch.cut(members.join(shared.select("bucket", "least"), "bucket"), "buckets")

    tried = scratch.cut(buckets.filter("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "tried")
    links = _verified(scratch.cut(_estimated(tried, heads, percent), "likely"), docs, percent, size, id_col, text_col)
    joined = scratch.cut(components(links), "components")

    sized = buckets.join(heads.select("id", "n_shingles"), "id").join(joined, "id", "left").select("bucket", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    split = sized.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("bucket")
    apart = scratch.cut(sized.join(split, "bucket", "left_semi").join(heads.select("id", "odd"), "id"), "apart", compression="none")
    left, right = (apart.select("bucket", F.col("id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("component").alias(f"c_{k}"), F.col("odd").alias(f"o_{k}")) for k in "ab")
    # percent * union <= 100 * intersection bounds the difference by the sizes.
    differ = sum((F.bit_count(F.col("o_a")[k].bitwiseXOR(F.col("o_b")[k])) for k in range(ODD_WORDS)), F.lit(0))
    close = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
    pairs = left.join(right, (left.bucket == right.bucket) & (F.col("c_a") < F.col("c_b")) & close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _verified(scratch.cut(_estimated(pairs.join(tried, ["a", "b"], "left_anti"), heads, percent), "likely"), docs, percent, size, id_col, text_col)
    joined = scratch.cut(components(links.union(more)), "components")

    named = rows.join(classes, "digest", "left").select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("representative")).otherwise(F.col("id")).alias("head"))
    out = named.join(joined.select(F.col("id").alias("head"), "component"), "head", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "head").alias("component_id")).withColumn("kept", F.col(id_col) == F.col("component_id"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, and with all their columns.

    Of rows of equal id and text one stays. A row without an id is named by its text's hash, so
    it links and stays as others do. Null and empty texts link with nothing and stay.
    """
    version = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # Names of their own lie below all ids that are at least -2 ** 62.
    name = F.coalesce(F.col(id_col).cast("long"), -F.abs(version % F.lit(2**61)) - F.lit(2**62))
    keyed = docs.withColumns({"_name": name, "_version": version})
    kept = near_duplicates(keyed, size, percent, "_name", text_col).filter("kept").select("_name").distinct()
    one = Window.partitionBy("_name", "_version").orderBy("_name")
    return keyed.join(kept, "_name", "left_semi").withColumn("_rank", F.row_number().over(one)).filter("_rank = 1").select(docs.columns)
