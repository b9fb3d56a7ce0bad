"""Best-fit packing of documents into training sequences.

The histogram of piece lengths (at most ``capacity`` entries) carries the whole problem.
On it, a configuration linear program (cover every length's pieces with as few configurations
as possible, in fractions) is solved by multiplicative weights: lengths have prices, at first
their share of a sequence; each round a knapsack dynamic program over the capacity finds the
configurations of most worth, which are used for the pieces that they lead with, and lengths
covered more than others lose price, those covered less gain. Prices over the worth of the best
configuration are feasible for the dual program, so each round also bounds the sequences from
below. The fractions are rounded down to whole sequences, whose slots take the longest pieces of their
size that are left and whose last slot takes whatever fits best; what that leaves goes by best fit
into open sequences, then into new ones. Sequences that stay emptier than others are dissolved
and their pieces fitted anew, by prices in whole numbers or by best fit. The
plan is a table of (length, run of ranks) -> places whose size depends on the histogram, not on
the corpus; Spark ranks the pieces within their length and looks the places up.
"""

import math
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .textblocks import in_batches
from .tokens import END_ID, Encoder, crc32_of

Pattern = tuple[tuple[tuple[int, int], ...], int]
#: Pieces over capacity / SHORT are long and go by the program; distinct sizes it tells apart, at most, and at a second try; how far below the best worth a configuration may be; how near to the bound is near enough for no second try.
SHORT, GROUPS, SLACK, NEAR = 8, (64, 192), 0.01, 0.001


def price(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each room, the most weight that fits and the length to take first (0: none).

    weights[l] is the weight of a piece of length l (0: none left).
    """
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    there = np.flatnonzero(weights)
    for room in range(1, capacity + 1):
        fits = there[: np.searchsorted(there, room, "right")]
        best[room], take[room] = best[room - 1], take[room - 1]
        if len(fits):
            value = weights[fits] + best[room - fits]
            k = int(value.argmax())
            if value[k] > best[room]:
                best[room], take[room] = value[k], fits[k]
    return best, take


def configuration(first: int, room: int, take: np.ndarray) -> Counter:
    items = Counter([first])
    room -= first
    while room > 0 and (length := int(take[room])):
        items[length] += 1
        room -= length
    return items


def priced(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, list[Counter]]:
    """The most worth a configuration of sizes can have, and for each size the configuration of most worth that has one of it; by dynamic programming over pieces and room."""
    most = capacity // int(sizes.min())
    best = np.zeros((most + 1, capacity + 1))
    take = np.zeros((most + 1, capacity + 1), np.int32)
    for k in range(1, most + 1):
        best[k], take[k] = best[k - 1], -1
        for g, size in enumerate(sizes):
            value = best[k - 1][: capacity + 1 - size] + prices[g]
            better = value > best[k][size:]
            best[k][size:][better] = value[better]
            take[k][size:][better] = g
    out = []
    for g, size in enumerate(sizes):
        items, k, room = Counter([g]), most - 1, capacity - int(size)
        while k > 0:
            if (h := int(take[k][room])) >= 0:
                items[h] += 1
                room -= int(sizes[h])
            k -= 1
        out.append(items)
    return float(best[most][capacity]), out


def grouped(histogram: dict[int, int], capacity: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the long pieces, their counts, and the size's index of each length (-1: short): all lengths, if there are few, or most groups of about as many pieces, each as long as its longest."""
    lengths = np.array(sorted(length for length in histogram if length * SHORT > capacity), np.int64)
    counts = np.array([histogram[int(length)] for length in lengths], np.int64)
    group = np.arange(len(lengths))
    if len(lengths) > most:
        group = np.unique(np.ceil(np.cumsum(counts) / counts.sum() * most), return_inverse=True)[1]
    of = np.full(capacity + 1, -1)
    of[lengths] = group
    sizes, n = np.zeros(group.max() + 1 if len(group) else 0, np.int64), np.zeros(group.max() + 1 if len(group) else 0, np.int64)
    np.maximum.at(sizes, group, lengths)
    np.add.at(n, group, counts)
    return sizes, n, of


def program(sizes: np.ndarray, n: np.ndarray, capacity: int, rounds: int = 300, rate: float = 1.0) -> tuple[dict[tuple[tuple[int, int], ...], float], np.ndarray, float]:
    """Fractions of configurations ((size's index, count), ...) that cover n pieces of each size, the best prices met, and the bound that they give.

    In each round the configurations of most worth are used for the pieces they lead with.
    Covers of earlier rounds fade, as their prices were worse. rate: how much a size's price
    moves with the share of its pieces that are covered.
    """
    # A size's share of a sequence, or steps of it: of these prices those that bound the sequences best begin.
    steps = lambda k: np.where(sizes * (k + 1) % capacity == 0, sizes / capacity, sizes * (k + 1) // capacity / k)
    begin = [sizes / capacity, *(w for w in map(steps, range(1, SHORT)) if w.any())]
    worths = [priced(sizes, w, capacity)[0] for w in begin]
    weights = begin[int(np.argmax([(n * w).sum() / x for w, x in zip(begin, worths, strict=True)]))]
    # Prices of nothing could never rise.
    weights = np.maximum(weights, 1e-6)
    used: dict[tuple[tuple[int, int], ...], float] = {}
    cover, top, at = np.zeros(len(sizes)), 0.0, weights
    best: tuple[float, dict] = (math.inf, {})
    for turn in range(rounds):
        worth, each = priced(sizes, weights, capacity)
        if (n * weights).sum() / worth > top:
            top, at = float((n * weights).sum() / worth), weights / worth
        fade = 1 - 1 / (2 + turn / 4)
        used = {c: k * fade for c, k in used.items() if k * fade > 1e-6}
        cover *= fade
        seen, slack = np.zeros(len(sizes)), max(SLACK, 0.1 / (1 + turn / 20))
        for g in np.argsort(-sizes):
            value = sum(weights[h] * a for h, a in each[g].items())
            need = n[g] - seen[g]
            if need <= 0 or value < (1 - slack) * worth:
                continue
            k = need / each[g][g] * (1 - fade)
            for h, a in each[g].items():
                seen[h] += k * a / (1 - fade)
                cover[h] += k * a
            key = tuple(sorted(each[g].items()))
            used[key] = used.get(key, 0.0) + k
        share = cover / n
        if share.min() > 0 and sum(used.values()) / share.min() < best[0]:
            best = sum(used.values()) / share.min(), {c: k / share.min() for c, k in used.items()}
        weights = weights * np.exp(rate / math.sqrt(1 + turn / 10) * np.clip(1 - share / max(share.mean(), 1e-9), -1, 1) / 4)
        weights = np.maximum(weights / weights.max(), 1e-9)
        if best[0] <= top * 1.002:
            break
    return best[1], at, top


def lower_bound(histogram: dict[int, int], of: np.ndarray, prices: np.ndarray, capacity: int) -> float:
    """What any packing needs at least, by the prices of the sizes: the lengths' worth over the most that a configuration of them can have."""
    weights = np.zeros(capacity + 1)
    for length in histogram:
        weights[length] = prices[of[length]] if of[length] >= 0 else 0.0
    total = sum(length * n for length, n in histogram.items()) / capacity
    if not weights.any():
        return total
    best, _ = price(weights, capacity)
    return max(total, sum(weights[length] * n for length, n in histogram.items()) / float(best[capacity]))


def rounded(histogram: dict[int, int], capacity: int, groups: int = GROUPS[0]) -> tuple[list[Pattern], float]:
    """The program's solution in whole sequences, with all pieces placed, and the lower bound."""
    sizes, n, of = grouped(histogram, capacity, groups)
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    if not len(sizes):
        return best_fit(*in_whole_numbers(left, Counter(), capacity), capacity), lower_bound(histogram, of, np.zeros(0), capacity)
    fractions, prices, _ = program(sizes, n, capacity)
    bound = lower_bound(histogram, of, prices, capacity)
    used = in_sequences(fractions, left, of, len(sizes), capacity)
    return repaired(best_fit(left, used, capacity), capacity, math.ceil(bound - 1e-6)), bound


def in_sequences(fractions: dict[tuple[tuple[int, int], ...], float], left: np.ndarray, of: np.ndarray, groups: int, capacity: int) -> Counter:
    """Whole sequences of the program's configurations; the pieces that they take leave left.

    A slot takes the longest piece left of its group, so a sequence has more room than its
    configuration says; its last slot takes the longest piece of any length that fits.
    """
    lists = [[int(x) for x in np.flatnonzero((of == g) & (left > 0))[::-1]] for g in range(groups)]
    there = np.flatnonzero(left).tolist()
    used: Counter = Counter()

    def drop(length: int) -> None:
        if not left[length]:
            there.pop(bisect_left(there, length))
            if of[length] >= 0:
                own = lists[of[length]]
                own.remove(length)

    for pattern, k in sorted(fractions.items(), key=lambda x: (-x[1], x[0])):
        whole = int(k + 1e-9)
        while whole > 0:
            slots: Counter = Counter()
            for g, a in sorted(pattern, key=lambda x: x[0], reverse=True):
                for length in lists[g]:
                    take = min(a, int(left[length]) - slots[length])
                    slots[length] += take
                    a -= take
                    if not a:
                        break
            slots = +slots
            if not slots:
                break
            last = min(slots)
            slots[last] -= 1
            slots = +slots
            room = capacity - sum(length * a for length, a in slots.items())
            at = bisect_right(there, room) - 1
            while left[there[at]] <= slots[there[at]]:
                at -= 1
            slots[there[at]] += 1
            alike = min(whole, *(int(left[length]) // a for length, a in slots.items()))
            used[tuple(sorted(slots.items(), reverse=True))] += alike
            whole -= alike
            for length, a in slots.items():
                left[length] -= alike * a
                drop(length)
    return used


def repaired(patterns: list[Pattern], capacity: int, enough: int) -> list[Pattern]:
    """The plan with its emptier sequences dissolved and their pieces fitted anew, for the bound on emptiness that needs fewest sequences; the full ones stay. With enough sequences or fewer there is nothing to mend."""
    made = patterns
    room = lambda pattern: capacity - sum(length * a for length, a in pattern)
    for most in (0, *(1 << i for i in range(0, capacity.bit_length(), 2))):
        if sum(k for _, k in made) <= enough:
            break
        left, kept = np.zeros(capacity + 1, np.int64), Counter()
        for pattern, k in patterns:
            if room(pattern) <= most:
                kept[pattern] += k
                continue
            for length, a in pattern:
                left[length] += a * k
        for way in (lambda: best_fit(left.copy(), kept.copy(), capacity), lambda: best_fit(*in_whole_numbers(left.copy(), kept.copy(), capacity), capacity)):  # noqa: B023
            made = min(made, way(), key=lambda patterns: sum(k for _, k in patterns))
    return made


def solve(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns ((length, count), ...) and how many sequences have each; all pieces are placed: the program's solution, rounded and mended, with finer sizes if that is not near the bound."""
    made, bound = [], 0.0
    for groups in GROUPS if histogram else ():
        found, least = rounded(histogram, capacity, groups)
        bound = max(bound, least)
        made = min(made, found, key=lambda patterns: sum(k for _, k in patterns)) if made else found
        if sum(k for _, k in made) <= math.ceil(bound * (1 + NEAR)):
            break
    return made


def in_whole_numbers(left: np.ndarray, used: Counter, capacity: int, rounds: int = 40, share: float = 0.5, rate: float = 0.02) -> tuple[np.ndarray, Counter]:
    """left and used after (nearly) full configurations of the pieces left are taken in whole numbers, a share of what they could take at once, by prices that rise for lengths that lag behind."""
    total = left.astype(float)
    weights = np.arange(capacity + 1, dtype=float)
    for turn in range(rounds):
        now = np.where(left > 0, weights, 0.0)
        if not now.any():
            break
        best, take = price(now, capacity)
        placed = 0
        for first in np.flatnonzero(left)[::-1]:
            if now[first] + best[capacity - first] < (1 - rate) * best[capacity]:
                continue
            items = configuration(int(first), capacity, take)
            if sum(length * a for length, a in items.items()) < capacity - turn:
                continue
            most = min(left[length] // a for length, a in items.items())
            if most < 1:
                continue
            k = max(1, int(most * (share if turn < rounds - 1 else 1)))
            for length, a in items.items():
                left[length] -= k * a
            used[tuple(sorted(items.items(), reverse=True))] += k
            placed += k
        behind = np.divide(left, total, out=np.zeros(capacity + 1), where=total > 0)
        weights *= np.exp(rate * (behind - behind[total > 0].mean()))
        if not placed and turn >= 8:
            break
    return left, used


def best_fit(left: np.ndarray, used: Counter, capacity: int) -> list[Pattern]:
    """used with the pieces left added, longest first, each where least room remains; equal sequences are handled at once."""
    done: Counter = Counter()
    open_at: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []

    def put(pattern: tuple[tuple[int, int], ...], room: int, k: int) -> None:
        if not room:
            done[pattern] += k
            return
        if not open_at[room]:
            insort(rooms, room)
        open_at[room][pattern] += k

    def added(pattern: tuple[tuple[int, int], ...], length: int, a: int) -> tuple[tuple[int, int], ...]:
        items = Counter(dict(pattern))
        items[length] += a
        return tuple(sorted(items.items(), reverse=True))

    for pattern, k in used.items():
        put(pattern, capacity - sum(length * a for length, a in pattern), k)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            pattern, k = open_at[room].popitem()
            if not open_at[room]:
                rooms.pop(at)
            a = min(room // length, max(1, n // k))
            used_now = min(k, n // a)
            if k > used_now:
                put(pattern, room, k - used_now)
            put(added(pattern, length, a), room - a * length, used_now)
            n -= a * used_now
        each = capacity // length
        if n // each:
            put(((length, each),), capacity - each * length, n // each)
        if n % each:
            put(((length, n % each),), capacity - n % each * length, 1)
    for room in rooms:
        for pattern, k in open_at[room].items():
            done[pattern] += k
    return sorted(done.items())


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Runs of ranks, sorted by (length, first rank): piece r of a length, in run i, goes to sequence
    base + (r - rank) // count at offset + length * ((r - rank) % count)."""
    runs, base, seen = [], 0, Counter()
    for pattern, k in patterns:
        offset = 0
        for length, count in pattern:
            runs.append((length, seen[length], count, base, offset))
            seen[length] += k * count
            offset += length * count
        base += k
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "count", "base", "offset"), table.T.copy(), strict=True))


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """A row per piece of each document's ids: part and local_rank number the pieces of a length within a task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b, ids, offsets in encoder(batch.column(1), end_id):
                size = np.diff(offsets)
                n = -(-size // capacity)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                bounds = np.concatenate([offsets[:-1][row] + start, offsets[-1:]]).astype(np.int32)
                crc = crc32_of(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)))
                order = np.argsort(length, kind="stable")
                new, at, count = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(at, count) + np.repeat(seen[new], count)
                seen[new] += count
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(row), part, np.int64)), pa.array(rank)], names=[id_col, "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs).select(id_col, text_col).mapInArrow(pieces, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part long, local_rank long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with its sequence_id and its offset there.

    Null texts are empty: one piece of the end id alone. Rows of equal id are documents of
    their own. Pieces longer than capacity don't exist; an empty table gives an empty one.
    """
    pieces = scratch.cut(cut_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    # At most ``capacity`` rows come to the driver, whatever the corpus.
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = places(solve(histogram, capacity))
    ranked = pieces.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 1 << 40
        keys = plan["length"] * wide + plan["rank"]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = np.searchsorted(keys, length * wide + rank, "right") - 1
            within = rank - plan["rank"][run]
            sequence = plan["base"][run] + within // plan["count"][run]
            offset = plan["offset"][run] + within % plan["count"][run] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank")).mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
