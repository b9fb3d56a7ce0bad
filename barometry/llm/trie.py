"""The trie of conversations' prefixes: which turns many conversations start with, and what sharing them saves.

A conversation is the string of its turns' digests (128 bits a turn). Strings are sorted, with
the conversation's id behind them, so that copies spread over tasks. Blocks of sorted
neighbours become forests by union-find: the edges between neighbours, as deep as their
common prefix, are taken in descending depth, and each merge of two components makes a
branching node, or widens the one that stands at that depth. Nodes that hold neither the
first nor the last string of a block are complete and go out, with a row for each turn on the
way from their parent. What is left of a block, the nodes on its two edges, is contracted to
strings again that carry their members' counts; these are sorted and merged in the same way,
until one block holds them all.

A conversation's digests are held in one task, about 30 bytes a turn; a block holds
BLOCK_TURNS turns. Of conversations that end at one node, a task sees blocks of their joined
ids only, as SHA-256 takes these in order.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .textblocks import take_ranges

#: Strings and turns of a block.
BLOCK_ROWS, BLOCK_TURNS = 1 << 16, 1 << 20
DIGEST = 16
NODE, STRING, ENDS = 0, 1, 2
_NONE = hashlib.sha256(b"").hexdigest()
_FIELDS = "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, seq binary, chars array<int>"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
_TYPES = dict(zip(_NAMES, [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.binary(), pa.list_(pa.int32())], strict=True))
_VALUES = ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns, an array of (turn, digest, chars) in order of turn (null first; rows of equal turn by their digest).

    Null roles and texts are empty. Rows without a conversation's id belong to none and are left out.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).alias("chars")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame, block: int = 100, heads: int = 6, **columns: str) -> DataFrame:
    """sequences() with each conversation's first turns replaced by those of the first conversation of its block of ids.

    Of conversation c, the first h = crc32(decimal c) % heads turns come from conversation
    c - c % block (fewer if it has fewer, none if there is none), the others are its own after its first h.
    """
    # Shuffled by block once: a conversation's rows and its block's are in one task.
    conv = columns.get("conv_col", "conv_id")
    base = F.col("conv_id") - F.col("conv_id") % block
    own = sequences(turns.withColumn("_base", F.col(conv) - F.col(conv) % block).repartition("_base"), **columns).withColumn("base", base)
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, heads - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    nothing = F.slice("turns", 1, 0)
    return own.withColumn("first", F.coalesce(first, nothing)).select("conv_id", F.concat(F.slice("first", F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _strings(conversations: DataFrame) -> DataFrame:
    digests = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return conversations.select(F.unhex(digests).alias("seq"), F.transform("turns", lambda t: t["chars"]).alias("chars"), "conv_id", one.alias("n_convs"), none.alias("n_children"), none.alias("n_leaves"), none.alias("saved_tokens"))


def _merged(lens: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The forest over distinct sorted strings of lens turns, neighbours having common turns: depth, parent (root: -1) and a string of each node, and which node each index stands for.

    Node i < len(lens) is string i's own; the others branch. The root is always there.
    """
    n = len(lens)
    depth, parent, string, same, head, top = lens.tolist(), [-1] * n, list(range(n)), list(range(n)), list(range(n)), list(range(n))

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for e in np.argsort(-common, kind="stable").tolist():
        d, a, b = int(common[e]), find(e), find(e + 1)
        left, right = top[a], top[b]
        if depth[left] == d:
            node = left
            if depth[right] == d:
                same[right] = left
            else:
                parent[right] = left
        elif depth[right] == d:
            node = right
            parent[left] = right
        else:
            node = len(depth)
            depth.append(d)
            parent.append(-1)
            string.append(e)
            same.append(node)
            parent[left] = parent[right] = node
        head[b], top[a] = a, node
    last = top[find(0)]
    if depth[last] > 0:
        depth.append(0)
        parent.append(-1)
        string.append(0)
        same.append(len(depth) - 1)
        parent[last] = len(depth) - 1
    node = np.array(same)
    while (node[node] != node).any():
        node = node[node]
    up = np.array(parent)
    up[up >= 0] = node[up[up >= 0]]
    return np.array(depth), up, np.array(string), node


def _batch(n: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(n, t)) for c, t in _TYPES.items()]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _block(rows: pa.Table, level: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Complete nodes, contracted strings and, at level 0, the ids of conversations that end at incomplete nodes. whole: this block has all strings, so every node is complete."""
    seqs = rows["seq"].to_pylist()
    size = np.array([len(s) // DIGEST for s in seqs], np.int64)
    start = np.cumsum(size) - size
    digests = np.frombuffer(b"".join(seqs), "<u8").reshape(-1, DIGEST // 8)
    chars = rows["chars"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(chars)])
    # Common turns of neighbours: the first place where they differ, or the shorter one's length.
    short = np.minimum(size[:-1], size[1:])
    common = short.copy()
    if short.sum():
        differ = (digests[take_ranges(start[:-1], short)] != digests[take_ranges(start[1:], short)]).any(1)
        place = take_ranges(np.zeros(len(short), np.int64), short)
        some = short > 0
        at = np.where(differ, place, np.iinfo(np.int64).max)
        common[some] = np.minimum(short[some], np.minimum.reduceat(at, (np.cumsum(short) - short)[some]))
    begins = np.flatnonzero(np.append(True, (common < size[:-1]) | (common < size[1:])))
    stops = np.append(begins[1:], len(seqs))
    lens = size[begins]
    depth, parent, string, node = _merged(lens, common[begins[1:] - 1])
    count = len(depth)
    ids = rows["conv_id"].to_numpy()
    low = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(low, node[: len(lens)], np.minimum.reduceat(ids, begins))
    n, kids, leaves, saved = (np.zeros(count, np.int64) for _ in range(4))
    for into, name in ((n, "n_convs"), (kids, "n_children"), (leaves, "n_leaves"), (saved, "saved_tokens")):
        np.add.at(into, node[: len(lens)], np.add.reduceat(rows[name].to_numpy(), begins))

    is_open = np.zeros(count, bool)
    if not whole:
        for x in (int(node[0]), int(node[len(lens) - 1])):
            while x >= 0 and not is_open[x]:
                is_open[x] = True
                x = int(parent[x])
    at = start[begins][string]
    real = np.flatnonzero(node == np.arange(count))
    shut = real[~is_open[real]]
    for x in shut[np.argsort(-depth[shut], kind="stable")].tolist():
        leaves[x] = leaves[x] if kids[x] else 1
        p = parent[x]
        if p >= 0:
            n[p] += n[x]
            low[p] = min(low[p], low[x])
            kids[p] += 1
            leaves[p] += leaves[x]
            saved[p] += saved[x] + (n[x] - 1) * (upto[at[x] + depth[x]] - upto[at[x] + depth[p]])

    def key(x: int) -> bytes:
        r = begins[string[x]]
        return hashlib.sha256(seqs[r][: DIGEST * int(depth[x])]).digest()

    if len(shut):
        above = np.where(parent[shut] >= 0, depth[parent[shut]], -1)
        steps = depth[shut] - above
        each = np.repeat(np.arange(len(shut)), steps)
        x, d = shut[each], take_ranges(above + 1, steps)
        own = d == depth[x]
        up = parent[x]
        first = d == above[each] + 1
        to_open = first & (up >= 0) & is_open[up]
        over = np.where(first, low[np.maximum(up, 0)], low[x])
        names = {int(p): key(int(p)) for p in np.unique(up[to_open])}
        ends = {}
        if level == 0:
            for r in np.flatnonzero(~is_open[node[: len(lens)]]).tolist():
                ends[int(node[r])] = hashlib.sha256(",".join(map(str, ids[begins[r] : stops[r]].tolist())).encode()).hexdigest()
        yield _batch(
            len(x),
            kind=np.full(len(x), NODE, np.int32),
            key=[key(a) if o else None for a, o in zip(x.tolist(), own.tolist(), strict=True)] if level else pa.nulls(len(x), pa.binary()),
            parent_key=[names[p] if t else None for p, t in zip(up.tolist(), to_open.tolist(), strict=True)],
            conv_id=low[x],
            depth=d,
            parent_conv_id=pa.array(over, mask=to_open | (first & (up < 0))),
            n_convs=n[x],
            n_children=np.where(own, kids[x], 1),
            n_leaves=leaves[x],
            saved_tokens=saved[x] + (n[x] - 1) * (upto[at[x] + depth[x]] - upto[at[x] + np.maximum(d - 1, 0)]),
            ends_sha256=[ends.get(a, _NONE) if o else _NONE for a, o in zip(x.tolist(), own.tolist(), strict=True)],
        )
    left = real[is_open[real]]
    if len(left):
        heads = [begins[string[x]] for x in left.tolist()]
        yield _batch(
            len(left),
            kind=np.full(len(left), STRING, np.int32),
            conv_id=low[left],
            n_convs=n[left],
            n_children=kids[left],
            n_leaves=leaves[left],
            saved_tokens=saved[left],
            seq=[seqs[r][: DIGEST * int(depth[x])] for x, r in zip(left.tolist(), heads, strict=True)],
            chars=[chars[start[r] : start[r] + depth[x]].tolist() for x, r in zip(left.tolist(), heads, strict=True)],
        )
        if level == 0:
            for r in np.flatnonzero(is_open[node[: len(lens)]]).tolist():
                own = ids[begins[r] : stops[r]]
                yield _batch(1, kind=[ENDS], key=[key(int(node[r]))], conv_id=[int(own[0])], ends_sha256=[",".join(map(str, own.tolist()))])


def _forests(strings: DataFrame, level: int, whole: bool, block_rows: int, block_turns: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                room = block_rows - sum(map(len, held))
                part = batch.slice(at, min(room, 4096))
                held.append(part)
                at += len(part)
                turns += len(part.column(1).flatten())
                if not whole and (sum(map(len, held)) >= block_rows or turns >= block_turns):
                    yield from _block(pa.Table.from_batches(held), level, whole)
                    held, turns = [], 0
        if held:
            yield from _block(pa.Table.from_batches(held), level, whole)

    return strings.select("seq", "chars", *_VALUES).mapInArrow(build, _FIELDS)


def _ends(blocks: DataFrame) -> DataFrame:
    """key, ends_sha256 from blocks of joined ids (key, conv_id: the first of them, ends_sha256: the text)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(2), strict=True):
                k = k.as_py()
                if k != key:
                    if state:
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])
                    key, state = k, hashlib.sha256(text.as_py().encode())
                else:
                    state.update(b"," + text.as_py().encode())
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])

    return blocks.select("key", "conv_id", "ends_sha256").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(digest, "key binary, ends string")


def prefix_trie(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct sequence of first turns, from the root (depth 0) on.

    conversations: conv_id (long, one row each, not null) and turns as sequences() gives them; a
    conversation without turns is a member of the root. Columns: conv_id (the smallest member),
    depth, parent_conv_id (the parent's smallest member; root: null), n_convs (members),
    n_children, n_leaves (childless nodes in the subtree, which includes its top), saved_tokens
    (over the subtree, each node's members but one times the code points of its last text) and
    ends_sha256 (SHA-256 of the ids of members that end here, ascending, joined by commas).
    An empty table gives no rows.
    """
    strings = scratch.cut(_strings(conversations), "strings")
    levels = []
    while True:
        level = len(levels)
        whole = level > 0 and n <= block_rows
        placed = strings.coalesce(1) if whole else strings.repartitionByRange("seq", "conv_id")
        levels.append(scratch.cut(_forests(placed.sortWithinPartitions("seq", "conv_id"), level, whole, block_rows, block_turns), f"forests-{level}"))
        if whole:
            break
        strings, before = levels[-1].filter(F.col("kind") == STRING), n if level else None
        n = strings.count()
        if n == 0:
            break
        if before and 2 * n > before:
            # Long chains of prefixes are all edge: only larger blocks make less of them.
            block_rows, block_turns = 4 * block_rows, 4 * block_turns
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = levels[0].filter(F.col("kind") == NODE).select("parent_key", *columns)
    if len(levels) > 1:
        upper = levels[1]
        for more in levels[2:]:
            upper = upper.unionByName(more)
        upper = upper.filter(F.col("kind") == NODE).select("key", "parent_key", *columns)
        found = _ends(levels[0].filter(F.col("kind") == ENDS))
        upper = scratch.cut(upper.join(found, "key", "left").withColumn("ends_sha256", F.coalesce("ends", "ends_sha256")).drop("ends"), "upper")
        heads = upper.filter("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
        every = nodes.unionByName(upper.drop("key"))
        # Nodes under one incomplete node can be most of all: their side of the join can be split, the other has one row a key.
        under = every.filter("parent_key is not null").join(heads, "parent_key").withColumn("parent_conv_id", F.col("_parent")).select(*columns)
        return every.filter("parent_key is null").select(*columns).unionByName(under)
    return nodes.select(*columns)
