"""The conversation trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from barometry.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, seq int, turns int"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            # Turns of one number are ordered by their digest.
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    return out


def plain_trie(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(set), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    for p in members:
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += p not in kids
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def rows_of(frame):
    assert frame.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in frame.collect())


def some_turns(n, seed):
    pick = random.Random(seed)
    rows = []
    for c in pick.sample(range(n * 2), n):
        length = pick.choice([1, 2, 3, 5, 8, 12])
        kind = pick.randrange(4)
        for t in range(length):
            text = f"t{t}" if kind == 0 else f"{t}{pick.randrange(2)}" if kind < 3 else pick.choice(["", None, "é漢😀", "x" * 50])
            rows.append((c, t if pick.random() > 0.02 else None, pick.choice(["user", "user", None]) if kind == 3 else ("user", "assistant")[t % 2], text, 0, 0))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block_rows", "block_turns"), [(4, 1000), (16, 40), (1 << 16, 1 << 20)])
def test_trie_equals_all_prefixes(spark, block_rows, block_turns):
    rows = some_turns(300, block_rows)
    # One hundred's first conversation has nothing or little, and some copies lie far apart.
    rows += [(c, t, "user", f"copy {t}", 0, 0) for c in range(1000, 1400, 3) for t in range(9)] + [(None, 0, "user", "no conversation", 0, 0)]
    # A repeated row is a turn of its own.
    rows += [(2000, 1, "user", "again", 0, 0)] * 3 + [(2100, 0, "user", "one", 0, 0), (2101, 0, "user", "one", 0, 0)]
    found = trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, SCHEMA).repartition(5)), block_rows, block_turns)
    assert rows_of(found) == plain_trie(rebuilt(rows))


def test_chains_of_prefixes_end(spark):
    """Every string is a prefix of the next: blocks are all edge, so they must grow."""
    rows = [(c, t, "user", f"{t}", 0, 0) for c in range(1, 90) for t in range(c)]
    conversations = trie.sequences(spark.createDataFrame(rows, SCHEMA))
    want = plain_trie({c: [("user", f"{t}") for t in range(c)] for c in range(1, 90)})
    assert rows_of(trie.prefix_trie(conversations, 4, 1000)) == want


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.rebuilt(empty)).count() == 0
    one = spark.createDataFrame([(7, None, None, None, 0, 0)], SCHEMA)
    assert rows_of(trie.prefix_trie(trie.sequences(one))) == plain_trie({7: [("", "")]})
    # Without its block's first conversation, one may have no turn left; it is a member of the root.
    bare = [(c, 0, "user", "hi", 0, 0) for c in range(1, 9)]
    assert rows_of(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(bare, SCHEMA)))) == plain_trie(rebuilt(bare))


def test_many_members_end_in_blocks_of_ids(spark):
    rows = [(c, 0, "user", "hi", 0, 0) for c in range(5000)]
    found = trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, SCHEMA).repartition(9)), 64, 1 << 20)
    assert rows_of(found) == plain_trie({c: [("user", "hi")] for c in range(5000)})
