"""Plain versions of the contracts, over lists of (id, text)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near_duplicates(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    both = Counter()
    for ds in holders.values():
        ds = sorted(set(ds))
        both.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1 :])
    head = {d: d for d in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            head[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def encode(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def contamination(rows, items, window):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for k, t in items:
        w = find(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(k)
    lengths = {len(x) for x in windows}
    out = {}
    for d, t in rows:
        w, hit, seen = find(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    seen |= windows[x]
        names = sorted(map(str, seen))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


def quality_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = defaultdict(list), set()
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    for at in seen.values():
        if len(at) > 1:
            repeated.update(j for i in at for j in range(i, i + 8))
    lines, before, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in before
            before.add(x)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w))


PATTERNS = (("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))


def secrets(text):
    spans = []
    for rank, (kind, p, group, least) in enumerate(PATTERNS):
        spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(p, text or "", re.A) if len(m.group(group)) >= least]
    spans.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    n = Counter(k for _, _, k, _ in spans)
    return (n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest()), joined


def repeats(rows, size):
    where = Counter()
    data = {d: (t or "").encode() for d, t in rows}
    for b in data.values():
        where.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = {}
    for d, b in data.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if where[b[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out
