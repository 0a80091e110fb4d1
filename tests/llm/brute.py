"""Brute-force versions of the operators, on lists of rows."""

import hashlib
from collections import defaultdict

import numpy as np
import xxhash


def sha(data):
    return hashlib.sha256(data).hexdigest()


def words(text):
    return (text or "").encode().split()


def passages(texts, window=35):
    uses = defaultdict(int)
    split = [words(t) for t in texts]
    for w in split:
        for i in range(len(w) - window + 1):
            uses[tuple(w[i : i + window])] += 1
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if uses[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def suffixes(rows, window=100):
    """``rows``: (id, text), unique ids."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            x = data[i : i + window]
            if x in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(x)
        runs = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), runs, sha(kept))
    return out


def lines(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)

    def key_of(line):
        key = line.encode().strip(b" \t\n\x0b\x0c\r").lower()
        return key if len(key.decode()) >= min_chars else None

    for key, text in rows:
        for line in (text or "").split("\n"):
            if key is not None and key_of(line):
                holders[key_of(line)].add(key)
    out = []
    for key, text in rows:
        all_lines = (text or "").split("\n")
        kept = [
            x for x in all_lines
            if key is None or key_of(x) is None or len(holders[key_of(x)]) < min_docs
            or max(holders[key_of(x)]) == key
        ]
        out.append((key, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text, n=3):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(
        1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes)
    )


def components(values, distance=3):
    """Index of the first member of each value's component."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    x = np.array(values, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= distance):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]
