"""Plain versions of the operators for small tables."""

import hashlib
import re

import numpy as np
import xxhash

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def components(ids, links):
    """Smallest id reachable, by id."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def fingerprint(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def suffix_repeats(docs, span=50):
    """docs: (doc_id, text). Rows of the digest, by doc_id."""
    first = {}
    raw = {i: (t or "").encode() for i, t in docs}
    for i, t in raw.items():
        for s in range(len(t) - span + 1):
            key = t[s : s + span]
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - span + 1):
            if first[t[s : s + span]] < i:
                gone[s : s + span] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out
