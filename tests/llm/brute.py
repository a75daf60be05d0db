"""The operators' results worked out plainly, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, window=10):
    """``{doc_id: (n_words, n_hit, item ids in string order)}``."""
    windows = {}
    for item, text in items:
        w = item_words(text)
        for i in range(max(len(w) - window + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    lengths = sorted({len(w) for w in windows})
    found = {}
    for doc, text in docs:
        w = item_words(text)
        hit, names = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                of = windows.get(tuple(w[i : i + n]))
                if of:
                    hit.update(range(i, i + n))
                    names |= of
        found[doc] = (len(w), len(hit), sorted(names))
    return found


def items_sha256(names):
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def simhash(text, words=3):
    parts = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(len(parts) - words + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints, radius=2):
    """The smallest reachable id of each ``(id, fingerprint)``, by position."""
    import numpy as np

    points = np.array([f for _, f in fingerprints], np.uint64)
    root = list(range(len(points)))

    def top(i):
        while root[i] != i:
            i = root[i] = root[root[i]]
        return i

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= radius) + i + 1:
            a, b = sorted((top(i), top(int(j))))
            root[b] = a
    least = {}
    for i, (doc, _) in enumerate(fingerprints):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [least.get(top(i)) for i in range(len(points))]
