"""Plain, slow versions of the operators, for comparison on small inputs."""

import hashlib
import re
from collections import defaultdict

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard_components(rows, numerator=75):
    """(doc_id, n_shingles, component_id) of unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            where[s].append(i)
    pairs = {(a, b) for found in where.values() for a in found for b in found if a < b}
    for a, b in pairs:
        inner = len(sets[a] & sets[b])
        if 100 * inner >= numerator * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def repeated_bytes(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = defaultdict(int)
    for _, d in data:
        for s in range(len(d) - length + 1):
            seen[d[s : s + length]] += 1
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)
