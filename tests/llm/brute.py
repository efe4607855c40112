"""Plain Python versions of the operators for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return SPACES.findall(lowered(text))


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(ids, linked):
    """Smallest id reachable from each id."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_duplicates(rows, percent):
    """{doc_id: (set size, component)} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    linked = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                linked.append((a, b))
    found = components(ids, linked)
    return {i: (len(sets[i]), found[i]) for i in ids}


def removed(rows, length):
    """(doc_id, bytes, removed, spans, digest) by counting every window."""
    counts = collections.Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        counts.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if counts[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def bag(w):
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def contaminated(rows, items, percent=80):
    """(doc_id, item_id) pairs whose best window of the item's size is similar enough."""
    found = set()
    for i, text in rows:
        w = words(text)
        for k, item in items:
            iw = words(item)
            if not iw or not w:
                continue
            ib, m = bag(iw), len(iw)
            if m < 5:
                best = float(any(w[s : s + m] == iw for s in range(len(w) - m + 1)))
            else:
                best = 0
                for s in range(max(1, len(w) - m + 1)):
                    wb = bag(w[s : s + m]) if len(w[s : s + m]) >= 5 else collections.Counter()
                    best = max(best, sum((wb & ib).values()) / sum((wb | ib).values()))
            if best * 100 >= percent - 1e-9:
                found.add((i, k))
    return found
