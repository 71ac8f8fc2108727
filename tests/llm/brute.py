"""Plain forms of the contracts, for small inputs."""

import hashlib
import re
import zlib

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def repeats(rows, n=13):
    """[(doc_id, n_words, n_removed, kept_sha256)] for rows (doc_id, text)."""
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - n + 1):
            if i is not None:
                x = tuple(w[j : j + n])
                first[x] = min(i, first.get(x, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if i is not None and first[tuple(w[j : j + n])] < i:
                gone[j : j + n] = [True] * n
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), sha(" ".join(kept))))
    return out


def shingles(text, n):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near(rows, n=2, percent=80):
    """{doc_id: (set size, component)} for rows (doc_id, text) with distinct ids."""
    sets = {i: shingles(t, n) for i, t in rows}
    comp = {i: i for i in sets}

    def of(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((of(a), of(b)))
                    comp[y] = x
    return {i: (len(sets[i]), of(i)) for i in ids}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(rows, items, n=13):
    wins = {}
    for i, t in items:
        w = bench_words(t)
        for j in range(max(1, len(w) - n + 1) if w and i is not None else 0):
            wins.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    lengths = sorted({len(w) for w in wins})
    out = []
    for i, t in rows:
        w = bench_words(t)
        hit, found = [False] * len(w), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                if i is not None and (x := wins.get(tuple(w[j : j + k]))):
                    found |= x
                    hit[j : j + k] = [True] * k
        h = sum(hit)
        out.append((i, len(w), h, len(found), sha(",".join(sorted(found))), h > 0 and 20 * h >= len(w)))
    return out


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
