"""Plain versions of the operators, for small inputs: what each contract says, in the shortest way."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def covered(n, starts, width):
    gone = [False] * n
    for s in starts:
        gone[s : s + width] = [True] * width
    return gone


def byte_dedup(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        starts = []
        for s in range(len(data) - length + 1):
            (starts.append(s) if data[s : s + length] in seen else seen.add(data[s : s + length]))
        gone = covered(len(data), starts, length)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def word_dedup(rows, window):
    first, words, out = {}, {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words[i] = w = re.findall(SPACE, text or "")
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    for i, w in words.items():
        gone = covered(len(w), [s for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < i], window)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def key_of(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)


def line_dedup(rows, min_length=20, min_docs=3):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key := key_of(line)) >= min_length:
                holders[key].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key_of(x), ())) >= min_docs and i != max(h))]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def kept_lines(rows, min_length=20, min_docs=3):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key := key_of(line)) >= min_length:
                holders[key].add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if not (len(h := holders.get(key_of(x), ())) >= min_docs and i != max(h))) for i, t in rows}


def fingerprint(text, shingle=3):
    words = re.findall(SPACE, (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    counts = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        counts.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def simhash(rows, radius=2):
    prints = {i: fingerprint(t) for i, t in rows}
    ids, parent = sorted(prints), {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= radius:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def contamination(rows, items, window=13, share=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[s : s + window])].add(item)
    out = {}
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if (piece := tuple(w[s : s + size])) in windows:
                    hit |= set(range(s, s + size))
                    found |= windows[piece]
        names = sorted(str(x) for x in found if x is not None)
        out[i] = (len(w), len(hit), len(names), sha(",".join(names)), len(hit) > 0 and share * len(hit) >= len(w))
    return out


def top_k(vectors, every, k, scale=64):
    import math

    whole = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(scale * float(x)) for x in v]))
    out = []
    for own, (a, v) in enumerate(whole):
        if a % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), b) for row, (b, w) in enumerate(whole) if row != own)
            out += [(a, r + 1, b, -s) for r, (s, b) in enumerate(scored[:k])]
    return sorted(out)
