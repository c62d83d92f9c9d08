"""Plain single-threaded versions of what the operators do, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

EMPTY = "doc_id long, text string, source string, lang string, n_chars long, kept boolean, copies int"


def words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    """Texts with copies, near copies, shared passages, junk, ties, nulls and a very long one."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    texts: list[str | None] = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.4 and (base := rng.choice([t for t in texts if t])):
            w = base.split(" ")
            for _ in range(rng.choice([1, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
            if kind > 0.8:
                w.insert(rng.randrange(len(w)), passage)
            texts.append((" " if kind < 0.9 else "\n").join(w))
    texts += [None, "", " \t", "one", "x " * 300, "ab" * 3000, "\x1cweird\x85 spaces\xa0stay", " ".join(rng.choice(vocabulary) for _ in range(5000))]
    rows = [(i, t, rng.choice(["s1", "s1", "s2", "é", None]), "en", len(t or ""), i % 2 == 0, 7) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3]]


def stats(text: str | None) -> tuple:
    w = words(text)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    seen: set[str] = set()
    repeated = 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), repeated, len(covered), n < 50 or 100 * len(covered) > 50 * n


def removed_bytes(rows: list[tuple], length: int, keep: str) -> dict:
    """(n_bytes, n_removed, n_spans, sha256) by id, for unique ids."""
    places: dict[bytes, list] = {}
    for i, t, *_ in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            places.setdefault(b[p : p + length], []).append((i, p))
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            at = places[b[p : p + length]]
            if len(at) > 1 if keep == "none" else min(at) < (i, p):
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def without_repeats(rows: list[tuple], length: int) -> list[tuple]:
    """Rows whose texts have lost the bytes of windows that an earlier place has, but for code points that keep a byte."""
    first: dict[bytes, tuple] = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], (i, p))
    out = []
    for i, t, *rest in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] != (i, p):
                gone[p : p + length] = [True] * length
        kept, p = "", 0
        for c in t or "":
            n = len(c.encode())
            kept += "" if all(gone[p : p + n]) else c
            p += n
        out.append((i, None if t is None else kept, *rest))
    return out


def removed_words(rows: list[tuple], length: int = 13) -> list[tuple]:
    key = lambda i: math.inf if i is None else i
    first: dict[tuple, float] = {}
    for i, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - length + 1):
            g = tuple(w[p : p + length])
            first[g] = min(first.get(g, math.inf), key(i))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < key(i):
                gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_duplicates(rows: list[tuple], similarity: float = 0.8) -> list[tuple]:
    """(id, smallest id of the group, links) for rows with an id."""
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    links, parent = [0] * len(sets), list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b in range(a + 1, len(sets)):
            y = sets[b][1]
            if x and y and len(x & y) >= similarity * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    low: dict[int, int] = {}
    for a, (i, _) in enumerate(sets):
        low[root(a)] = min(low.get(root(a), i), i)
    return [(i, low[root(a)], links[a]) for a, (i, _) in enumerate(sets)]


def lower(w: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def unigrams(rows: list[tuple]) -> dict:
    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 == 1

    def tokens(t):
        return [lower(w) for w in words(t)] + [None]

    c = collections.Counter(x for i, t, *_ in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t))) for i, t, *_ in rows}


def class_scores(rows: list[tuple], held: dict, kinds: dict, classes: int, mix: float) -> dict:
    """log10 probability of each text under class bigrams; ``kinds``: hash of a word -> (count, class)."""
    import numpy as np
    import pyarrow as pa

    from galena.llm.class_lm import tokens_of
    from galena.llm.common import flat

    end, unseen = classes, classes + 1
    texts = {i: tokens_of(*flat(pa.array([t or ""])))[0].tolist() for i, t, *_ in rows}
    follow = np.full((classes + 2, classes + 1), 0.5)
    for i, tokens in texts.items():
        if not held[i]:
            before = end
            for w in tokens:
                follow[before, kinds[w][1]] += 1
                before = kinds[w][1]
    follow[unseen] += (follow[:unseen] - 0.5).sum(0)
    follow /= follow.sum(1, keepdims=True)
    size = [0.5 * (c != end) for c in range(classes + 1)]
    for n, c in kinds.values():
        size[c] += n + 0.5
    everything = sum(n + 0.5 for n, _ in kinds.values()) + 0.5
    out = {}
    for i, tokens in texts.items():
        before, total = end, 0.0
        for w in tokens:
            n, c = kinds.get(w, (0, unseen))
            in_class = sum(follow[before, k] * 0.5 / size[k] for k in range(classes)) if c == unseen else follow[before, c] * (n + 0.5) / size[c]
            total += math.log10(mix * in_class + (1 - mix) * (n + 0.5) / everything)
            before = c
        out[i] = total
    return out


def targets(sizes: dict, weights=(3, 1, 2), share: float = 1.5, cap: float = 2) -> dict:
    """Targets by resharing the excess of capped sources, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > cap * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
        rest -= sum(target[s] for s in over)
        free -= over
    return target
