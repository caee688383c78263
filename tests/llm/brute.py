"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("assign", "access", "hex")


def base_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for rank, pattern, least in ((1, r"AKIA[A-Z0-9]+", 18), (2, r"[0-9a-f]+", 16)):
        out += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text or "") if len(m[0]) >= least]
    return sorted(out)


def spans_text(found):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def substring_dedup(docs, window=13):
    """{doc_id: (n_words, n_removed, kept)} for (doc_id, text) rows with distinct ids."""
    least = {}
    all_words = {i: WORD.findall(t or "") for i, t in docs}
    for i, w in all_words.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, w in all_words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def byte_dedup(docs, length=200):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)}."""
    seen = defaultdict(int)
    raw = {i: (t or "").encode() for i, t in docs}
    for b in raw.values():
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def shingles(text, n=2):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(docs, n=2):
    """{doc_id: (n_shingles, component_id)}."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(k)
    shared = defaultdict(int)
    for ks in by.values():
        for a in range(len(ks)):
            for b in range(a + 1, len(ks)):
                shared[ks[a], ks[b]] += 1
    for (a, b), both in shared.items():
        if 100 * both >= 80 * (len(sets[a][1]) + len(sets[b][1]) - both):
            x, y = root(sets[a][0]), root(sets[b][0])
            up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}
