"""Plain forms of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")


def substring(docs, size=20):
    """{doc_id: (n_words, n_removed, sha)} for (doc_id, text) pairs."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda x: x[0]):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            key = tuple(w[a : a + size])
            if key in seen:
                gone[a : a + size] = [True] * size
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def factors(docs, size=20):
    """{doc_id: [(start, words, ref_doc, ref_start)]}: greedy runs of windows whose first occurrences follow one another."""
    first, out = {}, {}
    for i, text in sorted(docs, key=lambda x: x[0]):
        w, out[i], last = WORD.findall(text or ""), [], None
        for a in range(len(w) - size + 1):
            d, s = first.setdefault(tuple(w[a : a + size]), (i, a))
            if (d, s) == (i, a):
                last = None
            elif last == (d, s - 1):
                x = out[i][-1]
                out[i][-1] = (x[0], x[1] + 1, x[2], x[3])
                last = (d, s)
            else:
                out[i].append((a, size, d, s))
                last = (d, s)
    return out


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(docs):
    """{doc_id: (n_shingles, component_id)} of documents linked at 0.75."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    for i in ids:
        for j in {j for s in sets[i] for j in where[s] if j < i}:
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}
