"""Plain re-statements of the contracts, for comparison on small inputs."""

import hashlib
import re

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    """A documents table; texts may be (id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], DOC)


def folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))


def decontamination(docs, items, window=10):
    patterns = []
    for item, text in items:
        w = bench_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            patterns.append((tuple(w[k : k + window]), item))
    lengths = {len(p) for p, _ in patterns}
    owners = {}
    for p, item in patterns:
        owners.setdefault(p, set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := owners.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        ids = sha(",".join(sorted(str(i) for i in found)))
        out.append((doc_id, len(w), len(hit), len(found), ids, bool(hit)))
    return out


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def near_duplicates(docs, size=4):
    """docs: (id, text); repeated ids allowed."""
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in sets]


def subsequence_kernel(s, t, order=3, decay=0.7):
    """All common subsequences, by enumeration."""
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), order):
        for b in combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def line_dedup(docs, size=3):
    """docs: (id, text); equal (id, text) rows are one place."""
    first, out = {}, []
    rows = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for i, text in rows:
        lines = (text or "").split("\n")
        for k in range(len(lines) - size + 1):
            first.setdefault(tuple(lines[k : k + size]), (i, k))
    for i, text in rows:
        lines, gone = ([] if text is None else text.split("\n")), set()
        for k in range(len(lines) - size + 1):
            if first[tuple(lines[k : k + size])] != (i, k):
                gone.update(range(k, k + size))
        spans = sum(k in gone and k - 1 not in gone for k in range(len(lines)))
        out.append((i, len(lines), len(gone), spans, sha("\n".join(x for k, x in enumerate(lines) if k not in gone))))
    return out


def repeats(docs, length=100):
    """docs: (id, text) with ids that differ, or equal rows."""
    first, out = {}, []
    rows = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for i, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            first.setdefault(data[k : k + length], (i, k))
    for i, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] != (i, k):
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, sha(bytes(c for c, g in zip(data, gone) if not g))))
    return out
