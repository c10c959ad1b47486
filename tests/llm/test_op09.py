from collections import Counter

import numpy as np
from brute import documents, sha

from tripmesh.llm import op09_fingerprint as op
from tripmesh.llm.common import read_table


def plain_digest(data):
    counts = [0] * op.BUCKETS
    for k, (second, third) in enumerate(op.GAPS):
        for i in range(len(data) - third):
            h = data[i] * 0x9E3779B1 + data[i + second] * 0x85EBCA77 + data[i + third] * 0xC2B2AE3D + k
            counts[(h * 0x27D4EB2F % (1 << 32)) >> 25] += 1
    ordered = sorted(counts)
    return [sum(c > ordered[k * 32 - 1] for k in (1, 2, 3)) for c in counts]


def brute(docs):
    """(doc_id, n_chars, edited sha, fingerprint, edited fingerprint)"""
    rows = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()))
    out = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        prints = [op.text_of(op.digests(*op.joined([t.encode()])))[0] for t in (text, edited)]
        out.append((i, len(text), sha(edited), *prints))
    return Counter(out)


def ours(docs):
    rows = op.compared(docs).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in rows)


def test_digest_against_plain_count():
    texts = [b"", b"a", b"abc", b"abcd", "Der Öl-Preis fällt, and so on. ".encode() * 9, bytes(range(256)) * 3]
    got = op.digests(*op.joined(texts))
    assert [g[: op.BUCKETS].tolist() for g in got] == [plain_digest(t) for t in texts]
    assert all((op.digest_of(t) == g).all() for t, g in zip(op.text_of(got), got))


def test_given_documents_in_many_ranges(spark, small, monkeypatch):
    docs = read_table(spark, small, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert ours(docs) == want
    monkeypatch.setattr(op, "RANGE_ROWS", 3)
    monkeypatch.setattr(op, "FAN", 5)
    assert len(op.id_bounds(docs)) > 50 and ours(docs.repartition(7)) == want


def test_edited_texts_are_nearer_than_others(spark, small):
    rows = [r for r in op.query(spark, small).collect() if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


def test_defined_cases(spark):
    texts = [None, "", "aé", (7, "b" * 300_000), (7, "b" * 300_000), (7, "c"), (None, "first"), (-5, "漢字かな")]
    docs = documents(spark, texts).selectExpr("*", "1 AS `range`", "2 AS again", "3 AS key")
    assert ours(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert ours(documents(spark, [(3, "alone here")])) == brute([(3, "alone here")])
    assert ours(documents(spark, [])) == Counter()
    printed = op.fingerprints(docs).collect()
    assert len({r.fingerprint for r in printed if (r.carried_row.text or "") == ""}) == 1
