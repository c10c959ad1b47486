import random

import numpy as np
import pyarrow as pa
from brute import documents, near_duplicates

from tripmesh.llm import op07_near_dedup as op
from tripmesh.llm.common import read_table


def both(docs):
    ours = sorted(tuple(r) for r in op.near_duplicates(docs).collect())
    return ours, sorted(near_duplicates([(r.doc_id, r.text) for r in docs.collect()]))


def test_given_documents_agree_with_brute_force(spark, small):
    ours, theirs = both(read_table(spark, small, "documents"))
    assert ours == theirs


def test_families_and_chains(spark):
    r = random.Random(2)
    texts = []
    for n in (3, 6, 9, 14, 25, 60, 200):
        for _ in range(6):
            base = [f"w{r.randrange(10**6)}" for _ in range(n)]
            for _ in range(7):
                texts.append(" ".join(base))
                if r.random() < 0.4:
                    texts.append("  ".join(w.upper() for w in base))
                k = r.randrange(len(base) + 1)
                base = base[:k] + [f"x{r.randrange(10**6)}" for _ in range(max(1, n // 40))] + base[k:]
    r.shuffle(texts)
    ours, theirs = both(documents(spark, texts))
    assert ours == theirs and sum(not x[3] for x in ours) > 100


def test_defined_cases(spark):
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one  two", (3, "one"), "é é é é", "É é é é", "a b c"]
    ours, theirs = both(documents(spark, [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]))
    assert ours == theirs
    got = [tuple(r) for r in op.near_duplicates(documents(spark, [(None, "one"), (2, "one")])).collect()]
    assert sorted(got, key=str) == [(2, 1, 2, True), (None, 1, None, True)]
    assert op.near_duplicates(documents(spark, [])).collect() == []


def test_kept_documents_keep_their_columns(spark, small):
    docs = read_table(spark, small, "documents").selectExpr("*", "1 AS rep", "2 AS gone_id", "3 AS n_shingles")
    kept = op.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == op.near_duplicates(docs).where("kept").count() < docs.count()


def test_estimate_is_near_the_truth():
    r = random.Random(3)
    for shared, own in ((900, 100), (300, 300), (0, 700)):
        words = lambda n: [f"{r.randrange(10**9)}" for _ in range(n)]
        middle = words(shared)
        texts = pa.array([" ".join(middle + words(own)).encode(), " ".join(middle + words(own)).encode()], pa.binary())
        n, _, _, keys = op.sketches(texts)
        regs = np.array(keys.to_pylist()).astype("<i8").view("<u2")
        guess = op.estimate(regs[:1], regs[1:], np.array(n[:1]), np.array(n[1:]))
        assert abs(guess[0] - shared / (shared + 2 * own)) < 0.15
