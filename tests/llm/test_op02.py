import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import documents, folder

from tripmesh.llm import op02_shards as op
from tripmesh.llm.common import ROW, read_table


def check(placed, texts, shards):
    """texts: list of texts, as many rows as placed; returns for each text its shards."""
    rows = placed.collect()
    assert len(rows) == len(texts)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values(), default=0) - min([counts.get(s, 0) for s in range(shards)]) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n)) and 0 <= s < shards
    where = defaultdict(Counter)
    for r in rows:
        where[r[ROW].text][r.shard] += 1
        data = (r[ROW].text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    assert Counter(r[ROW].text for r in rows) == Counter(texts)
    return where


def cut_groups(where, capacity):
    return sum(len(c) > -(-sum(c.values()) // capacity) for t, c in where.items() if t is not None and sum(c.values()) > 1)


def test_given_documents(spark, small):
    docs = read_table(spark, small, "documents")
    where = check(op.assign_shards(docs), [r.text for r in docs.collect()], 24)
    assert cut_groups(where, docs.count() // 24) == 0
    got = op.query(spark, small)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {(r.law, r.grown_shard) for r in got.collect()} == {("rows", None)}


@pytest.mark.parametrize("hot", [0, 300])
def test_groups_stay_together(spark, hot):
    r = random.Random(hot)
    texts = ["hot"] * hot
    for g in range(60):
        texts += [f"group {g}"] * r.choice([1, 2, 3, 5, 8])
    texts += [f"single {k}" for k in range(500)]
    r.shuffle(texts)
    where = check(op.assign_shards(documents(spark, texts).repartition(5), 10), texts, 10)
    assert cut_groups(where, len(texts) // 10) <= 2
    assert len(where["hot"]) <= (hot * 10 // len(texts) + 2 if hot else 0)


def test_all_linked_without_room(spark):
    texts = [f"g{k % 40}" for k in range(240)]
    where = check(op.assign_shards(documents(spark, texts), 8), texts, 8)
    assert sum(len(c) for c in where.values()) < 40 * 3


def test_defined_cases(spark, tmp_path):
    texts = [None, None, "", "", "é" * 9, (7, "twice"), (7, "twice"), (None, "x"), "y" * 200_000]
    flat = [t[1] if isinstance(t, tuple) else t for t in texts]
    docs = documents(spark, texts).selectExpr("*", "1 AS shard", "2 AS n", "3 AS row_id", "4 AS part")
    check(op.assign_shards(docs), flat, 24)
    assert op.query(spark, folder(tmp_path, documents=documents(spark, []))).collect() == []


def test_quotas_never_overfill():
    r = np.random.default_rng(1)
    for _ in range(200):
        sums = r.integers(0, 9, (5, 5)) * (1 - np.eye(5, dtype=int))
        room = r.integers(0, 6, 5)
        q = op.quotas(sums, room)
        assert (q <= sums).all() and (q >= 0).all()
        assert (q.sum(axis=0) - q.sum(axis=1) <= room).all()
