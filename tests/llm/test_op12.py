import random
import re
import zlib

import pytest
from brute import folder, sha

from tripmesh.llm import op12_prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string"


def trie(rows):
    """The contract over lists. Equal turn numbers must have equal rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, own.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])
        built[c] = base[:h] + ts[h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members),
            sum(len(k) == len(key) + 1 for k in under), sum(not any(o[: len(k)] == k and len(o) > len(k) for o in nodes) for k in under),
            sum((len(nodes[k]) - 1) * words(k) for k in under), sha(",".join(map(str, sorted(c for c in members if len(built[c]) == len(key))))),
        ))
    return sorted(out, key=str)


def rows_of(seed, n, longest=9, alphabet=2):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(n * 2), n):
        m = r.randint(1, longest)
        rows += [(c, t, r.choice(["user", "assistant", None]) if t % 2 else "user", r.choice(["a b", "c", "", None, "d e f"][:alphabet])) for t in range(m)]
    return rows


def asked(spark, tmp_path, rows, n=1):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "2 AS n_convs", "3 AS p1")
    got = op.query(spark, folder(tmp_path / str(n), conversations=docs))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_query_against_brute_force(spark, tmp_path, seed):
    rows = rows_of(seed, 60, alphabet=2 + seed)
    assert asked(spark, tmp_path, rows) == trie(rows)


def test_small_chunks_and_many_pieces_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 2)
    monkeypatch.setattr(op, "RANGE_BITS", 1)
    monkeypatch.setattr(op, "HEAVY", 3)
    rows = rows_of(5, 30, longest=25) + [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]
    rows += [(999, t, "user", f"long {t % 3}") for t in range(120)]
    assert asked(spark, tmp_path, rows) == trie(rows)


def test_defined_cases(spark, tmp_path):
    rows = [
        (None, 0, "user", "nobody"),
        (7, None, "user", "first"), (7, 3, None, None), (7, -1, "user", "x" * 100_000), (7, 2**40, "user", "last"),
        (9, 1, "user", "twice"), (9, 1, "user", "twice"), (9, 1, "user", "twice"), (9, 1, "user", "twice"),
        (-3, 0, "", "below"), (-3, 1, "", "below"), (-3, 2, "", "below"), (-3, 3, "", "below"),
        (20, 0, "ab", "c"), (21, 0, "a", "bc"), (2**62, 0, "user", "far"), (2**62, 1, "user", "far"),
    ]
    assert asked(spark, tmp_path, rows) == trie(rows)
    assert asked(spark, tmp_path, [], 2) == []
    alone = [(c, 0, "user", "x") for c in range(1, 60) if zlib.crc32(str(c).encode()) % 4 and c % 20][:1]
    assert asked(spark, tmp_path, alone, 3) == trie(alone) == [(alone[0][0], 0, None, 1, 0, 1, 0, sha(str(alone[0][0])))]
