import random

from brute import documents, folder, repeats

from tripmesh.llm import op08_repeats as op
from tripmesh.llm.common import read_table


def both(spark, docs, path):
    ours = [tuple(r) for r in op.query(spark, folder(path, documents=docs)).collect()]
    return sorted(ours, key=str), sorted(repeats([(r.doc_id, r.text) for r in docs.collect()]), key=str)


def test_given_documents(spark, small, tmp_path):
    ours, theirs = both(spark, read_table(spark, small, "documents"), tmp_path)
    assert ours == theirs and sum(x[2] > 0 for x in ours) > 20


def test_passages_copies_and_periods(spark, tmp_path):
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abé") for _ in range(n))
    shared = [letters(n) for n in (60, 99, 100, 101, 130, 250, 700)]
    texts = []
    for k in range(120):
        texts.append("".join(r.choice([letters(r.randint(0, 90)), r.choice(shared), r.choice(shared)[r.randint(0, 40) :]]) for _ in range(r.randint(0, 7))))
    texts += [texts[5], texts[6], texts[6], "x" * 99, "x" * 100, "x" * 350, "ab" * 200, "ba" * 200, "abcdefg" * 60, letters(30) * 20]
    r.shuffle(texts)
    ours, theirs = both(spark, documents(spark, texts).repartition(5), tmp_path)
    assert ours == theirs and sum(x[3] > 1 for x in ours) > 10


def test_defined_cases(spark, tmp_path):
    r = random.Random(9)
    long_ = "".join(r.choice("abcdefgh ") for _ in range(3000))
    texts = [None, "", "short", (9, long_), (9, long_), (4, long_[500:900]), (None, long_[:150])]
    docs = documents(spark, [t if isinstance(t, tuple) else (20 + k, t) for k, t in enumerate(texts)])
    wide = docs.selectExpr("*", "1 AS doc", "2 AS low", "3 AS covered", "4 AS spans")
    ours, theirs = both(spark, wide, tmp_path / "a")
    assert ours == theirs
    kept = {r.doc_id: (bytes(r.kept), r.n_spans) for r in op.remove_repeats(wide).collect()}
    assert kept[4] == (long_[500:900].encode(), 0) and kept[22] == (b"short", 0)
    assert both(spark, documents(spark, []), tmp_path / "b") == ([], [])


def test_crowded_suffixes_give_the_same(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    common = letters(160)
    texts = [letters(r.randint(0, 150)) + common[r.randint(0, 20) :] + letters(r.randint(0, 150)) for _ in range(90)]
    docs = documents(spark, texts).repartition(6)
    want, theirs = both(spark, docs, tmp_path / "a")
    assert want == theirs and sum(x[2] > 100 for x in want) > 80
    monkeypatch.setattr(op, "CROWD", 5)
    assert both(spark, docs, tmp_path / "b")[0] == theirs
