import random

import numpy as np
import pytest
from brute import documents, folder, subsequence_kernel

from tripmesh.llm import op05_toxicity as op
from tripmesh.llm.common import read_table

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(("s", "t"), [("moron", "moron"), ("moron", "moxroxn"), ("scum", "music"), ("abc", "cba"), ("aaaa", "aaaaa")])
def test_kernel_against_enumeration(s, t):
    got = op.subsequence_kernel(op.coded([s]), op.coded([t, "zz"]))
    assert got == pytest.approx([subsequence_kernel(s, t), 0.0], rel=1e-4)


def test_gaps_and_inserted_letters_stay_near():
    marks = op.Landmarks(["moron", "worthless"])
    near = marks.rows([op.word_of(c) for c in ("moron", "m.o.r.o.n", "moroon", "worthlesss", "worxthless", "thention", "")])
    assert near[0, 0] == near[1, 0] == pytest.approx(1)
    assert near[2, 0] > 0.3 and near[3, 1] > 0.3 and near[4, 1] > 0.3
    assert near[5].max() < 0.05 and near[6].max() == 0
    assert "moron" in map(op.word_of, op.chunks_of("you m o r o n !"))


def sentences(n, toxic_share=0.3):
    r = random.Random(5)
    clean = ["".join(r.choice("aeioubdgklnrst") for _ in range(r.randint(2, 9))) for _ in range(300)]
    out = []
    for k in range(n):
        words = [r.choice(clean) for _ in range(r.randint(0, 60))]
        toxic = r.random() < toxic_share
        if toxic:
            words.insert(r.randint(0, len(words)), r.choice(["moron", "scumbag", "vermin"]))
        out.append((k, " ".join(words), int(toxic)))
    return out


def test_held_out_and_obfuscated_sentences(spark, tmp_path):
    rows = sentences(600)
    extra = [(1000, "you m.o.r.o.n sir"), (1001, "what a scuumbag"), (1002, "ver-min all of them"), (1003, "a fine day")]
    docs = documents(spark, [(k, t) for k, t, _ in rows] + extra)
    labels = spark.createDataFrame([(k, 0, y) for k, _, y in rows], LABELS)
    got = {r.doc_id: r for r in op.query(spark, folder(tmp_path, documents=docs, labels=labels)).collect()}
    held = [k for k, _, _ in rows if got[k].held_out]
    assert 60 < len(held) < 180
    assert np.mean([got[k].predicted == rows[k][2] for k in held]) > 0.97
    assert [got[k].predicted for k, _ in extra] == [1, 1, 1, 0]


def test_given_documents(spark, small):
    docs, labels = read_table(spark, small, "documents"), read_table(spark, small, "labels")
    got = op.query(spark, small).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.85
    model = op.fit(docs, op.training_labels(spark, small))
    wide = docs.selectExpr("*", "1 AS score", "2 AS toxic")
    kept = op.keep_clean(wide, model)
    assert kept.columns == wide.columns and 0.8 * docs.count() < kept.count() < docs.count()


def test_defined_cases(spark, tmp_path):
    texts = [None, "", " ", "x" * 100_000, "moron " * 20_000, (9, "moron"), (9, "moron"), (None, "moron")]
    docs = documents(spark, texts)
    none = spark.createDataFrame([], LABELS)
    got = op.query(spark, folder(tmp_path / "a", documents=docs, labels=none)).collect()
    assert len(got) == 8 and {r.score for r in got} == {0.0}
    assert op.query(spark, folder(tmp_path / "b", documents=documents(spark, []), labels=none)).collect() == []
    one_kind = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, 0, None)], LABELS)
    assert {r.score for r in op.query(spark, folder(tmp_path / "c", documents=docs, labels=one_kind)).collect()} == {0.0}


def test_memo_that_is_full_changes_nothing(monkeypatch):
    texts = [t for _, t, _ in sentences(80)]
    free = op.Pool(["moron", "scumbag"])
    want = np.concatenate([free(texts[:40]), free(texts[40:])])
    monkeypatch.setattr(op, "MEMO_WORDS", 0)
    full = op.Pool(["moron", "scumbag"])
    assert np.array_equal(want, np.concatenate([full(texts[:40]), full(texts[40:])]))


def test_long_and_joined_chunks_are_compared():
    marks = op.Landmarks(["moron", "scum"])

    def exact(word, mark):
        k = lambda a, b: subsequence_kernel(a, b)
        return (k(word, mark) / (k(word, word) * k(mark, mark)) ** 0.5) ** op.SHARPNESS

    whole = ["mmmooorrrooonnn", "moronmoronmoron", "scumscumscum"]
    got = marks.rows(whole)
    for row, word in zip(got, whole):
        for value, mark in zip(row, marks.words):
            assert value >= (exact(word, mark) * 0.999 if set(mark) <= set(word) else 0)
    assert got[0, 0] > 0.19 and got[1, 0] > 0.26 and got[2, 1] > 0.2
    pool = op.Pool(["moron", "scum"])
    filler = "bdfghjkl" * 40
    for at in range(12):
        joined, glued = pool(["trash/moron/and-scum", "x" * at + filler[at:] + "moron" + filler])
        assert joined.tolist() == pytest.approx([1, 1]) and glued[0] > 0.03 and glued[1] < 0.01
    assert pool(["q" * 100_000, "日本語" * 30_000]).max() == 0


def exact_value(word, mark):
    return (subsequence_kernel(word, mark) / (subsequence_kernel(word, word) * subsequence_kernel(mark, mark)) ** 0.5) ** op.SHARPNESS


def test_pooled_values_against_enumeration(monkeypatch):
    r = random.Random(2)
    marks = ["moron", "scum", "vermin", "éclat"]
    words = ["".join(r.choices("morscuveinétlax", k=r.randint(1, 8))) for _ in range(120)] + ["moroon", "s-c-u-m", "vermin,"]
    texts = [" ".join(r.choices(words, k=12)) for _ in range(20)]
    monkeypatch.setattr(op, "CELLS", 50)
    pool = op.Pool(marks)
    got = np.concatenate([pool(texts[:7]), pool(texts[7:])])
    for row, text in zip(got, texts):
        for value, mark in zip(row, marks):
            # words of more than twice a landmark's length are compared in pieces too
            want = max(exact_value(op.word_of(w), mark) for w in text.split() if len(op.word_of(w)) >= 3)
            assert want - op.FLOOR <= value and (value <= want + op.FLOOR or any(len(w) > 2 * len(mark) for w in text.split()))


def test_machine_is_at_the_least_loss():
    r = np.random.default_rng(3)
    pooled, toxic = r.random((200, 2)), r.random(200) < 0.3
    pooled[toxic, 0] += 0.5
    model = op.trained(["moron", "vermin"], pooled, toxic)
    own = op.Landmarks(["moron", "vermin"]).rows(["moron", "vermin"]).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors @ np.diag(values**-0.5) @ vectors.T
    y, cost = np.where(toxic, 1, -1), np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * len(toxic)

    def loss(w, bias):
        return op.RIDGE * (w @ w) / 2 + (cost * np.maximum(0, 1 - y * (pooled @ root @ w + bias)) ** 2).sum() / 2

    w = np.linalg.solve(root, model.weights)
    least = loss(w, model.bias)
    assert all(loss(w + d[:2], model.bias + d[2]) > least - 1e-6 for d in r.normal(0, 0.05, (300, 3)))


def test_landmarks_are_chosen_among_what_is_left(monkeypatch):
    monkeypatch.setattr(op, "FEWEST", 0)
    toxic = np.arange(60) < 30
    held = np.zeros((60, 4), bool)
    held[:20, 0] = held[:19, 1] = held[20:30, 2] = True  # the second says nothing new
    held[::2, 3] = True
    assert op.chosen_words(held, toxic, 2.0, 4) == [0, 2]
    monkeypatch.setattr(op, "FEWEST", 3)
    assert op.chosen_words(held, toxic, 2.0, 4) == [0, 2, 1]
