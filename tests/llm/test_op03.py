import random

import numpy as np
from brute import documents

from tripmesh.llm import op03_language as op
from tripmesh.llm.common import read_table


def greedy(text, sample):
    """Phrases of a text against a sample, by looking for substrings."""
    count, k = 0, 0
    for lo in range(0, len(text), op.SEGMENT):
        part, k = text[lo : lo + op.SEGMENT], 0
        while k < len(part):
            n = 1
            while k + n < len(part) and part[k : k + n] in sample and part[k : k + n + 1] in sample:
                n += 1
            k, count = k + n, count + 1
    return count


def test_phrases_against_substring_search():
    r = random.Random(7)
    letters = lambda n: "".join(r.choice("abcde ") for _ in range(n))
    samples = op.Samples(("x", "y"), (letters(300), letters(500)))
    parser = op.Parser(samples)
    texts = ["", "a", "zzz", "azbz", *[letters(r.randint(1, 400)) for _ in range(40)], letters(2500)]
    got = parser.phrases(texts)
    assert got.tolist() == [[greedy(t, s) for s in samples.texts] for t in texts]


def test_automaton_accepts_substrings_only():
    codes = [1, 2, 1, 1, 2, 3, 1, 2]
    step = op.suffix_automaton(codes)
    inside = {tuple(codes[a:b]) for a in range(8) for b in range(a, 9)}

    def accepts(w):
        s = 0
        for c in w:
            if c not in step[s]:
                return False
            s = step[s][c]
        return True

    from itertools import product

    for n in range(5):
        assert all(accepts(w) == (w in inside) for w in product((1, 2, 3), repeat=n))


def test_given_documents(spark, small):
    docs = read_table(spark, small, "documents")
    got = op.query(spark, small).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out and len(r.text or "") > 40]
    assert len(got) == docs.count() and np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_defined_cases(spark):
    samples = op.Samples(("de", "en"), ("der hund und die katze", "the dog and the cat"))
    texts = [None, "", "123 ... 4", "the cat", "der die das", "漢字", "The " * 60_000, (9, "the"), (9, "the"), (None, "the")]
    got = {(r.carried_row.doc_id, r.lang_pred): r.score for r in op.predict(documents(spark, texts), samples).collect()}
    assert [(k, "und") in got and got[k, "und"] == 0 for k in (0, 1, 2)] == [True] * 3
    assert {(3, "en"), (4, "de"), (6, "en"), (9, "en"), (None, "en")} <= got.keys() and (5, "und") not in got
    none = op.learn(documents(spark, []).select("text", "lang"))
    assert {r.lang_pred for r in op.predict(documents(spark, ["a"]), none).collect()} == {"und"}
    assert op.predict(documents(spark, []), samples).collect() == []
    only_null = op.learn(documents(spark, [None, "x"], lang=None).select("text", "lang"))
    assert only_null == op.Samples((), ())


def test_sample_is_the_first_distinct_texts_however_many_copies(spark):
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)).strip()
    for seed in range(2):
        long, others = f"{seed} " + letters(5000), [letters(1000) for _ in range(100)]
        docs = documents(spark, [long] * 2900 + others + ["..."] * 5, lang="xx").select("text", "lang").repartition(8)
        distinct = docs.where("text <> '...'").distinct().selectExpr("text", "pmod(xxhash64(text), 1 << 30) AS o").orderBy("o").collect()
        want = " ".join(op.letters_of(x.text) for x in distinct)
        for chars in (24_000, 1_000_000):
            assert op.learn(docs, chars) == op.Samples(("xx",), (want[:chars],))


def test_letters_of_many_scripts():
    r = random.Random(9)
    script = lambda first, size, n: "".join(chr(first + r.randrange(size)) for _ in range(n))
    places = {"cyrillic": (0x430, 32), "greek": (0x3B1, 17), "han a": (0x4E00, 400), "han b": (0x5200, 400), "hangul": (0xAC00, 2000)}
    samples = op.Samples(tuple(places), tuple(script(*p, 3000) for p in places.values()))
    parser = op.Parser(samples)
    texts = [t[k : k + 30] + t[-k - 30 : -k] for k, t in enumerate(samples.texts, 100)]
    got = parser.phrases(texts)
    assert got.tolist() == [[greedy(t, s) for s in samples.texts] for t in texts]
    assert (got * parser.cost).argmin(axis=1).tolist() == list(range(len(places)))
