import random
import re

from brute import documents

from tripmesh.llm import op06_licenses as op
from tripmesh.llm.common import read_table


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def shingles(text):
    w = words(text)
    return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []


def brute(docs, templates):
    out = {}
    for i, text in docs:
        s = shingles(text)
        for name, t in templates.items():
            want = set(shingles(t))
            n = len(want)
            for block in range(0, len(s), op.BLOCK):
                for at in range(block, min(block + op.BLOCK, len(s)), n):
                    share = len(want & set(s[at : at + 2 * n])) / n
                    if share >= op.CONTAINED:
                        best, first, count = out.get((i, name), (0, at, 0))
                        out[i, name] = (max(best, share), min(first, at), count + 1)
    return sorted((*k, round(v[0], 6), *v[1:]) for k, v in out.items())


def ours(docs, templates=op.TEMPLATES):
    rows = op.find_licenses(docs, templates).collect()
    return sorted((r.doc_id, r.license, round(r.containment, 6), r.first_shingle, r.n_windows) for r in rows)


def test_given_documents(spark, small):
    docs = read_table(spark, small, "documents")
    assert ours(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], op.TEMPLATES) != []


def test_notices_in_prose_edited_and_at_block_ends(spark):
    r = random.Random(6)
    prose = lambda n: " ".join(r.choice("red the license of under fox 2 0".split()) for _ in range(n))
    texts = []
    for t in op.TEMPLATES.values():
        w = words(t)
        for k in (0, 3, 40, 1015, 1020, 1024, 2047):
            texts.append(prose(k) + " " + t.upper() + " " + prose(9))
        cut = r.randrange(len(w))
        texts.append(prose(30) + " " + " ".join(w[:cut] + ["xx"] + w[cut:]) + " " + prose(30))
        texts.append(" ".join(w[: int(len(w) * 0.9)]))
    docs = documents(spark, texts)
    got = ours(docs)
    assert got == brute(list(enumerate(texts)), op.TEMPLATES) and len(got) > 70


def test_defined_cases(spark):
    texts = [None, "", "...", "all rights reserved", "x " * 60_000 + op.TEMPLATES["mit"], (None, op.TEMPLATES["bsd"])]
    docs = documents(spark, texts).selectExpr("*", "1 AS license", "2 AS block")
    got = op.find_licenses(docs, {**op.TEMPLATES, "short": "All rights reserved.", "none": "", "dots": "..."}).collect()
    assert {(r.doc_id, r.license) for r in got} == {(3, "short"), (4, "mit"), (None, "bsd")}
    assert ours(documents(spark, [])) == [] and ours(documents(spark, ["a"]), {}) == []
    twice = op.find_licenses(documents(spark, [(1, op.TEMPLATES["mit"])] * 3)).collect()
    assert [(r.doc_id, r.license, r.n_windows) for r in twice] == [(1, "mit", 1)]
