import random

import numpy as np
import pytest
from brute import documents, folder, sha

from tripmesh.llm import op11_fill_middle as op
from tripmesh.llm.common import plain


def rearranged(doc_id, text):
    """The contract, over decoded code points."""
    text = text or ""
    h1, h2, h3, h4 = (int(sha(f"1:{'' if doc_id is None else doc_id}")[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


@pytest.mark.parametrize("seed", range(4))
def test_ranks_and_places_against_decoding(seed):
    r = random.Random(seed)
    alphabet = "aé€😀\0\x7f\u0080߿ࠀ￿" if seed else "abc"
    texts = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 7, 8, 9, 63, 300]))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    units = op.Units(np.frombuffer(b"".join(raw), np.uint8), bounds)
    base = units.rank(bounds)
    assert np.diff(base).tolist() == [len(t) for t in texts]
    for k, t in enumerate(texts):
        ranks = np.arange(1, len(t) + 1) + base[k]
        assert (units.select(ranks) - bounds[k]).tolist() == [len(t[:c].encode()) for c in range(1, len(t) + 1)]


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(3)
    texts = ["".join(r.choice("ab<PSM> é€😀\n") for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "<P>", "a<S>b", "<", "P>", "<P<", "é" * 5000, "😀" * 200_001, (5, "twice"), (5, "twice"), (None, "no id"), (-7, "below")]
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    got = op.query(spark, folder(tmp_path, documents=documents(spark, texts)))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [(*(w := rearranged(i, t))[:5], sha(w[5]), sha(t or "")) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_texts_and_clashing_columns(spark):
    docs = documents(spark, ["some text to cut"] * 50).selectExpr("*", "1 AS form", "2 AS output", "3 AS n")
    got = op.rearranged(docs)
    assert plain(got).columns == docs.columns
    rows = got.select("carried_row.doc_id", "form", "output", op.restored(got.output, got.form).alias("back")).collect()
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and {r.back for r in rows} == {"some text to cut"}
    assert all(r.output == rearranged(r.doc_id, "some text to cut")[5] for r in rows)
    assert op.rearranged(docs.limit(0)).count() == 0
