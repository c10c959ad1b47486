import random

from brute import documents, folder, line_dedup

from tripmesh.llm import op04_line_dedup as op
from tripmesh.llm.common import read_table


def both(spark, docs, path):
    ours = [tuple(r) for r in op.query(spark, folder(path, documents=docs)).collect()]
    return sorted(ours, key=str), sorted(line_dedup([(r.doc_id, r.text) for r in docs.collect()]), key=str)


def test_random_lines_agree_with_brute_force(spark, tmp_path):
    r = random.Random(4)
    texts = ["\n".join(r.choice("abcdé") * r.randint(0, 2) for _ in range(r.randint(0, 14))) for _ in range(200)]
    ours, theirs = both(spark, documents(spark, texts), tmp_path)
    assert ours == theirs and sum(x[2] > 0 for x in ours) > 40 and sum(x[3] > 1 for x in ours) > 3


def test_defined_cases(spark, tmp_path):
    same = "a\nb\nc\nd"
    texts = [None, "", "\n", "\n\n", "\n\n\n\n", (9, same), (9, same), (7, "x\n" + same), (None, "b\nc\nd"), (3, "k\n" * 5000)]
    ours, theirs = both(spark, documents(spark, [t if isinstance(t, tuple) else (20 + k, t) for k, t in enumerate(texts)]), tmp_path / "a")
    assert ours == theirs
    assert both(spark, documents(spark, []), tmp_path / "b") == ([], [])


def test_rewritten_documents(spark, small):
    docs = read_table(spark, small, "documents").selectExpr("*", "1 AS covered", "2 AS key_id", "3 AS n_lines")
    new = op.rewritten(docs)
    assert new.columns == docs.columns and new.dtypes == docs.dtypes and new.count() == docs.count()
    assert new.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
