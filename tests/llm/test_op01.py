import random

from brute import decontamination, documents

from tripmesh.llm import op01_decontaminate as op
from tripmesh.llm.common import read_table

WORDS = "ab cd ef gh été 12".split()


def both(spark, texts, items, monkeypatch):
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    tables = {"documents": docs, "benchmark": bench}
    monkeypatch.setattr(op, "read_table", lambda s, d, name: tables[name])
    ours = sorted(tuple(r) for r in op.query(spark, "").collect())
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    return ours, sorted(decontamination(pairs, [i for i in items if i[0] is not None]))


def test_random_texts_agree_with_brute_force(spark, monkeypatch):
    r = random.Random(1)
    words = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    items = [(i, words(r.choice([0, 1, 4, 9, 10, 11, 14]))) for i in range(12)]
    texts = [words(r.randint(0, 60)) for _ in range(150)]
    texts += [words(700) + " " + items[k % 12][1].upper() + ", " + words(900) for k in range(4)]
    texts += [items[5][1].replace(" ", "--"), texts[3], texts[3]]
    ours, theirs = both(spark, texts, items, monkeypatch)
    assert ours == theirs and sum(x[2] > 0 for x in ours) > 20


def test_defined_cases(spark, monkeypatch):
    items = [(1, None), (2, ""), (3, " .,"), (None, "a b c"), (4, "x y"), (4, "x y"), (5, "x y")]
    texts = [None, "", "...", "X-y x", (7, "a b c"), (7, "a b c"), "x" * 50_000 + " x y"]
    ours, theirs = both(spark, texts, items, monkeypatch)
    assert ours == theirs
    assert [x for x in ours if x[0] == 7] == [x for x in theirs if x[0] == 7]


def test_empty_tables(spark, monkeypatch):
    ours, theirs = both(spark, [], [(1, "a b")], monkeypatch)
    assert ours == theirs == []
    ours, theirs = both(spark, ["a b"], [], monkeypatch)
    assert ours == theirs


def test_blocks_of_items_and_clashing_columns(spark, small):
    docs = read_table(spark, small, "documents").selectExpr("*", "1 AS n_words", "2 AS item_ids", "3 AS carried_row")
    bench = read_table(spark, small, "benchmark")
    one = op.decontaminate(docs, bench)
    many = op.decontaminate(docs, bench, block_bytes=2000)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    kept = op.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == one.where("size(item_ids) = 0").count() < docs.count()


def test_one_block_at_a_time(spark, monkeypatch):
    r = random.Random(4)
    words = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    items = [(i, words(12)) for i in range(40)] + [(3, words(9))]
    texts = [None, "", *[words(r.randint(0, 20)) + " " + items[k][1] + " " + items[k + 1][1] for k in range(0, 40, 2)], items[5][1], items[5][1]]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    alive, most, total = set(), [0], [0]
    make, Broadcast = spark.sparkContext.broadcast, type(spark.sparkContext.broadcast(0))
    destroy = Broadcast.destroy

    def made(value):
        b = make(value)
        alive.add(id(b))
        most[0], total[0] = max(most[0], len(alive)), total[0] + 1
        return b

    monkeypatch.setattr(spark.sparkContext, "broadcast", made)
    monkeypatch.setattr(Broadcast, "destroy", lambda b, *a: (alive.discard(id(b)), destroy(b, *a))[1])
    many = sorted(map(str, op.decontaminate(docs, bench, block_bytes=400).collect()))
    assert most[0] == 1 and total[0] > 2
    assert many == sorted(map(str, op.decontaminate(docs, bench).collect()))
