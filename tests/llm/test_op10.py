import string
import zlib
from collections import defaultdict

import numpy as np
from brute import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tripmesh.llm import op10_pack as op
from tripmesh.llm.common import read_table


def check(spark, docs, length=op.LENGTH):
    placed = op.pack_documents(docs.select("doc_id", "text"), length=length, carry=["doc_id"])
    rows = placed.collect()
    tok = Tokenizer.from_file(op.default_tokenizer())
    want = defaultdict(int)
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, op.END_ID]
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            want[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return rows, places


def test_ids_pieces_and_places(spark, small):
    rows, places = check(spark, read_table(spark, small, "documents"))
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // op.LENGTH) * 1.02 + 1


def test_defined_cases(spark):
    odd = ["a\x1cb\x1dc", "x\x85y", "\x01 \x01", "a\x01b", "ＡÉ é ﬁ", "don't I'LL 12345 ... !?", "<|endoftext|> a<|startoftext|>b"]
    texts = [None, "", "  \n", *odd, "word " * 3000, (5, "same"), (5, "same"), (None, "no id")]
    rows, places = check(spark, documents(spark, texts), length=64)
    assert sum(r.doc_id == 5 and r.piece == 0 for r in rows) == 3
    assert check(spark, documents(spark, []))[0] == []


def test_sequences_hold_the_ids_in_order(spark):
    placed = op.pack_documents(documents(spark, ["a b c", "d e", "f"]), length=8).cache()
    want = defaultdict(list)
    for r in sorted(placed.collect(), key=lambda r: (r.sequence_id, r.offset)):
        want[r.sequence_id] += r.ids
    assert {r.sequence_id: r.ids for r in op.sequences(placed).collect()} == want


def test_memo_that_is_full_changes_nothing(small, spark):
    texts = [r.text or "" for r in read_table(spark, small, "documents").collect()]
    small_memo, large = op.WordIds(op.default_tokenizer(), 100), op.WordIds(op.default_tokenizer())
    for k in range(0, len(texts), 50):
        assert small_memo.encode(texts[k : k + 50]) == large.encode(texts[k : k + 50])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_rule_against_plain_statement(sizes):
    sequence, offset = op.sum_of_squares(np.array(sizes, np.int64), 12)
    gaps = {}
    for s, q, o in zip(sizes, sequence.tolist(), offset.tolist()):
        def cost(choice):
            left = [g - s if k == choice else g for k, g in gaps.items()]
            return sum(left.count(g) ** 2 for g in range(1, 12))

        open_ = [k for k, g in gaps.items() if s <= g < 12 and g > 0]
        if open_:
            assert q in gaps and cost(q) == min(map(cost, open_))
        else:
            assert q not in gaps
            gaps[q] = 12
        assert o == 12 - gaps[q]
        gaps[q] -= s


def test_latin_letters_alone_and_before_stops():
    words, tok = op.WordIds(op.default_tokenizer()), Tokenizer.from_file(op.default_tokenizer())
    forms = [f.format(chr(c)) for c in range(0x80, 0x250) for f in ("{}", "{},", "{}.", "a{},", "{}b.", "{0}{0}", "x{}.y")]
    got = words.encode([f"k {t} k" for t in forms])
    assert got == [np.array(tok.encode(f"k {t} k", add_special_tokens=False).ids, "<u4").tobytes() for t in forms]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aİŻﬁſŉΣς,.'1 ​­日é<|>"), max_size=8), max_size=6))
def test_texts_of_odd_letters_against_the_tokenizer(parts):
    text, words = " ".join(parts), op.word_ids(op.default_tokenizer())
    assert words.encode([text]) == [np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_every_letter_that_lower_case_brings_among_the_words():
    """In words, before marks, and beside capitals; the memo is warm in the second pass."""
    words, tok = op.WordIds(op.default_tokenizer()), Tokenizer.from_file(op.default_tokenizer())
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and any(op._WORD(x) for x in chr(c).lower())]
    marks = ["", *string.punctuation, "###", ".!!", "...", "'s", "<|", "|>", "_1", "-a"]
    texts = [f"{c} x{c}Y{m} {c}{c}{m}" for c in letters for m in marks[:3]] + [f"{c}b{m} ab{m}{c} Q{m}" for c in "aÉıſK" for m in marks]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.encode(texts) == want and words.encode(texts) == want


def test_copies_of_a_long_text_go_to_all_groups(spark, tmp_path):
    pieces = op.tokenised(documents(spark, ["many words of one text " * 500] * 1000), op.default_tokenizer(), 64, ["doc_id"], keep_ids=False)
    pieces.write.parquet(str(tmp_path / "pieces"))
    stored = spark.read.parquet(str(tmp_path / "pieces"))
    n, groups = stored.count(), 20
    packed = op.pack(stored, 64, group_rows=n // groups)
    sizes = [r["count"] for r in packed.selectExpr("sequence_id >> 32 AS g").groupBy("g").count().collect()]
    assert sum(sizes) == n and len(sizes) == groups and max(sizes) < 1.3 * n / groups


def test_clashing_columns(spark):
    docs = documents(spark, ["a b", None]).selectExpr("doc_id", "text", "'kept' AS source", "7 AS piece", "8 AS deal", "9 AS pack_group", "1 AS Length")
    rows = op.pack_documents(docs, keep_ids=False)
    assert rows.columns == ["doc_id", "text", "source", "deal", "pack_group", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {(r.piece, r.deal, r.pack_group) for r in rows.collect()} == {(0, 8, 9)}
