"""Packing of tokenised documents into sequences by the sum-of-squares rule.

A document is the ids of its text and one end id. Longer ones than a sequence
are cut into full pieces and a rest. Pieces are dealt at random into groups of
about ``group_rows``, and each group is packed on its own, in one task: with
N(g) the number of open sequences with g tokens left, a piece goes where the
sum of N(g)**2 becomes smallest, and a new sequence is opened when it fits
nowhere. Only the counts per gap matter, so a step costs one pass over 4096
numbers. Longer pieces come first: all are known beforehand, and then the rule
leaves hardly more than one unfilled sequence in a group.

Ids come from a memo of bounded size. The chunks between white space are safe units,
as the tokenizer normalises and splits within white space only; each distinct one of
a slice is looked up once, as a lower-case word and the marks after it. Words that the
memo lacks are encoded together and told apart by their last tokens. Texts with
separators that not all libraries count as white space are encoded whole.

Defined cases: null text is empty, and an empty text is one piece, the end id
alone; repeated rows are packed once each; null ids are kept; an empty table
gives no rows. Text of any length is tokenised whole. Other columns are carried, whatever
their names; one named like a result column gives way to it.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmesh.llm.common import ROW, kept, plain, read_table, saved, slices

LENGTH = 4096
END_ID = 1
GROUP_ROWS = 30_000
MEMO_WORDS = 600_000
MEMO_LETTERS = 64  # longer ones are encoded each time, so the memo is bounded in bytes

# Separators that str.split knows and the tokenizer may not.
_UNSURE = "\x1c\x1d\x1e\x1f\x85"
# A lower-case word of these letters is one unit to the tokenizer, and so are the ASCII marks that end a chunk.
_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+").fullmatch
_MARKS = string.punctuation


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def word_ids(path: str) -> WordIds:
    """One memo for the tasks of a worker process."""
    return kept(("word ids", path), lambda: WordIds(path))


class WordIds:
    """Ids of texts as little-endian 32-bit numbers."""

    def __init__(self, path: str, limit: int = MEMO_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.memo, self.odd = limit, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        chunks = [None if any(c in t for c in _UNSURE) else t.split() for t in texts]
        find = self._chunk_ids(set().union(*[c for c in chunks if c is not None])).__getitem__
        return [self._ids(t).tobytes() if c is None else b"".join(map(find, c)) for t, c in zip(texts, chunks)]

    def _chunk_ids(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks: those of a lower-case word of the memo and of the marks after it, or of the whole chunk."""
        marks, found, rest = {"": b""}, {}, []
        known, whole = self.memo.get, self.odd.get
        for c in chunks:
            word = c.rstrip(_MARKS).lower()
            if (ids := known(word)) is not None:
                tail = c[len(word) :]
                if tail not in marks:
                    marks[tail] = self._ids(tail).tobytes()
                found[c] = ids + marks[tail]
            elif (ids := whole(c)) is not None:
                found[c] = ids
            else:
                rest.append((c, word))
        words = self._word_ids(list({w for _, w in rest if _WORD(w)}))
        odd = {c: self._ids(c).tobytes() for c, w in rest if w not in words}
        for c, word in rest:
            if word in words:
                tail = c[len(word) :]
                if tail not in marks:
                    marks[tail] = self._ids(tail).tobytes()
                found[c] = words[word] + marks[tail]
        if len(self.memo) + len(self.odd) < self.limit:
            self.memo.update((w, ids) for w, ids in words.items() if len(w) <= MEMO_LETTERS)
            self.odd.update((c, ids) for c, ids in odd.items() if len(c) <= MEMO_LETTERS)
        found.update(odd)
        return found

    def _word_ids(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            ids = self._ids(" ".join(part))
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            raw = ids.tobytes()
            out.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        return out


def tokenised(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, carry: list[str] | None = None, keep_ids: bool = True
) -> DataFrame:
    """One row per piece: the carried columns in ``common.ROW``, piece, start, length, ids_crc32 and, if wanted, ids."""
    carry = docs.columns if carry is None else carry
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias(ROW), F.col("text").cast("binary").alias("text"))
    fields = [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([inner.schema[ROW], *fields])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            row, texts = batch.columns
            for lo, hi in slices(texts):
                coded = words.encode([(t or b"").decode("utf-8", "replace") for t in texts.slice(lo, hi - lo).to_pylist()])
                source, out = [], []
                for k, ids in enumerate(coded):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        source.append(lo + k)
                        out.append((piece, at // 4, len(part) // 4, zlib.crc32(part), part))
                columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum([x[2] for x in out])]).astype(np.int32)
                    flat = np.frombuffer(b"".join(x[4] for x in out), "<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays([row.take(pa.array(source)), *columns], names=schema.names)

    return inner.mapInArrow(run, schema)


def pack(pieces: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces, which must be a stored table, with ``sequence_id`` and ``offset``.

    A piece is dealt by a hash of its checksum and its row in that table: copies go
    to all groups, and a task that runs again deals them alike.
    """
    groups = max(1, round(pieces.count() / group_rows))
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def one_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "deal"], ascending=[False, True], kind="stable")
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), length)
        return rows.drop(columns=["deal", "pack_group"]).assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    dealt = pieces.withColumn("deal", F.xxhash64("ids_crc32", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("pack_group", F.pmod(F.col("deal"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(one_group, schema)


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each size, in the order given."""
    n = np.zeros(length + 1, np.int64)  # open sequences by tokens left
    open_by_gap: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    for i, s in enumerate(np.asarray(sizes).tolist()):
        gap = length
        fits = np.flatnonzero(n[s:length])
        if len(fits):
            closed = fits == 0  # nothing is left, and closed sequences do not count
            change = 2 * (np.where(closed, 0, n[fits]) - n[fits + s]) + 2 - closed
            gap = s + int(fits[change.argmin()])
        if gap == length:
            bin_, made = made, made + 1
        else:
            bin_ = open_by_gap[gap].pop()
            n[gap] -= 1
        sequence[i], offset[i] = bin_, length - gap
        left = gap - s
        if left:
            n[left] += 1
            open_by_gap[left].append(bin_)
    return sequence, offset


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, carry: list[str] | None = None, keep_ids: bool = True
) -> DataFrame:
    """All pieces of the documents with their places; carried columns come first, but for those named like a result."""
    pieces = saved(tokenised(docs, tokenizer or default_tokenizer(), length, carry, keep_ids), "pieces")
    placed = pack(pieces, length)
    return plain(placed, *[c for c in placed.columns if c != ROW])


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), from pieces that kept their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, carry=["doc_id"], keep_ids=False)
