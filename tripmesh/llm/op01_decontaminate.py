"""Benchmark decontamination by Wu-Manber search for many word windows at once.

Patterns are the windows of benchmark items, as sequences of words. A table
over hashed blocks of three words gives how far the window end may move on
without missing a pattern; where it gives nothing, the hash of the last block
names a bucket of patterns, and the words of each are compared with the text.
Blocks stand for words rather than letters, so most of a text is jumped over in
steps of eight words. Texts are cut into overlapping lanes which move in step,
so a very long text is no slower than many short ones.

Benchmark rows are taken in blocks of ``block_bytes``. One block is broadcast and
searched in one pass, without a shuffle. Of several, only one at a time is on
the driver and in the workers: each has its own pass over the documents, which
writes the spans and items of the texts with hits, and these are merged by text.

Defined cases: null or wordless texts have no words and no hits; items that are
null, wordless or have no id match nothing; repeated item rows count once;
repeated documents give one row each; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmesh.llm.common import LOWER, ROW, SpanHashes, annotate, mixed, plain, read_table, saved, text_bytes, word_bounds

WINDOW = 10
BLOCK_BYTES = 16 << 20
BLOCK_WORDS = 3
LANE = 512
TABLE_BITS = 18
KEY = "text_key"

IS_WORD = np.zeros(256, bool)
IS_WORD[ord("0") : ord("9") + 1] = True
IS_WORD[ord("a") : ord("z") + 1] = True
IS_WORD[0x80:] = True

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("item_ids", T.ArrayType(T.LongType())),
]
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None
) -> DataFrame:
    """Documents with ``n_words``, ``hit_spans`` (half-open, in words, merged) and ``item_ids``.

    The carried columns are in the struct column ``common.ROW``.
    """
    carry = docs.columns if carry is None else carry
    n, items = benchmark_blocks(benchmark, block_bytes)
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(block_items(items, 0))
        return annotate(docs, FIELDS, lambda: searched(WindowSearch(shared.value, window)), carry)
    hits = saved(reduce(DataFrame.union, [block_hits(docs, items, k, window) for k in range(n)]), "hits")
    hits = hits.groupBy(KEY).agg(
        F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.flatten(F.collect_list("item_ids")).alias("item_ids")
    )
    hits = saved(hits.select(KEY, merged("hit_spans").alias("hit_spans"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids")), "merged")
    every = annotate(docs, [*FIELDS, T.StructField(KEY, T.BinaryType())], keyed, carry).drop("hit_spans", "item_ids")
    none = [F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) for f in FIELDS[1:]]
    return every.join(hits, KEY, "left").select(ROW, "n_words", *none)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, DataFrame]:
    """How many blocks of a bounded size there are, and the items; several blocks are written apart, so that each is read alone."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = items.where("item_id IS NOT NULL AND length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) if n > 1 else F.lit(0))
    return n, saved(items.repartitionByRange(n, "block").sortWithinPartitions("block"), "items") if n > 1 else items


def block_items(items: DataFrame, block: int) -> list[tuple[int, bytes]]:
    return [(r.item_id, bytes(r.text)) for r in items.where(F.col("block") == block).select("item_id", "text").distinct().collect()]


def searched(search: WindowSearch):
    return lambda ids, texts: scan(texts, [search])


def keyed():
    """Words without a search, and the key of each text: hits depend on nothing else."""
    return lambda ids, texts: [*scan(texts, []), text_keys(texts)]


def text_keys(texts: pa.Array) -> pa.Array:
    return pa.array([blake2b(t or b"", digest_size=16).digest() for t in texts.to_pylist()], pa.binary())


def block_hits(docs: DataFrame, items: DataFrame, block: int, window: int) -> DataFrame:
    """(text_key, hit_spans, item_ids) of the texts with hits of one block, written before the next block is fetched."""
    shared = docs.sparkSession.sparkContext.broadcast(block_items(items, block))

    def make():
        search = WindowSearch(shared.value, window)
        return lambda ids, texts: [*scan(texts, [search]), text_keys(texts)]

    found = annotate(docs, [*FIELDS, T.StructField(KEY, T.BinaryType())], make, []).where(F.size("item_ids") > 0)
    found = saved(found.groupBy(KEY).agg(F.first("hit_spans").alias("hit_spans"), F.first("item_ids").alias("item_ids")), "block")
    shared.destroy()
    return found


def merged(spans: str):
    """Sorted spans with those that overlap or touch joined."""

    def add(done, s):
        last = F.get(done, F.size(done) - 1)
        apart = (F.size(done) == 0) | (s["start"] > last["end"])
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(apart, F.concat(done, F.array(s))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    return F.aggregate(F.array_sort(spans), F.array().cast(FIELDS[1].dataType), add)


def tokenised(data: np.ndarray, bounds: np.ndarray):
    low = LOWER[data]
    starts, ends, first = word_bounds(low, bounds, IS_WORD)
    return low, starts, ends, first, SpanHashes(low)(starts, ends)


def block_hash(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end at each position."""
    h = words[at].copy()
    for k in range(1, size):
        h = h * np.uint64(0x2545F4914F6CDD1D) + words[at - k]
    return mixed(h)


class WindowSearch:
    """Tables for the windows of some items, one set for each window length."""

    def __init__(self, items: list[tuple[int, bytes]], window: int) -> None:
        found: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        for item, text in items:
            data = np.frombuffer(text, np.uint8)
            low, starts, ends, _, _ = tokenised(data, np.array([0, len(data)]))
            raw = low.tobytes()
            words = [raw[a:b] for a, b in zip(starts, ends)]
            for k in range(max(1, len(words) - window + 1) if words else 0):
                found[tuple(words[k : k + window])].add(item)
        by_length: dict[int, list] = defaultdict(list)
        for words, owners in found.items():
            by_length[len(words)].append((words, sorted(owners)))
        self.tables = [_Tables(length, patterns) for length, patterns in sorted(by_length.items())]


class _Tables:
    def __init__(self, length: int, patterns: list[tuple[tuple[bytes, ...], list[int]]]) -> None:
        self.length, self.size = length, min(BLOCK_WORDS, length)
        text = np.frombuffer(b" ".join(b" ".join(w) for w, _ in patterns), np.uint8)
        words = tokenised(text, np.array([0, len(text)]))[4].reshape(len(patterns), length)
        flat, ends = words.ravel(), np.arange(length, len(patterns) * length + 1, length) - 1
        self.shift = np.full(1 << TABLE_BITS, length - self.size + 1, np.int64)
        for back in range(length - self.size, -1, -1):
            self.shift[self._slot(block_hash(flat, ends - back, self.size))] = back
        suffix = block_hash(flat, ends, self.size)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.words = suffix[order], words[order]
        self.patterns = [patterns[i] for i in order]

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def ends(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Window ends at which the shift table allows no step."""
        lo, hi = first[:-1] + self.length - 1, first[1:]
        counts = np.maximum(0, -(-(hi - lo) // LANE))
        row = np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = lo[row] + nth * LANE
        stop = np.minimum(at + LANE, hi[row])
        found = []
        while len(at):
            step = self.shift[self._slot(block_hash(words, at, self.size))]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def matches(self, low, starts, ends, first, words) -> tuple[list[int], list[int]]:
        """(end, pattern) of all occurrences, each confirmed word by word."""
        at = self.ends(words, first)
        h = block_hash(words, at, self.size)
        lo, hi = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
        pattern = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        at = np.repeat(at, hi - lo)
        for k in range(self.length):
            same = words[at - k] == self.words[pattern, self.length - 1 - k]
            at, pattern = at[same], pattern[same]
        good = ([], [])
        for end, p in zip(at.tolist(), pattern.tolist()):
            begin = end - self.length + 1
            a, b = starts[begin : end + 1].tolist(), ends[begin : end + 1].tolist()
            raw = low[a[0] : b[-1]].tobytes()
            if all(raw[x - a[0] : y - a[0]] == w for x, y, w in zip(a, b, self.patterns[p][0])):
                good[0].append(end)
                good[1].append(p)
        return good


def scan(texts: pa.Array, searches: list[WindowSearch]) -> list[pa.Array]:
    data, bounds = text_bytes(texts)
    low, starts, ends, first, words = tokenised(data, bounds)
    change = np.zeros(len(starts) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(len(texts))]
    for tables in (t for s in searches for t in s.tables):
        at, pattern = tables.matches(low, starts, ends, first, words)
        rows = np.searchsorted(first, at, "right") - 1
        np.add.at(change, np.array(at, np.int64) - tables.length + 1, 1)
        np.add.at(change, np.array(at, np.int64) + 1, -1)
        for row, p in zip(rows.tolist(), pattern):
            items[row].update(tables.patterns[p][1])
    hit = np.cumsum(change)[:-1] > 0
    before, after = np.zeros_like(hit), np.zeros_like(hit)
    before[1:], after[:-1] = hit[:-1], hit[1:]
    row_starts = first[(first > 0) & (first < len(hit))]
    before[row_starts], after[row_starts - 1] = False, False
    begin, stop = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    rows = np.searchsorted(first, begin, "right") - 1
    counts = np.bincount(rows, minlength=len(texts))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    span = pa.StructArray.from_arrays(
        [pa.array(begin - first[rows], pa.int64()), pa.array(stop - first[rows], pa.int64())], fields=list(_SPAN)
    )
    return [
        pa.array(np.diff(first), pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), span),
        pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
    ]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return plain(
        found,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, as they came."""
    return plain(decontaminate(docs, benchmark).where(F.size("item_ids") == 0))
