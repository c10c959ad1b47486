"""Helpers that several operators share: row carriage, byte-level words, shared scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmesh.session import scratch_path

ROW = "carried_row"
SLICE_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """The frame written as Parquet to the shared scratch folder and read again; this cuts lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


# --- Arrow passes -------------------------------------------------------------


def annotate(
    docs: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array, pa.Array], list[pa.Array]]],
    carry: list[str],
) -> DataFrame:
    """Adds columns computed from (doc_id, text), rows in and out one to one.

    ``make`` runs once in each task and returns a function from the two Arrow
    arrays (texts as bytes) to one array per field. The columns in ``carry``
    travel inside one struct column, so their names never meet those of
    ``fields``; ``plain`` takes them out again.
    """
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias(ROW),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
    )
    schema = T.StructType([inner.schema[ROW], *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            row, ids, texts = batch.columns
            for lo, hi in slices(texts):
                got = work(ids.slice(lo, hi - lo), texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([row.slice(lo, hi - lo), *got], names=names)

    return inner.mapInArrow(run, schema)


def plain(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The carried columns of an annotated frame, followed by the given ones.

    A carried column with the name of a given one, in any case, gives way to it.
    """
    taken = {c.lower() for c in df.select(*columns).columns}
    carried = [c for c in df.schema[ROW].dataType.names if c.lower() not in taken]
    return df.select(*[F.col(f"{ROW}.`{c}`") for c in carried], *columns)


_kept: dict = {}


def kept(key: tuple, make: Callable):
    """What a worker process keeps from task to task: the last thing asked for, so the stages of a pipeline do not pile up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``limit`` bytes each; a longer text is a range of its own."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array, and the bounds of its rows in them. A null has no bytes."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


# --- words and hashes over bytes ------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class SpanHashes:
    """64-bit hashes of any spans of one byte array."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def word_bounds(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, maximal runs of word bytes inside a row, and the first word of each row."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = np.zeros(len(data) + 1, bool)
    last[1:] = inside[:-1] & ~inside[1:]
    cut = bounds[bounds < len(data)]
    first[cut] = inside[cut]
    cut = bounds[bounds > 0]
    last[cut] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, bounds)
