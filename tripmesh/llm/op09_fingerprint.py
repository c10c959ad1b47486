"""Document fingerprints: a digest of byte-triplet counts by quartile.

Triplets of bytes, contiguous and with a gap, are hashed into 128 buckets and
counted. Each bucket is encoded in two bits, the quartile of its count among all
buckets, and the length on a logarithmic scale in a byte, so a text of any size
gives 68 hexadecimal digits. The difference of two digests adds up the steps
between quartiles, from the lowest to the highest counting double, and the steps
between lengths, up to a bound; likeness is 1 minus its share of the bound.

``with_successors`` puts each text beside the next one by id, with one shuffle of
the texts: ranges of ids go to tasks, and the first document of each range is
sent to the range before it too. Bounds are ids from approximate quantiles, so
ranges hold like numbers of rows whatever the ids. Tasks stream through their
sorted rows, holding a few megabytes.

Defined cases: null texts are empty, and empty texts have the digest of all
zeros; a single document is its own successor; rows of equal id follow each other
in the order of their texts; null ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmesh.llm.common import annotate, read_table, text_bytes

BUCKETS = 128
BOUND = 256
RANGE_ROWS, MOST_RANGES, FAN = 4000, 4096, 64
FIRST_ID = -(1 << 63)
GAPS = ((1, 2), (2, 3))  # places of the second and third byte after the first

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digests(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of BUCKETS quartiles and a length code for each text."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(bounds))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
    wide = data.astype(np.uint32)
    counts = np.zeros(n * BUCKETS, np.int64)
    for k, (second, third) in enumerate(GAPS):
        if len(data) <= third:
            continue
        h = wide[:-third] * np.uint32(0x9E3779B1) + wide[second : len(wide) - third + second] * np.uint32(0x85EBCA77)
        h = (h + wide[third:] * np.uint32(0xC2B2AE3D) + np.uint32(k)) * np.uint32(0x27D4EB2F)
        at = row[:-third] + (h >> np.uint32(25)).astype(np.int64)
        counts += np.bincount(at[left[:-third] > third], minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    ordered = np.sort(counts, axis=1)
    out = np.zeros((n, BUCKETS + 1), np.uint8)
    for k in (1, 2, 3):
        out[:, :BUCKETS] += counts > ordered[:, [k * BUCKETS // 4 - 1]]
    out[:, BUCKETS] = np.minimum(255, np.round(np.log(np.diff(bounds) + 1) / np.log(1.1)))
    return out


def text_of(digest: np.ndarray) -> list[str]:
    """Digests as hexadecimal text: length code, checksum of the rest, quartiles."""
    q = digest[:, :BUCKETS].reshape(len(digest), -1, 4)
    packed = (q << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2).astype(np.uint8)
    check = packed.astype(np.int64).sum(axis=1) % 251
    whole = np.column_stack([digest[:, BUCKETS], check.astype(np.uint8), packed])
    return [r.tobytes().hex() for r in whole]


def digest_of(text: str) -> np.ndarray:
    """The digest that a fingerprint encodes."""
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    q = (raw[2:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return np.concatenate([q.ravel(), raw[:1]])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests (rows), 0 from the bound on."""
    step = np.abs(a.astype(np.int64) - b.astype(np.int64))
    quartiles, length = step[:, :BUCKETS], step[:, BUCKETS]
    score = (quartiles + 3 * (quartiles == 3)).sum(axis=1) + np.minimum(length, 40)
    return 1 - np.minimum(score, BOUND) / BOUND


def fingerprints(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Documents with their ``fingerprint``; the carried columns are in ``common.ROW``."""
    fields = [T.StructField("fingerprint", T.StringType())]
    work = lambda: lambda ids, texts: [pa.array(text_of(digests(*text_bytes(texts))), pa.string())]
    return annotate(docs, fields, work, docs.columns if carry is None else carry)


def id_bounds(docs: DataFrame) -> list[int]:
    """First ids of ranges of about equal numbers of rows; all are ids of documents."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("key")
    n = docs.count()
    ranges = min(MOST_RANGES, n // RANGE_ROWS + 1)
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    low, inner = docs.select(key).agg(F.min("key"), F.percentile_approx("key", shares, 20 * ranges)).first()
    return [] if low is None else sorted({low, *(inner if ranges > 1 else [])})


def range_of(key: Column, bounds: list[int]) -> tuple[Column, Column]:
    """Number of the range that holds a key and its first key, by a search in two levels."""
    parts = [bounds[k : k + FAN] for k in range(0, len(bounds), FAN)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = F.size(F.filter(longs([p[0] for p in parts]), lambda b: b <= key)) - 1
    part = F.get(F.array(*map(longs, parts)), coarse)
    fine = F.size(F.filter(part, lambda b: b <= key)) - 1
    return coarse * FAN + fine, F.get(part, fine)


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows (range, again, key, doc_id, text), sorted within each task, one range after the other.

    In each range the first row with ``again`` is the successor of its last document.
    """
    bounds = id_bounds(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), key.alias("key"))
    if not bounds:
        return rows.select(F.lit(0).alias("range"), F.lit(False).alias("again"), "key", "doc_id", "text")
    number, first = range_of(F.col("key"), bounds)
    placed = rows.select("*", number.alias("own"), first.alias("first"))
    before = F.pmod(F.col("own") - 1, F.lit(len(bounds)))
    both = F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("again")), F.struct(before.alias("range"), F.lit(True).alias("again")))
    places = F.when(F.col("key") == F.col("first"), both).otherwise(F.slice(both, 1, 1))
    spread = placed.select(F.inline(places), "key", "doc_id", "text")
    return spread.repartition("range").sortWithinPartitions("range", "again", "key", "text")


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and that of its successor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int | None, bytes]] = []
        size = 0
        for batch in batches:
            for r, again, i, t in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                held.append((r, again, i, t or b""))
                size += len(held[-1][3])
                if size > 4 << 20:
                    yield measured(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield measured(held)

    return with_successors(docs).mapInArrow(run, SCHEMA)


def measured(rows: list[tuple[int, bool, int | None, bytes]]) -> pa.RecordBatch:
    """Result for every row that is followed by another one of its range."""
    texts = [t for _, _, _, t in rows]
    at = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
    own = digests(*joined(texts))
    edited, n_chars = [], []
    for k in at:
        text, following = (t.decode("utf-8", "surrogateescape") for t in texts[k : k + 2])
        half = len(text) // 2
        edited.append((text[: len(text) - half] + following[:half]).encode("utf-8", "surrogateescape"))
        n_chars.append(len(text))
    new, at_ = digests(*joined(edited)), np.array(at, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[k][2] for k in at], pa.int64()),
            pa.array(n_chars, pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array(text_of(own[at_]), pa.string()),
            pa.array(text_of(new), pa.string()),
            pa.array(likeness(own[at_], new), pa.float64()),
            pa.array(likeness(own[at_], own[at_ + 1]) if at else [], pa.float64()),
        ],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
