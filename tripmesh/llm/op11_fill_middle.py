"""Fill-in-middle: texts cut at two hashed places and put in the order prefix, suffix, middle or suffix first.

Places count units (code points). The UTF-8 bytes of a batch are viewed as
64-bit words; shifts and masks mark in each word the bytes that end a unit, a
population count per word and its running sum give ranks, a search of the sum
finds the word of a wanted unit, and a multiplication gives the running counts
inside that word, from which the byte follows. No text is decoded. Rows are independent, so
there is no shuffle, and a batch is worked off in slices of about 2 MB; only a
longer text is a slice of its own.

Defined cases: null texts count as empty; empty texts and those that hold a
sentinel stay plain. A null id hashes as empty decimal digits. Equal rows
give equal rows. In bytes that are not UTF-8 a unit is whatever stands between
bytes that may start one. Other columns are carried, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmesh.llm.common import annotate, plain, read_table, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


class Units:
    """Ranks and places of the units of concatenated rows."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        padded = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
        padded[: len(data)] = data
        words = padded.view("<u8")
        starts = ~((words >> np.uint64(7)) & ~(words >> np.uint64(6))) & _ONES  # not of the form 10xxxxxx
        ends = starts >> np.uint64(8)
        ends[:-1] |= starts[1:] << np.uint64(56)
        last = bounds[1:][bounds[1:] > bounds[:-1]] - 1  # a row ends its last unit
        np.bitwise_or.at(ends, last >> 3, np.uint64(1) << ((last & 7) * 8).astype(np.uint64))
        ends[len(data) >> 3] &= (np.uint64(1) << np.uint64((len(data) & 7) * 8)) - np.uint64(1)
        ends[(len(data) >> 3) + 1 :] = 0
        self.ends = ends
        self.before = np.zeros(len(ends) + 1, np.int64)
        np.cumsum(np.bitwise_count(ends), out=self.before[1:])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Units that end before a byte."""
        word = place >> 3
        below = (np.uint64(1) << ((place & 7) * 8).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.ends[word] & below)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The byte behind the unit of a rank, counted from 1."""
        word = np.searchsorted(self.before, rank) - 1
        inside = (rank - self.before[word]).astype(np.uint64)
        running = self.ends[word] * _ONES  # byte i: units that end in the bytes up to i
        reached = ((running | _HIGH) - inside * _ONES) & _HIGH
        return 8 * word + 9 - np.bitwise_count(reached)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """The first four groups of eight hexadecimal digits of the hash of seed and id, as numbers."""
    key = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    return struct.unpack(">4I", hashlib.sha256(key).digest()[:16])


def rearranged(docs: DataFrame, carry: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """Documents with n, form, prefix_chars, middle_chars and output; carried columns are in ``common.ROW``."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    any_mark = re.compile(b"|".join(re.escape(m) for m in marks))
    p, s, m = marks

    def work(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        data, bounds = text_bytes(texts)
        units = Units(data, bounds)
        base = units.rank(bounds)
        n = np.diff(base)
        h = np.array([draws(i, seed) for i in ids.to_pylist()], np.int64).reshape(-1, 4)
        cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
        places = np.repeat(bounds[:-1, None], 2, axis=1)
        inner = cuts > 0
        places[inner] = units.select((base[:-1, None] + cuts)[inner])
        whole = data.tobytes()
        forms, outputs = [], []
        for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if lo == hi or h[k, 2] % 100 >= PLAIN_FROM or any_mark.search(whole, lo, hi):
                forms.append("plain")
                outputs.append(whole[lo:hi])
                continue
            a, b = places[k].tolist()
            pre, mid, suf = whole[lo:a], whole[a:b], whole[b:hi]
            spm = h[k, 3] % 100 < SPM_BELOW
            forms.append("spm" if spm else "psm")
            outputs.append(b"".join((s, suf, p, pre, m, mid) if spm else (p, pre, s, suf, m, mid)))
        cut = np.array([f == "plain" for f in forms], bool)
        return [
            pa.array(n, pa.int64()),
            pa.array(forms, pa.string()),
            pa.array(cuts[:, 0], pa.int64(), mask=cut),
            pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=cut),
            pa.array(outputs, pa.binary()).view(pa.string()),
        ]

    return annotate(docs, _FIELDS, lambda: work, docs.columns if carry is None else carry)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No sentinel overlaps itself or another, so the first one found is the one put in."""

    def parts(of: Column, mark: str) -> Column:
        return F.split(of, re.escape(mark), 2)

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        head = parts(F.substring(output, len(first) + 1, 2**31 - 1), second)
        tail = parts(F.get(head, F.lit(1)), MIDDLE)
        return F.get(head, F.lit(0)), F.get(tail, F.lit(0)), F.get(tail, F.lit(1))

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return plain(
        rearranged(docs, ["doc_id"]),
        *("n", "form", "prefix_chars", "middle_chars"),
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex
  FROM documents
), h AS (
  SELECT doc_id, t, n,
         CAST('0x' || substr(hex, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(hex, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) % 100 AS h4
  FROM drawn
), formed AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), made AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM formed
), put AS (
  SELECT doc_id, n, form, a, b,
         CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS o
  FROM made
), found AS (
  SELECT *, strpos(o, '<P>') AS p, strpos(o, '<S>') AS s, strpos(o, '<M>') AS m FROM put
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o
              WHEN 'psm' THEN substr(o, 4, s - 4) || substr(o, m + 3) || substr(o, s + 3, m - s - 3)
              ELSE substr(o, p + 3, m - p - 3) || substr(o, m + 3) || substr(o, 4, p - 4) END) AS restored_sha256
FROM found
"""
