"""Removal of repeated passages by overlapping windows of three lines.

Every three consecutive lines are hashed (128 bits). A window that also starts
earlier (smaller doc_id, or same document and earlier line) makes its three lines
go; lines covered by several such windows go once. Windows are judged on the
input, not on what is left. Only DataFrame functions: hashes per line are
computed in the row, windows are grouped with map-side minima, so a passage in a
third of all documents is one row per task, and what is covered comes back as
line numbers per document.

Defined cases: a null text has no lines and stays null; an empty text is one
empty line; texts of fewer than three lines stay as they are. Rows with equal
id and text count as one place, so neither is later than the other and both
change alike; a null id comes before all others. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmesh.llm.common import ROW, let, read_table, saved

LINES = 3


def drop_repeated_lines(docs: DataFrame, lines: int = LINES, carry: list[str] | None = None) -> DataFrame:
    """Each document's carried columns in ``common.ROW``, n_lines, n_removed, n_spans and kept_text."""
    carry = docs.columns if carry is None else carry
    covered = covered_lines(docs, lines)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias(ROW), "text", *_key())
    joined = keyed.join(covered, [keyed["key_id"].eqNullSafe(covered["covered_id"]), keyed["key_hash"] == covered["covered_hash"]], "left")
    every = F.split("text", "\n")
    n = F.coalesce(F.size(every), F.lit(0))
    gone = F.coalesce("covered", F.array().cast("array<int>"))
    edges = F.zip_with(
        F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(n)), lambda a, b: F.struct((a + 2).alias("at"), (b - a - 1).alias("n"))
    )
    parts = lambda lines: F.transform(F.filter(edges, lambda e: e["n"] > 0), lambda e: F.slice(lines, e["at"], e["n"]))
    kept = F.flatten(let(every, parts))
    spans = F.size(F.filter(F.zip_with(gone, F.concat(F.array(F.lit(-1)), gone), lambda a, b: (a - b).alias("d")), lambda d: d > 1))
    first_line = F.when(F.get(gone, F.lit(0)) == 0, 1).otherwise(0)
    return joined.select(
        ROW,
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.when(F.size(gone) == 0, 0).otherwise(spans + first_line).cast("long").alias("n_spans"),
        F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def _key() -> list[Column]:
    return [F.col("doc_id").alias("key_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("key_hash")]


def covered_lines(docs: DataFrame, lines: int) -> DataFrame:
    """(covered_id, covered_hash, covered): sorted numbers of the lines of a document that go."""
    found = saved(windows(docs, lines), "windows")
    place = F.struct("key_id", "at")
    repeated = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(repeated, ["a", "b"]).where(place > F.col("first"))
    numbers = F.flatten(F.transform(F.collect_set("at"), lambda k: F.sequence(k, k + (lines - 1))))
    return later.groupBy(F.col("key_id").alias("covered_id"), F.col("key_hash").alias("covered_hash")).agg(
        F.array_sort(F.array_distinct(numbers)).alias("covered")
    )


def windows(docs: DataFrame, lines: int) -> DataFrame:
    """(key_id, key_hash, at, a, b): both halves of the hash of each window and the number of its first line."""
    split = docs.select(*_key(), F.split("text", "\n").alias("lines")).where(F.size("lines") >= lines)
    hashed = split.select(
        "key_id",
        "key_hash",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("p"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(7), x)).alias("q"),
    )
    side = lambda c, k: F.xxhash64(*[F.get(c, k + j) for j in range(lines)])
    each = F.transform(
        F.sequence(F.lit(0), F.size("p") - lines), lambda k: F.struct(k.alias("at"), side("p", k).alias("a"), side("q", k).alias("b"))
    )
    return hashed.select("key_id", "key_hash", F.inline(each))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return done.select(
        f"{ROW}.doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )


def rewritten(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; a column n_chars follows."""
    done = drop_repeated_lines(docs)
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        old = F.col(f"{ROW}.n_chars")
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return done.select(*[new[c].alias(c) if c in new else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns])


SQL = """
WITH line AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), numbered AS (
  SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM line WHERE len(lines) >= 3
), win AS (
  SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS w FROM numbered
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth FROM win
  ) WHERE nth > 1
), covered AS (
  SELECT DISTINCT doc_id, pos + j AS pos FROM later, (SELECT unnest([0, 1, 2]) AS j)
), every AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM line
), marked AS (
  SELECT e.doc_id, e.pos, e.line, c.pos IS NOT NULL AS gone,
         c.pos IS NOT NULL AND NOT coalesce(lag(c.pos IS NOT NULL) OVER (PARTITION BY e.doc_id ORDER BY e.pos), false) AS begins
  FROM every e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.pos = c.pos
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
