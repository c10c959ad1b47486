"""Removal of repeated byte strings, by prefix-free parsing.

Every byte covered by a string of ``length`` bytes that also starts earlier goes.
As in prefix-free parsing, a rolling hash sets triggers in the text. The trigger
of a string is the place of the smallest hash of 8 bytes among its first 64, so
equal strings have their triggers at the same place, strings that start near each
other share one, and there is one trigger for 30 bytes of text. The strings of
one trigger make a phrase: from the first one's first to the last one's last byte.

* Dictionary: phrases, by the hash of their bytes. Parse: where each stands.
  An occurrence that is not the first of its phrase is covered whole. In highly
  repetitive text nearly all are, and cost one row, not one for each byte.
* Suffix order: the first occurrences of different phrases can share strings only
  if the bytes from the trigger to the end of the shortest string (36) agree.
  Phrases are put in the order of that suffix; one whose suffix no other phrase
  has is done. What is left, at the ends of repetitions and around common passages, is
  sent with its bytes to the others of its suffix, and the strings of each group are
  compared there. Where more than CROWD phrases have one suffix, the
  strings themselves are hashed and dealt out, so that no group is held in one task.

Only equality with something earlier is asked, never what sorts before what, so
suffixes are ordered by their hashes instead of their letters. Hashes that decide
on removal have 128 bits.

Phrases are first reduced within a slice of a task, so a group of copies is one
row per slice, then dealt out by suffix and compared with their neighbours in
windows that spill; what a slice has decided already is dealt out by hash of its place. Documents are
shuffled once, by id, and that shuffle is read for both the strings and the result.

Defined cases: null texts are empty; texts shorter than ``length`` stay; rows with
equal id and text are one place, so neither is later than the other; rows of
equal id and different texts count by their texts; null ids come first; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripmesh.llm.common import SpanHashes, mixed, powers, read_table, saved, slices, text_bytes

LENGTH = 100
GRAM = 8
REACH = 64  # places looked at for a trigger; REACH + GRAM <= LENGTH
SUFFIX = LENGTH - REACH  # bytes from a trigger that all its strings have
CROWD = 4096  # phrases of one suffix that are compared in one task
FIRST_ID = -(1 << 63)

# A phrase is four numbers, as there is one for 30 bytes of text. ``place`` holds, from the upper bits on, 20 bits
# of the hash of the text, the trigger, and the distances to the first and the last string. Starts known to be covered
# have a negative place, -1 - (tag and first start), the last start as phrase, and a hash of doc and place as suffix.
_PHRASE = "suffix long, phrase long, doc long, place long"
STEP_BITS, AT_BITS = 6, 31
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- triggers -------------------------------------------------------------------


def triggers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first string, trigger and last string (starts, within the row) of every phrase."""
    empty = np.zeros(0, np.int64)
    usable = np.maximum(0, np.diff(bounds) - LENGTH + 1)
    if not usable.any():
        return empty, empty, empty, empty
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * GRAM, np.uint8)])
    gram = np.empty(n, np.uint64)
    for k in range(GRAM):
        here = len(range(k, n, GRAM))
        gram[k::GRAM] = padded[k : k + GRAM * here].view("<u8")
    best = (mixed(gram) & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < REACH:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(usable)), usable)
    start = np.arange(len(row)) - np.repeat(np.cumsum(usable) - usable, usable) + bounds[row]
    at = place[start]
    new = np.ones(len(row), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    base = bounds[row[first]]
    return row[first], start[first] - base, at[first] - base, start[last] - base


class DoubleHashes:
    """Two independent 64-bit hashes of spans."""

    def __init__(self, data: np.ndarray) -> None:
        self.one = SpanHashes(data)
        table = mixed(np.arange(256, dtype=np.uint64) * np.uint64(0x9E6C63D0876A9A47) + np.uint64(0x3C79AC492BA7B653))
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] ^ np.uint64(0x94D049BB133111EB))
        return self.one(starts, ends).view(np.int64), b.view(np.int64)


def phrases_of(ids: np.ndarray, tags: np.ndarray, texts: pa.Array) -> list[np.ndarray]:
    """Columns of _PHRASE for some documents. Phrases that occur before in the slice are covered."""
    data, bounds = text_bytes(texts)
    row, low, trigger, high = triggers(data, bounds)
    hashes = DoubleHashes(data)
    base = bounds[row]
    suffix = hashes(base + trigger, base + trigger + SUFFIX)[0]
    phrase = mixed(hashes(base + low, base + high + LENGTH)[1].view(np.uint64) + (trigger - low).astype(np.uint64)).view(np.int64)
    doc, tag = ids[row], tags[row]
    place = (((tag << AT_BITS | trigger) << STEP_BITS | (trigger - low)) << STEP_BITS) | (high - low)
    later = later_of(suffix, phrase, doc, place)
    if not len(later):
        return [suffix, phrase, doc, place]
    # Neighbouring covered phrases of one document become one row.
    keep = np.ones(len(later), bool)
    keep[1:] = ~later[1:] | ~later[:-1] | (row[1:] != row[:-1])
    begin = np.flatnonzero(keep)
    end = np.append(begin[1:], len(later)) - 1
    gone = later[begin]
    place = np.where(gone, -1 - (tag[begin] << AT_BITS | low[begin]), place[begin])
    spread = mixed((doc[begin] * 3 + place).view(np.uint64)).view(np.int64)
    return [np.where(gone, spread, suffix[begin]), np.where(gone, high[end], phrase[begin]), doc[begin], place]


# --- phrases across documents -----------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, tag, text): the place of a document in the order, and its bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    tag = F.shiftrightunsigned(F.xxhash64(text), 44).alias("tag")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc"), tag, text.alias("text"))


def parsed(rows: DataFrame) -> DataFrame:
    """Phrases of all documents."""
    names = [c.split()[0] for c in _PHRASE.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, texts = batch.columns
            for lo, hi in slices(texts):
                columns = phrases_of(ids[lo:hi].to_numpy(), tags[lo:hi].to_numpy(), texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return rows.mapInArrow(parse, _PHRASE)


def decided(phrases: DataFrame) -> DataFrame:
    """(doc, tag, low, high, suffix, crowded): starts that are covered (without suffix), or open to be looked at one by one."""
    place = F.struct("doc", "place")
    of_suffix = Window.partitionBy("suffix")
    of_phrase = Window.partitionBy("suffix", "phrase").orderBy("doc", "place")
    known = F.col("place") < 0
    compared = phrases.select(
        "*",
        F.first(place).over(of_phrase).alias("first"),
        (F.min("phrase").over(of_suffix) != F.max("phrase").over(of_suffix)).alias("several"),
        (F.count("*").over(of_suffix) > CROWD).alias("crowded"),
    )
    covered = known | (F.col("first") != place)
    bits = lambda c, by, n: F.shiftright(c, by).bitwiseAND(F.lit((1 << n) - 1))
    mark = F.when(known, -1 - F.col("place")).otherwise(F.shiftright("place", 2 * STEP_BITS))
    trigger = bits(mark, 0, AT_BITS)
    low = F.when(known, trigger).otherwise(trigger - bits("place", STEP_BITS, STEP_BITS))
    high = F.when(known, F.col("phrase")).otherwise(low + bits("place", 0, STEP_BITS))
    columns = [low.cast("int").alias("low"), high.cast("int").alias("high"), F.when(~covered, F.col("suffix")).alias("suffix"), "crowded"]
    return compared.where(covered | F.col("several")).select("doc", F.shiftright(mark, AT_BITS).alias("tag"), *columns)


def later_of(a: np.ndarray, b: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of some hashed strings start later than an equal one."""
    order = np.lexsort((place, doc, b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    first = np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
    lead = np.repeat(order[first], np.diff(np.append(first, len(order))))
    later = np.zeros(len(order), bool)
    later[order] = (doc[order] != doc[lead]) | (place[order] != place[lead])
    return later


def with_texts(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """(suffix, doc, place, bytes) of open phrases; place: tag and first start."""
    lists = open_.groupBy("doc", "tag").agg(F.collect_set(F.struct("low", "high", "suffix")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag, text, spans = (batch.column(c) for c in ("doc", "tag", "text", "spans"))
            for k in range(batch.num_rows):
                whole, found, mark = text[k].as_py(), spans[k].as_py(), tag[k].as_py() << AT_BITS
                places = pa.array([mark | s["low"] for s in found], pa.int64())
                columns = [pa.array([s["suffix"] for s in found], pa.int64()), pa.array([doc[k].as_py()] * len(found), pa.int64()), places]
                columns.append(pa.array([whole[s["low"] : s["high"] + LENGTH] for s in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["suffix", "doc", "place", "bytes"])

    found = rows.join(lists, ["doc", "tag"], "left").where("spans IS NOT NULL")
    return found.mapInArrow(cut, "suffix long, doc long, place long, bytes binary")


def later_in_groups(phrases: DataFrame) -> DataFrame:
    """(doc, tag, low, high): runs of strings of open phrases that start earlier, too, in a phrase of the same suffix."""

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = text_bytes(batch.column("bytes"))
        strings = np.diff(bounds) - LENGTH + 1
        row = np.repeat(np.arange(len(strings)), strings)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
        start = bounds[row] + offset
        doc, place = batch.column("doc").to_numpy()[row], batch.column("place").to_numpy()[row] + offset
        later = later_of(*DoubleHashes(data)(start, start + LENGTH), doc, place)
        begins = later.copy()
        begins[1:] &= ~later[:-1] | (row[1:] != row[:-1])
        ends = later.copy()
        ends[:-1] &= ~later[1:] | (row[1:] != row[:-1])
        at = place & ((1 << AT_BITS) - 1)
        columns = [pa.array(doc[begins]), pa.array(place[begins] >> AT_BITS), pa.array(at[begins].astype(np.int32)), pa.array(at[ends].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "tag", "low", "high"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of equal suffixes, which stand together; a group is at most CROWD rows."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if table.num_rows:
                suffix = table.column("suffix").to_numpy()
                whole = int(np.flatnonzero(suffix != suffix[-1])[-1]) + 1 if suffix[0] != suffix[-1] else 0
                if whole:
                    yield from map(runs, table.slice(0, whole).combine_chunks().to_batches())
                rest = table.slice(whole).combine_chunks().to_batches()
                held = rest[0]
        if held is not None:
            yield runs(held)

    return phrases.repartition("suffix").sortWithinPartitions("suffix").mapInArrow(groups, "doc long, tag long, low int, high int")


def later_strings(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """(doc, tag, low, high): open strings that start earlier, too."""
    lists = open_.groupBy("doc", "tag").agg(F.collect_set(F.struct("low", "high")).alias("spans"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = np.frombuffer(batch.column("text")[k].as_py(), np.uint8)
                spans = batch.column("spans")[k].as_py()
                starts = np.unique(np.concatenate([np.arange(s["low"], s["high"] + 1) for s in spans]))
                a, b = DoubleHashes(text)(starts, starts + LENGTH)
                doc, tag = (batch.column(c)[k].as_py() for c in ("doc", "tag"))
                columns = [pa.array(a), pa.array(b), pa.array(np.full(len(starts), doc)), pa.array(tag << AT_BITS | starts)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "doc", "place"])

    found = rows.join(lists, ["doc", "tag"], "left").where("spans IS NOT NULL").mapInArrow(strings, "a long, b long, doc long, place long")
    place = F.struct("doc", "place")
    first = F.first(place).over(Window.partitionBy("a", "b").orderBy("doc", "place"))
    later = found.withColumn("later", first != place).where("later")
    low = F.col("place").bitwiseAND(F.lit((1 << AT_BITS) - 1)).cast("int")
    return later.select("doc", F.shiftright("place", AT_BITS).alias("tag"), low.alias("low"), low.alias("high"))


def repeats(docs: DataFrame) -> DataFrame:
    """Rows (doc, tag, text, spans) of all documents; spans: first and last starts of strings that go."""
    rows = keyed(docs)
    found = saved(decided(parsed(rows)), "phrases")
    covered = found.where("suffix IS NULL").select("doc", "tag", "low", "high")
    covered = covered.union(later_in_groups(with_texts(rows, found.where("suffix IS NOT NULL AND NOT crowded"))))
    covered = covered.union(later_strings(rows, found.where("suffix IS NOT NULL AND crowded")))
    lists = covered.groupBy("doc", "tag").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return rows.join(lists, ["doc", "tag"], "left")


def without(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of a text, and how many runs of bytes went."""
    if not spans:
        return text, 0
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, [s["low"] for s in spans], 1)
    np.add.at(change, [s["high"] + LENGTH for s in spans], -1)
    gone = np.cumsum(change)[:-1] > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_spans) of every document: what is left of it, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [without(t.as_py(), s.as_py()) for t, s in zip(batch.column("text"), batch.column("spans"))]
            columns = [batch.column("doc"), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "kept", "n_spans"])

    left = repeats(docs).mapInArrow(run, "doc long, kept binary, n_spans long")
    return left.select(F.when(F.col("doc") != FIRST_ID, F.col("doc")).alias("doc_id"), "kept", "n_spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, taken from what ``without`` leaves of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            done = [without(t, s.as_py()) for t, s in zip(texts, batch.column("spans"))]
            counts = [[len(t) for t in texts], [len(t) - len(d[0]) for t, d in zip(texts, done)], [d[1] for d in done]]
            columns = [batch.column("doc"), *[pa.array(c, pa.int64()) for c in counts]]
            columns.append(pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RESULT.split(", ")])

    done = repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(run, _RESULT)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != FIRST_ID, F.col("doc_id")))
