"""Near-duplicate documents by HyperMinHash sketches.

A document's set of shingles is hashed in 8 rounds into 16 buckets each. A
bucket keeps the smallest hash in 16 bits, as the count of leading zeros and 10
bits of mantissa, so a sketch is 128 registers of 2 bytes. A band is the same
bucket in four rounds, its key the four registers as they are: 32 bands find a
pair at similarity 0.8 with a chance of 1 - 5e-8.

1. Documents of equal sets form classes, represented by the smallest id. Groups
   of exact copies, however large, are one row from here on.
2. In each band bucket every member meets the smallest one only, so a bucket
   gives as many candidates as it has members.
3. Candidates whose Jaccard estimate, corrected for registers that agree by
   chance, is more than six standard deviations below the limit are dropped;
   the others are verified on their full sets of shingles.
4. Verified links join classes to components.
5. In buckets that still hold several components, members of different ones are
   compared by their registers, each pair in the first bucket that it shares.
   Small buckets hand on the pairs that may reach the limit. Large ones are cut
   into tiles of bounded size, where such pairs are tested on their sets of
   shingle hashes at once, a member needing one link to each other component;
   only links leave a tile, never the pairs of a group.

Defined cases: texts that are null or hold no word have no shingle and are alone
in their component; with fewer words than a shingle the whole text is one.
Repeated rows get the same answer each; a null id has no component and is kept;
empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmesh.llm.common import LOWER, SpanHashes, annotate, mixed, plain, read_table, saved, slices, text_bytes, word_bounds
from tripmesh.llm.graph import components

SHINGLE = 4
PERCENT = 80
ROUNDS, BUCKETS, ROWS = 8, 16, 4
BANDS = ROUNDS // ROWS * BUCKETS
VALUE_BITS, MANTISSA = 40, 10
DEVIATIONS = 6
TILE = 500
SMALL, UNIT_ROWS = 64, 10_000
NO_PAIRS = pd.DataFrame({"a": [], "b": []}, dtype="int64")

IS_WORD = np.ones(256, bool)
IS_WORD[0x20] = False
IS_WORD[0x09:0x0E] = False

SALTS = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

FIELDS = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_a", T.LongType()),
    T.StructField("set_b", T.LongType()),
    T.StructField("sketch", T.ArrayType(T.LongType())),
]


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle of every row, sorted by row."""
    data, bounds = text_bytes(texts)
    low = LOWER[data]
    starts, ends, first = word_bounds(low, bounds, IS_WORD)
    words = SpanHashes(low)(starts, ends)
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(1, count - size + 1))
    row = np.repeat(np.arange(len(count)), n)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(count[row], size)
    h = np.full(len(row), 0x1F83D9ABFB41BD6B, np.uint64) + length.astype(np.uint64)
    for k in range(size):
        inside = k < length
        h[inside] = mixed(h[inside] * np.uint64(0x2545F4914F6CDD1D) + words[at[inside] + k])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def sketches(texts: pa.Array, size: int = SHINGLE) -> list[pa.Array]:
    row, h = shingle_hashes(texts, size)
    n = len(texts)
    registers = np.zeros((n, ROUNDS, BUCKETS), np.uint16)
    for k in range(ROUNDS):
        v = mixed(h ^ SALTS[k])
        bucket = (v >> np.uint64(60)).astype(np.int64)
        slot = row * BUCKETS + bucket
        value = (v >> np.uint64(60 - VALUE_BITS)) & np.uint64((1 << VALUE_BITS) - 1)
        packed = np.sort((slot.astype(np.uint64) << np.uint64(VALUE_BITS)) | value)
        slot = packed >> np.uint64(VALUE_BITS)
        new = np.ones(len(slot), bool)
        new[1:] = slot[1:] != slot[:-1]
        value = packed[new] & np.uint64((1 << VALUE_BITS) - 1)
        registers.reshape(n, -1)[(slot[new] // np.uint64(BUCKETS)).astype(np.int64), k * BUCKETS + (slot[new] % np.uint64(BUCKETS)).astype(np.int64)] = compressed(value)
    set_a, set_b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(set_a, row, mixed(h + np.uint64(1)))
    np.add.at(set_b, row, mixed(h ^ np.uint64(0x5851F42D4C957F2D)))
    bands = registers.reshape(n, ROUNDS // ROWS, ROWS, BUCKETS).transpose(0, 1, 3, 2)
    keys = np.ascontiguousarray(bands).view("<i8").reshape(-1)
    offsets = np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)
    return [
        pa.array(np.bincount(row, minlength=n).astype(np.int64)),
        pa.array(set_a.view(np.int64)),
        pa.array(set_b.view(np.int64)),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys, pa.int64())),
    ]


def compressed(value: np.ndarray) -> np.ndarray:
    """1 + (leading zeros, mantissa) of hashes below 2**VALUE_BITS; 0 stays for empty buckets."""
    fraction, exponent = np.frexp(np.maximum(value, 1).astype(np.float64))
    zeros = VALUE_BITS - exponent
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return (1 + (zeros << MANTISSA) + mantissa).astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that filled registers of two unrelated sets of these sizes agree."""
    zeros = np.arange(VALUE_BITS + 1)[:, None]
    law = lambda n: (1 - 2.0**-zeros) ** (n / BUCKETS) - (1 - 2.0 ** -(zeros + 1)) ** (n / BUCKETS)
    return np.abs(law(np.maximum(n, 1)) * law(np.maximum(m, 1))).sum(axis=0) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches (rows of registers), corrected for chance."""
    raw, by_chance = agreement(a, b)[0], chance(n, m)
    return (raw - by_chance) / (1 - by_chance)


def agreement(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of filled registers that agree, and how many are filled."""
    filled = np.count_nonzero(a | b, axis=1)
    same = np.count_nonzero((a == b) & (a > 0), axis=1)
    return same / np.maximum(filled, 1), filled


def promising(a, b, n, m, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs may reach the limit, and their estimates. Sizes alone rule some out."""
    limit = percent / 100
    raw, filled = agreement(a, b)
    least = limit - DEVIATIONS * np.sqrt(limit * (1 - limit) / np.maximum(filled, 1))
    good = (raw >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    guess = np.zeros(len(raw))
    by_chance = chance(n[good], m[good])
    guess[good] = (raw[good] - by_chance) / (1 - by_chance)
    return good & (guess >= least), guess


def registers_of(keys: pd.Series) -> np.ndarray:
    return np.stack(keys.to_numpy()).astype("<i8").view("<u2") if len(keys) else np.zeros((0, BANDS * ROWS), np.uint16)


def shingle_set(text: bytes, size: int) -> set:
    words = text.lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs."""
    sketched = annotate(docs.select("doc_id", "text"), FIELDS, lambda: lambda ids, texts: sketches(texts, size), ["doc_id"])
    sketched = saved(plain(sketched, *[f.name for f in FIELDS]), "sketches")
    key = ["n_shingles", "set_a", "set_b"]
    classes = (
        sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
        .groupBy(*key)
        .agg(F.min(F.struct("doc_id", "sketch")).alias("least"))
        .select(*key, F.col("least.doc_id").alias("rep"), F.col("least.sketch").alias("sketch"))
    )
    classes = saved(classes, "classes")
    roots = components(links(docs, classes.select("rep", "n_shingles", "sketch"), size, percent))
    rooted = classes.drop("sketch").join(roots, F.col("rep") == F.col("node"), "left")
    rooted = rooted.select(*key, F.coalesce("root", "rep").alias("component_id"))
    joined = sketched.drop("sketch").join(rooted, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links (a, b) that connect all similar classes."""
    members = classes.select("rep", F.posexplode("sketch").alias("band", "key")).where("key <> 0")
    shared = members.groupBy("band", "key").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = saved(members.join(shared, ["band", "key"]), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts = saved(texts.join(wanted, "doc_id"), "texts")
    tested = saved(members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "candidates")
    found = saved(verified(texts, likely(tested, classes, percent), size, percent), "found")
    rows = saved(rival_rows(members, classes, components(found)), "rivals")
    more = small_rivals(rows, percent).union(large_rivals(rows, texts, size, percent)).distinct()
    more = saved(more.join(tested, ["a", "b"], "left_anti"), "candidates")
    return found.union(verified(texts, more, size, percent))


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose registers may belong to similar sets."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            good, _ = promising(registers_of(p.sketch_a), registers_of(p.sketch_b), p.n_a.to_numpy(), p.n_b.to_numpy(), percent)
            yield p.loc[good, ["a", "b"]]

    return joined.mapInPandas(run, "a long, b long")


def verified(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets of shingles are similar enough."""
    pairs = saved(pairs, "pairs")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, set()
        for batch in batches:
            good = []
            a, b, text_a, text_b = batch.columns
            for k in range(batch.num_rows):
                left, right = text_a[k].as_py() or b"", text_b[k].as_py() or b""
                if left != last:
                    last, last_set = left, shingle_set(left, size)
                other = shingle_set(right, size)
                both = len(last_set & other)
                good.append(both > 0 and 100 * both >= percent * (len(last_set) + len(other) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long").distinct()


def rival_rows(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their sketches."""
    rooted = members.select("band", "key", "rep", "n").join(roots, F.col("rep") == F.col("node"), "left")
    rooted = rooted.select("band", "key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    several = rooted.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    rows = rooted.join(several.select("band", "key"), ["band", "key"]).join(classes, "rep")
    return rows.select("rep", "root", "n_shingles", "sketch", "n", "band", F.xxhash64("band", "key").alias("bucket"))


def rival_pairs(p: tuple, q: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Which pairs (row i of p, row j of q) may be similar, lie in different components and meet here first."""
    (root_p, n_p, band, sketch_p), (root_q, n_q, _, sketch_q) = p, q
    apart = (root_p[i] != root_q[j]) & (100 * np.minimum(n_p[i], n_q[j]) >= percent * np.maximum(n_p[i], n_q[j]))
    i, j = i[apart], j[apart]
    a, b = sketch_p[i], sketch_q[j]
    here = ((a == b) & (a != 0)).argmax(axis=1) == band[i]
    i, j, a, b = i[here], j[here], a[here], b[here]
    good, guess = promising(a.view("<u2"), b.view("<u2"), n_p[i], n_q[j], percent)
    return i[good], j[good], guess[good]


def rival_arrays(p: pd.DataFrame) -> tuple[np.ndarray, ...]:
    keys = np.stack(p.sketch.to_numpy()).astype("<i8") if len(p) else np.zeros((0, BANDS), "<i8")
    return p.root.to_numpy(), p.n_shingles.to_numpy(), p.band.to_numpy(), keys


def small_rivals(rows: DataFrame, percent: int) -> DataFrame:
    """Promising pairs of buckets of at most SMALL members, many buckets to a call."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("bucket")
        bucket, rep, own, found = p.bucket.to_numpy(), p.rep.to_numpy(), rival_arrays(p), []
        for step in range(1, SMALL):
            i = np.flatnonzero(bucket[step:] == bucket[:-step])
            if not len(i):
                break
            i, j, _ = rival_pairs(own, own, i, i + step, percent)
            found.append(pd.DataFrame({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])}))
        return pd.concat(found) if found else NO_PAIRS

    units = rows.count() // UNIT_ROWS + 1
    few = rows.where(F.col("n") <= SMALL).withColumn("unit", F.pmod(F.col("bucket"), F.lit(units)))
    return few.groupBy("unit").applyInPandas(run, "a long, b long")


def large_rivals(rows: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of larger buckets: for each member and other component one pair that is similar, if there is any."""
    many = rows.where(F.col("n") > SMALL)
    sets = texts.join(many.select(F.col("rep").alias("doc_id")).distinct(), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                row, h = shingle_hashes(batch.column("text").slice(lo, hi - lo), size)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                data = [h[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(data, pa.binary())], names=["rep", "hashes"])

    sets = saved(sets.mapInArrow(hashed, "rep long, hashes binary"), "sets")

    def tile(p: pd.DataFrame) -> pd.DataFrame:
        p, q = p[p.left], p[~p.left]
        rep_p, rep_q, root_q = p.rep.to_numpy(), q.rep.to_numpy(), q.root.to_numpy()
        set_p, set_q = ([np.frombuffer(x, np.uint64) for x in side.hashes] for side in (p, q))
        own, other = rival_arrays(p), rival_arrays(q)
        i, j = np.nonzero(rep_p[:, None] < rep_q)
        done, found = set(), []
        for lo in range(0, len(i), 100_000):
            for a, b, _ in sorted(zip(*rival_pairs(own, other, i[lo : lo + 100_000], j[lo : lo + 100_000], percent)), key=lambda x: -x[2]):
                if (a, root_q[b]) in done:
                    continue
                both = np.count_nonzero(np.isin(set_p[a], set_q[b], assume_unique=True))
                if 100 * both >= percent * (len(set_p[a]) + len(set_q[b]) - both):
                    done.add((a, root_q[b]))
                    found.append((rep_p[a], rep_q[b]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    many = many.join(sets, "rep").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    part = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = many.select("*", part.alias("i"), each.alias("j")).withColumn("left", F.lit(True))
    right = many.select("*", each.alias("i"), part.alias("j")).withColumn("left", F.lit(False))
    return left.union(right).groupBy("bucket", "i", "j").applyInPandas(tile, "a long, b long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, as it came."""
    gone = near_duplicates(docs, size, percent).where("NOT kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
