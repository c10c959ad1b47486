"""Shards of equal size that keep linked documents together: balanced label propagation.

Documents with equal texts are linked. They start in shard (row number modulo
shards), so counts are at most one apart, and then move in rounds. A document
wants the shard where most of its group is, if that is more than where it is now.
From the wishes per pair of shards come quotas: as many documents may go from s
to t as come back, and what room t has beyond that is shared out among those who
wish to come. Only the 24 x 24 sums reach the driver. Documents of one group in
one shard have the same neighbours, so rounds work on (group, shard, count) rows
and only the last step names documents; a group larger than a shard takes
several whole. Every move brings a document to more of its group, so the rounds
end. Documents without links fill the shards up to their exact counts.

The law is ``rows``: counts of shards are at most one apart. Only DataFrame
functions are used. Numbers within a shard or group come from counts per stored
partition, so no task ever sorts a whole shard or group.

Defined cases: null texts have size 8, crc 0 and no links; empty texts are linked
with each other; repeated rows are documents of their own; null ids are kept; with
fewer rows than shards some shards are empty; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripmesh.llm.common import ROW, read_table, saved

SHARDS = 24
OVERHEAD = 8
BUCKETS = 64
GROUP = ["group_a", "group_b"]


def assign_shards(docs: DataFrame, shards: int = SHARDS, carry: list[str] | None = None) -> DataFrame:
    """The carried columns in ``common.ROW``, with size, text_crc32, shard and slot."""
    rows = described(docs, docs.columns if carry is None else carry)
    total = rows.count()
    capacity = np.array([total // shards + (s < total % shards) for s in range(shards)])
    linked, single = split_by_links(rows, shards)
    fragments = propagate(saved(linked.groupBy(*GROUP, "shard").agg(F.count("*").alias("n")), "fragments"), capacity)
    placed = place_linked(linked.drop("shard"), fragments)
    taken = loads(fragments, shards)
    ends = np.cumsum(capacity - taken).tolist()
    filled = numbered(single, [], "nth")
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("nth")))
    done = saved(placed.unionByName(filled.select("row_id", shard.alias("shard"))), "placed")
    return numbered(rows.join(done, "row_id"), ["shard"], "slot").select(ROW, "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def described(docs: DataFrame, carry: list[str]) -> DataFrame:
    """What the steps need of each document, stored with a row id that says where it is stored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias(ROW),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("group_a"),
        F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(7), "text")).alias("group_b"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    return saved(rows, "described")


def split_by_links(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(row_id, group, shard) of documents with links, and the row ids of those without."""
    start = numbered(rows.select("row_id", *GROUP), [], "nth")
    sizes = rows.where("group_a IS NOT NULL").groupBy(*GROUP).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    marked = start.join(sizes.withColumn("linked", F.lit(True)), GROUP, "left")
    marked = saved(marked.select("row_id", *GROUP, "linked", (F.col("nth") % shards).cast("int").alias("shard")), "start")
    return marked.where("linked").drop("linked"), marked.where("linked IS NULL").select("row_id")


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 for each value of the keys, in the order of row_id.

    The upper bits of row_id are the partition it was made in. Rows of one key
    and partition are numbered together, after those of earlier partitions.
    """
    rows = rows.withColumn("part", F.shiftright("row_id", 33))
    counts = rows.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy(*keys, "part").orderBy("row_id")
    ranked = rows.withColumn("nth_here", F.row_number().over(within) - 1)
    out = ranked.join(counts, [*keys, "part"])
    return out.withColumn(name, (F.col("before") + F.col("nth_here")).cast("long")).drop("part", "before", "nth_here")


def loads(fragments: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards, np.int64)
    for r in fragments.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        out[r.shard] = r.n
    return out


def propagate(fragments: DataFrame, capacity: np.ndarray) -> DataFrame:
    """Rounds of moves until none is left. ``fragments``: (group, shard, n)."""
    shards = len(capacity)
    while True:
        room = capacity - loads(fragments, shards)
        wanted = saved(wishes(fragments, room), "wishes")
        sums = np.zeros((shards, shards), np.int64)
        for r in wanted.where("target IS NOT NULL").groupBy("shard", "target").agg(F.sum("n").alias("n")).collect():
            sums[r.shard, r.target] = r.n
        quota = quotas(sums, room)
        if not quota.any():
            return fragments
        fragments = saved(moved(wanted, sums, quota), "fragments")


def wishes(fragments: DataFrame, room: np.ndarray) -> DataFrame:
    """Each fragment with the shard it wants to move to: the best one with room, else the best for an exchange."""
    weight = F.struct("n", F.xxhash64(*GROUP, "shard").alias("tie"), "shard")
    open_ = F.col("shard").isin([int(s) for s in np.flatnonzero(room > 0)])
    best = fragments.groupBy(*GROUP).agg(F.max(F.when(open_, weight)).alias("roomy"), F.max(weight).alias("best"))
    joined = fragments.join(best, GROUP).withColumn("own", weight)
    target = F.when(F.col("roomy") > F.col("own"), F.col("roomy.shard")).when(F.col("best") > F.col("own"), F.col("best.shard"))
    return joined.select(*GROUP, "shard", "n", target.alias("target"))


def quotas(sums: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many may go from shard to shard: exchanges, and a fair part of the room beyond."""
    swaps = np.minimum(sums, sums.T)
    rest = sums - swaps
    asked = np.maximum(rest.sum(axis=0), 1)
    share = np.minimum(rest, rest * np.maximum(room, 0) // asked)
    left = np.minimum(np.maximum(room, 0) - share.sum(axis=0), rest.sum(axis=0) - share.sum(axis=0))
    for t in np.flatnonzero(left > 0):  # what rounding left over
        for s in np.argsort(share[:, t] - rest[:, t], kind="stable"):
            more = min(left[t], rest[s, t] - share[s, t])
            share[s, t] += more
            left[t] -= more
    return swaps + share


def moved(wanted: DataFrame, sums: np.ndarray, quota: np.ndarray) -> DataFrame:
    """Fragments after the moves; where a quota is short, small ones first, by running sums in hashed buckets."""
    spark = wanted.sparkSession
    pairs = [(int(s), int(t), int(quota[s, t]), bool(quota[s, t] < sums[s, t])) for s, t in np.argwhere(sums > 0)]
    limits = spark.createDataFrame(pairs, "shard int, target int, quota long, short boolean")
    asked = wanted.join(F.broadcast(limits), ["shard", "target"], "left")
    short = asked.where("short").withColumn(
        "bucket", F.floor(F.log2("n")) * BUCKETS + F.pmod(F.xxhash64(*GROUP), F.lit(BUCKETS))
    )
    pair = ["shard", "target"]
    earlier = Window.partitionBy(*pair).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = short.groupBy(*pair, "bucket").agg(F.sum("n").alias("in_bucket"))
    before = before.select(*pair, "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy(*pair, "bucket").orderBy(*GROUP).rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("here", F.coalesce(F.sum("n").over(here), F.lit(0))).join(before, [*pair, "bucket"])
    free = F.col("quota") - F.col("before") - F.col("here")
    go = F.greatest(F.lit(0), F.least(F.col("n"), free))
    columns = [*GROUP, "shard", "n", "target"]
    going = short.select(*columns, go.alias("go")).union(asked.where("NOT short").select(*columns, F.col("n").alias("go")))
    staying = asked.where("short IS NULL").select(*columns, F.lit(0).cast("long").alias("go"))
    every = going.union(staying)
    after = F.explode(F.array(F.struct("shard", (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("target").alias("shard"), F.col("go").alias("n"))))
    every = every.select(*GROUP, after.alias("e")).where("e.n > 0")
    return every.groupBy(*GROUP, "e.shard").agg(F.sum("e.n").alias("n"))


def place_linked(linked: DataFrame, fragments: DataFrame) -> DataFrame:
    """(row_id, shard): the first n rows of a group go to its first shard, and so on."""
    plan = fragments.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("plan"))
    joined = saved(linked.join(plan, GROUP), "linked")
    whole = joined.where(F.size("plan") == 1).select("row_id", F.col("plan")[0]["shard"].alias("shard"))
    cut = numbered(joined.where(F.size("plan") > 1), GROUP, "nth")
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(-1).alias("shard"))
    pick = F.aggregate(
        "plan",
        zero,
        lambda a, p: F.struct(
            (a["end"] + p["n"]).alias("end"),
            F.when((a["end"] <= F.col("nth")) & (F.col("nth") < a["end"] + p["n"]), p["shard"]).otherwise(a["shard"]).alias("shard"),
        ),
    )
    return whole.union(cut.select("row_id", pick["shard"].alias("shard")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return placed.select(
        f"{ROW}.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
