"""Prefix trie of conversations by digests of blocks of turns.

Turns become two 64-bit hashes of their place, role and text; hashes of a run
of turns are joined by exclusive or, so a prefix has one digest however it was
added up. Conversations are grouped by successive blocks of ``BLOCK``
turns: equal blocks after equal prefixes are one row with a count, made in the
map tasks first. A block without siblings is a chain of nodes that share that row's
members. Only where siblings differ are blocks taken apart and grouped turn by turn.

Every node is named by its smallest member. The nodes of one member are the lower
end of its conversation, so sums over subtrees add up along the conversations that
name nodes: the sum from a place to the end counts for the node at that place.

Skew: turns are numbered by a range partitioning and conversations of any length are
added up in chunks, so a conversation with a third of all rows has no task of its own.
Copies of conversations, common first turns and the root are counts in map tasks. Lists of members are
joined from pieces that hold the ids of one range of 2**``RANGE_BITS`` numbers, and are hashed in a stream, piece by piece.
Parents with many children, at most ``HEAVY`` by their share of all nodes, are broadcast.

Defined cases: rows without conv_id belong to no conversation and are left out; null
turns come first; turns of one number are ordered by hash; repeated rows are
turns of their own; null roles and texts count as empty; an empty table has no node,
not even a root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripmesh.llm.common import read_table, saved

BLOCK = 4
CHUNK = 4096
RANGE_BITS = 12
HEAVY = 2000
SALTS = 16
FAMILY = 20  # conversations that share the head of the first of them
WORD = r"[^\x20\x09-\x0D]+"

KEY = ["p1", "p2"]
UP = ["u1", "u2"]
TURN = ["d1", "d2", "words"]


# --- turns ----------------------------------------------------------------------


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, d1, d2, words): the turns as hashes, numbered from 0 in each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("d1"),
        F.xxhash64(F.lit(2), role, text).alias("d2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    turns = turns.groupBy("conv_id", "turn", *TURN).agg(F.count("*").alias("times"))
    order = [F.asc_nulls_first("turn"), F.asc("d1"), F.asc("d2")]
    ranges = turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    ranges = saved(ranges, "turns")
    inside = F.sum("times").over(Window.partitionBy("conv_id", "part").orderBy(*order)) - F.col("times")
    totals = ranges.groupBy("conv_id", "part").agg(F.sum("times").alias("all"))
    earlier = F.sum("all").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("conv_id", "part", earlier.alias("earlier")).where("earlier > 0")
    placed = ranges.withColumn("inside", inside).join(totals, ["conv_id", "part"], "left")
    first = F.col("inside") + F.coalesce("earlier", F.lit(0))
    return placed.select("conv_id", F.explode(F.sequence(first, first + F.col("times") - 1)).alias("pos"), *TURN)


def branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths (conv_id, length) of conversations rebuilt on the head of the first of their family.

    A conversation c keeps its turns from number h = crc32(c) % 4 on, behind
    the first h turns of the conversation c - c % 20, as far as there are any.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    heads = turns.where((F.col("conv_id") == base) & (F.col("pos") < 3)).groupBy("conv_id")
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", *TURN))).alias("head")).withColumnRenamed("conv_id", "base")
    plan = lengths.withColumns({"h": h, "base": base}).join(heads, "base", "left")
    plan = plan.withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")))
    plan = saved(plan.withColumn("taken", F.size("head").cast("long")), "families")
    inherited = plan.select("conv_id", F.inline("head"))
    # The few conversations whose base is short or absent move up; their turns are found in salted pieces.
    salt = F.pmod(F.floor(F.col("pos") / CHUNK), F.lit(SALTS))
    moved = plan.where("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("up"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    kept = turns.where(F.col("pos") >= h).withColumn("salt", salt.cast("int")).join(moved, ["conv_id", "salt"], "left")
    kept = kept.select("conv_id", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("pos"), *TURN)
    return kept.union(inherited), plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


# --- running totals -----------------------------------------------------------------


def running(rows: DataFrame, at: str, totals: dict[str, Column], combine, last_first: bool = False) -> DataFrame:
    """Adds to each row of a conversation what ``combine`` makes of the rows before it (or, last first, behind it), itself left out.

    Rows are added up inside chunks of ``CHUNK`` places and the chunks of long conversations
    among themselves, so that no task holds a whole conversation.
    """
    chunk = F.floor(F.col(at) / CHUNK)
    order = F.desc if last_first else F.asc
    rows = rows.withColumn("chunk", chunk)
    near = Window.partitionBy("conv_id", "chunk").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy("conv_id").orderBy(order("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv_id", "chunk").agg(*[combine(c).alias(f"far_{name}") for name, c in totals.items()])
    chunks = chunks.select("conv_id", "chunk", *[combine(F.col(f"far_{n}")).over(far).alias(f"far_{n}") for n in totals])
    chunks = chunks.where(" OR ".join(f"far_{n} IS NOT NULL" for n in totals))
    out = rows.withColumns({f"near_{n}": combine(c).over(near) for n, c in totals.items()})
    out = out.join(chunks, ["conv_id", "chunk"], "left")
    zero = F.lit(0).cast("long")
    both = {n: [F.coalesce(f"{side}_{n}", zero) for side in ("near", "far")] for n in totals}
    joined = {n: (a.bitwiseXOR(b) if combine is F.bit_xor else a + b) for n, (a, b) in both.items()}
    return out.withColumns(joined).drop("chunk", *[f"{side}_{n}" for n in totals for side in ("near", "far")])


# --- trie -----------------------------------------------------------------------


def blocks_of(turns: DataFrame, size: int) -> DataFrame:
    """(conv_id, block, z1, z2, turns, u1, u2): blocks with their digests, and the digest of all before them."""
    z = [F.xxhash64(F.lit(k), "pos", "d1", "d2") for k in (3, 4)]
    hashed = turns.select("conv_id", "pos", z[0].alias("z1"), z[1].alias("z2"), "words")
    made = hashed.groupBy("conv_id", F.floor(F.col("pos") / size).alias("block")).agg(
        F.bit_xor("z1").alias("z1"),
        F.bit_xor("z2").alias("z2"),
        F.sort_array(F.collect_list(F.struct("pos", "z1", "z2", "words"))).alias("turns"),
    )
    return running(made, "block", {"u1": F.col("z1"), "u2": F.col("z2")}, F.bit_xor)


def steps(blocks: DataFrame, *keep: str) -> DataFrame:
    """One row for each turn of the blocks: its prefix (p1, p2), the prefix above it (u1, u2), depth and words."""

    def digest(above: str, field: str, n: Column) -> Column:
        return F.aggregate(F.slice("turns", F.lit(1), n), F.col(above), lambda a, t: a.bitwiseXOR(t[field]))

    def step(t: Column, k: Column) -> Column:
        return F.struct(
            (t["pos"] + 1).alias("depth"),
            t["words"].alias("words"),
            digest("u1", "z1", k + 1).alias("p1"),
            digest("u2", "z2", k + 1).alias("p2"),
            digest("u1", "z1", k).alias("q1"),
            digest("u2", "z2", k).alias("q2"),
        )

    each = blocks.select(*keep, F.explode(F.transform("turns", step)).alias("s"))
    return each.select(*keep, "s.depth", "s.words", "s.p1", "s.p2", F.col("s.q1").alias("u1"), F.col("s.q2").alias("u2"))


def nodes_of(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """(p1, p2, u1, u2, depth, words, n_convs, conv_id) of every node; the root has no prefix above it."""
    alike = blocks.groupBy(*UP, "block", "z1", "z2").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")
    )
    alike = saved(alike, "blocks")
    alone = alike.groupBy(*UP, "block").agg(F.count("*").alias("n"), F.min("z1").alias("z1"), F.min("z2").alias("z2"))
    alone = alone.where("n = 1").select(*UP, "block", "z1", "z2", F.lit(True).alias("alone"))
    alike = alike.join(alone, [*UP, "block", "z1", "z2"], "left")
    keep = ["n_convs", "conv_id"]
    chains = steps(alike.where("alone"), *keep)
    forks = steps(alike.where("alone IS NULL"), *keep).groupBy(*KEY, *UP, "depth").agg(
        F.first("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    columns = [*KEY, *UP, "depth", "words", "n_convs", "conv_id"]
    none = F.lit(None).cast("long")
    top = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    top = top.select(zero.alias("p1"), zero.alias("p2"), none.alias("u1"), none.alias("u2"), zero.alias("depth"), zero.alias("words"), *keep)
    return chains.select(columns).union(forks.select(columns)).union(top)


def named_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with n_children (null: none) and parent_conv_id."""
    counts = nodes.where("u1 IS NOT NULL").groupBy(*UP).agg(F.count("*").alias("n_children"))
    counted = saved(nodes.join(counts.withColumnsRenamed({"u1": "p1", "u2": "p2"}), KEY, "left"), "nodes")
    total = counted.count()
    parents = counted.where("n_children > 0").select(
        F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") * HEAVY > total).alias("heavy")
    )
    heavy = F.broadcast(parents.where("heavy").drop("heavy"))  # fewer than HEAVY rows
    near = counted.join(heavy, UP, "left")
    light = near.where("parent_conv_id IS NULL").drop("parent_conv_id").join(parents.where("NOT heavy").drop("heavy"), UP, "left")
    return near.where("parent_conv_id IS NOT NULL").unionByName(light)


def subtree_sums(nodes: DataFrame, blocks: DataFrame, ends: DataFrame) -> DataFrame:
    """(p1, p2, n_leaves, saved_tokens) of every node."""
    own = nodes.select(*KEY, "conv_id", F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    naming = ends.join(own, [*KEY, "conv_id"], "left_semi").select("conv_id")
    path = steps(blocks.join(naming, "conv_id", "left_semi"), "conv_id").select("conv_id", "depth", *KEY)
    path = path.union(naming.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", *KEY)]))
    path = path.join(own, [*KEY, "conv_id"], "left").fillna(0, ["leaf", "saved"])
    path = running(path, "depth", {"leaf_below": F.col("leaf"), "saved_below": F.col("saved")}, F.sum, last_first=True)
    return path.groupBy(*KEY).agg(F.sum(F.col("leaf") + F.col("leaf_below")).alias("n_leaves"), F.sum(F.col("saved") + F.col("saved_below")).alias("saved_tokens"))


def prefix_trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie of turns (conv_id, pos, d1, d2, words) of conversations (conv_id, length).

    Nodes: p1, p2, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. Ends: p1, p2
    and conv_id of the conversations that end there. The text of a node is turn depth - 1 of conversation conv_id.
    """
    blocks = saved(blocks_of(turns, block), "conversations")
    nodes = named_parents(nodes_of(blocks, lengths))
    zero = F.lit(0).cast("long")
    last = blocks.groupBy("conv_id").agg(F.bit_xor("z1").alias("p1"), F.bit_xor("z2").alias("p2"))
    ends = saved(last.select("conv_id", *KEY).union(lengths.where("length = 0").select("conv_id", zero, zero)), "ends")
    nodes = nodes.join(subtree_sums(nodes, blocks, ends), KEY).select(
        *KEY, "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens"
    )
    return nodes, ends


def member_hashes(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256): hash of the ids that end at a node, ascending and joined by commas."""
    pieces = ends.groupBy(*KEY, F.shiftright("conv_id", RANGE_BITS).alias("range"))
    pieces = pieces.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "range")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for p1, p2, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (p1, p2) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (p1, p2), hashlib.sha256()
                state.update(ids.encode())
            yield _rows(done)
            done = []
        if key:
            yield _rows([(*key, state.hexdigest())])

    return ordered.select(*KEY, "ids").mapInArrow(hashes, "p1 long, p2 long, ends_sha256 string")


def _rows(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, h = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(h, pa.string())], names=["p1", "p2", "ends_sha256"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lengths = branched(saved(numbered(read_table(spark, sf_dir, "conversations")), "numbered"))
    nodes, ends = prefix_trie(turns, lengths)
    out = nodes.join(member_hashes(ends), KEY, "left").drop(*KEY)
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


SQL = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), counted AS (
  SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id
), checked AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS base, CAST(conv_id AS VARCHAR) AS s FROM counted
), summed AS (
  SELECT conv_id, n, base, xor(4294967295, list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, CAST(i AS INTEGER), 1)) AS BIGINT))),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(k AS BIGINT) for k in range(8)]),
                                    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END))) % 4 AS h
  FROM checked
), families AS (
  SELECT f.conv_id, f.h, f.base, least(f.h, coalesce(b.n, 0)) AS taken, least(f.h, coalesce(b.n, 0)) + greatest(f.n - f.h, 0) AS length
  FROM summed f LEFT JOIN counted b ON b.conv_id = f.base
), rebuilt AS (
  SELECT f.conv_id, o.pos, o.role, o.text FROM families f JOIN own o ON o.conv_id = f.base AND o.pos < f.h
  UNION ALL
  SELECT f.conv_id, o.pos - f.h + f.taken, o.role, o.text FROM families f JOIN own o ON o.conv_id = f.conv_id AND o.pos >= f.h
), prefixes AS (
  SELECT conv_id, pos + 1 AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM families
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM prefixes GROUP BY prefix, depth
), children AS (
  SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), ends AS (
  SELECT prefix, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS h
  FROM prefixes JOIN families USING (conv_id) WHERE depth = length GROUP BY prefix
), above AS (
  SELECT prefix, unnest(range(0, depth + 1)) AS d, saved FROM nodes
), sums AS (
  SELECT a.prefix[1:a.d] AS prefix, sum(a.saved) AS saved, count_if(c.n IS NULL) AS leaves
  FROM above a LEFT JOIN children c ON c.prefix = a.prefix GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.prefix = n.prefix
LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
LEFT JOIN children c ON c.prefix = n.prefix
LEFT JOIN ends e ON e.prefix = n.prefix
"""
