"""Joins of a large frame to a lookup table.

A lookup is broadcast only if a bound on its bytes is known to be under
``Settings.broadcast_bytes`` (and its rows under ``broadcast_rows``). The bound is rows times the width
of a row, in which a text counts as the longest text measured.

Otherwise the join is a shuffle. Keys that hold a large share of the facts are measured
when inputs are opened (``with_hot_keys``); the lookup rows of those keys alone are repeated, once
for each of ``Settings.salts`` buckets, and the facts that have them, or a null key, go to one bucket by a
hash of the fact. All other rows join on the plain key. Where nothing is known of
the keys every one is treated as hot. Either way the same rows come out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmesh.config import Settings

# Columns that tell one flight from the others.
IDENTITY = ("icao24", "dep_s", "arr_s")
# Arrays of lookups hold at most the minutes of one day.
LONGEST_ARRAY = 1501


@dataclass(frozen=True)
class Lookup:
    """A table and upper bounds on its row count and on the bytes of its longest text, None if unknown.

    ``null_safe`` lets null keys meet. Where the table comes from the facts
    themselves this changes nothing but the plan: an ordinary equality makes
    Spark filter one side to non-null keys, and the two sides could then not
    read the same shuffle.

    ``hot`` are the keys of the facts that need several tasks each; None if not measured.
    """

    df: DataFrame
    rows: int | None = None
    null_safe: bool = False
    text_bytes: int = 64
    hot: tuple | None = None

    @classmethod
    def measured(cls, df: DataFrame) -> Lookup:
        """Count the table and its longest text once. This runs a job; do it when inputs are opened."""
        texts = [F.max(F.octet_length(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        size = df.agg(F.count("*"), F.coalesce(F.greatest(F.lit(0), F.lit(0), *texts), F.lit(0))).first()
        return cls(df, size[0], text_bytes=size[1])

    def derive(self, df: DataFrame, factor: int = 1) -> Lookup:
        """A table made from this one that has at most ``factor`` rows per row of it."""
        return Lookup(df, None if self.rows is None else self.rows * factor, text_bytes=self.text_bytes)

    def fits(self, settings: Settings) -> bool:
        """Is the table known to be small enough to broadcast?"""
        if self.rows is None or self.rows > settings.broadcast_rows:
            return False
        return self.rows * row_bytes(self.df.schema, self.text_bytes) <= settings.broadcast_bytes

    def with_hot_keys(self, facts: DataFrame, key: str, settings: Settings) -> Lookup:
        """The lookup with the keys that hold more than a share of 1 / (4 x salts) of the facts.

        Fewer than 4 x salts keys can, whatever the facts are. A table that is broadcast needs none.
        Counts are combined in the map tasks, so what is shuffled is one row for each key and task.
        """
        if self.fits(settings):
            return self
        counts = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        top = counts.orderBy(F.desc("n")).limit(4 * settings.salts)  # no more can pass the next line
        total = counts.agg(F.sum("n").alias("total"))
        found = top.join(F.broadcast(total), F.col("n") * (4 * settings.salts) > F.col("total")).select(key)
        return replace(self, hot=tuple(sorted(r[0] for r in found.collect())))


def row_bytes(kind: T.DataType, text_bytes: int) -> int:
    """Upper bound on the bytes of a value in a row format of eight-byte words, with the longest text given."""
    if isinstance(kind, T.StructType):
        return 8 + 8 * len(kind.fields) + sum(row_bytes(f.dataType, text_bytes) for f in kind.fields)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 8 + text_bytes
    if isinstance(kind, T.ArrayType):
        return 16 + LONGEST_ARRAY * (8 + row_bytes(kind.elementType, text_bytes))
    return 8


def per_day(df: DataFrame, settings: Settings, rows_per_day: int = 1) -> Lookup:
    """A table with at most ``rows_per_day`` rows for each arrival day."""
    days = settings.day_bound
    return Lookup(df, None if days is None else days * rows_per_day, null_safe=True)


def attach(
    facts: DataFrame,
    lookup: Lookup,
    on: list[str],
    settings: Settings,
    how: str = "left",
    also: Column | None = None,
) -> DataFrame:
    """Join ``facts`` to ``lookup`` on equal ``on`` columns and, if given, a further condition.

    Apart from ``on`` the two sides must not share column names (a semi join may). ``how`` is left, inner or left_semi: the facts are never the side that is repeated.
    """
    keys = {c: f"_lookup_{c}" for c in on}
    side = lookup.df.withColumnsRenamed(keys)
    if lookup.fits(settings):
        side = F.broadcast(side)
    elif lookup.hot != ():
        # Few columns: Spark writes each condition on them anew for every alias they get on the way.
        rest = [c for c in IDENTITY if c in facts.columns and c not in on] or [c for c in facts.columns if c not in on][:3] or on
        bucket = F.pmod(F.xxhash64(*rest), F.lit(settings.salts)).cast("int")
        buckets = F.sequence(F.lit(0), F.lit(settings.salts - 1))
        if lookup.hot is not None:
            hot, one = F.col(on[0]).isin(list(lookup.hot)), F.lit(0)
            bucket = F.when(hot | F.col(on[0]).isNull(), bucket).otherwise(one)
            buckets = F.when(F.col(keys[on[0]]).isin(list(lookup.hot)), buckets).otherwise(F.array(one))
        facts = facts.withColumn("_bucket", bucket)
        side = side.withColumn("_lookup__bucket", F.explode(buckets))
        keys["_bucket"] = "_lookup__bucket"

    equal = [
        F.col(k).eqNullSafe(F.col(v)) if lookup.null_safe else F.col(k) == F.col(v)
        for k, v in keys.items()
    ]
    condition = reduce(and_, equal + ([] if also is None else [also]))
    return facts.join(side, condition, how).drop("_bucket", *keys.values())
