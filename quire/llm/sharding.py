"""Weighted rendezvous (highest random weight) sharding of stable record keys.

Every (key, shard) pair has a pseudo-random number u in (0, 1) from an MD5
digest.  A record goes to the shard with the smallest ``-ln(u) / weight``:
each shard gets its weight's share, and a new shard only takes the records for
which its own number is the smallest, so none move between older shards.

The key is the record id alone, so reruns and other texts do not move a
record.  A null id is a key of its own.  Rows that share an id share a shard.
An empty table gives an empty result.  An input column with the name of an added
one is refused with an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import refuse_clash

#: Slot groups a shard: rows are counted per group, then numbered within it.
SLOT_GROUPS = 4096
_DIGITS = 13  # hex digits of the digest that make the number (52 bits)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard (from 0) of a key among ``len(weights)`` shards."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def cost(shard: int, weight: float) -> Column:
        digest = F.md5(F.concat(text, F.lit(f"/{shard}")).cast("binary"))
        number = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")
        return -F.log((number + 0.5) / float(16 ** _DIGITS)) / float(weight)

    costs = [F.struct(cost(i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*costs) if len(costs) > 1 else costs[0]).getField("shard")


def assign_shards(df: DataFrame, weights: Sequence[float], *, key_col: str = "doc_id",
                  shard_col: str = "shard") -> DataFrame:
    """``df`` with the shard of every row."""
    refuse_clash(df.columns, [shard_col])
    return df.withColumn(shard_col, shard_of(F.col(key_col), weights))


def number_slots(df: DataFrame, *, shard_col: str = "shard", order_cols: Sequence[str] = ("doc_id",),
                 slot_col: str = "slot", groups: int = SLOT_GROUPS) -> DataFrame:
    """``df`` with a gapless number from 0 within each shard.

    A shard may hold any share of all rows, so it is not numbered as one
    window: rows fall into hashed groups, the group sizes (at most ``groups``
    a shard) give each group's first number, and rows are numbered within
    their group in the order of ``order_cols``.
    """
    refuse_clash(df.columns, [slot_col])
    group = F.pmod(F.xxhash64(*order_cols), F.lit(groups)).alias("__group")
    rows = df.select("*", group)
    sizes = rows.groupBy(shard_col, "__group").agg(F.count("*").alias("__rows"))
    before = W.partitionBy(shard_col).orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard_col).alias("__shard"), F.col("__group").alias("__of"),
                          F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    within = W.partitionBy(shard_col, "__group").orderBy(*[F.col(c).asc_nulls_first() for c in order_cols])
    numbered = rows.withColumn("__at", F.row_number().over(within) - 1)
    joined = numbered.join(starts, (numbered[shard_col].eqNullSafe(starts["__shard"]))
                           & (numbered["__group"] == starts["__of"]))
    return joined.select(*df.columns, (F.col("__start") + F.col("__at")).cast("long").alias(slot_col))


def write_shards(df: DataFrame, path: str, weights: Sequence[float], *, key_col: str = "doc_id") -> None:
    """Write whole records as Parquet, one folder a shard (``shard=N``), several files each."""
    shards = assign_shards(df, weights, key_col=key_col, shard_col="shard")
    shards.write.partitionBy("shard").parquet(path)
