"""Redirect resolution by pointer doubling over the redirects that other redirects lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import ensure_checkpoint_dir

#: A target of more redirects is joined in ``SALTS`` places.
HOT_TARGET = 100_000
SALTS = 64


def _inner_ends(inner: DataFrame) -> DataFrame:
    """(archive, at, end, hops) of the redirects in ``inner(archive, at, end)``; end null: into a cycle.

    Each round joins every open pointer with the pointer at its end, so the
    distance covered doubles and a chain of n hops takes log2(n) rounds.  Among
    open pointers off any cycle one closes in every round; a round that closes
    none leaves only pointers into cycles.  Each round's table is checkpointed.
    """
    todo, done, left = inner.withColumn("hops", F.lit(1).cast("bigint")).checkpoint(), None, None
    while True:
        known = todo if done is None else todo.unionByName(done)
        ahead = known.select("archive", F.col("at").alias("end"), F.col("end").alias("_next"), F.col("hops").alias("_more"))
        step = (todo.join(ahead, ["archive", "end"], "left")
                .select("archive", "at", F.coalesce("_next", "end").alias("end"),
                        (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"),
                        F.col("_next").isNull().alias("_ends")).checkpoint())
        ended = step.filter("_ends").drop("_ends")
        done = ended if done is None else done.unionByName(ended)
        todo = step.filter("not _ends").drop("_ends")
        open_now = todo.count()
        if open_now == 0 or open_now == left:
            return done.unionByName(todo.withColumn("end", F.lit(None).cast("string")))
        left = open_now


def resolve_redirects(entries: DataFrame, only_redirects: bool = False) -> DataFrame:
    """(archive, path, final_path, hops, resolved): follow redirect chains of any length.

    Chains are followed once per distinct target, and only targets that are
    redirects themselves take part in the rounds (:func:`_inner_ends`).  A
    pointer into a cycle or to a path that does not exist ends unresolved.
    Redirects then meet their target's end; those of a target that very many
    share are dealt over ``SALTS`` places, so they never all lie in one task.
    """
    ensure_checkpoint_dir(entries.sparkSession)
    links = (entries.filter(F.col("is_redirect") & F.col("redirect_path").isNotNull())
             .select("archive", "path", F.col("redirect_path").alias("at")))
    # map-side aggregation: a target that all redirects share is one row a task
    targets = links.groupBy("archive", "at").agg(F.count(F.lit(1)).alias("_n"))
    pointers = links.select("archive", F.col("path").alias("_p"), F.col("at").alias("end"))
    # hints: entries compress well, and Spark would send what looks small on disk through the driver
    inner = targets.join(pointers.hint("merge"), (targets["archive"] == pointers["archive"]) & (targets["at"] == pointers["_p"])) \
        .select(targets["archive"], targets["at"], "end").checkpoint()
    chains = inner.withColumn("hops", F.lit(1).cast("bigint")) if inner.isEmpty() else _inner_ends(inner)
    ends = targets.join(chains.withColumn("_chain", F.lit(True)), ["archive", "at"], "left").select(
        "archive", "at", "_n", F.when(F.col("_chain"), F.col("end")).otherwise(F.col("at")).alias("final_path"),
        (F.coalesce("hops", F.lit(0)) + 1).cast("int").alias("hops"))
    there = (ends.select("archive", "final_path").distinct()
             .join(entries.select("archive", F.col("path").alias("final_path")).hint("merge"), ["archive", "final_path"], "left_semi")
             .withColumn("_ok", F.lit(True)))
    ends = (ends.join(there, ["archive", "final_path"], "left")
            .select("archive", "at", "_n", F.when(F.col("_ok"), F.col("final_path")).alias("final_path"), "hops",
                    F.coalesce("_ok", F.lit(False)).alias("resolved")))
    # there are at most (redirects / HOT_TARGET) of these
    hot = F.broadcast(targets.filter(F.col("_n") > HOT_TARGET).select("archive", "at", F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("_n") > HOT_TARGET, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    out = (links.join(hot, ["archive", "at"], "left").withColumn("_salt", salt)
           .join(ends.withColumn("_salt", F.explode(copies)), ["archive", "at", "_salt"])
           .select("archive", "path", "final_path", "hops", "resolved"))
    if only_redirects:
        return out
    own = entries.filter(~F.col("is_redirect") | F.col("redirect_path").isNull()).select(
        "archive", "path", F.col("path").alias("final_path"), F.lit(0).alias("hops"), F.lit(True).alias("resolved"))
    return own.unionByName(out)
