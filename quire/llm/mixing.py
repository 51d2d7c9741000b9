"""Mixing sources to target weights by blocks.

1. Every source's documents, in a pseudo-random order, are one stream of
   words, packed into blocks of ``BLOCK`` words (the last may be short).
2. A source's target fixes how many slots it gets; each slot draws its output
   shard, so a source's counts over the shards are one multinomial draw, and
   the sources' shares of a shard vary around the target weights.  A shard gets
   as many consecutive indices of the source as drew it.
3. Index ``j`` of a source with ``K`` blocks is in pass ``j div K``.  It takes
   the block that the pass's own pseudo-random permutation (swap-or-not
   shuffle: exact on any ``K``, computed per index) gives for ``j mod K``.
4. Blocks and slots meet in a join on (source, block index).

Each full pass takes every block once, so a source's words are within one
block of its target, and no word is taken more often than the target's cap.
All randomness is MD5 of stable values: reruns agree.

Sources are ordered by code point, null last, and weigh 5, 2, 1, 5, ... of the
total of all sizes.  A target stops at ``CAP`` times its source's size; the
excess goes to the other sources by weight, until none is above.

Nulls: a null text has no words, a null source is a source of its own, null
ids sort first.  Documents without words are never drawn (``taken`` 0).
Repeated rows are separate rows of the stream; equal rows are interchangeable.
An empty table gives an empty result.  Only the named columns are read; ``mixture``
carries all along and refuses one with the name of a column it writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import once, refuse_clash, stored, words

BLOCK = 64
SHARDS = 16
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
ROUNDS = 12
#: Stream groups a source: a source's words are summed per group before documents are placed.
GROUPS = 4096
#: Slots that one generated row stands for before it is unfolded.
SLOT_RUN = 1024
SEED = "mix"


def _digest(parts: list[Column], hex_digits: int = 13) -> Column:
    """A number in [0, 16**hex_digits) from the MD5 of the parts."""
    text = F.concat_ws("/", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, hex_digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size): one row a source.

    Water filling in closed form: sources with the least ``size / weight`` hit
    their cap first, so one ordered pass finds the level at which all others
    share the rest by weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", pick).withColumn("full", (F.col("source_size") * cap).cast("double"))
    every = W.partitionBy(F.lit(1))
    filling = W.partitionBy(F.lit(1)).orderBy(F.col("full") / F.col("weight"), "rank")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    level = weighed.select(
        "*", F.sum("source_size").over(every).alias("total"), F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum("full").over(before), F.lit(0.0)).alias("full_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"))
    # the share of the rest, were all earlier sources full and this one not
    rest = (F.col("total") - F.col("full_before")) / (F.col("weights") - F.col("weight_before"))
    first = F.min(F.when(rest <= F.col("full") / F.col("weight"), F.struct(
        (F.col("full") / F.col("weight")).alias("at"), F.col("rank"), rest.alias("rest")))).over(every)
    found = level.withColumn("rest", first["rest"])
    return found.select("source", "source_size", "rank",
                        F.least(F.col("full"), F.coalesce(F.col("weight") * F.col("rest"), F.col("full")))
                        .alias("target"))


def place(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          keep: list[str] | None = None, groups: int = GROUPS, seed: str = SEED) -> DataFrame:
    """Documents with their word count and first word in the source's stream."""
    size = F.size(words(F.col(text_col))).cast("long")
    order = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
                  .cast("binary"))
    kept = [F.col(c) for c in keep or []]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                       order.alias("place"), *kept)
    width = F.lit(groups)
    band = (F.conv(F.substring("place", 1, 6), 16, 10).cast("long") % width).cast("int")
    # the texts are read once: all that follows works on sizes
    rows = stored(rows.withColumn("band", band), "sizes")
    sums = rows.groupBy("source", "band").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("source").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("of_source"), F.col("band").alias("of_band"),
                         F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("band_start"))
    within = (W.partitionBy("source", "band").orderBy("place", F.col("doc_id").asc_nulls_first(), "size")
              .rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("in_band", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = rows.join(starts, rows["source"].eqNullSafe(starts["of_source"]) & (rows["band"] == starts["of_band"]))
    return joined.select("doc_id", "source", "size", (F.col("band_start") + F.col("in_band")).alias("first"),
                         *(keep or []))


def _round_keys(passes: Column, key: list[Column], rounds: int) -> Column:
    """The shuffle's offset numbers, per pass and round."""
    return F.transform(F.sequence(F.lit(0).cast("long"), passes - 1), lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: _digest([*key, p, r, F.lit("k")])))


def permuted(index: Column, n: Column, offsets: Column, key: list[Column]) -> Column:
    """Swap-or-not shuffle: a permutation of [0, n) picked by key and offsets, at ``index``."""
    def step(state: Column, offset: Column) -> Column:
        x, r = state["x"], state["r"]
        mirror = (offset % n + n - x) % n
        text = F.concat_ws("/", *[p.cast("string") for p in [*key, r, F.greatest(x, mirror)]])
        # half of the hex digits have an odd code
        swap = F.ascii(F.md5(text.cast("binary"))) % 2 == 1
        return F.struct(F.when(swap, mirror).otherwise(x).alias("x"), (r + 1).alias("r"))

    start = F.struct(index.cast("long").alias("x"), F.lit(0).alias("r"))
    return F.aggregate(offsets, start, step, lambda s: s["x"])


def _slots(shares: DataFrame, block: int) -> DataFrame:
    """(rank, n, slots): blocks and slots of every source that has any."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots = F.round(F.col("target") * blocks / F.col("source_size")).cast("long")
    return (shares.where("source_size > 0 and target > 0").select("rank", blocks.alias("n"), slots.alias("slots"))
            .where("slots > 0"))


def shard_counts(shares: DataFrame, *, block: int = BLOCK, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(rank, n, slots, shard, first, count): the multinomial draw.

    Each slot of a source draws one output shard; ``count`` says how many drew
    this one, and the shard gets that many indices from ``first`` on.
    """
    runs = _slots(shares, block).select("*", F.explode(F.expr(f"sequence(0L, (slots - 1) div {SLOT_RUN})")).alias("run"))
    each = _spread(runs, shares).select("rank", "n", "slots", F.explode(F.sequence(
        F.col("run") * SLOT_RUN, F.least((F.col("run") + 1) * SLOT_RUN, F.col("slots")) - 1)).alias("slot"))
    shard = (_digest([F.lit(seed), F.col("rank"), F.col("slot"), F.lit("shard")]) % shards).cast("int")
    counts = each.groupBy("rank", "n", "slots", shard.alias("shard")).agg(F.count("*").alias("count"))
    earlier = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("count").over(earlier), F.lit(0)))


def _spread(runs: DataFrame, shares: DataFrame) -> DataFrame:
    """Tiny rows that stand for much work, in a set number of tasks, which are not merged by size."""
    tasks = int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(tasks, *[c for c in ("rank", "shard", "run") if c in runs.columns])


def draw(shares: DataFrame, *, block: int = BLOCK, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(rank, shard, pass, block): what every shard takes of every source, by the drawn counts."""
    counts = shard_counts(shares, block=block, shards=shards, seed=seed)
    keys = _round_keys(F.expr("(slots - 1) div n + 1"), [F.lit(seed), F.col("rank")], ROUNDS)
    runs = counts.select("rank", "n", "shard", "first", "count", keys.alias("keys"), F.explode(
        F.expr(f"sequence(0L, (count - 1) div {SLOT_RUN})")).alias("run"))
    each = _spread(runs, shares).select("rank", "n", "shard", "keys", F.explode(F.sequence(
        F.col("first") + F.col("run") * SLOT_RUN,
        F.col("first") + F.least((F.col("run") + 1) * SLOT_RUN, F.col("count")) - 1)).alias("index"))
    numbered = each.select("rank", "n", "shard", "keys", "index", F.expr("index div n").alias("pass"))
    return numbered.select("rank", "shard", "pass", permuted(
        F.col("index") - F.col("pass") * F.col("n"), F.col("n"), F.get("keys", F.col("pass").cast("int")),
        [F.lit(seed), F.col("rank"), F.col("pass")]).alias("block"))


def pieces(placed: DataFrame, shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each (document, block) that overlap, with the words they share."""
    ranked = _with_share(placed, shares)
    cut = ranked.where("size > 0").select("*", F.explode(F.expr(
        f"sequence(first div {block}, (first + size - 1) div {block})")).alias("block"))
    start = F.greatest(F.col("first"), F.col("block") * block)
    stop = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("*", (start - F.col("first")).alias("at"), (stop - start).alias("n_words"))


def _with_share(placed: DataFrame, shares: DataFrame) -> DataFrame:
    own = shares.select(F.col("source").alias("of_source"), "rank", "source_size", "target")
    return placed.join(own, placed["source"].eqNullSafe(own["of_source"])).drop("of_source")


def source_sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("source").agg(F.sum("size").alias("source_size"))


def taken_words(docs: DataFrame, *, block: int = BLOCK, shards: int = SHARDS, weights=WEIGHTS, cap: int = CAP,
                seed: str = SEED, **cols) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    placed = stored(place(docs, seed=seed, **cols), "placed")
    shares = targets(source_sizes(placed), weights, cap)
    times = draw(shares, block=block, shards=shards, seed=seed).groupBy("rank", "block").agg(
        F.count("*").alias("times"))
    # rows are told apart by their place in the stream, not by an id that may repeat
    # as many rows as blocks, which the planner cannot foresee: never a broadcast
    hit = pieces(placed, shares, block).join(times.hint("merge"), ["rank", "block"]).groupBy(
        "rank", "first").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    ranked = _with_share(placed, shares)
    return ranked.join(
        hit.select(F.col("rank").alias("__r"), F.col("first").alias("__f"), "taken"),
        (F.col("rank") == F.col("__r")) & (F.col("first") == F.col("__f")) & (F.col("size") > 0), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixture(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
            block: int = BLOCK, shards: int = SHARDS, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every drawn piece of a document as a row.

    Columns: the input's, with the text cut to the piece (white space after
    its words stays), and ``mix_shard``, ``mix_pass``, ``mix_block``.
    """
    refuse_clash(docs.columns, ["mix_shard", "mix_pass", "mix_block"])
    # equal rows have one identity: whose draw it is does not matter, the pieces are the same
    same = [F.xxhash64(*docs.columns).alias("__i1"), F.xxhash64(F.lit(seed), *docs.columns).alias("__i2")]
    placed = stored(place(docs.select("*", *same), id_col=id_col, text_col=text_col, source_col=source_col,
                          keep=["__i1", "__i2"], seed=seed), "placed")
    shares = targets(source_sizes(placed), weights, cap)
    drawn = draw(shares, block=block, shards=shards, seed=seed)
    hit = pieces(placed, shares, block).join(drawn.hint("merge"), ["rank", "block"])
    cuts = hit.groupBy("__i1", "__i2", "rank", "first").agg(
        F.collect_list(F.struct("shard", "pass", "block", "at", "n_words")).alias("__cuts"))
    rows = docs.select(*same, F.struct(*[F.col(c) for c in docs.columns]).alias("__row"))
    texts = rows.groupBy("__i1", "__i2").agg(F.first("__row").alias("__row"))
    both = cuts.select("__i1", "__i2", "__cuts").join(texts, ["__i1", "__i2"])
    spaced = F.regexp_extract_all(F.col(f"__row.{text_col}"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = once(both, ["__row", "__cuts"], __words=spaced)
    texts_of = F.transform("__cuts", lambda c: F.struct(c.alias("c"), F.array_join(
        F.slice("__words", (c["at"] + 1).cast("int"), c["n_words"].cast("int")), "").alias("text")))
    each = cut.select("__row", F.explode(texts_of).alias("__p"))
    return each.select(*[F.col("__p.text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c)
                         for c in docs.columns],
                       F.col("__p.c.shard").alias("mix_shard"), F.col("__p.c.pass").alias("mix_pass"),
                       F.col("__p.c.block").alias("mix_block"))
