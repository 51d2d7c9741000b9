"""N-gram Jaccard join with rare-first prefix filtering.

A document's set is its distinct word n-grams; with fewer words, all of them
as one.  Two sets link when ``100 * |A and B| >= PERCENT * |A or B|``.

1. Equal sets form one class; only classes are compared.
2. All n-grams have one global order, rarest first: those whose hash falls in
   the lowest ``SAMPLED`` share come first, by the number of classes' rows
   that hold them, then the others by hash.  Any fixed order makes the prefix
   filter exact; this one needs counts for a quarter of the n-grams only.
   Linked sets of sizes n share an n-gram in their first
   ``n - ceil(PERCENT n / 100) + 1`` (prefix) n-grams.
3. Prefix n-grams that a single class holds cannot join and go early, and
   with them every class that has no other.
4. Classes meet on prefix n-grams.  A pair is a candidate if sizes are close
   enough (length filter), the places of the shared n-gram leave room for the
   needed overlap (positional filter), and the counts of n-grams in hashed
   partitions do too (suffix filter).  Each candidate pair is verified once,
   on whole sets.
5. Classes are first compared with one leader, then with the leaders of all
   groups that are still apart, and the links joined up each time.  So groups
   of near copies are not expanded into all pairs.
6. Before the second comparison and the last one, groups are made anew among
   the classes that meet another component: now all their n-grams are counted,
   a class's n-grams that no other component has come first, and a class with
   fewer shared n-grams than ``PERCENT`` of its size, which cannot link, goes,
   again and again.  Many texts that share a passage, but not enough, have no
   group left then.
7. What is left is compared across components, without loss: in groups of up
   to ``SMALL`` classes pair by pair, in larger ones by the differences from
   the group's leader.  Near copies share almost all, so what tells them apart
   is what each has more or less than the leader: two that link are joined up
   through the leader or share enough of those differences (``_differing``).

Sets without words link with nothing.  A null text has no words, a null id
never names a component unless all ids in it are null.  Repeated rows and
equal texts share a class.  An empty table gives an empty result.  Columns
besides id and text are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import words
from quire.llm.common import Scratch, free_driver, once, ship_package, stored
from quire.llm.components import components

N = 5
PERCENT = 80
#: Share of the hash range whose n-grams are counted and ordered by rarity.
SAMPLED = 0.25
#: Slices of the hashes whose n-grams are counted one after the other, each through a shuffle of its own.
SLICES = 2
#: Hashed partitions of the suffix filter.
PARTS = 128
#: Members of the groups whose pairs are compared plainly in the last comparison.
SMALL = 16

_U = np.uint64


def _sets(column: pa.Array, n: int):
    """For runs of rows: (sorted distinct hashes end to end, offsets a row)."""
    for _, data, off in words.chunks(column):
        data = words.LOWER[data]
        start, end, first = words.spans(data, off, words.NOT_SPACE)
        hashed = words.word_hashes(data, start, end)
        grams, at = words.ngram_hashes(hashed, first, n)
        row = words.rows_of(at, first)
        # fewer words: the whole sequence is the only one
        for size in range(1, n):
            rows = np.flatnonzero(np.diff(first) == size)
            if len(rows):
                whole = np.zeros(len(rows), dtype=_U)
                for j in range(size):
                    whole = whole * _U(words._STEP) + hashed[first[rows] + j]
                grams = np.concatenate([grams, words.mix(whole + _U(size))])
                row = np.concatenate([row, rows])
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        grams, row = grams[new], row[new]
        yield grams, np.searchsorted(row, np.arange(len(off)))


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _reduce(op, values: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1, dtype=_U)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        out[full] = op.reduceat(values, off[full])
    return out


def _map_sets(docs: DataFrame, keep: list[str], fields: str, make, n: int) -> DataFrame:
    """``keep`` columns and what ``make(hashes, offsets)`` gives for each row's set."""
    def run(batches):
        for batch in batches:
            row = 0
            for grams, off in _sets(batch.column("__text"), n):
                own = batch.slice(row, len(off) - 1)
                made = make(grams, off)
                yield pa.RecordBatch.from_arrays([own.column(c) for c in keep] + list(made.values()),
                                                 names=[*keep, *made])
                row += len(off) - 1

    schema = T.StructType(docs.select(*keep).schema.fields + T.StructType.fromDDL(fields).fields)
    ship_package(docs.sparkSession)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, type=pa.int32()), _signed(values))


def _describe(grams: np.ndarray, off: np.ndarray, percent: int, cut: int) -> dict:
    """Size, identity and the n-grams that count for the prefix: the sampled, at least a prefix."""
    n = np.diff(off)
    identity = words.mix(_reduce(np.add, words.mix(grams ^ _U(0xA5A5A5A5)), off) + n.astype(_U))
    other = _reduce(np.bitwise_xor, words.mix(grams + _U(0x5C5C5C5C)), off)
    row = np.repeat(np.arange(len(n)), n)
    low = grams < _U(cut)
    sampled = np.bincount(row[low], minlength=len(n))
    taken = np.maximum(sampled, np.where(n > 0, _prefix(n, percent), 0))
    place = np.arange(len(grams)) - off[:-1][row]
    kept = place < taken[row]
    return {"n": pa.array(n, type=pa.int64()), "class": _signed(identity), "twin": _signed(other),
            "sampled": pa.array(sampled, type=pa.int64()),
            "grams": _lists(grams[kept], np.concatenate([[0], np.cumsum(taken)]))}


def _whole(grams: np.ndarray, off: np.ndarray) -> dict:
    """Identity, whole set and its numbers of n-grams in the hashed partitions."""
    n = np.diff(off)
    identity = words.mix(_reduce(np.add, words.mix(grams ^ _U(0xA5A5A5A5)), off) + n.astype(_U))
    cells = np.repeat(np.arange(len(n)) * PARTS, n) + (grams % _U(PARTS)).astype(np.int64)
    parts = np.bincount(cells, minlength=len(n) * PARTS)
    edges = np.arange(len(n) + 1) * PARTS
    return {"class": _signed(identity), "grams": _lists(grams, off), "parts": pa.ListArray.from_arrays(
        pa.array(edges, type=pa.int32()), pa.array(parts, type=pa.int32()))}


class Jaccard:
    """The join over one table; see the module's text."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N,
                 percent: int = PERCENT, sampled: float = SAMPLED):
        if not 0 < sampled <= 0.5:
            raise ValueError("sampled must lie in (0, 0.5]: sampled hashes are to be positive longs")
        self.n, self.percent, self.cut = n, percent, min(int(sampled * 2 ** 64), 2 ** 63 - 1)
        self.docs = docs.select(F.col(id_col).alias("doc_id"), *_text_key(text_col), F.col(text_col).alias("text"))
        cut = self.cut
        describe = lambda grams, off: _describe(grams, off, percent, cut)
        self.scratch = Scratch(docs.sparkSession)
        self.rows = self.scratch.stored(_map_sets(
            self.docs, ["doc_id", "k1", "k2"], "n long, class long, twin long, sampled long, grams array<bigint>",
            describe, n), "sets")

    # -- candidates ------------------------------------------------------

    def prefixes(self, scratch: Scratch | None = None) -> DataFrame:
        """(gram, class, n, place, alone): prefix n-grams that two classes hold at least.

        ``alone`` counts the sampled n-grams that no other class holds.
        """
        scratch = scratch or Scratch(self.rows.sparkSession)
        rows = self.rows.where("n > 0")
        parts = [scratch.stored(self._shared(rows, i), f"shared-{i}") for i in range(SLICES)]
        shared = functools.reduce(DataFrame.unionByName, parts)
        # unsigned hash order puts the sampled n-grams at 0 .. cut
        later = ~((F.col("gram") >= 0) & (F.col("gram") < F.lit(self.cut)))
        ordered = shared.groupBy("class").agg(F.sort_array(F.collect_list(F.struct(
            later.alias("later"), F.when(~later, F.col("held")).alias("held"), "rank", "gram"))).alias("ordered"))
        one = rows.groupBy("class").agg(F.first("n").alias("n"), F.first("sampled").alias("sampled"))
        in_sample = F.size(F.filter("ordered", lambda x: ~x["later"]))
        least = F.floor((F.lit(self.percent) * F.col("n") + 99) / 100)
        # places before the shared ones: n-grams of this class alone, which are the rarest; counted
        # once a class, before its n-grams become rows
        counted = once(one.join(ordered, "class"), ["class", "n", "ordered"],
                       alone=F.col("sampled") - in_sample, prefix=(F.col("n") - least + 1).cast("int"))
        placed = counted.select("class", "n", "alone", "prefix", F.posexplode("ordered"))
        place = F.when(F.col("col.later"), F.col("col.rank")).otherwise(F.col("alone") + F.col("pos"))
        return placed.select(F.col("col.gram").alias("gram"), "class", "n", place.cast("int").alias("place"),
                             "alone", "prefix").where("place < prefix").drop("prefix")

    def _shared(self, rows: DataFrame, part: int) -> DataFrame:
        """(class, rank, gram, held): n-grams of one slice of the hashes that two classes hold at least."""
        # rank: place by hash, which for n-grams beyond the sample is their place in the order
        each = rows.select("class", F.posexplode("grams").alias("rank", "gram")) \
            .where(F.pmod("gram", F.lit(SLICES)) == part)
        # shared by two classes: the least and the greatest class differ
        counts = (each.groupBy("gram").agg(F.min("class").alias("low"), F.max("class").alias("high"),
                                           F.count("*").alias("held"))
                  .where("low <> high").select("gram", "held"))
        # equal rows of a class meet by n-gram, so copies go before rows are gathered by class
        return each.join(counts, "gram").select("class", "rank", "gram", "held").distinct()

    def _needed(self, a: Column, b: Column) -> Column:
        """Least overlap of linked sets of these sizes: ceil(p (a + b) / (100 + p))."""
        return F.ceil(F.lit(self.percent) * (a + b) / F.lit(100 + self.percent))

    def _fits(self, left: str, right: str, shared: str | None = None) -> Column:
        """Length and positional filters of two members of a group; ``shared``: n-grams that can be common."""
        a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
        length = (F.lit(self.percent) * a <= 100 * b) & (F.lit(self.percent) * b <= 100 * a)
        before = F.least(F.col(f"{left}.place"), F.col(f"{right}.place"))
        from_here = F.least(a - F.col(f"{left}.place"), b - F.col(f"{right}.place"))
        fits = length & (before + from_here >= self._needed(a, b))
        if shared is not None:
            most = F.least(F.col(f"{left}.{shared}"), F.col(f"{right}.{shared}"))
            fits = fits & (most >= self._needed(a, b))
        return fits

    def links(self) -> DataFrame:
        """(a, b): linked class pairs that join up all linked classes."""
        scratch = Scratch(self.rows.sparkSession)
        groups = scratch.stored(self.prefixes(scratch), "prefixes")
        scratch.drop(*[f"shared-{i}" for i in range(SLICES)])
        if groups.isEmpty():
            return groups.select(F.col("class").alias("a"), F.col("class").alias("b"))
        sets = scratch.stored(self._whole_sets(groups.select("class").distinct()), "whole")
        free_driver(groups.sparkSession)
        # first round: every class against the leader, among those of its groups, that has the fewest
        # n-grams of its own, as an unedited original has
        lead = groups.groupBy("gram").agg(F.min(F.struct("alone", "class", "n", "place")).alias("lead"))
        star = (groups.alias("m").join(lead.select("gram", "lead.*").alias("l"), "gram")
                .where(F.col("m.class") != F.col("l.class")).where(self._fits("m", "l")))
        first = star.groupBy(F.col("m.class").alias("b")).agg(F.min(F.struct("l.alone", "l.class")).alias("l"))
        tried = stored(self._verified(first.select(F.col("l.class").alias("a"), "b"), sets), "tried")
        free_driver(groups.sparkSession)
        # second round: against the leaders of all groups that are still apart
        apart = self._apart(groups, tried, sets)
        lead = apart.groupBy("gram").agg(F.min(F.struct("place", "class", "n", "root", "shared")).alias("lead"))
        again = (apart.alias("m").join(lead.select("gram", "lead.*").alias("l"), "gram")
                 .where((F.col("m.root") != F.col("l.root")) & self._fits("m", "l", "shared"))
                 .select(F.col("l.class").alias("a"), F.col("m.class").alias("b")).distinct())
        more = stored(self._verified(self._untried(again, tried), sets), "tried")
        tried = tried.unionByName(more)
        free_driver(groups.sparkSession)
        # last round: what is left between components, pairs in small groups, differences in large ones;
        # without a new link the components are the same, and so is what lies between them
        if not more.where("linked").isEmpty():
            apart = self._apart(groups, tried, sets)
        held = apart.groupBy("gram").agg(F.count("*").alias("held"),
                                         F.min(F.struct((F.col("n") - F.col("shared")).alias("own"), "class", "n", "root"))
                                         .alias("lead"))
        small = apart.join(held.where(F.col("held") <= SMALL).select("gram"), "gram", "left_semi")
        pairs = (small.alias("x").join(small.alias("y"), "gram").where(F.col("x.class") < F.col("y.class"))
                 .where((F.col("x.root") != F.col("y.root")) & self._fits("x", "y", "shared"))
                 .select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct())
        tried = tried.unionByName(stored(self._verified(self._untried(pairs, tried), sets), "tried"))
        large = apart.join(held.where(F.col("held") > SMALL).select("gram", "lead"), "gram")
        star = stored(large.select("class", "n", "root", F.col("lead.class").alias("lead"), F.col("lead.root").alias("lead_root"))
                      .where("class <> lead").distinct(), "star")
        free_driver(groups.sparkSession)
        if not star.isEmpty():
            with_lead = star.where("root <> lead_root").select(F.col("lead").alias("a"), F.col("class").alias("b"))
            tried = tried.unionByName(stored(self._verified(self._untried(with_lead, tried), sets), "tried"))
            free_driver(groups.sparkSession)
            tried = tried.unionByName(self._verified(self._untried(self._differing(star, tried, sets), tried), sets))
        links = stored(tried.where("linked").select("a", "b"), "links")
        scratch.drop()
        free_driver(groups.sparkSession)
        return links

    def _differing(self, star: DataFrame, tried: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b): candidate pairs among the classes that have a leader in common, by their differences from it.

        The difference E of a set from its leader is what only one of the two
        holds.  Where those of A and B are disjoint, A and B's intersection lies
        in the leader and the leader in their union, so both are at least as
        similar to it as to each other: if they link, they are joined up through
        it.  All other links share a difference, and at least
        (|EA| + |EB| - most) / 2 of them, ``most`` being the largest symmetric
        difference of linked sets of these sizes.  So a prefix filter over
        differences, rarest first, finds them.
        """
        linked = tried.where("linked")
        near = linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))) \
            .select(F.col("a").alias("lead"), F.col("b").alias("class"), F.lit(True).alias("joined")).distinct()
        known = star.join(near.hint("merge"), ["lead", "class"], "left").withColumn(
            "joined", F.coalesce("joined", F.lit(False)) | (F.col("root") == F.col("lead_root")))
        both = (known.join(sets.select("class", F.col("grams").alias("g")), "class")
                .join(sets.select(F.col("class").alias("lead"), F.col("grams").alias("l")), "lead"))
        apart = once(both, ["lead", "class", "n", "root", "joined"],
                     diff=F.concat(F.array_except("g", "l"), F.array_except("l", "g")))
        apart = stored(apart.withColumn("size", F.size("diff")), "differences")
        # a set's share in the largest symmetric difference, and what it exceeds that by
        over = F.col("size") - F.lit(100 - self.percent) * F.col("n") / F.lit(100 + self.percent)
        least = apart.groupBy("lead").agg(F.min(over).alias("least"))
        each = apart.select("lead", "class", F.explode("diff").alias("gram"))
        held = each.groupBy("lead", "gram").agg(F.count("*").alias("held")).where("held > 1")
        ordered = each.join(held, ["lead", "gram"]).groupBy("lead", "class").agg(
            F.sort_array(F.collect_list(F.struct("held", "gram"))).alias("ordered"))
        placed = (apart.drop("diff").join(ordered.hint("merge"), ["lead", "class"]).join(least, "lead")
                  .withColumn("common", F.size("ordered"))
                  .withColumn("needed", F.greatest(F.lit(1), F.ceil((over + F.col("least")) / 2 - F.lit(1e-6))))
                  .withColumn("prefix", (F.col("common") - F.col("needed") + 1).cast("int")).where("prefix > 0"))
        posted = stored(placed.select("lead", "class", "n", "root", "joined", "size", "common", F.posexplode(
            F.slice("ordered", F.lit(1), F.col("prefix"))).alias("place", "x"))
            .withColumn("gram", F.col("x.gram")).drop("x"), "posted")
        a, b = F.col("x.n"), F.col("y.n")
        most = a + b - 2 * self._needed(a, b)
        needed = F.greatest(F.lit(0), F.col("x.size") + F.col("y.size") - most)
        room = F.least("x.place", "y.place") + F.least(F.col("x.common") - F.col("x.place"), F.col("y.common") - F.col("y.place"))
        return (posted.alias("x").join(posted.alias("y"), ["lead", "gram"]).where(F.col("x.class") < F.col("y.class"))
                .where((F.col("x.root") != F.col("y.root")) & ~(F.col("x.joined") & F.col("y.joined")))
                .where((F.lit(self.percent) * a <= 100 * b) & (F.lit(self.percent) * b <= 100 * a) & (2 * room >= needed))
                .select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct())

    def _untried(self, pairs: DataFrame, tried: DataFrame) -> DataFrame:
        """Candidate pairs that were not verified before, in either order."""
        done = tried.select("a", "b").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return pairs.join(done, ["a", "b"], "left_anti")

    def _apart(self, groups: DataFrame, tried: DataFrame, sets: DataFrame) -> DataFrame:
        """(gram, class, n, place, root, shared): prefix n-grams that classes of two components hold, stored.

        All n-grams of the classes that meet another component are counted;
        ``shared`` are those that classes of another component have too, the
        rest come before them in the order.
        """
        scratch = Scratch(self.rows.sparkSession)
        roots = components(tried.where("linked").select("a", "b"))
        members = groups.join(roots.withColumnRenamed("node", "class"), "class", "left") \
            .withColumn("root", F.coalesce("root", "class"))
        met = members.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")) \
            .where("low <> high").select("gram")
        left = scratch.stored(members.join(met, "gram", "left_semi").select("class", "n", "root").distinct(), "open")
        whole = sets.select("class", "grams").join(left.hint("merge"), "class")
        # unfolded twice rather than stored: what is kept of it is a fraction
        grams = whole.select("class", "n", "root", F.explode("grams").alias("gram"))
        count = left.count()
        while True:
            held = grams.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held")) \
                .where("low <> high").select("gram", "held")
            grams = scratch.stored(grams.join(held, "gram").select("class", "n", "root", "gram", "held"), "open-grams")
            enough = grams.groupBy("class").agg(F.first("n").alias("n"), F.count("*").alias("shared")) \
                .where(100 * F.col("shared") >= F.lit(self.percent) * F.col("n"))
            kept = scratch.stored(enough.select("class", "shared"), "enough")
            free_driver(self.rows.sparkSession)
            now = kept.count()
            if now >= 0.9 * count:
                break
            # n-grams of classes that went are no longer shared
            grams = scratch.stored(grams.join(kept.hint("merge"), "class", "left_semi").drop("held"), "open-grams")
            count = now
        ordered = grams.groupBy("class").agg(F.first("n").alias("n"), F.first("root").alias("root"),
                                             F.sort_array(F.collect_list(F.struct("held", "gram"))).alias("ordered"))
        own = once(ordered.join(kept.hint("merge"), "class"), ["class", "n", "root", "shared", "ordered"],
                   prefix=(F.col("n") - F.floor((F.lit(self.percent) * F.col("n") + 99) / 100) + 1
                           - F.col("n") + F.col("shared")).cast("int"))
        placed = own.where("prefix > 0").select(
            "class", "n", "root", "shared", F.posexplode(F.slice("ordered", F.lit(1), F.col("prefix"))).alias("pos", "x"))
        apart = stored(placed.select(F.col("x.gram").alias("gram"), "class", "n",
                                    (F.col("n") - F.col("shared") + F.col("pos")).cast("int").alias("place"), "root", "shared"),
                      "apart")
        scratch.drop()
        free_driver(self.rows.sparkSession)
        return apart

    def _whole_sets(self, wanted: DataFrame) -> DataFrame:
        """Whole sets of the wanted classes, one row a class, read from the texts anew.

        The wanted grow with the documents, so they are never broadcast.
        """
        wanted = wanted.hint("merge")
        # one row a class, by id and text; of repeated rows one stays, so sets need not meet by class
        row = ["k0", "k1", "k2"]
        k0 = F.xxhash64("doc_id").alias("k0")
        heads = self.rows.join(wanted, "class", "left_semi").groupBy("class").agg(
            F.min(F.struct(k0, "k1", "k2")).alias("x")).select("x.*").hint("merge")
        texts = self.docs.select(k0, "k1", "k2", "text").join(heads, row, "left_semi").dropDuplicates(row)
        return _map_sets(texts, ["k0"], "class long, grams array<bigint>, parts array<int>", _whole, self.n).drop("k0")

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b, linked): candidate pairs, through the suffix filter and then by their whole sets."""
        sizes = sets.select("class", "parts", F.size("grams").alias("n"))
        near = (pairs.join(sizes.select(F.col("class").alias("a"), F.col("parts").alias("pa"),
                                        F.col("n").alias("na")), "a")
                .join(sizes.select(F.col("class").alias("b"), F.col("parts").alias("pb"),
                                   F.col("n").alias("nb")), "b"))
        most = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        kept = near.withColumn("near", most >= self._needed(F.col("na"), F.col("nb")))
        both = (kept.where("near").select("a", "b", "na", "nb")
                .join(sets.select(F.col("class").alias("a"), F.col("grams").alias("ga")), "a")
                .join(sets.select(F.col("class").alias("b"), F.col("grams").alias("gb")), "b"))
        common = F.size(F.array_intersect("ga", "gb"))
        linked = 100 * common >= F.lit(self.percent) * (F.col("na") + F.col("nb") - common)
        return both.select("a", "b", linked.alias("linked"))

    # -- results ---------------------------------------------------------

    def classes(self) -> DataFrame:
        """(doc_id, k1, k2, n, component): a row for each document; k1, k2 name its text."""
        roots = components(self.links())
        rows = self.rows.select("doc_id", "k1", "k2", "n", "class")
        return rows.join(roots.withColumnRenamed("node", "class"), "class", "left").select(
            "doc_id", "k1", "k2", "n", F.coalesce("root", "class").alias("component"))

    def members(self) -> DataFrame:
        """(doc_id, n_shingles, component_id): component_id is the least doc_id in reach."""
        named = self.classes()
        least = named.where("n > 0").groupBy(F.col("component").alias("c")).agg(F.min("doc_id").alias("component_id"))
        return named.join(least, (F.col("component") == F.col("c")) & (F.col("n") > 0), "left").select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


    def firsts(self) -> DataFrame:
        """(doc_id, k1, k2): the document of the least id of each component, and all without words."""
        named = self.classes()
        first = named.where("n > 0").groupBy("component").agg(F.min(F.struct(
            F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")).alias("x"))
        return first.select("x.doc_id", "x.k1", "x.k2").unionByName(
            named.where("n = 0").select("doc_id", "k1", "k2").distinct())


def _text_key(text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("2"), text).alias("k2")]


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of linked ones, the one of the least id, with the input's columns.

    Rows with the same id and the same text count as one.
    """
    join = Jaccard(docs, id_col=id_col, text_col=text_col, **options)
    firsts = stored(join.firsts(), "firsts")
    join.scratch.drop()
    rows = docs.select(F.col(id_col).alias("doc_id"), *_text_key(text_col),
                       F.struct(*[F.col(c) for c in docs.columns]).alias("__row"))
    single = rows.groupBy("doc_id", "k1", "k2").agg(F.first("__row").alias("__row"))
    same = (F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.k1") == F.col("f.k1"))
            & (F.col("r.k2") == F.col("f.k2")))
    return single.alias("r").join(firsts.alias("f"), same, "left_semi").select(
        *[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
