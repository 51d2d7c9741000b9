r"""Ranked lexical search through FP-trees of the documents.

Terms are the matches of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``, A-Z
lower-cased.  N documents hold a term, L is the number of all their terms.
With tf occurrences in a document of n terms and df documents that hold it, a
term of an item adds ``w * ((10**9 * tf) div (1000 * tf + 20 * m))`` to the
document's score, where ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and
``m = 50 + (50 n N) div L``.  Each item gets its ``top`` documents of the
highest score above 0, equal scores by ascending id.

1. Documents become vectors restricted to the terms of the items: term
   numbers and counts, stored with n.  N, L and df are counted over all of
   them.
2. A group of documents becomes one FP-tree: terms stand in descending order
   of df, so vectors that begin alike share a path, and equal vectors share it
   to its end.  Paths without branches are one node, and neighbouring
   branches of few documents are one leaf, so a tree has few more nodes than
   ``documents / LEAF``.
3. Each node holds the largest tf of each term and the smallest m below it.  As
   a term's part of the score grows with tf and falls with m, they bound the
   score of every document below.  Each item walks the tree depth first, best
   child first, and leaves out nodes whose bound is under its ``top``-th score
   so far (or equal to it, with no id that would come before).  That score is
   carried from tree to tree of a task.  Bounds are exact integers, so nothing
   is lost.
4. The best of all tasks are ranked in two steps, salted and then by item.

Items are dealt into blocks of about ``BLOCK_TERMS`` terms, and every block
makes its own vectors and trees; what goes to the tasks is one block, whose
size does not grow with the documents or the number of items.  One item is
never split, so it must fit in a task with its distinct terms.

Null texts have no terms and are found by no item; an item without terms finds
nothing.  Of items that share an id the terms are put together.  Repeated
document rows are ranked as rows of their own; a null id comes after all
others.  Empty tables give an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import words
from quire.llm.common import ship_package, stored

TOP = 50
#: Distinct terms of all items in a block, about; with a group's nodes they set the size of the bounds.
BLOCK_TERMS = 8192
#: Documents of a tree, and entries of its vectors, at most (one document may have more).
GROUP_DOCS = 1 << 14
GROUP_ENTRIES = 1 << 21
#: Documents below a node that is not divided further.
LEAF = 64
#: Parts in which the best of an item are ranked first.
SALTS = 64

_BIG = np.iinfo(np.int64).max


def _term_counts(column: pa.Array, vocabulary: np.ndarray | None):
    """For runs of rows: terms of each row, then row, term and count of its distinct terms.

    Terms are hashes, or places in the sorted ``vocabulary`` and only those in it.
    """
    for _, data, off in words.chunks(column):
        data = words.LOWER[data]
        start, end, first = words.spans(data, off, words.ALNUM)
        n = np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        terms = words.word_hashes(data, start, end)
        if vocabulary is not None:
            place = np.searchsorted(vocabulary, terms)
            place[place == len(vocabulary)] = 0
            known = np.flatnonzero(vocabulary[place] == terms) if len(vocabulary) else np.zeros(0, dtype=np.int64)
            both, counts = np.unique(row[known] * max(len(vocabulary), 1) + place[known], return_counts=True)
            yield n, both // max(len(vocabulary), 1), both % max(len(vocabulary), 1), counts
            continue
        order = np.lexsort((terms, row))
        row, terms = row[order], terms[order]
        new = np.ones(len(terms), dtype=bool)
        new[1:] = (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        yield n, row[at], terms[at], np.diff(np.append(at, len(terms)))


def _item_terms(batches):
    """A row for each distinct term of an item."""
    for batch in batches:
        done = 0
        for n, row, terms, _ in _term_counts(batch.column("text"), None):
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(row + done)), pa.array(terms.view(np.int64))],
                names=["item_id", "term"])
            done += len(n)


def _vectors(batches, vocabulary: np.ndarray):
    """n and the restricted vector of each document that has one of the terms or any term at all."""
    for batch in batches:
        done = 0
        for n, row, terms, counts in _term_counts(batch.column("text"), vocabulary):
            edges = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(done, len(n)), pa.array(n),
                 pa.ListArray.from_arrays(edges, pa.array(terms, type=pa.int32())),
                 pa.ListArray.from_arrays(edges, pa.array(counts, type=pa.int32()))],
                names=["doc_id", "n", "terms", "counts"])
            done += len(n)


class Tree:
    """The FP-tree of some documents, as node arrays; see the module's text.

    ``off``, ``terms`` and ``counts`` are the documents' vectors end to end,
    terms as places in the order of descending df; ``m`` and ``ids`` are the
    documents' own.  Documents lie in the order of the paths, so those below a
    node are a run ``low .. high``.
    """

    def __init__(self, off: np.ndarray, terms: np.ndarray, counts: np.ndarray, m: np.ndarray, ids: np.ndarray,
                 n_terms: int, leaf: int = LEAF):
        wide = terms.astype(">i4").tobytes()
        order = sorted(range(len(m)), key=lambda d: wide[4 * off[d]:4 * off[d + 1]])
        size = np.diff(off)[order]
        self.off = np.concatenate([[0], np.cumsum(size)])
        entry = np.repeat(off[:-1][order] - self.off[:-1], size) + np.arange(self.off[-1])
        self.terms, self.counts, self.m, self.ids = terms[entry], counts[entry], m[order], ids[order]
        self.low, self.high, self.children = [], [], []
        leaves = []
        self._node(0, len(m))
        open_nodes = [(0, 0)]
        while open_nodes:
            node, depth = open_nodes.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= leaf:
                leaves.append(node)
                continue
            depth = self._shared(low, high, depth)
            edges = self._branches(low, high, depth, leaf)
            if len(edges) == 2:
                leaves.append(node)  # equal vectors: the path ends here
                continue
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                child = self._node(a, b)
                self.children[node].append(child)
                # branches of few documents are together in one leaf, which is not divided
                open_nodes.append((child, depth))
        self._bounds(leaves, n_terms)

    def _node(self, low: int, high: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        return len(self.low) - 1

    def _shared(self, low: int, high: int, depth: int) -> int:
        """Length of the path that all documents of a run have: that of the first and the last."""
        a = self.terms[self.off[low] + depth:self.off[low + 1]]
        b = self.terms[self.off[high - 1] + depth:self.off[high]]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return depth + (int(differ[0]) if len(differ) else n)

    def _branches(self, low: int, high: int, depth: int, leaf: int) -> list[int]:
        """Edges between the runs of documents that go on with the same term; small neighbours are one run."""
        at = self.off[low:high] + depth
        ended = at >= self.off[low + 1:high + 1]
        following = np.where(ended, -1, self.terms[np.minimum(at, len(self.terms) - 1)])
        edges = [low, *(low + 1 + np.flatnonzero(following[1:] != following[:-1])).tolist(), high]
        merged = [low]
        for i in range(1, len(edges)):
            if edges[i] - merged[-1] > leaf and edges[i - 1] > merged[-1]:
                merged.append(edges[i - 1])
        merged.append(high)
        return merged

    def _bounds(self, leaves: list[int], n_terms: int) -> None:
        nodes = len(self.low)
        self.most = np.zeros((nodes, n_terms), dtype=np.int32)
        self.least_m = np.full(nodes, _BIG, dtype=np.int64)
        self.least_id = np.full(nodes, _BIG, dtype=np.int64)
        for node in leaves:
            a, b = self.low[node], self.high[node]
            run = slice(self.off[a], self.off[b])
            np.maximum.at(self.most[node], self.terms[run], self.counts[run])
            self.least_m[node], self.least_id[node] = self.m[a:b].min(), self.ids[a:b].min()
        for node in range(nodes - 1, -1, -1):  # children come after their parent
            if self.children[node]:
                below = self.children[node]
                self.most[node] = self.most[below].max(axis=0)
                self.least_m[node], self.least_id[node] = self.least_m[below].min(), self.least_id[below].min()

    def search(self, item: np.ndarray, weight: np.ndarray, dense: np.ndarray, best: Best) -> None:
        """Put the documents that belong to an item's best into ``best``.

        ``item`` and ``weight``: its terms and their weights; ``dense``: the weights by term, 0 elsewhere.
        """
        def bounds(nodes):
            return _gain(weight, self.most[np.ix_(nodes, item)], self.least_m[nodes][:, None]).sum(axis=1)

        stack = [(int(bounds([0])[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if not best.may_hold(bound, self.least_id[node]):
                continue
            below = self.children[node]
            if not below:
                self._score(node, dense, best)
                continue
            bound = bounds(below)
            for i in np.argsort(bound, kind="stable").tolist():  # the best is taken first
                if best.may_hold(int(bound[i]), self.least_id[below[i]]):
                    stack.append((int(bound[i]), below[i]))

    def _score(self, node: int, dense: np.ndarray, best: Best) -> None:
        a, b = self.low[node], self.high[node]
        run = slice(self.off[a], self.off[b])
        w = dense[self.terms[run]]
        hit = np.flatnonzero(w)
        doc = np.repeat(np.arange(a, b), np.diff(self.off[a:b + 1]))[hit]
        score = np.zeros(b - a, dtype=np.int64)
        np.add.at(score, doc - a, _gain(w[hit], self.counts[run][hit], self.m[doc]))
        best.add(score, self.ids[a:b])


def _gain(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Best:
    """The ``top`` best (score, id) so far, highest score first, then lowest id."""

    def __init__(self, top: int):
        self.top = top
        self.score = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int64)

    def may_hold(self, bound: int, least_id: int) -> bool:
        """Whether a document of this score at most and this id at least can be among the best."""
        if len(self.score) < self.top:
            return bound > 0
        last = self.score[-1]
        return bound > last or bound == last and least_id < self.ids[-1]

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        kept = score > 0
        if len(self.score) == self.top:
            kept &= score >= self.score[-1]
        if kept.any():
            score, ids = np.concatenate([self.score, score[kept]]), np.concatenate([self.ids, ids[kept]])
            order = np.lexsort((ids, -score))[:self.top]
            self.score, self.ids = score[order], ids[order]


def _groups(batches, most_docs: int):
    """Vectors of one tree's documents: (ids, n, offsets, terms, counts)."""
    def joined(held):
        sizes = np.concatenate([h[2] for h in held])
        return (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]),
                np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([h[3] for h in held]),
                np.concatenate([h[4] for h in held]))

    held, docs, entries = [], 0, 0
    for batch in batches:
        lists, counts = batch.column("terms"), batch.column("counts")
        off = lists.offsets.to_numpy()
        ids = batch.column("doc_id").fill_null(_BIG).to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(off, off[row] + GROUP_ENTRIES - entries, side="right")) - 1
            end = min(max(end, row + (not held)), row + most_docs - docs, batch.num_rows)
            if end > row:
                run = slice(off[row] - off[0], off[end] - off[0])
                held.append((ids[row:end], n[row:end], np.diff(off[row:end + 1]),
                             lists.flatten().to_numpy()[run], counts.flatten().to_numpy()[run]))
                docs, entries, row = docs + end - row, entries + int(off[end] - off[row]), end
            if row < batch.num_rows:
                yield joined(held)
                held, docs, entries = [], 0, 0
    if held:
        yield joined(held)


class Block:
    """The items that are searched together: their terms, and the weights once df is known."""

    def __init__(self, items: list[tuple[int | None, list[int]]], group_docs: int = GROUP_DOCS, leaf: int = LEAF):
        self.items, self.group_docs, self.leaf = items, group_docs, leaf
        self.vocabulary = np.unique(np.array([t for _, terms in items for t in terms], dtype=np.int64).view(np.uint64))

    def weigh(self, df: dict[int, int], n_docs: int, n_terms: int) -> None:
        size = len(self.vocabulary)
        held = np.array([df.get(i, 0) for i in range(size)], dtype=np.int64)
        # descending df, and the place of each term in that order
        place = np.empty(size, dtype=np.int64)
        place[np.lexsort((np.arange(size), -held))] = np.arange(size)
        weight = np.zeros(size, dtype=np.int64)
        weight[place] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in held.tolist()]
        self.place, self.weight, self.n_docs, self.n_terms = place, weight, n_docs, n_terms
        self.wanted = [place[np.searchsorted(self.vocabulary, np.array(terms, dtype=np.int64).view(np.uint64))]
                       for _, terms in self.items]

    def search(self, batches, top: int, id_type: pa.DataType):
        """The best documents of one task for each item."""
        best = [Best(top) for _ in self.items]
        dense = np.zeros(len(self.vocabulary), dtype=np.int64)
        for ids, n, off, terms, counts in _groups(batches, self.group_docs):
            # entries of a document in the order of the tree
            doc = np.repeat(np.arange(len(ids)), np.diff(off))
            order = np.lexsort((self.place[terms], doc))
            m = 50 + (50 * n * self.n_docs) // self.n_terms
            tree = Tree(off, self.place[terms][order], counts[order], m, ids, len(self.vocabulary), self.leaf)
            for wanted, found in zip(self.wanted, best, strict=True):
                dense[wanted] = self.weight[wanted]
                tree.search(wanted, self.weight[wanted], dense, found)
                dense[wanted] = 0
        item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        names = pa.array([name for name, _ in self.items], type=id_type)
        ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(item)), pa.array(ids, mask=ids == _BIG),
             pa.array(np.concatenate([b.score for b in best]) if best else ids)], names=["item_id", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", top: int = TOP,
           block_terms: int = BLOCK_TERMS, group_docs: int = GROUP_DOCS, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item.  Ids are integers."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    queries = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    terms = stored(queries.mapInArrow(_item_terms, "item_id long, term long").distinct(), "item-terms")
    n_blocks = -(-terms.count() // block_terms)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for number in range(n_blocks):
        found = found.unionByName(_search_block(
            texts, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == number), top, group_docs, leaf))
    return ranked(found, top)


def _search_block(texts: DataFrame, terms: DataFrame, top: int, group_docs: int, leaf: int) -> DataFrame:
    """(item_id, doc_id, score): candidates of the block's items from each task."""
    # one block of items, bounded by its terms
    block = Block([(r["item_id"], r["terms"]) for r in
                   terms.groupBy("item_id").agg(F.collect_list("term").alias("terms")).orderBy("item_id").collect()],
                  group_docs, leaf)
    vocabulary = block.vocabulary
    vectors = stored(texts.mapInArrow(lambda b: _vectors(b, vocabulary),
                                      "doc_id long, n long, terms array<int>, counts array<int>"), "vectors")
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    # one row a term of the block
    df = {r["term"]: r["df"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("df")).collect()}
    block.weigh(df, total["n_docs"], total["n_terms"])
    holding = vectors.where(F.size("terms") > 0)
    return holding.mapInArrow(lambda b: block.search(b, top, pa.int64()), "item_id long, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of candidates by item, first among parts of them, then among what those leave."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order))) \
        .where(F.col("rank") <= top).drop("salt", "rank")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))) \
        .where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
