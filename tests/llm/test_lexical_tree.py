"""Ranked lexical search against plain scoring of every document; trees and bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import lexical_tree as lt
from quire.llm.oracle import ORACLE
from quire.llm.queries import QUERIES

from . import brute

ITEMS = "item_id long, text string, rank long, score string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(brute.LOWER))


def plain_search(docs, items, top=50):
    found = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    held = [c for _, c in found if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    wanted = {}
    for item_id, text in items:
        wanted.setdefault(item_id, set()).update(terms(text))
    for item_id, own in wanted.items():
        scores = []
        for doc_id, c in found:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank + 1, doc_id, -s) for rank, (s, _, _, doc_id) in
                enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def check(spark, docs, items, **options):
    got = lt.search(brute.frame(spark, docs), spark.createDataFrame([(*i, 0, "x") for i in items], ITEMS), **options)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_search(docs, items, options.get("top", 50)), key=key)


WORDS = [f"w{i}" for i in range(40)] + ["Été", "日本", "x_y"]


def some_text(rng, n):
    return " ".join(WORDS[min(int(rng.expovariate(0.12)), len(WORDS) - 1)] for _ in range(n))


@pytest.mark.parametrize("seed,top,leaf,group,block", [(1, 50, 64, 1 << 14, 8192), (2, 5, 2, 40, 8192), (3, 7, 1, 300, 12),
                                                     (4, 1, 4, 7, 30)])
def test_search_equals_plain_scoring(spark, seed, top, leaf, group, block):
    rng = random.Random(seed)
    docs = [(i, some_text(rng, rng.randrange(0, 60))) for i in range(300)]
    docs += [(300 + i, docs[i % 3][1]) for i in range(90)]  # large groups of copies: ties by id
    items = [(i, some_text(rng, rng.randrange(1, 12))) for i in range(12)] + [(2, "w39 w1"), (90, None), (91, ""), (None, "w3 w30")]
    check(spark, docs, items, top=top, block_terms=block, group_docs=group, leaf=leaf)


def test_edges(spark):
    items = [(1, "one word"), (2, "WORD Été 日本語"), (3, "a b c d e"), (4, "absent"), (5, "!!!")]
    check(spark, brute.EDGES, items)
    check(spark, brute.EDGES, items, top=2)
    check(spark, [], items)
    check(spark, brute.EDGES, [])
    check(spark, [(1, None), (2, "...")], items)


def test_nodes_cover_the_documents_and_bound_them():
    rng = np.random.default_rng(3)
    vectors = [np.sort(rng.choice(30, size=rng.integers(0, 12), replace=False, p=np.arange(30, 0, -1) / 465))
               for _ in range(400)]
    off = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    counts = rng.integers(1, 9, off[-1])
    m = rng.integers(50, 500, 400)
    tree = lt.Tree(off, np.concatenate(vectors), counts, m, np.arange(400), 30, leaf=5)
    assert sorted(tree.ids.tolist()) == list(range(400))
    for node, below in enumerate(tree.children):
        low, high = tree.low[node], tree.high[node]
        if below:
            assert [tree.low[c] for c in below] + [high] == [low] + [tree.high[c] for c in below]
        most = np.zeros(30, dtype=int)
        for d in range(low, high):
            run = slice(tree.off[d], tree.off[d + 1])
            np.maximum.at(most, tree.terms[run], tree.counts[run])
        assert (tree.most[node] == most).all()
        assert tree.least_m[node] == tree.m[low:high].min() and tree.least_id[node] == tree.ids[low:high].min()
    # most documents are never scored for a rare term
    best, scored = lt.Best(5), []
    plain = tree._score
    tree._score = lambda node, dense, found: (scored.append(node), plain(node, dense, found))
    dense = np.zeros(30, dtype=np.int64)
    dense[25] = 1000
    tree.search(np.array([25]), np.array([1000]), dense, best)
    assert len(scored) < sum(not c for c in tree.children) / 2


def test_query_equals_its_twin(spark):
    from quire.plans.check import compare, duck_connect

    sf = "/root/testdata/sf0.001"
    for name in ("op12_fill_middle", "op13_lexical_search"):
        assert compare(spark, name, QUERIES[name], ORACLE[name], sf, duck_connect(sf))["ok"]
