"""Packing along the Hilbert curve: the curve, whole documents, no padding, neighbours."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quire.llm import curve_packing as cp
from quire.llm.common import new_path
from quire.llm.queries import QUERIES, tokenizer_path

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2), (6, 1)])
def test_hilbert_key_is_a_walk_through_all_cells(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = cp.hilbert_key(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_similar_documents_lie_close_along_the_curve():
    rng = random.Random(5)
    base = [[rng.randrange(40_000) for _ in range(300)] for _ in range(300)]
    near = [[t if rng.random() > 0.02 else rng.randrange(40_000) for t in ids] for ids in base]
    ids = np.array([t for doc in base + near for t in doc], dtype=np.int32)
    cells = cp.cells_of(ids, np.full(600, 300), cp.projection(40_000))
    place = np.argsort(np.argsort(cp.hilbert_key(cells), kind="stable"))
    apart = np.abs(place[:300] - place[300:])
    assert np.median(apart) <= 10  # 200 if they lay at random


def packed(spark, docs, **options):
    path = new_path(spark, "test-sequences")
    cp.pack(docs, path, tokenizer_path(), **options)
    return cp.read_sequences(spark, path)


def check(sequences, rows, wanted, length):
    """Lengths, gapless offsets, and every id of every document in one piece."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for s in sequences:
        assert len(s["token_ids"]) == s["length"]
        assert s["length"] == length or s["length"] < length and s["length"] & (s["length"] - 1) == 0
        place = 0
        for p in s["pieces"]:
            assert p["offset"] == place and p["length"] > 0
            place += p["length"]
            by_doc[p["id"]].append((p["start"], tuple(s["token_ids"][p["offset"]:place]), p["doc_tokens"]))
        assert place == s["length"]
    assert len({s["sequence_id"] for s in sequences}) == len(sequences)
    for doc_id in {r[0] for r in rows}:
        texts = [r[1] or "" for r in rows if r[0] == doc_id]
        got = sorted(by_doc[doc_id])
        if len(texts) == 1:
            assert [g[0] for g in got] == list(itertools.accumulate([0] + [len(g[1]) for g in got[:-1]]))
            assert tuple(t for g in got for t in g[1]) == wanted(texts[0])
            assert {g[2] for g in got} == {len(wanted(texts[0]))}
        else:
            assert sorted(t for g in got for t in g[1]) == sorted(t for text in texts for t in wanted(text))
    return by_sequence


@pytest.fixture(scope="module")
def wanted():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: (*tokenizer.encode(text, add_special_tokens=False).ids, 1)


@pytest.mark.parametrize("length,parts,segment", [(16, 1, 7), (2048, 3, 4096), (1, 2, 100_000)])
def test_every_id_lies_in_one_piece(spark, wanted, length, parts, segment):
    rows = brute.EDGES[:-4] + brute.EDGES[-3:] if length == 1 else brute.EDGES + [(100 + i, f"w{i} " * i) for i in range(60)]
    docs = brute.frame(spark, rows).repartition(parts)
    check(packed(spark, docs, length=length, segment=segment).collect(), rows, wanted, length)


def test_string_ids_clashing_columns_and_empty_tables(spark, wanted):
    rows = [("a", "one two", None, None, 1), ("b", "three", None, None, 2)]
    docs = brute.frame(spark, rows, "name string, body string, key string, pieces string, tie long")
    got = packed(spark, docs, id_col="name", text_col="body", length=4).collect()
    check(got, rows, wanted, 4)
    assert packed(spark, brute.frame(spark, [])).count() == 0
    assert cp.pieces(packed(spark, brute.frame(spark, []))).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        cp.pack(docs, "unused", tokenizer_path(), length=100)


def test_query_covers_the_table_with_checksums(spark, wanted):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_packing"](spark, SF).collect()
    per_doc = defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
    assert per_doc.keys() == docs.keys()
    for doc_id, found in per_doc.items():
        ids = wanted(docs[doc_id] or "")
        place = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == place and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[place:place + r["length"]], dtype="<u4").tobytes())
            place += r["length"]
        assert place == len(ids)
    ends = defaultdict(int)
    for r in rows:
        ends[r["sequence_id"]] = max(ends[r["sequence_id"]], r["offset"] + r["length"])
    assert all(n == 2048 or n & (n - 1) == 0 for n in ends.values())
