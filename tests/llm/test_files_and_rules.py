"""Token files, quality rules, sharding and mixing."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.llm import mixing, quality_rules, sharding, token_output
from quire.llm.common import new_path
from quire.llm.queries import QUERIES, tokenizer_path

from . import brute

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple((x is None, x) for x in row)


# -- token files ---------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def expected_tokens(tokenizer, rows):
    """Rows (doc_id, n_tokens, crc) of whole-text encodings."""
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    return out


def test_special_tokens_in_any_case_equal_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["<|ENDOFTEXT|>", "<|endoftext|>", "A <|EndOfText|> b, X<|ENDOFTEXT|>Y.Z <|StartOfText|>", "IF A<|B|>C<", "|ENDOFTEXT|>",
             "", "Plain WORDS don't", "<|ENDOFTEXT|><|endoftext|>Word"]
    ids, sizes = next(token_output.WordEncoder(tokenizer_path()).encode(pa.array(texts)))
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]



def test_token_files_hold_whole_text_encodings(spark, tokenizer):
    docs = brute.frame(spark, brute.EDGES)
    path = new_path(spark, "test")
    token_output.write_token_files(docs, path, tokenizer_path(), keep=["source"])
    back = token_output.read_token_files(spark, path)
    got = token_output.with_checksums(back).select("doc_id", "n_tokens", "ids_crc32", "start").collect()
    want = expected_tokens(tokenizer, [r[:2] for r in brute.EDGES])
    assert sorted(map(key, (r[:3] for r in got))) == sorted(map(key, want))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(r["n_tokens"] for r in ordered[:i]) for i in range(len(ordered))]
    ids = [r["doc_id"] for r in ordered]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert "source" in back.columns


def test_token_query_matches_the_tokenizer_on_all_documents(spark, tokenizer):
    rows = QUERIES["op1_token_output"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = expected_tokens(tokenizer, docs)
    start, full = 0, []
    for doc_id, n, crc in want:
        full.append((doc_id, start, n, crc))
        start += n
    assert sorted(tuple(r) for r in rows) == full


def test_token_file_layout(spark):
    path = new_path(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_output.write_token_files(docs.coalesce(1), path, tokenizer_path())
    import glob
    meta = pq.ParquetFile(glob.glob(f"{path}/tokens/*.parquet".replace("file:", ""))[0]).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i)
               for i in range(meta.num_columns)}
    tokens = columns["token_ids.list.element"]
    assert "RLE_DICTIONARY" in tokens.encodings and tokens.compression == "ZSTD"
    assert "DELTA_BINARY_PACKED" in columns["part_start"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())


def test_token_files_of_no_documents_and_clashing_columns(spark):
    path = new_path(spark, "test")
    token_output.write_token_files(brute.frame(spark, []), path, tokenizer_path())
    assert token_output.with_checksums(token_output.read_token_files(spark, path)).count() == 0
    clash = brute.frame(spark, [(1, "x")]).withColumn("part", F.lit(1))
    token_output.write_token_files(clash, new_path(spark, "test"), tokenizer_path())  # not kept, so no clash
    with pytest.raises(ValueError, match="part"):
        token_output.write_token_files(clash, new_path(spark, "test"), tokenizer_path(), keep=["part"])


def test_encoder_starts_its_cache_anew(tokenizer, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(token_output, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(token_output, "ENCODE_BYTES", 16)
    texts = ["a b c d", "e.f g-h", "it's a b", "", "z Z z", "x!y?z"]
    got = []
    for ids, sizes in token_output.WordEncoder(tokenizer_path()).encode(pa.array(texts)):
        ids = ids.tolist()
        for n in sizes.tolist():
            got.append(ids[:n])
            ids = ids[n:]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# -- quality rules -------------------------------------------------------


def expected_quality(text):
    w = brute.words(text)
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i:i + 5]), []).append(i)
    hit = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_quality_counts(spark):
    rng = random.Random(3)
    texts = [None, "", "word " * 5000, "a\nb\na\n \n\nb", "x" * 10, "##| <b>", "ä ö ü"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    docs = brute.frame(spark, list(enumerate(texts)))
    rows = quality_rules.keep_good(docs.withColumn("n_words", F.lit("clash"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = expected_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_keep_good_and_drop_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_rules.keep_good(docs).join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in judged}
    assert share[1] > 0.95 and share[0] < 0.1
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_rules_are_one_projection(spark):
    plan = quality_rules.keep_good(brute.frame(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# -- sharding ------------------------------------------------------------


def test_shards_follow_weights_and_move_little(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 1.0, 2.0, 4.0]
    rows = sharding.assign_shards(sharding.assign_shards(ids, weights), [*weights, 2.0], shard_col="grown").collect()
    share = Counter(r["shard"] for r in rows)
    for i, w in enumerate(weights):
        assert abs(share[i] / 20_000 - w / 8) < 0.02
    moved = [r for r in rows if r["shard"] != r["grown"]]
    assert {r["grown"] for r in moved} == {4}
    assert abs(len(moved) / 20_000 - 0.2) < 0.02


def test_slots_are_gapless_with_nulls_and_repeats(spark):
    docs = brute.frame(spark, brute.EDGES * 3)
    rows = sharding.number_slots(sharding.assign_shards(docs, [1.0, 1.0, 1.0]), groups=2).collect()
    assert len(rows) == 3 * len(brute.EDGES)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    assert sharding.number_slots(sharding.assign_shards(docs.limit(0), [1.0])).count() == 0
    with pytest.raises(ValueError, match="weight"):
        sharding.shard_of(F.col("doc_id"), [1.0, 0.0])


def test_sharding_query_against_brute_force(spark):
    import hashlib
    rows = QUERIES["op5_sharding"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    def best(doc_id, n):
        cost = lambda s: -math.log(
            (int(hashlib.md5(f"{doc_id}/{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13)
        return min(range(n), key=cost)

    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == best(r["doc_id"], 16) and r["grown_shard"] == best(r["doc_id"], 17)
        assert r["grown_shard"] in (r["shard"], 16)


def test_write_shards(spark):
    path = new_path(spark, "shards")
    docs = brute.frame(spark, brute.EDGES)
    sharding.write_shards(docs, path, [1.0, 2.0])
    assert spark.read.parquet(path).count() == len(brute.EDGES)


# -- mixing --------------------------------------------------------------


def expected_targets(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_ = {}, set(names)
    left = float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(cap * sizes[s] for s in over)
        open_ -= set(over)
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 2, None: 50}, {"a": 0, "b": 5}, {"a": 0}, {},
    {None: 7}, {"a": 3, "b": 3, "c": 900, "d": 5, "e": 5, "f": 1}])
def test_targets_against_brute_force(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(expected_targets(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_shuffle_is_a_permutation(spark, n):
    keys = mixing._round_keys(F.lit(1).cast("long"), [F.lit("s")], 12)
    rows = spark.range(n).withColumn("k", F.get(keys, 0))
    got = [r["p"] for r in rows.select(
        mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.col("k"), [F.lit("s")]).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    assert n < 17 or got != list(range(n))


def mix_table(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 300), "en", rng.choice(["a", "b", "b", "b", None, "zz"]), 0) for i in range(120)]
    rows += [(5, "w w w", "en", "b", 0)] * 3 + [(900, None, "en", "b", 0), (901, "one", "en", "tiny", 0),
                                               (None, "x y", "en", "a", 0), (902, "", "en", "none", 0)]
    return rows, brute.frame(spark, rows)


def test_mix_meets_targets_within_a_block(spark):
    rows, docs = mix_table(spark)
    got = mixing.taken_words(docs.withColumn("taken", F.lit(1)), block=8).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    want = expected_targets(dict(sizes))
    taken = Counter()
    source_of = {}
    for r in rows:
        source_of.setdefault((r[0], len(brute.words(r[1]))), r[3])
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        taken[source_of[(r["doc_id"], r["size"])]] += r["taken"]
    for s, target in want.items():
        assert abs(taken[s] - target) <= 8, (s, taken[s], target)
    again = mixing.taken_words(docs.repartition(7), block=8).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixture_holds_what_was_taken(spark):
    _, docs = mix_table(spark)
    taken = sum(r["taken"] for r in mixing.taken_words(docs, block=8).collect())
    pieces = mixing.mixture(docs, block=8).collect()
    assert sum(len(brute.words(p["text"])) for p in pieces) == taken
    assert all(1 <= len(brute.words(p["text"])) <= 8 for p in pieces)
    # each shard's slots are a multinomial draw: every shard gets some
    assert len({p["mix_shard"] for p in pieces}) == mixing.SHARDS


def test_mix_of_nothing(spark):
    assert mixing.taken_words(brute.frame(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.taken_words(brute.frame(spark, [(1, None)])).collect()] == [(1, 0, 0, 0.0, 0)]
    assert mixing.mixture(brute.frame(spark, [(1, "")])).count() == 0
