"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (curve_packing, decontaminate, fill_middle, lexical_tree, licenses, lm_score, mixing, quality_rules,
                       secret_scan, sharding, token_output, toxicity)
from quire.llm.common import new_path, table
from quire.llm.ngram_jaccard import Jaccard
from quire.llm.oracle import ORACLE  # noqa: F401


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids in sorted files, read back from them."""
    path = new_path(spark, "tokens")
    token_output.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_output.with_checksums(token_output.read_token_files(spark, path)).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return Jaccard(table(spark, sf_dir, "documents")).members()


def usable_label() -> Column:
    """Labels that a model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"), usable=usable_label())
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", (~F.coalesce(usable_label(), F.lit(True))).alias("held_out"), "score",
        (F.col("score") >= toxicity.PREDICT_AT).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality_rules.keep_good(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law ``key``."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = sharding.assign_shards(rows, [1.0] * 16, shard_col="shard")
    grown = sharding.assign_shards(placed, [1.0] * 17, shard_col="grown_shard")
    return sharding.number_slots(grown, order_cols=["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                        "contaminated")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secret_scan.find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = F.array(*[F.lit(k) for k in secret_scan.KINDS])

    def written(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under the counts of all others."""
    return lm_score.scores(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, laid out as files of three depths under their source."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat_ws(
            "/", F.coalesce("source", F.lit("none")), F.when(F.col("doc_id") % 3 > 0, F.coalesce("lang", F.lit("none"))),
            F.when(F.col("doc_id") % 3 > 1, F.expr("cast(doc_id div 50 as string)")),
            F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return licenses.scan(docs, keep=["doc_id", "path"])


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens, read back from them."""
    path = new_path(spark, "sequences")
    curve_packing.pack(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return curve_packing.pieces(curve_packing.read_sequences(spark, path))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-middle form, and the text rebuilt from that."""
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    digests = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return fill_middle.restore(made, keep=digests).select(*digests, "restored_sha256")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_mixing": op8_mixing,
    "op9_lm_score": op9_lm_score,
    "op10_license_scan": op10_license_scan,
    "op11_packing": op11_packing,
    "op12_fill_middle": op12_fill_middle,
    "op13_lexical_search": op13_lexical_search,
}
