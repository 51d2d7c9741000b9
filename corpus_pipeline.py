"""From raw documents to token files: five stages, each a training-data operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and reread as the next stage's documents.  All but the last
return the columns of their input.

1. toxicity: documents that score as toxic go;
2. n-gram Jaccard join: one document of each group of near duplicates stays;
3. benchmark decontamination: documents that hold a benchmark passage go;
4. mixing: documents become the pieces that the mix draws from their source;
5. token output: token files in document order; returns a row a piece.

Null, empty and repeated rows follow the operators' own rules; an empty table
runs through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, ngram_jaccard, token_output, toxicity
from quire.llm.common import new_path, stored, table
from quire.llm.queries import tokenizer_path, usable_label

#: Words in a block of the mix.
MIX_BLOCK = 512


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"), usable=usable_label())
    return toxicity.drop_toxic(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = mixing.mixture(docs, block=MIX_BLOCK).select(*docs.columns)
    return pieces.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_output.write_token_files(docs, path, tokenizer_path(), keep=["source"])
    return token_output.with_checksums(token_output.read_token_files(spark, path)).select(
        "doc_id", "source", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: A trained classifier and a tokenizer have no SQL twin; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
