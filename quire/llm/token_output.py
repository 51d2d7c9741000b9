"""Token-ID output: a sorted Parquet file set of token lists, and its reader.

``write_token_files`` puts documents in ascending ``doc_id`` order (range
partitioned, so every task writes one file of one id range), encodes whole
texts and writes

* ``<path>/tokens``: one row a document: ``doc_id``, the kept columns,
  ``part`` (number of its file), ``part_start`` (ids before it in that file),
  ``n_tokens`` and ``token_ids list<int>``;
* ``<path>/index``: one row a file: ``part``, ``n_docs``, ``n_tokens``,
  ``start`` (ids in all files before it).

Token lists are dictionary encoded, the ascending numbers delta encoded.
Row groups and pages have set sizes and every column chunk carries a page
index, so a filter on ``doc_id`` or a read of the metadata columns skips the
token pages it does not need.

A null text is an empty one (only the end id is written).  Null ``doc_id``
come first; rows that share a ``doc_id`` follow one another in the order of
their text hash, and equal rows are interchangeable.  An empty table gives
files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import words
from quire.llm.common import ship_package

END_ID = 1
#: Parquet layout: version 2 pages, row groups of 32 MB, pages of 64 KB.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
#: Cached encodings a worker; the cache starts anew beyond it.
CACHE_ENTRIES = 1_500_000
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True


class WordEncoder:
    """Encodes whole texts through the distinct pieces in them.

    The tokenizer never joins characters over white space, nor an ASCII letter
    with ASCII punctuation (the apostrophe and ``<|>``, which may begin
    contractions and special tokens, count as neither).  A text's ids are
    therefore the ids of its pieces between such places, one after another,
    and each distinct piece is encoded once.

    Known pieces are kept as sorted hashes with their place in one array of
    ids; beyond ``CACHE_ENTRIES`` the store starts anew.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # Lower-case Latin-1 letter runs are left as they are by the normaliser
        # and are one pre-token each, so for them a split at spaces is the same.
        self.letters = Tokenizer.from_file(tokenizer_path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids: list[np.ndarray] = [np.zeros(0, dtype=np.int32)]
        self.total = 0

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts, number of ids of each) for runs of rows."""
        for _, data, off in words.chunks(column, ENCODE_BYTES):
            yield self._chunk(data, off)

    def _chunk(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = words.LOWER[raw]
        start, end, first = _pieces(data, off)
        # special tokens are looked for before letters are lower-cased
        special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        for i in np.unique(np.searchsorted(start, special, side="right") - 1).tolist():
            data[start[i]:end[i]] = raw[start[i]:end[i]]
        if not len(start):
            return np.zeros(0, dtype=np.int32), np.zeros(len(off) - 1, dtype=np.int64)
        codes, distinct = pd.factorize(words.word_hashes(data, start, end))
        if len(self.keys) + len(distinct) > CACHE_ENTRIES:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            some = np.empty(len(distinct), dtype=np.int64)
            some[codes] = np.arange(len(codes))  # a piece of each code
            some = some[~known]
            self._learn(distinct[~known], [data[a:b].tobytes().decode("utf-8")
                                           for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        pool = self.ids[0]
        n = self.size[at][codes]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(self.begin[at][codes] - before[:-1], n) + np.arange(before[-1])]
        return ids, np.diff(before[first])

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        plain = np.array([p.isalpha() and p.islower() and max(p) < "\u0100" for p in pieces])
        ids, size = [], np.zeros(len(pieces), dtype=np.int64)
        if plain.any():
            text = " ".join([p for p, x in zip(pieces, plain, strict=True) if x])
            ids.append(np.array(self.letters.encode(text, add_special_tokens=False).ids, dtype=np.int32))
            ends = np.flatnonzero(self.ends_word[ids[-1]])
            size[plain] = np.diff(np.concatenate([[-1], ends]))
        if not plain.all():
            rest = [p for p, x in zip(pieces, plain, strict=True) if not x]
            encoded = self.tokenizer.encode("\n".join(rest), add_special_tokens=False)
            ids.append(np.array(encoded.ids, dtype=np.int32))
            places = np.fromiter((o[0] for o in encoded.offsets), dtype=np.int64, count=len(ids[-1]))
            size[~plain] = np.diff(np.searchsorted(places, np.cumsum([0] + [len(p) + 1 for p in rest])))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        begin = self.total + np.concatenate([[0], np.cumsum(size[order])[:-1]])
        self.ids = [np.concatenate([*self.ids, *ids])]
        self.total = len(self.ids[0])
        by_key = np.argsort(keys[order])
        fresh = keys[order][by_key]
        at = np.searchsorted(self.keys, fresh)
        self.keys = np.insert(self.keys, at, fresh)
        self.begin = np.insert(self.begin, at, begin[by_key])
        self.size = np.insert(self.size, at, size[order][by_key])


def _pieces(data: np.ndarray, off: np.ndarray):
    """Spans of the pieces that the tokenizer keeps apart; see WordEncoder."""
    start, end, first = words.spans(data, off, words.NOT_SPACE)
    if not len(start):
        return start, end, first
    letter, punct = _LETTER[data], _PUNCT[data]
    cut = np.flatnonzero((letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:])) + 1
    word = np.searchsorted(start, cut, side="right") - 1
    cut = cut[(word >= 0) & (cut > start[word]) & (cut < end[word])]
    start = np.sort(np.concatenate([start, cut]))
    end = np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, off)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _encode_part(batches, tokenizer_path: str, end_id: int, kept: list[str]):
    """One sorted partition: adds its number, the running start and the ids."""
    from pyspark import TaskContext

    part, running = TaskContext.get().partitionId(), 0
    encoder = _encoder(tokenizer_path)
    for batch in batches:
        row = 0
        for ids, sizes in encoder.encode(batch.column("__text")):
            rows = len(sizes)
            before = np.concatenate([[0], np.cumsum(sizes + 1)])
            values = np.full(before[-1], end_id, dtype=np.int32)
            inside = np.ones(before[-1], dtype=bool)
            inside[before[1:] - 1] = False
            values[inside] = ids
            own = batch.slice(row, rows)
            lists = pa.ListArray.from_arrays(pa.array(before, type=pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [own.column(c) for c in kept]
                + [pa.array(np.full(rows, part, dtype=np.int32)), pa.array(running + before[:-1]),
                   pa.array(sizes + 1), lists],
                names=kept + ["part", "part_start", "n_tokens", "token_ids"])
            running += int(before[-1])
            row += rows


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id",
                      text_col: str = "text", keep: list[str] | None = None, end_id: int = END_ID) -> None:
    """Write the token files and their index; ``keep`` names metadata columns to carry along."""
    kept = [id_col, *(keep or [])]
    clash = {"part", "part_start", "n_tokens", "token_ids"} & set(kept)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are written by the format; rename them first")
    source = docs.select(*[F.col(c) for c in kept], F.col(text_col).alias("__text"))
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64("__text")]
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([ordered.schema[c] for c in kept] + [
        T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    ship_package(docs.sparkSession)
    encoded = ordered.mapInArrow(lambda b: _encode_part(b, tokenizer_path, end_id, kept), schema)
    encoded.write.options(**LAYOUT).parquet(f"{path}/tokens")
    # one row a file; the running total over files is the only ordered step
    files = (docs.sparkSession.read.schema(encoded.schema).parquet(f"{path}/tokens").groupBy("part")
             .agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))) \
        .write.parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a token file set, with ``start``: the ids of all documents before."""
    tokens = spark.read.parquet(f"{path}/tokens")
    # one row a file, so its size is that of a file listing
    index = spark.read.parquet(f"{path}/index").select("part", F.col("start").alias("file_start"))
    return (tokens.join(F.broadcast(index), "part")
            .withColumn("start", F.col("file_start") + F.col("part_start")).drop("file_start"))


def _checksums(batches):
    for batch in batches:
        lists = batch.column("token_ids")
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
        off = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
        names = [n for n in batch.schema.names if n != "token_ids"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(crc, type=pa.int64())],
                                         names=[*names, "ids_crc32"])


def with_checksums(tokens: DataFrame) -> DataFrame:
    """``token_ids`` replaced by ``ids_crc32``: the unsigned CRC-32 of the ids as little-endian 32-bit."""
    rest = tokens.drop("token_ids").columns
    ordered = tokens.select(*rest, "token_ids")
    schema = T.StructType([ordered.schema[c] for c in rest] + [T.StructField("ids_crc32", T.LongType())])
    ship_package(tokens.sparkSession)
    return ordered.mapInArrow(_checksums, schema)
