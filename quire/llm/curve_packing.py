"""Packing documents into sequences along a space-filling curve.

1. Every whole text is encoded once (``token_output.WordEncoder``) and ends
   with ``end_id``.  Its ids make a hashed vector of ``BUCKETS`` entries, an
   occurrence weighing the logarithm of its id, which is its rarity where ids
   follow frequency; a fixed matrix of signs projects it to ``DIMS``
   dimensions.  Each coordinate, divided by the length it would have for
   unrelated ids, is spread over ``2 ** BITS`` steps by the normal
   distribution, and the Hilbert curve through these cells gives the document
   its key.  Texts of similar wording have close keys, copies the same one.
2. Documents, in segments of ``SEGMENT`` ids at most, are range partitioned by
   key, id, text hash and segment, and sorted.
3. A task lays the documents of its range end to end along the curve and cuts
   the run into sequences of ``SEQUENCE`` ids.  A document that lies over a cut
   is divided into pieces; neighbours on the curve share sequences.  The rest
   at the end of a task is cut into sequences whose lengths are powers of two,
   which need no padding, so nothing is padded at all and no task waits for
   another.

``pack`` writes sequences as Parquet: ``sequence_id`` (the task's number and
the place in it), ``length``, ``token_ids`` and ``pieces`` (id, ``start`` and
``length`` in the document, ``doc_tokens``, ``offset`` in the sequence).
``pieces`` reads them back as a row a piece.

A null text is an empty one: a single end id, whose vector is zero and lies in
the middle of the cells.  Null ids and rows that share an id are packed like
others, each row on its own; equal rows are interchangeable.  An empty table
gives no sequences.  Only the id and the text are read, so other columns clash
with nothing.  A key that many documents share is divided by id and a long
document by segment, so Spark can deal both to several tasks; what a task holds
besides a batch is one unfinished sequence.  Encoded documents are stored before they are sorted: a lost
executor costs a re-read, not the encoding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import words
from quire.llm.common import ship_package, stored
from quire.llm.token_output import END_ID, _encoder

SEQUENCE = 2048
BUCKETS = 1 << 16
DIMS = 6
BITS = 10
#: Ids of a document that travel as one row.
SEGMENT = 4096
#: Sequences that are written at a time.
WRITE_SEQUENCES = 256

_U = np.uint64


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of cells (rows of coordinates below ``2 ** bits``)."""
    x = cells.astype(_U).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        q, low = _U(1 << b), _U((1 << b) - 1)
        for i in range(dims):
            turned = (x[:, i] & q) != 0
            # either the first axis is mirrored, or it changes places with this one
            swap = np.where(turned, _U(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    last = np.zeros(len(x), dtype=_U)
    for b in range(bits - 1, 0, -1):
        last ^= np.where((x[:, -1] & _U(1 << b)) != 0, _U((1 << b) - 1), _U(0))
    x ^= last[:, None]
    key = np.zeros(len(x), dtype=_U)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << _U(1)) | ((x[:, i] >> _U(b)) & _U(1))
    return key.astype(np.int64)


def projection(n_ids: int) -> np.ndarray:
    """What an occurrence of each id adds: its weight, with the signs of its bucket."""
    ids = np.arange(n_ids, dtype=_U)
    bucket = words.mix(ids) % _U(BUCKETS)
    signs = 1.0 - 2.0 * ((words.mix(bucket + _U(1))[:, None] >> np.arange(DIMS, dtype=_U)) & _U(1)).astype(np.float64)
    return signs * np.log(2.0 + np.arange(n_ids))[:, None]


def cells_of(ids: np.ndarray, sizes: np.ndarray, projected: np.ndarray) -> np.ndarray:
    """Cell of each document; ``ids`` are those of all documents, one after another."""
    out = np.full((len(sizes), DIMS), 1 << (BITS - 1), dtype=np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1][full]
        each = projected[ids]
        at = np.add.reduceat(each, first, axis=0) / np.sqrt(np.add.reduceat(each[:, 0] ** 2, first))[:, None]
        # logistic approximation of the normal distribution function
        out[full] = np.minimum((2 ** BITS / (1 + np.exp(-1.702 * at))).astype(np.int64), 2 ** BITS - 1)
    return out


def _bytes(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column of the runs of ``values`` between ``edges``."""
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [
        None, pa.py_buffer((edges * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])


def _encode(batches, tokenizer_path: str, end_id: int, kind: str, n_ids: int, segment: int):
    """Key and ids of each document, in segments; ids are bytes of the numbers ``kind``."""
    encoder = _encoder(tokenizer_path)
    projected = projection(n_ids)
    for batch in batches:
        row = 0
        for ids, sizes in encoder.encode(batch.column("__text")):
            rows = len(sizes)
            before = np.concatenate([[0], np.cumsum(sizes + 1)])
            values = np.full(before[-1], end_id, dtype=kind)
            inside = np.ones(before[-1], dtype=bool)
            inside[before[1:] - 1] = False
            values[inside] = ids
            segments = -(-(sizes + 1) // segment)
            doc = np.repeat(np.arange(rows), segments)
            start = segment * (np.arange(len(doc)) - np.repeat(np.cumsum(segments) - segments, segments))
            own = batch.slice(row, rows)
            yield pa.RecordBatch.from_arrays(
                [own.column("id").take(pa.array(doc)), own.column("tie").take(pa.array(doc)), pa.array(hilbert_key(cells_of(ids, sizes, projected))[doc]),
                 pa.array(start), pa.array((sizes + 1)[doc]), _bytes(values, np.append(before[doc] + start, before[-1]))],
                names=["id", "tie", "key", "start", "doc_tokens", "ids"])
            row += rows


class _Run:
    """Documents end to end, as pieces: an unfinished sequence and what follows it."""

    def __init__(self, id_type: pa.DataType, kind: str):
        self.ids = np.zeros(0, dtype=kind)
        self.names = pa.array([], type=id_type)
        self.start = self.length = self.doc_tokens = np.zeros(0, dtype=np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        column = batch.column("ids").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        if not len(column) or off[0] == off[-1]:
            return
        kind = self.ids.dtype
        self.ids = np.concatenate([self.ids, np.frombuffer(data, np.uint8)[off[0]:off[-1]].view(kind)])
        self.names = pa.concat_arrays([self.names, batch.column("id")])
        self.start = np.concatenate([self.start, batch.column("start").to_numpy()])
        self.length = np.concatenate([self.length, np.diff(off) // kind.itemsize])
        self.doc_tokens = np.concatenate([self.doc_tokens, batch.column("doc_tokens").to_numpy()])

    def take(self, lengths: list[int]) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Cut sequences of these lengths off the front: their ids, their pieces, their lengths."""
        edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        places = np.concatenate([[0], np.cumsum(self.length)])
        cuts = np.union1d(places, edges)
        piece = np.searchsorted(places, cuts[:-1], side="right") - 1
        start = self.start[piece] + cuts[:-1] - places[piece]
        length = np.diff(cuts)
        sequence = np.searchsorted(edges, cuts[:-1], side="right") - 1
        n = int(np.searchsorted(cuts[:-1], edges[-1]))  # pieces in whole sequences
        offset = cuts[:n] - edges[sequence[:n]]
        made = pa.StructArray.from_arrays(
            [self.names.take(pa.array(piece[:n])), pa.array(start[:n]), pa.array(length[:n]),
             pa.array(self.doc_tokens[piece[:n]]), pa.array(offset)],
            names=["id", "start", "length", "doc_tokens", "offset"])
        held = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(sequence[:n], np.arange(len(lengths) + 1)), type=pa.int32()), made)
        ids = pa.ListArray.from_arrays(pa.array(edges, type=pa.int32()), pa.array(self.ids[:edges[-1]].astype(np.int32)))
        self.names, self.doc_tokens = self.names.take(pa.array(piece[n:])), self.doc_tokens[piece[n:]]
        self.start, self.length, self.ids = start[n:], length[n:], self.ids[edges[-1]:]
        return ids, held, np.diff(edges)


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _sequences(batches, length: int, id_type: pa.DataType, kind: str):
    """The sequences of one sorted range of documents."""
    from pyspark import TaskContext

    first, done = TaskContext.get().partitionId() << 32, 0
    run = _Run(id_type, kind)

    def cut(lengths):
        nonlocal done
        for i in range(0, len(lengths), WRITE_SEQUENCES):
            ids, held, sizes = run.take(lengths[i:i + WRITE_SEQUENCES])
            numbers = first + done + np.arange(len(sizes))
            done += len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(sizes), ids, held],
                                             names=["sequence_id", "length", "token_ids", "pieces"])

    for batch in batches:
        run.add(batch)
        yield from cut([length] * (len(run.ids) // length))
    yield from cut(powers_of_two(len(run.ids)))


def pack(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
         length: int = SEQUENCE, segment: int = SEGMENT, end_id: int = END_ID) -> None:
    """Write the sequences of all documents to ``path``; ``length`` is a power of two."""
    if length < 1 or length & (length - 1):
        raise ValueError("sequences must have a power of two of ids")
    from pyspark.sql.pandas.types import to_arrow_type
    from tokenizers import Tokenizer

    ship_package(docs.sparkSession)
    n_ids = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if n_ids <= 1 << 16 else "<u4"
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("__text"))
    id_field = source.schema["id"]
    fields = T.StructType.fromDDL("tie long, key long, start long, doc_tokens long, ids binary").fields
    encoded = stored(source.mapInArrow(lambda b: _encode(b, tokenizer_path, end_id, kind, n_ids, segment),
                                       T.StructType([id_field, *fields])), "encoded")
    order = [F.col("key"), F.col("id").asc_nulls_first(), F.col("tie"), F.col("start")]
    along = encoded.repartitionByRange(*order).sortWithinPartitions(*order)
    piece = T.StructType([id_field, *[T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "offset")]])
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("token_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("pieces", T.ArrayType(piece))])
    id_type = to_arrow_type(id_field.dataType)
    along.mapInArrow(lambda b: _sequences(b, length, id_type, kind), schema) \
        .write.option("compression", "zstd").parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _with_checksums(batches):
    for batch in batches:
        lists, held = batch.column("token_ids"), batch.column("pieces")
        made = held.flatten()
        sizes = np.diff(held.offsets.to_numpy())
        at = np.repeat(lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), sizes) + made.field("offset").to_numpy()
        values = np.ascontiguousarray(lists.flatten().to_numpy().astype("<u4"))
        length = made.field("length").to_numpy()
        crc = [zlib.crc32(values[a:a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [made.field("id"), made.field("start"), made.field("length"), pa.array(crc, type=pa.int64()),
             made.field("doc_tokens"), pa.array(np.repeat(batch.column("sequence_id").to_numpy(), sizes)),
             made.field("offset")],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pieces(sequences: DataFrame) -> DataFrame:
    """A row a piece of the sequences, with the unsigned CRC-32 of its ids as little-endian 32-bit."""
    id_field = sequences.schema["pieces"].dataType.elementType["id"]
    schema = T.StructType([T.StructField("doc_id", id_field.dataType)] + [
        T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    ship_package(sequences.sparkSession)
    return sequences.select("sequence_id", "token_ids", "pieces").mapInArrow(_with_checksums, schema)
