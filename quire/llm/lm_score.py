"""Language-model scoring with stupid backoff over corpus counts.

The score of a word is ``c(n-gram) / c(context)`` for the longest n-gram up to
``ORDER`` that other documents have, times ``ALPHA`` for every order given up;
a word no other document has counts as half an occurrence.  Counts are those
of all documents less the scored document's own, so no text vouches for
itself.  A document's score is the mean of the logarithms.

As joins and sums:

1. documents are dealt into batches; each batch's n-grams (by 64-bit hash) are
   counted, which pre-aggregates frequent ones, and go out as blocks: one row
   for each (batch, hash partition) with the sorted n-grams and their counts;
2. blocks meet by hash partition, where they make the count table of that part
   of the hash range, and the table joins each block, giving it the corpus
   counts of its n-grams;
3. the counted blocks meet their batch's documents again, whose exploded
   n-grams look up their counts and are summed per document.

A hash partition holds an n-gram once a batch, however frequent it is, and
batches have a set number of bytes, so no task grows with the corpus or with
a frequent word.  Nothing is collected.

Words are runs without white space, A-Z lower-cased.  A null or empty text has
no words: ``n_words`` 0 and a null score.  Repeated rows are documents of
their own (equal ones vouch for each other).  An empty table gives an empty
result.  Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words
from quire.llm.common import ship_package, stored

ORDER = 3
ALPHA = 0.4
#: Bytes of text in a batch and, about, of hashes in a hash partition.
BATCH_BYTES = 8 << 20
PART_BYTES = 8 << 20

_U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as zstandard-compressed byte planes."""
    import zstandard as z

    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)
    return z.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard as z

    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(z.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def _packed_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=_U(0)))


def _unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, _U), dtype=_U)


def _grams(column: pa.Array, order: int):
    """(words a row, for each n from 1: (hashes, row, place of the last word among all words))."""
    counts, parts = [], [[] for _ in range(order)]
    rows = n_words = 0
    for _, data, off in words.chunks(column):
        data = words.LOWER[data]
        start, end, first = words.spans(data, off, words.NOT_SPACE)
        hashed = words.word_hashes(data, start, end)
        for n in range(1, order + 1):
            grams, at = words.ngram_hashes(hashed, first, n)
            parts[n - 1].append((grams, words.rows_of(at, first) + rows, at + n - 1 + n_words))
        counts.append(np.diff(first))
        rows += len(off) - 1
        n_words += len(start)
    none = (np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    joined = [tuple(np.concatenate(x) for x in zip(*p, strict=True)) if p else none for p in parts]
    return np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64), joined


def _pack_docs(docs: pa.Table) -> bytes:
    import zstandard as z

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as stream:
        stream.write_table(docs)
    return z.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpack_docs(data: bytes) -> tuple[pa.ChunkedArray, pa.Array]:
    """(ids, texts) of a batch."""
    import zstandard as z

    docs = pa.ipc.open_stream(z.ZstdDecompressor().decompress(data)).read_all()
    texts = docs.column("text").cast(pa.large_string())
    return docs.column("doc_id"), pa.concat_arrays(texts.chunks)


def _deal(batches, batch_bytes: int):
    """Rows of a task into batches of ``batch_bytes`` of text: (batch, packed documents)."""
    from pyspark import TaskContext

    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def packed():
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + number], type=pa.int64()),
             pa.array([_pack_docs(pa.Table.from_batches(held))], type=pa.binary())], names=["batch", "docs"])

    for rows in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < rows.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + batch_bytes - size, side="right")))
            held.append(rows.slice(start, stop - start))
            size += int(ends[stop - 1]) - done
            start = stop
            if size >= batch_bytes or start < rows.num_rows:
                yield packed()
                number, held, size = number + 1, [], 0
    if held:
        yield packed()


def _blocks(table: pa.Table, order: int, parts: int) -> pa.Table:
    out = {"part": [], "batch": [], "n": [], "grams": [], "counts": []}
    edges = _part_edges(parts)
    for batch, docs in zip(table.column("batch").to_pylist(), table.column("docs"), strict=True):
        for n, (grams, _, _) in enumerate(_grams(_unpack_docs(docs.as_py())[1], order)[1], start=1):
            keys, counts = np.unique(grams, return_counts=True)
            cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            for p in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[p], cut[p + 1]
                out["part"].append(p)
                out["batch"].append(batch)
                out["n"].append(n)
                out["grams"].append(_packed_sorted(keys[a:b]))
                out["counts"].append(pack(counts[a:b].astype(np.uint32)))
    return pa.table(out, schema=pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("n", pa.int32()),
                                           ("grams", pa.binary()), ("counts", pa.binary())]))


def _part_edges(parts: int) -> np.ndarray:
    """First hashes of all hash partitions but the first."""
    return np.array([(i << 64) // parts for i in range(1, parts)], dtype=_U)


def _joined(table: pa.Table) -> pa.Table:
    """Count table of one hash partition and order, joined to each of its blocks."""
    blocks = table.to_pylist()
    grams = [_unpacked_sorted(b["grams"]) for b in blocks]
    counts = [unpack(b["counts"], np.uint32) for b in blocks]
    keys, place = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(keys)).astype(np.uint64)
    ends = np.cumsum([len(g) for g in grams])
    found = np.split(total[place], ends[:-1])
    return pa.table({"batch": [b["batch"] for b in blocks], "n": [b["n"] for b in blocks],
                     "part": [b["part"] for b in blocks], "totals": [pack(t) for t in found]},
                    schema=pa.schema([("batch", pa.int64()), ("n", pa.int32()), ("part", pa.int32()),
                                      ("totals", pa.binary())]))


def _others(grams: np.ndarray, rows: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Occurrences of each n-gram in the other documents."""
    _, code = np.unique(grams, return_inverse=True)
    pair = rows * (int(code.max()) + 1) + code if len(code) else code
    _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
    return totals[code].astype(np.int64) - own[inverse]


def _scored(batch: pa.Table, replies: pa.Table, order: int, alpha: float) -> pa.Table:
    """Per document of a batch: words, log sum without the corpus size, and words that fell back to it."""
    ids, texts = _unpack_docs(batch.column("docs")[0].as_py())
    counts, grams = _grams(texts, order)
    answer: dict[int, list] = {}
    for r in sorted(replies.to_pylist(), key=lambda r: (r["n"], r["part"])):
        answer.setdefault(r["n"], []).append(unpack(r["totals"], _U))
    n_words = int(counts.sum())
    row = np.repeat(np.arange(len(counts)), counts)
    value = np.zeros(n_words)      # log of the score, still without the corpus size for lone words
    level = np.zeros(n_words, dtype=np.int64)
    seen = []                      # per order and word: occurrences elsewhere of the n-gram that ends there
    for n in range(1, order + 1):
        here, rows, last = grams[n - 1]
        full = np.zeros(n_words, dtype=np.int64)
        if len(here):
            full[last] = _others(here, rows, np.concatenate(answer[n]))
        seen.append(full)
    for n in range(1, order + 1):
        hit = seen[n - 1] > 0
        if n == 1:
            value = np.log(np.where(hit, seen[0], 0.5)) + (order - 1) * np.log(alpha)
            level[hit] = 1
        else:
            before = np.zeros(n_words, dtype=np.int64)
            before[1:] = seen[n - 2][:-1]  # the context ends one word earlier
            value[hit] = np.log(seen[n - 1][hit] / before[hit]) + (order - n) * np.log(alpha)
            level[hit] = n
    size = len(counts)
    per = {"n_words": counts, "log_sum": np.bincount(row, weights=value, minlength=size),
           "n_backed": np.bincount(row[level < 2], minlength=size)}
    for n in range(1, order + 1):
        per[f"seen_{n}"] = np.bincount(row[level == n], minlength=size)
    schema = pa.schema([("doc_id", ids.type), ("n_words", pa.int64()),
                        ("log_sum", pa.float64()), ("n_backed", pa.int64()),
                        *[(f"seen_{n}", pa.int64()) for n in range(1, order + 1)]])
    return pa.table([ids, *[pa.array(per[f.name], type=f.type) for f in list(schema)[1:]]],
                    schema=schema)


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
           alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, score, seen_1 .. seen_order): seen_n counts the words scored by n-grams."""
    text = F.col(text_col)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-size * order // PART_BYTES))
    ship_package(docs.sparkSession)
    # batches follow the scan, so equal rows do not meet in one task; they travel compressed, once, as
    # both uses below read the same exchange
    batch_bytes = BATCH_BYTES
    dealt = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).mapInArrow(
        lambda b: _deal(b, batch_bytes), "batch long, docs binary")
    grouped = dealt.groupBy("batch")
    blocks = grouped.applyInArrow(lambda t: _blocks(t, order, parts),
                                  "part int, batch long, n int, grams binary, counts binary")
    replies = blocks.groupBy("n", "part").applyInArrow(_joined, "batch long, n int, part int, totals binary")
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, log_sum double, n_backed long, " \
        + ", ".join(f"seen_{n} long" for n in range(1, order + 1))
    summed = stored(grouped.cogroup(replies.groupBy("batch")).applyInArrow(
        lambda d, r: _scored(d, r, order, alpha), schema), "scores")
    total = summed.agg(F.sum("n_words")).first()[0] or 0
    # the unigram's denominator: the words of all other documents
    size_of_rest = F.log(F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double"))
    return summed.select("doc_id", "n_words", F.when(F.col("n_words") > 0, (
        F.col("log_sum") - F.col("n_backed") * size_of_rest) / F.col("n_words")).alias("score"),
        *[f"seen_{n}" for n in range(1, order + 1)])
