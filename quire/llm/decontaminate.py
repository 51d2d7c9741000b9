"""Benchmark decontamination by winnowing.

A text's fingerprints are, in every window of ``W`` consecutive k-gram hashes,
the smallest one.  Two texts that share ``K + W - 1`` words share a
fingerprint of that span, so joining fingerprints finds every shared window of
``WINDOW = K + W - 1`` words.  Each joined pair gives an alignment of document
and item; the hit is extended over the equal words around it, compared as
bytes, and counts if it covers a window.

Repeated words give equal k-grams side by side.  Where a k-gram comes again
after at most ``PERIOD`` words, the words around it repeat with that period, and
its places in that stretch are not joined one by one.  A shared window that
reaches over the stretch's end lies at an end in both texts, so only the places
near the ends are joined; windows inside the stretch are worked out from the
two stretches and their phases (``inside``).  So a text of one word, joined with
an item of that word, costs a handful of rows.

An item of fewer than ``WINDOW`` words is one window: its whole text is its
only fingerprint (winnowing with k its length and windows of one), and
documents carry all k-grams of the lengths that such items have.

Work on a text is done once for all rows that share it.  Null texts have no
words and are never hit; so are items without words.  An item id that stands
in several rows counts once.  Repeated rows get equal results, empty tables
give an empty or an unhit result.  Other columns are carried along; one with the
name of a written column is refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import words
from quire.llm.common import refuse_clash, ship_package, stored

WINDOW = 10
K = 6
W = WINDOW - K + 1
#: Longest period of a stretch: a window inside one then holds a k-gram twice.
PERIOD = WINDOW - K
#: Up to so many benchmark fingerprints (some 40 MB) go to every task; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


#: What a fingerprint has: its hash, its place, and the stretch of words that it repeats in (period 0: none).
PRINT = ["hashes", "places", "period", "begin", "end"]


def winnow(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Indices of the k-grams that are the smallest of some ``width`` consecutive ones.

    ``at`` are the k-grams' first words; a gap between them is a text's end.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)
    # within one text the first words of a window's k-grams are consecutive
    whole = np.flatnonzero(at[width - 1:] - at[:n - width + 1] == width - 1)
    return np.unique(whole + np.argmin(view[whole], axis=1))


def _stretches(grams: np.ndarray, at: np.ndarray, hashed: np.ndarray, row_of_word: np.ndarray, picked: np.ndarray):
    """Least period of each picked k-gram (0: it does not come again near by) and its stretch of words."""
    n = len(picked)
    period, begin, end = np.zeros(n, dtype=np.int64), at[picked].copy(), at[picked] + K
    for d in range(1, min(PERIOD, len(grams) - 1) + 1):
        again = np.zeros(len(grams), dtype=bool)        # the same k-gram stands d words further
        again[:-d] = (grams[:-d] == grams[d:]) & (at[d:] - at[:-d] == d)
        before = np.zeros(len(grams), dtype=bool)
        before[d:] = again[:-d]
        new = np.flatnonzero((period == 0) & (again[picked] | before[picked]))
        if not len(new):
            continue
        same = (hashed[:-d] == hashed[d:]) & (row_of_word[:-d] == row_of_word[d:])
        breaks = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
        inside = at[picked[new]] - np.where(again[picked[new]], 0, d)
        k = np.searchsorted(breaks, inside)
        period[new], begin[new], end[new] = d, breaks[k - 1] + 1, breaks[k] + d
    return period, begin, end


def _ends_only(grams: np.ndarray, at: np.ndarray, picked: np.ndarray, period: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Fingerprints: (hash, place, period, begin, end); of a stretch the places near its ends."""
    single = period == 0
    parts = [(grams[picked[single]], at[picked[single]], period[single], begin[single], end[single])]
    if not single.all():
        value, x, d, b, e = (v[~single] for v in (grams[picked], at[picked], period, begin, end))
        phase = (x - b) % d
        kept = np.unique(np.rec.fromarrays([value, phase, d, b, e]))
        value, phase, d, b, e = (kept[f] for f in kept.dtype.names)
        last = e - K - ((e - K - b - phase) % d)        # last place of the phase
        for i in range(PERIOD):
            near = i * d + phase < PERIOD
            parts.append((value[near], (b + phase + i * d)[near], d[near], b[near], e[near]))
            far = (e - K - last + i * d < PERIOD) & (last - i * d >= b + PERIOD)
            parts.append((value[far], (last - i * d)[far], d[far], b[far], e[far]))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def inside(period: int, begin: int, end: int, item_begin: int, item_end: int, delta: int) -> tuple[int, int] | None:
    """The words of a stretch that windows cover which lie inside the item's stretch too; ``delta``: where a
    place of the item's stretch lies in the document, modulo the period."""
    starts = item_end - WINDOW - item_begin + 1         # windows of the item's stretch
    if starts < 1 or end - begin < WINDOW:
        return None
    low, high = end, begin
    for q in range(item_begin, item_begin + min(starts, period)):
        low = min(low, begin + (q + delta - begin) % period)
        high = max(high, end - WINDOW - (end - WINDOW - q - delta) % period)
    return (low, high + WINDOW) if low <= high else None


def _fingerprints(column: pa.Array, short: list[int], whole_short: bool):
    """For runs of rows: words a row, row of each fingerprint, and its hash, place, period, begin and end in the row."""
    for _, data, off in words.chunks(column):
        data = words.LOWER[data]
        start, end, first = words.spans(data, off, words.ALNUM)
        counts = np.diff(first)
        hashed = words.word_hashes(data, start, end)
        grams, at = words.ngram_hashes(hashed, first, K)
        # texts meet at their ends: no k-gram crosses, but a window of k-grams must not either
        row = words.rows_of(at, first)
        picked = winnow(grams, at + row * (K + W), W)
        of_word = np.repeat(np.arange(len(counts)), counts)
        found = _ends_only(grams, at, picked, *_stretches(grams, at, hashed, of_word, picked))
        rows = [words.rows_of(found[1], first)]
        kept = [[found[0], *[found[i] - first[rows[0]] if i != 2 else found[2] for i in range(1, 5)]]]
        for n in short:
            grams, at = words.ngram_hashes(hashed, first, n)
            row = words.rows_of(at, first)
            if whole_short:
                only = counts[row] == n
                grams, at, row = grams[only], at[only], row[only]
            place = at - first[row]
            rows.append(row)
            kept.append([grams, place, np.zeros(len(at), dtype=np.int64), place, place + n])
        yield (counts, np.concatenate(rows), *[np.concatenate(x) for x in zip(*kept, strict=True)])


def fingerprints(texts: DataFrame, keep: list[str], short: list[int], whole_short: bool = False) -> DataFrame:
    """``keep`` columns, ``n_words`` and a list for each of ``PRINT`` of every ``text``."""
    def run(batches):
        for batch in batches:
            row = 0
            for counts, rows, values, *numbers in _fingerprints(batch.column("__text"), short, whole_short):
                order = np.argsort(rows, kind="stable")
                off = pa.array(np.searchsorted(rows[order], np.arange(len(counts) + 1)), type=pa.int32())
                own = batch.slice(row, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [own.column(c) for c in keep] + [
                        pa.array(counts, type=pa.int64()),
                        pa.ListArray.from_arrays(off, pa.array(values[order].view(np.int64))),
                        *[pa.ListArray.from_arrays(off, pa.array(x[order], type=pa.int32())) for x in numbers]],
                    names=[*keep, "n_words", *PRINT])
                row += len(counts)

    schema = T.StructType([texts.schema[c] for c in keep] + [
        T.StructField("n_words", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType())),
        *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in PRINT[1:]]])
    return texts.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def _word_list(text: bytes) -> list[bytes]:
    data = words.LOWER[np.frombuffer(text, dtype=np.uint8)]
    start, end, _ = words.spans(data, np.array([0, len(data)]), words.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def extend(doc: list[bytes], item: list[bytes], shifts: list[int]) -> list[tuple[int, int]]:
    """Runs of equal words along the given alignments that cover a window: (first word, end)."""
    least = min(WINDOW, len(item))
    found = []
    for shift in sorted(set(shifts)):
        low, high = max(0, shift), min(len(doc), shift + len(item))
        begin = low
        for i in range(low, high + 1):
            if i == high or doc[i] != item[i - shift]:
                if i - begin >= least:
                    found.append((begin, i))
                begin = i + 1
    return found


_HITS = T.StructType([T.StructField("key", T.StringType()), T.StructField("item_id", T.StringType()),
                      T.StructField("runs", T.ArrayType(T.ArrayType(T.IntegerType())))])


def _extend_batches(batches):
    for batch in batches:
        out = {"key": [], "item_id": [], "runs": []}
        docs: dict[str, list[bytes]] = {}
        items: dict[str, list[bytes]] = {}
        for key, text, item_id, item_text, shifts, both in zip(
                *[batch.column(c) for c in ("key", "text", "item_id", "item_text", "shifts", "both")], strict=True):
            key, item_text = key.as_py(), item_text.as_py()
            if key not in docs:
                docs = {key: _word_list(text.as_py().encode())}
            if item_text not in items:
                items[item_text] = _word_list(item_text.encode())
            runs = extend(docs[key], items[item_text], shifts.as_py())
            runs += [x for x in (inside(**b) for b in both.as_py()) if x]
            if runs:
                out["key"].append(key)
                out["item_id"].append(item_id.as_py())
                out["runs"].append([list(r) for r in runs])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("key", pa.string()), ("item_id", pa.string()), ("runs", pa.list_(pa.list_(pa.int32())))]))


def text_key(text_col: str = "text") -> Column:
    """What rows with the same text share."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.concat_ws("-", F.xxhash64(text), F.xxhash64(F.lit("2"), text), F.octet_length(text))


def hits(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id",
         item_text_col: str = "text") -> DataFrame:
    """The extended hits: ``key`` of the text, ``item_id`` and the ``runs`` (first word, end) in the text."""
    ship_package(docs.sparkSession)
    bench = (items.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
             .where("text is not null").distinct())
    bench_prints = stored(fingerprints(bench, ["item_id", "text"], list(range(1, WINDOW)), whole_short=True)
                          .select("item_id", F.xxhash64("text").alias("item_key"), "n_words",
                                  F.inline_outer(F.arrays_zip(*PRINT))), "benchmark")
    # at most nine numbers: the lengths of items that are shorter than a window
    short = sorted(r["n_words"] for r in bench_prints.where(f"n_words between 1 and {WINDOW - 1}")
                   .select("n_words").distinct().collect())
    bench_unrolled = bench_prints.where("hashes is not null").select(
        "item_id", "item_key", "hashes", *[F.col(c).alias(f"item_{c}") for c in PRINT[1:]])
    if bench_unrolled.count() <= BROADCAST_ROWS:
        bench_unrolled = F.broadcast(bench_unrolled)
    source = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = fingerprints(source, ["key"], short)
    unrolled = prints.select("key", F.inline(F.arrays_zip(*PRINT)))
    delta = F.pmod(F.col("places") - F.col("item_places"), F.col("period"))
    both = F.when((F.col("period") > 0) & (F.col("period") == F.col("item_period")),
                  F.struct("period", "begin", "end", F.col("item_begin"), F.col("item_end"), delta.alias("delta")))
    met = (unrolled.join(bench_unrolled, "hashes")
           .groupBy("key", "item_id", "item_key")
           .agg(F.collect_set(F.col("places") - F.col("item_places")).alias("shifts"),
                F.collect_set(both).alias("both")))
    met = stored(met, "hits")
    # texts of the documents that met an item, once a text; their number grows with the documents, so
    # they are never broadcast
    wanted = met.select("key").distinct().hint("merge")
    texts = source.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    pairs = (met.join(bench.select("item_id", F.col("text").alias("item_text"),
                                   F.xxhash64("text").alias("item_key")), ["item_id", "item_key"])
             .join(texts, "key").select("key", "text", "item_id", "item_text", "shifts", "both"))
    return pairs.sortWithinPartitions("key").mapInArrow(_extend_batches, _HITS)


def _counted(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` columns, ``__key`` and ``n_words`` of every row."""
    def run(batches):
        for batch in batches:
            sizes = [np.zeros(0, dtype=np.int64)]
            for _, data, off in words.chunks(batch.column("__text")):
                sizes.append(np.diff(words.spans(data, off, words.ALNUM)[2]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in (*keep, "__key")] + [pa.array(np.concatenate(sizes), type=pa.int64())],
                names=[*keep, "__key", "n_words"])

    rows = docs.select(*keep, text_key(text_col).alias("__key"), F.col(text_col).alias("__text"))
    schema = rows.drop("__text").schema.add("n_words", "long")
    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, items: DataFrame, *, text_col: str = "text", keep: list[str] | None = None,
           **cols) -> DataFrame:
    """``keep`` (all columns by default) plus n_words, n_hit, item_ids (sorted) and contaminated."""
    kept = docs.columns if keep is None else keep
    refuse_clash(kept, ["n_words", "n_hit", "item_ids", "contaminated"])
    found = hits(docs, items, text_col=text_col, **cols)
    runs = found.groupBy("key").agg(
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    # runs in order of their first word: each adds the words behind the furthest end so far
    covered = F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0), r[1] - F.greatest(s["end"], r[0]))).alias("n"),
        F.greatest(s["end"], r[1]).alias("end")), lambda s: s["n"])
    per_key = runs.select(F.col("key").alias("__key"), covered.cast("long").alias("n_hit"), "item_ids")
    return _counted(docs, kept, text_col).join(per_key, "__key", "left").select(
        *kept, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **cols) -> DataFrame:
    """The documents that no item's window hits, with the input's columns."""
    found = hits(docs, items, text_col=text_col, **cols).select(F.col("key").alias("__key")).distinct().hint("merge")
    return docs.withColumn("__key", text_key(text_col)).join(found, "__key", "left_anti").select(*docs.columns)
