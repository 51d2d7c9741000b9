"""Secret scan: fixed patterns plus a randomness test battery.

Base spans are the leftmost non-overlapping matches of three patterns
(assigned values, access keys, hex runs); they always stay.

The method adds tokens that look random.  Every run of ``[A-Za-z0-9+/_-]`` of
``LEAST_LENGTH`` characters or more gets an inferred encoding (decimal, hex,
base32 or base64) and three tests on the order numbers of its symbols:
chi-squared uniformity over equal cells (more cells for longer tokens), runs
above and below the middle, and lag-one serial correlation.  Fisher's method
joins them to one value: near 0 for wording, anything from 0 to 1 for random
symbols.

Tokens of letters in one case, and names and paths made of such words with a
few digits behind, are wording and serve as the null: a candidate's
p-value is the share of wording of its length class or a shorter one that
looks as random.
Benjamini-Hochberg within each length class then sets the threshold at which
at most ``FALSE_SHARE`` of the flagged tokens are expected to be wording.  All
tokens of the corpus are counted; only counts per (length class, score bin)
are compared, so the table of counts has a fixed size.  A fixed set of wording
(``SHIPPED_WORDS`` run together, some thousands) always counts as wording too,
so that p-values are fine enough on the smallest table and without any wording
of its own; on a large corpus it weighs nothing.

A null text is empty.  Offsets are code points, ends exclusive.  Repeated rows
get equal results; an empty table gives an empty result and no threshold.
``keep`` (all columns by default) is carried along; a column with the name of a
written one is refused with an error.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import words
from quire.llm.common import refuse_clash, ship_package, stored

KINDS = ["assign", "access", "hex", "random"]
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
LEAST_LENGTH = 16
#: Lower ends of the length classes.
LENGTH_CLASSES = [16, 20, 24, 32, 40, 64]
FALSE_SHARE = 0.01
#: Scores are counted in bins of 1/20 of a power of ten, up to 30 powers.
BINS_A_POWER, LAST_BIN = 20, 600

#: The base patterns.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Names and paths: words in one case, each with up to four digits behind, between separators.
NAME = re.compile(rb"(?:[A-Z]?[a-z]*|[A-Z]+)\d{0,4}(?:[/_+-]+(?:[A-Z]?[a-z]*|[A-Z]+)\d{0,4})*")
_KEYWORDS = [b"passw", b"secret", b"token", b"api"]


def _of(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table


_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = _of(_DIGITS + "abcdef")
_TOKEN = _of(_DIGITS + _LOW + _UP + "+/_-")
_IS_DIGIT, _IS_LOW, _IS_UP = _of(_DIGITS), _of(_LOW), _of(_UP)
#: Encodings: symbols in order; characters in one group share an order number.
ENCODINGS = [list(_DIGITS), [c + c.upper() * (c > "9") for c in _DIGITS + "abcdef"], list(_UP + "234567"),
             [*_DIGITS, *_UP, *_LOW, "+-", "/_"]]
_ORDER = np.full((len(ENCODINGS), 256), -1, dtype=np.int64)
for _e, _symbols in enumerate(ENCODINGS):
    for _i, _group in enumerate(_symbols):
        _ORDER[_e, [ord(c) for c in _group]] = _i
_SIZE = np.array([len(e) for e in ENCODINGS])


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return np.array([max(1e-300, 0.5 * math.erfc(x / math.sqrt(2))) for x in z.tolist()])


def randomness(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fisher-joined p-value of each token (bytes end to end, offsets) under random symbols."""
    n = np.diff(off)
    owner = np.repeat(np.arange(len(n)), n)
    fits = np.stack([np.add.reduceat((_ORDER[e][tokens] < 0).astype(np.int64), off[:-1]) == 0
                     for e in range(len(ENCODINGS))])
    encoding = np.argmax(fits, axis=0)  # the smallest alphabet that has all symbols
    k = _SIZE[encoding]
    order = _ORDER[encoding[owner], tokens]
    # chi-squared over m equal cells, m growing with the length
    m = np.minimum(np.clip(n // 5, 2, 16), k)
    cell = order * m[owner] // k[owner]
    count = np.bincount(owner * 16 + cell, minlength=len(n) * 16).reshape(-1, 16)
    edge = np.ceil(np.arange(17)[None, :] * k[:, None] / m[:, None])
    symbols = edge[:, 1:] - edge[:, :-1]
    used = np.arange(16)[None, :] < m[:, None]
    expected = np.where(used, n[:, None] * symbols / k[:, None], 1.0)
    chi = (np.where(used, (count - expected) ** 2 / expected, 0.0)).sum(axis=1)
    df = m - 1.0
    p_chi = _normal_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)))
    # runs above and below the middle of the alphabet
    high = order * 2 >= k[owner]
    n1 = np.add.reduceat(high.astype(np.int64), off[:-1])
    n2 = n - n1
    turn = np.zeros(len(tokens), dtype=np.int64)
    turn[1:] = (high[1:] != high[:-1]) & (owner[1:] == owner[:-1])
    runs = np.add.reduceat(turn, off[:-1]) + 1
    mean = 2 * n1 * n2 / n + 1
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / np.maximum(n - 1, 1), 1e-9))
    one_sided = (n1 == 0) | (n2 == 0)
    p_runs = np.where(one_sided, 2.0 ** (1.0 - np.minimum(n, 900)),
                      2 * _normal_tail(np.abs(runs - mean) / spread))
    # serial correlation of neighbours
    centred = order - (np.add.reduceat(order, off[:-1]) / n)[owner]
    square = np.add.reduceat(centred ** 2, off[:-1])
    product = np.zeros(len(tokens))
    product[1:] = centred[1:] * centred[:-1] * (owner[1:] == owner[:-1])
    serial = np.add.reduceat(product, off[:-1]) / np.maximum(square, 1e-9)
    p_serial = np.where(square > 0, 2 * _normal_tail(np.abs(serial + 1 / n) * np.sqrt(n)), 1e-300)
    h = -(np.log(p_chi) + np.log(np.minimum(p_runs, 1)) + np.log(np.minimum(p_serial, 1)))
    return np.exp(-h) * (1 + h + h * h / 2)


def score_bins(p: np.ndarray) -> np.ndarray:
    return np.minimum(-np.log10(np.maximum(p, 1e-300)) * BINS_A_POWER, LAST_BIN).astype(np.int64)


def _long_runs(data, off, table, least):
    """Starts, ends and rows of the runs of the table's bytes."""
    start, end, first = words.spans(data, off, table)
    at = np.flatnonzero(end - start >= least)
    return start[at], end[at], words.rows_of(at, first)


def _scan(data: np.ndarray, off: np.ndarray):
    """Per row: base spans (kind, start, end), candidates (start, end, class, bin), codes of wording."""
    rows = len(off) - 1
    base: list[list] = [[] for _ in range(rows)]
    found: list[list] = [[] for _ in range(rows)]
    wording: list[list] = [[] for _ in range(rows)]
    for s, e, r in zip(*[x.tolist() for x in _long_runs(data, off, _HEX, HEX_LENGTH)], strict=True):
        base[r].append((2, s, e))
    raw = data.tobytes()
    for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        text = raw[a:b]
        if b"AKIA" in text:
            base[r] += [(1, a + x.start(), a + x.end()) for x in ACCESS.finditer(text)
                        if x.end() - x.start() >= ACCESS_LENGTH]
        if b"=" in text or b":" in text:
            low = text.lower()
            if any(k in low for k in _KEYWORDS):
                base[r] += [(0, a + x.start(), a + x.end()) for x in ASSIGN.finditer(text)
                            if x.end(2) - x.start(2) >= ASSIGN_LENGTH]
    start, end, row = _long_runs(data, off, _TOKEN, LEAST_LENGTH)
    if len(start):
        size = end - start
        token_off = np.concatenate([[0], np.cumsum(size)])
        tokens = data[np.repeat(start - token_off[:-1], size) + np.arange(token_off[-1])]
        total = lambda table: np.add.reduceat(table[tokens].astype(np.int64), token_off[:-1])
        digits, low, up = total(_IS_DIGIT), total(_IS_LOW), total(_IS_UP)
        capital = _IS_UP[data[start]]
        # letters in one case, a capital at most in front
        plain = (low + up == size) & ((low == 0) | (up - capital == 0))
        mixed = ((digits > 0) & (low + up > 0)) | ((low > 0) & (up - capital > 0)) | (digits == size)
        bins = score_bins(randomness(tokens, token_off))
        classes = np.searchsorted(LENGTH_CLASSES, size, side="right") - 1
        for s, e, r, c, b, is_plain, is_mixed in zip(*[x.tolist() for x in (
                start, end, row, classes, bins, plain, mixed)], strict=True):
            if is_plain or NAME.fullmatch(raw, s, e):
                wording[r].append(c * 1000 + b)
            elif is_mixed:
                found[r].append((s, e, c, b))
    for r in range(rows):
        if base[r] or found[r]:
            a = int(off[r])
            points = np.cumsum((data[a:int(off[r + 1])] & 0xC0) != 0x80)
            place = lambda x, a=a, points=points: int(points[x - a - 1]) if x > a else 0
            base[r] = [(k, place(s), place(e)) for k, s, e in base[r]]
            found[r] = [(place(s), place(e), c, b) for s, e, c, b in found[r]]
    return base, found, wording


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("bin", pa.int32())])


def scan(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), ``base`` spans, ``found`` candidates and ``wording`` codes."""
    kept = docs.columns if keep is None else keep

    def run(batches):
        for batch in batches:
            row = 0
            for _, data, off in words.chunks(batch.column("__text")):
                base, found, wording = _scan(data, off)
                own = batch.slice(row, len(base))
                yield pa.RecordBatch.from_arrays([own.column(c) for c in kept] + [
                    pa.array([[{"start": s, "kind": k, "end": e} for k, s, e in x] for x in base],
                             type=pa.list_(_SPAN)),
                    pa.array([[{"start": s, "end": e, "class": c, "bin": b} for s, e, c, b in x] for x in found],
                             type=pa.list_(_FOUND)),
                    pa.array(wording, type=pa.list_(pa.int32()))], names=[*kept, "base", "found", "wording"])
                row += len(base)

    source = docs.select(*kept, F.col(text_col).alias("__text"))
    schema = T.StructType([source.schema[c] for c in kept] + [
        T.StructField("base", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()),
            T.StructField("end", T.LongType())]))),
        T.StructField("found", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
            T.StructField("class", T.IntegerType()), T.StructField("bin", T.IntegerType())]))),
        T.StructField("wording", T.ArrayType(T.IntegerType()))])
    ship_package(docs.sparkSession)
    return source.mapInArrow(run, schema)


#: Ordinary words whose runs are wording in every table.
SHIPPED_WORDS = """about after again answer before better between business change children company country course different
every example family father follow friend general government great group house important interest large letter little
living member moment money morning mother mountain nothing number office other people person picture place point power
present problem question reason research result school service several should something story street student summer
system teacher thing thought through together under village water weather without woman world writing""".split()


def _shipped_null() -> dict[int, int]:
    """Counts of the shipped wording by length class and bin (class * 1000 + bin)."""
    n = len(SHIPPED_WORDS)
    runs = [SHIPPED_WORDS[i] + SHIPPED_WORDS[(i * 7 + j) % n] + SHIPPED_WORDS[(i + j * 11) % n] * (j % 2)
            + SHIPPED_WORDS[(i * 3 + j * 5) % n] * (j % 3) for i in range(n) for j in range(1, 37)]
    data = " ".join(runs).encode()
    _, _, wording = _scan(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
    values, counts = np.unique(np.array(wording[0], dtype=np.int64), return_counts=True)
    return dict(zip(values.tolist(), counts.tolist(), strict=True))


def thresholds(scanned: DataFrame, false_share: float = FALSE_SHARE) -> list[int]:
    """Per length class, the last score bin that is flagged (-1: none), by Benjamini-Hochberg."""
    seen = scanned.select(F.explode("found").alias("x")).select(
        F.col("x.class").alias("class"), F.col("x.bin").alias("bin"), F.lit(1).alias("c"), F.lit(0).alias("w"))
    null = scanned.select(F.explode("wording").alias("x")).select(
        (F.col("x") / 1000).cast("int").alias("class"), (F.col("x") % 1000).alias("bin"),
        F.lit(0).alias("c"), F.lit(1).alias("w"))
    shipped = scanned.sparkSession.createDataFrame(
        [(v // 1000, v % 1000, 0, c) for v, c in _shipped_null().items()], "class int, bin int, c int, w int")
    counted = seen.unionByName(null).unionByName(shipped).groupBy("class", "bin").agg(F.sum("c").alias("c"), F.sum("w").alias("w"))
    # shorter wording looks more random, so it may stand in the null of longer classes, which have less
    further = counted.where("w > 0").select(
        F.explode(F.sequence(F.col("class") + 1, F.lit(len(LENGTH_CLASSES)))).alias("class"), "bin",
        F.lit(0).cast("long").alias("c"), "w").where(F.col("class") < len(LENGTH_CLASSES))
    counts = counted.unionByName(further).groupBy("class", "bin").agg(F.sum("c").alias("c"), F.sum("w").alias("w"))
    upto = W.partitionBy("class").orderBy("bin")
    every = W.partitionBy("class")
    ranked = counts.select(
        "class", "bin", F.sum("c").over(upto).alias("flagged"), F.sum("c").over(every).alias("m"),
        ((1 + F.sum("w").over(upto)) / (1 + F.sum("w").over(every))).alias("p"))
    last = ranked.where(F.col("p") * F.col("m") <= false_share * F.col("flagged")) \
        .groupBy("class").agg(F.max("bin").alias("bin")).collect()  # a row a length class
    by_class = {r["class"]: r["bin"] for r in last}
    return [by_class.get(c, -1) for c in range(len(LENGTH_CLASSES))]


def find(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None,
         false_share: float = FALSE_SHARE) -> DataFrame:
    """``keep`` columns and ``spans``: start, kind (index in KINDS) and end of every secret, in order."""
    kept = docs.columns if keep is None else keep
    refuse_clash(kept, ["spans", "base", "found", "wording"])
    scanned = stored(scan(docs, text_col=text_col, keep=kept), "secrets")
    last = F.array(*[F.lit(b) for b in thresholds(scanned, false_share)])
    flagged = F.filter("found", lambda x: (x["bin"] <= F.get(last, x["class"])) & ~F.exists(
        "base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    added = F.transform(flagged, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")))
    return scanned.select(*kept, F.sort_array(F.concat("base", added)).alias("spans"))


def masked(docs: DataFrame, *, text_col: str = "text", mask: str = "[secret]", **options) -> DataFrame:
    """The documents with every secret replaced by ``mask`` (overlapping spans by one)."""
    found = find(docs, text_col=text_col, **options)
    text = F.col(text_col)
    state = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("end")), lambda s, x: F.struct(
        F.when(x["start"] >= s["end"], F.concat(
            s["out"], F.substring(text, (s["end"] + 1).cast("int"), (x["start"] - s["end"]).cast("int")), F.lit(mask)))
        .otherwise(s["out"]).alias("out"), F.greatest(s["end"], x["end"]).alias("end")))
    cut = found.withColumn("__s", state)
    whole = F.concat(F.col("__s.out"), F.substring(text, (F.col("__s.end") + 1).cast("int"), F.length(text)))
    return cut.withColumn(text_col, F.when(text.isNotNull(), whole)).select(*docs.columns)
