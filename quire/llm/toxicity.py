"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one on ordinary
wording and one on toxic wording.  A text is cut into windows (a run of
letters with its borders, at most ``WINDOW_BYTES``), each window is compressed
with the ordinary dictionary and with the ordinary and toxic one together, and
the bytes that the toxic dictionary saves are compared:

* per window, the saving is turned into a log likelihood ratio by thresholds
  calibrated on labelled windows that the dictionaries were not trained on;
* per passage, the ratios are summed; a window that speaks for toxicity counts
  once a passage, so repeats do not add up.  Passages are the whole text and
  overlapping runs of ``PASSAGE`` windows and of 4, 16, ... times as many;
* per text, the largest sum of its passages is calibrated to a probability.
  Clean text before or behind a passage takes nothing from it.

Only the text is used for a score.  The fit uses a bounded sample: at most
``TRAIN_TOXIC`` and ``TRAIN_ORDINARY`` labelled rows in the order of the hash
of their id, of texts up to ``TRAIN_TEXT_BYTES``; scoring reads whole texts of
all rows.

One half of the sample trains the dictionaries and the other calibrates, at every
size.  Without toxic or ordinary rows in both halves, or without wording that
tells them apart, every score is the (smoothed) base rate.  A null or empty text scores what a text without windows scores.
Repeated rows get equal scores, an empty table gives an empty result.  A
label of a null id, or a null label, is not used; of several labels for one
id the highest holds.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import words
from quire.llm.common import ship_package

TRAIN_TOXIC = 2000
TRAIN_ORDINARY = 4000
TRAIN_TEXT_BYTES = 32_000
#: Sizes of the trained dictionaries.
ORDINARY_BYTES = 8192
TOXIC_BYTES = 4096
#: Words an ordinary dictionary is trained on.
ORDINARY_WORDS = 150_000
#: How much more often toxic wording must stand in toxic texts than in ordinary ones.
RARITY = 15
WINDOW_BYTES = 48
#: Windows in the shortest passages of a text; passages start every half of their length.
PASSAGE = 256
PREDICT_AT = 0.7
#: Cached windows a worker; the cache starts anew beyond it.
CACHE_ENTRIES = 1_500_000
#: Bytes of text that are scored at a time; array memory is a small multiple of it.
SCORE_BYTES = 1 << 20
#: Savings are counted in this range.
LEAST, MOST = -4, 10

_LETTERS = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_WORD = re.compile(r"[^\W\d_]+")
# A head that either dictionary ends with, so that the block is always stored
# compressed, and a tail of other bytes, as the compressor starts no match in
# the last eight.
_HEAD = bytes(range(1, 32)) + bytes(range(128, 160))
_TAIL = bytes(range(200, 208))


@dataclass(frozen=True)
class Model:
    """What a score needs: two dictionaries and the calibration."""

    ordinary: bytes = b""
    toxic: bytes = b""
    ratios: tuple[float, ...] = field(default_factory=tuple)  # by saving, from LEAST to MOST
    slope: float = 0.0
    offset: float = math.log(0.5 / 1.5)

    @property
    def key(self) -> str:
        return hashlib.sha256(repr((self.ordinary, self.toxic, self.ratios)).encode()).hexdigest()


def _compressor(content: bytes):
    import zstandard as z

    how = z.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=4, target_length=16,
        strategy=z.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    content = z.ZstdCompressionDict(content + _HEAD, dict_type=z.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=how)
    return z.ZstdCompressor(dict_data=content, compression_params=how)


class Scorer:
    """Scores columns of texts under one model, each distinct window once."""

    def __init__(self, model: Model):
        self.model = model
        self.plain = _compressor(model.ordinary)
        self.with_toxic = _compressor(model.toxic + model.ordinary)
        self.keys = np.zeros(0, dtype=np.uint64)
        self.saved = np.zeros(0, dtype=np.int8)

    def savings(self, column: pa.Array):
        """(saving and code of every window, index of each row's first window) for runs of rows."""
        column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
        for _, data, off in words.chunks(column, SCORE_BYTES):
            start, end, first = _windows(data, off)
            if not len(start):
                yield np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), first
                continue
            codes, distinct = pd.factorize(words.word_hashes(data, start, end))
            if len(self.keys) + len(distinct) > CACHE_ENTRIES:
                self.keys, self.saved = self.keys[:0], self.saved[:0]
            at = self._places(distinct)
            known = at >= 0
            if not known.all():
                some = np.empty(len(distinct), dtype=np.int64)
                some[codes] = np.arange(len(codes))
                some = some[~known]
                self._learn(distinct[~known], [
                    data[a:b].tobytes() for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
                at = self._places(distinct)
            yield self.saved[at][codes].astype(np.int64), codes, first

    def _places(self, distinct: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, distinct)
        inside = at < len(self.keys)
        hit = np.zeros(len(distinct), dtype=bool)
        hit[inside] = self.keys[at[inside]] == distinct[inside]
        return np.where(hit, at, -1)

    def _learn(self, keys: np.ndarray, windows: list[bytes]) -> None:
        plain, with_toxic = self.plain.compress, self.with_toxic.compress
        saved = np.empty(len(windows), dtype=np.int64)
        for i, w in enumerate(windows):
            block = _HEAD + b" " + w + b" " + _TAIL
            saved[i] = len(plain(block)) - len(with_toxic(block))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.saved = np.insert(self.saved, at, np.clip(saved, LEAST, MOST).astype(np.int8)[order])

    def sums(self, column: pa.Array) -> np.ndarray:
        """Largest summed log likelihood ratio of each text's passages."""
        ratios = np.array(self.model.ratios)
        out = [np.zeros(0)]
        for saved, codes, first in self.savings(column):
            best = np.full(len(first) - 1, -np.inf)
            hits = np.flatnonzero(saved >= 2)
            gain = ratios[saved[hits] - LEAST] - ratios[-LEAST]
            saved[hits] = 0
            total = np.concatenate([[0.0], np.cumsum(ratios[saved - LEAST])])
            for row, start, end in _passages(first):
                passage, at = _distinct_hits(hits, codes, start, end)
                sums = total[end] - total[start] + np.bincount(passage, gain[at], len(start))
                np.maximum.at(best, row, sums)
            out.append(best)
        return np.concatenate(out)

    def scores(self, column: pa.Array) -> np.ndarray:
        if not self.model.ratios:
            return np.full(len(column), _logistic(np.array(self.model.offset)))
        return _logistic(self.model.slope * self.sums(column) + self.model.offset)


def _passages(first: np.ndarray):
    """(row, first window, last window + 1) of passages: whole texts, then the runs of each length."""
    counts = np.diff(first)
    yield np.arange(len(counts)), first[:-1], first[1:]
    length = PASSAGE
    while (longer := np.flatnonzero(counts > length)).size:
        step = length // 2
        room = counts[longer] - length
        many = -(-room // step) + 1
        row = np.repeat(longer, many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = first[row] + np.minimum(nth * step, np.repeat(room, many))  # the last ends with its text
        yield row, start, start + length
        length *= 4


def _distinct_hits(hits: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(passage, index in ``hits``) of the hits in each passage, of equal windows the first only."""
    low, high = np.searchsorted(end, hits, side="right"), np.searchsorted(start, hits, side="right")
    many = high - low
    at = np.repeat(np.arange(len(hits)), many)
    passage = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    if not len(at):
        return passage, at
    _, kept = np.unique(passage * (int(codes.max()) + 1) + codes[hits[at]], return_index=True)
    return passage[kept], at[kept]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _windows(data: np.ndarray, off: np.ndarray):
    """Letter runs, the long ones in windows of WINDOW_BYTES."""
    start, end, first = words.spans(data, off, _LETTERS)
    more = (end - start - 1) // WINDOW_BYTES
    if more.any():
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        cut = np.repeat(start, more) + step * WINDOW_BYTES
        start = np.sort(np.concatenate([start, cut]))
        end = np.sort(np.concatenate([end, cut]))
        first = np.searchsorted(start, off)
    return start, end, first


def _trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary, or plainly the samples where there are too few to train one."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _contexts(texts: list[str]) -> dict[str, int]:
    """In how many different surroundings each word stands; copies of a passage add none."""
    # numbers of words end to end, 0 around each text: arrays take less memory than sets
    number, run = {"": 0}, array.array("i", [0])
    for text in texts:
        run.extend(number.setdefault(w, len(number)) for w in _WORD.findall(text.lower()))
        run.append(0)
    code = np.array(run, dtype=np.int64)
    at = np.flatnonzero(code)
    # the surroundings get numbers, so that a word and its surroundings fit one number
    around = np.unique(code[at - 1] * len(number) + code[at + 1], return_inverse=True)[1]
    placed = np.unique(code[at] * (len(at) + 1) + around) // (len(at) + 1)
    counts = np.bincount(placed, minlength=len(number)).tolist()
    return {w: counts[i] for w, i in number.items() if i}


def _telling(some: dict[str, int], rest: dict[str, int], least: int) -> dict[str, int]:
    """Words in at least ``least`` surroundings, and far more often than in the rest."""
    n_some, n_rest = sum(some.values()), sum(rest.values())
    return {w: n for w, n in some.items()
            if n >= least and n * n_rest > RARITY * (rest.get(w, 0) + 1) * n_some}


def _wording(toxic: list[str], ordinary: list[str]) -> dict[str, int]:
    """Words that tell toxic texts from ordinary ones, with their number of surroundings.

    The least number is the smallest at which ordinary texts, put to the same
    test against other ordinary texts, yield at most a twentieth as many words.
    """
    in_toxic, in_ordinary = _contexts(toxic), _contexts(ordinary)
    mock = ordinary[:max(1, min(len(toxic), len(ordinary) // 2))]
    in_mock, in_others = _contexts(mock), _contexts(ordinary[len(mock):])
    for least in range(3, 60):
        real = _telling(in_toxic, in_ordinary, least)
        chance = len(_telling(in_mock, in_others, least)) * len(toxic) / len(mock)
        if chance <= len(real) / 20:
            return real
    return {}


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Train the dictionaries on one half of the texts and calibrate on the other."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    rate = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1.5)
    flat = Model(offset=math.log(rate / (1 - rate)))
    if min(len(toxic), len(ordinary)) < 2:  # a half would be empty
        return flat
    learn = lambda x: x[::2]
    check = lambda x: x[1::2]
    wording = _wording(learn(toxic), learn(ordinary))
    if not wording:
        return flat
    bordered = lambda w: f" {w} ".encode()
    n_plain = sum(len(_WORD.findall(t.lower())) for t in learn(ordinary))
    plain = itertools.islice((w for t in learn(ordinary) for w in _WORD.findall(t.lower())),
                             0, None, max(1, n_plain // ORDINARY_WORDS))
    by_hash = sorted((hashlib.md5(f"{w}/{i}".encode()).digest(), w) for w in wording for i in range(min(wording[w], 60)))
    toxic_part = _trained([bordered(w) for _, w in by_hash], TOXIC_BYTES)
    # what the trainer left out goes behind it, the most telling last, in the room that is left
    left_out = [bordered(w) for w in sorted(wording, key=lambda w: (wording[w], w)) if bordered(w) not in toxic_part]
    model = Model(ordinary=_trained([bordered(w) for w in plain], ORDINARY_BYTES),
                  toxic=toxic_part + b"".join(left_out)[-TOXIC_BYTES:])
    scorer = Scorer(model)

    def histogram(texts):
        counts = Counter()
        for saved, codes, first in scorer.savings(pa.array(texts, type=pa.large_string())):
            # side by side, so that a passage counts its windows as a score does
            start = np.concatenate([np.arange(a, b, PASSAGE) for a, b in zip(first[:-1], first[1:], strict=True)])
            hits = np.flatnonzero(saved >= 2)
            _, once = _distinct_hits(hits, codes, start, np.append(start[1:], len(saved)))
            again = np.delete(hits, once)
            saved[again] = 0
            counts.update((saved - LEAST).tolist())
        return counts

    t, o = histogram(check(toxic)), histogram(check(ordinary))
    n_t, n_o = sum(t.values()), sum(o.values())
    if not n_t or not n_o:
        return flat
    ratios = np.array([math.log((t[i] + 0.5) / (n_t + 1) / ((o[i] + 1) / (n_o + 1)))
                       for i in range(MOST - LEAST + 1)])
    ratios[:2 - LEAST] = np.minimum(ratios[:2 - LEAST], 0.5)   # a saving under two bytes is chance
    ratios[2 - LEAST:] = np.maximum.accumulate(ratios[2 - LEAST:])  # more saved is never less toxic
    scorer.model = Model(model.ordinary, model.toxic, tuple(ratios.tolist()))
    x = scorer.sums(pa.array(check(toxic) + check(ordinary), type=pa.large_string()))
    y = np.array([1.0] * len(check(toxic)) + [0.0] * len(check(ordinary)))
    slope, offset = _calibrate(x, y)
    del scorer, x, y
    pa.default_memory_pool().release_unused()  # else the process keeps what the sample took
    return Model(model.ordinary, model.toxic, tuple(ratios.tolist()), slope, offset)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of one variable with smoothed targets, by Newton steps."""
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-6, np.abs(x).mean())
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(100):
        p = _logistic(design @ beta)
        gradient = design.T @ (goal - p) - 1e-3 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(max(0.0, beta[0]) / scale), float(beta[1])


def _sample(docs: DataFrame, labels: DataFrame, usable: Column | None, id_col: str, text_col: str,
            label_col: str) -> tuple[DataFrame, list[Column]]:
    """(__id, __label, __text) of the bounded sample, and its order: by the hash of the ids."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    one = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    order = [F.md5(F.col("__id").cast("string").cast("binary")), F.col("__id")]
    picked = (one.where("__label = 1").orderBy(*order).limit(TRAIN_TOXIC)
              .unionAll(one.where("__label = 0").orderBy(*order).limit(TRAIN_ORDINARY)))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")) \
        .where(F.octet_length("__text") <= TRAIN_TEXT_BYTES)
    # at most TRAIN_TOXIC + TRAIN_ORDINARY ids, whatever the tables hold
    return texts.join(F.broadcast(picked), "__id").groupBy("__id").agg(
        F.max("__label").alias("__label"), F.min("__text").alias("__text")), order


def training_texts(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[str]]:
    """The bounded sample: (toxic texts, ordinary texts), in the order of their ids' hash."""
    sample, order = _sample(docs, labels, usable, id_col, text_col, label_col)
    rows = sample.orderBy(*order).collect()
    return [r["__text"] for r in rows if r["__label"] == 1], [r["__text"] for r in rows if r["__label"] == 0]


def learned(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, id_col: str = "doc_id",
            text_col: str = "text", label_col: str = "toxic") -> Model:
    """What ``fit`` gives for ``training_texts``, made in a task: the driver gets the model only.

    A driver that has fitted keeps the memory of it for as long as it runs.
    """
    sample, order = _sample(docs, labels, usable, id_col, text_col, label_col)

    def fitted(batches):
        toxic, ordinary = [], []
        for batch in batches:
            for label, text in zip(batch.column("__label").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                if label in (0, 1):
                    (toxic if label == 1 else ordinary).append(text.decode("utf-8", "replace"))
        model = fit(toxic, ordinary)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.ordinary], type=pa.binary()), pa.array([model.toxic], type=pa.binary()),
             pa.array([list(model.ratios)], type=pa.list_(pa.float64())), pa.array([model.slope]), pa.array([model.offset])],
            names=["ordinary", "toxic", "ratios", "slope", "offset"])

    ship_package(docs.sparkSession)
    row = (sample.repartition(1).sortWithinPartitions(*order)
           .select("__label", F.col("__text").cast("binary").alias("__text"))
           .mapInArrow(fitted, "ordinary binary, toxic binary, ratios array<double>, slope double, offset double").first())
    if row is None:  # an empty sample may have no task
        return fit([], [])
    return Model(bytes(row["ordinary"]), bytes(row["toxic"]), tuple(row["ratios"]), row["slope"], row["offset"])


_SCORERS: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None,
          score_col: str = "score") -> DataFrame:
    """The columns in ``keep`` (all by default) and the score of every row."""
    kept = docs.columns if keep is None else keep
    read = text_col if text_col in kept else "__text"  # the text goes to Python once

    def scored(batches):
        scorer = _scorer(model)
        for batch in batches:
            values = scorer.scores(batch.column(read))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(values, type=pa.float64())], names=[*kept, score_col])

    schema = docs.select(*kept).schema.add(score_col, "double")
    ship_package(docs.sparkSession)
    source = docs.select(*kept) if read == text_col else docs.select(*kept, F.col(text_col).alias(read))
    return source.mapInArrow(scored, schema)


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", at: float = PREDICT_AT) -> DataFrame:
    """The rows that score under ``at``, with the input's columns."""
    return score(docs, model, text_col=text_col, score_col="__score").where(F.col("__score") < at).drop("__score")
