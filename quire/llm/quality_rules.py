"""Quality rules: a table of thresholds compiled into one Spark projection.

Each rule bounds one metric of a text; a text is kept when every rule holds.
Metrics are counts and ratios of words, symbols, stop words and lines, all
built-in functions on the row itself, so there is no shuffle.

A null or empty text has no words and fails the base rules.  Rows are judged
one by one: repeated rows and ties get equal verdicts, an empty table gives an
empty result.  The input's own columns named like a metric are left out of
the metrics' way: the operator only reads the id and text columns it is given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import once, words

WINDOW = 5

#: Frequent function words of the corpus languages (en, de, fr, es).
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this",
    "are", "or", "an", "from", "at", "have", "not", "der", "die", "und", "das", "den", "von", "zu", "mit", "sich",
    "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "le", "la", "les", "de",
    "et", "un", "une", "du", "que", "qui", "dans", "pour", "est", "pas", "sur", "par", "au", "en", "el", "los",
    "las", "y", "se", "del", "por", "con", "para", "su", "al", "lo", "como", "no", "más",
]


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; an open side is None."""

    metric: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value = F.col(self.metric)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= F.lit(self.low))
        if self.high is not None:
            ok = ok & (value <= F.lit(self.high))
        return ok


#: The base rules of the operator: enough words, few words in repeated 5-word windows.
BASE_RULES = [Rule("n_words", low=10), Rule("repeat_percent", high=20)]
#: The verdict's threshold table.
RULES = [
    Rule("mean_word_chars", low=2.0, high=15.0),
    Rule("symbol_ratio", high=0.08),
    Rule("stop_word_gap", high=2.0),
    Rule("dup_line_ratio", high=0.5),
]


def metrics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, base counts and the ratios that rules bound."""
    base = once(docs, [F.col(id_col).alias("doc_id")], text=F.coalesce(F.col(text_col), F.lit("")))
    step = once(
        base, ["doc_id"],
        words=words(F.col("text")),
        lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        n_symbols=(F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long"))
    hashed = once(
        step, ["doc_id", "n_symbols"],
        word_hashes=F.transform("words", lambda w: F.xxhash64(w)),
        word_chars=F.length(F.array_join("words", "")).cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    n = F.size("word_hashes")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get("word_hashes", i + k) for k in range(WINDOW)]))) \
        .otherwise(F.array().cast("array<bigint>"))
    stops = [F.xxhash64(F.lit(form)) for w in STOP_WORDS for form in (w, w.capitalize())]
    counted = once(
        hashed, ["doc_id", "n_symbols", "word_chars", "n_lines", "n_dup_lines"],
        n_words=n.cast("long"), hashes=windows,
        n_stop=F.size(F.filter("word_hashes", lambda h: h.isin(stops))).cast("long"))
    repeated = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform(
        "hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    sorted_ = once(counted,
                   [c for c in counted.columns if c != "hashes"], pairs=repeated)
    places = F.sort_array(F.transform(F.filter("pairs", _has_twin), lambda p: p["at"]))
    placed = once(sorted_, [c for c in sorted_.columns if c != "pairs"], places=places)
    covered = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda s, p: F.struct(
        (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    total = once(placed, [c for c in placed.columns if c != "places"],
                 n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return total.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.col("n_words") > 0, 100 * F.col("n_repeat_words") / F.col("n_words")).otherwise(F.lit(0.0))
        .alias("repeat_percent"),
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "word_chars").alias("symbol_ratio"),
        share("n_stop", "n_words").alias("stop_word_ratio"),
        # stop words short of a tenth of all words; a short text may well have none
        (F.col("n_words") / 10 - F.col("n_stop")).alias("stop_word_gap"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"))


def _has_twin(pair: Column, i: Column) -> Column:
    """Is a neighbour in hash order the same window?"""
    pairs = F.col("pairs")
    return ((i > 0) & (F.get(pairs, i - 1)["h"] == pair["h"])) | (F.get(pairs, i + 1)["h"] == pair["h"])


def judge(measured: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` and ``kept``: all rules in one projection."""
    rules = RULES if rules is None else rules
    base_ok = _all(BASE_RULES)
    failed = F.filter(F.array(*[F.when(~r.holds(), F.lit(r.metric)) for r in rules]).cast("array<string>"),
                      lambda x: x.isNotNull())
    return measured.select("*", (~base_ok).alias("base_failed"), failed.alias("failed_rules"),
                           (base_ok & _all(rules)).alias("kept"))


def _all(rules: list[Rule]) -> Column:
    out = F.lit(True)
    for r in rules:
        out = out & r.holds()
    return out


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, **cols) -> DataFrame:
    """Metrics and verdict of every document."""
    return judge(metrics(docs, **cols), rules)
