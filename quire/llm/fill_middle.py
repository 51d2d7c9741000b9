r"""Fill-in-middle transformation over a piece table.

A document is a list of descriptors ``(buffer, start, length)`` over two
buffers that never change: its own text (0) and the sentinels (1), in bytes.
It begins as one descriptor of the whole text.  Cutting splits descriptors,
an arrangement permutes the parts and puts sentinel descriptors between them,
and nothing is copied before the output is written; hashes are streamed from
the descriptors.

A text is cut at line ends: its units are ``[^\n]*\n|[^\n]+``, n in number.
The key digits h1 to h4 are the first four groups of eight hex digits of the
SHA-256 of ``<seed>:<id>``.  The prefix ends after the smaller of h1 % (n + 1)
and h2 % (n + 1) units, the middle after the larger, the suffix is the rest.
The form is

* ``plain``: the text as it is, if it is empty, holds a sentinel, or h3 % 100
  is not below ``rate``;
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, if h4 % 100 is below ``spm``;
* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle otherwise.

A text of the last two forms holds no sentinel, and no sentinel begins with a
character that another one ends with, so the three sentinels are found again
in an output without doubt: ``restore`` cuts the output there and applies the
inverse permutation.

A null text is an empty one.  A null id is keyed as the empty string, rows
that share an id are cut by the same digits, and repeated rows give equal
rows.  An empty table gives an empty result.  Of other columns those in
``keep`` are carried along; one with the name of a written column is refused
with an error.  Rows are independent: there is no shuffle, and a text of any
length costs one pass over its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import words
from quire.llm.common import refuse_clash, ship_package

TEXT, SENTINEL = 0, 1
#: The sentinel buffer and the descriptors of its three sentinels.
SENTINELS = b"<P><S><M>"
PREFIX, SUFFIX, MIDDLE = (SENTINEL, 0, 3), (SENTINEL, 3, 3), (SENTINEL, 6, 3)
#: Which part follows which sentinel in an output; parts are 0 prefix, 1 middle, 2 suffix.
ARRANGED = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
PLAIN = "plain"
SEED = "7"
RATE = 100
SPM = 50

Pieces = list[tuple[int, int, int]]

_DESCRIPTORS = "pieces array<struct<buffer: int, start: bigint, length: bigint>>"
_MADE = (f"n long, form string, prefix_chars long, middle_chars long, {_DESCRIPTORS}, "
         "output string, output_sha256 string")
_RESTORED = "restored string, restored_sha256 string"


def cut(pieces: Pieces, at: int) -> tuple[Pieces, Pieces]:
    """The descriptors of the first ``at`` bytes and those of the rest; one that lies over the cut is split."""
    left, right = [], []
    for buffer, start, length in pieces:
        inside = min(max(at, 0), length)
        if inside:
            left.append((buffer, start, inside))
        if inside < length:
            right.append((buffer, start + inside, length - inside))
        at -= length
    return left, right


def arrange(parts: list[Pieces], form: str) -> Pieces:
    """The parts in the order of a form, each behind its sentinel."""
    return [piece for sentinel, part in ARRANGED[form] for piece in (sentinel, *parts[part])]


def inverse(pieces: Pieces, output: bytes, form: str) -> Pieces:
    """Descriptors over an output, without its sentinels and in the order of the text."""
    parts: list[Pieces] = [[], [], []]
    marks = [SENTINELS[s:s + n] for (_, s, n), _ in ARRANGED[form]]
    places = [0]
    for mark in marks[1:]:
        places.append(output.index(mark, places[-1] + len(marks[0])))
    rest, done = pieces, 0
    for i, (_, part) in enumerate(ARRANGED[form]):
        _, rest = cut(rest, places[i] + len(marks[i]) - done)
        done = places[i + 1] if i + 1 < len(places) else len(output)
        parts[part], rest = cut(rest, done - places[i] - len(marks[i]))
    return [piece for part in parts for piece in part]


def stream(pieces: Pieces, buffers: tuple) -> Iterator[memoryview]:
    """The bytes of the descriptors, one after another, uncopied."""
    for buffer, start, length in pieces:
        yield buffers[buffer][start:start + length]


def _sha256(pieces: Pieces, buffers: tuple) -> str:
    digest = hashlib.sha256()
    for part in stream(pieces, buffers):
        digest.update(part)
    return digest.hexdigest()


def key_digits(name: str | None, seed: str) -> list[int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"{seed}:{name or ''}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def _describe(raw: np.ndarray, digits: list[int], rate: int, spm: int):
    """(units, form, code points of prefix and middle, descriptors) of one text."""
    ends = np.flatnonzero(raw == 10) + 1
    size = len(raw)
    n = len(ends) + int(size > (ends[-1] if len(ends) else 0))
    whole: Pieces = [(TEXT, 0, size)] if size else []
    text = raw.tobytes()
    h1, h2, h3, h4 = digits
    if not size or h3 % 100 >= rate or any(SENTINELS[s:s + k] in text for _, s, k in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, whole
    form = "spm" if h4 % 100 < spm else "psm"
    low, high = (0 if not j else int(ends[j - 1]) if j <= len(ends) else size
                 for j in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, rest = cut(whole, low)
    middle, suffix = cut(rest, high - low)
    points = (raw & 0xC0) != 0x80  # the first byte of each code point
    return (n, form, int(np.count_nonzero(points[:low])), int(np.count_nonzero(points[low:high])),
            arrange([prefix, middle, suffix], form))


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    raw, off = words.utf8(column)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield raw[a:b]


def _runs(batches, size_col: str):
    """Arrow batches in slices of bounded bytes, so that outputs are bounded too."""
    for batch in batches:
        row = 0
        for _, _, off in words.chunks(batch.column(size_col), 8 << 20):
            yield batch.slice(row, len(off) - 1)
            row += len(off) - 1


def _schema(docs: DataFrame, kept: list[str], fields: str) -> T.StructType:
    return T.StructType([docs.schema[c] for c in kept] + T.StructType.fromDDL(fields).fields)


def _batch(own: pa.RecordBatch, kept: list[str], schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    made = schema.fields[len(kept):]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(made)
    arrays = [pa.array(values, type=to_arrow_type(f.dataType)) for f, values in zip(made, columns, strict=True)]
    return pa.RecordBatch.from_arrays([own.column(c) for c in kept] + arrays, names=kept + [f.name for f in made])


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
              seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Every document in its form: the ``keep`` columns (the id alone by default) and

    ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars`` (code points; null if plain),
    ``pieces`` (the descriptors of the output, in bytes), ``output`` and ``output_sha256``.
    """
    kept = keep or [id_col]
    schema = _schema(docs, kept, _MADE)
    refuse_clash(kept, [f.name for f in schema.fields[len(kept):]])
    ship_package(docs.sparkSession)

    def run(batches):
        sentinels = memoryview(SENTINELS)
        for own in _runs(batches, "__text"):
            rows = []
            for name, raw in zip(own.column("__id").to_pylist(), _texts(own.column("__text")), strict=True):
                n, form, prefix, middle, pieces = _describe(raw, key_digits(name, seed), rate, spm)
                buffers = (memoryview(raw), sentinels)
                rows.append((n, form, prefix, middle, [dict(zip(("buffer", "start", "length"), p, strict=True))
                                                       for p in pieces],
                             b"".join(stream(pieces, buffers)).decode("utf-8"), _sha256(pieces, buffers)))
            yield _batch(own, kept, schema, rows)

    return docs.select(*[F.col(c) for c in kept], F.col(id_col).cast("string").alias("__id"),
                       F.col(text_col).alias("__text")).mapInArrow(run, schema)


def restore(made: DataFrame, *, output_col: str = "output", form_col: str = "form",
            keep: list[str] | None = None) -> DataFrame:
    """The exact texts, rebuilt from outputs and forms alone: ``restored`` and ``restored_sha256``."""
    kept = keep or ["doc_id"]
    schema = _schema(made, kept, _RESTORED)
    refuse_clash(kept, [f.name for f in schema.fields[len(kept):]])
    ship_package(made.sparkSession)

    def run(batches):
        for own in _runs(batches, "__output"):
            rows = []
            for form, raw in zip(own.column("__form").to_pylist(), _texts(own.column("__output")), strict=True):
                pieces: Pieces = [(TEXT, 0, len(raw))] if len(raw) else []
                if form in ARRANGED:
                    pieces = inverse(pieces, raw.tobytes(), form)
                buffers = (memoryview(raw),)
                rows.append((b"".join(stream(pieces, buffers)).decode("utf-8"), _sha256(pieces, buffers)))
            yield _batch(own, kept, schema, rows)

    return made.select(*[F.col(c) for c in kept], F.col(form_col).alias("__form"),
                       F.col(output_col).alias("__output")).mapInArrow(run, schema)
