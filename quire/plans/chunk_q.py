"""Chunking queries over ``documents`` (plain and derived markup), with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunking as K
from quire.plans import sql as S
from quire.sources import archive as A

MARKUP_CAP = 2048   # the smaller part size suggested for slow links
PART_REQUESTS = [None, "parts", "1", "2", "0", "-2", "99", " 3 ", "abc", "3.7"]


def _docs(spark, sf_dir):
    # documents are CPU-bound per row (line folds): spread a single-split file over the cores
    docs = A.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # CPU-bound work per document: dealt by key over all tasks, whatever files the table has
    return docs.repartition("doc_id")


def _markup(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", K.headed_markup("text").alias("text"))


def chunk_lines(spark, sf_dir):
    return K.chunk_documents(_docs(spark, sf_dir), "doc_id", "text")


def chunk_markup(spark, sf_dir):
    return K.chunk_documents(_markup(spark, sf_dir), "doc_id", "text", MARKUP_CAP)


def chunk_line_map(spark, sf_dir):
    return K.line_chunks(_markup(spark, sf_dir), "doc_id", "text", MARKUP_CAP)


def chunk_stats(spark, sf_dir):
    return K.chunk_stats(_docs(spark, sf_dir), "doc_id", "text")


def section_index(spark, sf_dir):
    return K.section_index(_markup(spark, sf_dir), "doc_id", "text", MARKUP_CAP)


def part_index(spark, sf_dir):
    return K.part_index(_markup(spark, sf_dir), "doc_id", "text", MARKUP_CAP)


def part_select(spark, sf_dir):
    """Every document asked for each view parameter of a fixed test vector."""
    docs = _markup(spark, sf_dir)
    totals = K.chunk_stats(docs, "doc_id", "text", MARKUP_CAP).select("doc_id", "parts")
    params = F.array(*[F.lit(p) if p is not None else F.lit(None).cast("string") for p in PART_REQUESTS])
    reqs = docs.select("doc_id", F.explode(params).alias("chunk"))
    return K.select_part(reqs, totals, "doc_id")


def line_flags(spark, sf_dir):
    lines = (_markup(spark, sf_dir)
             .select("doc_id", F.posexplode(K.split_lines("text")).alias("line_no", "line")))
    out = K.prev_heading_flags(K.in_table_flags(lines, "doc_id"), "doc_id")
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                      "in_table", "prev_heading")


def collapse_blank(spark, sf_dir):
    d = _docs(spark, sf_dir)
    c = K.collapse_blank("text")
    return d.select("doc_id", c.alias("text"), T.byte_size(c).alias("bytes"))


QUERIES = {
    "chunk_lines": chunk_lines,
    "chunk_markup": chunk_markup,
    "chunk_line_map": chunk_line_map,
    "chunk_stats": chunk_stats,
    "section_index": section_index,
    "part_index": part_index,
    "part_select": part_select,
    "line_flags": line_flags,
    "collapse_blank": collapse_blank,
}

# ---------------------------------------------------------------------------
# SQL twins (DuckDB list_reduce runs the same greedy fold)
# ---------------------------------------------------------------------------
_MARKUP = ("array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), "
           "lambda x, i: CASE WHEN i = 1 THEN '>' || x "
           f"WHEN length(x) > 0 AND length(x) <= {K.SHORT_LINE_CHARS} THEN '>>' || x ELSE x END), chr(10))")


def _breaks_cte(text_expr: str, cap: int) -> str:
    th = cap * K.SECTION_NUM // K.SECTION_DEN
    strip_x = S.py_strip("x")
    return f"""
d AS (SELECT doc_id, string_split(coalesce({text_expr}, ''), chr(10)) AS l FROM documents),
f AS (
  SELECT doc_id, l, list_reduce(
    list_transform(l, lambda x, i: {{'b': CAST(strlen(x) + 1 AS BIGINT),
        'sec': starts_with(x, '>>') AND NOT starts_with(x, '>>>'),
        'fence': starts_with({strip_x}, '`t'),
        'ph': i > 1 AND starts_with(l[i - 1], '>'),
        'i': CAST(i - 1 AS INTEGER)}}),
    lambda acc, x: CASE WHEN NOT acc.tbl AND x.i > 0 AND NOT x.ph
                         AND (acc.size + x.b > {cap} OR (x.sec AND acc.size > {th}))
        THEN {{'breaks': list_append(acc.breaks, x.i), 'size': x.b, 'tbl': acc.tbl <> x.fence}}
        ELSE {{'breaks': acc.breaks, 'size': acc.size + x.b, 'tbl': acc.tbl <> x.fence}} END,
    {{'breaks': []::INTEGER[], 'size': 0::BIGINT, 'tbl': false}}).breaks AS br
  FROM d),
k AS (SELECT doc_id, l, br, unnest(generate_series(0, len(br))) AS k FROM f),
c AS (
  SELECT doc_id, l, br, CAST(k + 1 AS BIGINT) AS chunk_no,
         CASE WHEN k = 0 THEN 0 ELSE br[k] END AS s,
         CASE WHEN k = len(br) THEN len(l) ELSE br[k + 1] END AS e
  FROM k),
parts AS (
  SELECT doc_id, chunk_no, array_to_string(l[s + 1:e], chr(10)) AS text FROM c)"""


def _sections_cte() -> str:
    strip_t = S.py_strip("regexp_replace(line, '^>+', '')")
    return f""",
lines AS (
  SELECT doc_id, br, CAST(i - 1 AS BIGINT) AS line_no, l[i] AS line
  FROM (SELECT doc_id, l, br, unnest(generate_series(1, len(l))) AS i FROM f)),
secs AS (
  SELECT doc_id, CAST(len(list_filter(br, lambda b: b <= line_no)) + 1 AS BIGINT) AS chunk_no,
         line_no,
         CAST(length(line) - length(regexp_replace(line, '^>+', '')) AS INTEGER) AS level,
         {strip_t} AS title
  FROM lines
  WHERE starts_with(line, '>>') AND NOT starts_with(line, '>>>>'))"""


def _sql_chunks(text_expr: str, cap: int) -> str:
    return ("WITH " + _breaks_cte(text_expr, cap) +
            "\nSELECT doc_id, chunk_no, text, CAST(strlen(text) AS BIGINT) AS bytes FROM parts")


_SEC_SELECT = ("SELECT doc_id, chunk_no, line_no, level, title FROM secs "
               "WHERE title <> '' AND level IN (2, 3)")

ORACLE = {
    "chunk_lines": _sql_chunks("text", K.DEFAULT_CAP),
    "chunk_markup": _sql_chunks(_MARKUP, MARKUP_CAP),
    "chunk_line_map": "WITH " + _breaks_cte(_MARKUP, MARKUP_CAP) + _sections_cte() +
    "\nSELECT doc_id, line_no, CAST(len(list_filter(br, lambda b: b <= line_no)) + 1 AS BIGINT) "
    "AS chunk_no, line FROM lines",
    "chunk_stats": "WITH " + _breaks_cte("text", K.DEFAULT_CAP) + """
SELECT p.doc_id, count(*) AS parts, CAST(strlen(coalesce(any_value(dd.text), '')) AS BIGINT) AS bytes,
       CAST(max(strlen(p.text)) AS BIGINT) AS max_part_bytes,
       """ + S.human_size("CAST(strlen(coalesce(any_value(dd.text), '')) AS BIGINT)") + """ AS size_label
FROM parts p JOIN documents dd USING (doc_id) GROUP BY p.doc_id""",
    "section_index": "WITH " + _breaks_cte(_MARKUP, MARKUP_CAP) + _sections_cte() + "\n" + _SEC_SELECT,
    "part_index": "WITH " + _breaks_cte(_MARKUP, MARKUP_CAP) + _sections_cte() + """,
s3 AS (
  SELECT doc_id, chunk_no, list(title ORDER BY line_no) AS titles FROM (""" + _SEC_SELECT + """)
  GROUP BY doc_id, chunk_no)
SELECT p.doc_id, p.chunk_no, CAST(strlen(p.text) AS BIGINT) AS bytes,
       'Part ' || p.chunk_no || ' — ' || """ + S.human_size("strlen(p.text)") + """ AS label,
       CASE WHEN s3.titles IS NULL AND p.chunk_no = 1 THEN 'Introduction'
            ELSE coalesce(array_to_string(s3.titles[1:3], ', '), '') END AS sections
FROM parts p LEFT JOIN s3 USING (doc_id, chunk_no)""",
    "part_select": "WITH " + _breaks_cte(_MARKUP, MARKUP_CAP) + """,
tot AS (SELECT doc_id, count(*) AS parts FROM parts GROUP BY doc_id),
req AS (SELECT doc_id, unnest([""" + ", ".join("NULL" if p is None else f"'{p}'" for p in PART_REQUESTS) + """]) AS chunk
        FROM documents),
v AS (
  SELECT r.doc_id, r.chunk, t.parts,
         CASE WHEN r.chunk IS NULL THEN 'full' WHEN r.chunk = 'parts' THEN 'parts' ELSE 'part' END AS view,
         greatest(1, least(coalesce(CASE WHEN regexp_matches(r.chunk, '^""" + S.WS + "*[+-]?[0-9]+" + S.WS + """*$')
              THEN TRY_CAST(trim(r.chunk) AS BIGINT) END, 1), t.parts)) AS idx
  FROM req r JOIN tot t USING (doc_id))
SELECT doc_id, chunk, view, CASE WHEN view = 'part' THEN idx END AS part_no, parts AS total,
       CASE WHEN view = 'part' THEN idx > 1 END AS has_prev,
       CASE WHEN view = 'part' THEN idx < parts END AS has_next
FROM v""",
    "line_flags": "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(" + _MARKUP + """, ''), chr(10))) AS line,
  unnest(generate_series(0, len(string_split(coalesce(""" + _MARKUP + """, ''), chr(10))) - 1)) AS line_no
  FROM documents)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  coalesce(sum(CASE WHEN starts_with(""" + S.py_strip("line") + """, '`t') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 2 = 1,
    false) AS in_table,
  coalesce(starts_with(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '>'), false) AS prev_heading
FROM l""",
    "collapse_blank": """SELECT doc_id, trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS text,
  CAST(strlen(trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS BIGINT) AS bytes
FROM documents""",
}
