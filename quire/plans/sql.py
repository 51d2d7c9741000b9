"""SQL building blocks for the DuckDB oracle twins.

Each registered query has an independent SQL formulation that DuckDB runs on
the same Parquet tables.  The fragments below restate the shared data
mapping (pages -> entries) and the Python-whitespace rules in SQL.
"""

from __future__ import annotations

from quire.functions.text import PYWS_RE2
from quire.sources import archive as A

WS = PYWS_RE2


def norm_space(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g')"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def unescape(x: str) -> str:
    """The character references that occur in the test pages ('&amp;' last)."""
    out = x
    for ent, ch in [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"),
                    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        lit = ch.replace("'", "''")
        out = f"replace({out}, '{ent}', '{lit}')"
    return out


def slug(x: str) -> str:
    return (f"lower(trim(regexp_replace({py_strip(norm_space(x))}, '[^A-Za-z0-9]+', '-', 'g'), '-'))")


def escape(x: str) -> str:
    return f"replace(replace(coalesce({x}, ''), '\\', '\\\\'), '`', '\\`')"


def human_size(n: str) -> str:
    return (f"CASE WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' B' "
            f"WHEN {n} < 1048576 THEN printf('%.1f', {n} / 1024.0) || ' KB' "
            f"ELSE printf('%.1f', {n} / 1048576.0) || ' MB' END")


def stem(x: str) -> str:
    return (f"CASE WHEN regexp_extract({x}, '^(\\.*[^.].*)\\.[^.]*$', 1) = '' THEN {x} "
            f"ELSE regexp_extract({x}, '^(\\.*[^.].*)\\.[^.]*$', 1) END")


URL_PATH = """CASE WHEN starts_with(url, 'https://') THEN regexp_replace(url, '^https://[^/?#]*/?', '')
              ELSE regexp_extract(url, '^([^:]*):', 1) || ':' || regexp_replace(url, '^[^:]*://[^/?#]*/?', '') END"""

ENTRIES_CTE = f"""
_base AS (
  SELECT CAST(page_id AS BIGINT) AS entry_id,
         regexp_extract(url, '{A.URL_HOST}', 1) || '{A.ARCHIVE_SUFFIX}' AS archive,
         {URL_PATH} AS path,
         html
  FROM pages),
_dedup AS (
  SELECT * FROM _base
  QUALIFY row_number() OVER (PARTITION BY archive, path ORDER BY entry_id) = 1),
_typed AS (
  SELECT entry_id, archive, path, html, strlen(html) AS bytes, html AS titled, '{A.HTML_MIMETYPE}' AS mimetype
  FROM _dedup
  UNION ALL
  SELECT entry_id + {A.MEDIA_ID_BASE},
         CASE WHEN entry_id % {A.VIDEO_EVERY} = 0 THEN '{A.VIDEO_PREFIX}' ELSE '{A.PDF_PREFIX}' END || archive,
         path || CASE WHEN entry_id % {A.VIDEO_EVERY} = 0 THEN '.webm' ELSE '.pdf' END,
         '', strlen(html), html,
         CASE WHEN entry_id % {A.VIDEO_EVERY} = 0 THEN '{A.VIDEO_MIMETYPE}' ELSE '{A.PDF_MIMETYPE}' END
  FROM _dedup WHERE entry_id % {A.VIDEO_EVERY} = 0 OR entry_id % {A.PDF_EVERY} = 0),
_mains AS (
  SELECT archive, arg_min(path, entry_id) AS main_path, min(entry_id) AS main_id,
         arg_max(path, entry_id) AS last_path, max(entry_id) AS last_id
  FROM _typed GROUP BY archive),
_led AS (
  SELECT t.*, CASE WHEN t.mimetype NOT LIKE 'text/html%' OR t.entry_id = m.last_id THEN NULL
                   WHEN t.entry_id = m.main_id AND t.entry_id % {A.MAIN_REDIRECT_EVERY} = 0 THEN m.last_path
                   WHEN t.entry_id <> m.main_id AND t.entry_id % {A.REDIRECT_EVERY} = 0 THEN m.main_path
              END AS redirect_path
  FROM _typed t JOIN _mains m USING (archive)),
entries AS (
  SELECT archive, entry_id, path,
         {py_strip(norm_space(unescape("regexp_extract(titled, '(?is)<title>(.*?)</title>', 1)")))} AS title,
         mimetype, redirect_path IS NOT NULL AS is_redirect, redirect_path, CAST(bytes AS BIGINT) AS size, html
  FROM _led),
archives AS (
  SELECT archive, count(*) AS entry_count,
         count(*) FILTER (WHERE NOT is_redirect AND mimetype LIKE 'text/html%') AS article_count,
         arg_min(path, entry_id) AS main_path
  FROM entries GROUP BY archive),
-- chains are walked to the end; the data has chains of up to two hops, three are allowed for
_ends AS (
  SELECT e.archive, e.path, coalesce(CASE WHEN c.is_redirect THEN d.path END, CASE WHEN NOT c.is_redirect THEN c.path END,
         CASE WHEN NOT b.is_redirect THEN b.path END, CASE WHEN NOT e.is_redirect THEN e.path END) AS final_path
  FROM entries e LEFT JOIN entries b ON e.is_redirect AND b.archive = e.archive AND b.path = e.redirect_path
  LEFT JOIN entries c ON b.is_redirect AND c.archive = e.archive AND c.path = b.redirect_path
  LEFT JOIN entries d ON c.is_redirect AND d.archive = e.archive AND d.path = c.redirect_path AND NOT d.is_redirect),
archive_metadata AS (
  SELECT archive, 'Tags' AS key,
         string_agg(DISTINCT '_lang:' || lang, ';' ORDER BY '_lang:' || lang) AS value
  FROM (SELECT archive, regexp_extract(path, '^(?:[a-z]+:)?([^/:?#]+)/', 1) AS lang FROM entries)
  WHERE lang <> '' GROUP BY archive)
"""

CATALOG_CTE = ENTRIES_CTE + f""",
_main AS (
  SELECT a.archive, coalesce(x.final_path, '') AS main_path,
         CASE WHEN e.mimetype LIKE 'text/html%' THEN e.html ELSE '' END AS main_html
  FROM archives a LEFT JOIN _ends x ON x.archive = a.archive AND x.path = a.main_path
  LEFT JOIN entries e ON e.archive = a.archive AND e.path = x.final_path),
_sample AS (
  SELECT x.archive, t.mimetype FROM _ends x LEFT JOIN entries t ON t.archive = x.archive AND t.path = x.final_path),
_ratio AS (
  SELECT archive, count(mimetype) AS sampled,
         count(*) FILTER (WHERE mimetype LIKE '%webm%' OR mimetype LIKE 'video%') AS video,
         count(*) FILTER (WHERE NOT (mimetype LIKE '%webm%' OR mimetype LIKE 'video%')
                          AND mimetype LIKE '%pdf%') AS pdf
  FROM _sample GROUP BY archive),
_tags AS (
  SELECT archive, lower({py_strip("value")} || ' ' || '' || ' ' || '') AS tags
  FROM archive_metadata WHERE key = 'Tags' AND strlen(value) > 0),
_kind AS (
  SELECT m.archive,
    CASE WHEN coalesce(t.tags, '') LIKE '%gutenberg%' THEN 'gutenberg'
         WHEN coalesce(r.sampled, 0) > 0 AND r.video / r.sampled > 0.1 THEN 'video'
         WHEN coalesce(r.sampled, 0) > 0 AND r.pdf / r.sampled > 0.1 THEN 'pdf'
         WHEN contains(m.main_html, 'mw-parser-output') THEN 'wikipedia'
         WHEN contains(lower(m.main_html), 'http-equiv="refresh"')
           OR contains(lower(m.main_html), 'http-equiv=''refresh''') THEN 'spa'
         WHEN m.main_html <> '' AND
              length({py_strip("regexp_replace(m.main_html, '<[^>]+>', '', 'g')")}) < 40 THEN 'spa'
         ELSE 'generic' END AS type
  FROM _main m LEFT JOIN _tags t USING (archive) LEFT JOIN _ratio r USING (archive)),
_title AS (
  SELECT archive,
    coalesce(nullif({py_strip(norm_space("regexp_extract(main_html, '(?is)<title>(.*?)</title>', 1)"))}, ''),
             {stem("archive")}) AS title
  FROM _main),
catalog AS (
  SELECT m.archive, t.title, k.type, '' AS description,
         CAST(a.article_count AS BIGINT) AS article_count, m.main_path
  FROM _main m JOIN _kind k USING (archive) JOIN _title t USING (archive)
  LEFT JOIN archives a USING (archive))
"""


def with_entries(body: str) -> str:
    return f"WITH {ENTRIES_CTE}\n{body}"


def with_catalog(body: str) -> str:
    return f"WITH {CATALOG_CTE}\n{body}"
