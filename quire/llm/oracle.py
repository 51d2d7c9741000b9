"""DuckDB twins of the training-data queries, where SQL can express them.

Not expressible: op1 (the tokenizer), op2 (reachability over similarity links
needs a recursion that SQL runs too slowly on whole tables), op3 (a trained
model), op5 (CRC-32) and op7 (span positions).  They are tested against
brute-force versions.
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_ALNUM} AS w FROM benchmark),
size AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n,
              unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
                                    lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g
       FROM b WHERE len(w) > 0),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, size WHERE len(w) >= n),
hit AS (SELECT r, p, bw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND array_to_string(w[p:p + dw.n - 1], ' ') = g),
covered AS (SELECT r, count(DISTINCT q) AS n_hit
            FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


def _op4() -> str:
    from quire.llm.quality_rules import STOP_WORDS

    stops = ", ".join(f"'{form}'" for w in STOP_WORDS for form in (w, w.capitalize()))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 3)) AS p, w FROM d WHERE len(w) >= 5),
twin AS (SELECT r, list(p) AS ps FROM win GROUP BY r, array_to_string(w[p:p + 4], ' ') HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q
        FROM (SELECT r, unnest(ps) AS p FROM twin)) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop
      FROM d LEFT JOIN rep USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / word_chars <= 0.08
       AND n_words / 10 - n_stop <= 2.0 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM v
"""


_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

OP8 = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
                  md5('mix/' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
ss AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM ss),
weighed AS (SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS most FROM ranked),
level AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER f, 0))
                    / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS rest
          FROM weighed WINDOW f AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT arg_min(rest, (most / weight, rank)) AS rest FROM level WHERE rest <= most / weight),
src AS (SELECT source, source_size, rank, least(most, coalesce(weight * (SELECT rest FROM found), most)) AS target,
               ceil(source_size / 64)::BIGINT AS n FROM weighed),
placed AS (SELECT doc_id, size, src.rank, source_size, target, row_number() OVER () AS r,
                  coalesce(sum(size) OVER (PARTITION BY src.rank
                    ORDER BY ('0x' || substr(place, 1, 6))::BIGINT % 4096, place, doc_id NULLS FIRST, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
           FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
slots AS (SELECT rank, n, unnest(range(round(target * n / source_size)::BIGINT)) AS slot
          FROM src WHERE source_size > 0 AND target > 0),
counts AS (SELECT rank, n, ('0x' || substr(md5('mix/' || rank || '/' || slot || '/shard'), 1, 13))::BIGINT % 16 AS shard,
                  count(*) AS c FROM slots GROUP BY ALL),
ranges AS (SELECT rank, n, shard, c, coalesce(sum(c) OVER (PARTITION BY rank ORDER BY shard
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f FROM counts),
taken_ AS (SELECT rank, n, shard, unnest(range(f, f + c)) AS slot FROM ranges),
passes AS (SELECT rank, n, slot // n AS pass, slot % n AS spot FROM taken_),
drawn AS (SELECT rank, list_reduce(list_concat([spot], range(12)), lambda x, r:
            CASE WHEN ascii(md5('mix/' || rank || '/' || pass || '/' || r || '/' || greatest(x, {{M}}))) % 2 = 1
                 THEN {{M}} ELSE x END) AS block FROM passes),
times AS (SELECT rank, block, count(*) AS times FROM drawn GROUP BY rank, block),
cut AS (SELECT r, rank, first, size, unnest(range(first // 64, (first + size - 1) // 64 + 1)) AS block
        FROM placed WHERE size > 0),
got AS (SELECT r, sum((least(first + size, (block + 1) * 64) - greatest(first, block * 64)) * times) AS taken
        FROM cut JOIN times USING (rank, block) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN got USING (r)
""".replace("{M}", "((('0x' || substr(md5('mix/' || rank || '/' || pass || '/' || r || '/k'), 1, 13))::BIGINT % n + n - x) % n)")

OP9 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_SPACED} AS w FROM documents),
t AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT r, i, len(w) AS n_words, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS w2,
             CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS w3 FROM t),
c AS (SELECT r, i, n_words, count(*) OVER () AS total,
             count(w1) OVER (PARTITION BY w1) - count(w1) OVER (PARTITION BY r, w1) AS c1,
             count(w2) OVER (PARTITION BY w2) - count(w2) OVER (PARTITION BY r, w2) AS c2,
             count(w3) OVER (PARTITION BY w3) - count(w3) OVER (PARTITION BY r, w3) AS c3 FROM g),
x AS (SELECT *, lag(c1) OVER o AS b1, lag(c2) OVER o AS b2 FROM c WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, avg(CASE WHEN c3 > 0 THEN ln(c3 / b2) WHEN c2 > 0 THEN ln(c2 / b1) + ln(0.4)
                         ELSE ln(CASE WHEN c1 > 0 THEN c1 ELSE 0.5 END / greatest(total - n_words, 1)) + 2 * ln(0.4) END) AS score,
             count(*) FILTER (WHERE c3 > 0) AS seen_3, count(*) FILTER (WHERE c3 = 0 AND c2 > 0) AS seen_2,
             count(*) FILTER (WHERE c3 = 0 AND c2 = 0 AND c1 > 0) AS seen_1 FROM x GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, score, coalesce(seen_1, 0) AS seen_1, coalesce(seen_2, 0) AS seen_2,
       coalesce(seen_3, 0) AS seen_3 FROM d LEFT JOIN s USING (r)
"""



def _op10() -> str:
    from quire.llm import licenses as lic

    rows = ", ".join(f"({i}, '{name}', '{term}')" for i, (name, text) in enumerate(lic.TEMPLATES)
                     for term in lic._term_list(text))
    lower = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = lambda x: f"regexp_extract_all({lower.format(x=x)}, '{lic.TERM}')"
    n_words = lambda x: f"len(regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+'))"
    return f"""
WITH tt(template, license, term) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', coalesce(source, 'none'),
             CASE WHEN doc_id % 3 > 0 THEN coalesce(lang, 'none') END,
             CASE WHEN doc_id % 3 > 1 THEN (doc_id // 50)::VARCHAR END, doc_id::VARCHAR || '.txt') AS path
      FROM documents),
n AS (SELECT count(*) AS files FROM d),
held AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({terms('text')})) AS term FROM d) GROUP BY term),
idf AS (SELECT DISTINCT tt.term, ln((1 + files) / (1 + coalesce(df, 0))) + 1 AS idf
        FROM tt CROSS JOIN n LEFT JOIN held USING (term)),
raw AS (SELECT template, license, term, count(*) * any_value(idf) AS w FROM tt JOIN idf USING (term) GROUP BY ALL),
tv AS (SELECT template, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS w FROM raw),
ln_ AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM d),
lt AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest({terms('line')}) AS term FROM ln_) GROUP BY ALL),
lw AS (SELECT line, lt.term, tf * coalesce(idf, ln(1 + files) + 1) AS w FROM lt CROSS JOIN n LEFT JOIN idf USING (term)),
norm AS (SELECT line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY line),
near AS (SELECT line, license, round(sum(lw.w * tv.w) / any_value(norm), 9) AS cosine
         FROM lw JOIN tv USING (term) JOIN norm USING (line) GROUP BY line, template, license),
named AS (SELECT line, min((-cosine, license)) AS best FROM near WHERE cosine >= {lic.LEAST} GROUP BY line),
hit AS (SELECT DISTINCT text, line, best FROM (SELECT text, unnest(string_split(text, chr(10))) AS line FROM d)
        JOIN named USING (line)),
own AS (SELECT text, min(best)[2] AS own, sum({n_words('line')}) >= {lic.FILE_SHARE} * {n_words('text')} AS mostly
        FROM hit GROUP BY text),
f AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, own, own IS NOT NULL AND mostly AS is_file
      FROM d LEFT JOIN own USING (text)),
votes AS (SELECT dir, own AS license, count(*) AS votes FROM f WHERE is_file GROUP BY ALL),
licensed AS (SELECT dir AS license_dir, min((-votes, license))[2] AS license FROM votes GROUP BY dir),
above AS (SELECT dir, arg_max((license, license_dir), length(license_dir)) AS x
          FROM (SELECT DISTINCT dir FROM f WHERE own IS NULL)
          JOIN licensed ON license_dir = '' OR dir = license_dir OR starts_with(dir, license_dir || '/') GROUP BY dir)
SELECT doc_id, path, coalesce(own, x[1]) AS license,
       CASE WHEN own IS NOT NULL THEN 'own' WHEN x IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN own IS NULL THEN x[2] END AS license_dir
FROM f LEFT JOIN above USING (dir)
"""


OP12 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
                  sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
k AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
c AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
             coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                          ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
                        WHEN 'psm' THEN substr(split_part(output, '<S>', 1), 4) || split_part(output, '<M>', 2)
                                        || split_part(split_part(output, '<S>', 2), '<M>', 1)
                        ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2)
                             || substr(split_part(output, '<P>', 1), 4) END) AS restored_sha256
FROM o
"""


_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH it AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
total AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
m AS (SELECT r, doc_id, 50 + (50 * len(t) * n_docs) // n_terms AS m FROM d, total WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
       SEMI JOIN (SELECT DISTINCT term FROM it) USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
s AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM it JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
"""


ORACLE: dict[str, str] = {
    "op4_quality_rules": _op4(),
    "op6_decontamination": OP6,
    "op8_mixing": OP8,
    "op9_lm_score": OP9,
    "op10_license_scan": _op10(),
    "op12_fill_middle": OP12,
    "op13_lexical_search": OP13,
}
