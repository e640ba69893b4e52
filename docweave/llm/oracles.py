"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from docweave.llm.licenses import TEMPLATES, THRESHOLD, templates

SPACE = r"[\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def repeats(size: int, with_spans: bool) -> str:
    """Words under windows of ``size`` words that also start earlier."""
    spans = ""
    if with_spans:
        spans = """, runs AS (SELECT doc_id, min(j) - 1 AS a, max(j) AS b FROM (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS island FROM cov) GROUP BY doc_id, island),
shown AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM runs GROUP BY 1)"""
    return f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') AS g, doc_id::hugeint * 1000000000 + i AS k FROM d, unnest(range(1, greatest(1, len(w) - {size - 2}))) t(i)),
first AS (SELECT g, min(k) AS f FROM win GROUP BY 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + {size})) AS j FROM win JOIN first USING (g) WHERE k > f){spans},
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT words.doc_id, count(cov.j) AS n_removed, string_agg(x, ' ' ORDER BY words.j) FILTER (cov.j IS NULL) AS left_ FROM words LEFT JOIN cov ON cov.doc_id = words.doc_id AND cov.j = words.j GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_, '')) AS kept_sha256{", coalesce(spans, '') AS spans" if with_spans else ""}
FROM d LEFT JOIN kept USING (doc_id){" LEFT JOIN shown USING (doc_id)" if with_spans else ""}"""


def words_of(table: str, key: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, regexp_extract_all({low}, '{ALNUM}') AS w FROM {table}"


CONTAMINATION = f"""WITH items AS ({words_of("benchmark", "item_id")}),
p AS (SELECT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
d AS ({words_of("documents", "doc_id")}),
win AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM d, (SELECT DISTINCT m FROM p) lens, unnest(range(1, greatest(1, len(w) - m + 2))) t(i)),
hits AS (SELECT DISTINCT doc_id, m, i, item_id FROM win JOIN p USING (m, g)),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS all_ FROM (SELECT DISTINCT doc_id, item_id::varchar AS s FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(all_, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN found USING (doc_id)"""

_GRAMS = ", ".join(f"({i}, '{t.licence}', '{g}')" for i, t in enumerate(templates(TEMPLATES)) for g in t.bigrams)
LICENSES = f"""WITH tg AS (SELECT k, gram, count(*) AS c FROM (VALUES {_GRAMS}) v(k, licence, gram) GROUP BY 1, 2),
t AS (SELECT k, any_value(licence) AS licence, count(*) AS n FROM (VALUES {_GRAMS}) v(k, licence, gram) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
w AS (SELECT doc_id, line, regexp_extract_all(body, '{ALNUM}') AS w FROM l),
g AS (SELECT doc_id, line, w[i] || ' ' || w[i + 1] AS gram, len(w) - 1 AS n FROM w, unnest(range(1, len(w))) r(i)),
lg AS (SELECT doc_id, line, gram, n, count(*) AS c FROM g GROUP BY ALL),
dice AS (SELECT doc_id, line, tg.k, 2.0::double * sum(least(lg.c, tg.c)) / (any_value(lg.n) + any_value(t.n)) AS dice, any_value(licence) AS licence FROM lg JOIN tg USING (gram) JOIN t ON t.k = tg.k GROUP BY 1, 2, 3),
best AS (SELECT * FROM dice WHERE dice >= {THRESHOLD} - 1e-12 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, k) = 1),
hit AS (SELECT doc_id, count(*) AS n, string_agg(line || ':' || licence, ',' ORDER BY line) AS matched, max(dice) AS dice, list(licence) AS licences FROM best GROUP BY 1),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{ALNUM}') AS w FROM documents),
dg AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS gram, len(w) - 1 AS total FROM dw, unnest(range(1, len(w))) r(i)),
th AS (SELECT doc_id, tg.k, i, gram, total, tg.c FROM dg JOIN tg USING (gram)),
begins AS (SELECT DISTINCT doc_id, th.k, least(i, total - least(n, total) + 1) AS s, least(n, total) AS wide, n FROM th JOIN t ON t.k = th.k),
wc AS (SELECT b.doc_id, b.k, s, wide, n, gram, least(count(*), any_value(c)) AS both_ FROM begins b JOIN th ON th.doc_id = b.doc_id AND th.k = b.k AND th.i BETWEEN s AND s + wide - 1 GROUP BY ALL),
wd AS (SELECT doc_id, k, s, s + wide + 1 AS e, 2.0::double * sum(both_) / (wide + n) AS dice FROM wc GROUP BY doc_id, k, s, wide, n HAVING dice >= {THRESHOLD} - 1e-12),
isl AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id, k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new_ FROM wd),
run AS (SELECT doc_id, k, s, e, dice, sum(new_) OVER (PARTITION BY doc_id, k ORDER BY s) AS g FROM isl),
sp AS (SELECT doc_id, run.k, licence, min(s) - 1 AS s, max(e) - 1 AS e, max(dice) AS dice FROM run JOIN t ON t.k = run.k GROUP BY doc_id, run.k, licence, g),
span AS (SELECT doc_id, count(*) AS n, string_agg(s || ':' || e || ':' || licence, ',' ORDER BY s, e, licence, dice) AS spans, max(dice) AS dice, list(licence) AS licences FROM sp GROUP BY 1)
SELECT d.doc_id, (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id) AS n_lines, coalesce(hit.n, 0) AS n_license_lines, coalesce(span.n, 0) AS n_license_spans,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(hit.licences, []), coalesce(span.licences, [])))), ',') AS licenses, round(greatest(coalesce(hit.dice, 0), coalesce(span.dice, 0)), 6)::double AS best_dice, coalesce(matched, '') AS matched, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN hit USING (doc_id) LEFT JOIN span USING (doc_id)"""

ORACLES = {"op3_rabin_karp": repeats(20, False), "op6_license_dice": LICENSES, "op7_wu_manber": CONTAMINATION, "op8_sparse_suffix": repeats(50, True)}
