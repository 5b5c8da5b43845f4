"""DuckDB SQL with the rows of those queries that SQL can express."""

WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (
  SELECT page_id, html,
         CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS keeper
  FROM p
)
SELECT page_id,
       strlen(html) AS payload_bytes,
       sha1(html) AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k
"""

OP5 = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS parts
  FROM documents
),
l AS (
  SELECT rid, doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM d
),
b AS (
  SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= 10
),
marked AS (
  SELECT l.*, b.line IS NOT NULL AS cut FROM l LEFT JOIN b ON trim(l.line, ' ') = b.line
),
per AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT cut), '') AS text
  FROM marked GROUP BY rid
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, per.text
FROM d LEFT JOIN per USING (rid)
"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents),
i AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM (SELECT item_id, {WORDS} AS ws FROM benchmark)
      WHERE len(ws) > 0),
ip AS (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM i),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS g FROM ip),
sizes AS (SELECT DISTINCT k FROM i),
dp AS (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, sizes WHERE len(ws) >= k),
dg AS (SELECT rid, k, p, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS g FROM dp),
m AS (SELECT rid, dg.k AS k, p, item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
places AS (SELECT DISTINCT rid, k, p FROM m),
hit AS (
  SELECT rid, count(DISTINCT w) AS n_hit
  FROM (SELECT rid, unnest(range(p, p + k)) AS w FROM places) GROUP BY rid
),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM m WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid)
"""


def all_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op5_line_dedup": OP5, "op7_decontaminate": OP7}
