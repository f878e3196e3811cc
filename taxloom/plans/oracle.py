"""The queries in SQL over the same tables, for comparison by value.

Common parts are shared as WITH lists. Left out, because SQL has no short equal: group_matches,
leftover_sums and reconcile_counts (claims taken in input order).
"""

from __future__ import annotations

from taxloom import constants as C
from taxloom.functions.ids import NAMESPACE


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


# --- invoices ------------------------------------------------------------------------------------

LINES = """
lines AS (SELECT l_orderkey AS invoice_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS base,
  CASE l_returnflag WHEN 'A' THEN 'standard' WHEN 'N' THEN 'zero_rated' ELSE 'exempt' END AS cat,
  l_partkey % 97 = 0 AS flagged FROM lineitem),
taxed AS (SELECT *, CASE WHEN cat = 'standard' THEN round(base * 0.15, 2) ELSE 0 END AS vat FROM lines)
"""
TOTALS = """
totals AS (SELECT invoice_id, sum(base) AS subtotal, CAST(sum(vat) AS DECIMAL(24,2)) AS total_vat,
  bool_or(flagged) AS has_flagged_lines, count(*) AS line_count FROM taxed GROUP BY invoice_id)
"""
INVOICES = """
items AS (SELECT l_orderkey AS k, CAST(l_extendedprice AS DECIMAL(18,2)) AS base,
  CASE WHEN l_partkey % 20 = 0 AND (l_partkey // 20) % 4 = 0 THEN 'exempt' WHEN l_partkey % 20 = 0 AND (l_partkey // 20) % 4 = 1 THEN 'zero_rated'
       WHEN l_partkey % 10 = 0 OR l_returnflag = 'A' THEN 'standard' WHEN l_returnflag = 'N' THEN 'zero_rated'
       ELSE 'exempt' END AS cat FROM lineitem),
sums AS (SELECT k, sum(CASE WHEN cat = 'standard' THEN round(base * 0.15, 2) ELSE 0 END) AS vat, sum(base) AS base
  FROM items GROUP BY k),
head AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS day, s.vat, s.base,
  s.k IS NOT NULL AS has_lines,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '12345'
       ELSE '3' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 13, '0') || '3' END AS seller,
  CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 23 = 0 THEN '923456789012345'
       ELSE '3' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 13, '0') || '3' END AS buyer,
  CASE WHEN o_custkey % 7 <> 0 THEN 'Customer ' || o_custkey END AS buyer_name,
  o_orderkey % 29 <> 0 AS dated, s.k IS NOT NULL AND o_orderkey % 31 <> 0 AS printed
  FROM orders LEFT JOIN sums s ON s.k = o_orderkey),
judged AS (SELECT *, 'inv_' || k AS filename,
  CASE WHEN seller IS NULL THEN 'The seller''s VAT number was not found.' END AS e1,
  CASE WHEN NOT dated THEN 'The issue date was not found.' END AS e2,
  CASE WHEN seller = '12345' THEN 'Seller: VAT number needs 15 digits: 12345' END AS e3,
  CASE WHEN buyer = '923456789012345' THEN 'Buyer: VAT number must begin and end with 3: 923456789012345' END AS e4,
  CASE WHEN dated AND day > DATE '1999-06-01' THEN 'Issue date lies ahead: ' || strftime(day, '%Y-%m-%d') END AS e5,
  CASE WHEN seller = buyer THEN 'Seller and buyer are the same.' END AS e6,
  CASE WHEN NOT has_lines THEN 'No line items were found.' END AS e7,
  CASE WHEN printed AND k % 10 IN (1, 2) THEN 2 ELSE 0 END AS mismatches,
  CASE WHEN printed AND k % 10 = 2 THEN 2 ELSE 0 END AS significant FROM head),
checked AS (SELECT *,
  len(list_filter([e1, e2, e3, e4, e5, e6, e7], lambda x: x IS NOT NULL)) AS errors,
  CASE WHEN buyer_name IS NULL AND buyer IS NULL THEN 1 ELSE 0 END
    + CASE WHEN has_lines AND NOT printed THEN 1 ELSE 0 END AS warnings FROM judged),
verdict AS (SELECT *, CASE WHEN errors > 0 OR significant > 0 THEN 'flagged' ELSE 'clean' END AS status FROM checked)
"""

# --- reconciliation --------------------------------------------------------------------------------

SIDES = r"""
ledger AS MATERIALIZED (SELECT 'a_' || o_orderkey || '_' || p.part AS row_id, o_orderkey * 2 + p.part AS ordinal, o_orderkey AS k,
  CASE WHEN o_orderkey % 20 IN (7, 11) THEN NULL WHEN o_orderkey % 40 = 8 THEN 'DUP-X-' || (o_orderkey % 400)
       ELSE 'INV-A-' || o_orderkey END AS reference,
  CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  'Lot ' || translate(lpad(CAST(o_orderkey // 3 AS VARCHAR), 8, '0'), '0123456789', 'abcdefghij') AS description
  FROM orders, (VALUES (0), (1)) p(part) WHERE p.part = 0 OR o_orderkey % 20 = 11),
base AS MATERIALIZED (SELECT o_orderkey AS k, o_orderkey % 20 AS kind, CAST(o_totalprice AS DECIMAL(18,2)) AS amt,
  CAST(o_orderdate AS DATE) AS day, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.40, 2) AS DECIMAL(18,2)) AS p1,
  CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.35, 2) AS DECIMAL(18,2)) AS p2 FROM orders),
parts AS (
  SELECT k, kind, day, 0 AS part, CASE WHEN kind = 1 THEN CAST(round(amt * 1.15, 2) AS DECIMAL(18,2))
    WHEN kind = 5 THEN CAST(amt + 0.01 AS DECIMAL(18,2)) ELSE amt END AS amount FROM base WHERE kind NOT IN (2, 3, 4)
  UNION ALL SELECT k, kind, day, 1, amt FROM base WHERE kind = 9
  UNION ALL SELECT k, kind, day, 1, p1 FROM base WHERE kind IN (2, 3) OR k % 40 = 24
  UNION ALL SELECT k, kind, day, 2, CAST(amt - p1 AS DECIMAL(18,2)) FROM base WHERE kind = 2 OR k % 40 = 24
  UNION ALL SELECT k, kind, day, 2, p2 FROM base WHERE kind = 3
  UNION ALL SELECT k, kind, day, 3, CAST(amt - p1 - p2 AS DECIMAL(18,2)) FROM base WHERE kind = 3),
statement AS MATERIALIZED (SELECT 'b_' || k || '_' || part AS row_id, k * 4 + part AS ordinal, k,
  CASE WHEN kind IN (2, 3, 4, 5, 6, 7, 9, 11) THEN NULL WHEN k % 40 = 8 THEN 'dup x ' || (k % 400) ELSE 'inv a ' || k END AS reference,
  day + CAST(CASE WHEN kind IN (2, 3) THEN part WHEN kind = 4 THEN part * 20 WHEN kind = 5 THEN 2 WHEN kind = 6 THEN 1 ELSE 0 END AS INTEGER) AS date,
  amount, CASE WHEN kind <> 4 THEN 'Lot ' || translate(lpad(CAST(k // 3 AS VARCHAR), 8, '0'), '0123456789', 'abcdefghij') END AS description
  FROM parts)
"""
PASS1 = r"""
ra AS (SELECT *, regexp_replace(lower(trim(reference)), '[^\p{L}\p{N}]', '', 'g') AS rk FROM ledger),
rb AS (SELECT *, regexp_replace(lower(trim(reference)), '[^\p{L}\p{N}]', '', 'g') AS rk FROM statement),
ua AS (SELECT rk, any_value(row_id) AS row_a, any_value(amount) AS amt_a FROM ra WHERE rk <> '' GROUP BY rk HAVING count(*) = 1),
ub AS (SELECT rk, any_value(row_id) AS row_b, any_value(amount) AS amt_b FROM rb WHERE rk <> '' GROUP BY rk HAVING count(*) = 1),
p1 AS MATERIALIZED (SELECT row_a, row_b, amt_a, amt_b, abs(amt_a - amt_b) <= 0.01 AS agrees FROM ua JOIN ub USING (rk)),
p1g AS MATERIALIZED (SELECT *, NOT agrees AND least(amt_a, amt_b) > 0 AND abs(greatest(amt_a, amt_b) - least(amt_a, amt_b) - 0.15 * least(amt_a, amt_b))
  <= 0.005 * least(amt_a, amt_b) AS possible_vat_gap FROM p1)
"""
PASS2 = """
la AS MATERIALIZED (SELECT * FROM ledger WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.row_a = ledger.row_id)),
lb AS MATERIALIZED (SELECT * FROM statement WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.row_b = statement.row_id)),
va AS (SELECT amount, min(row_id) AS row_id FROM la GROUP BY amount HAVING count(*) = 1),
vb AS (SELECT amount, min(row_id) AS row_id FROM lb GROUP BY amount HAVING count(*) = 1),
p2 AS MATERIALIZED (SELECT va.row_id AS row_a, vb.row_id AS row_b, amount FROM va JOIN vb USING (amount))
"""
PASS3 = """
ma AS MATERIALIZED (SELECT * FROM la WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.row_a = la.row_id)),
mb AS MATERIALIZED (SELECT * FROM lb WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.row_b = lb.row_id)),
seek AS (SELECT ma.*, amount + d.x AS want FROM ma, (VALUES (-0.01), (0.00), (0.01)) d(x)),
cand AS MATERIALIZED (SELECT s.row_id AS row_a, mb.row_id AS row_b, mb.ordinal AS ord_b FROM seek s JOIN mb ON mb.amount = s.want
  WHERE abs(datediff('day', s.date, mb.date)) <= 3),
wants AS (SELECT row_b, count(*) AS n_wanting FROM cand GROUP BY row_b),
per_a AS (SELECT row_a, count(*) AS n_candidates, max(n_wanting) AS n_wanting, min(cand.row_b) AS pick, arg_min(cand.row_b, ord_b) AS first_b
  FROM cand JOIN wants USING (row_b) GROUP BY row_a),
items AS MATERIALIZED (
  SELECT 'review_amount_mismatch_' || row_a AS item_id, 'amount_mismatch' AS kind, 0 AS n_candidates, row_a, row_b, possible_vat_gap, NULL AS pick
    FROM p1g WHERE NOT agrees
  UNION ALL SELECT 'review_' || ma.row_id, CASE WHEN p.row_a IS NULL THEN 'unmatched' WHEN p.n_candidates = 1 AND p.n_wanting = 1 THEN 'fuzzy_match'
      ELSE 'ambiguous' END, coalesce(p.n_candidates, 0), ma.row_id,
      CASE WHEN p.n_candidates = 1 AND p.n_wanting = 1 THEN p.pick END, false, p.pick FROM ma LEFT JOIN per_a p ON p.row_a = ma.row_id
  UNION ALL SELECT 'review_' || row_id, 'unmatched', 0, NULL, row_id, false, NULL FROM mb WHERE NOT EXISTS (SELECT 1 FROM cand WHERE cand.row_b = mb.row_id)),
numbered AS MATERIALIZED (SELECT i.*, coalesce(a.ordinal // 2, b.ordinal // 4) AS n, a.ordinal AS ord_a FROM items i LEFT JOIN ledger a ON a.row_id = i.row_a
  LEFT JOIN statement b ON b.row_id = i.row_b),
reviewed AS MATERIALIZED (SELECT *, CASE n % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' END AS decision,
  CASE WHEN n % 3 = 0 AND kind = 'ambiguous' THEN pick END AS selected FROM numbered),
matched AS MATERIALIZED (SELECT row_a, row_b FROM p1 WHERE agrees UNION ALL SELECT row_a, row_b FROM p2),
settled AS MATERIALIZED (SELECT row_a AS row_id FROM matched UNION SELECT row_b FROM matched
  UNION SELECT row_a FROM reviewed WHERE decision = 'confirmed' AND row_a IS NOT NULL
  UNION SELECT row_b FROM reviewed WHERE decision = 'confirmed' AND row_b IS NOT NULL
  UNION SELECT selected FROM reviewed WHERE selected IS NOT NULL)
"""
RECON = (SIDES, PASS1, PASS2, PASS3)
CHOICE = """
listed AS (SELECT r.item_id, c.row_b FROM reviewed r JOIN cand c ON c.row_a = r.row_a WHERE r.kind = 'ambiguous'),
money AS (SELECT row_id, reference, description, amount FROM ledger UNION ALL SELECT row_id, reference, description, amount FROM statement),
shown AS (SELECT l.item_id, string_agg(coalesce(b.reference, '-') || ': ' || b.description, '; ' ORDER BY b.ordinal) AS txt,
  arg_min(b.amount, b.ordinal) AS amt FROM listed l JOIN statement b ON b.row_id = l.row_b GROUP BY l.item_id),
excepted AS (SELECT r.item_id, r.kind, r.n_candidates, r.possible_vat_gap, r.decision, a.reference AS ref_a, a.row_id AS ida, b.reference AS ref_b,
  a.description AS desc_a, a.amount AS amt_a, CASE WHEN r.kind = 'ambiguous' THEN s.txt ELSE b.description END AS desc_b,
  CASE WHEN r.kind = 'ambiguous' THEN s.amt ELSE b.amount END AS amt_b
  FROM reviewed r LEFT JOIN ledger a ON a.row_id = r.row_a LEFT JOIN statement b ON b.row_id = r.row_b LEFT JOIN shown s ON s.item_id = r.item_id),
report AS (SELECT item_id, CASE
    WHEN kind = 'amount_mismatch' AND possible_vat_gap THEN 'Amounts differ by about the VAT rate: ' || format('{:,.2f}', CAST(amt_a AS DOUBLE)) || ' / ' || format('{:,.2f}', CAST(amt_b AS DOUBLE))
    WHEN kind = 'ambiguous' AND n_candidates = 1 THEN 'More than one reading (Candidate wanted by several rows)'
    WHEN kind = 'ambiguous' THEN 'More than one reading' WHEN kind = 'fuzzy_match' THEN 'Likely pair'
    WHEN kind = 'unmatched' THEN 'No counterpart' ELSE 'Amounts differ' END AS exception_type,
  coalesce(CASE WHEN ida IS NOT NULL THEN ref_a ELSE ref_b END, '') AS reference, coalesce(desc_a, '') AS side_a,
  coalesce(format('{:,.2f}', CAST(amt_a AS DOUBLE)), '') AS amount_a, coalesce(desc_b, '') AS side_b,
  coalesce(format('{:,.2f}', CAST(amt_b AS DOUBLE)), '') AS amount_b,
  coalesce(format('{:,.2f}', CAST(amt_a - amt_b AS DOUBLE)), '') AS difference,
  CASE decision WHEN 'confirmed' THEN 'Accepted' WHEN 'dismissed' THEN 'Rejected' ELSE 'Open' END AS status, '' AS explanation FROM excepted)
"""
POOL4 = """
ta AS (SELECT a.* FROM items i JOIN ledger a ON a.row_id = i.row_a WHERE i.kind = 'unmatched'),
tb AS (SELECT b.* FROM items i JOIN statement b ON b.row_id = i.row_b WHERE i.kind = 'unmatched'),
-- None of these references has a series number, so only dates and the shared subject word link rows.
edge AS (SELECT a.ordinal AS t, a.amount AS goal, b.ordinal AS m, b.amount AS v FROM tb b JOIN ta a ON abs(datediff('day', a.date, b.date)) <= 3
  UNION SELECT a.ordinal, a.amount, b.ordinal, b.amount FROM tb b JOIN ta a ON a.description = b.description)
"""
SUBSETS = """
two AS (SELECT x.t, x.goal, x.m AS m1, y.m AS m2, x.v + y.v AS s FROM edge x JOIN edge y ON x.t = y.t AND x.m < y.m WHERE x.v + y.v <= x.goal + 0.01),
three AS (SELECT p.t, p.goal, m1, m2, y.m AS m3, s + y.v AS s FROM two p JOIN edge y ON p.t = y.t AND m2 < y.m WHERE s + y.v <= p.goal + 0.01),
four AS (SELECT p.t, p.goal, m1, m2, m3, y.m AS m4, s + y.v AS s FROM three p JOIN edge y ON p.t = y.t AND m3 < y.m WHERE s + y.v <= p.goal + 0.01),
fits AS (SELECT t, m1 || ',' || m2 AS members FROM two WHERE abs(s - goal) <= 0.01
  UNION ALL SELECT t, m1 || ',' || m2 || ',' || m3 FROM three WHERE abs(s - goal) <= 0.01
  UNION ALL SELECT t, m1 || ',' || m2 || ',' || m3 || ',' || m4 FROM four WHERE abs(s - goal) <= 0.01)
"""

# --- registers ---------------------------------------------------------------------------------------

REGISTERS = """
words AS (SELECT * FROM (VALUES (0, 'Office supplies', NULL, NULL), (1, 'Client entertainment', 'entertainment', NULL), (2, 'Vehicle repair', NULL, 'vehicle'),
  (3, 'Hotel stay', 'hotel', NULL), (4, 'Consulting', NULL, NULL), (5, 'Diesel fuel', NULL, 'fuel'), (6, 'Staff catering', 'catering', NULL),
  (7, 'Software', NULL, NULL), (8, 'Motor parts', NULL, 'motor'), (9, 'Printing', NULL, NULL)) w(i, expense, blocked, unclear)),
sales AS (SELECT o_orderkey AS row_index, CAST(o_totalprice AS DECIMAL(18,2)) AS base, o_orderkey % 4 = 0 AS zero, o_orderkey % 9 = 0 AND o_orderkey % 4 <> 0 AS open_rate,
  'Customer ' || o_custkey AS label,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.15, 2) END + CASE WHEN o_orderkey % 100 = 1 THEN 7 ELSE 0 END AS DECIMAL(18,2)) AS vat FROM orders),
bought AS (SELECT l_orderkey * 8 + l_linenumber AS row_index, CAST(l_extendedprice AS DECIMAL(18,2)) AS base, w.expense, w.blocked, w.unclear,
  CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.15, 2) + CASE WHEN l_partkey % 100 = 3 THEN 5 ELSE 0 END AS DECIMAL(18,2)) AS vat,
  CASE l_linestatus WHEN 'F' THEN 'stated' ELSE 'guessed' END AS source_id, l_partkey,
  CASE WHEN l_linestatus = 'F' THEN CASE l_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'N' END END AS said
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN words w ON w.i = p_size % 10),
purchases AS (SELECT *, CASE WHEN said IS NOT NULL THEN 'stated' WHEN blocked IS NOT NULL THEN 'blocked' WHEN unclear IS NOT NULL THEN 'unclear' ELSE 'default' END AS reason_code,
  CASE WHEN said IS NOT NULL THEN said WHEN blocked IS NOT NULL THEN blocked ELSE unclear END AS keyword,
  CASE WHEN said IS NOT NULL THEN said = 'Yes' ELSE blocked IS NULL END AS reclaimable, said IS NULL AND blocked IS NULL AND unclear IS NOT NULL AS needs_review
  FROM bought),
decided AS (SELECT *, CASE WHEN needs_review THEN row_index % 4 = 0 ELSE reclaimable END AS final FROM purchases)
"""

# --- vectors ---------------------------------------------------------------------------------------------

VECTORS = """
docs AS (SELECT e.vec_id AS v, lpad(CAST(e.vec_id AS VARCHAR), 8, '0') AS id, CAST(e.embedding AS DOUBLE[]) AS x, d.lang, d.source, d.text
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
asked AS (SELECT id AS query_id, CASE WHEN v % 5 = 0 THEN 'ar' ELSE lang END AS language, x, text FROM docs),
scored AS (SELECT query_id, language, d.id, d.lang, list_cosine_similarity(asked.x, d.x) AS score FROM asked, docs d),
ranked AS (SELECT query_id, 'any' AS scope, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored
  UNION ALL SELECT query_id, 'same', id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM scored WHERE lang = language),
hits AS (SELECT * FROM ranked WHERE rank <= 10),
good AS (SELECT *, bool_or(scope = 'same') OVER (PARTITION BY query_id) AS has_same FROM hits WHERE score >= 0.5),
chosen AS (SELECT query_id, id, score, rank, NOT has_same AS cross_language FROM good WHERE (has_same AND scope = 'same') OR (NOT has_same AND scope = 'any'))
"""
TABLES = """
rowtext AS (SELECT 't' || s_nationkey AS table_ref, s_suppkey AS row_index,
  'supplier: ' || s_name || ' | ' || CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS fragment FROM supplier),
tabletext AS (SELECT table_ref, string_agg('- ' || fragment, chr(10) ORDER BY row_index) AS table_text FROM rowtext GROUP BY table_ref)
"""
PARTS = """
payload AS (SELECT v, id, source AS document_type, text, 'u' || v AS source_url, v % 7 = 0 AS pointer, v % 10 <> 0 AS is_current, 't' || (v % 25) AS ref, CAST(v % 50 AS VARCHAR) AS article,
  v % 7 <> 0 AND v % 3 = 0 AS cites FROM docs),
firsts AS (SELECT document_type, article, arg_min(id, id) AS id FROM payload WHERE NOT pointer GROUP BY document_type, article),
context AS (
  SELECT c.query_id, 0 AS tier, c.rank, 0 AS step, 'table_rows' AS content_kind, p.document_type, p.source_url, p.ref AS table_ref, true AS sited, p.is_current,
    'Rows of table ' || p.ref || ':' || chr(10) || coalesce(t.table_text, '') AS text
    FROM found c JOIN payload p USING (id) LEFT JOIN tabletext t ON t.table_ref = p.ref WHERE p.pointer
  UNION ALL SELECT c.query_id, 1, c.rank, 0, 'prose', p.document_type, p.source_url, NULL, true, p.is_current, p.text FROM found c JOIN payload p USING (id) WHERE NOT p.pointer
  UNION ALL SELECT c.query_id, 2, c.rank, 0, 'prose', p.document_type, q.source_url, NULL, true, q.is_current, q.text FROM found c JOIN payload p USING (id)
    JOIN firsts f ON f.document_type = p.document_type AND f.article = CAST((p.v + 1) % 50 AS VARCHAR) JOIN payload q ON q.id = f.id WHERE p.cites
  UNION ALL SELECT c.query_id, 2, c.rank, 1, 'table_rows', NULL, NULL, p.ref, false, NULL, 'Rows of the table referred to, ' || p.ref || ':' || chr(10) || coalesce(t.table_text, '')
    FROM found c JOIN payload p USING (id) LEFT JOIN tabletext t ON t.table_ref = p.ref WHERE p.cites),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, step) AS position FROM context) WHERE position <= 6)
"""
CHOSEN = "found AS (SELECT query_id, id, rank, cross_language FROM chosen)"

# --- texts --------------------------------------------------------------------------------------------------

WORDS = r"list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')"
ARTICLES = r"""
docs AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
arts AS (SELECT doc_id, source, i, regexp_replace(l[i] || CASE WHEN i < len(l) THEN chr(10) || 'Article ' || (i + 1) || ':' ELSE '' END, '^\s+|\s+$', '', 'g') AS body
  FROM docs, unnest(range(1, len(l) + 1)) u(i)),
cut AS (SELECT *, """ + WORDS + r""" AS w FROM arts),
pieces AS (SELECT *, greatest(1, CAST(ceil(len(w) / 500.0) AS INTEGER)) AS n FROM cut),
chunks AS (SELECT doc_id, CAST(i AS VARCHAR) AS article_number, CAST(j AS INTEGER) AS part_index,
  CASE WHEN n = 1 THEN len(w) ELSE len(w[j * 500 + 1 : j * 500 + 500]) END AS word_count,
  source || ', Article ' || i || ':' || CASE WHEN n > 1 THEN ' (part ' || (j + 1) || '/' || n || ')' ELSE '' END || ' '
    || CASE WHEN n = 1 THEN body ELSE array_to_string(w[j * 500 + 1 : j * 500 + 500], ' ') END AS text
  FROM pieces, unnest(range(0, n)) u(j))
"""
NOTES = """
notes AS (SELECT 'u' || (o_custkey % 20) AS user_id, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS customer_name, lower(o_orderstatus) AS status,
  'order ' || o_orderkey AS notes, strftime(CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey), '%Y-%m-%d %H:%M:%S') AS created_at FROM orders),
noted AS (SELECT *, '* ' || customer_name || ' | ' || status || ' | ' || notes || ' | ' || created_at AS line FROM notes)
"""

def _html_sql() -> str:
    """The same replacements, with the character references by name only (the pages hold no numeric ones)."""
    text = r"regexp_replace(html, '(?s)<!--.*?(-->|\z)', '', 'g')"
    for tag in C.HTML_SILENT_TAGS:
        text = rf"regexp_replace({text}, '(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\z)', '', 'g')"
    text = rf"regexp_replace({text}, '\s*(</?[A-Za-z!][^>]*>)\s*', '\1', 'g')"
    text = rf"regexp_replace({text}, '(?i)<({'|'.join(C.HTML_BLOCK_TAGS)})([\s/][^>]*)?>', chr(10), 'g')"
    text = rf"regexp_replace({text}, '(?i)<({'|'.join(C.HTML_CELL_TAGS)})([\s/][^>]*)?>', ' | ', 'g')"
    text = rf"regexp_replace({text}, '</?[A-Za-z!][^>]*>', ' ', 'g')"
    for name, value in C.HTML_ENTITIES.items():
        text = f"replace({text}, '&{name};', chr({ord(value)}))"
    text = rf"regexp_replace(regexp_replace(regexp_replace({text}, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g')"
    return f"SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {text} AS t FROM pages)"


ORACLE = {
    "invoice_totals": _with(LINES, TOTALS) + """
SELECT invoice_id, CAST(subtotal AS DOUBLE) AS subtotal, CAST(total_vat AS DOUBLE) AS total_vat, CAST(subtotal + total_vat AS DOUBLE) AS grand_total,
  has_flagged_lines, line_count FROM totals""",
    "line_vat": _with(LINES) + """
SELECT cat AS tax_category, count(*) AS line_count, CAST(sum(vat) AS DOUBLE) AS vat, count(*) FILTER (WHERE flagged) AS flagged FROM taxed GROUP BY cat""",
    "totals_mismatch": _with(LINES, TOTALS) + """,
printed AS (SELECT invoice_id, subtotal, total_vat, CAST(CASE invoice_id % 10 WHEN 1 THEN 0.01 WHEN 2 THEN 0.10 WHEN 3 THEN -0.02 ELSE 0 END AS DECIMAL(18,2)) AS err FROM totals)
SELECT invoice_id, 'total_vat' AS field, CAST(total_vat + err AS DOUBLE) AS document_value, CAST(total_vat AS DOUBLE) AS recalculated_value, abs(err) <= 0.02 AS within_tolerance
  FROM printed WHERE err <> 0 AND invoice_id % 11 <> 0
UNION ALL SELECT invoice_id, 'grand_total', CAST(subtotal + total_vat + err AS DOUBLE), CAST(subtotal + total_vat AS DOUBLE), abs(err) <= 0.02
  FROM printed WHERE err <> 0 AND invoice_id % 13 <> 0""",
    "invoice_status": _with(INVOICES) + """
SELECT filename, status, CAST(errors AS INTEGER) AS errors, CAST(warnings AS INTEGER) AS warnings, CAST(mismatches AS INTEGER) AS mismatches,
  CAST(significant AS INTEGER) AS significant, CAST(vat AS DOUBLE) AS total_vat FROM verdict""",
    "batch_counts": _with(INVOICES) + """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'clean') AS clean, count(*) FILTER (WHERE status = 'flagged') AS flagged FROM verdict""",
    "invoice_reasons": _with(INVOICES) + """
SELECT filename, status, seller AS seller_vat_number, buyer_name, CASE WHEN status = 'flagged'
  THEN concat_ws(' | ', e1, e2, e3, e4, e5, e6, e7, CASE WHEN significant > 0 THEN 'Printed totals differ from the recalculated ones.' END)
  WHEN mismatches > 0 THEN 'Rounding only (total_vat, grand_total)' ELSE '' END AS reason FROM verdict""",
    "issue_detail": _with(INVOICES) + """,
gaps AS (SELECT filename, significant, vat, base, CAST(CASE WHEN k % 10 = 1 THEN 0.01 ELSE 0.10 END AS DECIMAL(18,2)) AS err FROM verdict WHERE status = 'flagged' AND mismatches > 0),
found AS (SELECT filename, list_filter([
    {'what': 'missing_seller_vat_number', 'severity': 'error', 'text': e1}, {'what': 'missing_issue_date', 'severity': 'error', 'text': e2},
    {'what': 'missing_buyer_identity', 'severity': 'warning', 'text': CASE WHEN buyer_name IS NULL AND buyer IS NULL THEN 'The buyer was not identified.' END},
    {'what': 'invalid_vat_number_format', 'severity': 'error', 'text': e3}, {'what': 'invalid_buyer_vat_number_format', 'severity': 'error', 'text': e4},
    {'what': 'future_issue_date', 'severity': 'error', 'text': e5}, {'what': 'seller_equals_buyer', 'severity': 'error', 'text': e6},
    {'what': 'not_readable_as_invoice', 'severity': 'error', 'text': e7},
    {'what': 'no_printed_totals', 'severity': 'warning', 'text': CASE WHEN has_lines AND NOT printed THEN 'No printed totals to compare with.' END}],
    lambda x: x.text IS NOT NULL) AS l FROM verdict WHERE status = 'flagged')
SELECT filename, 'issue' AS part, CAST(i AS INTEGER) AS pos, l[i + 1].severity AS severity, l[i + 1].what AS what, l[i + 1].text AS text FROM found, range(len(l)) r(i)
UNION ALL SELECT filename, 'mismatch', 0, CASE WHEN significant > 0 THEN 'error' ELSE 'rounding' END, 'total_vat',
  'printed ' || format('{:,.2f}', CAST(vat + err AS DOUBLE)) || ', recalculated ' || format('{:,.2f}', CAST(vat AS DOUBLE)) FROM gaps
UNION ALL SELECT filename, 'mismatch', 1, CASE WHEN significant > 0 THEN 'error' ELSE 'rounding' END, 'grand_total',
  'printed ' || format('{:,.2f}', CAST(base + vat + err AS DOUBLE)) || ', recalculated ' || format('{:,.2f}', CAST(base + vat AS DOUBLE)) FROM gaps""",
    "structural_issues": """
WITH d AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 50 <> 0 THEN 'P' || (o_orderkey % 1500) END AS seller, CASE WHEN o_orderkey % 51 <> 0 THEN 'P' || o_custkey END AS buyer,
  CASE WHEN o_orderkey % 7 = 0 THEN 'short' WHEN o_orderkey % 11 = 0 THEN 'edges' WHEN o_orderkey % 13 <> 0 THEN 'good' END AS number,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS issued,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - 2 AS INTEGER) END AS supplied, o_orderkey % 19 <> 0 AS identified FROM orders),
l AS (SELECT document_id, list_filter([
  CASE WHEN seller IS NULL THEN ['missing_required_field', 'seller_id', 'error'] END, CASE WHEN buyer IS NULL THEN ['missing_required_field', 'buyer_id', 'error'] END,
  CASE WHEN number IS NULL THEN ['missing_required_field', 'vat_number', 'error'] END, CASE WHEN issued IS NULL THEN ['missing_required_field', 'issue_date', 'error'] END,
  CASE WHEN NOT identified THEN ['missing_identity_field', 'identity_number', 'error'] END,
  CASE WHEN number IN ('short', 'edges') THEN ['invalid_vat_number_format', 'vat_number', 'error'] END,
  CASE WHEN issued > DATE '1999-06-01' THEN ['future_issue_date', 'issue_date', 'error'] END,
  CASE WHEN supplied > issued THEN ['supply_date_after_issue_date', 'supply_date', 'warning'] END,
  CASE WHEN seller = buyer THEN ['seller_equals_buyer', 'buyer_id', 'error'] END], lambda x: x IS NOT NULL) AS i FROM d)
SELECT document_id, CAST(p - 1 AS INTEGER) AS position, i[p][1] AS rule_id, i[p][2] AS field, i[p][3] AS severity FROM l, unnest(range(1, len(i) + 1)) u(p)""",
    "category_resolution": _with(INVOICES) + """
SELECT 'inv_' || i.k AS filename, cat AS tax_category, count(*) AS line_count, CAST(sum(i.base) AS DOUBLE) AS base FROM items i JOIN orders ON o_orderkey = i.k GROUP BY i.k, cat""",
    "classification_split": """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS line_id, CASE l_returnflag WHEN 'A' THEN 'standard' WHEN 'N' THEN 'other' END AS tax_category,
  CASE WHEN l_returnflag = 'A' THEN 'valid' ELSE 'invalid' END AS outcome FROM lineitem""",
    "payload_lines": _with(LINES, TOTALS) + """
SELECT invoice_id, CASE WHEN invoice_id % 40 = 3 OR invoice_id % 50 = 7 THEN NULL ELSE CAST(total_vat AS DOUBLE) END AS total_vat,
  CASE WHEN invoice_id % 40 = 3 OR invoice_id % 50 = 7 THEN 'rejected' ELSE 'parsed' END AS outcome FROM totals""",
    "result_roundtrip": _with(LINES, TOTALS) + """
SELECT invoice_id, CAST(line_count AS INTEGER) AS line_count, CAST(total_vat AS DOUBLE) AS total_vat, CAST(subtotal + total_vat AS DOUBLE) AS grand_total, has_flagged_lines FROM totals""",
    "match_reference": _with(SIDES, PASS1) + "SELECT row_a, row_b, agrees, possible_vat_gap FROM p1g",
    "vat_gap": _with(SIDES, PASS1) + """
SELECT possible_vat_gap, count(*) AS n, CAST(sum(abs(amt_a - amt_b)) AS DOUBLE) AS gap FROM p1g WHERE NOT agrees GROUP BY possible_vat_gap""",
    "match_amount": _with(SIDES, PASS1, PASS2) + "SELECT row_a, row_b, CAST(amount AS DOUBLE) AS amount FROM p2",
    "fuzzy_candidates": _with(*RECON) + "SELECT row_a AS row_id, n_candidates, n_wanting FROM per_a",
    "fuzzy_classification": _with(*RECON) + "SELECT item_id, kind, CAST(n_candidates AS BIGINT) AS n_candidates, row_a, row_b FROM items",
    "unmatched_rows": _with(*RECON) + """
SELECT row_id, 'a' AS source, CAST(amount AS DOUBLE) AS amount FROM ma WHERE NOT EXISTS (SELECT 1 FROM per_a WHERE per_a.row_a = ma.row_id)
UNION ALL SELECT row_id, 'b', CAST(amount AS DOUBLE) FROM mb WHERE NOT EXISTS (SELECT 1 FROM cand WHERE cand.row_b = mb.row_id)""",
    "leftover_pool": _with(*RECON) + """,
touched AS (SELECT row_a AS row_id FROM reviewed WHERE coalesce(decision, '') <> 'confirmed' AND row_a IS NOT NULL
  UNION SELECT row_b FROM reviewed WHERE coalesce(decision, '') <> 'confirmed' AND row_b IS NOT NULL
  UNION SELECT c.row_b FROM reviewed r JOIN cand c ON c.row_a = r.row_a WHERE r.kind = 'ambiguous'),
both_sides AS (SELECT row_id, 'a' AS source, amount FROM ledger UNION ALL SELECT row_id, 'b', amount FROM statement)
SELECT row_id, source, CAST(amount AS DOUBLE) AS amount FROM touched JOIN both_sides USING (row_id) ANTI JOIN settled USING (row_id)""",
    "stale_items": _with(*RECON) + """
SELECT item_id, kind, decision FROM reviewed r WHERE kind <> 'unmatched' OR NOT EXISTS (SELECT 1 FROM settled WHERE settled.row_id = coalesce(r.row_a, r.row_b))""",
    "double_claims": _with(*RECON) + """
SELECT selected AS candidate_id, item_id, n_claims FROM (SELECT *, count(*) OVER (PARTITION BY selected) AS n_claims FROM reviewed WHERE selected IS NOT NULL) WHERE n_claims > 1""",
    "invalid_selections": _with(*RECON) + """
SELECT item_id, 'b_none' AS selected_candidate_id FROM reviewed WHERE kind = 'ambiguous' AND decision = 'confirmed' AND ord_a % 2 = 0""",
    "contested_groups": _with(*RECON) + """
SELECT pick AS candidate_id, item_id, count(*) OVER (PARTITION BY pick) AS n_items FROM items WHERE kind = 'ambiguous' AND n_candidates = 1""",
    "group_decisions": _with(*RECON) + """,
g AS (SELECT pick AS c, item_id, CAST(split_part(pick, '_', 2) AS BIGINT) % 3 AS m, min(item_id) OVER (PARTITION BY pick) AS first FROM items WHERE kind = 'ambiguous' AND n_candidates = 1)
SELECT item_id, CASE WHEN m = 1 THEN NULL WHEN m = 0 AND item_id = first THEN 'confirmed' ELSE 'dismissed' END AS decision,
  CASE WHEN m = 0 AND item_id = first THEN c END AS selected_candidate_id FROM g""",
    "control_totals": _with(*RECON) + """,
seen AS (SELECT row_a AS row_id FROM matched UNION SELECT row_b FROM matched UNION SELECT row_a FROM items WHERE row_a IS NOT NULL UNION SELECT row_b FROM items WHERE row_b IS NOT NULL
  UNION SELECT c.row_b FROM items i JOIN cand c ON c.row_a = i.row_a WHERE i.kind = 'ambiguous')
SELECT (SELECT CAST(sum(amount) AS DOUBLE) FROM matched m JOIN ledger a ON a.row_id = m.row_a) AS matched_amount_a,
  (SELECT CAST(sum(amount) AS DOUBLE) FROM matched m JOIN statement b ON b.row_id = m.row_b) AS matched_amount_b,
  (SELECT CAST(sum(amount) AS DOUBLE) FROM ledger JOIN seen USING (row_id)) AS grand_total_a,
  (SELECT CAST(sum(amount) AS DOUBLE) FROM statement JOIN seen USING (row_id)) AS grand_total_b, (SELECT count(*) FROM matched) AS matched_count""",
    "summary_counts": _with(*RECON) + """
SELECT count(*) FILTER (WHERE kind = 'amount_mismatch') AS mismatch_count, count(*) FILTER (WHERE kind = 'group_match') AS group_match_count,
  count(*) FILTER (WHERE kind = 'sum_match') AS sum_match_count, count(*) FILTER (WHERE kind NOT IN ('amount_mismatch', 'group_match', 'sum_match')) AS other_exception_count,
  count(*) FILTER (WHERE decision = 'confirmed') AS confirmed, count(*) FILTER (WHERE decision = 'dismissed') AS dismissed, count(*) FILTER (WHERE decision IS NULL) AS unresolved FROM reviewed""",
    "exception_rows": _with(*RECON, CHOICE) + "SELECT * FROM report",
    "exception_findings": _with(*RECON, CHOICE) + """
SELECT item_id, concat_ws(' | ', '* ' || exception_type, 'ours ' || coalesce(nullif(side_a, ''), '-') || ' ' || coalesce(nullif(amount_a, ''), '-'),
  'theirs ' || coalesce(nullif(side_b, ''), '-') || ' ' || coalesce(nullif(amount_b, ''), '-'), status, '-') AS finding FROM report""",
    "register_scan": """
SELECT 'D-' || o_orderkey AS doc_no, 3 AS n_cells, md5(CASE o_orderkey % 3 WHEN 0 THEN 'lot ' || o_orderkey
  WHEN 1 THEN 'line one, of ' || o_orderkey || chr(10) || '"second"' || chr(10) || chr(10) || 'last' ELSE 'say "' || o_orderkey || '"' || chr(10) END) AS note_md5,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders""",
    "sequential_references": """
WITH r AS (SELECT o_orderkey AS ordinal, o_orderkey * 7 AS n, 'PO' || o_orderstatus || '-' AS series FROM orders),
g AS (SELECT *, n - lag(n) OVER w AS before, lead(n) OVER w - n AS after FROM r WINDOW w AS (PARTITION BY series ORDER BY n))
SELECT ordinal, series || n AS reference FROM g WHERE before <= 20 OR after <= 20""",
    "group_options": _with(*RECON, POOL4, SUBSETS) + """
SELECT t AS target, CAST(least(count(*), 2) AS INTEGER) AS n, CASE WHEN count(*) = 1 THEN min(members) END AS members FROM fits GROUP BY t""",
    "ledger_rows": """
SELECT 'a_' || o_orderkey AS row_id, 'D-' || o_orderkey AS reference, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS description FROM orders""",
    "normalized_references": r"""
WITH d AS (SELECT c_name AS n, c_nationkey AS k FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier)
SELECT ' ' || upper(n) || '/' || k AS raw, regexp_replace(lower(n) || k, '[^\p{L}\p{N}]', '', 'g') AS reference FROM d""",
    "description_tokens": """
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower('Purchase of ' || p_name || ' ' || p_type || ' ' || p_brand), '[a-z]{4,}'),
  lambda w: w NOT IN ('purchase', 'order', 'invoice', 'service')))), ' ') AS tokens FROM part""",
    "parsed_amounts": """
WITH v AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS x, o_orderkey % 5 AS m FROM orders)
SELECT o_orderkey, CASE WHEN m = 3 THEN NULL WHEN m = 2 THEN -x WHEN m = 4 THEN NULL ELSE x END AS signed, CASE WHEN m IN (3, 4) THEN NULL ELSE x END AS absolute FROM v""",
    "register_rows": _with(REGISTERS) + """
SELECT 'sales' AS source_id, 'sales' AS role, false AS is_total, count(*) AS n, CAST(sum(base) AS DOUBLE) AS amount, CAST(sum(vat) AS DOUBLE) AS vat FROM sales
UNION ALL SELECT source_id, 'purchases', false, count(*), CAST(sum(base) AS DOUBLE), CAST(sum(vat) AS DOUBLE) FROM bought GROUP BY source_id
UNION ALL SELECT 'sales', 'sales', true, 1, NULL, CAST(sum(vat) AS DOUBLE) FROM sales
UNION ALL SELECT source_id, 'purchases', true, 1, NULL, CAST(sum(vat) + CASE source_id WHEN 'stated' THEN 12.50 ELSE 0.01 END AS DOUBLE) FROM bought GROUP BY source_id""",
    "total_check": _with(REGISTERS) + """
SELECT 'stated' AS source_id, 'total_differs' AS issue, 'stated ' || CAST(CAST(sum(vat) + 12.50 AS DECIMAL(24,2)) AS VARCHAR) || ', rows give ' || CAST(CAST(sum(vat) AS DECIMAL(24,2)) AS VARCHAR) AS detail
  FROM bought WHERE source_id = 'stated'
UNION ALL SELECT s, 'default_rate_assumed', 'rows without a rate of their own were checked at the standard rate' FROM (VALUES ('sales'), ('guessed')) x(s)""",
    "row_vat_check": _with(REGISTERS) + """
SELECT 'sales' AS source_id, row_index, label, CAST(vat AS DOUBLE) AS vat_amount,
  CASE WHEN open_rate THEN '0.00 or ' ELSE '' END || CAST(CAST(CASE WHEN zero THEN 0 ELSE round(base * 0.15, 2) END AS DECIMAL(24,2)) AS VARCHAR) AS expected FROM sales WHERE row_index % 100 = 1
UNION ALL SELECT source_id, row_index, CASE source_id WHEN 'stated' THEN expense ELSE 'monthly bill' END, CAST(vat AS DOUBLE),
  '0.00 or ' || CAST(CAST(round(base * 0.15, 2) AS DECIMAL(24,2)) AS VARCHAR) FROM bought WHERE l_partkey % 100 = 3""",
    "reclaimability": _with(REGISTERS) + "SELECT source_id, row_index, CAST(vat AS DOUBLE) AS vat_amount, reclaimable, reason_code, keyword, needs_review FROM purchases",
    "period_headline": _with(REGISTERS) + """,
f AS (SELECT (SELECT sum(vat) FROM sales) AS o, (SELECT sum(vat) FROM purchases) AS i, (SELECT sum(vat) FROM purchases WHERE reclaimable AND NOT needs_review) AS r,
  (SELECT count(*) FROM sales) AS ns, (SELECT count(*) FROM purchases) AS np, (SELECT count(*) FROM purchases WHERE needs_review) AS pending)
SELECT CAST(o AS DOUBLE) AS output_vat, CAST(i AS DOUBLE) AS input_vat_total, CAST(r AS DOUBLE) AS reclaimable_input_vat, CAST(o - r AS DOUBLE) AS net_position,
  ns AS sales_row_count, np AS purchase_row_count, pending AS pending_count, CASE WHEN pending > 0 THEN 'awaiting_review' ELSE 'ready' END AS status FROM f""",
    "period_final": _with(REGISTERS) + """,
f AS (SELECT (SELECT sum(vat) FROM sales) AS o, (SELECT sum(vat) FROM purchases) AS i, (SELECT sum(vat) FROM decided WHERE final) AS r,
  (SELECT count(*) FROM sales) AS ns, (SELECT count(*) FROM purchases) AS np)
SELECT CAST(o AS DOUBLE) AS output_vat, CAST(i AS DOUBLE) AS input_vat_total, CAST(r AS DOUBLE) AS reclaimable_input_vat, CAST(o - r AS DOUBLE) AS net_position,
  ns AS sales_row_count, np AS purchase_row_count, CAST(0 AS BIGINT) AS pending_count, 'ready' AS status FROM f""",
    "excluded_purchases": _with(REGISTERS) + "SELECT source_id, row_index, CAST(vat AS DOUBLE) AS vat_amount, reason_code FROM decided WHERE NOT final",
    "headline_rows": _with(REGISTERS) + """,
f AS (SELECT (SELECT sum(vat) FROM sales) AS o, (SELECT sum(vat) FROM purchases) AS i, (SELECT sum(vat) FROM purchases WHERE reclaimable AND NOT needs_review) AS r)
SELECT 0 AS position, 'output_vat' AS key, CAST(o AS DOUBLE) AS value, 'VAT on sales' AS label FROM f UNION ALL SELECT 1, 'input_vat_total', CAST(i AS DOUBLE), 'VAT on purchases' FROM f
UNION ALL SELECT 2, 'reclaimable_input_vat', CAST(r AS DOUBLE), 'VAT to reclaim' FROM f UNION ALL SELECT 3, 'net_position', CAST(o - r AS DOUBLE), 'Net VAT (owed when positive)' FROM f""",
    "vector_topk": _with(VECTORS) + "SELECT query_id, scope, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits",
    "language_fallback": _with(VECTORS) + "SELECT query_id, id, CAST(rank AS INTEGER) AS rank, cross_language FROM chosen",
    "retrieve_context": _with(VECTORS, TABLES, CHOSEN, PARTS) + """
SELECT c.query_id, CAST(position AS INTEGER) AS position, CAST(tier AS INTEGER) AS tier, content_kind, table_ref, f.cross_language, md5(text) AS text_md5
  FROM capped c JOIN (SELECT DISTINCT query_id, cross_language FROM found) f USING (query_id)""",
    "cross_reference": _with(VECTORS, TABLES, "found AS (SELECT id AS query_id, id, 1 AS rank, false AS cross_language FROM docs)", PARTS) + """
SELECT query_id, CAST(step AS INTEGER) AS step, content_kind, document_type, table_ref, source_url FROM context WHERE tier = 2""",
    "reply_kinds": _with(VECTORS) + """,
q AS (SELECT query_id, CASE WHEN query_id LIKE '%3' THEN 'What about Oman? ' || text ELSE text END AS t FROM asked),
c AS (SELECT *, CASE WHEN contains(lower(t), 'bahrain') THEN 'Bahrain' WHEN contains(lower(t), 'uae') THEN 'UAE' WHEN contains(lower(t), 'oman') THEN 'Oman'
  WHEN contains(lower(t), 'qatar') THEN 'Qatar' WHEN contains(lower(t), 'kuwait') THEN 'Kuwait' END AS country FROM q)
SELECT query_id, country, CASE WHEN country IS NOT NULL THEN 'wrong_jurisdiction' WHEN f.x IS NULL THEN 'nothing_found' WHEN f.x THEN 'cross_language' ELSE 'answer' END AS reply_kind
  FROM c LEFT JOIN (SELECT query_id, bool_or(cross_language) AS x FROM chosen GROUP BY query_id) f USING (query_id)""",
    "context_block": _with(VECTORS, TABLES, CHOSEN, PARTS) + """
SELECT query_id, md5(string_agg('[' || position || '] ' || text || chr(10) || 'from ' || CASE WHEN sited THEN 'site' ELSE 'unknown' END || '; KSA; version '
  || CASE WHEN sited THEN 'current' ELSE 'unknown' END || '; ' || coalesce(document_type, 'unknown') || '; current ' || CAST(coalesce(is_current, true) AS VARCHAR),
  chr(10) || chr(10) ORDER BY position)) AS context_md5 FROM capped GROUP BY query_id""",
    "chunk_articles": _with(ARTICLES) + "SELECT doc_id, article_number, part_index, CAST(word_count AS INTEGER) AS word_count, md5(text) AS text_md5 FROM chunks",
    "chunk_references": _with(ARTICLES) + r"""
SELECT doc_id, article_number, part_index, array_to_string(list_filter(regexp_extract_all(text, '(?i)Articles?\s*\(?([0-9]+)\)?', 1), lambda n: n <> article_number), ',') AS cited FROM chunks""",
    "chunk_fallback": _with(r"""
docs AS (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents WHERE text <> ''),
cut AS (SELECT *, """ + WORDS + r""" AS w FROM docs),
pieces AS (SELECT *, greatest(1, CAST(ceil(len(w) / 500.0) AS INTEGER)) AS n FROM cut WHERE body <> ''),
chunks AS (SELECT doc_id, 'fallback-1' AS article_number, CAST(j AS INTEGER) AS part_index, CASE WHEN n = 1 THEN len(w) ELSE len(w[j * 500 + 1 : j * 500 + 500]) END AS word_count,
  source || ', Section 1:' || CASE WHEN n > 1 THEN ' (part ' || (j + 1) || '/' || n || ')' ELSE '' END || ' '
    || CASE WHEN n = 1 THEN body ELSE array_to_string(w[j * 500 + 1 : j * 500 + 500], ' ') END AS text FROM pieces, unnest(range(0, n)) u(j))""") + """
SELECT doc_id, article_number, part_index, CAST(word_count AS INTEGER) AS word_count, md5(text) AS text_md5 FROM chunks""",
    "ingest_points": _with(ARTICLES) + """
SELECT 'doc' || doc_id AS path, count(*) AS prose_chunks, CAST(0 AS BIGINT) AS tables FROM chunks GROUP BY doc_id
UNION ALL SELECT 't' || n_nationkey, 0, 1 FROM nation""",
    "stable_ids": f"""
WITH d AS (SELECT doc_id, sha1(unhex('{NAMESPACE.hex}') || encode(source || ':' || lang || ':article:' || doc_id)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1)
  || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM d""",
    "table_description": _with(TABLES) + """,
run AS (SELECT *, sum(length(fragment)) OVER (PARTITION BY table_ref ORDER BY row_index) AS used, row_number() OVER (PARTITION BY table_ref ORDER BY row_index) AS r FROM rowtext),
sample AS (SELECT table_ref, string_agg(fragment, '; ' ORDER BY row_index) AS txt FROM run WHERE used <= 150 OR r = 1 GROUP BY table_ref),
n AS (SELECT table_ref, count(*) AS c FROM rowtext GROUP BY table_ref)
SELECT 't' || n_nationkey AS table_ref, 'Table of ' || n_name || ' (' || coalesce(c, 0) || ' rows; columns supplier, 0, blank).' || coalesce(' Rows: ' || txt, '') AS description
  FROM nation LEFT JOIN sample ON sample.table_ref = 't' || n_nationkey LEFT JOIN n ON n.table_ref = 't' || n_nationkey""",
    "table_text": _with(TABLES) + "SELECT * FROM tabletext",
    "registry_upsert": """
SELECT 't' || n_nationkey AS table_ref, n_name AS document_type, 'new' AS version_label, 'KSA' AS jurisdiction, CASE WHEN n_nationkey % 2 = 0 THEN 'about t' || n_nationkey END AS description,
  n_nationkey % 6 = 0 AS corrected, CASE WHEN n_nationkey % 2 = 0 THEN '2024-01-01' ELSE '2024-02-02' END AS created FROM nation""",
    "language_detect": """
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'ar' ELSE 'en' END AS language, doc_id % 9 = 0 AS translate FROM documents""",
    "intent": r"""
WITH m AS (SELECT conv_id AS thread_id, turn AS seq, lower(CASE turn % 3 WHEN 1 THEN 'Calculate the tax. ' WHEN 2 THEN 'Tell me about it. ' ELSE '' END || text) AS t FROM conversations)
SELECT thread_id, seq, CASE WHEN regexp_matches(t, '\b(zatca|vat|calculate|calculator|compliance|tax)\b') THEN 'calculator'
  WHEN regexp_matches(t, '\b(feature|features|what is|how to use|tell me about|help me with)\b') THEN 'product_info' ELSE 'general' END AS intent FROM m""",
    "strip_markup": r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\\[|\\\]', '', 'g'), '\\\(|\\\)', '', 'g'), '\$\$|\$', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\text\{([^{}]*)\}', '\1', 'g'), '\\frac\{([^{}]*)\}\{([^{}]*)\}', '(\1/\2)', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\times', 'x', 'g'), '\\div', '/', 'g'), '\\cdot', 'x', 'g'), '\\left|\\right', '', 'g'), ' {2,}', ' ', 'g') AS t FROM b)
SELECT doc_id, md5(array_to_string(list_transform(string_split(t, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10))) AS text_md5 FROM c""",
    "stated_names": "SELECT conv_id AS thread_id, turn AS seq, CASE WHEN turn % 2 = 0 THEN 'Dana Lee' ELSE 'Sam' END AS name FROM conversations",
    "session_window": """
SELECT thread_id, seq, role FROM (SELECT conv_id AS thread_id, turn AS seq, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3""",
    "wire_window": """
SELECT thread_id, seq, role FROM (SELECT conv_id AS thread_id, turn AS seq, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
WHERE r <= 4 AND role IN ('user', 'assistant')""",
    "last_question": """
SELECT conv_id AS thread_id, max(turn) AS seq, md5(arg_max(text, turn)) AS content_md5 FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    "session_view": r"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
q AS (SELECT conv_id, lower(arg_max(text, turn)) AS t FROM k WHERE r <= 5 AND role = 'user' GROUP BY conv_id)
SELECT k.conv_id AS thread_id, count(*) FILTER (WHERE r <= 5) AS history_size, nullif(count(*) FILTER (WHERE r <= 3 AND role IN ('user', 'assistant')), 0) AS window_size,
  CASE WHEN any_value(q.t) IS NOT NULL THEN 'en' END AS language, CASE WHEN any_value(q.t) IS NULL THEN NULL WHEN regexp_matches(any_value(q.t), '\b(zatca|vat|calculate|calculator|compliance|tax)\b') THEN 'calculator'
  WHEN regexp_matches(any_value(q.t), '\b(feature|features|what is|how to use|tell me about|help me with)\b') THEN 'product_info' ELSE 'general' END AS intent
  FROM k LEFT JOIN q USING (conv_id) GROUP BY k.conv_id""",
    "merged_profiles": """
SELECT user_id, arg_max(props, event_id) FILTER (WHERE event_id % 5 = 0) AS user_name, CAST(max(event_id) FILTER (WHERE event_type = 'click') AS VARCHAR) AS email,
  arg_max(event_type, event_id) AS preferred_tone FROM events GROUP BY user_id""",
    "latest_note": _with(NOTES) + "SELECT user_id, customer_name, status, notes, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC) AS r FROM notes) WHERE r = 1",
    "recent_activity": """
SELECT user_id, event_id, event_type, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5""",
    "ilike_notes": _with(NOTES) + "SELECT user_id, customer_name, status, notes, created_at FROM notes WHERE user_id = 'u3' AND customer_name ILIKE '%omer#0000000_3%' ORDER BY created_at DESC LIMIT 10",
    "note_answers": _with(NOTES) + """,
asks AS (SELECT c_custkey AS request_id, 'u' || (c_custkey % 20) AS user_id, CASE WHEN c_custkey % 4 <> 0 THEN lpad(CAST(c_custkey + c_custkey % 2 AS VARCHAR), 9, '0') END AS wanted FROM customer),
hits AS (SELECT request_id, wanted, line, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, line) AS r FROM asks JOIN noted USING (user_id) WHERE wanted IS NOT NULL AND contains(customer_name, wanted)),
named AS (SELECT request_id, string_agg(line, chr(10) ORDER BY r) AS found FROM hits WHERE r <= 3 GROUP BY request_id),
newest AS (SELECT user_id, arg_max(line, created_at || line) AS found FROM noted GROUP BY user_id)
SELECT request_id, CASE WHEN wanted IS NULL THEN coalesce(w.found, 'No filing records.') ELSE coalesce(n.found, 'No filing records for ' || wanted || '.') END AS answer
  FROM asks LEFT JOIN named n USING (request_id) LEFT JOIN newest w USING (user_id)""",
    "ttl_lookup": """
SELECT 'b' || event_id AS batch_id, 'u' || user_id AS user_id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'ready' ELSE 'awaiting_review' END AS status FROM events
WHERE ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-02 12:00:00' AND (event_id % 2 = 0 OR user_id = 0)""",
    "batch_update": """
WITH b AS (SELECT event_type AS kind, event_id % 6 = 0 AS hit, CASE WHEN event_id % 2 = 0 THEN 'ready' ELSE 'awaiting_review' END AS s FROM events)
SELECT CASE WHEN hit THEN 'done' ELSE s END AS status, kind, count(*) AS n, count(*) FILTER (WHERE hit) AS emptied FROM b GROUP BY 1, 2""",
    "memory_upsert": """
WITH e AS (SELECT 'u' || user_id AS user_id, event_type AS customer_name, props, event_id, ts, event_id % 2 = 1 AS late FROM events),
g AS (SELECT user_id, customer_name, string_agg(props, chr(10) ORDER BY late, event_id) AS ctx, arg_max(event_id, event_id) FILTER (WHERE late) AS new_id, max(event_id) AS any_id,
  min(ts) FILTER (WHERE NOT late) AS c0, min(ts) AS c1, max(ts) FILTER (WHERE late) AS u1, max(ts) AS u0 FROM e GROUP BY user_id, customer_name)
SELECT user_id, customer_name, md5(ctx) AS context_md5, 'issue ' || coalesce(new_id, any_id) AS issue_summary, strftime(coalesce(c0, c1), '%Y-%m-%d %H:%M:%S') AS created,
  strftime(coalesce(u1, u0), '%Y-%m-%d %H:%M:%S') AS updated FROM g""",
    "html_text": _html_sql(),
    "file_routes": """
WITH f AS (SELECT o_orderkey % 7 AS m, '/in/v1.2/f' || o_orderkey || ['.XML', '.csv', '.txt', '.md', '.pdf', '', '.tar.gz'][o_orderkey % 7 + 1] AS path FROM orders)
SELECT path, CASE m WHEN 0 THEN 'ubl_xml' WHEN 1 THEN 'csv' WHEN 2 THEN 'text' WHEN 3 THEN 'text' END AS format,
  CASE m WHEN 4 THEN 'unsupported file type .pdf' WHEN 5 THEN 'unsupported file type (none)' WHEN 6 THEN 'unsupported file type .gz' END AS reason FROM f""",
    "manifest_join": """
SELECT 'docs/' || doc_id || '.md' AS path, source AS document_type, lang AS language, CASE WHEN doc_id % 4 = 0 THEN 'v2' ELSE 'current' END AS version_label, doc_id % 5 <> 0 AS is_current,
  CASE WHEN doc_id % 3 <> 0 THEN '/data/docs/' || doc_id || '.md' END AS file_path, CASE WHEN doc_id % 3 = 0 THEN 'file not found' END AS reason FROM documents""",
    "first_tables": """
SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 7 <> 0 THEN CAST((3 - o_orderkey % 3) % 3 AS INTEGER) END AS table_index,
  CASE WHEN o_orderkey % 7 = 0 THEN 'no table with an amount, debit or credit column' END AS reason FROM orders""",
    "dispatch": """
SELECT 'inv_' || o_orderkey AS filename, CASE WHEN o_orderkey % 9 = 0 THEN 'tables' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'lines'
  ELSE 'neither a table nor line items' END AS outcome FROM orders""",
    "rows_from_invoices": """
WITH l AS (SELECT 'inv_' || o_orderkey AS source_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line,
  l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 9 <> 0),
f AS (SELECT source_id, row_number() OVER (ORDER BY source_id) - 1 AS file, n, CAST(sum(n) OVER (ORDER BY source_id) AS BIGINT) AS upto FROM (SELECT source_id, count(*) AS n FROM l GROUP BY source_id))
SELECT 'a_' || CASE WHEN file > 0 THEN file || ':' ELSE '' END || line AS row_id, line AS reference, CASE WHEN k % 29 <> 0 THEN strftime(day, '%Y-%m-%d') END AS date,
  CAST(amount AS DOUBLE) AS amount, 'part ' || l_partkey AS description, source_id, upto - n AS first_ordinal, upto - 1 AS last_ordinal FROM l JOIN f USING (source_id)""",
    "replaced_rows": """
SELECT 't' || s_nationkey AS table_ref, s_suppkey AS row_index, s_name AS supplier FROM supplier
WHERE s_nationkey % 2 = 1 OR s_suppkey % 2 = 0 OR NOT EXISTS (SELECT 1 FROM supplier x WHERE x.s_nationkey = supplier.s_nationkey AND x.s_suppkey % 2 = 0)""",
    "registry_changes": """
SELECT 's' || s_suppkey AS table_ref, 'lists' AS document_type, CASE WHEN s_suppkey % 2 = 0 THEN 'second' END AS description, s_suppkey % 3 = 0 AS corrected,
  CASE WHEN s_suppkey % 3 = 0 THEN '2024-05-01' END AS corrected_date, true AS is_current FROM supplier WHERE s_suppkey % 5 <> 0""",
    "point_snapshots": _with(ARTICLES) + """
SELECT 'doc' || doc_id AS path, article_number, part_index, md5(CASE WHEN doc_id % 2 = 0 AND article_number = '1' AND part_index = 0 THEN doc_id || ', Article 1: new'
  ELSE doc_id || substr(c.text, length(d.source) + 1) END) AS text_md5 FROM chunks c JOIN documents d USING (doc_id)""",
    "customer_memories": """
WITH e AS (SELECT 'u' || user_id AS user_id, event_type AS customer_name, props, event_id, ts FROM events WHERE user_id = 3 AND event_type ILIKE '%i%')
SELECT user_id, customer_name, md5(string_agg(props, chr(10) ORDER BY event_id)) AS context_md5, 'issue ' || max(event_id) AS issue_summary,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated FROM e GROUP BY user_id, customer_name ORDER BY min(ts) DESC LIMIT 10""",
    "citations": _with(VECTORS, TABLES, CHOSEN, PARTS) + """
SELECT query_id, CAST(position AS INTEGER) AS position, document_type, CASE WHEN sited THEN 'KSA' END AS jurisdiction, CASE WHEN sited THEN 'current' END AS version_label,
  CASE WHEN sited THEN 'site' END AS source_site, source_url FROM capped""",
    "item_numbers": _with(REGISTERS) + """
SELECT source_id, row_index, row_number() OVER (ORDER BY CASE source_id WHEN 'stated' THEN 2 ELSE 3 END, row_index) - 1 AS number FROM purchases""",
    "filing_note": _with(REGISTERS) + """,
f AS (SELECT (SELECT sum(vat) FROM sales) AS o, (SELECT sum(vat) FROM decided WHERE final) AS r),
m AS (SELECT CAST(CAST(o AS DECIMAL(24,2)) AS VARCHAR) AS o, CAST(CAST(r AS DECIMAL(24,2)) AS VARCHAR) AS r, CAST(CAST(o - r AS DECIMAL(24,2)) AS VARCHAR) AS n FROM f)
SELECT 'u1' AS user_id, 'Demo Trading' AS customer_name, 'ready' AS status, 'Return for 2024-Q1: VAT on sales ' || o || ', to reclaim ' || r || ', net ' || n AS notes FROM m""",
    "workpapers": _with(REGISTERS) + """,
f AS (SELECT (SELECT sum(vat) FROM sales) AS o, (SELECT sum(vat) FROM purchases) AS i, (SELECT sum(vat) FROM decided WHERE final) AS r)
SELECT 'headline' AS dataset, 'ضريبة المبيعات' AS name, CAST(o AS DOUBLE) AS value FROM f UNION ALL SELECT 'headline', 'ضريبة المشتريات', CAST(i AS DOUBLE) FROM f
UNION ALL SELECT 'headline', 'ضريبة قابلة للخصم', CAST(r AS DOUBLE) FROM f UNION ALL SELECT 'headline', 'صافي الضريبة (مستحق إن كان موجبا)', CAST(o - r AS DOUBLE) FROM f
UNION ALL SELECT 'excluded', reason_code, CAST(sum(vat) AS DOUBLE) FROM decided WHERE NOT final GROUP BY reason_code
UNION ALL SELECT 'issues', 'total_differs', 1 UNION ALL SELECT 'issues', 'default_rate_assumed', 2""",
    "printed_numbers": """
WITH c AS (SELECT c_custkey, c_name, c_mktsegment, '3' || lpad(CAST(c_custkey * 7 AS VARCHAR), 13, '0') || CASE WHEN c_custkey % 3 = 0 THEN '3' ELSE '4' END AS n FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n END AS vat_number, md5(c_name || ' / VAT ' || n || ', tel. ' || c_custkey) AS western_md5,
  regexp_replace(c_name, '[^A-Za-z0-9_.-]', '_', 'g') AS file_name, 'rates_of_' || replace(lower(c_mktsegment), ' ', '_') || '_table_' || c_custkey AS table_ref FROM c""",
}
ORACLE |= {"memory_snapshots": ORACLE["memory_upsert"], "profile_snapshots": ORACLE["merged_profiles"]}

# A query that continues the WITH list starts with a comma.
ORACLE = {name: sql.replace("\n,\n", ",\n").replace(")\n,", "),") for name, sql in ORACLE.items()}
