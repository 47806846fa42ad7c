"""DuckDB SQL for the queries of this subpackage that SQL expresses on whole tables."""

from .licenses import GRAM, TEMPLATES, pieces
from .urls import LONG_SUFFIXES

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER.format("coalesce({0}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format('text')} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, list_slice(w, i, i + least(13, len(w)) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
ms AS (SELECT DISTINCT m FROM p),
d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format('text')} AS w FROM documents),
g AS (
  SELECT rid, m, i, list_slice(w, i, i + m - 1) AS win
  FROM (SELECT rid, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)
),
h AS (SELECT g.rid, g.i, g.m, p.item FROM g JOIN p ON g.m = p.m AND g.win = p.win),
hw AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT rid, i, m FROM h)) GROUP BY rid),
hi AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""

_HOST = r"regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)"
_LONG = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
_BARE = "regexp_replace(regexp_replace(host, '^(?s:.*)@', ''), ':[0-9]*$', '')"


def _eb(child: str, parent: str, counts: str, rates: str) -> str:
    """Posterior of each child under the beta prior of its parent."""
    return f"""(
  WITH j AS (SELECT c.*, p.rate AS r FROM {counts} c JOIN {rates} p ON c.{parent} = p.{parent}),
  f AS (SELECT {parent}, sum(pow(k * 1.0 / n - r, 2) * n - r * (1 - r)) / sum(n) AS v, min(r) AS fr FROM j GROUP BY {parent}),
  m AS (SELECT {parent}, least(1000.0, greatest(1.0, CASE WHEN v > 0 THEN fr * (1 - fr) / v - 1 ELSE 1000.0 END)) AS m FROM f)
  SELECT j.{child}, m * r + k AS a, m * (1 - r) + n - k AS b, (m * r + k) / (m + n) AS rate FROM j JOIN m ON j.{parent} = m.{parent})"""


OP9 = f"""
WITH u AS (
  SELECT page_id, translate(coalesce({_HOST}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
o AS (SELECT host, CAST(toxic = 1 OR quality = 0 AS INT) AS bad FROM u JOIN labels ON page_id = doc_id),
g AS (SELECT host, {_BARE} AS bare, string_split({_BARE}, '.') AS l, count(*) AS n, sum(bad) AS k FROM o WHERE bad IS NOT NULL AND host <> '' GROUP BY host),
g2 AS (SELECT *, regexp_matches(bare, '^([0-9]+(\\.[0-9]+){{3}}|\\[.*)$') AS ip, array_to_string(list_slice(l, -2, -1), '.') AS two FROM g),
h AS (SELECT host, n, k,
  CASE WHEN ip THEN bare WHEN two IN ({_LONG}) THEN array_to_string(list_slice(l, -3, -1), '.') ELSE two END AS domain,
  CASE WHEN ip THEN 'ip' WHEN two IN ({_LONG}) THEN two ELSE list_extract(l, -1) END AS suffix FROM g2),
d AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain),
s AS (SELECT suffix, 0 AS root, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
r AS (SELECT root, (sum(k) + 1) / (sum(n) + 2) AS rate FROM s GROUP BY root),
ps AS (SELECT * FROM {_eb('suffix', 'root', 's', 'r')}),
pd AS (SELECT * FROM {_eb('domain', 'suffix', 'd', 'ps')}),
ph AS (SELECT * FROM {_eb('host', 'domain', 'h', 'pd')}),
l AS (SELECT host, rate - 1.6449 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM ph),
e AS (SELECT u.*, lower,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u LEFT JOIN l USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM e
"""

OP10 = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest),
u AS (SELECT p.*, CASE WHEN url LIKE '%://%' THEN
  array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)), '.')), ',') || ')' || regexp_extract(url, '^(?s:.*?)://[^/?#]*((?s:.*))$', 1)
  ELSE coalesce(url, '') END AS urlkey FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, u.payload_digest,
  CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < kept THEN kept END AS refers_to, urlkey,
  row_number() OVER (ORDER BY urlkey, page_id % 31536000, page_id) - 1 AS place, row_number() OVER (PARTITION BY urlkey ORDER BY page_id % 31536000, page_id) AS capture
FROM u LEFT JOIN k ON u.payload_digest = k.payload_digest AND payload_bytes >= 1000
"""

#: The crc32 table, eight halvings of each byte with the polynomial for odd ones.
_STEPS = ",\n".join(f"c{i + 1} AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM c{i})" for i in range(8))
_HEX = "hex(encode(doc || ':' || word))"
_NEXT = "xor(crc // 256, list_extract(tab, 1 + CAST(xor(crc % 256, b) AS BIGINT)))"
OP11 = f"""
WITH RECURSIVE c0 AS (SELECT i, CAST(i AS BIGINT) AS v FROM range(256) r(i)),
{_STEPS},
t AS (SELECT list(v ORDER BY i) AS tab FROM c8),
u AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
r AS (SELECT doc, {LOWER.format('run')} AS word, count(*) AS n FROM u GROUP BY ALL),
k AS (SELECT word, n, list_reduce(
    list_prepend(4294967295, list_transform(range(0, length({_HEX}) // 2), lambda j: ('0x' || substr({_HEX}, 2 * j + 1, 2))::BIGINT)),
    lambda crc, b: {_NEXT}) AS crc FROM r, t),
h AS (SELECT word, n, xor(crc, 4294967295) AS h FROM k),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.less = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.less = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, struct_pack(a := -near_n, b := encode(near))) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN b USING (word)),
w AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT w.word, f.word, f.form FROM w JOIN f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word AND w.next IS NULL
"""

_TEMPLATES = ", ".join(f"({i}, '{label}', {base}, '{' '.join(w)}')" for i, (label, base, w) in enumerate(pieces(TEMPLATES)))
_LEADS = ", ".join(f"lead(w0, {i}) OVER p AS w{i}" for i in range(1, GRAM))
_ROLLED = " UNION ALL ".join(
    f"SELECT rid, pos, {k}, concat_ws(' ', {', '.join(f'w{i}' for i in range(k))}) FROM v WHERE w{k - 1} IS NOT NULL" for k in range(2, GRAM + 1)
)
OP12 = f"""
WITH t AS (SELECT *, string_split(words, ' ') AS tw, len(string_split(words, ' ')) AS m, least({GRAM}, len(string_split(words, ' '))) AS k
  FROM (VALUES {_TEMPLATES}) v(tid, label, base, words)),
tg AS (SELECT tid, k, tpos, array_to_string(list_slice(tw, tpos + 1, tpos + k), ' ') AS gram FROM (SELECT *, unnest(range(0, m - k + 1)) AS tpos FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format('text')} AS w FROM documents),
u AS (SELECT rid, unnest(range(0, len(w))) AS pos, unnest(w) AS w0 FROM d),
v AS (SELECT rid, pos, w0, {_LEADS} FROM u WINDOW p AS (PARTITION BY rid ORDER BY pos)),
g AS (SELECT rid, pos, 1 AS k, w0 AS gram FROM v UNION ALL {_ROLLED}),
h AS (SELECT rid, tid, pos - tpos AS diagonal, tpos FROM g JOIN tg ON g.k = tg.k AND g.gram = tg.gram),
b AS (SELECT rid, label, diagonal FROM h JOIN t USING (tid) WHERE base GROUP BY rid, tid, label, diagonal, m, k HAVING count(DISTINCT tpos) = m - k + 1),
c AS (SELECT DISTINCT rid, tid, diagonal FROM h JOIN t USING (tid) WHERE NOT base),
x AS (SELECT rid, tid, label, mid, count(DISTINCT p) / any_value(m) AS share
  FROM (SELECT c.rid, c.tid, label, c.diagonal AS mid, m, unnest(range(h.tpos, h.tpos + k)) AS p
    FROM c JOIN t USING (tid) JOIN h ON h.rid = c.rid AND h.tid = c.tid AND abs(h.diagonal - c.diagonal) <= 2)
  GROUP BY rid, tid, label, mid HAVING count(DISTINCT p) >= 0.9 * any_value(m)),
bd AS (SELECT rid, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY rid),
ld AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT rid, label, 1.0 AS share FROM b UNION ALL SELECT rid, label, share FROM x) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(CAST(score AS DOUBLE), 0.0) AS score
FROM d LEFT JOIN bd USING (rid) LEFT JOIN ld USING (rid)
"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, length(t) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
  ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {"op1_decontaminate": OP1, "op9_url_filter": OP9, "op10_warc": OP10, "op11_spelling": OP11, "op12_license_scan": OP12, "op13_fill_in_middle": OP13}
