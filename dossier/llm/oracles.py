"""SQL (DuckDB) for the operators that SQL can express."""

from __future__ import annotations

from .url_filter import ENTITIES, LOWER, RULES, UPPER


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _key(url: str) -> str:
    return f"{_host(url)} || regexp_replace({_path(url)}, '/$', '') || coalesce(regexp_extract({url}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1), '')"


def _rule(host: str, path: str, what: int) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "allow", r))
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, verdict)[what]}'" for verdict, h, p in ordered) + " END"


def _dotless(path: str) -> str:
    kept = f"list_reduce(list_transform(string_split({path}, '/'), lambda x: [x]), lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, x) END)"
    return f"array_to_string({kept}, '/') || CASE WHEN string_split({path}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END"


def _absolute(target: str) -> str:
    scheme, root = "regexp_extract(url, '(?s)^(.*?)://', 1)", f"regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || {_host('url')}"
    before, rest = f"regexp_extract({target}, '(?s)^([^?#]*)', 1)", f"regexp_extract({target}, '(?s)^[^?#]*(.*)$', 1)"
    folder = f"CASE WHEN {_path('url')} = '' THEN '/' ELSE regexp_replace({_path('url')}, '[^/]*$', '') END"
    return f"""CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_extract({target}, '(?s)^(.*?://[^/?#]*)', 1) || {_dotless(_path(target))} || regexp_extract({target}, '(?s)^.*?://[^?#]*(.*)$', 1)
WHEN starts_with({target}, '//') THEN {scheme} || ':' || {target} WHEN {target} = '' OR starts_with({target}, '#') OR regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
WHEN starts_with({target}, '?') THEN {root} || {_path('url')} || {target} WHEN starts_with({target}, '/') THEN {root} || {_dotless(before)} || {rest} ELSE {root} || {_dotless(f'(({folder}) || {before})')} || {rest} END"""


def _decoded(target: str) -> str:
    for name, sign in ENTITIES:
        target = f"replace({target}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return target


_QUOTE = "[\"'']?"
_PLAIN = "regexp_replace(html, '(?s)<!--.*?(?:-->|$)', '', 'g')"
_TAGS = f"regexp_extract_all({_PLAIN}, '(?is)<link\\b[^>]*\\brel\\s*=\\s*{_QUOTE}canonical\\b[^>]*>')", f"regexp_extract_all({_PLAIN}, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*{_QUOTE}refresh\\b[^>]*>')"
_FOUND = " , ".join(f"list_transform({tags}, lambda t: regexp_extract(t, '(?is)\\b{name}\\s*=\\s*{_QUOTE}([^\"''\\s>]+)', 1))" for tags, name in zip(_TAGS, ("href", "url")))

URL_FILTER = f"""
WITH RECURSIVE linked AS (SELECT url, unnest(list_concat({_FOUND})) AS raw FROM pages WHERE contains(url, '://') AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))),
stated AS (SELECT url, {_decoded('raw')} AS link FROM linked), edges AS (SELECT url, {_absolute('link')} AS target FROM stated),
keyed AS (SELECT url, target, {_key('url')} AS a, {_key('target')} AS b FROM edges WHERE target IS NOT NULL),
arcs AS (SELECT a, b FROM keyed WHERE a <> b UNION SELECT b, a FROM keyed WHERE a <> b),
nodes AS (SELECT a AS node, url AS u FROM keyed WHERE a <> b UNION SELECT b, target FROM keyed WHERE a <> b),
tainted(node) AS (SELECT DISTINCT node FROM nodes WHERE {_rule(_host('u'), _path('u'), 1)} = 'block' UNION SELECT arcs.b FROM tainted JOIN arcs ON arcs.a = tainted.node),
judged AS (SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_key('url')} AS node FROM pages),
ruled AS (SELECT *, {_rule('host', 'path', 0)} AS rule, {_rule('host', 'path', 1)} AS own, host <> '' AND node IN (SELECT node FROM tainted) AS hit FROM judged)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict, own IS NULL AND hit AS aliased FROM ruled
"""

_NIBBLES = "[" + ", ".join(f"'{k:04b}'" for k in range(16)) + "]"
_BITS = f"array_to_string(list_transform(range(1, 41), lambda i: {_NIBBLES}[instr('0123456789abcdef', substr(h, CAST(i AS INTEGER), 1))]), '')"
_FIVE = " + ".join(f"{1 << (4 - k)} * CAST(substr(bits, CAST(i * 5 + {k + 1} AS INTEGER), 1) AS INTEGER)" for k in range(5))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, lower(sha1(payload)) AS h FROM p),
b AS (SELECT *, {_BITS} AS bits, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM b
"""

SUBSTRINGS = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents), n AS (SELECT r, doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n_bytes FROM t),
w AS (SELECT r, unnest(range(0, n_bytes - 199)) AS i FROM n WHERE n_bytes >= 200), k AS (SELECT w.r, w.i, hash(substr(x, CAST(2 * w.i + 1 AS BIGINT), 400)) AS k1, md5_number(substr(x, CAST(2 * w.i + 1 AS BIGINT), 400)) AS k2 FROM w JOIN n USING (r)),
c AS (SELECT k1, k2 FROM k GROUP BY k1, k2 HAVING count(*) > 1), hit AS (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS run FROM k JOIN c USING (k1, k2)),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM hit GROUP BY r, run), o AS (SELECT *, max(b) OVER (PARTITION BY r ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM runs),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY a) AS span FROM o), s AS (SELECT r, span, min(a) AS a, max(b) AS b FROM g GROUP BY r, span),
e AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM s), kept AS (SELECT e.r, count(*) AS n_spans, sum(b - e.a) AS n_removed, string_agg(substr(x, CAST(2 * since + 1 AS BIGINT), CAST(2 * (e.a - since) AS BIGINT)), '' ORDER BY e.a) AS head, max(b) AS stop FROM e JOIN n USING (r) GROUP BY e.r)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, CAST(2 * coalesce(stop, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM n LEFT JOIN kept USING (r)
"""

_STEP = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS UBIGINT))"
_CRC = "xor(list_reduce(list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: CAST(16 * (instr('0123456789abcdef', h[i]) - 1) + instr('0123456789abcdef', h[i + 1]) - 1 AS UBIGINT)), lambda c, b: xor(c >> 8, crcs[CAST(xor(c, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS UBIGINT)), 4294967295) % 10000"

RESAMPLING = f"""
WITH crc AS (SELECT list({_STEP} ORDER BY b) AS crcs FROM range(256) AS r(b)),
texts AS (SELECT true AS raw, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT raw, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT raw, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
kinds AS (SELECT f, lower(hex(encode(f))) AS h FROM (SELECT DISTINCT f FROM runs)), hashed AS (SELECT f, {_CRC} AS bucket FROM kinds, crc),
counted AS (SELECT raw, r, bucket, count(*) AS n FROM runs JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (raw), 0) AS s, coalesce(sum(n) FILTER (NOT raw), 0) AS t FROM counted GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM sums, totals),
weights AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, sum(n * gain) AS total FROM counted JOIN gains USING (bucket) WHERE raw GROUP BY r),
known AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS BIGINT) AS weight, substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS h FROM words LEFT JOIN weights USING (r) WHERE raw),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || h AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM known),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank FROM scored WHERE n_words >= 20),
due AS (SELECT floor(25 * count(*) / 100) AS most FROM ranked)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r), due
"""

NEGATIVES = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.r AS a, b.r AS b, a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5),
n AS (SELECT p.*, vec_id, score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, vec_id, pairs.b) AS rank FROM p JOIN pairs ON p.a = pairs.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM n WHERE rank <= 10
"""
