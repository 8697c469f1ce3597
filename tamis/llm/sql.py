"""DuckDB SQL for the operators that SQL can express."""

SECRET_SCAN = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
assigned AS (SELECT doc_id, 0 AS no, 'assign' AS kind, 6 AS least,
    regexp_extract_all(text, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
    regexp_extract_all(text, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g,
    string_split_regex(text, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS p
  FROM docs),
others AS (SELECT doc_id, no, kind, least, m, m AS g, p FROM (
    SELECT doc_id, 1 AS no, 'access' AS kind, 20 AS least, regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) AS m, string_split_regex(text, 'AKIA[A-Z0-9]+') AS p FROM docs
    UNION ALL
    SELECT doc_id, 2, 'hex', 24, regexp_extract_all(text, '[0-9a-f]+', 0), string_split_regex(text, '[0-9a-f]+') FROM docs)),
cells AS (
  SELECT doc_id, no, kind, least, unnest(m) AS m, unnest(g) AS g, unnest(p[1:len(m)]) AS p, unnest(range(len(m))) AS i
  FROM (SELECT * FROM assigned UNION ALL SELECT * FROM others) WHERE len(m) > 0),
ends AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, no ORDER BY i) AS stop FROM cells),
found AS (SELECT doc_id, no, kind, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM ends WHERE length(g) >= least),
grouped AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN grouped USING (doc_id)
"""
LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

URL_RULES = r"""
WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rests),
rules(rule_host, rule_path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""

DECONTAMINATION = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item FROM places JOIN windows USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


FANOUT = 16


def _leaf(text: str) -> str:
    """The digest of a document's fields, its text given."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR) END"
    return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(tag: str, levels: int) -> str:
    """From {tag}0(g, i, n, h): {tag}r0, ... with the runs of each level, joined, and {tag}1, ... with the nodes above."""
    parts = []
    for k in range(levels):
        parts.append(f"{tag}r{k} AS (SELECT g, i // {FANOUT} AS i, max(n) AS n, string_agg(h, '' ORDER BY i) AS run FROM {tag}{k} WHERE n > 1 GROUP BY g, i // {FANOUT})")
        parts.append(f"{tag}{k + 1} AS (SELECT g, i, (n + {FANOUT - 1}) // {FANOUT} AS n, sha256(run) AS h FROM {tag}r{k})")
    return ",\n".join(parts)


def _path(tag: str, rows: str, out: str, levels: int) -> str:
    """CTE {out}: rows with h and proof carried up through the runs of a tree; rows has g, i, h (original), shown and proof."""
    parts = []
    for k in range(levels):
        before, after = rows if k == 0 else f"{out}{k - 1}", out if k == levels - 1 else f"{out}{k}"
        place = f"(t.i // {FANOUT**k}) % {FANOUT}"
        left, right = f"substr(run, 1, 64 * ({place}))", f"substr(run, 64 * ({place}) + 65)"
        folds = ", ".join(f"CASE WHEN run IS NULL THEN {c} ELSE sha256({left} || {c} || {right}) END AS {c}" for c in ("h", "shown"))
        parts.append(f"{after} AS (SELECT t.* REPLACE ({folds}, CASE WHEN run IS NULL THEN proof ELSE proof || {left} || {right} END AS proof) FROM {before} t LEFT JOIN {tag}r{k} r ON r.g = t.g AND r.i = t.i // {FANOUT ** (k + 1)})")
    return ",\n".join(parts)


#: CRC-32 of the decimal doc_id: bytes as 256 and up, then eight shifts each.
_CRC32 = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(256 + ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x - 256) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""WITH leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf('text')} AS leaf, CASE WHEN {_CRC32} % 5 = 0 THEN {_leaf(_LOWERED)} END AS tampered FROM documents),
rows AS (SELECT *, leaf AS h, coalesce(tampered, leaf) AS shown, '' AS proof, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
a0 AS (SELECT g, i, n, h FROM rows),
{_tree('a', 8)},
{_path('a', 'rows', 'ap', 8)},
b0 AS (SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT g, h FROM ap)),
{_tree('b', 4)},
up AS (SELECT ap.* EXCLUDE (g, i, n), ap.h AS subroot, '' AS g, b0.i FROM ap JOIN b0 ON b0.name = ap.g),
{_path('b', 'up', 'bp', 4)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, shown AS folded_root, shown = h AS verified FROM bp"""

HARD_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, other_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 5"""
