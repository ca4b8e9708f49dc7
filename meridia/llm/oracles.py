"""SQL (DuckDB) of the corpus queries that SQL can state on whole tables; the others are tested against brute force."""

from __future__ import annotations

from meridia.llm.licenses import BASE_PHRASES, DRIFT, MIN_COVER, RARE_PER_TEMPLATE, TEMPLATES
from meridia.llm.secrets import COPIED_OWNERS, COPIED_REPOSITORIES, COPIED_TEXTS, GOES_ON, LONG, MIN_DISTINCT, MIN_FORMAT, MIN_LETTERS, PLAIN_WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

# Equal sets are one class; pairs of classes are counted by their common shingles.
OP1 = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
classes AS (SELECT s, len(s) AS n, min(doc_id) AS c FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT c, n, unnest(s) AS g FROM classes),
links AS (SELECT a.c AS x, b.c AS y FROM grams a JOIN grams b USING (g) WHERE a.c <> b.c AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
walk AS (SELECT c AS x, c AS y FROM classes UNION SELECT walk.x, links.y FROM walk JOIN links ON walk.y = links.x),
least_of AS (SELECT x, min(y) AS component_id FROM walk GROUP BY x)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least_of ON classes.c = least_of.x"""

OP3 = f"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM words WHERE len(w) >= 20),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM placed WHERE k > 1),
single AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM single ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP5 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
able AS (SELECT vec_id, label, x FROM v WHERE label IS NOT NULL AND len(x) > 0 AND list_bool_and(list_transform(x, lambda e: coalesce(isfinite(e), false))) AND list_bool_or(list_transform(x, lambda e: e <> 0))),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= .98),
walk AS (SELECT x, y FROM links UNION SELECT walk.x, links.y FROM walk JOIN links ON walk.y = links.x),
c AS (SELECT x, min(y) AS y FROM walk GROUP BY x), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id <= coalesce(y, vec_id) AS kept
FROM v LEFT JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x"""


def _licenses() -> str:
    template = lambda k, label, words, keys: f"({k}, '{label}', '{words}', [{', '.join(repr(x) for x in keys)}])"
    templates = ", ".join(template(k, *t) for k, t in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in BASE_PHRASES.items())
    return rf"""WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {phrases}) t(p, label)),
base AS (SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM docs, phrases) WHERE w[i:i + len(p) - 1] = p),
based AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY doc_id),
templates AS (SELECT t, label, string_split(words, ' ') AS own, keys FROM (VALUES {templates}) v(t, label, words, keys)),
vocabulary AS (SELECT DISTINCT unnest(own) AS word FROM templates),
seen AS (SELECT word, count(n) AS n FROM vocabulary LEFT JOIN (SELECT DISTINCT doc_id AS n, unnest(w) AS word FROM docs) USING (word) GROUP BY word),
rare AS (SELECT t, word FROM (SELECT DISTINCT t, unnest(own) AS word FROM templates) JOIN seen USING (word) QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, word) <= {RARE_PER_TEMPLATE}),
needed AS (SELECT t, least(3, count(*)) AS needed FROM rare GROUP BY t),
postings AS (SELECT t, word, q FROM (SELECT t, unnest(own) AS word, unnest(range(len(own))) AS q FROM templates) JOIN rare USING (t, word)),
votes AS (SELECT doc_id, t, p - q AS start FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs) JOIN postings USING (word) JOIN needed USING (t)
  GROUP BY doc_id, t, p - q, needed HAVING count(DISTINCT q) >= needed),
tried AS (SELECT doc_id, label, own, keys, start, w, ' ' || array_to_string(w[greatest(0, start - {DRIFT}) + 1:start + len(own) + {DRIFT}], ' ') || ' ' AS stretch FROM votes JOIN templates USING (t) JOIN docs USING (doc_id)),
covered AS (SELECT doc_id, label, list_sum(list_transform(range(len(own)), lambda q: list_contains(w[greatest(0, start + q - {DRIFT}) + 1:start + q + {DRIFT + 1}], own[q + 1])::INT)) / len(own) AS cover
  FROM tried WHERE list_bool_and(list_transform(keys, lambda k: contains(stretch, ' ' || k || ' ')))),
method AS (SELECT doc_id, max(cover) AS cover, list(DISTINCT label) AS labels FROM covered WHERE cover >= {MIN_COVER} GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, array_to_string(coalesce(based.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(method.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1 ELSE coalesce(cover, 0) END::DOUBLE AS score
FROM docs LEFT JOIN based USING (doc_id) LEFT JOIN method USING (doc_id)"""


# (kind, name, pattern, what to take off a match's front to get the value, least length)
_KINDS = [
    (0, "assign", r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.=-]+", r"^(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?", 6),
    (1, "access", r"AKIA[A-Z0-9]+", "", 20),
    (2, "hex", r"[0-9a-f]{24,}", "", 24),
    (3, "vendor", r"(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-|AIza|eyJ)[A-Za-z0-9_.-]{16,}", "", 20),
    (4, "pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+", "", 40),
    (5, "blob", r"[A-Za-z0-9+/_-]{32,}", "", 32),
]


def _secrets() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, text, owner, repository, {k} AS kind, '{name}' AS name, '{front}' AS front, {least} AS least, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits FROM docs"
        for k, name, pattern, front, least in _KINDS
    )
    return rf"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
cut AS ({found}),
hits AS (SELECT doc_id, text, owner, repository, kind, name, front, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits FROM cut),
placed AS (SELECT doc_id, text, owner, repository, kind, name, least, hits[i] AS hit, gaps[i + 1] AS after, CASE WHEN front = '' THEN hits[i] ELSE regexp_replace(hits[i], front, '') END AS value, length(hits[i]) AS n,
  list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start FROM hits),
spans AS (SELECT *, kind = 0 AND regexp_matches(left(hit, length(hit) - length(value)), ':\x20*$') AND regexp_matches(value, '{PLAIN_WORDS}') AND regexp_matches(coalesce(after, ''), '{GOES_ON}') AS prose, name || ':' || start || ':' || (start + n) AS span, len(list_distinct(string_split(value, ''))) AS chars FROM placed WHERE length(value) >= least),
held AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories, count(DISTINCT text) AS texts FROM spans GROUP BY value),
judged AS (SELECT spans.*, CASE WHEN owners >= {COPIED_OWNERS} OR repositories >= {COPIED_REPOSITORIES} OR texts >= {COPIED_TEXTS} THEN 'copied' WHEN prose THEN 'weak' WHEN CASE kind WHEN 0 THEN chars * 2 >= least(length(value), {LONG}) WHEN 4 THEN true
  WHEN 5 THEN (chars >= {MIN_DISTINCT} AND regexp_matches(value, '[0-9]')) OR (chars >= {MIN_LETTERS} AND regexp_matches(value, '^[A-Za-z]+$') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]'))
  ELSE chars >= {MIN_FORMAT} END THEN 'live' ELSE 'weak' END AS verdict FROM spans JOIN held USING (value)),
whole AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
  string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3 OR verdict = 'live') AS spans, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM docs LEFT JOIN whole USING (doc_id)"""


# CRC-32 byte by byte, from a table of its 256 remainders.
OP12 = f"""WITH remainders AS (SELECT list(r ORDER BY i) AS table_of FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) AS r FROM range(256) t(i))),
turns AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY i) AS w FROM turns GROUP BY c),
headed AS (SELECT c, w, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda a, b: xor(a >> 8, table_of[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM own, remainders),
built AS (SELECT o.c, list_concat(coalesce(b.w, [])[1:h], o.w[h + 1:]) AS w FROM headed o LEFT JOIN own b ON b.c = o.c - o.c % 20),
prefixes AS (SELECT c, d, w[1:d] AS p, len(w) = d AS ends FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM built)),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),
named AS (SELECT c, prefixes.d, conv_id FROM prefixes JOIN nodes USING (p, d)),
parents AS (SELECT n.conv_id, n.d, u.conv_id AS parent_conv_id FROM nodes n JOIN named u ON u.c = n.conv_id AND u.d = n.d - 1),
children AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n FROM parents GROUP BY ALL),
heaviest AS (SELECT conv_id, d FROM nodes JOIN parents USING (conv_id, d) QUALIFY row_number() OVER (PARTITION BY parent_conv_id, d ORDER BY n_convs DESC, conv_id) = 1),
valued AS (SELECT n.conv_id, d, n_convs, coalesce(n, 0) AS n_children, ends_sha256, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[-1].x, {_WORD})) END AS saved
  FROM nodes n LEFT JOIN children USING (conv_id, d)),
sums AS (SELECT a.conv_id, a.d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM valued v JOIN named a ON a.c = v.conv_id AND a.d <= v.d GROUP BY a.conv_id, a.d)
SELECT v.conv_id, v.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256, h.conv_id IS NOT NULL AS heavy
FROM valued v JOIN sums USING (conv_id, d) LEFT JOIN parents USING (conv_id, d) LEFT JOIN heaviest h ON h.conv_id = v.conv_id AND h.d = v.d"""


OP13 = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
runs AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 5) t(m)),
counts AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM runs GROUP BY ALL HAVING f >= 30),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
longer AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, a, m, s, unnest(range(1, m - s + 2)) AS i FROM candidates, range(2, 4) t(s) WHERE s < m) GROUP BY ALL),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT lang, phrase, a, w, unnest(range(1, m)) AS k FROM candidates)),
scored AS (SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f::HUGEINT + r.f))::BIGINT AS score FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = first
  JOIN counts r ON r.lang = c.lang AND r.phrase = rest QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored LEFT JOIN longer USING (lang, phrase) JOIN totals USING (lang) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": OP1, "op3_substring_dedup": OP3, "op5_spherical_cap_dedup": OP5, "op8_license_scans": _licenses(),
        "op10_secret_ownership": _secrets(), "op12_heavy_path_trie": OP12, "op13_hashed_collocations": OP13,
    }
