"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses, url_filter

_LOWER = f"'{licenses.UPPER}', '{licenses.LOWER}'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def near_duplicates(size: int, percent: int) -> str:
    """All pairs of shingle sets, and reachability over the links."""
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(size))
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {size} THEN [{gram} FOR i IN range(1, len(ws) - {size} + 2)]
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n AS x ON u = x.doc_id JOIN n AS y ON v = y.doc_id WHERE 100 * k >= {percent} * (x.c + y.c - k)),
sym AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT sym.v, reach.c FROM reach JOIN sym ON sym.u = reach.doc_id)
SELECT doc_id, coalesce(any_value(n.c), 0) AS n_shingles, min(reach.c) AS component_id, doc_id = min(reach.c) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def license_scan() -> str:
    words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    places, labels = [], []
    for phrase, label in licenses.PHRASES:
        here = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        here = f"[i - 1 FOR i IN range(1, len(w) + 1) IF {here}]"
        places.append(here)
        labels.append(f"CASE WHEN len({here}) > 0 THEN '{label}' END")
    templates = ", ".join(
        f"({i}, {_text(label)}, [{', '.join(_text(t) for t in licenses.token_set(text))}], {licenses.STRETCH * licenses.word_count(text)})" for i, (label, text) in enumerate(licenses.TEMPLATES)
    )
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), {_LOWER}) AS t FROM documents),
base AS (
  SELECT doc_id, w, list_concat(list_concat({places[0]}, {places[1]}), {places[2]}) AS p,
    list_filter([{", ".join(labels)}], lambda x: x IS NOT NULL) AS own
  FROM (SELECT doc_id, {words.format("t")} AS w FROM low)
), template(id, label, tokens, span) AS (VALUES {templates}),
pair AS (
  SELECT doc_id, w, label, tokens, span, ceil({licenses.THRESHOLD!r} * len(tokens) - 1e-9) AS need FROM base, template
  WHERE len(list_intersect(list_distinct(w), tokens)) >= ceil({licenses.THRESHOLD!r} * len(tokens) - 1e-9)
), run AS (
  SELECT doc_id, label, tokens, need, list_max([len(list_intersect(list_distinct(w[i : i + span - 1]), tokens)) FOR i IN range(1, len(w) + 1)]) AS shared
  FROM pair
), hit AS (
  SELECT doc_id, list(DISTINCT label) AS found, max(shared / cast(len(tokens) AS double)) AS best FROM run WHERE shared >= need GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word,
  array_to_string(list_sort(list_distinct(own)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(own, coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1e0 ELSE coalesce(best, 0e0) END AS score
FROM base LEFT JOIN hit USING (doc_id)
"""


def url_verdicts() -> str:
    """Rules and spellings of one address; the given pages hold no canonical link or refresh (tests cover those)."""
    rule = verdict = "NULL"
    for kind, host, path in sorted(url_filter.RULES, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        rule = f"CASE WHEN {fits} THEN '{host}{path}' ELSE {rule} END"
        verdict = f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    return f"""
WITH cut AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), {_LOWER}) AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), own AS (
  SELECT *, {rule} AS rule, {verdict} AS own, CASE WHEN contains(url, '://')
    THEN host || regexp_replace(path, '/+$', '') || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1, 's') END AS address FROM cut
), votes AS (SELECT address, bool_or(own = 'block') AS b, bool_or(own = 'allow') AS a FROM own WHERE address IS NOT NULL GROUP BY 1),
spread AS (SELECT address, true AS s FROM votes WHERE b AND NOT coalesce(a, false))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN s THEN 'block' END, 'allow') AS verdict,
  CASE WHEN own IS NOT NULL THEN 'rule' WHEN s THEN 'alias' ELSE 'default' END AS decided_by
FROM own LEFT JOIN spread USING (address)
"""


def prefix_trie(group: int = 100, borrowed: int = 6) -> str:
    """Prefixes as joined digests of turns; every node is counted for each of its own prefixes."""
    step = "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))"
    crc = (
        "xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(conv_id AS VARCHAR), ''), "
        f"lambda s: cast(ascii(s) AS BIGINT))), lambda a, b: {step}), 4294967295)"
    )
    return f"""
WITH t AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS own FROM t GROUP BY 1),
h AS (SELECT *, {crc} % {borrowed} AS h FROM o),
r AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h.h), []), list_slice(h.own, h.h + 1, len(h.own))) AS s
  FROM h LEFT JOIN o AS b ON b.conv_id = h.conv_id - h.conv_id % {group}
), p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM r),
q AS (
  SELECT *, list_transform(list_slice(s, 1, depth), lambda x: x.k) AS ks, CASE WHEN depth > 0 THEN s[depth].n ELSE 0 END AS n FROM p
), node AS (
  SELECT depth, array_to_string(ks, ',') AS key, any_value(ks) AS ks, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
    sha256(coalesce(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth), '')) AS ends_sha256
  FROM q GROUP BY 1, 2
), up AS (SELECT *, CASE WHEN depth > 0 THEN array_to_string(list_slice(ks, 1, depth - 1), ',') END AS parent FROM node),
child AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1, 2),
wide AS (SELECT up.*, coalesce(child.n_children, 0) AS n_children FROM up LEFT JOIN child USING (depth, key)),
above AS (SELECT unnest(range(0, depth + 1)) AS d, ks, n_children, (n_convs - 1) * n AS saved FROM wide),
tree AS (
  SELECT d AS depth, array_to_string(list_slice(ks, 1, d), ',') AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM above GROUP BY 1, 2
)
SELECT wide.conv_id, wide.depth, p.conv_id AS parent_conv_id, wide.n_convs, wide.n_children, tree.n_leaves,
  cast(tree.saved AS BIGINT) AS saved_tokens, wide.ends_sha256
FROM wide JOIN tree USING (depth, key) LEFT JOIN node AS p ON p.depth = wide.depth - 1 AND p.key = wide.parent
"""


def source_divergence(least_docs: int = 30, top: int = 50) -> str:
    """Every kept term for every group, and all pairs of sources over all kept terms."""
    share = lambda n, size, v: f"1 + cast(1000000000 AS HUGEINT) * ({n} + 5) // ({size} + 5 * {v})"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_LOWER}) AS t
  FROM documents
), w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {least_docs}),
whole AS (SELECT lang, sum(total) AS big, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3),
cell AS (SELECT lang, source, term, total, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
size AS (SELECT lang, source, sum(n) AS size FROM cell GROUP BY 1, 2),
p AS (
  SELECT lang, source, term, n, {share("n", "size", "v")} AS p, {share("total", "big", "v")} AS q
  FROM cell JOIN size USING (lang, source) JOIN whole USING (lang)
), gap AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(gap.value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, cast(value AS BIGINT) AS value, cast(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""


def top_products(k: int) -> str:
    """The inner products of each query with all other vectors."""
    return f"""
WITH u AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, u.vec_id, max(cast(list_inner_product(q.v, u.v) AS BIGINT)) AS score
  FROM u AS q JOIN u ON q.vec_id <> u.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}
"""
