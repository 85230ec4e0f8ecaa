"""SQL for the queries of this subpackage that SQL can express."""

OP2 = r"""
WITH RECURSIVE p AS (SELECT page_id::BIGINT AS page_id, url, coalesce(html, '') AS html,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^#]*)', 1) AS tail FROM p),
n AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN lower(split_part(url, '://', 1)) || '://' || host || CASE tail WHEN '' THEN '/' ELSE tail END END AS node FROM h),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) v(rhost, rpath, ruling)),
c AS (SELECT *, split_part(url, '://', 1) AS scheme, regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|$)', '', 'g'), '(?is)<script\b[^>]*>.*?(</script\s*>|$)|<style\b[^>]*>.*?(</style\s*>|$)|<template\b[^>]*>.*?(</template\s*>|$)|<textarea\b[^>]*>.*?(</textarea\s*>|$)|<title\b[^>]*>.*?(</title\s*>|$)|<noembed\b[^>]*>.*?(</noembed\s*>|$)|<xmp\b[^>]*>.*?(</xmp\s*>|$)|<iframe\b[^>]*>.*?(</iframe\s*>|$)', '', 'g') AS bare FROM n WHERE node IS NOT NULL),
tg AS (SELECT node, scheme, host, path, UNNEST(regexp_extract_all(bare, '(?is)<(?:link|meta)[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM c),
ag AS (SELECT * EXCLUDE (tag), list_transform(regexp_extract_all(tag, '(?is)([^\s"''>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?', 1), lambda x: lower(x)) AS names, regexp_extract_all(tag, '(?is)([^\s"''>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?', 2) AS vals FROM tg),
av AS (SELECT node, scheme, host, path, names[1] AS tag, coalesce(regexp_replace(vals[list_position(names, 'rel')], '^["'']|["'']$', '', 'g'), '') AS rel, coalesce(regexp_replace(vals[list_position(names, 'http-equiv')], '^["'']|["'']$', '', 'g'), '') AS equiv,
    coalesce(regexp_replace(vals[list_position(names, 'href')], '^["'']|["'']$', '', 'g'), '') AS href, coalesce(regexp_replace(vals[list_position(names, 'content')], '^["'']|["'']$', '', 'g'), '') AS content FROM ag),
t AS (SELECT node, scheme, host, path, regexp_replace(trim(CASE WHEN tag = '<link' AND list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') THEN href
    WHEN tag = '<meta' AND lower(trim(equiv)) = 'refresh' THEN regexp_extract(content, '(?is)url\s*=\s*["'']?([^"'']*)', 1) ELSE '' END), '(?i)&amp;', '&', 'g') AS target FROM av),
u AS (SELECT node, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN target WHEN starts_with(target, '//') THEN scheme || ':' || target WHEN starts_with(target, '/') THEN scheme || '://' || host || target
    ELSE scheme || '://' || host || CASE regexp_replace(path, '[^/]*$', '') WHEN '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || target END AS full_url FROM t WHERE target <> ''),
e AS (SELECT DISTINCT node AS a, lower(split_part(full_url, '://', 1)) || '://' || translate(regexp_extract(full_rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || CASE regexp_extract(full_rest, '^[^/?#]*([^#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(full_rest, '^[^/?#]*([^#]*)', 1) END AS b
  FROM (SELECT *, substr(full_url, strpos(full_url, '://') + 3) AS full_rest FROM u WHERE strpos(full_url, '://') > 0) WHERE a <> b),
w AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e UNION SELECT w.x, k.y FROM w JOIN (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e) k ON w.y = k.x),
z AS (SELECT y, arg_max(ruling, length(rhost || rpath)) AS ruling FROM (SELECT y, translate(regexp_extract(split_part(y, '://', 2), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(split_part(y, '://', 2), '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT y FROM w)) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY y),
q AS (SELECT w.x AS node, bool_or(ruling = 'allow') AS allowed, bool_or(ruling = 'block') AS blocked FROM w JOIN z USING (y) GROUP BY w.x),
f AS (SELECT page_id, url, host, path, node, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(ruling, length(rhost || rpath)) AS ruling FROM n
  LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN blocked AND NOT allowed THEN 'block' END, 'allow') AS verdict, url FROM f LEFT JOIN q USING (node)"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
c AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM c GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN m USING (vec_id)"""

OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id::BIGINT AS doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
k AS (SELECT 0 AS round, 0::BIGINT AS capped_size, 0::BIGINT AS capped_weight
  UNION ALL SELECT round + 1, (SELECT coalesce(sum(2 * source_size), 0) FROM s WHERE 2.0 * source_size <= weight * (1.5 * tot - capped_size) / (w - capped_weight))::BIGINT,
    (SELECT coalesce(sum(weight), 0) FROM s WHERE 2.0 * source_size <= weight * (1.5 * tot - capped_size) / (w - capped_weight))::BIGINT
  FROM k, (SELECT sum(source_size) AS tot, sum(weight) AS w FROM s) WHERE round < 60 AND capped_weight < w),
z AS (SELECT capped_size, capped_weight FROM k ORDER BY round DESC LIMIT 1),
y AS (SELECT source, source_size, least(2.0 * source_size, weight * (3 * tot - 2 * capped_size)::DOUBLE / ((w - capped_weight) * 2)) AS target,
    ('0x' || substr(md5('17:' || coalesce('=' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s, z, (SELECT sum(source_size) AS tot, sum(weight) AS w FROM s)),
o AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS place FROM d)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (least(floor(place * r + u) - floor((place - 1) * r + u), 2) * size)::BIGINT AS taken
FROM (SELECT doc_id, size, source_size, target, u, place, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM o JOIN y ON o.source IS NOT DISTINCT FROM y.source)"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha, {5 * g + 1}, 5))::BIGINT >> {s}) & 31) + 1)::BIGINT, 1)" for g in range(8) for s in (15, 10, 5, 0)
)
OP10 = f"""
WITH p AS (SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f"""

OP13 = r"""
WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
    UNNEST(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM (SELECT lang, k, UNNEST(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 5) t(k) WHERE len(w) >= k) GROUP BY ALL),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 30),
q AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:k], ' ') AS y FROM c JOIN range(1, 4) t(cut) ON cut < k),
s AS (SELECT q.lang, q.phrase, a, cut, l.f AS l, r.f AS r, 2000000 * a // (l.f + r.f) AS score FROM q JOIN f l ON l.lang = q.lang AND l.phrase = x JOIN f r ON r.lang = q.lang AND r.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM c JOIN range(2, 4) u(m) ON m < k JOIN range(1, 4) v(i) ON i + m - 1 <= k) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM b LEFT JOIN o USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000"""
