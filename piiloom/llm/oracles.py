"""The same results as SQL, where SQL can express an operator."""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP5 = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
           ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))
         END AS shingles
  FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles, list_sort(shingles) AS shingles FROM s),
c AS (SELECT shingles, n_shingles, min(doc_id) AS id FROM n WHERE n_shingles > 0 GROUP BY ALL),
e AS (SELECT id, n_shingles, unnest(shingles) AS shingle FROM c),
p AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.id < b.id
   AND 100 * least(a.n_shingles, b.n_shingles) >= 80 * greatest(a.n_shingles, b.n_shingles)
  GROUP BY a.id, b.id, a.n_shingles, b.n_shingles
  HAVING 100 * count(*) >= 80 * (a.n_shingles + b.n_shingles - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id, id AS reach FROM c UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a),
m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT n.doc_id, n.n_shingles, coalesce(m.component_id, n.doc_id) AS component_id,
       n.doc_id = coalesce(m.component_id, n.doc_id) AS kept
FROM n LEFT JOIN c ON n.n_shingles > 0 AND n.shingles = c.shingles LEFT JOIN m ON m.id = c.id
"""

OP12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS MATERIALIZED (
  SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
f AS MATERIALIZED (
  SELECT lang, 1 AS size, x AS phrase, count(*) AS f FROM g GROUP BY lang, x
  UNION ALL
  SELECT lang, 2, x || ' ' || y, count(*) FROM g WHERE y IS NOT NULL GROUP BY lang, x, y
  UNION ALL
  SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM g WHERE z IS NOT NULL GROUP BY lang, x, y, z),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL
  SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE size = 3),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r,
         ((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.x JOIN f r ON r.lang = k.lang AND r.phrase = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE size = 3) GROUP BY ALL),
o AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score,
         row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE coalesce(100 * i.longer < 50 * b.a, true))
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n, o.score FROM o JOIN n ON n.lang = o.lang WHERE o.rank <= 2000
"""

OP13 = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS mark
  FROM documents),
q AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
s AS MATERIALIZED (
  SELECT source, s, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, sum(s) OVER () AS t FROM q),
-- sources by the level at which each is clamped; the level if all before it are clamped
o AS (
  SELECT *, coalesce(sum(3 * s) OVER before, 0) AS taken, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_over
  FROM s WINDOW before AS (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT (t - taken)::BIGINT AS num, left_over::BIGINT AS den FROM o WHERE 3 * s * left_over >= (t - taken) * w
  ORDER BY 3 * s / w, source NULLS LAST LIMIT 1),
p AS (
  SELECT source, s, least((w * num)::DOUBLE / den::DOUBLE, (3 * s)::DOUBLE) AS target,
         CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole, target - whole * s AS rest
  FROM s, l),
r AS (
  SELECT d.doc_id, d.source, d.size, p.s, p.target, p.whole, p.rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(d.mark, 1, 15), d.doc_id, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, s AS source_size, target, source, whole,
       (size * (whole + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP2 = """WITH RECURSIVE cut AS (
  SELECT page_id, split_part(split_part(CASE WHEN contains(url, '://')
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '?', 1), '#', 1) AS rest FROM pages),
whole AS (SELECT page_id, split_part(rest, '/', 1) AS h, coalesce(rest, '') AS rest FROM cut),
named AS (SELECT page_id, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(rest, length(coalesce(h, '')) + 1) AS path FROM whole),
rules(verdict, own, prefix) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fitting AS (SELECT page_id, arg_max(struct_pack(verdict := r.verdict, rule := own || prefix), length(own || prefix)) AS found
  FROM named, rules r WHERE (host = own OR ends_with(host, '.' || own)) AND starts_with(path, prefix) GROUP BY page_id),
placed AS (SELECT n.*, f.found, list_transform(
    CASE WHEN regexp_replace(path, '^/|/$', '', 'g') = '' THEN []::VARCHAR[]
      ELSE string_split(regexp_replace(path, '^/|/$', '', 'g'), '/') END,
    lambda x: CASE WHEN regexp_matches(regexp_replace(x, '\\.[A-Za-z]{1,5}$', ''), '[0-9]')
        OR length(regexp_replace(x, '\\.[A-Za-z]{1,5}$', '')) > 32
      THEN '*' || substr(x, length(regexp_replace(x, '\\.[A-Za-z]{1,5}$', '')) + 1) ELSE x END) AS raw
  FROM named n LEFT JOIN fitting f USING (page_id)),
paths AS (SELECT host, raw, count(found)::DOUBLE AS n,
  (count(*) FILTER (found.verdict = 'block'))::DOUBLE AS b FROM placed GROUP BY host, raw),
walk(d, host, raw, names, n, b) AS (
  SELECT 0, host, raw, []::VARCHAR[], n, b FROM paths
  UNION ALL
  SELECT d + 1, host, raw, names || [CASE WHEN count(DISTINCT raw[d + 1]) OVER (PARTITION BY host, names) > 20
    THEN '**' ELSE raw[d + 1] END], n, b FROM walk WHERE d < length(raw)),
nodes AS (SELECT host, d, names AS k, names[:d - 1] AS up, sum(b) AS b, sum(n) AS n FROM walk GROUP BY ALL HAVING sum(n) > 0),
branches AS (SELECT c.*, abs(c.b / c.n - p.b / p.n) > 2.0 * sqrt(p.b / p.n * (1 - p.b / p.n) / c.n) AS far
  FROM nodes c JOIN nodes p ON c.host = p.host AND c.d = p.d + 1 AND c.up = p.k),
merged AS (SELECT host, d, up, coalesce(sum(b) FILTER (NOT far), 0) AS mb, coalesce(sum(n) FILTER (NOT far), 0) AS mn
  FROM branches GROUP BY ALL HAVING bool_or(far)),
alone AS (SELECT host, d, k, b, n FROM branches WHERE far UNION ALL SELECT host, d, k, b, n FROM nodes WHERE d = 0),
chains AS (SELECT w.host, w.raw, arg_max(w.names, w.d) AS names, max(a.n) FILTER (w.d = 0) AS labelled,
    list(struct_pack(b := coalesce(a.b, m.mb, 0), n := coalesce(a.n, m.mn, 0)) ORDER BY w.d) AS chain
  FROM walk w LEFT JOIN alone a ON w.host = a.host AND w.d = a.d AND w.names = a.k
  LEFT JOIN merged m ON w.host = m.host AND w.d = m.d AND w.d > 0 AND w.names[:w.d - 1] = m.up
  GROUP BY w.host, w.raw),
judged AS (SELECT host, raw, names, labelled, list_reduce(
    list_prepend((SELECT coalesce(sum(b) / sum(n), 0) FROM paths),
      list_transform(chain, lambda x: x.b)), lambda acc, x, i: (x + 8.0 * acc) / (chain[i - 1].n + 8.0)) AS share FROM chains)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict,
  CASE WHEN labelled > 0 AND share >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || array_to_string(names, '/') AS template
FROM placed JOIN judged USING (host, raw)"""

ORACLES = {"op2_url_filters": OP2, "op4_exact_topk": OP4, "op8_minhash_near_dedup": OP8, "op5_exact_dedup": OP5,
           "op12_collocations": OP12, "op13_source_mixing": OP13}
