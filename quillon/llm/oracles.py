"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

OP7 = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
    ), r AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP10 = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ), g AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w
    ), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, list_sort(s) AS s FROM g),
    c AS (SELECT min(doc_id) AS id, n, s FROM n WHERE n > 0 GROUP BY n, s),
    e AS (SELECT id, n, unnest(s) AS x FROM c),
    l AS (
        SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
        GROUP BY a.id, b.id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)
    ), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach(id, comp) AS (SELECT id, id FROM c UNION SELECT y.b, reach.comp FROM reach JOIN both_ways y ON y.a = reach.id),
    comp AS (SELECT id, min(comp) AS component_id FROM reach GROUP BY id)
    SELECT n.doc_id, n.n AS n_shingles, coalesce(comp.component_id, n.doc_id) AS component_id
    FROM n LEFT JOIN c ON n.n = c.n AND n.s = c.s LEFT JOIN comp ON comp.id = c.id
"""

OP9 = r"""
    WITH p AS (
        SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
    ), rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    q AS (
        SELECT p.*, (SELECT arg_max({'rule': h || r.p, 'verdict': r.verdict}, length(h || r.p)) FROM rules r WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, r.p)) AS fit,
            list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
                CASE WHEN regexp_matches(s, '^[0-9a-fA-F-]{8,}$') AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-fA-F-]') THEN '{h}' ELSE regexp_replace(s, '[0-9]+', '{n}', 'g') END) AS segs
        FROM p
    ), t AS (SELECT host, segs, count(*) AS n, count(*) FILTER (WHERE fit.verdict = 'allow') AS allowed, count(fit.verdict) AS labelled FROM q GROUP BY host, segs),
    lv AS (SELECT t.host, t.segs, t.n, i AS level, segs[i] AS seg, segs[1:i - 1] AS parent FROM t, generate_series(1, 64) AS s(i) WHERE i <= len(segs)),
    varied AS (SELECT host, parent FROM (SELECT host, parent, count(DISTINCT seg) AS kinds, sum(n) AS n FROM lv GROUP BY host, parent) WHERE kinds >= 20 AND n <= 3.0 * kinds),
    own AS (SELECT lv.host, segs, list(CASE WHEN v.host IS NOT NULL THEN '*' ELSE seg END ORDER BY level) AS template FROM lv LEFT JOIN varied v ON lv.host = v.host AND lv.parent = v.parent GROUP BY lv.host, segs),
    r AS (SELECT t.*, coalesce(own.template, []) AS template FROM t LEFT JOIN own ON t.host = own.host AND t.segs = own.segs),
    root AS (SELECT (sum(allowed) + 1) / (sum(labelled) + 2) AS root FROM t),
    nodes AS (SELECT host, i AS level, template[1:i] AS node, sum(allowed) AS allowed, sum(labelled) AS labelled FROM r, generate_series(0, 64) AS s(i) WHERE i <= len(template) GROUP BY ALL),
    sums AS (SELECT host, level, node[1:level - 1] AS up, sum(allowed) AS a, sum(labelled) AS l FROM nodes WHERE level > 0 GROUP BY ALL),
    judged AS (
        SELECT nodes.*, sums.up, nodes.labelled > 0 AND abs(nodes.allowed / greatest(nodes.labelled, 1) - a / greatest(l, 1)) <= 2.0 * sqrt(a / greatest(l, 1) * (1 - a / greatest(l, 1)) / greatest(nodes.labelled, 1)) + 1e-9 AS near
        FROM nodes JOIN sums ON nodes.host = sums.host AND nodes.level = sums.level AND nodes.node[1:nodes.level - 1] = sums.up
    ), known AS (
        SELECT host, level, node, CASE WHEN near THEN sum(allowed) FILTER (WHERE near) OVER k ELSE allowed END AS allowed, CASE WHEN near THEN sum(labelled) FILTER (WHERE near) OVER k ELSE labelled END AS labelled
        FROM judged WINDOW k AS (PARTITION BY host, level, up) UNION ALL SELECT host, level, node, allowed, labelled FROM nodes WHERE level = 0
    ), chain AS (
        SELECT r.host, r.segs, list({'a': CAST(k.allowed AS DOUBLE), 'l': CAST(k.labelled AS DOUBLE)} ORDER BY k.level) AS chain
        FROM r JOIN known k ON k.host = r.host AND k.level <= len(r.template) AND k.node = r.template[1:k.level] GROUP BY ALL
    ), judged_templates AS (SELECT host, segs, list_reduce(list_prepend({'a': root, 'l': 0.0}, chain), lambda acc, x: {'a': (x.a + 10.0 * acc.a) / (x.l + 10.0), 'l': 0.0}).a AS purity FROM chain, root)
    SELECT q.page_id, q.host, q.path, q.fit.rule AS rule, coalesce(q.fit.verdict, CASE WHEN purity < 0.35 THEN 'block' ELSE 'allow' END) AS verdict
    FROM q LEFT JOIN judged_templates j ON q.host = j.host AND q.segs = j.segs
"""

ORACLE_SQL = {"op7_exact_top_k": OP7, "op9_url_filter": OP9, "op10_ngram_jaccard_join": OP10}
