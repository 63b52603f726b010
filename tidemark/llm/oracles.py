"""DuckDB equivalents of the queries that SQL can express, written from their definitions and not from their plans."""

#: Smallest member of each component of link(a, b), as component(id, c).
_COMPONENTS = """
    ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(id, c) AS (
        SELECT a, a FROM ways
        UNION
        SELECT r.id, e.b FROM reach r JOIN ways e ON e.a = r.c
    ),
    component AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE
    word AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ),
    shingle AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE [w[i : i + 2] FOR i IN range(1, len(w) - 1)] END) AS s
        FROM word
    ),
    size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
    text_class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY members) AS rep FROM (SELECT doc_id, list(s ORDER BY s) AS members FROM shingle GROUP BY doc_id)),
    own AS (SELECT s.doc_id, s.s FROM shingle s JOIN text_class t ON t.doc_id = s.doc_id AND t.rep = t.doc_id),
    meet AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM own x JOIN own y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
    link AS (
        SELECT a, b FROM meet JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
        UNION ALL
        SELECT rep, doc_id FROM text_class WHERE rep <> doc_id
    ),
    {_COMPONENTS}
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN size z ON z.doc_id = d.doc_id LEFT JOIN component c ON c.id = d.doc_id
"""

_FINE = """
    fine AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
    )
"""

ANN = f"""
WITH {_FINE},
    near AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
        FROM fine q JOIN fine c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE {_FINE},
    link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
    {_COMPONENTS}
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, e.vec_id) AS component_id, coalesce(c.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM ways GROUP BY a) n ON n.a = e.vec_id LEFT JOIN component c ON c.id = e.vec_id
"""

_HOST = "translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"


def url_filter(rules: list[tuple[str, str]]) -> str:
    """The walks run for 110 rounds, after which nothing is left to move at a tolerance of 1e-6."""
    listed = ", ".join(f"('{r}', '{r.split('/')[0]}', '{r[r.index('/'):]}', '{v}')" for r, v in rules)
    return f"""
WITH RECURSIVE
    rules(rule, of, rest, verdict) AS (VALUES {listed}),
    page AS (SELECT page_id, coalesce({_HOST.format(_REST)}, '') AS host, coalesce(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
    judged AS (
        SELECT p.page_id, p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
        FROM page p LEFT JOIN rules r ON (p.host = r.of OR ends_with(p.host, '.' || r.of)) AND starts_with(p.path, r.rest)
        GROUP BY ALL
    ),
    target AS (
        SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]*)', 1))) AS t FROM page WHERE host <> ''
    ),
    edge AS (
        SELECT src, dst, count(*) AS n FROM (SELECT src, {_HOST.format("substr(t, strpos(t, '//') + 2)")} AS dst FROM target) WHERE dst <> '' AND dst <> src GROUP BY ALL
    ),
    step AS (
        SELECT 0 AS walk, src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM edge
        UNION ALL
        SELECT 1, dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edge
    ),
    seed AS (
        SELECT walk, host, count(*) / (SELECT greatest(1, count(*)) FROM judged WHERE rule IS NOT NULL) AS mass
        FROM (SELECT CASE verdict WHEN 'allow' THEN 0 ELSE 1 END AS walk, host FROM judged WHERE rule IS NOT NULL) GROUP BY ALL
    ),
    round(i, walk, host, mass) AS (
        SELECT 0, walk, host, mass::DOUBLE FROM seed
        UNION ALL
        SELECT i, walk, host, sum(mass) FROM (
            SELECT r.i + 1 AS i, s.walk, s.dst AS host, 0.85 * r.mass * s.weight AS mass FROM round r JOIN step s ON s.walk = r.walk AND s.src = r.host
            UNION ALL
            SELECT x.i + 1, s.walk, s.host, 0.15 * s.mass FROM (SELECT DISTINCT i FROM round) x, seed s
        ) WHERE i <= (SELECT CASE WHEN count(*) = 0 THEN 0 ELSE 110 END FROM step) GROUP BY ALL
    ),
    total AS (SELECT host, sum(mass) FILTER (walk = 0) AS trust, sum(mass) FILTER (walk = 1) AS distrust FROM round WHERE i = (SELECT max(i) FROM round) GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule,
    coalesce(j.verdict, CASE WHEN coalesce(t.distrust, 0) > coalesce(t.trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(t.trust, 0) AS trust, coalesce(t.distrust, 0) AS distrust
FROM judged j LEFT JOIN total t ON t.host = j.host
"""


_AT = f"""CASE WHEN contains(url, '://') THEN
    regexp_replace({_HOST.format(_REST)}, ':(80|443)?$', '')
    || CASE WHEN starts_with(regexp_extract({_REST}, '^[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END
    || regexp_extract({_REST}, '^[^/?#]*([^#]*)', 1) END"""

WARC = f"""
WITH
    page AS (SELECT page_id, url, html, {_AT} AS place FROM pages),
    response AS (SELECT 2 * page_id AS id, page_id AS time, place, html FROM page),
    met AS (
        SELECT p.page_id, max(struct_pack(t := r.time, id := r.id)).id AS source_id
        FROM page p JOIN response r ON r.place = p.place AND r.time <= p.page_id + 1000 GROUP BY p.page_id
    ),
    ways AS (
        SELECT 2 * page_id AS record_id, 'response' AS type, url, page_id AS time, 2 * page_id AS source_id, 'own' AS checked, html AS payload,
            strlen(html) AS size, page_id AS date, 'text/html' AS kind, '"' || md5(place) || '"' AS tag
        FROM page
        UNION ALL
        SELECT 2 * p.page_id + 1, 'revisit', p.url, p.page_id + 1000, m.source_id, CASE WHEN m.source_id IS NULL THEN 'none' ELSE 'etag' END, r.html,
            CASE WHEN m.source_id IS NULL THEN 0 ELSE strlen(r.html) END, p.page_id + 1000, CASE WHEN m.source_id IS NOT NULL THEN 'text/html' END, 'W/"' || md5(p.place) || '"'
        FROM page p LEFT JOIN met m ON m.page_id = p.page_id LEFT JOIN response r ON r.id = m.source_id
    )
SELECT record_id, type, url, time, source_id, checked, sha256(payload) AS payload_sha256,
    sha256('content-length: ' || coalesce(size::VARCHAR, '') || coalesce(chr(10) || 'content-type: ' || kind, '') || chr(10) || 'date: ' || date || chr(10) || 'etag: ' || coalesce(tag, '')) AS headers_sha256
FROM ways
"""
