"""SQL that gives the same results as the queries of this subpackage, where SQL can express them."""

_SESSION = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(trim(source_file), '^.*[/\\]', ''))), '\.[a-z][a-z0-9]*$', ''), '^[0-9]+(\.[0-9]+)?_percent_', ''), '_fs[0-9]+(\.[0-9]+)?$', '')"

_RUNS = """
WITH RECURSIVE s AS (
  SELECT seed_id, any_value(symbols) v, any_value(scale) scale, any_value(CASE WHEN alphabet_size > 5 THEN 1 ELSE 0 END) t FROM seeds WHERE len(symbols) > 0 GROUP BY seed_id),
walk AS (
  SELECT seed_id, v, scale, t, 1 i, 0 run, CASE WHEN v[1] = -1 THEN NULL ELSE v[1] END anchor FROM s
  UNION ALL
  SELECT seed_id, v, scale, t, i + 1, CASE WHEN v[i + 1] = -1 OR anchor IS NULL OR abs(v[i + 1] - anchor) <= t THEN run ELSE run + 1 END,
    CASE WHEN v[i + 1] = -1 THEN anchor WHEN anchor IS NULL OR abs(v[i + 1] - anchor) > t THEN v[i + 1] ELSE anchor END
  FROM walk WHERE i < len(v)),
r AS (SELECT seed_id, coalesce(max_by(anchor, i), -1)::INTEGER symbol, min(i) - 1 first_pos, max(i) - 1 last_pos, count(*) n, any_value(scale) scale FROM walk GROUP BY seed_id, run)
"""

_GRAMS = "WITH g AS (SELECT doc_id, n, i, md5(substr(text, i, 200)) h FROM (SELECT doc_id, text, len(text) n, unnest(range(1, len(text) - 198)) i FROM documents WHERE len(text) >= 200)) "

SQL = {
    "p2_found": f"""
WITH RECURSIVE r AS (SELECT id, {_SESSION.replace("source_file", "any_value(source_file)")} node FROM recordings GROUP BY id),
n AS (SELECT id, coalesce('s:' || node, 'r:' || id) node FROM r),
a AS (SELECT id, any_value(recording_id) rec, any_value(parent_annotation_id) par FROM annotations GROUP BY id HAVING any_value(deleted_at) IS NULL),
e AS (SELECT DISTINCT x.node a, y.node b FROM a c JOIN a p ON c.par = p.id JOIN n x ON x.id = c.rec JOIN n y ON y.id = p.rec WHERE x.node != y.node),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a node, a root FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.root),
comp AS (SELECT node, min(root) root FROM reach GROUP BY node),
m AS (SELECT id, coalesce(root, node) c FROM n LEFT JOIN comp USING (node))
SELECT min(id) OVER (PARTITION BY c) group_id, id recording_id FROM m QUALIFY group_id != recording_id
""",
    "p4_found": """
WITH RECURSIVE w AS (SELECT window_id id, any_value(features) f FROM cluster_windows GROUP BY window_id),
ok AS (SELECT id, f::DOUBLE[16] f FROM w WHERE len(f) = 16 AND len(list_filter(f, lambda v: NOT isfinite(v))) = 0),
e AS (SELECT a.id a, b.id b FROM ok a JOIN ok b ON b.f[1] BETWEEN a.f[1] - 0.25 AND a.f[1] + 0.25 AND a.id != b.id WHERE array_distance(a.f, b.f) <= 0.25),
reach AS (SELECT a node, a root FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.root)
SELECT min(root) first_window_id, node window_id FROM reach GROUP BY node HAVING min(root) != node
""",
    "p4_clusters": """
WITH RECURSIVE w AS (SELECT window_id id, any_value(features) f FROM cluster_windows GROUP BY window_id),
ok AS (SELECT id, f::DOUBLE[16] f FROM w WHERE len(f) = 16 AND len(list_filter(f, lambda v: NOT isfinite(v))) = 0),
e AS (SELECT a.id a, b.id b FROM ok a JOIN ok b ON b.f[1] BETWEEN a.f[1] - 0.25 AND a.f[1] + 0.25 AND a.id != b.id WHERE array_distance(a.f, b.f) <= 0.25),
reach AS (SELECT a node, a root FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.root),
comp AS (SELECT node id, min(root) c FROM reach GROUP BY node),
lab AS (SELECT ok.id, coalesce(c, ok.id) c, f FROM ok LEFT JOIN comp USING (id)),
el AS (SELECT id, c, unnest(range(16)) i, unnest(f::DOUBLE[]) v FROM lab),
g AS (SELECT id, c, round(sum((v - m) * (v - m)), 9) gap FROM el JOIN (SELECT c, i, avg(v) m FROM el GROUP BY ALL) USING (c, i) GROUP BY ALL)
SELECT c first_window_id, count(*) AS "size", (list(id ORDER BY gap, id))[1] medoid, (list(id ORDER BY gap, id))[1:3] typical FROM g GROUP BY c
""",
    "p9_found": _GRAMS + "SELECT DISTINCT a.doc_id doc_a, b.doc_id doc_b FROM (SELECT DISTINCT doc_id, h FROM g) a JOIN (SELECT DISTINCT doc_id, h FROM g) b USING (h) WHERE a.doc_id < b.doc_id",
    "p9_shares": _GRAMS + """, s AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
p AS (SELECT DISTINCT doc_id, n, i FROM g SEMI JOIN s USING (h)),
c AS (SELECT doc_id, n, least(200, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 200)) fresh FROM p)
SELECT doc_id, n n_chars, sum(fresh)::BIGINT shared_chars, sum(fresh) / n AS "share" FROM c GROUP BY doc_id, n
""",
    "p5_found": _RUNS + "SELECT seed_id, first_pos::BIGINT first_pos, last_pos::BIGINT last_pos FROM r WHERE n >= 2",
    "p5_runs": _RUNS + "SELECT seed_id, symbol, first_pos::BIGINT first_pos, last_pos::BIGINT last_pos, n, (n * scale)::BIGINT duration FROM r",
}
