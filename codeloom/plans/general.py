"""Queries of the general data problems (1, 2, 4, 5) over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import hierarchy, orphans, skew, snapshots
from codeloom.util import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_keys(table(spark, sf_dir, "slice_edges"), ["target", "source"]).select("key_field", "node_id")


def p1_key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.key_figures(table(spark, sf_dir, "slice_edges"), table(spark, sf_dir, "slice_nodes"))


def p1_heaviest_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heaviest_callers(table(spark, sf_dir, "slice_nodes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.graph_changes(table(spark, sf_dir, "slice_nodes"), table(spark, sf_dir, "slice_edges"))


def p2_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("table_name", "project_id", "snapshot_no", "change").agg(F.count(F.lit(1)).alias("n_records"))


def p2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and rows that equal digests spare."""
    return snapshots.graph_chunks(table(spark, sf_dir, "slice_nodes"), table(spark, sf_dir, "slice_edges"))


def _orphans(spark: SparkSession, sf_dir: str, counts: bool) -> orphans.OrphanState:
    references = orphans.reference_events(table(spark, sf_dir, "edge_keys"), table(spark, sf_dir, "findings"))
    return orphans.replayed(references, orphans.parent_events(*(table(spark, sf_dir, t) for t in ("slice_nodes", "library_nodes", "files"))), counts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir, counts=False).orphans()


def p4_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir, counts=True).counts()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = hierarchy.tree_links(table(spark, sf_dir, "edge_keys"))
    return hierarchy.hierarchy(links, with_path=False).select("type", "node_id", "root_id", "depth")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy.hierarchy(hierarchy.tree_links(table(spark, sf_dir, "edge_keys")))
    return hierarchy.tree_sizes(tree).withColumn("path", F.array_join("path", "/"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(hierarchy.tree_links(table(spark, sf_dir, "edge_keys"))))


QUERIES = {f.__name__: f for f in (p1_found, p1_key_figures, p1_heaviest_callers, p2_found, p2_change_counts, p2_chunks, p4_found, p4_pending, p5_found, p5_paths, p5_descendants)}

_P2 = """
WITH n AS (SELECT project_id, snapshot_no, label || ':' || fq_name AS record_key, {'a': callee_count, 'b': file_id, 'c': start_line, 'd': end_line} AS v, delivered_at FROM slice_nodes WHERE snapshot_no IS NOT NULL),
e AS (SELECT project_id, snapshot_no, source || '>' || target AS record_key, type AS v, delivered_at FROM slice_edges WHERE snapshot_no IS NOT NULL),
nd AS (SELECT project_id, snapshot_no, record_key, v FROM n WHERE record_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, snapshot_no, record_key ORDER BY delivered_at DESC NULLS LAST, v DESC) = 1),
ed AS (SELECT project_id, snapshot_no, record_key, v FROM e WHERE record_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, snapshot_no, record_key ORDER BY delivered_at DESC NULLS LAST, v DESC) = 1),
ns AS (SELECT project_id, snapshot_no AS cur, lag(snapshot_no) OVER (PARTITION BY project_id ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT project_id, snapshot_no FROM n)),
es AS (SELECT project_id, snapshot_no AS cur, lag(snapshot_no) OVER (PARTITION BY project_id ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT project_id, snapshot_no FROM e)),
na AS (SELECT s.cur, d.project_id, d.record_key, d.v FROM nd d JOIN ns s ON d.project_id = s.project_id AND d.snapshot_no = s.cur WHERE s.prev IS NOT NULL),
nb AS (SELECT s.cur, d.project_id, d.record_key, d.v FROM nd d JOIN ns s ON d.project_id = s.project_id AND d.snapshot_no = s.prev),
ea AS (SELECT s.cur, d.project_id, d.record_key, d.v FROM ed d JOIN es s ON d.project_id = s.project_id AND d.snapshot_no = s.cur WHERE s.prev IS NOT NULL),
eb AS (SELECT s.cur, d.project_id, d.record_key, d.v FROM ed d JOIN es s ON d.project_id = s.project_id AND d.snapshot_no = s.prev),
found AS (
 SELECT 'slice_nodes' AS table_name, CAST(coalesce(a.cur, b.cur) AS INTEGER) AS snapshot_no, coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.record_key, b.record_key) AS record_key,
  CASE WHEN b.cur IS NULL THEN 'added' WHEN a.cur IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM na a FULL JOIN nb b ON a.cur = b.cur AND a.project_id = b.project_id AND a.record_key = b.record_key
 WHERE a.cur IS NULL OR b.cur IS NULL OR a.v IS DISTINCT FROM b.v
 UNION ALL
 SELECT 'slice_edges', CAST(coalesce(a.cur, b.cur) AS INTEGER), coalesce(a.project_id, b.project_id), coalesce(a.record_key, b.record_key),
  CASE WHEN b.cur IS NULL THEN 'added' WHEN a.cur IS NULL THEN 'removed' ELSE 'changed' END
 FROM ea a FULL JOIN eb b ON a.cur = b.cur AND a.project_id = b.project_id AND a.record_key = b.record_key
 WHERE a.cur IS NULL OR b.cur IS NULL OR a.v IS DISTINCT FROM b.v)
"""

_P4 = """
WITH days AS (SELECT project_id, snapshot_no, min(snapshot_at) AS began FROM slice_nodes GROUP BY ALL),
span AS (SELECT project_id, snapshot_no, began, lead(began) OVER (PARTITION BY project_id ORDER BY began) AS until FROM days),
life AS (
 SELECT DISTINCT 'to_id' AS field, n.id AS key, s.began, s.until FROM slice_nodes n JOIN span s USING (project_id, snapshot_no)
 UNION SELECT 'subject', n.project_id || chr(10) || n.fq_name, s.began, s.until FROM slice_nodes n JOIN span s USING (project_id, snapshot_no)
 UNION SELECT 'to_id', id, TIMESTAMP '0001-01-01', NULL FROM library_nodes
 UNION SELECT 'subject', project_id || chr(10) || fq_name, TIMESTAMP '0001-01-01', NULL FROM library_nodes
 UNION SELECT 'file_id', file_id, first_seen_at, removed_at FROM files),
refs AS (
 SELECT DISTINCT 'edge_keys' AS table_name, 'to_id' AS field, to_id AS key, event_no AS row_no, ingested_at AS t FROM edge_keys WHERE to_id IS NOT NULL
 UNION SELECT 'findings', 'subject', project_id || chr(10) || subject, finding_id, found_at FROM findings WHERE subject IS NOT NULL
 UNION SELECT 'findings', 'file_id', file_id, finding_id, found_at FROM findings WHERE file_id IS NOT NULL),
seen AS (
 SELECT r.table_name, r.field, r.row_no, r.t, bool_or(l.began <= r.t AND (l.until IS NULL OR r.t < l.until)) AS alive, bool_or(l.began <= r.t) AS before, count(l.key) AS ever
 FROM refs r LEFT JOIN life l ON r.field = l.field AND r.key = l.key GROUP BY ALL)
"""

_P5 = """
WITH RECURSIVE ends AS (
 SELECT type, CASE type WHEN 'CONTAINS' THEN to_id ELSE from_id END AS node_id, CASE type WHEN 'CONTAINS' THEN from_id ELSE to_id END AS parent_id, ingested_at, event_no
 FROM edge_keys WHERE type IN ('CONTAINS', 'EXTENDS') AND from_id IS NOT NULL AND to_id IS NOT NULL),
links AS (SELECT type, node_id, arg_max(parent_id, (ingested_at, event_no)) AS parent_id FROM ends GROUP BY ALL),
walk AS (
 SELECT l.type, l.node_id, l.parent_id, l.parent_id AS root_id, 1 AS depth, l.parent_id || '/' || l.node_id AS path FROM links l ANTI JOIN links p ON l.type = p.type AND l.parent_id = p.node_id
 UNION ALL
 SELECT l.type, l.node_id, l.parent_id, w.root_id, w.depth + 1, w.path || '/' || l.node_id FROM walk w JOIN links l ON l.type = w.type AND l.parent_id = w.node_id),
tree AS (
 SELECT l.type, l.node_id, l.parent_id, coalesce(w.root_id, '') AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS depth, w.path
 FROM links l LEFT JOIN walk w ON l.type = w.type AND l.node_id = w.node_id),
below AS (
 SELECT type, unnest(string_split(path, '/')[:-2]) AS ancestor_id, node_id, depth, unnest(range(depth)) AS level FROM walk)
"""

ORACLE = {
    "p1_found": " UNION ALL ".join(f"SELECT '{c}' AS key_field, {c} AS node_id FROM slice_edges WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) * 100 >= (SELECT count(*) FROM slice_edges)" for c in ("target", "source")),
    "p1_key_figures": "WITH c AS (SELECT id, sum(callee_count)::BIGINT AS callees FROM slice_nodes WHERE callee_count IS NOT NULL GROUP BY id), k AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS key_field, {c} AS node_id, count(*) AS edges, count(DISTINCT {o}) AS partners FROM slice_edges WHERE {c} IS NOT NULL GROUP BY {c}" for c, o in (("target", "source"), ("source", "target")))
    + ") SELECT coalesce(k.key_field, 'source') AS key_field, coalesce(k.node_id, c.id) AS node_id, coalesce(k.edges, 0) AS edges, coalesce(k.partners, 0) AS partners, c.callees FROM k FULL JOIN (SELECT * FROM c WHERE id IS NOT NULL) c ON c.id = k.node_id",
    "p1_heaviest_callers": "SELECT id AS node_id, sum(callee_count)::BIGINT AS callees, count(*) AS deliveries FROM slice_nodes WHERE callee_count IS NOT NULL AND id IS NOT NULL GROUP BY id HAVING sum(callee_count) * 1000 >= (SELECT sum(callee_count) FROM slice_nodes)",
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_change_counts": _P2 + "SELECT table_name, project_id, snapshot_no, change, count(*) AS n_records FROM found GROUP BY ALL",
    "p4_found": _P4 + "SELECT table_name, field, row_no, CASE WHEN ever = 0 THEN 'missing' WHEN before THEN 'deleted' ELSE 'late' END AS state, strftime(t, '%Y-%m') AS period FROM seen WHERE NOT coalesce(alive, FALSE)",
    "p4_pending": _P4 + """, arrive AS (SELECT DISTINCT field, key, began AS t FROM life l WHERE began IS NOT NULL AND NOT EXISTS (SELECT 1 FROM life p WHERE p.field = l.field AND p.key = l.key AND p.until = l.began)),
gone AS (SELECT DISTINCT field, key, until AS t FROM life l WHERE until IS NOT NULL AND NOT EXISTS (SELECT 1 FROM life p WHERE p.field = l.field AND p.key = l.key AND p.began = l.until)),
moves AS (
 SELECT table_name, field, strftime(t, '%Y-%m') AS period, 1 AS orphaned, 0 AS resolved, 0 AS reopened FROM seen WHERE NOT coalesce(alive, FALSE)
 UNION ALL SELECT r.table_name, r.field, strftime(a.t, '%Y-%m'), 0, 1, 0 FROM refs r JOIN arrive a ON a.field = r.field AND a.key = r.key AND r.t < a.t
 UNION ALL SELECT r.table_name, r.field, strftime(g.t, '%Y-%m'), 0, 0, 1 FROM refs r JOIN gone g ON g.field = r.field AND g.key = r.key AND r.t < g.t),
months AS (SELECT table_name, field, period, sum(orphaned)::BIGINT AS orphaned, sum(resolved)::BIGINT AS resolved, sum(reopened)::BIGINT AS reopened FROM moves GROUP BY ALL)
SELECT *, sum(orphaned - resolved + reopened) OVER (PARTITION BY table_name, field ORDER BY period)::BIGINT AS pending FROM months""",
    "p5_found": _P5 + "SELECT type, node_id, root_id, depth FROM tree",
    "p5_paths": _P5 + "SELECT t.*, coalesce(b.descendants, 0) AS descendants FROM tree t LEFT JOIN (SELECT type, ancestor_id, count(*) AS descendants FROM below GROUP BY ALL) b ON t.type = b.type AND t.node_id = b.ancestor_id",
    "p5_descendants": _P5 + "SELECT type, ancestor_id, node_id, depth - level AS distance FROM below",
}
