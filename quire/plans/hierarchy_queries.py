"""Queries of problem 1, over the whole table chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.hierarchy import cycles, descendants, hierarchy
from quire.session import table


def p1_found(spark, sf):
    return cycles(table(spark, sf, "chapters")).select("id", "cycle_id")


def p1_paths(spark, sf):
    """Chapters that reach a root; p1_found names the others."""
    tree = hierarchy(table(spark, sf, "chapters")).where(F.col("path").isNotNull())
    return tree.select("id", "root", "depth", F.array_join("path", "/").alias("path"), "n_descendants")


def p1_descendants(spark, sf):
    return descendants(hierarchy(table(spark, sf, "chapters")))


QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants}

_LINKS = """WITH RECURSIVE one AS (SELECT id, min(CASE WHEN length(parent_id) > 0 THEN parent_id END) AS par FROM chapters WHERE id IS NOT NULL GROUP BY id),
links AS (SELECT a.id, b.id AS par FROM one a LEFT JOIN one b ON a.par = b.id),
down AS (SELECT id, id AS root, 0 AS depth, [id] AS path FROM links WHERE par IS NULL
  UNION ALL SELECT l.id, d.root, d.depth + 1, list_append(d.path, l.id) FROM links l JOIN down d ON l.par = d.id),
lost AS (SELECT id, par FROM links WHERE id NOT IN (SELECT id FROM down)),
walk AS (SELECT id, par AS pos FROM lost UNION SELECT w.id, l.par FROM walk w JOIN lost l ON w.pos = l.id),
ring AS (SELECT id FROM walk WHERE id = pos),
cyc AS (SELECT w.id, min(w.pos) AS cycle_id FROM walk w JOIN ring r ON w.pos = r.id GROUP BY w.id)
"""
SQL = {
    "p1_found": _LINKS + "SELECT id, cycle_id FROM cyc",
    "p1_paths": _LINKS
    + """, below AS (SELECT a AS id, CAST(count(*) - 1 AS BIGINT) AS n_descendants FROM (SELECT unnest(path) AS a FROM down) GROUP BY a)
SELECT d.id, d.root, CAST(d.depth AS INTEGER) AS depth, array_to_string(d.path, '/') AS path, b.n_descendants FROM down d JOIN below b USING (id)""",
    "p1_descendants": _LINKS
    + "SELECT id, descendant_id, CAST(depth - pos AS INTEGER) AS distance FROM (SELECT id AS descendant_id, depth, unnest(path) AS id, unnest(range(len(path))) AS pos FROM down) WHERE id <> descendant_id",
}
