"""Ontology queries: customers and suppliers below nations below regions, and parts below brands and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismet.functions import text as X
from prismet.operators import graph, ontology
from prismet.plans import roles
from prismet.plans.catalog import query
from prismet.plans.roles import PRELUDE


@query("rid_extract", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'R' || p_partkey WHEN 1 THEN 'N' || p_partkey ELSE p_brand END AS rid FROM part")
def rid_extract(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    uri = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("http://www.example.org/x:y/R"), k)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("ont:N"), k)).otherwise(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")))
    return roles.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.rid_from_uri(uri).alias("rid"))


@query("preferred_labels", """
SELECT p_partkey AS pos, label FROM (SELECT p_partkey, trim(label) AS label, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY p_partkey) AS k
 FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) || ' ' || p_size ELSE p_brand || ' ' || p_size || ' ' END AS label FROM part WHERE p_partkey % 11 <> 0)) WHERE k = 1
""")
def preferred_labels(spark, sf_dir):
    name = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))
    label = F.when(F.col("p_partkey") % 2 == 0, F.upper(name)).otherwise(F.concat(name, F.lit(" ")))
    nodes = roles.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), label.alias("label"), (F.col("p_partkey") % 11 == 0).alias("obsolete"))
    return ontology.preferred_labels(nodes).select("pos", "label")


@query("ancestor_closure", PRELUDE + "SELECT node, ancestor FROM closure")
def ancestor_closure(spark, sf_dir):
    nodes, edges = roles.tree(spark, sf_dir)
    return graph.ancestors(nodes.select(F.col("rid").alias("node")), edges)


@query("cyclic_closure", """
WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey - p_partkey % 5 + (p_partkey + 1) % 5 AS parent FROM part),
c AS (SELECT child AS node, child AS ancestor FROM e UNION SELECT c.node, e.parent FROM c JOIN e ON e.child = c.ancestor) SELECT node, ancestor FROM c
""")
def cyclic_closure(spark, sf_dir):
    """A graph of rings of five: the closure ends all the same."""
    p = roles.read(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").alias("child"), (F.col("p_partkey") - F.col("p_partkey") % 5 + (F.col("p_partkey") + 1) % 5).alias("parent"))
    return graph.ancestors(e.select(F.col("child").alias("node")), e)


@query("descends_from_roots", PRELUDE + "SELECT DISTINCT node FROM closure WHERE ancestor IN ('R1', 'N3')")
def descends_from_roots(spark, sf_dir):
    nodes, edges = roles.tree(spark, sf_dir)
    closure = graph.ancestors(nodes.select(F.col("rid").alias("node")), edges)
    return graph.descends_from(closure, spark.createDataFrame([("R1",), ("N3",)], "node string"))


@query("descendant_counts", PRELUDE + "SELECT ancestor AS node, count(DISTINCT node) AS n FROM closure GROUP BY ancestor")
def descendant_counts(spark, sf_dir):
    nodes, edges = roles.tree(spark, sf_dir)
    return graph.descendant_counts(graph.ancestors(nodes.select(F.col("rid").alias("node")), edges))


@query("domain_filter", PRELUDE + """
, sites AS (SELECT 'S' || s_suppkey AS rid, 'N' || (s_suppkey % 25) AS site FROM supplier WHERE s_suppkey % 4 = 0),
rel AS (SELECT n.rid, c.ancestor, false AS by_site FROM nodes n JOIN closure c ON c.node = n.rid UNION ALL SELECT s.rid, c.ancestor, true FROM sites s JOIN closure c ON c.node = s.site),
j AS (SELECT r.rid, bool_or(coalesce(contains(lower(a.label), 'asia') OR contains(lower(a.label), 'ania'), false)) AS excluded, bool_or(r.ancestor IN ('R0', 'R2') OR (NOT by_site AND r.ancestor IN ('N7', 'N9'))) AS inside FROM rel r LEFT JOIN nodes a ON a.rid = r.ancestor GROUP BY r.rid)
SELECT n.rid, n.label FROM nodes n JOIN j USING (rid) WHERE inside AND NOT excluded AND NOT (n.rid LIKE 'C%5')
""")
def domain_filter(spark, sf_dir):
    nodes, edges = roles.tree(spark, sf_dir)
    sites = roles.read(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("rid"), F.concat(F.lit("N"), (F.col("s_suppkey") % 25).cast("string")).alias("site"))
    marked = nodes.withColumn("obsolete", F.col("rid").like("C%5"))
    return ontology.domain_filter(marked, edges, sites, ["R0", "R2"], ["N7"], ["N9"], ["asia", "ania"]).select("rid", "label")


@query("keep_terms", PRELUDE + """
, t AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN 'no such ' || c_custkey ELSE upper(c_name) END AS term FROM customer),
kept AS (SELECT rid FROM nodes WHERE rid LIKE '%1' OR rid LIKE '%3')
SELECT pos, term FROM t LEFT JOIN nodes n ON lower(n.label) = lower(term) GROUP BY pos, term HAVING bool_or(n.rid IS NULL OR n.rid IN (SELECT rid FROM kept))
""")
def keep_terms(spark, sf_dir):
    nodes, _ = roles.tree(spark, sf_dir)
    c = roles.read(spark, sf_dir, "customer")
    terms = c.select(F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("no such "), F.col("c_custkey").cast("string"))).otherwise(F.upper("c_name")).alias("term"))
    return ontology.keep_terms(terms, nodes, nodes.where("rid like '%1' or rid like '%3'").select("rid"))


CLUSTERS = """, cl AS (SELECT c_custkey % 40 AS cluster_id, c_name AS name FROM customer UNION SELECT s_suppkey % 40, s_name FROM supplier UNION SELECT c_custkey % 40, 'ghost' || c_custkey FROM customer WHERE c_custkey % 7 = 0),
mem AS (SELECT cluster_id, name, (SELECT min(rid) FROM nodes n WHERE lower(n.label) = lower(cl.name)) AS rid FROM cl),
sz AS (SELECT cluster_id, count(*) AS n_members, count(rid) AS n_resolved FROM mem GROUP BY 1),
sup AS (SELECT m.cluster_id, c.ancestor, count(*) AS support FROM mem m JOIN closure c ON c.node = m.rid GROUP BY 1, 2),
dc AS (SELECT ancestor, count(DISTINCT node) AS n FROM closure GROUP BY 1), tot AS (SELECT count(DISTINCT rid) AS t FROM nodes),
cand AS (SELECT s.* FROM sup s JOIN sz USING (cluster_id) JOIN dc USING (ancestor), tot WHERE support >= CASE WHEN n_resolved >= 2 THEN greatest(2, ceil(n_resolved / 2)) ELSE 1 END AND ancestor IN (SELECT child FROM edges) AND (t < 1000 OR dc.n <= 0.01 * t)),
dep AS (SELECT a.cluster_id, a.ancestor, a.support, count(*) AS depth FROM cand a JOIN closure c ON c.node = a.ancestor JOIN cand b ON b.cluster_id = a.cluster_id AND b.ancestor = c.ancestor GROUP BY 1, 2, 3),
best AS (SELECT cluster_id, ancestor AS rid, (SELECT min(label) FROM nodes n WHERE n.rid = dep.ancestor) AS label, row_number() OVER (PARTITION BY cluster_id ORDER BY depth DESC, support DESC, length((SELECT min(label) FROM nodes n WHERE n.rid = dep.ancestor)), ancestor) AS k FROM dep)
"""


@query("cluster_annotation", PRELUDE + CLUSTERS + "SELECT sz.cluster_id, b.rid, b.label, n_resolved, n_members FROM sz LEFT JOIN best b ON b.cluster_id = sz.cluster_id AND b.k = 1")
def cluster_annotation(spark, sf_dir):
    nodes, edges = roles.tree(spark, sf_dir)
    c, s = roles.read(spark, sf_dir, "customer"), roles.read(spark, sf_dir, "supplier")
    k = F.col("c_custkey") % 40
    clusters = c.select(k.alias("cluster_id"), F.col("c_name").alias("name")).union(s.select(F.col("s_suppkey") % 40, "s_name")).union(c.where("c_custkey % 7 = 0").select(k, F.concat(F.lit("ghost"), F.col("c_custkey").cast("string"))))
    return ontology.annotate(clusters, nodes, edges)


@query("diamond_closure", """
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || p_partkey AS child, 'b' || p_brand AS parent FROM part UNION SELECT 'p' || p_partkey, 't' || p_type FROM part UNION SELECT 'b' || p_brand, 'root' FROM part UNION SELECT 't' || p_type, 'root' FROM part),
c AS (SELECT child AS node, child AS ancestor FROM e UNION SELECT c.node, e.parent FROM c JOIN e ON e.child = c.ancestor) SELECT ancestor, count(*) AS n FROM c GROUP BY ancestor HAVING count(*) > 1
""")
def diamond_closure(spark, sf_dir):
    """Several ways lead to the root; a node counts once."""
    p = roles.read(spark, sf_dir, "part")
    part, brand, kind = F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.concat(F.lit("b"), F.col("p_brand")), F.concat(F.lit("t"), F.col("p_type"))
    e = p.select(part.alias("child"), brand.alias("parent")).union(p.select(part, kind)).union(p.select(brand, F.lit("root"))).union(p.select(kind, F.lit("root"))).distinct()
    closure = graph.ancestors(e.select(F.col("child").alias("node")), e)
    return closure.groupBy("ancestor").agg(F.count("*").alias("n")).where("n > 1")


@query("mesh_branch_filter", """
WITH m AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS name, CASE WHEN p_partkey % 5 = 0 THEN []::VARCHAR[] ELSE [chr(65 + (p_partkey % 7)::INT) || '01', chr(65 + (p_size % 7)::INT) || '02.3'] END AS trees FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY pos) AS r FROM m WHERE len(list_filter(trees, lambda t: substr(t, 1, 1) IN ('A', 'C', 'E'))) > 0)
SELECT pos, name FROM k WHERE r = 1
""")
def mesh_branch_filter(spark, sf_dir):
    k = F.col("p_partkey")
    letter = lambda c: F.char((F.lit(65) + c % 7).cast("long"))
    trees = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(letter(k), F.lit("01")), F.concat(letter(F.col("p_size")), F.lit("02.3"))))
    records = roles.read(spark, sf_dir, "part").select(k.alias("pos"), F.when(k % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("name"), trees.alias("trees"))
    return ontology.branch_filter(records, ["A", "C", "E"]).select("pos", "name")
