"""Ontology operators: label hygiene, the domain filter, term filtering and cluster annotation.

The closure is the clean one: labels of a site's ancestors count for the node itself and never for later nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismet.functions.text import mentions_any
from prismet.operators.graph import ancestors, descendant_counts


def preferred_labels(nodes: DataFrame) -> DataFrame:
    """(pos, rid, label): current, non-blank, longer than one character; of equal spellings (any case) the first."""
    good = nodes.where(~F.coalesce("obsolete", F.lit(False))).withColumn("label", F.trim("label")).where(F.length("label") > 1)
    first = Window.partitionBy(F.lower("label")).orderBy("pos")
    return good.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def branch_filter(records: DataFrame, prefixes: list[str]) -> DataFrame:
    """Records (pos, name, trees) of which any tree number starts with any prefix; first spelling of a name wins."""
    starts = F.exists("trees", lambda t: F.array_contains(F.transform(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(t, p)), True))
    kept = records.where(F.length(F.trim("name")) > 1).where(starts)
    return kept.withColumn("__r", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("pos"))).where("__r = 1").drop("__r")


def domain_filter(nodes: DataFrame, edges: DataFrame, sites: DataFrame, targets: list, findings: list, devices: list, keywords: list[str]) -> DataFrame:
    """rids to keep: not obsolete, no keyword in any label of the ancestors or of the site's ancestors, and below a
    target (itself or through a site), a finding or a device. nodes: rid, label, obsolete; sites: rid, site."""
    every = nodes.select(F.col("rid").alias("node")).union(sites.select(F.col("site").alias("node"))).distinct()
    closure = ancestors(every, edges)
    labels = nodes.select(F.col("rid").alias("ancestor"), F.lower("label").alias("label"))
    own = closure.join(nodes.select(F.col("rid").alias("node")), "node", "left_semi").select(F.col("node").alias("rid"), "ancestor", F.lit(False).alias("by_site"))
    by_site = sites.join(closure, sites["site"] == closure["node"]).select("rid", "ancestor", F.lit(True).alias("by_site"))
    related = own.unionByName(by_site).join(labels, "ancestor", "left")
    words = F.array(*[F.lit(k) for k in keywords]).cast("array<string>")
    excluded = F.bool_or(F.coalesce(mentions_any(F.array("label"), words), F.lit(False)))
    inside = F.bool_or(F.col("ancestor").isin(targets) | (~F.col("by_site") & F.col("ancestor").isin(findings + devices)))
    judged = related.groupBy("rid").agg(excluded.alias("excluded"), inside.alias("inside"))
    return nodes.where(~F.coalesce("obsolete", F.lit(False))).join(judged.where("inside and not excluded").select("rid"), "rid", "left_semi")


def keep_terms(terms: DataFrame, nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Terms that no label resolves, and those of which any rid is kept. terms: pos, term; nodes: rid, label; kept: rid."""
    resolved = terms.join(nodes.select("rid", F.lower("label").alias("__l")), F.lower("term") == F.col("__l"), "left")
    marked = resolved.join(kept.select("rid", F.lit(True).alias("ok")), "rid", "left")
    by_term = marked.groupBy("pos", "term").agg(F.bool_or(F.col("rid").isNull() | F.coalesce("ok", F.lit(False))).alias("keep"))
    return by_term.where("keep").select("pos", "term")


def resolve(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """name to the smallest rid (as text) whose label equals it in any case; null where none does."""
    labels = nodes.groupBy(F.lower("label").alias("__l")).agg(F.min("rid").alias("rid"))
    return names.join(labels, F.lower("name") == F.col("__l"), "left").drop("__l")


def annotate(clusters: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster_id, rid, label, n_resolved, n_members: the most specific node shared by enough members.

    clusters: cluster_id, name. A node needs the support of half of the resolved members (two at least, one where a
    single member resolves), parents of its own, and in an ontology of 1,000 nodes or more no more than 1 % of them
    below it. Order: depth among the candidates, support, shortest label, smallest rid."""
    members = resolve(clusters.select("cluster_id", "name").distinct(), nodes)
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.count("rid").alias("n_resolved"))
    n_nodes = nodes.select("rid").distinct().count()
    closure = ancestors(nodes.select(F.col("rid").alias("node")).union(edges.select("parent")).distinct(), edges)
    up = members.where("rid is not null").join(closure, F.col("rid") == F.col("node")).groupBy("cluster_id", "ancestor").agg(F.count("*").alias("support"))
    least = F.when(F.col("n_resolved") >= 2, F.greatest(F.lit(2), F.ceil(F.col("n_resolved") / 2))).otherwise(1)
    candidates = up.join(sizes, "cluster_id").where(F.col("support") >= least).join(edges.select(F.col("child").alias("ancestor")).distinct(), "ancestor", "left_semi")
    if n_nodes >= 1000:
        small = descendant_counts(closure).where(F.col("n") <= 0.01 * n_nodes).select(F.col("node").alias("ancestor"))
        candidates = candidates.join(small, "ancestor", "left_semi")
    candidates = candidates.select("cluster_id", "ancestor", "support")
    inner = candidates.join(closure.withColumnRenamed("ancestor", "above"), F.col("ancestor") == F.col("node"))
    depth = inner.join(candidates.select("cluster_id", F.col("ancestor").alias("above")), ["cluster_id", "above"]).groupBy("cluster_id", "ancestor").agg(F.count("*").alias("depth"))
    ranked = candidates.join(depth, ["cluster_id", "ancestor"]).join(nodes.groupBy(F.col("rid").alias("ancestor")).agg(F.min("label").alias("label")), "ancestor", "left")
    order = Window.partitionBy("cluster_id").orderBy(F.desc("depth"), F.desc("support"), F.length(F.coalesce("label", "ancestor")), "ancestor")
    best = ranked.withColumn("__r", F.row_number().over(order)).where("__r = 1").select("cluster_id", F.col("ancestor").alias("rid"), "label")
    return sizes.join(best, "cluster_id", "left").select("cluster_id", "rid", "label", "n_resolved", "n_members")


def display_label(label: Column, medoid: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), medoid)
