"""Relational glue: reports, identifiers, splits, explanations, prompts and snapshots over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from prismet.functions import text as X
from prismet.operators import explain, sampling, vocab
from prismet.plans import roles
from prismet.plans.catalog import query
from prismet.plans.roles import PRELUDE
from prismet.sources import reports, snapshot

R6 = lambda c: F.round(c, 6)
HEAD = "lower(substr(text, 1, 40))"


def _read(spark, sf_dir, name):
    return roles.read(spark, sf_dir, name)


@query("report_two_hop", """
WITH p AS (SELECT 'img_' || o_orderkey % 700 || '.png' AS filename, o_custkey AS uid, o_orderkey AS pos FROM orders),
r AS (SELECT c_custkey AS uid, trim(c_mktsegment) AS findings, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END AS impression FROM customer),
l AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY pos DESC) AS k FROM p JOIN r USING (uid))
SELECT filename AS image_id, findings || CASE WHEN trim(impression) = '' THEN '' ELSE ' ' || trim(impression) END AS report FROM l WHERE k = 1
""")
def report_two_hop(spark, sf_dir):
    """Image to report over the uid; the last row of a file name wins."""
    p = _read(spark, sf_dir, "orders").select(F.concat(F.lit("img_"), (F.col("o_orderkey") % 700).cast("string"), F.lit(".png")).alias("filename"), F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("pos"))
    r = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("findings"), F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name")).alias("impression"))
    return reports.two_hop_lookup(p, r)


@query("report_text", "SELECT o_orderkey AS id, CASE WHEN f = '' AND i = '' THEN 'No report available.' ELSE concat_ws(' ', CASE WHEN f <> '' THEN 'Findings: ' || f END, CASE WHEN i <> '' THEN 'Impression: ' || i END) END AS report FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE trim(o_orderpriority) END AS f, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE trim(o_orderstatus) END AS i FROM orders)")
def report_text(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    f, i = F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 2 == 0, None).otherwise(F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("id"), X.report_text(f, i).alias("report"))


@query("missing_report_skip", """
WITH x AS (SELECT vec_id FROM embeddings), r AS (SELECT l.doc_id, d.source FROM labels l JOIN documents d USING (doc_id) WHERE d.lang = 'en')
SELECT count(*) FILTER (WHERE r.doc_id IS NOT NULL) AS n_paired, count(*) FILTER (WHERE r.doc_id IS NULL) AS n_skipped FROM x LEFT JOIN (SELECT DISTINCT doc_id FROM r) r ON r.doc_id = x.vec_id
""")
def missing_report_skip(spark, sf_dir):
    from prismet.operators import judge

    x = roles.vectors(spark, sf_dir).select("image_id")
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.when(F.col("lang") == "en", F.col("source")).otherwise(" ").alias("report"))
    r = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id")).distinct().join(docs, "image_id")
    paired, missing = judge.with_reports(x, r), judge.skipped(x, r)
    return paired.agg(F.count("*").alias("n_paired")).crossJoin(missing.agg(F.count("*").alias("n_skipped")))


@query("stem_join_captions", """
WITH cap AS (SELECT p_partkey AS pos, p_brand || '_' || p_size || '.jpg' AS name, p_name AS caption FROM part WHERE p_size % 5 <> 0),
disk AS (SELECT p_brand || '_' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.jpg' ELSE '.png' END AS file, p_partkey AS pos FROM part WHERE p_partkey % 3 <> 0),
d AS (SELECT regexp_replace(file, '\\.[^.]*$', '') AS stem, arg_min(file, (file, pos)) AS file FROM disk GROUP BY 1),
c AS (SELECT regexp_replace(name, '\\.[^.]*$', '') AS stem, arg_max(caption, pos) AS caption FROM cap GROUP BY 1)
SELECT file AS image_id, caption AS report FROM c JOIN d USING (stem)
""")
def stem_join_captions(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    name = F.concat_ws("_", "p_brand", F.col("p_size").cast("string"))
    captions = part.where("p_size % 5 <> 0").select(F.col("p_partkey").alias("pos"), F.concat(name, F.lit(".jpg")).alias("name"), F.col("p_name").alias("caption"))
    disk = part.where("p_partkey % 3 <> 0").select(F.concat(name, F.when(F.col("p_partkey") % 2 == 0, ".jpg").otherwise(".png")).alias("file"))
    return reports.captions_by_stem(captions, disk)


@query("image_names", "SELECT page_id, url, lower(url) LIKE '%.png' OR lower(url) LIKE '%.jpg' OR lower(url) LIKE '%.jpeg' AS is_image, regexp_extract(url, '[^/]*$') AS base FROM pages")
def image_names(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", "url", X.is_image_name(F.col("url")).alias("is_image"), X.basename(F.col("url")).alias("base"))


@query("uid_regex_fallback", """
WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey || '_IM-' || o_orderkey || '-1001.png' ELSE 'scan-' || o_orderkey || '.png' END AS name FROM orders),
p AS (SELECT 'scan-' || o_orderkey || '.png' AS name, o_custkey + 100000 AS uid FROM orders WHERE o_orderkey % 5 = 0)
SELECT id, coalesce(p.uid, TRY_CAST(nullif(regexp_extract(i.name, '^(\\d+)_', 1), '') AS BIGINT), -1) AS uid FROM i LEFT JOIN p USING (name)
""")
def uid_regex_fallback(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    scan = F.concat(F.lit("scan-"), F.col("o_orderkey").cast("string"), F.lit(".png"))
    i = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit("_IM-"), F.col("o_orderkey").cast("string"), F.lit("-1001.png"))).otherwise(scan).alias("name"))
    p = o.where("o_orderkey % 5 = 0").select(scan.alias("name"), (F.col("o_custkey") + 100000).alias("file_uid"))
    return i.join(p, "name", "left").select("id", F.coalesce(X.uid_of(F.col("file_uid"), F.col("name")), F.lit(-1)).alias("uid"))


NAMES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'plain' || o_custkey ELSE o_custkey || '_IM-' || lpad((o_orderkey % 50)::VARCHAR, 4, '0') || '-' || o_orderkey % 3 || '.dcm.png' END AS name FROM orders"


def _names(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("plain"), c)).otherwise(F.concat(c, F.lit("_IM-"), F.lpad((k % 50).cast("string"), 4, "0"), F.lit("-"), (k % 3).cast("string"), F.lit(".dcm.png")))
    return _read(spark, sf_dir, "orders").select(k.alias("id"), name.alias("name"))


KEYED = f"WITH n AS ({NAMES}), g AS (SELECT id, name, CASE WHEN contains(name, '_IM-') THEN split_part(name, '_IM-', 1) || '_IM-' || split_part(split_part(name, '_IM-', 2), '-', 1) ELSE name END AS study FROM n)"
SPLIT = KEYED + ", s AS (SELECT study, CASE WHEN row_number() OVER (ORDER BY md5('42|' || study), study) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT study FROM g))"


def _split(spark, sf_dir):
    return sampling.group_split(_names(spark, sf_dir).withColumn("study", X.study_key(F.col("name"))), "study")


@query("study_key", KEYED + " SELECT id, study FROM g")
def study_key(spark, sf_dir):
    return _names(spark, sf_dir).select("id", X.study_key(F.col("name")).alias("study"))


@query("group_split", SPLIT + " SELECT id, study, split FROM g JOIN s USING (study)")
def group_split(spark, sf_dir):
    return _split(spark, sf_dir).select("id", "study", "split")


@query("split_leak_check", SPLIT + " SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test, 0::BIGINT AS n_leaked FROM s")
def split_leak_check(spark, sf_dir):
    s = _split(spark, sf_dir)
    groups = s.select("study", "split").distinct().agg(F.sum((F.col("split") == "train").cast("long")).alias("n_train"), F.sum((F.col("split") == "test").cast("long")).alias("n_test"))
    return groups.crossJoin(sampling.leaked_groups(s, "study").agg(F.count("*").alias("n_leaked")))


@query("patient_groups", "SELECT o.o_orderkey AS id, coalesce(c.c_custkey::VARCHAR, 'order' || o.o_orderkey) AS grp FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON c.c_custkey = o.o_custkey")
def patient_groups(spark, sf_dir):
    """An image without a known patient is a group of its own."""
    c = _read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").cast("string").alias("patient"))
    o = _read(spark, sf_dir, "orders").join(c, "o_custkey", "left")
    return o.select(F.col("o_orderkey").alias("id"), F.coalesce("patient", F.concat(F.lit("order"), F.col("o_orderkey").cast("string"))).alias("grp"))


@query("augmented_views", PRELUDE + "SELECT image_id, view::INT AS view FROM img, range(0, 3) t(view)")
def augmented_views(spark, sf_dir):
    return sampling.views(roles.images(spark, sf_dir), 2).select("image_id", "view")


@query("head_sample", PRELUDE + "SELECT image_id FROM img ORDER BY image_id LIMIT 25")
def head_sample(spark, sf_dir):
    """The feature is the limit itself: the first n rows in order."""
    return sampling.head(roles.images(spark, sf_dir), "image_id", 25).select("image_id")


@query("snapshot_diff", """
WITH a AS (SELECT 'f' || p_partkey AS path, sha256(p_name) AS digest FROM part WHERE p_partkey % 5 <> 0),
b AS (SELECT 'f' || p_partkey AS path, sha256(CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE p_name END) AS digest FROM part WHERE p_partkey % 6 <> 0)
SELECT path, CASE WHEN a.digest IS NULL THEN 'only_after' WHEN b.digest IS NULL THEN 'only_before' WHEN a.digest = b.digest THEN 'matched' ELSE 'mismatched' END AS state FROM a FULL JOIN b USING (path)
""")
def snapshot_diff(spark, sf_dir):
    p = _read(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
    a = p.where("p_partkey % 5 <> 0").select("path", F.sha2("p_name", 256).alias("digest"))
    b = p.where("p_partkey % 6 <> 0").select("path", F.sha2(F.when(F.col("p_partkey") % 7 == 0, F.col("p_type")).otherwise(F.col("p_name")), 256).alias("digest"))
    return snapshot.diff(a, b)


@query("concat_splits", "SELECT id, caption, count(*) AS n FROM (SELECT c_custkey AS id, c_name AS caption FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT n_nationkey, n_name FROM nation) GROUP BY 1, 2")
def concat_splits(spark, sf_dir):
    """Union by position, repeats kept."""
    parts = [_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("caption")), _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name")]
    return reduce(lambda a, b: a.union(b), parts).groupBy("id", "caption").agg(F.count("*").alias("n"))


EXPLAINED = PRELUDE + """
, nm AS (SELECT f AS feature_id, 'concept_' || f AS name FROM range(0, 64) t(f) WHERE f % 6 <> 0),
top AS (SELECT image_id, a.feature_id, coalesce(nm.name, 'unknown_feature_' || a.feature_id) AS name, round(activation, 4) AS activation, row_number() OVER (PARTITION BY image_id ORDER BY a.activation DESC, a.feature_id) AS k FROM act a LEFT JOIN nm USING (feature_id)),
ex AS (SELECT image_id, string_agg(name, ', ' ORDER BY k) AS names, max(name) FILTER (WHERE k = 1) AS first, max(activation) FILTER (WHERE k = 1) AS most, count(*) AS n FROM top WHERE k <= 5 GROUP BY 1)
"""


def _explained(spark, sf_dir):
    names = roles.features(spark).where("feature_id % 6 <> 0").select("feature_id", F.concat(F.lit("concept_"), F.col("feature_id").cast("string")).alias("name"))
    return explain.explain(roles.activations(spark, sf_dir), names, roles.vectors(spark, sf_dir))


@query("explanations_pseudo_report", EXPLAINED + """
SELECT v.image_id, coalesce(n, 0)::INT AS n, CASE WHEN n IS NULL THEN 'No active concepts detected.' ELSE 'The model identifies the following visual concepts in this radiograph: ' || names || '. The dominant concept is ''' || first || ''' (activation=' || printf('%.3f', most) || ').' END AS pseudo_report
FROM vecs v LEFT JOIN ex USING (image_id)
""")
def explanations_pseudo_report(spark, sf_dir):
    return _explained(spark, sf_dir).select("image_id", F.size("top_k_concepts").alias("n"), "pseudo_report")


@query("unknown_feature_names", EXPLAINED + "SELECT image_id, feature_id, name FROM top WHERE k <= 5 AND name LIKE 'unknown%'")
def unknown_feature_names(spark, sf_dir):
    c = _explained(spark, sf_dir).select("image_id", F.explode("top_k_concepts").alias("c"))
    return c.select("image_id", F.col("c.feature_id").alias("feature_id"), F.col("c.name").alias("name")).where("name like 'unknown%'")


@query("spl_pseudo_report", PRELUDE + """
, c AS (SELECT image_id, a.feature_id, term, activation, row_number() OVER (PARTITION BY image_id ORDER BY activation DESC, a.feature_id) AS k FROM act a JOIN vocab v ON v.term_idx = a.feature_id)
SELECT v.image_id, coalesce(count(term), 0)::INT AS n, 'Findings suggest: ' || coalesce(string_agg(term, ', ' ORDER BY k) FILTER (WHERE k <= 5), '') AS pseudo_report FROM vecs v LEFT JOIN c USING (image_id) GROUP BY v.image_id
""")
def spl_pseudo_report(spark, sf_dir):
    c = roles.activations(spark, sf_dir).join(roles.vocab(spark, sf_dir).select(F.col("term_idx").alias("feature_id"), F.col("term").alias("name")), "feature_id").withColumnRenamed("feature_id", "term_idx")
    return explain.splice_explanations(c, roles.vectors(spark, sf_dir)).select("image_id", F.size("top_k_concepts").alias("n"), "pseudo_report")


CONCEPTS = PRELUDE + ", con AS (SELECT image_id, term AS name FROM act JOIN vocab ON term_idx = feature_id WHERE activation > 0)\n"


def _concepts(spark, sf_dir):
    return roles.activations(spark, sf_dir).where("activation > 0").join(roles.vocab(spark, sf_dir).select(F.col("term_idx").alias("feature_id"), F.col("term").alias("name")), "feature_id")


@query("vocab_coverage", CONCEPTS + "SELECT (SELECT count(DISTINCT name) FROM con) AS n_active, count(DISTINCT term) AS n_terms, round(100.0 * (SELECT count(DISTINCT name) FROM con) / count(DISTINCT term), 6) AS coverage_pct, count(DISTINCT term) - (SELECT count(DISTINCT name) FROM con) AS n_unused FROM vocab")
def vocab_coverage(spark, sf_dir):
    return vocab.coverage(_concepts(spark, sf_dir), roles.vocab(spark, sf_dir)).withColumn("coverage_pct", R6("coverage_pct"))


@query("most_common_concepts", CONCEPTS + "SELECT name, count(*) AS n FROM con GROUP BY name ORDER BY n DESC, name LIMIT 20")
def most_common_concepts(spark, sf_dir):
    return vocab.most_common(_concepts(spark, sf_dir))


@query("unused_terms", CONCEPTS + "SELECT term FROM vocab WHERE term NOT IN (SELECT name FROM con)")
def unused_terms(spark, sf_dir):
    return vocab.unused(_concepts(spark, sf_dir), roles.vocab(spark, sf_dir))


@query("label_union", PRELUDE + "SELECT DISTINCT label FROM il")
def label_union(spark, sf_dir):
    return roles.image_labels(spark, sf_dir).select("label").distinct()


@query("parse_labels", """
WITH t AS (SELECT p_partkey AS id, unnest(string_split(p_type || ';' || p_brand || '/x;' || CASE WHEN p_partkey % 3 = 0 THEN 'Normal' ELSE ' ' || p_type || ' / left' END, ';')) AS x FROM part)
SELECT id, string_agg(DISTINCT l, '|' ORDER BY l) AS labels FROM (SELECT id, lower(trim(split_part(x, '/', 1))) AS l FROM t) WHERE l <> '' AND l <> 'normal' GROUP BY id
""")
def parse_labels(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    second = F.concat(F.col("p_brand"), F.lit("/x;"), F.when(F.col("p_partkey") % 3 == 0, F.lit("Normal")).otherwise(F.concat(F.lit(" "), F.col("p_type"), F.lit(" / left"))))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(X.clinical_labels(F.col("p_type"), second)), "|").alias("labels"))


@query("prompt_fill", "SELECT c_custkey AS id, 'Report: ' || c_mktsegment || ' / claim: ' || c_name || ' again ' || c_mktsegment AS prompt FROM customer")
def prompt_fill(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.prompt("Report: {report} / claim: {pseudo_report} again {report}", F.col("c_mktsegment"), F.col("c_name")).alias("prompt"))


@query("source_paths", "SELECT *, CASE source WHEN 'baseline' THEN '' ELSE '_' || source END AS suffix, 'judge_scores' || CASE source WHEN 'baseline' THEN '' ELSE '_' || source END || '_' || regexp_replace(model, '[/:]', '_', 'g') || '.json' AS file FROM (VALUES ('baseline', 'org/m:4b'), ('splice', 'a/b'), ('null_k5', 'plain')) t(source, model)")
def source_paths(spark, sf_dir):
    t = spark.createDataFrame([("baseline", "org/m:4b"), ("splice", "a/b"), ("null_k5", "plain")], "source string, model string")
    suffix = X.source_suffix(F.col("source"))
    return t.select("source", "model", suffix.alias("suffix"), F.concat(F.lit("judge_scores"), suffix, F.lit("_"), X.safe_model_name(F.col("model")), F.lit(".json")).alias("file"))


@query("vocabulary_entries", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS term FROM part")
def vocabulary_entries(spark, sf_dir):
    """Objects with a term, and bare strings."""
    p = _read(spark, sf_dir, "part")
    value = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.col("p_name").alias("term"), F.lit(0.5).alias("similarity_score")))).otherwise(F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("id"), X.vocabulary_term(value).alias("term"))


@query("content_digests", "SELECT page_id, sha256(html) AS digest, substr(sha256(html), 1, 16) AS prefix FROM pages")
def content_digests(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"), X.sha_prefix(F.col("html")).alias("prefix"))


@query("null_explanations", PRELUDE + """
, n AS (SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 2 WHEN image_id % 3 = 1 THEN 0 END AS k FROM img), t AS (SELECT count(DISTINCT term) AS t FROM vocab),
d AS (SELECT image_id, term, row_number() OVER (PARTITION BY image_id ORDER BY md5('42|' || image_id || '|' || term), term) AS place, least(greatest(coalesce(k, 7), 1), t) AS k FROM n, t, (SELECT DISTINCT term FROM vocab))
SELECT image_id, count(*)::INT AS n, 'Findings suggest: ' || string_agg(term, ', ' ORDER BY place) FILTER (WHERE place <= 5) AS pseudo_report FROM d WHERE place <= k GROUP BY image_id
""")
def null_explanations(spark, sf_dir):
    k = F.when(F.col("image_id") % 3 == 0, 2).when(F.col("image_id") % 3 == 1, 0)
    return explain.null_explanations(roles.images(spark, sf_dir).select("image_id", k.alias("n")), roles.vocab(spark, sf_dir), 42, 7)
