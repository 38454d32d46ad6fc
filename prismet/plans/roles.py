"""The engine's inputs, taken from the driver's tables, in Spark and in the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.functions.vectors import doubles
from prismet.operators.sparse import top_coordinates

WIDTH = 64
TOP = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocab(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").select(F.expr("vec_id div 10").alias("term_idx"), doubles("embedding").alias("emb"))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("term_idx"), F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("term"))
    return e.join(p, "term_idx").select("term_idx", "term", "emb")


def images(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id % 10 <> 0").select(F.col("vec_id").alias("image_id"), F.col("label").cast("long").alias("grp"), doubles("embedding").alias("emb"))


def decoder(spark, sf_dir) -> DataFrame:
    """Five models: the seed is the remainder of the id by five."""
    return read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("seed"), F.expr("vec_id div 5").alias("feature_id"), F.col("vec_id").alias("id"), doubles("embedding").alias("emb"))


def vectors(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").cast("long").alias("grp"), doubles("embedding").alias("emb"))


def activations(spark, sf_dir) -> DataFrame:
    return top_coordinates(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", TOP)


def features(spark) -> DataFrame:
    return spark.range(WIDTH).withColumnRenamed("id", "feature_id")


def relabelled(acts: DataFrame, seeds: DataFrame) -> DataFrame:
    """The same activations under a bijection of the features for every seed."""
    return acts.crossJoin(F.broadcast(seeds)).select("seed", "image_id", ((F.col("feature_id") * (2 * F.col("seed") + 1) + F.col("seed")) % WIDTH).alias("feature_id"), "activation")


def seeds(spark, n: int = 5) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "seed")


def image_labels(spark, sf_dir) -> DataFrame:
    """image_id, label: marks, language and source of the document of the same id."""
    marks = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"), F.explode(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))).alias("label"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))).alias("label"))
    return marks.unionByName(docs).where("label is not null").distinct().join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id")), "image_id", "left_semi")


def judge_log(spark, sf_dir) -> DataFrame:
    """Records of a judge, made from events."""
    kind = F.col("event_type")
    raw = F.when(kind == "view", "it fits | Verdict: Aligned").when(kind == "signup", "Supports").when(kind == "error", "ERROR: timeout").when(kind == "click", F.when(F.col("event_id") % 3 == 0, "no | Verdict: Unaligned.").when(F.col("event_id") % 3 == 1, "Aligned.").otherwise("well | Verdict: Contradicts it")).otherwise("Perhaps unclear to me")
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("image_id"), F.col("props").alias("pseudo_report"), raw.alias("raw_response"))


def tree(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Nodes (rid, label, pos, obsolete) and edges (child, parent): customers and suppliers below nations below regions."""
    r = lambda n: read(spark, sf_dir, n)
    c, s, n, g = r("customer"), r("supplier"), r("nation"), r("region")
    text = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = c.select(text("C", "c_custkey").alias("rid"), F.col("c_name").alias("label")).union(s.select(text("S", "s_suppkey"), "s_name")).union(n.select(text("N", "n_nationkey"), "n_name")).union(g.select(text("R", "r_regionkey"), "r_name"))
    edges = c.select(text("C", "c_custkey").alias("child"), text("N", "c_nationkey").alias("parent")).union(s.select(text("S", "s_suppkey"), text("N", "s_nationkey"))).union(n.select(text("N", "n_nationkey"), text("R", "n_regionkey")))
    return nodes, edges


PRELUDE = """WITH RECURSIVE
vocab AS (SELECT e.vec_id // 10 AS term_idx, p.p_name || '_' || p.p_partkey AS term, e.embedding::DOUBLE[] AS emb
          FROM embeddings e JOIN part p ON p.p_partkey = e.vec_id // 10 WHERE e.vec_id % 10 = 0),
img AS (SELECT vec_id AS image_id, label::BIGINT AS grp, embedding::DOUBLE[] AS emb FROM embeddings WHERE vec_id % 10 <> 0),
vecs AS (SELECT vec_id AS image_id, label::BIGINT AS grp, embedding::DOUBLE[] AS emb FROM embeddings),
decoder AS (SELECT vec_id % 5 AS seed, vec_id // 5 AS feature_id, vec_id AS id, embedding::DOUBLE[] AS emb FROM embeddings),
imgx AS (SELECT image_id, grp, unnest(emb) AS x, unnest(range(1, 65)) AS d FROM img),
vocx AS (SELECT term_idx, unnest(emb) AS x, unnest(range(1, 65)) AS d FROM vocab),
vecx AS (SELECT image_id, grp, unnest(emb) AS x, unnest(range(1, 65)) AS d FROM vecs),
gap AS (SELECT list(i.m - v.m ORDER BY i.d) AS g FROM (SELECT d, avg(x) AS m FROM imgx GROUP BY d) i JOIN (SELECT d, avg(x) AS m FROM vocx GROUP BY d) v USING (d)),
act AS (SELECT image_id, d - 1 AS feature_id, x AS activation FROM (SELECT image_id, d, x, row_number() OVER (PARTITION BY image_id ORDER BY x DESC, d) AS r FROM vecx) WHERE r <= 8 AND x > 0),
il AS (SELECT DISTINCT image_id, label FROM (
         SELECT doc_id AS image_id, 'quality' AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1
         UNION ALL SELECT doc_id, 'lang:' || lang FROM documents UNION ALL SELECT doc_id, 'source:' || source FROM documents)
       WHERE label IS NOT NULL AND image_id IN (SELECT vec_id FROM embeddings)),
log AS (SELECT event_id, user_id AS image_id, props AS pseudo_report,
          CASE event_type WHEN 'view' THEN 'it fits | Verdict: Aligned' WHEN 'signup' THEN 'Supports' WHEN 'error' THEN 'ERROR: timeout'
            WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'no | Verdict: Unaligned.' WHEN 1 THEN 'Aligned.' ELSE 'well | Verdict: Contradicts it' END
            ELSE 'Perhaps unclear to me' END AS raw_response FROM events),
nodes AS (SELECT 'C' || c_custkey AS rid, c_name AS label FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier
          UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region),
edges AS (SELECT 'C' || c_custkey AS child, 'N' || c_nationkey AS parent FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
          UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
closure AS (SELECT rid AS node, rid AS ancestor FROM nodes UNION SELECT c.node, e.parent FROM closure c JOIN edges e ON e.child = c.ancestor)
"""


def cosine_sql(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-12) * greatest(sqrt(list_dot_product({b}, {b})), 1e-12)))"
