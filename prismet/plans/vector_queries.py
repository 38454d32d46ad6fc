"""Queries over vectors: normalising, centroids, gap, naming, ranking and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismet.functions import vectors as V
from prismet.operators import similarity, vocab
from prismet.plans import roles
from prismet.plans.catalog import query
from prismet.plans.roles import PRELUDE, cosine_sql

R6 = lambda c: F.round(c, 6)


@query("concept_naming_top3", PRELUDE + f"""
, cen AS (SELECT grp, list(m ORDER BY d) AS v FROM (SELECT grp, d, avg(x) AS m FROM imgx GROUP BY grp, d) GROUP BY grp),
sh AS (SELECT grp, [v[i] - g[i] for i in range(1, 65)] AS v FROM cen, gap),
sc AS (SELECT grp, term, term_idx, {cosine_sql('v', 'emb')} AS s FROM sh, vocab)
SELECT grp, rank, term, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY s DESC, term_idx)::INT AS rank FROM sc) WHERE rank <= 3
""")
def concept_naming_top3(spark, sf_dir):
    images, terms = roles.images(spark, sf_dir), roles.vocab(spark, sf_dir)
    shifted = V.with_gap(V.mean_vector(images, "emb", "grp", name="emb"), V.modality_gap(images, terms))
    found = similarity.top_matches(shifted, terms, 3, left_id="grp", right_id="term_idx")
    return found.join(terms.select(F.col("term_idx").alias("right_id"), "term"), "right_id").select(F.col("left_id").alias("grp"), "rank", "term", R6("score").alias("score"))


@query("named_candidates", PRELUDE + f"""
, sc AS (SELECT d.feature_id, v.term, v.term_idx, {cosine_sql('d.emb', 'v.emb')} AS s FROM decoder d, vocab v WHERE d.seed = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY s DESC, term_idx) AS k FROM sc)
SELECT feature_id, max(term) FILTER (WHERE k = 1) AS name, round(max(s), 6) AS score, string_agg(term, ',' ORDER BY k) AS candidates FROM r WHERE k <= 3 GROUP BY feature_id
""")
def named_candidates(spark, sf_dir):
    terms = roles.vocab(spark, sf_dir)
    found = similarity.top_matches(roles.decoder(spark, sf_dir).where("seed = 0"), terms, 3, left_id="feature_id", right_id="term_idx")
    named = similarity.named_candidates(found, terms)
    return named.select(F.col("left_id").alias("feature_id"), "name", R6("score").alias("score"), F.array_join(F.transform("candidates", lambda c: c["label"]), ",").alias("candidates"))


@query("l2_normalize", PRELUDE + """
SELECT image_id, round(u[1], 6) + 0.0 AS first, round(u[64], 6) + 0.0 AS last, round(list_sum(u), 6) + 0.0 AS total
FROM (SELECT image_id, [x * (image_id % 7) / greatest(sqrt(list_dot_product(emb, emb)) * (image_id % 7), 1e-12) for x in emb] AS u FROM vecs)
""")
def l2_normalize(spark, sf_dir):
    scaled = roles.vectors(spark, sf_dir).withColumn("emb", F.transform("emb", lambda x: x * (F.col("image_id") % 7)))
    u = scaled.select("image_id", V.l2_normalize(F.col("emb")).alias("u"))
    return u.select("image_id", R6(F.col("u")[0]).alias("first"), R6(F.col("u")[63]).alias("last"), R6(F.aggregate("u", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("label_centroids", PRELUDE + "SELECT grp, d - 1 AS dim, round(avg(x), 6) AS value FROM vecx GROUP BY grp, d")
def label_centroids(spark, sf_dir):
    means = V.mean_vector(roles.vectors(spark, sf_dir), "emb", "grp")
    return V.entries(means, "mean", "grp").select("grp", F.col("dim").cast("long").alias("dim"), R6("value").alias("value"))


@query("modality_gap", PRELUDE + "SELECT unnest(range(0, 64)) AS dim, round(unnest(g), 6) AS value FROM gap")
def modality_gap(spark, sf_dir):
    gap = V.modality_gap(roles.images(spark, sf_dir), roles.vocab(spark, sf_dir))
    return V.entries(gap, "gap").select(F.col("dim").cast("long").alias("dim"), R6("value").alias("value"))


@query("norm_summary", PRELUDE + """
, n AS (SELECT sqrt(list_dot_product(emb, emb)) * (1 + image_id % 5) AS n FROM vecs)
SELECT round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, round(min(n), 6) AS least, round(max(n), 6) AS most FROM n
""")
def norm_summary(spark, sf_dir):
    n = roles.vectors(spark, sf_dir).select((V.norm(F.col("emb")) * (1 + F.col("image_id") % 5)).alias("n"))
    return n.agg(R6(F.avg("n")).alias("mean"), R6(F.stddev_samp("n")).alias("sd"), R6(F.min("n")).alias("least"), R6(F.max("n")).alias("most"))


RANKED = PRELUDE + f"""
, ux AS (SELECT grp, d, avg(x) AS m FROM (SELECT image_id, grp, d, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY image_id)), 1e-12) AS x FROM imgx) GROUP BY grp, d),
cen AS (SELECT grp, list(m ORDER BY d) AS v FROM ux GROUP BY grp),
scored AS (SELECT term_idx, term, max({cosine_sql('emb', 'v')}) AS score FROM vocab, cen GROUP BY term_idx, term)
"""


def _scored(spark, sf_dir):
    terms = roles.vocab(spark, sf_dir)
    return vocab.rank_terms(terms, vocab.centroids(roles.images(spark, sf_dir), "grp"), "grp").join(terms.select("term_idx", "term"), "term_idx")


@query("centroid_rank_terms", RANKED + "SELECT term_idx, term, round(score, 6) AS score FROM scored")
def centroid_rank_terms(spark, sf_dir):
    return _scored(spark, sf_dir).select("term_idx", "term", R6("score").alias("score"))


@query("build_vocabulary_topk_seeds", RANKED + """
, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, term_idx) AS pos, 'ranked' AS source FROM (SELECT * FROM scored ORDER BY score DESC, term_idx LIMIT 20)),
added AS (SELECT term_idx, term, score, 20 + row_number() OVER (ORDER BY term_idx) AS pos, 'seed' AS source FROM scored WHERE term_idx % 6 = 0 AND lower(term) NOT IN (SELECT lower(term) FROM top)),
both_ AS (SELECT term, round(score, 6) AS score, source, pos FROM top UNION ALL SELECT term, round(score, 6), source, pos FROM added)
SELECT term, score, source, row_number() OVER (ORDER BY score DESC, pos)::INT AS place FROM both_
""")
def build_vocabulary_topk_seeds(spark, sf_dir):
    seeds = roles.vocab(spark, sf_dir).where("term_idx % 6 = 0").select(F.upper("term").alias("term"))
    return vocab.build(_scored(spark, sf_dir), 20, seeds)


BEST = PRELUDE + """
, s AS (SELECT a.seed AS seed_i, b.seed AS seed_j, a.feature_id AS i, b.feature_id AS j, list_dot_product(a.emb, b.emb) / (sqrt(list_dot_product(a.emb, a.emb)) * sqrt(list_dot_product(b.emb, b.emb))) AS c FROM decoder a JOIN decoder b ON a.seed < b.seed),
f AS (SELECT seed_i, seed_j, i, j, c FROM (SELECT *, row_number() OVER (PARTITION BY seed_i, seed_j, i ORDER BY c DESC, j) AS k FROM s) WHERE k = 1),
g AS (SELECT seed_i, seed_j, i, j, c FROM (SELECT *, row_number() OVER (PARTITION BY seed_i, seed_j, j ORDER BY c DESC, i) AS k FROM s) WHERE k = 1)
"""


def _all_pairs(spark, sf_dir):
    return similarity.best_between(roles.decoder(spark, sf_dir))


@query("best_match_pairs", BEST + "SELECT seed_i, seed_j, i AS left_id, j AS right_id, round(c, 6) AS score FROM f")
def best_match_pairs(spark, sf_dir):
    """For every feature its best match in each later seed."""
    return _all_pairs(spark, sf_dir).select("seed_i", "seed_j", "left_id", "right_id", R6("score").alias("score"))


@query("mutual_matches", BEST + "SELECT seed_i, seed_j, i AS left_id, j AS right_id, round(f.c, 6) AS score FROM f JOIN g USING (seed_i, seed_j, i, j)")
def mutual_matches(spark, sf_dir):
    return _all_pairs(spark, sf_dir).where("mutual").select("seed_i", "seed_j", "left_id", "right_id", R6("score").alias("score"))


@query("matched_summary", BEST + """
SELECT seed_i, seed_j, round(avg(f.c), 6) AS mean_best, round(avg((f.c >= 0.3)::INT), 6) AS frac_03, round(avg((f.c >= 0.5)::INT), 6) AS frac_05,
       round(count(g.c) / count(*), 6) AS mutual FROM f LEFT JOIN g USING (seed_i, seed_j, i, j) GROUP BY seed_i, seed_j
""")
def matched_summary(spark, sf_dir):
    share = lambda c: R6(F.avg(c.cast("double")))
    return _all_pairs(spark, sf_dir).groupBy("seed_i", "seed_j").agg(R6(F.avg("score")).alias("mean_best"), share(F.col("score") >= 0.3).alias("frac_03"), share(F.col("score") >= 0.5).alias("frac_05"), share(F.col("mutual")).alias("mutual"))


@query("threshold_edges", PRELUDE + """
SELECT a.id AS a, b.id AS b, round(list_dot_product(a.emb, b.emb) / (sqrt(list_dot_product(a.emb, a.emb)) * sqrt(list_dot_product(b.emb, b.emb))), 6) AS score
FROM decoder a JOIN decoder b ON a.id < b.id WHERE list_dot_product(a.emb, b.emb) / (sqrt(list_dot_product(a.emb, a.emb)) * sqrt(list_dot_product(b.emb, b.emb))) > 0.4
""")
def threshold_edges(spark, sf_dir):
    return similarity.threshold_edges(roles.decoder(spark, sf_dir), 0.4).select("a", "b", R6("score").alias("score"))
