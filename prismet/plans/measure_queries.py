"""Queries over sparse activations: sparsity, stability, faithfulness and judge scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismet.functions import figures
from prismet.functions import text as X
from prismet.functions import vectors as V
from prismet.operators import faithfulness, graph, judge, organize, similarity, sparse, stability
from prismet.plans import roles
from prismet.plans.catalog import query
from prismet.plans.roles import PRELUDE, WIDTH
from prismet.plans.vector_queries import BEST

R6 = lambda c: F.round(c, 6)


@query("topk_activations", PRELUDE + "SELECT image_id, feature_id, round(activation, 6) AS activation FROM act")
def topk_activations(spark, sf_dir):
    return roles.activations(spark, sf_dir).select("image_id", "feature_id", R6("activation").alias("activation"))


@query("topn_per_image", PRELUDE + "SELECT image_id, feature_id, round(activation, 6) AS activation, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY activation DESC, feature_id) AS r FROM act) WHERE r <= 3")
def topn_per_image(spark, sf_dir):
    return sparse.top_per_image(roles.activations(spark, sf_dir), 3).select("image_id", "feature_id", R6("activation").alias("activation"), "rank")


@query("sparsity_metrics", PRELUDE + """
, l0 AS (SELECT v.image_id, count(a.feature_id) AS n FROM vecs v LEFT JOIN act a USING (image_id) GROUP BY v.image_id)
SELECT round(avg(n), 6) AS l0_mean, round(stddev_samp(n), 6) AS l0_std, (SELECT round(100.0 * (64 - count(DISTINCT feature_id)) / 64, 6) FROM act) AS dead_pct,
       (SELECT round(100.0 * count(DISTINCT feature_id) / 64, 6) FROM act) AS used_pct FROM l0
""")
def sparsity_metrics(spark, sf_dir):
    s = sparse.sparsity(roles.activations(spark, sf_dir), roles.vectors(spark, sf_dir), WIDTH)
    return s.select(*[R6(c).alias(c) for c in s.columns])


@query("activation_entropy", PRELUDE + """
, c AS (SELECT feature_id, count(*) AS n FROM act GROUP BY feature_id), t AS (SELECT sum(n) AS t FROM c)
SELECT round(-sum(n / (t + 1e-8) * ln(n / (t + 1e-8))), 6) AS entropy FROM c, t
""")
def activation_entropy(spark, sf_dir):
    return sparse.entropy(sparse.feature_counts(roles.activations(spark, sf_dir))).select(R6("entropy").alias("entropy"))


@query("dead_features", PRELUDE + "SELECT f AS feature_id FROM range(0, 64) t(f) WHERE f NOT IN (SELECT feature_id FROM act WHERE activation > 0)")
def dead_features(spark, sf_dir):
    """Features that fire on no image at all."""
    return sparse.dead_features(roles.activations(spark, sf_dir), roles.features(spark))


@query("feature_frequency", PRELUDE + """
, f AS (SELECT f AS feature_id, count(a.image_id) AS n FROM range(0, 64) t(f) LEFT JOIN act a ON a.feature_id = f GROUP BY f)
SELECT feature_id, round(n / (SELECT count(*) FROM vecs), 6) AS frequency FROM f
""")
def feature_frequency(spark, sf_dir):
    n = roles.vectors(spark, sf_dir).count()
    return sparse.frequency(roles.activations(spark, sf_dir), roles.features(spark), F.lit(n)).select("feature_id", R6("frequency").alias("frequency"))


@query("feature_frequency_summary", PRELUDE + """
, f AS (SELECT f AS feature_id, count(a.image_id) / (SELECT count(*) FROM vecs) AS q FROM range(0, 64) t(f) LEFT JOIN act a ON a.feature_id = f GROUP BY f)
SELECT round(avg(q), 6) AS mean, round(stddev_samp(q), 6) AS sd FROM f
""")
def feature_frequency_summary(spark, sf_dir):
    n = roles.vectors(spark, sf_dir).count()
    return sparse.frequency(roles.activations(spark, sf_dir), roles.features(spark), F.lit(n)).agg(R6(F.avg("frequency")).alias("mean"), R6(F.stddev_samp("frequency")).alias("sd"))


COACT = PRELUDE + """
, n AS (SELECT feature_id, sqrt(count(*)) + 1e-8 AS n FROM act GROUP BY feature_id),
j AS (SELECT a.feature_id AS a, b.feature_id AS b, count(*) AS n_ab FROM act a JOIN act b ON a.image_id = b.image_id AND a.feature_id <= b.feature_id GROUP BY 1, 2),
s AS (SELECT j.a, j.b, n_ab, n_ab / (x.n * y.n) AS similarity FROM j JOIN n x ON x.feature_id = j.a JOIN n y ON y.feature_id = j.b)
"""


@query("coactivation_pairs", COACT + "SELECT a, b, n_ab, round(similarity, 6) AS similarity FROM s WHERE a < b")
def coactivation_pairs(spark, sf_dir):
    return sparse.coactivation(roles.activations(spark, sf_dir)).where("a < b").select("a", "b", "n_ab", R6("similarity").alias("similarity"))


@query("coactivation_summary", COACT + """
, k AS (SELECT count(*) AS k FROM n)
SELECT k AS n_active, (SELECT count(*) FROM s WHERE a < b AND similarity > 0.15) AS high_pairs, round((SELECT sum(CASE WHEN a = b THEN similarity ELSE 2 * similarity END) FROM s) / (k * k), 6) AS mean_co_occurrence FROM k
""")
def coactivation_summary(spark, sf_dir):
    return sparse.coactivation_summary(roles.activations(spark, sf_dir), 0.15).select("n_active", "high_pairs", R6("mean_co_occurrence").alias("mean_co_occurrence"))


@query("recon_mse_cosine", PRELUDE + """
, w AS (SELECT d.feature_id, d.emb FROM decoder d WHERE d.seed = 0),
r AS (SELECT a.image_id, i AS d, sum(a.activation * w.emb[i]) AS hat FROM act a JOIN w USING (feature_id), range(1, 65) t(i) GROUP BY 1, 2),
p AS (SELECT x.image_id, avg((x.x - coalesce(hat, 0)) ** 2) AS mse, sum(x.x * coalesce(hat, 0)) AS xy, sum(x.x * x.x) AS xx, sum(coalesce(hat, 0) ** 2) AS yy FROM vecx x LEFT JOIN r ON r.image_id = x.image_id AND r.d = x.d GROUP BY x.image_id)
SELECT round(avg(mse), 6) AS mse, round(avg(xy / (greatest(sqrt(xx), 1e-12) * greatest(sqrt(yy), 1e-12))), 6) AS cosine FROM p
""")
def recon_mse_cosine(spark, sf_dir):
    weights = roles.decoder(spark, sf_dir).where("seed = 0")
    s = sparse.reconstruction(V.entries(roles.vectors(spark, sf_dir), "emb", "image_id"), sparse.decode(roles.activations(spark, sf_dir), weights))
    return s.select(R6("mse").alias("mse"), R6("cosine").alias("cosine"))


SLOT = PRELUDE + """
, sd AS (SELECT s, image_id, (feature_id * (2 * s + 1) + s) % 64 AS f FROM act, range(0, 5) t(s)),
n AS (SELECT s, image_id, count(*) AS n FROM sd GROUP BY 1, 2),
base AS (SELECT i.s AS i, j.s AS j, v.image_id FROM range(0, 5) i(s), range(0, 5) j(s), vecs v WHERE i.s <= j.s),
x AS (SELECT a.s AS i, b.s AS j, a.image_id, count(*) AS k FROM sd a JOIN sd b ON a.image_id = b.image_id AND a.f = b.f AND a.s <= b.s GROUP BY 1, 2, 3),
m AS (SELECT base.i, base.j, avg(CASE WHEN coalesce(p.n, 0) + coalesce(q.n, 0) = 0 THEN 0 ELSE coalesce(k, 0) / (p.n + q.n - coalesce(k, 0)) END) AS jac
      FROM base LEFT JOIN x ON x.i = base.i AND x.j = base.j AND x.image_id = base.image_id LEFT JOIN n p ON p.s = base.i AND p.image_id = base.image_id LEFT JOIN n q ON q.s = base.j AND q.image_id = base.image_id GROUP BY 1, 2)
"""


def _slots(spark, sf_dir):
    seeds = roles.seeds(spark)
    return sparse.slot_jaccard(roles.relabelled(roles.activations(spark, sf_dir), seeds), roles.vectors(spark, sf_dir), seeds)


@query("slot_jaccard_matrix", SLOT + "SELECT i AS seed_i, j AS seed_j, round(jac, 6) AS jaccard FROM m")
def slot_jaccard_matrix(spark, sf_dir):
    return _slots(spark, sf_dir).select("seed_i", "seed_j", R6("jaccard").alias("jaccard"))


@query("relabel_control", SLOT + "SELECT round(avg(jac) FILTER (WHERE i < j), 6) AS slot_mean, round(stddev_pop(jac) FILTER (WHERE i < j), 6) AS slot_sd, round(avg(jac) FILTER (WHERE i = j), 6) AS own FROM m")
def relabel_control(spark, sf_dir):
    """Permuting the features of one model leaves its function alone and makes slot sets disagree."""
    m = _slots(spark, sf_dir)
    off = F.when(F.col("seed_i") < F.col("seed_j"), F.col("jaccard"))
    return m.agg(R6(F.avg(off)).alias("slot_mean"), R6(F.stddev_pop(off)).alias("slot_sd"), R6(F.avg(F.when(F.col("seed_i") == F.col("seed_j"), F.col("jaccard")))).alias("own"))


@query("chance_floor", SLOT + "SELECT i AS seed_i, j AS seed_j, round(jac, 6) AS jaccard, round(8 / (2.0 * 64 - 8), 6) AS floor, round(jac / (8 / (2.0 * 64 - 8)), 6) AS ratio FROM m WHERE i < j")
def chance_floor(spark, sf_dir):
    """The slot overlap of each pair of models beside that expected of independent ones."""
    floor = stability.chance_floor(roles.TOP, WIDTH)
    pairs = _slots(spark, sf_dir).where("seed_i < seed_j")
    return pairs.select("seed_i", "seed_j", R6("jaccard").alias("jaccard"), R6(F.lit(floor)).alias("floor"), R6(F.col("jaccard") / floor).alias("ratio"))


@query("figure_heatmap", SLOT + "SELECT i AS x, j AS y, round(jac, 6) AS value FROM m UNION ALL SELECT j, i, round(jac, 6) FROM m WHERE i < j")
def figure_heatmap(spark, sf_dir):
    """The data of the heat map of slot overlaps: all cells, both halves."""
    return figures.heatmap(_slots(spark, sf_dir), "seed_i", "seed_j", "jaccard").withColumn("value", R6("value"))


COMP = PRELUDE + """
, un AS (SELECT id, seed, [x / sqrt(list_dot_product(emb, emb)) for x in emb] AS u FROM decoder),
e AS (SELECT a.id AS a, b.id AS b FROM un a JOIN un b ON a.id <> b.id WHERE list_dot_product(a.u, b.u) > 0.5),
reach AS (SELECT id AS v, id AS w FROM un UNION SELECT r.v, e.b FROM reach r JOIN e ON e.a = r.w),
lab AS (SELECT v AS id, min(w) AS component FROM reach GROUP BY v),
l AS (SELECT lab.*, seed, u FROM lab JOIN un USING (id)),
c AS (SELECT component, count(*) AS n, count(DISTINCT seed) AS seeds FROM l GROUP BY component)
"""


def _components(spark, sf_dir):
    d = roles.decoder(spark, sf_dir)
    return d.join(graph.connected_components(d.select("id"), similarity.threshold_edges(d, 0.5)), "id")


@query("components_tau", COMP + "SELECT id, component FROM lab")
def components_tau(spark, sf_dir):
    return _components(spark, sf_dir).select("id", "component")


@query("component_stats", COMP + "SELECT count(*) AS n_components, count(*) FILTER (WHERE n > 1) AS n_multi, max(n) AS max_size FROM c")
def component_stats(spark, sf_dir):
    return stability.component_stats(_components(spark, sf_dir))


@query("consensus_at_m", COMP + "SELECT m::INT AS m, round(sum(n) FILTER (WHERE seeds >= m) / sum(n), 6) AS consensus FROM c, range(2, 5) t(m) GROUP BY m")
def consensus_at_m(spark, sf_dir):
    labelled = _components(spark, sf_dir)
    spans = labelled.groupBy("component").agg(F.countDistinct("seed").alias("seeds"), F.count("*").alias("n"))
    m = spark.range(2, 5).select(F.col("id").cast("int").alias("m"))
    return spans.crossJoin(F.broadcast(m)).groupBy("m").agg(R6(F.sum(F.when(F.col("seeds") >= F.col("m"), F.col("n"))) / F.sum("n")).alias("consensus"))


@query("seed_count_hist", COMP + "SELECT seeds, count(*) AS n_components FROM c GROUP BY seeds")
def seed_count_hist(spark, sf_dir):
    return stability.seed_count_histogram(_components(spark, sf_dir))


@query("cohesion", COMP + ", p AS (SELECT a.component, avg(list_dot_product(a.u, b.u)) AS m FROM l a JOIN l b ON a.component = b.component AND a.id < b.id GROUP BY 1) SELECT round(avg(m), 6) AS cohesion FROM p")
def cohesion(spark, sf_dir):
    return stability.cohesion(_components(spark, sf_dir)).select(R6("cohesion").alias("cohesion"))


@query("prevalence_filter", PRELUDE + "SELECT image_id, label FROM il WHERE label IN (SELECT label FROM il GROUP BY label HAVING count(*) >= 10)")
def prevalence_filter(spark, sf_dir):
    return faithfulness.prevalent(roles.image_labels(spark, sf_dir), 10)


@query("zscore_columns", PRELUDE + ", s AS (SELECT feature_id, avg(activation) AS m, stddev_pop(activation) AS s FROM act GROUP BY 1) SELECT image_id, feature_id, round((activation - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS z FROM act JOIN s USING (feature_id)")
def zscore_columns(spark, sf_dir):
    return sparse.zscored(roles.activations(spark, sf_dir), "feature_id", "activation").select("image_id", "feature_id", R6("z").alias("z"))


CORR = PRELUDE + """
, pl AS (SELECT image_id, label FROM il WHERE label IN (SELECT label FROM il GROUP BY label HAVING count(*) >= 10)),
lb AS (SELECT DISTINCT label FROM pl),
dense AS (SELECT f AS feature_id, lb.label, v.image_id, coalesce(a.activation, 0) AS a, (p.image_id IS NOT NULL)::INT AS y
          FROM (SELECT DISTINCT feature_id AS f FROM act) t, lb, vecs v LEFT JOIN act a ON a.image_id = v.image_id AND a.feature_id = t.f LEFT JOIN pl p ON p.image_id = v.image_id AND p.label = lb.label),
r AS (SELECT feature_id, label, corr(a, y) AS r FROM dense GROUP BY 1, 2),
best AS (SELECT feature_id, abs_r, label FROM (SELECT feature_id, round(abs(r), 10) AS abs_r, label, row_number() OVER (PARTITION BY feature_id ORDER BY round(abs(r), 10) DESC, label) AS k FROM r) WHERE k = 1)
"""


def _correlations(spark, sf_dir):
    labels = faithfulness.prevalent(roles.image_labels(spark, sf_dir), 10)
    return faithfulness.point_biserial(roles.activations(spark, sf_dir), labels, roles.vectors(spark, sf_dir).count())


@query("point_biserial", CORR + "SELECT feature_id, label, round(r, 6) + 0.0 AS r FROM r")
def point_biserial(spark, sf_dir):
    return _correlations(spark, sf_dir).select("feature_id", "label", R6("r").alias("r"))


@query("best_label_per_feature", CORR + "SELECT feature_id, round(abs_r, 6) AS abs_r, label FROM best")
def best_label_per_feature(spark, sf_dir):
    return faithfulness.best_label(_correlations(spark, sf_dir)).select("feature_id", R6("abs_r").alias("abs_r"), "label")


@query("top_faithful", CORR + "SELECT feature_id, round(abs_r, 6) AS abs_r, label FROM best ORDER BY best.abs_r DESC, feature_id LIMIT 10")
def top_faithful(spark, sf_dir):
    return faithfulness.top_faithful(faithfulness.best_label(_correlations(spark, sf_dir))).select("feature_id", R6("abs_r").alias("abs_r"), "label")


@query("bh_fdr", PRELUDE + """
, p AS (SELECT feature_id, (feature_id * 37 % 64 + 1) / 641.0 AS p FROM range(0, 64) t(feature_id)),
k AS (SELECT *, row_number() OVER (ORDER BY p, feature_id) AS r, count(*) OVER () AS n FROM p)
SELECT feature_id, round(p, 6) AS p, round(least(1, min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM k
""")
def bh_fdr(spark, sf_dir):
    p = roles.features(spark).select("feature_id", ((F.col("feature_id") * 37 % 64 + 1) / 641.0).alias("p"))
    return faithfulness.bh_fdr(p, "p", "feature_id").select("feature_id", R6("p").alias("p"), R6("q").alias("q"))


@query("percentile95", PRELUDE + "SELECT feature_id, round(quantile_cont(activation, 0.95), 6) AS p95 FROM act GROUP BY feature_id")
def percentile95(spark, sf_dir):
    return faithfulness.percentile95(roles.activations(spark, sf_dir), "activation", "feature_id").select("feature_id", R6("p95").alias("p95"))


@query("seed_aggregates", PRELUDE + ", n AS (SELECT seed, avg(list_sum(emb)) AS v FROM decoder GROUP BY seed) SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, string_agg(printf('%.6f', v + 0.0), ',' ORDER BY seed) AS \"values\" FROM n")
def seed_aggregates(spark, sf_dir):
    total = F.aggregate("emb", F.lit(0.0), lambda s, x: s + x)
    n = roles.decoder(spark, sf_dir).groupBy("seed").agg(F.avg(total).alias("v"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seed", "v"))), lambda x: F.format_string("%.6f", x["v"])), ",")
    return n.agg(R6(F.avg("v")).alias("mean"), R6(F.stddev_pop("v")).alias("sd"), listed.alias("values"))


VERDICT = """CASE
 WHEN contains(raw_response, 'Verdict:') AND coalesce({stage1}) IS NOT NULL THEN coalesce({stage1}) ELSE {stage2} END""".format(
    stage1=", ".join(f"CASE WHEN contains(lower(split_part(raw_response, 'Verdict:', -1)), '{k.lower()}') THEN '{v}' END" for k, v in [*((x, x) for x in X.VERDICTS), *X.ALIASES.items()]),
    stage2="coalesce(" + ", ".join(f"CASE WHEN list_contains(string_split_regex(lower(trim(raw_response)), '\\s+'), '{v.lower()}') THEN '{v}' END" for v in ("Aligned", "Unaligned", "Uncertain"))
    + ", list_filter(list_transform(string_split_regex(lower(trim(raw_response)), '\\s+'), lambda w: CASE " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in X.ALIASES.items()) + " END), lambda v: v IS NOT NULL)[1])",
)
PARSED = PRELUDE + f", parsed AS (SELECT *, {VERDICT} AS said, coalesce({VERDICT}, 'Uncertain') AS verdict FROM log)\n"


def _records(spark, sf_dir):
    return roles.judge_log(spark, sf_dir).withColumn("said", X.verdict(F.col("raw_response"))).withColumn("verdict", F.coalesce("said", F.lit("Uncertain")))


@query("verdict_parse", PARSED + "SELECT event_id, raw_response, said FROM parsed")
def verdict_parse(spark, sf_dir):
    return _records(spark, sf_dir).select("event_id", "raw_response", "said")


@query("judge_resume_antijoin", PARSED + """
, done AS (SELECT DISTINCT image_id, pseudo_report FROM log WHERE event_id % 2 = 0 AND NOT starts_with(raw_response, 'ERROR:'))
SELECT min(event_id) AS event_id, image_id, pseudo_report FROM log l WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM done d WHERE d.image_id = l.image_id AND d.pseudo_report = l.pseudo_report) GROUP BY image_id, pseudo_report
""")
def judge_resume_antijoin(spark, sf_dir):
    log = roles.judge_log(spark, sf_dir)
    return judge.pending(log.where("event_id % 2 = 1").drop("raw_response"), log.where("event_id % 2 = 0"), ["image_id", "pseudo_report"], "event_id").select("event_id", "image_id", "pseudo_report")


SCORES = """count(*) FILTER (WHERE NOT e AND verdict = 'Aligned') AS aligned, count(*) FILTER (WHERE NOT e AND verdict = 'Unaligned') AS unaligned,
 count(*) FILTER (WHERE NOT e AND verdict = 'Uncertain') AS uncertain, count(*) FILTER (WHERE e) AS n_errors, count(*) FILTER (WHERE NOT e) AS n_valid, count(*) AS n_total,
 coalesce(round(count(*) FILTER (WHERE NOT e AND verdict = 'Aligned') / nullif(count(*) FILTER (WHERE NOT e), 0), 4), 0) AS aligned_rate
 FROM (SELECT *, starts_with(raw_response, 'ERROR:') AS e FROM parsed)"""


@query("judge_scores", PARSED + "SELECT " + SCORES)
def judge_scores(spark, sf_dir):
    return judge.scores(_records(spark, sf_dir))


@query("judge_scores_by_model", PARSED + "SELECT image_id % 3 AS model, " + SCORES + " GROUP BY image_id % 3")
def judge_scores_by_model(spark, sf_dir):
    return judge.scores(_records(spark, sf_dir).withColumn("model", F.col("image_id") % 3), "model")


@query("verdict_pivot", PARSED + "SELECT image_id % 3 AS model, count(*) FILTER (WHERE verdict = 'Aligned') AS \"Aligned\", count(*) FILTER (WHERE verdict = 'Unaligned') AS \"Unaligned\", count(*) FILTER (WHERE verdict = 'Uncertain') AS \"Uncertain\" FROM parsed GROUP BY 1")
def verdict_pivot(spark, sf_dir):
    return judge.distribution(_records(spark, sf_dir).withColumn("model", F.col("image_id") % 3), "model")


def _families(spark, sf_dir):
    """Concepts are the features; a feature's family is its remainder by eight."""
    acts = roles.activations(spark, sf_dir).select("image_id", F.col("feature_id").alias("name"), "activation")
    fams = roles.features(spark).select(F.col("feature_id").alias("name"), (F.col("feature_id") % 8).alias("cluster_id"))
    return acts, organize.families(acts, fams)


FAM = PRELUDE + ", fam AS (SELECT image_id, feature_id % 8 AS cluster_id, sum(activation) AS activation, count(*) AS intra FROM act GROUP BY 1, 2)\n"
PER_IMAGE = FAM + """, per AS (SELECT v.image_id, coalesce(r.n, 0) AS n_raw, coalesce(f.n, 0) AS n_families, CASE WHEN coalesce(f.n, 0) > 0 THEN r.n / f.n ELSE 0 END AS redundancy
 FROM vecs v LEFT JOIN (SELECT image_id, count(*) AS n FROM act GROUP BY 1) r USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS n FROM fam GROUP BY 1) f USING (image_id))
"""


@query("image_families", FAM + "SELECT image_id, cluster_id, round(activation, 6) AS activation, intra FROM fam")
def image_families(spark, sf_dir):
    return _families(spark, sf_dir)[1].select("image_id", "cluster_id", R6("activation").alias("activation"), "intra")


@query("image_redundancy", PER_IMAGE + "SELECT image_id, n_raw, n_families, round(redundancy, 6) AS redundancy FROM per")
def image_redundancy(spark, sf_dir):
    acts, fams = _families(spark, sf_dir)
    return organize.redundancy(acts, fams, roles.vectors(spark, sf_dir)).withColumn("redundancy", R6("redundancy"))


@query("redundancy_metrics", PER_IMAGE + "SELECT round(avg(n_raw), 6) AS mean_raw, round(avg(n_families), 6) AS mean_families, count(*) FILTER (WHERE n_raw = 0) AS n_empty, round(avg(n_raw) / avg(n_families), 6) AS redundancy_reduction FROM per")
def redundancy_metrics(spark, sf_dir):
    acts, fams = _families(spark, sf_dir)
    m = organize.redundancy_metrics(organize.redundancy(acts, fams, roles.vectors(spark, sf_dir)))
    return m.select(R6("mean_raw").alias("mean_raw"), R6("mean_families").alias("mean_families"), "n_empty", R6("redundancy_reduction").alias("redundancy_reduction"))


def _members(spark, sf_dir):
    return roles.vectors(spark, sf_dir).select(F.col("grp").alias("cluster_id"), F.col("image_id").alias("name"), "emb")


UNIT = PRELUDE + ", un AS (SELECT grp AS cluster_id, image_id AS name, [x / greatest(sqrt(list_dot_product(emb, emb)), 1e-12) for x in emb] AS u FROM vecs)\n"


@query("medoids", UNIT + """, m AS (SELECT a.cluster_id, a.name, avg(list_dot_product(a.u, b.u)) AS s FROM un a JOIN un b ON a.cluster_id = b.cluster_id AND a.name <> b.name GROUP BY 1, 2)
SELECT cluster_id, name AS medoid, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(s, 10) DESC, name) AS k FROM m) WHERE k = 1""")
def medoids(spark, sf_dir):
    return organize.medoids(_members(spark, sf_dir)).select("cluster_id", "medoid", R6("score").alias("score"))


@query("silhouette_cosine", UNIT + """, d AS (SELECT a.cluster_id, a.name, b.cluster_id AS other, sum(1 - list_dot_product(a.u, b.u)) AS s, count(*) AS n FROM un a JOIN un b ON a.name <> b.name GROUP BY 1, 2, 3),
ab AS (SELECT cluster_id, name, max(s / n) FILTER (WHERE other = cluster_id) AS a, min(s / n) FILTER (WHERE other <> cluster_id) AS b FROM d GROUP BY 1, 2)
SELECT cluster_id, name, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS s FROM ab""")
def silhouette_cosine(spark, sf_dir):
    return organize.silhouette(_members(spark, sf_dir)).withColumn("s", R6("s"))


@query("cluster_ids", PRELUDE + ", m AS (SELECT grp, list(image_id ORDER BY image_id) AS members FROM vecs GROUP BY grp) SELECT (dense_rank() OVER (ORDER BY members) - 1)::INT AS cluster_id, len(members)::INT AS n, members[1] AS first FROM m")
def cluster_ids(spark, sf_dir):
    c = organize.cluster_ids(roles.vectors(spark, sf_dir), "image_id", "grp")
    return c.select("cluster_id", F.size("members").alias("n"), F.col("members")[0].alias("first"))


NAMING = PRELUDE + """
, sc AS (SELECT d.feature_id, max(list_dot_product(d.emb, v.emb) / (sqrt(list_dot_product(d.emb, d.emb)) * sqrt(list_dot_product(v.emb, v.emb)))) AS s FROM decoder d, vocab v WHERE d.seed = 0 GROUP BY 1),
nm AS (SELECT feature_id, feature_id % 9 = 0 AS is_dead, CASE WHEN feature_id % 9 = 0 THEN 0 ELSE s END AS score FROM sc)
"""


def _naming(spark, sf_dir):
    found = similarity.top_matches(roles.decoder(spark, sf_dir).where("seed = 0"), roles.vocab(spark, sf_dir), 1, left_id="feature_id", right_id="term_idx")
    dead = F.col("left_id") % 9 == 0
    return found.select(F.col("left_id").alias("feature_id"), dead.alias("is_dead"), F.when(dead, 0.0).otherwise(F.col("score")).alias("score"))


@query("naming_summary", NAMING + """SELECT count(*) AS n, count(*) FILTER (WHERE is_dead) AS n_dead, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(min(score), 6) AS least, round(max(score), 6) AS most,
 round(100.0 * avg((score < 0.5)::INT), 6) AS below_50, round(100.0 * avg((score < 0.4)::INT), 6) AS below_40 FROM nm""")
def naming_summary(spark, sf_dir):
    """Dead features count with their score of 0."""
    below = lambda t: R6(100.0 * F.avg((F.col("score") < t).cast("double")))
    return _naming(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(F.col("is_dead").cast("long")).alias("n_dead"), R6(F.avg("score")).alias("mean"), R6(F.median("score")).alias("median"), R6(F.min("score")).alias("least"), R6(F.max("score")).alias("most"), below(0.5).alias("below_50"), below(0.4).alias("below_40"))


@query("live_naming_summary", NAMING + "SELECT round(avg(score), 6) AS mean, round(quantile_disc(score, 0.5), 6) AS lower_median FROM nm WHERE NOT is_dead")
def live_naming_summary(spark, sf_dir):
    return _naming(spark, sf_dir).where("not is_dead").agg(R6(F.avg("score")).alias("mean"), R6(F.expr("percentile_disc(0.5) within group (order by score)")).alias("lower_median"))


@query("score_histogram", NAMING + "SELECT least(greatest(floor(score * 50), 0), 49)::INT AS bin, count(*) AS n FROM nm GROUP BY 1")
def score_histogram(spark, sf_dir):
    """The data of the score histogram: 50 bins from 0 to 1."""
    return _naming(spark, sf_dir).groupBy(F.least(F.greatest(F.floor(F.col("score") * 50), F.lit(0)), F.lit(49)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("figure_density", NAMING + """
, b AS (SELECT is_dead, least(greatest(floor(score * 20), 0), 19)::INT AS bin, count(*) AS n FROM nm GROUP BY 1, 2)
SELECT is_dead, bin, n, round(n * 20.0 / sum(n) OVER (PARTITION BY is_dead), 6) AS density FROM b""")
def figure_density(spark, sf_dir):
    """The data of the score densities of live and of dead features: 20 bins from 0 to 1, each curve of area 1."""
    return figures.density(_naming(spark, sf_dir), "score", 20, "is_dead").withColumn("density", R6("density"))


@query("figure_seed_bars", SLOT + """
, l AS (SELECT s AS seed, image_id, sum(n) AS n FROM n GROUP BY 1, 2), b AS (SELECT seed, avg(n) AS l0, stddev_pop(n) AS sd FROM l GROUP BY 1),
o AS (SELECT seed, avg(jac) AS overlap FROM (SELECT i AS seed, jac FROM m WHERE i < j UNION ALL SELECT j, jac FROM m WHERE i < j) GROUP BY 1)
SELECT seed, 'l0' AS measure, round(l0, 6) AS value, round(sd, 6) AS error FROM b UNION ALL SELECT seed, 'overlap', round(overlap, 6), NULL FROM o""")
def figure_seed_bars(spark, sf_dir):
    """The data of the bars by seed: active features an image with their deviation, and the mean slot overlap with the other seeds."""
    counts = roles.relabelled(roles.activations(spark, sf_dir), roles.seeds(spark)).groupBy("seed", "image_id").agg(F.count("*").alias("n"))
    l0 = counts.groupBy("seed").agg(F.avg("n").alias("value"), F.stddev_pop("n").alias("error"))
    pairs = _slots(spark, sf_dir).where("seed_i < seed_j")
    ends = pairs.select(F.explode(F.array("seed_i", "seed_j")).alias("seed"), "jaccard").groupBy("seed").agg(F.avg("jaccard").alias("value"))
    return figures.bars(l0=l0, overlap=ends).select("seed", "measure", R6("value").alias("value"), R6("error").alias("error"))


ABLATION = (4, 8, 16)


@query("ablation_compare", PRELUDE + """
, z AS (SELECT image_id, d - 1 AS feature_id, x AS activation, row_number() OVER (PARTITION BY image_id ORDER BY x DESC, d) AS r FROM vecx),
a AS (SELECT k, seed, z.* FROM z JOIN (SELECT vec_id AS image_id, vec_id % 5 AS seed FROM embeddings) USING (image_id), (VALUES (4), (8), (16)) p(k) WHERE r <= k AND activation > 0),
i AS (SELECT k, vec_id % 5 AS seed, vec_id AS image_id FROM embeddings, (VALUES (4), (8), (16)) p(k)),
l AS (SELECT i.k, i.seed, i.image_id, count(a.feature_id) AS n, coalesce(sum(a.activation ** 2), 0) AS kept FROM i LEFT JOIN a ON a.k = i.k AND a.image_id = i.image_id GROUP BY 1, 2, 3),
q AS (SELECT image_id, sum(x * x) AS whole FROM vecx GROUP BY 1),
runs AS (SELECT k, seed, avg(n) AS l0, avg((whole - kept) / 64) AS mse FROM l JOIN q USING (image_id) GROUP BY 1, 2),
dead AS (SELECT k, seed, 100.0 * (64 - count(DISTINCT feature_id)) / 64 AS dead FROM a GROUP BY 1, 2)
SELECT k, count(*) AS n_runs, round(avg(l0), 6) AS l0, round(avg(dead), 6) AS dead_pct, round(stddev_pop(dead), 6) AS dead_sd, round(avg(mse), 6) AS mse, round(avg(mse) / first(avg(mse)) OVER (ORDER BY k), 6) AS mse_over_first
FROM runs JOIN dead USING (k, seed) GROUP BY k""")
def ablation_compare(spark, sf_dir):
    """Means over runs of active features an image, dead share and reconstruction error by number of active features.

    A run is a fifth of the vectors; its decoder is the axes themselves, so what is not kept of a vector is its error."""
    vectors = roles.read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("seed"), F.col("vec_id").alias("image_id"), V.doubles("embedding").alias("emb"))
    runs = None
    for k in ABLATION:
        acts = sparse.top_coordinates(vectors, "image_id", "emb", k).join(vectors.select("image_id", "seed"), "image_id")
        run = sparse.run_metrics(acts, vectors, WIDTH).withColumn("k", F.lit(k))
        runs = run if runs is None else runs.unionByName(run)
    return sparse.compared(runs, "k").select("k", "n_runs", *[R6(c).alias(c) for c in ("l0", "dead_pct", "dead_sd", "mse", "mse_over_first")])


@query("universality_verdict", BEST + """
, n AS (SELECT count(*) AS n FROM decoder WHERE seed = 0), anc AS (SELECT sqrt(2 * ln(n)) / sqrt(64.0) AS anchor FROM n),
t AS (SELECT seed_i, seed_j, avg((c >= 0.9)::INT) AS frac_09, avg((c < anchor)::INT) AS p, avg(c) AS observed, max(anchor) AS null_mean FROM f, anc GROUP BY 1, 2)
SELECT seed_i, seed_j, round(frac_09, 6) AS frac_09, round(p, 6) AS p, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean,
       CASE WHEN frac_09 >= 0.1 THEN 'strong' WHEN p < 0.05 AND observed > 1.5 * null_mean THEN 'weak' ELSE 'null' END AS verdict FROM t""")
def universality_verdict(spark, sf_dir):
    """The rule's verdict on each pair of models, against the expected best cosine of as many random directions; p is here the share of
    features whose best match stays below that."""
    decoder = roles.decoder(spark, sf_dir)
    anchor = stability.random_anchor(decoder.where("seed = 0").count(), WIDTH)
    share = lambda c: F.avg(c.cast("double"))
    pairs = similarity.best_between(decoder).groupBy("seed_i", "seed_j").agg(share(F.col("score") >= 0.9).alias("frac_09"), share(F.col("score") < anchor).alias("p"), F.avg("score").alias("observed"))
    judged = pairs.withColumn("null_mean", F.lit(anchor)).withColumn("verdict", stability.universality_verdict(F.col("frac_09"), F.col("p"), F.col("observed"), F.col("null_mean")))
    return judged.select("seed_i", "seed_j", *[R6(c).alias(c) for c in ("frac_09", "p", "observed", "null_mean")], "verdict")
