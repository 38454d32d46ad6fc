"""Queries that SQL cannot express: decompositions, clustering, matching, null models, training; tests check them by brute force."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from prismet.functions.text import RETRY_SUFFIX
from prismet.functions.vectors import modality_gap
from prismet.operators import faithfulness, graph, organize, similarity, sparse, splice, stability, train
from prismet.operators.similarity import matrix
from prismet.plans import roles
from prismet.plans.catalog import query
from prismet.plans.config import Consensus, Faithfulness, Run
from prismet.plans.measure_queries import CORR
from prismet.plans.roles import PRELUDE
from prismet.streaming import judge_dedup, judging

R6 = lambda c: F.round(c, 6)


def _dictionary(spark, sf_dir):
    t = roles.vocab(spark, sf_dir).orderBy("term_idx").toArrow()
    return t.column("term").to_pylist(), matrix(t.column("emb").combine_chunks())


@query("splice_decompose")
def splice_decompose(spark, sf_dir):
    terms, rows = _dictionary(spark, sf_dir)
    images = roles.images(spark, sf_dir)
    gap = np.array(modality_gap(images, roles.vocab(spark, sf_dir)).first()["gap"])
    return splice.decompose(images, terms, rows, min(8, len(terms)), gap).withColumn("activation", R6("activation"))


@query("agglomerative_clusters")
def agglomerative_clusters(spark, sf_dir):
    return organize.agglomerative_clusters(roles.vocab(spark, sf_dir).select(F.col("term").alias("name"), "emb"))


@query("hungarian_match")
def hungarian_match(spark, sf_dir):
    return similarity.optimal_matches(roles.decoder(spark, sf_dir), 0.5)


@query("erank_per_seed")
def erank_per_seed(spark, sf_dir):
    return stability.effective_ranks(roles.decoder(spark, sf_dir))


def _nulls(spark, sf_dir, kind):
    return stability.null_summary(stability.null_draws(stability.live(roles.decoder(spark, sf_dir)), Run.n_perm, kind))


@query("null_isotropic")
def null_isotropic(spark, sf_dir):
    return _nulls(spark, sf_dir, "isotropic")


@query("null_subspace")
def null_subspace(spark, sf_dir):
    return _nulls(spark, sf_dir, "subspace")


@query("stability_summary")
def stability_summary(spark, sf_dir):
    return stability.stability_summary(_nulls(spark, sf_dir, "isotropic"))


@query("shuffle_null")
def shuffle_null(spark, sf_dir):
    """feature_id, observed, p95 of the shuffled maxima, significant."""
    acts, labels = roles.activations(spark, sf_dir), faithfulness.prevalent(roles.image_labels(spark, sf_dir), 10)
    images = roles.vectors(spark, sf_dir).select("image_id")
    null = faithfulness.percentile95(faithfulness.shuffle_null(acts, labels, images, Faithfulness.n_perm), "max_r", "feature_id")
    best = faithfulness.best_label(faithfulness.point_biserial(acts, labels, images.count()))
    return best.join(null, "feature_id").select("feature_id", R6("abs_r").alias("observed"), R6("p95").alias("p95"), (F.col("abs_r") > F.col("p95")).alias("significant"))


@query("normal_p_fdr", CORR + """
, strongest AS (SELECT feature_id, max(round(abs(r), 10)) AS a FROM r GROUP BY 1),
n AS (SELECT count(*) AS n FROM vecs), x AS (SELECT feature_id, least(a * sqrt(n / 2.0), 6.0) AS x FROM strongest, n),
p AS (SELECT feature_id, CASE WHEN x = 0 THEN 1.0 ELSE greatest(0.0, 1 - exp(-x * x) * list_sum([exp((2 * k + 1) * ln(x) - lgamma(k + 1.5)) for k in range(0, 140)])) END AS p FROM x),
k AS (SELECT *, row_number() OVER (ORDER BY p, feature_id) AS k, count(*) OVER () AS m FROM p)
SELECT feature_id, round(p, 6) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM k
""")
def normal_p_fdr(spark, sf_dir):
    """Two-sided normal p of the best correlations, and their q."""
    labels = faithfulness.prevalent(roles.image_labels(spark, sf_dir), 10)
    n = roles.vectors(spark, sf_dir).count()
    best = faithfulness.best_label(faithfulness.point_biserial(roles.activations(spark, sf_dir), labels, n))
    return faithfulness.bh_fdr(best.withColumn("p", faithfulness.normal_p(F.col("abs_r"), n)), "p", "feature_id").select("feature_id", R6("p").alias("p"), R6("q").alias("q"))


@query("seed_tag_null")
def seed_tag_null(spark, sf_dir):
    d = roles.decoder(spark, sf_dir)
    labelled = d.join(graph.connected_components(d.select("id"), similarity.threshold_edges(d, 0.5)), "id")
    return stability.seed_tag_null(labelled, 3, Consensus.n_perm)


@query("random_naming_baseline")
def random_naming_baseline(spark, sf_dir):
    """Mean best cosine of random directions with the vocabulary, through a fixed bridge and with the gap subtracted."""
    from prismet.plans.pipelines import random_naming

    terms = roles.vocab(spark, sf_dir)
    bridge = np.random.default_rng(3).normal(size=(roles.WIDTH, 32))
    gap = modality_gap(roles.images(spark, sf_dir), terms)
    return random_naming(spark, terms, 32, bridge, gap).select(R6("mean_best").alias("mean_best"), "n")


@query("train_topk_sae")
def train_topk_sae(spark, sf_dir):
    """Features of five models trained on the image vectors, with their decoder norms."""
    config = train.TrainConfig(dict_size=128, k=8, steps=120, batch=128, lr=5e-3)
    models = train.train(roles.images(spark, sf_dir).select("image_id", "emb"), [0, 42, 123, 456, 789], config)
    square = F.aggregate(F.transform("dec", lambda x: x * x), F.lit(0.0), lambda s, v: s + v)
    return models.select("seed", "feature_id", R6("enc_bias").alias("enc_bias"), R6(F.sqrt(square)).alias("dec_norm"))


@query("sae_encode", PRELUDE + """
, w AS (SELECT feature_id, [x / greatest(sqrt(list_dot_product(emb, emb)), 1e-12) for x in emb] AS u FROM decoder WHERE seed = 0),
z AS (SELECT image_id, feature_id, list_dot_product(emb, u) AS z FROM img, w)
SELECT image_id, feature_id, round(z, 6) AS activation FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY z DESC, feature_id) AS k FROM z) WHERE k <= 8 AND z > 0
""")
def sae_encode(spark, sf_dir):
    """Activations of a model whose encoder rows are those of seed 0's decoder."""
    w = stability.decoders(roles.decoder(spark, sf_dir).where("seed = 0"))[0]
    return sparse.encode(roles.images(spark, sf_dir), w, np.zeros(len(w)), np.zeros(w.shape[1]), 8).withColumn("activation", R6("activation"))


RESPONSES = ("fine | Verdict: Aligned", "Supports", "hm", "no | Verdict: Unaligned.")
PROMPT = "Report: {report} Claim: {pseudo_report}"


@query("judge_run", f"""
WITH p AS (SELECT doc_id::VARCHAR AS image_id, 'Findings suggest: ' || substr(coalesce(text, '?'), 1, 40) AS pseudo_report, coalesce(text, '') AS report FROM documents WHERE trim(coalesce(text, '')) <> ''),
q AS (SELECT image_id, pseudo_report, length('Report: ' || report || ' Claim: ' || pseudo_report) % 4 AS k FROM p),
r AS (SELECT image_id, pseudo_report, CASE k WHEN 2 THEN (k + {len(RETRY_SUFFIX)}) % 4 ELSE k END AS k FROM q)
SELECT image_id, pseudo_report, ['Aligned', 'Aligned', 'Uncertain', 'Unaligned'][k + 1] AS verdict, [{", ".join(f"'{r}'" for r in RESPONSES)}][k + 1] AS raw_response FROM r
""")
def judge_run(spark, sf_dir):
    """The judge's run, a streaming query with a ledger, over the texts of all documents with a deterministic model."""
    docs = roles.read(spark, sf_dir, "documents")
    pairs = docs.select(F.col("doc_id").cast("string").alias("image_id"), F.coalesce("text", F.lit("")).alias("report"), F.concat(F.lit("Findings suggest: "), F.substring(F.coalesce("text", F.lit("?")), 1, 40)).alias("pseudo_report")).where(F.trim("report") != "")

    def model(prompt: str) -> str:
        return RESPONSES[len(prompt) % 4]

    folder = f"{graph.shared(spark)}/judge-{uuid.uuid4().hex}"
    known = judging.ledger(spark, f"{folder}/ledger")
    judging.write_open(pairs, known, f"{folder}/open", 500)
    judging.run(spark, f"{folder}/open", f"{folder}/ledger", PROMPT, model)
    return judging.ledger(spark, f"{folder}/ledger")


@query("judge_stream_dedup")
def judge_stream_dedup(spark, sf_dir):
    """An extension: the resume rule over a stream of records."""
    return judge_dedup.run_once(spark, f"{sf_dir}/events.parquet")
