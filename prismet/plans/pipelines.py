"""The analyses end to end: each composes operators, writes its tables below one folder and returns them by name.

Stages are written as Parquet (results for readers as JSON besides), so each is computed once and a lost executor
costs one stage. `stages` of a result lists what ran and for how long."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismet.functions.vectors import entries, modality_gap, with_gap
from prismet.operators import explain, faithfulness, graph, judge, ontology, organize, sampling, similarity, sparse, splice, stability, train, vocab
from prismet.operators.stability import chance_floor
from prismet.plans import config
from prismet.sources import sinks
from prismet.streaming import judging


class Stages:
    """Tables of a run by name, each written when it is added."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark, self.out, self.times, self.tables = spark, out.rstrip("/"), [], {}

    def add(self, name: str, make: Callable[[], DataFrame], json: bool = False) -> DataFrame:
        start = time.time()
        df = make()
        df.write.mode("overwrite").parquet(f"{self.out}/{name}")
        kept = self.spark.read.parquet(f"{self.out}/{name}")
        if json:
            sinks.write_json(kept, f"{self.out}/{name}.json")
        self.times.append((name, round(time.time() - start, 3)))
        self.tables[name] = kept
        return kept

    def report(self) -> str:
        """Stage times as a Markdown table."""
        return sinks.markdown(["stage", "seconds"], self.times)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def bridge(decoder: DataFrame, projection: np.ndarray) -> DataFrame:
    """Decoder rows through a fixed linear map (rows of `projection` are output dimensions)."""
    import pyarrow as pa

    shipped = decoder.sparkSession.sparkContext.broadcast(np.asarray(projection, float))
    names = [c for c in decoder.columns if c != "emb"]

    def task(batches):
        for batch in batches:
            x = similarity.matrix(batch.column("emb"))
            p = shipped.value
            if x.size and x.shape[1] != p.shape[1]:
                raise ValueError(f"rows of {x.shape[1]} dimensions, projection of {p.shape[1]}")
            y = x @ p.T if x.size else np.zeros((0, p.shape[0]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(list(y), pa.list_(pa.float64()))], names=[*names, "emb"])

    rows = decoder.select(*names, F.col("emb").cast("array<double>").alias("emb"))
    return rows.mapInArrow(task, rows.schema)


def join_by_position(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Tables aligned by a row number written at ingest; different lengths are an error."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows and {b} rows do not align")
    return left.join(right, key)


def model_parts(models: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Encoder, bias and offset (b_dec) of one seed's model."""
    rows = models.where(F.col("seed") == seed).orderBy("feature_id").select("enc", "enc_bias", "b_dec").collect()
    return np.array([r["enc"] for r in rows]), np.array([r["enc_bias"] for r in rows]), np.array(rows[0]["b_dec"])


def name_features(decoder: DataFrame, terms: DataFrame, gap: DataFrame | None, fired: DataFrame, n: int = 3) -> DataFrame:
    """feature_id, name, score, candidates, is_dead; a feature that never fires is DEAD_FEATURE with score 0."""
    shifted = decoder if gap is None else with_gap(decoder, gap)
    named = similarity.named_candidates(similarity.top_matches(shifted, terms, n, left_id="feature_id", right_id="term_idx"), terms).withColumnRenamed("left_id", "feature_id")
    alive = fired.select("feature_id").distinct().withColumn("alive", F.lit(True))
    joined = named.join(alive, "feature_id", "left").withColumn("is_dead", F.col("alive").isNull()).drop("alive")
    return joined.withColumn("name", F.when(F.col("is_dead"), "DEAD_FEATURE").otherwise(F.col("name"))).withColumn("score", F.when(F.col("is_dead"), 0.0).otherwise(F.col("score")))


def baseline(spark: SparkSession, images: DataFrame, terms: DataFrame, out: str, run: config.Run | None = None, group: str = "grp", projection: np.ndarray | None = None, gap: DataFrame | None = None, models: DataFrame | None = None) -> Stages:
    """Split, train every seed (or take `models`), name, measure stability, explain. images: image_id, group, emb; terms: term_idx, term, emb.

    With a projection the decoder is mapped into the vocabulary's space before naming (the hidden-state form), and
    `gap` (one row, in that space) is subtracted after it; without one, the images' own gap is taken where the spaces agree."""
    given = gap
    run = run or config.Run()
    s = Stages(spark, out)
    split = s.add("split", lambda: sampling.group_split(images, group, run.ratio, run.split_seed))
    if sampling.leaked_groups(split, group).limit(1).count():
        raise ValueError("a group is on both sides of the split")
    training, test = split.where("split = 'train'"), split.where("split = 'test'")
    trained = models
    models = s.add("models", lambda: train.train(training.select("image_id", "emb"), list(run.seeds), run.train) if trained is None else trained)
    acts = None
    for seed in run.seeds:
        w, b, o = model_parts(models, seed)
        one = sparse.encode(test, w, b, o, run.train.k).withColumn("seed", F.lit(seed).cast("long"))
        acts = one if acts is None else acts.unionByName(one)
    acts = s.add("activations", lambda: acts)
    w, b, o = model_parts(models, run.first)
    fired = s.add("fired", lambda: sparse.feature_counts(sparse.encode(training, w, b, o, run.train.k)))
    decoder = models.select("seed", "feature_id", F.col("dec").alias("emb"))
    first = decoder.where(F.col("seed") == run.first)
    space = first if projection is None else bridge(first, projection)
    if given is not None:
        gap = s.add("gap", lambda: given)
    else:
        gap = None if projection is not None else s.add("gap", lambda: modality_gap(training, terms))
    names = add_names(s, space, terms, gap, fired, run.naming.names)
    own = acts.where(F.col("seed") == run.first)
    n_seeds = spark.createDataFrame([(x,) for x in run.seeds], "seed long")
    rebuilt = lambda: sparse.reconstruction(entries(test, "emb", "image_id"), sparse.decode(own, first.select("feature_id", "emb"), o, test))
    s.add("reconstruction", rebuilt, json=True)
    s.add("random_naming", lambda: random_naming(spark, terms, len(first.first()["emb"]), projection, gap), json=True)
    s.add("sparsity", lambda: sparse.sparsity(own, test, run.train.dict_size), json=True)
    s.add("coactivation", lambda: sparse.coactivation_summary(own), json=True)
    add_stability(s, acts, test, n_seeds, decoder, run.n_perm)
    s.add("explanations", lambda: explain.explain(own, names, test, run.naming.concepts), json=True)
    return s


def add_names(s: Stages, space: DataFrame, terms: DataFrame, gap: DataFrame | None, fired: DataFrame, n: int) -> DataFrame:
    """The naming stage: names and their summary. space: feature_id, emb of the rows to name."""
    names = s.add("names", lambda: name_features(space.select("feature_id", "emb"), terms, gap, fired, n), json=True)
    s.add("naming_summary", lambda: naming_summary(names), json=True)
    return names


def add_stability(s: Stages, acts: DataFrame, test: DataFrame, seeds: DataFrame, decoder: DataFrame, n_perm: int) -> None:
    """The stability stage: slot overlaps, matches of all pairs of models, and both nulls."""
    s.add("slot_jaccard", lambda: sparse.slot_jaccard(acts, test, seeds), json=True)
    alive = stability.live(decoder)
    s.add("matched", lambda: stability.matched_table(alive), json=True)
    for kind in ("isotropic", "subspace"):
        s.add(f"null_{kind}", lambda kind=kind: stability.null_summary(stability.null_draws(alive, n_perm, kind)), json=True)


def one_stage(spark: SparkSession, which: str, run: str, out: str, terms: DataFrame | None = None, seed: int = 42, names: int = 3, concepts: int = 5, n_perm: int = 200) -> Stages:
    """A stage of a baseline run alone (names, stability or explanations), from the tables that the run's folder holds."""
    s = Stages(spark, out)
    table = lambda name: existing(spark, f"{run}/{name}")
    if which == "explanations":
        test = table("split").where("split = 'test'")
        s.add("explanations", lambda: explain.explain(table("activations").where(F.col("seed") == seed), table("names"), test, concepts), json=True)
        return s
    decoder = table("models").select("seed", "feature_id", F.col("dec").alias("emb"))
    if which == "names":
        first = decoder.where(F.col("seed") == seed)
        if not first.limit(1).count():
            raise ValueError(f"no model of seed {seed} in {run}")
        add_names(s, first, terms, where_there(spark, f"{run}/gap"), table("fired"), names)
    elif which == "stability":
        add_stability(s, table("activations"), table("split").where("split = 'test'"), decoder.select("seed").distinct(), decoder, n_perm)
    else:
        raise ValueError(f"no stage {which!r}; there are names, stability and explanations")
    return s


def random_naming(spark: SparkSession, terms: DataFrame, dim: int, projection: np.ndarray | None = None, gap: DataFrame | None = None, n: int = 1000, seed: int = 7) -> DataFrame:
    """One row: mean and deviation of the best cosine of n random unit directions with the vocabulary.

    The directions go the way of decoder rows: through the bridge where there is one, then the gap is subtracted."""
    draws = similarity.unit(np.random.default_rng(seed).normal(size=(n, dim)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draws)], "id long, emb array<double>")
    rows = rows if projection is None else bridge(rows, projection)
    rows = rows if gap is None else with_gap(rows, gap)
    best = similarity.top_matches(rows, terms, 1, right_id="term_idx")
    return best.agg(F.avg("score").alias("mean_best"), F.stddev_pop("score").alias("sd"), F.count("*").alias("n"))


def naming_summary(names: DataFrame) -> DataFrame:
    """Over all features (dead ones with 0) and, apart, over live ones (lower median)."""
    live = F.when(~F.col("is_dead"), F.col("score"))
    lower = F.expr("percentile_disc(0.5) within group (order by case when not is_dead then score end)")
    return names.agg(F.count("*").alias("n"), F.sum(F.col("is_dead").cast("long")).alias("n_dead"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.max("score").alias("most"), F.avg(live).alias("live_mean"), lower.alias("live_lower_median"))


def spliced(spark: SparkSession, images: DataFrame, terms: DataFrame, out: str, settings: config.Splice | None = None, analyze: bool = True) -> Stages:
    """Decompose images over the vocabulary; explanations and, if wanted, the vocabulary's coverage."""
    settings = settings or config.Splice()
    s = Stages(spark, out)
    t = terms.orderBy("term_idx").select("term", F.col("emb").cast("array<double>").alias("emb")).toArrow()
    gap = np.array(modality_gap(images, terms).first()["gap"]) if settings.gap_correction else None
    coefficients = s.add("coefficients", lambda: splice.decompose(images, t.column("term").to_pylist(), similarity.matrix(t.column("emb").combine_chunks()), settings.k, gap))
    s.add("explanations", lambda: explain.splice_explanations(coefficients, images), json=True)
    if analyze:
        s.add("coverage", lambda: vocab.coverage(coefficients, terms), json=True)
        s.add("most_common", lambda: vocab.most_common(coefficients), json=True)
        s.add("unused", lambda: vocab.unused(coefficients, terms), json=True)
    return s


def organized(spark: SparkSession, explanations: DataFrame, terms: DataFrame, out: str, settings: config.Organize | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Stages:
    """Cluster the concepts in use, annotate the clusters (if an ontology is given), regroup explanations into families."""
    settings = settings or config.Organize()
    s = Stages(spark, out)
    concepts = explanations.select("image_id", F.explode("top_k_concepts").alias("c")).select("image_id", F.col("c.name").alias("name"), F.col("c.activation").alias("activation"))
    active = s.add("image_concepts", lambda: concepts.where("activation > 0").join(terms.select(F.col("term").alias("name")).distinct(), "name", "left_semi").groupBy("image_id", "name").agg(F.max("activation").alias("activation")))
    used = terms.select(F.col("term").alias("name"), "emb").join(active.select("name").distinct(), "name", "left_semi")
    assigned = s.add("assigned", lambda: organize.agglomerative_clusters(used, n_clusters=settings.n_clusters, distance=settings.distance, linkage=settings.linkage))
    clusters = s.add("members", lambda: organize.cluster_ids(assigned).select("cluster_id", F.explode("members").alias("name")))
    centres = organize.medoids(clusters.join(used, "name")).select("cluster_id", "medoid")
    if nodes is not None:
        notes = ontology.annotate(clusters, nodes, edges)
    else:
        notes = clusters.groupBy("cluster_id").agg(F.lit(None).cast("string").alias("rid"), F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("n_resolved"), F.count("*").alias("n_members"))
    annotated = s.add("clusters", lambda: notes.join(centres, "cluster_id", "left").withColumn("display_label", ontology.display_label(F.col("label"), F.col("medoid"))), json=True)
    fams = s.add("families", lambda: organize.families(active, clusters).join(annotated.select("cluster_id", "display_label"), "cluster_id"))
    per_image = s.add("structured", lambda: organize.redundancy(active, fams, explanations), json=True)
    width = organize.silhouette(clusters.join(used, "name")).agg(F.avg("s").alias("silhouette")) if annotated.count() > 1 else spark.createDataFrame([(None,)], "silhouette double")
    s.add("metrics", lambda: organize.cluster_metrics(annotated).crossJoin(organize.redundancy_metrics(per_image)).crossJoin(width), json=True)
    if nodes is not None:
        s.add("unresolved", lambda: ontology.resolve(clusters.select("name"), nodes).where("rid is null").select("name"), json=True)
    return s


def faithful(spark: SparkSession, activations: DataFrame, image_labels: DataFrame, images: DataFrame, out: str, settings: config.Faithfulness | None = None) -> Stages:
    """Correlate features with labels: analytic q, shuffle null, shares and the best features."""
    settings = settings or config.Faithfulness()
    s = Stages(spark, out)
    ids = images.select("image_id").distinct()
    n_images = ids.count()
    labels = s.add("labels", lambda: faithfulness.prevalent(image_labels, settings.min_prevalence))
    best = s.add("best", lambda: faithfulness.best_label(faithfulness.point_biserial(activations, labels, n_images)))
    q = s.add("q", lambda: faithfulness.bh_fdr(best.withColumn("p", faithfulness.normal_p(F.col("abs_r"), n_images)), "p", "feature_id"))
    null = s.add("null", lambda: faithfulness.percentile95(faithfulness.shuffle_null(activations, labels, ids, settings.n_perm, settings.seed), "max_r", "feature_id"))
    share = lambda c: F.avg(c.cast("double"))
    s.add("summary", lambda: q.join(null, "feature_id").agg(F.count("*").alias("n_live"), share(F.col("abs_r") > F.col("p95")).alias("frac_shuffle"), share(F.col("q") < settings.fdr).alias("frac_fdr"), share(F.col("abs_r") > settings.strong).alias("frac_strong"), F.avg("abs_r").alias("mean_abs_r")), json=True)
    s.add("top", lambda: faithfulness.top_faithful(best), json=True)
    return s


def consensus(spark: SparkSession, decoder: DataFrame, out: str, settings: config.Consensus | None = None) -> Stages:
    """Components of the pooled features over seeds at a threshold and over the grid; null and optimal matches. decoder: id, seed, feature_id, emb."""
    settings = settings or config.Consensus()
    s = Stages(spark, out)
    alive = stability.live(decoder)
    labelled = s.add("labelled", lambda: alive.join(graph.connected_components(alive.select("id"), similarity.threshold_edges(alive, settings.tau)), "id"))
    s.add("components", lambda: stability.component_stats(labelled).crossJoin(stability.cohesion(labelled)).crossJoin(stability.consensus_share(labelled, settings.m)), json=True)
    s.add("seed_counts", lambda: stability.seed_count_histogram(labelled), json=True)
    grid = None
    for tau in settings.grid:
        at = alive.join(graph.connected_components(alive.select("id"), similarity.threshold_edges(alive, tau)), "id")
        row = stability.component_stats(at).crossJoin(stability.consensus_share(at, settings.m)).withColumn("tau", F.lit(tau))
        grid = row if grid is None else grid.unionByName(row)
    s.add("grid", lambda: grid, json=True)
    null = s.add("null", lambda: stability.seed_tag_null(labelled, settings.m, settings.n_perm, settings.seed))
    observed = F.max(F.when(F.col("perm") < 0, F.col("share")))
    draws = F.when(F.col("perm") >= 0, F.col("share"))
    seen = null.agg(observed.alias("observed"), F.avg(draws).alias("null_mean"))
    p = null.where("perm >= 0").crossJoin(F.broadcast(seen)).agg(F.avg((F.col("share") >= F.col("observed")).cast("double")).alias("p"))
    s.add("verdict", lambda: seen.crossJoin(p).withColumn("gap", F.col("observed") - F.col("null_mean")).withColumn("above_null", (F.col("gap") > 0) & (F.col("p") < 0.05)), json=True)
    s.add("optimal", lambda: similarity.optimal_matches(alive, settings.tau), json=True)
    return s


def judged(spark: SparkSession, explanations: DataFrame, reports: DataFrame, model: Callable[[str], str], template: str, out: str, records: DataFrame | None = None) -> Stages:
    """Judge explanations against reports, resuming from earlier records; scores over all records."""
    s = Stages(spark, out)
    known = records if records is not None else spark.createDataFrame([], "image_id string, pseudo_report string, verdict string, raw_response string")
    pairs = judge.with_reports(explanations.withColumn("image_id", F.col("image_id").cast("string")), reports.withColumn("image_id", F.col("image_id").cast("string")))
    open_ = judge.pending(pairs.select("image_id", "pseudo_report", "report"), known, ["image_id", "pseudo_report"], "report")
    fresh = s.add("fresh", lambda: judge.ask(open_, template, model))
    everything = s.add("records", lambda: known.unionByName(fresh))
    s.add("scores", lambda: judge.scores(everything), json=True)
    sinks.write_verdicts(everything, f"{s.out}/verdicts.csv")
    return s


def existing(spark: SparkSession, path: str) -> DataFrame:
    """The table at a path; a missing one is an error that names the path."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no table at {path}; make it first") from e


def where_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None."""
    try:
        return existing(spark, path)
    except FileNotFoundError:
        return None


def run_report(spark: SparkSession, s: Stages, title: str, settings: Sequence[tuple[str, object]], inputs: dict[str, DataFrame]) -> str:
    """REPORT_run in the run's folder: settings, stages with status and seconds, means over seeds, and what makes the run reproducible."""
    digests = [(name, *sinks.merkle(df).first()) for name, df in inputs.items()]
    means = []
    for name in ("slot_jaccard", "matched", "null_isotropic", "null_subspace"):
        if name in s.tables:
            pairs = s[name] if "seed_i" not in s[name].columns else s[name].where("seed_i < seed_j")
            numbers = [c for c, kind in pairs.dtypes if kind == "double"]
            row = pairs.agg(*[F.avg(c).alias(c) for c in numbers]).first()
            means += [(name, c, "-" if row[c] is None else f"{row[c]:.4f}") for c in numbers]
    sections = [
        ("Run config", sinks.markdown(["param", "value"], settings)),
        ("Stages", sinks.markdown(["stage", "status", "seconds"], [(n, "done", f"{t:.1f}") for n, t in s.times])),
        ("Means over pairs of seeds", sinks.markdown(["table", "measure", "mean"], means) if means else ""),
        ("Reproducibility", sinks.markdown(["input", "digest", "rows"], digests) + f"\n\ncommit: {sinks.commit() or 'none'}"),
    ]
    return sinks.write_report(spark, f"{s.out}/REPORT_run", title, f"{len(s.times)} stages in {sum(t for _, t in s.times):.0f} s.", sections)


def failures(spark: SparkSession, out: str, names: DataFrame | None = None, records: DataFrame | None = None, slots: DataFrame | None = None, dict_size: int | None = None, k: int | None = None) -> Stages:
    """What goes wrong: weakly named features, slot overlap against its chance floor, verdicts by model. names: as named by a run; records:
    model, verdict, raw_response; slots: seed_i, seed_j, jaccard. A section whose input is missing is left out, and the report says so."""
    s = Stages(spark, out)
    below = lambda t: 100.0 * F.avg((F.col("score") < t).cast("double"))
    sections = []
    if names is not None:
        s.add("naming", lambda: names.agg(F.count("*").alias("n"), F.sum(F.col("is_dead").cast("long")).alias("n_dead"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.max("score").alias("most"), below(0.5).alias("below_50"), below(0.4).alias("below_40")), json=True)
        s.add("weakest", lambda: names.where("not is_dead").orderBy("score", "feature_id").limit(15).select("feature_id", "name", "score"), json=True)
        s.add("strongest", lambda: names.where("not is_dead").orderBy(F.desc("score"), "feature_id").limit(15).select("feature_id", "name", "score"), json=True)
        sections.append(("Naming", "\n\n".join(sinks.report(s[t]) for t in ("naming", "strongest", "weakest"))))
    else:
        sections.append(("Naming", "_skipped: no names; run the naming stage first_"))
    if slots is not None and dict_size and k:
        floor = chance_floor(k, dict_size)
        s.add("stability", lambda: slots.where("seed_i < seed_j").agg(F.avg("jaccard").alias("slot_mean")).select("slot_mean", F.lit(floor).alias("chance_floor"), (F.col("slot_mean") / floor).alias("ratio")), json=True)
        sections.append(("Stability", sinks.report(s["stability"])))
    else:
        sections.append(("Stability", "_skipped: no slot overlaps; run the stability stage first_"))
    if records is not None:
        s.add("verdicts", lambda: judge.scores(records, "model"), json=True)
        sections.append(("Judge disagreement", sinks.report(s["verdicts"].orderBy("model"))))
    else:
        sections.append(("Judge disagreement", "_skipped: no records; run the judge first_"))
    done = sum("skipped" not in body for _, body in sections)
    sinks.write_report(spark, f"{s.out}/REPORT", "Failure cases", f"{done} of {len(sections)} sections have their input.", sections)
    return s


def failures_of_run(spark: SparkSession, run: str, judged: dict[str, str], out: str, dict_size: int, k: int) -> Stages:
    """failures() from a run's own folder, and the judge folders of its models by name."""
    records = None
    for model, path in judged.items():
        own = where_there(spark, f"{path}/records")
        if own is not None:
            own = own.select(F.lit(model).alias("model"), "verdict", "raw_response")
            records = own if records is None else records.unionByName(own)
    return failures(spark, out, where_there(spark, f"{run}/names"), records, where_there(spark, f"{run}/slot_jaccard"), dict_size, k)


def ablation(spark: SparkSession, images: DataFrame, terms: DataFrame, out: str, run: config.Run | None = None, presets=config.ABLATION) -> DataFrame:
    """The baseline at several widths: dict_size, k, means over seeds of dead share, L0 and reconstruction, mean live naming score, and
    matches over the isotropic null; REPORT_ablation beside the runs."""
    run, rows = run or config.Run(), None
    for width, k in presets:
        s = baseline(spark, images, terms, f"{out}/{width}_{k}", replace(run, train=replace(run.train, dict_size=width, k=k)))
        test = s["split"].where("split = 'test'")
        row = over_seeds(s, test, width).crossJoin(s["naming_summary"].select(F.col("live_mean").alias("naming_mean"))).crossJoin(stability.stability_summary(s["null_isotropic"]).select(F.col("observed").alias("match_cos"), F.col("null_mean").alias("null_cos"), F.col("ratio").alias("match_over_null")))
        row = row.withColumn("dict_size", F.lit(width)).withColumn("k", F.lit(k))
        rows = row if rows is None else rows.unionByName(row)
    done = Stages(spark, out)
    table = done.add("comparison", lambda: rows.select("dict_size", "k", "dead_pct", "recon_cosine", "l0", "naming_mean", "match_cos", "null_cos", "match_over_null"), json=True)
    notes = "- dead share, reconstruction and L0: means over seeds on the test set\n- naming: mean top-1 cosine of live features\n- match over null: best-match cosine over that of random directions"
    sections = [("Presets", sinks.markdown(["dict_size", "k"], presets)), ("Results", sinks.report(table.orderBy("dict_size", "k"))), ("Notes", notes)]
    sinks.write_report(spark, f"{done.out}/REPORT_ablation", "Width and sparsity", f"{len(presets)} presets, seeds {', '.join(map(str, run.seeds))}.", sections)
    return table


def over_seeds(s: Stages, test: DataFrame, width: int) -> DataFrame:
    """One row: means over a run's seeds of dead_pct, l0 and recon_cosine on the test set."""
    acts, rows = s["activations"], None
    for seed in sorted(r["seed"] for r in s["models"].select("seed").distinct().collect()):  # models, not data
        own, decoder = acts.where(F.col("seed") == seed), s["models"].where(F.col("seed") == seed)
        offset = np.array(decoder.first()["b_dec"])
        rebuilt = sparse.reconstruction(entries(test, "emb", "image_id"), sparse.decode(own, decoder.select("feature_id", F.col("dec").alias("emb")), offset, test))
        row = sparse.sparsity(own, test, width).select("dead_pct", F.col("l0_mean").alias("l0")).crossJoin(rebuilt.select(F.col("cosine").alias("recon_cosine")))
        rows = row if rows is None else rows.unionByName(row)
    return rows.agg(*[F.avg(c).alias(c) for c in ("dead_pct", "l0", "recon_cosine")])


def vocabulary(spark: SparkSession, terms: DataFrame, images: DataFrame, out: str, settings: config.Vocabulary | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, sites: DataFrame | None = None, domain: config.Domain | None = None) -> Stages:
    """Build a vocabulary: terms (term, emb) that the ontology's domain filter leaves, ranked by the nearest centroid of the
    images' labels (images: label, emb), the best top_k and the injected seeds.

    Without an ontology (descriptor records are filtered by their tree numbers before) all terms are ranked."""
    settings, domain = settings or config.Vocabulary(), domain or config.Domain()
    s = Stages(spark, out)
    numbered = terms.groupBy("term").agg(F.first("emb").alias("emb"))
    numbered = s.add("terms", lambda: graph.ranked(numbered, 1 + numbered.count() // 100_000, F.col("term")).select((F.col("__r") - 1).alias("term_idx"), "term", "emb"))
    if nodes is not None:
        labels = ontology.preferred_labels(nodes)
        inside = ontology.domain_filter(nodes, edges, sites, list(domain.targets), list(domain.findings), list(domain.devices), list(domain.keywords))
        kept = s.add("kept", lambda: ontology.keep_terms(numbered.select(F.col("term_idx").alias("pos"), "term"), labels.select("rid", "label"), inside.select("rid")))
        numbered = numbered.join(kept.select("term"), "term", "left_semi")
    centres = s.add("centroids", lambda: graph.ranked(vocab.centroids(images, "label"), 1, F.col("label")).select((F.col("__r") - 1).alias("centre"), "label", "emb"))
    scored = s.add("scored", lambda: vocab.rank_terms(numbered, centres, "centre").join(numbered.select("term_idx", "term"), "term_idx"))
    seeds = spark.createDataFrame([(x,) for x in settings.seeds], "term string")
    s.add("vocabulary", lambda: vocab.build(scored, settings.top_k, seeds), json=True)
    return s


def descriptor_vocabulary(spark: SparkSession, records: DataFrame, terms: DataFrame, images: DataFrame, out: str, branches: Sequence[str] = ("A", "C", "E"), top_k: int = 1024) -> Stages:
    """vocabulary() over the names of descriptor records (pos, name, trees) in the given branches; no seeds are added.

    terms: term, emb of the names, in any case; no record in the branches is an error."""
    inside = ontology.branch_filter(records, list(branches)).select(F.col("name").alias("term"))
    if not inside.limit(1).count():
        raise ValueError(f"no descriptors in the branches {', '.join(branches)}")
    vectors = terms.groupBy(F.lower("term").alias("key")).agg(F.first("emb").alias("emb"))
    s = vocabulary(spark, inside.join(vectors, F.lower("term") == F.col("key")).select("term", "emb"), images, out, config.Vocabulary(top_k, ()))
    s.add("entries", lambda: s["vocabulary"].select("term", F.round("score", 6).alias("similarity_score"), F.lit("mesh").alias("source"), "place"), json=True)
    return s


def nulls(spark: SparkSession, images: DataFrame, terms: DataFrame, out: str, k: int | None = None, counts: DataFrame | None = None, seed: int = 42, default: int = 32) -> Stages:
    """Explanations of randomly drawn terms: k each, or as many as `counts` (explanations of a decomposition) has for the image."""
    s = Stages(spark, out)
    if k is None and counts is None:
        raise ValueError("give a number of concepts, or explanations whose numbers count")
    n = images.select("image_id").distinct()
    n = n.withColumn("n", F.lit(k)) if k is not None else n.join(counts.select("image_id", F.size("top_k_concepts").alias("n")), "image_id", "left")
    s.add("explanations", lambda: explain.null_explanations(n, terms, seed, default), json=True)
    return s


def judged_in_parts(spark: SparkSession, explanations: DataFrame, reports: DataFrame, model: Callable[[str], str], template: str, out: str, every: int = 50, resume: bool = False) -> Stages:
    """judged() as one streaming query over files of `every` pairs, whose records go to a ledger: an interrupted run goes on from it."""
    s = Stages(spark, out)
    path = f"{s.out}/judged"
    pairs = judge.with_reports(explanations.withColumn("image_id", F.col("image_id").cast("string")), reports.withColumn("image_id", F.col("image_id").cast("string")))
    if not resume:
        judging.begin(spark, path)
    judging.write_open(pairs, judging.ledger(spark, path), f"{s.out}/open", every)
    start = time.time()
    judging.run(spark, f"{s.out}/open", path, template, model)
    s.times.append(("judged", round(time.time() - start, 3)))
    everything = judging.ledger(spark, path)
    failed = F.startswith(F.coalesce("raw_response", F.lit("")), F.lit("ERROR:"))
    latest = everything.withColumn("failed", failed).withColumn("__r", F.row_number().over(Window.partitionBy("image_id", "pseudo_report").orderBy("failed", "raw_response"))).where("__r = 1").drop("__r", "failed")
    s.add("records", lambda: latest)
    s.add("scores", lambda: judge.scores(s["records"]), json=True)
    sinks.write_verdicts(s["records"], f"{s.out}/verdicts.csv")
    return s
