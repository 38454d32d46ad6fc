"""Command line: python -m prismet ANALYSIS --images PATH ... --out PATH (tables are Parquet)."""

from __future__ import annotations

import argparse
import importlib
import os
from dataclasses import replace
from functools import partial

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from prismet.functions import pictures
from prismet.operators import graph, sampling, train
from prismet.operators.train import TrainConfig
from prismet.plans import config, pipelines
from prismet.sources import images, models, ontologies, registry, reports, sinks, snapshot


#: Folders of the methods whose explanations can be organised.
SOURCES = {"splice": "splice", "baseline": "baseline", "hidden": "hidden"}


def _training(a: argparse.ArgumentParser) -> None:
    a.add_argument("--seeds", default=",".join(map(str, config.SEEDS)))
    a.add_argument("--dict-size", type=int, default=2048)
    a.add_argument("--k", type=int, default=32)
    a.add_argument("--steps", type=int, default=8000)
    a.add_argument("--batch-size", type=int, default=256)
    a.add_argument("--lr", default="auto")


def _function(name: str):
    """module:function."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prismet")
    sub = p.add_subparsers(dest="analysis", required=True)
    add = lambda name: sub.add_parser(name)
    for name in ("baseline", "path-a", "ablation"):
        a = add(name)
        a.add_argument("--images", required=True)
        a.add_argument("--terms", required=True)
        _training(a)
        a.add_argument("--n-perm", type=int, default=200)
        if name in ("baseline", "path-a"):
            a.add_argument("--dataset", default="iu_xray")
            a.add_argument("--variant", choices=("standard", "augmented"), default="standard")
            a.add_argument("--tag", default="")
            a.add_argument("--models", help="trained models to reuse instead of training")
        if name == "path-a":
            a.add_argument("--projection", required=True, help="matrix of the bridge (.npy, rows are output dimensions)")
            a.add_argument("--gap", help="table of one row with the gap in the vocabulary's space")
            a.add_argument("--folder", help="image files to encode into --images before the run")
            a.add_argument("--encoder", help="module:function from a list of file contents to rows of hidden states")
            a.add_argument("--skip-extract", action="store_true", help="reuse the table at --images")
    a = add("stage")
    a.add_argument("which", choices=("names", "stability", "explanations"), help="the stage of a baseline run to do again, alone")
    a.add_argument("--run", required=True, help="folder of the run")
    a.add_argument("--terms", help="table of term_idx, term, emb, for names")
    a.add_argument("--seed", type=int, default=42)
    a.add_argument("--names", type=int, default=3)
    a.add_argument("--concepts", type=int, default=5)
    a.add_argument("--n-perm", type=int, default=200)
    a = add("train")
    a.add_argument("--images", required=True)
    _training(a)
    a = add("extract")
    a.add_argument("--folder", required=True)
    a.add_argument("--dataset", default="iu_xray")
    a.add_argument("--encoder", required=True, help="module:function from a list of file contents to rows")
    a.add_argument("--text-encoder", help="module:function from a list of texts to rows")
    a.add_argument("--batch-size", type=int, default=64)
    a.add_argument("--augmentation", type=int, default=0, help="views an image besides the original")
    a.add_argument("--skip-text", action="store_true")
    a.add_argument("--short-edge", type=int, default=pictures.SHORT_EDGE, help="pixels to which short edges are reduced first; 0 leaves pictures as they are")
    a = add("vocabulary")
    a.add_argument("--terms", required=True, help="table of term, emb")
    a.add_argument("--images", required=True, help="table of label, emb")
    a.add_argument("--dataset", default="iu_xray", help="picks the source of the vocabulary: an ontology or descriptor records")
    a.add_argument("--ontology")
    a.add_argument("--descriptors", help="descriptor records, for datasets whose vocabulary they are")
    a.add_argument("--branches", default="A,C,E", help="branches of the descriptors to keep")
    a.add_argument("--topk", type=int, default=1024)
    a.add_argument("--seeds-file", help="text file of terms to inject")
    a = add("null")
    a.add_argument("--images", required=True)
    a.add_argument("--terms", required=True)
    a.add_argument("--k", type=int)
    a.add_argument("--explanations", help="explanations whose numbers of concepts are mirrored")
    a.add_argument("--seed", type=int, default=42)
    a = add("judge")
    a.add_argument("--explanations", required=True)
    a.add_argument("--reports", required=True, help="table of image_id, report, or the dataset's folder with --raw")
    a.add_argument("--raw", action="store_true")
    a.add_argument("--dataset", default="iu_xray")
    a.add_argument("--source", default="baseline")
    a.add_argument("--resume", action="store_true")
    a.add_argument("--checkpoint-every", type=int, default=50)
    a.add_argument("--url", default="http://localhost:1234/v1")
    a.add_argument("--model", default="local-model")
    a = add("failures")
    a.add_argument("--run", required=True, help="folder of a baseline run")
    a.add_argument("--judged", nargs="*", default=[], help="judge folders, as MODEL=FOLDER")
    a.add_argument("--dict-size", type=int, default=2048)
    a.add_argument("--k", type=int, default=32)
    a = add("splice")
    a.add_argument("--images", required=True)
    a.add_argument("--terms", required=True)
    a.add_argument("--k", type=int, default=32)
    a.add_argument("--no-gap-correction", action="store_true")
    a.add_argument("--analyze", action="store_true")
    a.add_argument("--dataset", default="iu_xray")
    a.add_argument("--tag", default="")
    a = add("organize")
    a.add_argument("--source", choices=sorted(SOURCES), default="splice", help="whose explanations to organise")
    a.add_argument("--dataset", default="iu_xray")
    a.add_argument("--tag", default="")
    a.add_argument("--explanations", help="instead of those of --source below --out")
    a.add_argument("--terms", required=True)
    a.add_argument("--n-clusters", type=int)
    a.add_argument("--distance", type=float)
    a.add_argument("--linkage", default="average")
    a.add_argument("--ontology")
    a = add("faithfulness")
    for x in ("--activations", "--labels", "--images"):
        a.add_argument(x, required=True)
    a.add_argument("--n-perm", type=int, default=200)
    a.add_argument("--min-prev", type=int, default=10)
    a.add_argument("--null-seed", type=int, default=0)
    a = add("consensus")
    a.add_argument("--decoder", required=True)
    a.add_argument("--tau", type=float, default=0.70)
    a.add_argument("--m", type=int, default=4)
    a.add_argument("--n-perm", type=int, default=200)
    a.add_argument("--null-seed", type=int, default=2026)
    for a in sub.choices.values():
        a.add_argument("--out", required=True)
    a = add("fetch")
    a.add_argument("urls", nargs="*")
    a.add_argument("--list", help="text file of addresses, one a line")
    a.add_argument("--to", required=True, help="folder of the files")
    a.add_argument("--gzip", action="store_true", help="only packed files are valid")
    a.add_argument("--dry-run", action="store_true")
    a = add("snapshot")
    a.add_argument("before")
    a.add_argument("after")
    a = add("take")
    a.add_argument("folder")
    a.add_argument("--out", required=True)
    a = add("compare")
    a.add_argument("before")
    a.add_argument("after")
    return p


def _fetch(o: argparse.Namespace) -> int:
    """Fetch what is not there yet, on the machine of the command."""
    listed = open(o.list, encoding="utf-8").read().splitlines() if o.list else []
    valid = models.is_gzip if o.gzip else (lambda path: os.path.getsize(path) > 0)
    for url in models.unique([*o.urls, *listed]):
        target = os.path.join(o.to, url.rstrip("/").rsplit("/", 1)[-1])
        print(url, target, "planned" if o.dry_run else "fetched" if models.fetch(url, target, valid) else "there")
    return 0


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    if o.analysis == "fetch":
        return _fetch(o)
    spark = SparkSession.builder.appName("prismet").getOrCreate()
    read = partial(pipelines.existing, spark)
    if o.analysis == "snapshot":
        return 0 if snapshot.identical(snapshot.take(spark, o.before), snapshot.take(spark, o.after)) else 1
    if o.analysis == "take":
        snapshot.take(spark, o.folder).write.mode("overwrite").parquet(o.out)
        return 0
    if o.analysis == "compare":
        changed = snapshot.diff(read(o.before), read(o.after)).where("state <> 'matched'")
        changed.orderBy("path").show(100, truncate=False)
        return 1 if changed.limit(1).count() else 0
    if o.analysis in ("baseline", "path-a", "ablation", "train"):
        settings = TrainConfig(dict_size=o.dict_size, k=o.k, steps=o.steps, batch=o.batch_size, lr=config.parse_rate(o.lr), warmup=min(1000, o.steps))
        run = config.Run(seeds=config.parse_seeds(o.seeds), n_perm=getattr(o, "n_perm", 200), train=settings)
        if o.analysis == "ablation":
            pipelines.ablation(spark, read(o.images), read(o.terms), o.out, replace(run)).show(truncate=False)
            return 0
        if o.analysis == "train":
            done = pipelines.Stages(spark, o.out)
            done.add("models", lambda: train.train(read(o.images).select("image_id", "emb"), list(run.seeds), settings))
            done.add("manifest", lambda: sinks.manifest(read(o.images), seeds=o.seeds, dict_size=o.dict_size, k=o.k, steps=o.steps, lr=settings.rate), json=True)
        else:
            hidden = o.analysis == "path-a"
            out = registry.dataset(o.dataset, variant=o.variant).folder(o.out, "hidden" if hidden else "baseline", o.tag)
            bridge = {"projection": np.load(o.projection), "gap": read(o.gap) if o.gap else None} if hidden else {}
            if hidden and o.folder and not o.skip_extract:
                data = registry.dataset(o.dataset)
                files = pictures.downscaled(data.images(spark, o.folder).select("file", "content"))
                rows = images.encode(files, _function(o.encoder)).withColumn("grp", data.group(F.col("image_id")))
                numbered = graph.ranked(rows, 1 + rows.count() // 100_000, F.col("image_id")).select((F.col("__r") - 1).alias("image_id"), F.col("image_id").alias("file"), "grp", "emb")
                numbered.write.mode("overwrite").parquet(o.images)
            done = pipelines.baseline(spark, read(o.images), read(o.terms), out, run, models=read(o.models) if o.models else None, **bridge)
            if hidden:
                settings = [("variant", o.variant), ("tag", o.tag or "-"), ("images", o.images), ("results", out), ("dict_size / k / steps", f"{o.dict_size} / {o.k} / {o.steps}"), ("seeds", o.seeds)]
                pipelines.run_report(spark, done, f"Hidden-state run ({o.variant})", settings, {"images": read(o.images).select("image_id", "emb"), "terms": read(o.terms), "models": done["models"]})
    elif o.analysis == "stage":
        if o.which == "names" and not o.terms:
            raise SystemExit("names need --terms")
        done = pipelines.one_stage(spark, o.which, o.run, o.out, read(o.terms) if o.terms else None, o.seed, o.names, o.concepts, o.n_perm)
    elif o.analysis == "extract":
        data = registry.dataset(o.dataset)
        done = pipelines.Stages(spark, o.out)
        files = images.flattened(images.listing(spark, o.folder, data.pattern, data.recursive))
        files = files.join(images.listing(spark, o.folder, data.pattern, data.recursive, content=True).select("path", "content"), "path")
        if o.short_edge:
            files = pictures.downscaled(files, o.short_edge).drop("width", "height", "reduced")
        views = sampling.views(files, o.augmentation) if o.augmentation else files.withColumn("view", F.lit(0))
        done.add("images", lambda: images.encode_views(views, _function(o.encoder), o.batch_size))
        if o.text_encoder and not o.skip_text:
            texts = reports.required(data.lookup(spark, o.folder), f"reports of {o.dataset}")
            done.add("reports", lambda: images.encode_texts(texts, _function(o.text_encoder), o.batch_size))
    elif o.analysis == "vocabulary":
        source = registry.dataset(o.dataset).vocabulary
        if source == "descriptors":
            if not o.descriptors:
                raise SystemExit(f"the vocabulary of {o.dataset} comes from descriptor records; give --descriptors")
            records = ontologies.descriptors(spark, o.descriptors)
            done = pipelines.descriptor_vocabulary(spark, records, read(o.terms), read(o.images), o.out, tuple(x for x in o.branches.replace(" ", "").split(",") if x), o.topk)
            print(done.report())
            return 0
        nodes, edges, sites = ontologies.ontology(spark, o.ontology) if o.ontology else (None, None, None)
        seeds = tuple(r["value"] for r in spark.read.text(o.seeds_file).where("trim(value) <> ''").collect()) if o.seeds_file else ()
        done = pipelines.vocabulary(spark, read(o.terms), read(o.images), o.out, config.Vocabulary(o.topk, seeds), nodes, edges, sites)
    elif o.analysis == "null":
        done = pipelines.nulls(spark, read(o.images), read(o.terms), o.out, o.k, read(o.explanations) if o.explanations else None, o.seed)
    elif o.analysis == "judge":
        data = registry.dataset(o.dataset)
        given = data.lookup(spark, o.reports) if o.raw else read(o.reports)
        out = f"{data.folder(o.out, 'judge', o.source)}/{o.model.replace('/', '_').replace(':', '_')}"
        done = pipelines.judged_in_parts(spark, read(o.explanations), given, models.http_model(o.url, o.model), data.prompt, out, o.checkpoint_every, o.resume)
    elif o.analysis == "failures":
        done = pipelines.failures_of_run(spark, o.run, dict(x.split("=", 1) for x in o.judged), o.out, o.dict_size, o.k)
    elif o.analysis == "splice":
        out = registry.dataset(o.dataset).folder(o.out, "splice", o.tag)
        done = pipelines.spliced(spark, read(o.images), read(o.terms), out, config.Splice(o.k, not o.no_gap_correction), o.analyze)
    elif o.analysis == "organize":
        nodes, edges, _ = ontologies.ontology(spark, o.ontology) if o.ontology else (None, None, None)
        data = registry.dataset(o.dataset)
        given = read(o.explanations or f"{data.folder(o.out, SOURCES[o.source], o.tag)}/explanations")
        done = pipelines.organized(spark, given, read(o.terms), data.folder(o.out, f"organization_{o.source}", o.tag), config.Organize(o.linkage, n_clusters=o.n_clusters, distance=o.distance), nodes, edges)
    elif o.analysis == "faithfulness":
        done = pipelines.faithful(spark, read(o.activations), read(o.labels), read(o.images), o.out, config.Faithfulness(o.min_prev, o.n_perm, o.null_seed))
    else:
        done = pipelines.consensus(spark, read(o.decoder), o.out, config.Consensus(o.tau, o.m, o.n_perm, o.null_seed))
    print(done.report())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
