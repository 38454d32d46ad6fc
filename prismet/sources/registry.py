"""Datasets by name: how their images are grouped and where their reports come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.functions.text import study_key
from prismet.sources import datasource, reports


@dataclass(frozen=True)
class Dataset:
    """A dataset's rules. `lookup` maps (spark, root) to image_id, report; `group` maps a file name to its group."""

    name: str
    pattern: str
    recursive: bool
    group: Callable[[Column], Column]
    lookup: Callable[[SparkSession, str], DataFrame]
    prompt: str
    vocabulary: str = "ontology"
    variant: str = "standard"

    def images(self, spark: SparkSession, root: str, content: bool = True) -> DataFrame:
        """file, path, bytes, content of the dataset's image files, read by the package's own data source."""
        datasource.register(spark)
        return spark.read.format(datasource.ImageFolder.name()).options(pattern=self.pattern, recursive=self.recursive, content=content).load(root)

    def folder(self, root: str, kind: str, tag: str = "") -> str:
        """Layout of results: one path a dataset, variant and kind."""
        return f"{root.rstrip('/')}/dataset={self.name}/variant={self.variant}/{kind}{'_' + tag if tag else ''}"


ENGLISH = "Compare the claim with the report.\nReport: {report}\nClaim: {pseudo_report}\nAnswer: <explanation> | Verdict: <Aligned/Unaligned/Uncertain>"
SPANISH = "Compara la afirmación con el informe.\nInforme: {report}\nAfirmación: {pseudo_report}\nRespuesta: <explicación> | Verdict: <Aligned/Unaligned/Uncertain>"


def _two_hop(spark: SparkSession, root: str) -> DataFrame:
    p = reports.with_position(reports.read_csv(spark, f"{root}/indiana_projections.csv")).select("filename", "uid", "pos")
    return reports.two_hop_lookup(p, reports.read_csv(spark, f"{root}/indiana_reports.csv").select("uid", "findings", "impression"))


def _labelled(spark: SparkSession, root: str) -> DataFrame:
    rows = reports.with_position(reports.read_csv(spark, f"{root}/labels.csv"))
    return reports.image_reports(rows.select(F.col("ImageID").alias("image_id"), F.col("Report").alias("report"), "pos"))


def _captioned(spark: SparkSession, root: str) -> DataFrame:
    rows = reports.with_position(reports.read_csv(spark, f"{root}/captions.csv", header=False, schema="name string, caption string"))
    kept = reports.captions(rows)
    return reports.last_wins(kept, "pos", "name").select(F.col("name").alias("image_id"), F.col("caption").alias("report"))


DATASETS = {
    "iu_xray": Dataset("iu_xray", "*.png", False, study_key, _two_hop, ENGLISH),
    "padchest": Dataset("padchest", "*.png", False, lambda name: name, _labelled, SPANISH),
    "rocov2": Dataset("rocov2", "*.jpg", True, lambda name: name, _captioned, ENGLISH, vocabulary="descriptors"),
}


def dataset(name: str, **changes) -> Dataset:
    """The named dataset, with fields replaced if given; an unknown name says which are known."""
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(DATASETS))}")
    return replace(DATASETS[name], **changes)
