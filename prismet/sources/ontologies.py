"""Readers of ontology tables (CSV) and of descriptor records (XML)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.functions.text import rid_from_uri
from prismet.sources import datasource
from prismet.sources.reports import read_csv

SITE = "http://www.radlex.org/RID/Anatomical_Site"  # fixed value: the column's name
DESCRIPTOR = "DescriptorUI string, DescriptorName struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>"


def _many(column: str):
    return F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), r"\|"), rid_from_uri), lambda x: x != "")


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (pos, rid, label, obsolete), edges (child, parent), sites (rid, site)."""
    raw = read_csv(spark, path).withColumn("pos", F.monotonically_increasing_id()).withColumn("rid", rid_from_uri(F.col("`Class ID`"))).where("rid <> ''")
    nodes = raw.select("pos", "rid", F.trim(F.coalesce(F.col("`Preferred Label`"), F.lit(""))).alias("label"), (F.lower(F.trim(F.coalesce(F.col("Obsolete"), F.lit("")))) == "true").alias("obsolete"))
    edges = raw.select(F.col("rid").alias("child"), F.explode(_many("Parents")).alias("parent"))
    sites = raw.select("rid", F.explode(_many(f"`{SITE}`")).alias("site"))
    return nodes, edges, sites


def descriptors(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name, trees) of descriptor records, read in ranges of bytes; a missing list of tree numbers is empty. Packed
    files are told by their first two bytes. pos follows the place in the files, however they are split."""
    datasource.register(spark)
    return spark.read.format(datasource.Descriptors.name()).load(path)


def descriptors_of_text(rows: DataFrame, column: str = "xml", more: Sequence[str] = ()) -> DataFrame:
    """The same from a column that holds one record each, after the columns in `more`."""
    parsed = rows.select(*more, F.from_xml(F.col(column), DESCRIPTOR).alias("d"))
    return parsed.select(*more, F.trim(F.col("d.DescriptorName.String")).alias("name"), F.coalesce(F.col("d.TreeNumberList.TreeNumber"), F.array().cast("array<string>")).alias("trees")).where("name is not null")
