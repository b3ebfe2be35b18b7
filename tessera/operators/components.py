"""Taxon-by-function components of genes, and gene-to-component rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept
from .matrix import matmul
from .stats import summary

UNKNOWN = "unknown_function_collective"


def assign(taxa: DataFrame, functions: DataFrame) -> DataFrame:
    """Components (``taxon|function``) of every gene: ``gene``, ``taxon``, ``function``, ``component``.

    ``taxa`` has ``gene``, ``taxon``; ``functions`` has ``gene``, ``function``
    with many rows a gene.  Genes without a function share one per taxon.
    """
    rows = taxa.join(functions.where("function is not null"), "gene", "left").withColumn("function", F.coalesce("function", F.lit(UNKNOWN)))
    return rows.select("gene", "taxon", "function", F.concat_ws("|", "taxon", "function").alias("component")).distinct()


def component_counts(x: DataFrame, members: DataFrame) -> DataFrame:
    """Cells summed by component; a gene counts in each of its own."""
    return x.join(members.select(F.col("gene").alias("attr"), "component"), "attr").groupBy("obs", F.col("component").alias("attr")).agg(F.sum("v").alias("v"))


def component_metadata(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """Genes of each component and statistics of their lengths, by taxon, function and number."""
    rows = members.join(lengths.select("gene", F.col("length").cast("double").alias("v")), "gene")
    return summary(rows, ["component", "taxon", "function"]).orderBy("taxon", "function", F.desc("n"))


def functional_potential(x: DataFrame, ratios: DataFrame) -> DataFrame:
    """Abundance of bins times their module completion ratios (bin as ``obs``, module as ``attr``)."""
    return matmul(x, ratios)


def pivot_modules(tables: DataFrame, modules: list | None = None) -> DataFrame:
    """Bin by module matrix (``bin``, ``module``, ``ratio``), absent ones 0."""
    return tables.groupBy("bin").pivot("module", modules).agg(F.first("ratio")).fillna(0.0)


def lineage(ids: DataFrame, taxonomy: DataFrame, ranks: list[str]) -> DataFrame:
    """Names at the given ranks of each ``taxon_id``, by climbing ``taxonomy`` (``taxon_id``, ``parent``, ``name``, ``rank``); unknown ids have none, and a circle is gone round once."""
    tree = taxonomy.select(F.col("taxon_id").alias("node"), "parent", "name", "rank")
    at = ids.select("taxon_id").distinct().withColumn("node", F.col("taxon_id"))
    found = None
    while True:
        here = kept(at.join(tree, "node").select("taxon_id", "node", "parent", "name", "rank"))
        found = here if found is None else found.unionByName(here)
        at = here.where("parent is not null and parent <> node").select("taxon_id", F.col("parent").alias("node")).join(found.select("taxon_id", "node"), ["taxon_id", "node"], "left_anti")
        if at.isEmpty():
            break
    named = found.groupBy("taxon_id").pivot("rank", ranks).agg(F.first("name"))
    return ids.join(named, "taxon_id", "left")


def identifiers(names: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Ids of names; NULL for unknown ones."""
    return names.join(taxonomy.select("name", "taxon_id"), "name", "left")
