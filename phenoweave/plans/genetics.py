"""Strip table -> leaf totals -> variance partition and association tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenoweave.functions.parse import (
    FACTOR_LABELS,
    PHENOTYPE_LABELS,
    device_of,
    phenotype_genotype,
    plot_of,
    relabel,
)
from phenoweave.operators.catalog import assert_unique, with_field_map
from phenoweave.operators.strips import PHENOTYPES, leaf_totals
from phenoweave.operators.variance import without_residual


def field_strips(strips: DataFrame, field_map: DataFrame) -> DataFrame:
    """Strip measurements with device and plot parsed and the field map joined."""
    parsed = strips.withColumns({"device": device_of(F.col("image_name")), "plot": plot_of(F.col("image_name"))})
    return with_field_map(parsed, field_map)


def leaves(strips: DataFrame, field_map: DataFrame) -> DataFrame:
    return leaf_totals(field_strips(strips, field_map))


def labelled_partition(partition: DataFrame) -> DataFrame:
    """Partition without the residual, with display labels and their order."""
    factor, factor_order = relabel(F.col("component"), FACTOR_LABELS)
    label, label_order = relabel(F.col("phenotype"), PHENOTYPE_LABELS)
    return without_residual(partition).select(
        factor.alias("factor"),
        factor_order.alias("factor_order"),
        label.alias("phenotype_label"),
        label_order.alias("phenotype_order"),
        "percent",
    )


def association_table(leaf: DataFrame, panel: DataFrame) -> DataFrame:
    """Leaf phenotypes of sequenced genotypes, under their panel names."""
    ids = panel.select("vcf_name", phenotype_genotype(F.col("vcf_name")).alias("genotype"))
    return (
        leaf.join(assert_unique(ids, "genotype"), "genotype")
        .drop("genotype")
        .select(F.col("vcf_name").alias("genotype"), *PHENOTYPES)
    )


def association_genotypes(table: DataFrame) -> DataFrame:
    return table.select("genotype").distinct()
