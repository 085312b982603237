"""Catalogue + masks + field map -> leakage-free splits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from phenoweave.operators import catalog, splits
from phenoweave.session import durable


def prepare_splits(
    images: DataFrame, masks: DataFrame, field_map: DataFrame, order: str | None = None,
    train: float = splits.TRAIN_RATIO, val: float = splits.VAL_RATIO, seed: int = splits.SEED,
) -> tuple[DataFrame, DataFrame]:
    """(usable images with split, one row per genotype with its split)."""
    usable = durable(catalog.usable_images(images, masks, field_map, order), "usable-images")
    assigned = durable(splits.assign_groups(usable, "genotype", train, val, seed), "assigned-groups")
    return splits.split_rows(usable, assigned, "genotype"), assigned
