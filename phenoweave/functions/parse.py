"""Name, path and label parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sequencing-panel names whose phenotype id is not derivable by rule.
GENOTYPE_OVERRIDES = {
    "BTx378": "PI 655991",
    "RTx430": "PI 655996",
}

# Display labels in plotting order.
FACTOR_LABELS = {
    "sam_score": "Segmentation Score",
    "device": "Device",
    "row": "Row",
    "range": "Range",
    "genotype": "Genotype",
}
PHENOTYPE_LABELS = {
    "max_height_px": "Maximum \nWidth",
    "median_height_px": "Median \nWidth",
    "mean_height_px": "Mean \nWidth",
    "area_px": "Area",
    "height_range_px": "Width \nRange",
    "min_height_px": "Minimum \nWidth",
}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/?$", 1)


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def leading_plot(name: Column) -> Column:
    """Plot number before the first underscore; null when the name has none."""
    return F.regexp_extract(name, r"^(\d+)_", 1).try_cast("int")


def device_of(image_name: Column) -> Column:
    """``device1_1403_...`` -> ``1``."""
    return F.regexp_replace(F.split_part(image_name, F.lit("_"), F.lit(1)), "^device", "")


def plot_of(image_name: Column) -> Column:
    """``device1_1403_...`` -> 1403; null when not a number."""
    return F.split_part(image_name, F.lit("_"), F.lit(2)).try_cast("int")


def strip_number(mask_name: Column) -> Column:
    """``strip_0001_mask.png`` -> 1."""
    return F.split_part(mask_name, F.lit("_"), F.lit(2)).try_cast("int")


def full_identifier(subdirectory: Column, image_stem: Column) -> Column:
    return F.concat_ws("_", subdirectory, image_stem)


def mask_directory(root: str, device: Column, image_stem: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/device"), device.cast("string"), F.lit("_"), image_stem)


def box_from_text(text: Column) -> Column:
    """``[x1, y1, x2, y2]`` -> ARRAY<INT>; null for malformed text."""
    return F.from_json(text, "array<int>", {"mode": "PERMISSIVE"})


def phenotype_genotype(vcf_name: Column, overrides: dict[str, str] | None = None) -> Column:
    """Panel name -> phenotype id: a space after the first ``PI``, plus overrides."""
    out = F.regexp_replace(vcf_name, r"^(.*?)PI", "$1PI ")
    for source, target in (GENOTYPE_OVERRIDES if overrides is None else overrides).items():
        out = F.when(vcf_name == source, target).otherwise(out)
    return out


def relabel(value: Column, labels: dict[str, str]) -> tuple[Column, Column]:
    """(label, 1-based order) of an ordered category; null for unknown levels."""
    label, order = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (key, text) in enumerate(labels.items(), 1):
        label = F.when(value == key, text).otherwise(label)
        order = F.when(value == key, i).otherwise(order)
    return label, order


def truncate_label(label: Column, length: int) -> Column:
    return F.substring(label, 1, length)


def as_factor(value: Column) -> Column:
    return value.cast("string")


def skip_reason(boxes: Column, min_boxes: int, max_boxes: int) -> Column:
    return F.when(boxes < min_boxes, F.format_string("fewer_than_%d_boxes", F.lit(min_boxes))).when(
        boxes > max_boxes, F.format_string("more_than_%d_boxes", F.lit(max_boxes))
    )
