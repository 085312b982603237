"""Image trees, rasters and mask sidecars.

A raster leaves the image source as one large binary row. It is cut into one
slice per image row inside the JVM first, so a Python batch holds image rows,
never whole photographs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phenoweave.functions import parse
from phenoweave.functions.colour import GREEN_HIGH, GREEN_LOW

# Suffixes of the photographs, compared in lower case.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp")


def relative_path(path: Column, base_dir: str) -> Column:
    """Path below ``base_dir``, whatever the scheme in front of it."""
    base = base_dir.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    return F.substring_index(path, base, -1)


def catalogue_columns(listing: DataFrame, base_dir: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Image columns of a file listing; root-level files and other suffixes are dropped."""
    relative = relative_path(F.col("path"), base_dir)
    name = parse.file_name(F.col("path"))
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return (
        listing.select("path", "length", "modificationTime")
        .withColumns({"_relative": relative, "filename": name})
        .filter(F.instr("_relative", "/") > 0)
        .filter(suffix.isin(list(suffixes)))
        .select(
            parse.full_identifier(F.split_part("_relative", F.lit("/"), F.lit(1)), parse.stem(F.col("filename"))).alias("image_id"),
            F.split_part("_relative", F.lit("/"), F.lit(1)).alias("subdirectory"),
            F.regexp_extract("_relative", r"^device(\d+)/", 1).try_cast("int").alias("device"),
            parse.leading_plot(F.col("filename")).alias("plot"),
            "filename",
            F.col("path").alias("image_path"),
            "length",
            F.col("modificationTime").alias("mtime"),
        )
    )


def list_images(spark: SparkSession, base_dir: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Catalogue of an image tree; file contents are never read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base_dir)
    return catalogue_columns(listing, base_dir, suffixes)


def source_path() -> Column:
    """Plain path of the file a row came from; the metadata path is URI-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_rasters(spark: SparkSession, base_dir: str) -> DataFrame:
    """(path, height, width, channels, data) per decodable file; others have a null ``data``."""
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(base_dir)
    valid = F.col("image.height") > 0
    return raw.select(
        source_path().alias("path"),
        *[F.when(valid, F.col(f"image.{c}")).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))],
    )


def failed_rasters(catalogue: DataFrame, rasters: DataFrame) -> DataFrame:
    """Paths of catalogued images that did not decode."""
    decoded = rasters.filter("data is not null").select(F.col("path").alias("image_path"))
    return catalogue.select("image_path").join(decoded, "image_path", "left_anti")


def raster_rows(rasters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, width, channels, row): one slice of pixel bytes per image row."""
    span = (F.col("width") * F.col("channels")).cast("int")
    return (
        rasters.filter("data is not null")
        .select(*keys, "width", "channels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
        .select(*keys, "y", "width", "channels", F.substring(F.col("data"), F.col("y") * span + 1, span).alias("row"))
    )


def _row_runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and inclusive ends of the set stretches of one row."""
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _green(pixels: np.ndarray) -> np.ndarray:
    """Leaf-green test of blue-green-red bytes, as the HSV expressions define it."""
    b, g, r = (pixels[:, k].astype(float) for k in range(3))
    top, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    spread = np.where(top > low, top - low, 1.0)
    hue = np.where(
        top == r, 60 * (g - b) / spread, np.where(top == g, 120 + 60 * (b - r) / spread, 240 + 60 * (r - g) / spread)
    )
    hue = np.where(top == low, 0.0, np.where(hue < 0, hue + 360, hue))
    half = np.floor(hue / 2 + 0.5) % 180
    saturation = np.floor(np.where(top > 0, (top - low) * 255 / np.where(top > 0, top, 1), 0) + 0.5)
    inside = np.ones(len(pixels), bool)
    for value, lowest, highest in zip((half, saturation, top), GREEN_LOW, GREEN_HIGH):
        inside &= (value >= lowest) & (value <= highest)
    return inside


def _runs(rows: DataFrame, keys: Sequence[str], test) -> DataFrame:
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            owner, starts, ends = [], [], []
            for i, (row, channels) in enumerate(zip(pdf["row"], pdf["channels"])):
                first, last = _row_runs(test(np.frombuffer(row, np.uint8).reshape(-1, channels)))
                owner.append(np.full(len(first), i))
                starts.append(first)
                ends.append(last)
            if owner:
                out = pdf[[*keys, "y"]].iloc[np.concatenate(owner)].reset_index(drop=True)
                out["x_start"], out["x_end"] = np.concatenate(starts), np.concatenate(ends)
                yield out

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["y int", "x_start bigint", "x_end bigint"])
    return rows.mapInPandas(encode, schema)


def mask_runs(rasters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of non-zero pixels of mask rasters."""
    return _runs(raster_rows(rasters, keys), keys, lambda p: p.max(axis=1) > 0)


def green_runs(rasters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of leaf-green pixels of colour rasters."""
    return _runs(raster_rows(rasters.filter("channels >= 3"), keys), keys, _green)


def pixel_rows(rasters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, x, r, g, b): one row per pixel of colour rasters."""
    keys = list(keys)
    rows = raster_rows(rasters.filter("channels >= 3"), keys)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                part = pdf.iloc[start : start + 64]
                pixels = [np.frombuffer(r, np.uint8).reshape(-1, c) for r, c in zip(part["row"], part["channels"])]
                sizes = [len(p) for p in pixels]
                out = part[[*keys, "y"]].loc[part.index.repeat(sizes)].reset_index(drop=True)
                out["x"] = np.concatenate([np.arange(n) for n in sizes])
                stacked = np.concatenate([p[:, :3] for p in pixels])
                for k, channel in enumerate(("b", "g", "r")):
                    out[channel] = stacked[:, k].astype(np.int32)
                yield out

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["y int", "x int", "r int", "g int", "b int"])
    return rows.mapInPandas(unpack, schema)


def mask_keys(rasters: DataFrame) -> DataFrame:
    """Add image_id and strip_id of mask files ``<image_id>/strip_0000_mask.png``."""
    return rasters.select(
        "*",
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("image_id"),
        parse.strip_number(parse.file_name(F.col("path"))).alias("strip_id"),
    ).filter(F.col("path").rlike(r"/strip_\d+_mask\.png$"))


def read_masks(spark: SparkSession, mask_dir: str) -> DataFrame:
    """Mask rasters with image_id and strip_id."""
    return mask_keys(read_rasters(spark, mask_dir))


def read_box_sidecars(spark: SparkSession, mask_dir: str) -> DataFrame:
    """(image_id, strip_id, box_coords, sam_score) from ``strip_*_box.txt`` files."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "strip_*_box.txt")
        .text(mask_dir, wholetext=True)
        .select("value", source_path().alias("path"))
    )
    box = F.regexp_extract("value", r"(?m)^Box:\s*(.*?)\s*$", 1)
    return raw.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("image_id"),
        parse.strip_number(parse.file_name(F.col("path"))).alias("strip_id"),
        F.nullif(box, F.lit("")).alias("box_coords"),
        F.regexp_extract("value", r"(?m)^Score:\s*(\S+)", 1).try_cast("double").alias("sam_score"),
    )
