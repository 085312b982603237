"""Colour-card patches, per-image least-squares colour transforms, and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phenoweave.functions.colour import add_lab, delta_e, lab_values, to_byte
from phenoweave.operators.packing import map_groups, pack
from phenoweave.session import durable

# sRGB (D65) reference colours of the 24 card patches, row by row.
REFERENCE_PATCHES = (
    (115, 82, 68), (194, 150, 130), (98, 122, 157), (87, 108, 67), (133, 128, 177), (103, 189, 170),
    (214, 126, 44), (80, 91, 166), (193, 90, 99), (94, 60, 108), (157, 188, 64), (224, 163, 46),
    (56, 61, 150), (70, 148, 73), (175, 54, 60), (231, 199, 31), (187, 86, 149), (8, 133, 161),
    (243, 243, 242), (200, 200, 200), (160, 160, 160), (122, 122, 121), (85, 85, 85), (52, 52, 52),
)

# Card rectangle in pixels, counted from the right and bottom edges.
CARD = {"card_width": 768, "card_height": 493, "from_right": 516, "from_bottom": 291}
# Size of the straightened card, its grid, and the border share.
STRAIGHT = {"width": 600, "height": 400}
ROWS, COLUMNS, BORDER = 4, 6, 0.08

_FIRST = ((1, 0, 0), (0, 1, 0), (0, 0, 1))
_SECOND = ((2, 0, 0), (0, 2, 0), (0, 0, 2), (1, 1, 0), (1, 0, 1), (0, 1, 1))
_THIRD = (
    (3, 0, 0), (0, 3, 0), (0, 0, 3), (2, 1, 0), (2, 0, 1), (1, 2, 0), (0, 2, 1), (1, 0, 2), (0, 1, 2), (1, 1, 1),
)
_ONE = ((0, 0, 0),)
CHUNK_CARDS = 128  # whose features are in memory at once: they fit into the caches

# Feature lists as exponents of (r, g, b), and the channel scale of the coefficients.
METHODS: dict[str, tuple[tuple[tuple[int, int, int], ...], float]] = {
    "linear": (_FIRST + _ONE, 255.0),
    "polynomial1": (_ONE + _FIRST, 255.0),
    "polynomial2": (_ONE + _FIRST + _SECOND, 255.0),
    "polynomial3": (_ONE + _FIRST + _SECOND + _THIRD, 255.0),
    "cheung2004": (_FIRST, 1.0),
    "finlayson2015": (_FIRST, 1.0),
    "vandermonde": (_SECOND[:3] + _FIRST + _ONE, 1.0),
}


def method_features(method: str) -> tuple[tuple[int, int, int], ...]:
    if method not in METHODS:
        raise ValueError(f"unknown colour correction method: {method}")
    return METHODS[method][0]


def reference_patches(spark: SparkSession) -> DataFrame:
    """The 24 reference colours: (patch_idx, ref_r, ref_g, ref_b)."""
    rows = [(i, *map(float, rgb)) for i, rgb in enumerate(REFERENCE_PATCHES)]
    return spark.createDataFrame(rows, "patch_idx int, ref_r double, ref_g double, ref_b double")


def with_reference(patches: DataFrame) -> DataFrame:
    """Measured patches joined with their reference colour.

    The 24 constant rows go to the tasks. Left to its estimates, Spark takes the exploded patches for the
    smaller side and sends all of them through the driver.
    """
    return patches.join(F.broadcast(reference_patches(patches.sparkSession)), "patch_idx")


def feature(exponents: tuple[int, int, int], r: Column, g: Column, b: Column) -> Column:
    factors = [c for c, e in zip((r, g, b), exponents) for _ in range(e)]
    out = F.lit(1.0)
    for i, c in enumerate(factors):
        out = c if i == 0 else out * c
    return out


def polynomial_features(r: Column, g: Column, b: Column, degree: int) -> Column:
    """Array of the 4, 10 or 20 polynomial terms of degree 1, 2 or 3."""
    return F.array(*[feature(e, r, g, b) for e in method_features(f"polynomial{degree}")])


def card_rectangle(height: Column, width: Column, card: dict = CARD) -> tuple[Column, Column, Column, Column]:
    """(x_left, y_top, x_right, y_bottom) of the card in an upright image."""
    right = width - card["from_right"]
    bottom = height - card["from_bottom"]
    return right - card["card_width"], bottom - card["card_height"], right, bottom


def grid_spans(length: int, cells: int, target: int) -> list[tuple[int, int]]:
    """Inclusive offsets of the central half of each cell, in card pixels.

    ``length`` is the straightened size the windows are defined on, ``target``
    the card's size in the photograph.
    """
    margin = length * BORDER
    cell = (length - 2 * margin) / cells
    scale = target / (length - 1)
    spans = []
    for i in range(cells):
        start, stop = int(margin + i * cell + cell * 0.25), int(margin + i * cell + cell * 0.75)
        spans.append((int(np.ceil(start * scale)), int(np.floor((stop - 1) * scale))))
    return spans


def patch_windows(frames: DataFrame, card: dict = CARD, straight: dict = STRAIGHT) -> DataFrame:
    """Inclusive pixel window of each of the 24 patches per image."""
    left, top, _, _ = card_rectangle(F.col("height"), F.col("width"), card)
    windows = [
        F.struct(
            F.lit(r * COLUMNS + c).alias("patch_idx"),
            (top + y0).alias("y0"), (top + y1).alias("y1"), (left + x0).alias("x0"), (left + x1).alias("x1"),
        )
        for r, (y0, y1) in enumerate(grid_spans(straight["height"], ROWS, card["card_height"]))
        for c, (x0, x1) in enumerate(grid_spans(straight["width"], COLUMNS, card["card_width"]))
    ]
    return frames.withColumn("_w", F.explode(F.array(*windows))).select("image_id", "_w.*")


def patch_index(y: Column, x: Column, height: Column, width: Column, card: dict = CARD, straight: dict = STRAIGHT) -> Column:
    """Patch holding pixel (y, x), or null: arithmetic instead of a range join."""
    left, top, _, _ = card_rectangle(height, width, card)
    row, col = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(grid_spans(straight["height"], ROWS, card["card_height"])):
        row = F.when((y - top).between(lo, hi), i).otherwise(row)
    for i, (lo, hi) in enumerate(grid_spans(straight["width"], COLUMNS, card["card_width"])):
        col = F.when((x - left).between(lo, hi), i).otherwise(col)
    return row * COLUMNS + col


def card_pixels(pixels: DataFrame, frames: DataFrame, card: dict = CARD, straight: dict = STRAIGHT) -> DataFrame:
    """The pixels inside the 24 windows, with their ``patch_idx``."""
    return (
        pixels.join(frames.select("image_id", "height", "width"), "image_id")
        .withColumn("patch_idx", patch_index(F.col("y"), F.col("x"), F.col("height"), F.col("width"), card, straight))
        .filter("patch_idx is not null")
        .drop("height", "width")
    )


def window_means(inside: DataFrame) -> DataFrame:
    return inside.groupBy("image_id", "patch_idx").agg(F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b"))


def patch_means(pixels: DataFrame, frames: DataFrame, card: dict = CARD, straight: dict = STRAIGHT) -> DataFrame:
    """Mean colour per (image, patch); pixels outside the windows are dropped first."""
    return window_means(card_pixels(pixels, frames, card, straight))


def normal_sums(patches: DataFrame, method: str = "linear") -> DataFrame:
    """Long XtX and Xty sums per image: (image_id, i, j, value); j >= p addresses Xty."""
    features = method_features(method)
    p = len(features)
    joined = with_reference(patches)
    x = [feature(e, F.col("r"), F.col("g"), F.col("b")) for e in features]
    y = [F.col("ref_r"), F.col("ref_g"), F.col("ref_b")]
    # All sums of an image in one row; the long form is made of the totals.
    total = lambda i, j: F.sum(x[i] * (x[j] if j < p else y[j - p])).alias(f"_{i}_{j}")
    cells = [(i, j) for i in range(p) for j in range(p + 3)]
    sums = joined.groupBy("image_id").agg(*[total(i, j) for i, j in cells])
    long = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_{i}_{j}").alias("value")) for i, j in cells]
    return sums.select("image_id", F.explode(F.array(*long)).alias("c")).select("image_id", "c.i", "c.j", "c.value")


def _features(rgb: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """Products of powers of the channels, which are the first axis; one feature along the last."""
    powers = [rgb]
    for _ in range(exponents.max() - 1):
        powers.append(powers[-1] * rgb)
    out = np.empty((*rgb.shape[1:], len(exponents)))
    for k, exponent in enumerate(exponents):
        factors = [powers[e - 1][c] for c, e in enumerate(exponent) if e]
        out[..., k] = factors[0] if factors else 1.0
        for other in factors[1:]:
            out[..., k] *= other
    return out


def _least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares of a stack of systems; minimum norm where one lacks rank."""
    p = x.shape[2]
    # Beside x, y becomes its share of the orthogonal columns.
    r = np.linalg.qr(np.concatenate([x, y], axis=2), mode="r")
    diagonal = np.abs(np.diagonal(r[:, :p, :p], axis1=1, axis2=2))
    full = diagonal.min(axis=1) > 1e-12 * diagonal.max(axis=1)
    out = np.empty((len(x), p, y.shape[2]))
    if full.all():
        return np.linalg.solve(r[:, :p, :p], r[:, :p, p:])
    out[full] = np.linalg.solve(r[full, :p, :p], r[full, :p, p:])
    out[~full] = np.linalg.pinv(x[~full]) @ y[~full]
    return out


def fit(patches: DataFrame, method: str = "linear") -> DataFrame:
    """Per-image least squares measured -> reference: (image_id, method, coef).

    ``coef`` is three rows (r, g, b) of one coefficient per feature.
    """
    method_features(method)
    return _solved(_by_image(patches), method)


def fit_each(patches: DataFrame | Cards, methods: Sequence[str]) -> dict[str, DataFrame | CardFits]:
    """:func:`fit` of each method; the patches are dealt by image once for all of them, which :func:`cards` are already."""
    for method in methods:
        method_features(method)
    if isinstance(patches, Cards):
        return {method: CardFits(patches, method) for method in methods}
    collected = durable(_by_image(patches), "image-patches")
    return {method: _solved(collected, method) for method in methods}


def _known(patches: DataFrame) -> DataFrame:
    """Patches of the card, with the types that packing needs."""
    return patches.filter(F.col("patch_idx").isin(*range(len(REFERENCE_PATCHES)))).select(
        "image_id", F.col("patch_idx").cast("int").alias("patch_idx"), *[F.col(c).cast("double").alias(c) for c in ("r", "g", "b")]
    )


def _patch_means(sizes: np.ndarray, patch_idx: np.ndarray, rgb: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean colours (images, 24, 3) of rows that come image by image, and which of the patches have rows.

    As in SQL, a mean leaves nulls out; that of nulls alone is unknown. Channels are the first axis of rows.
    """
    slots = len(REFERENCE_PATCHES)
    cell = np.repeat(np.arange(len(sizes)) * slots, sizes) + patch_idx
    cells = len(sizes) * slots
    out = np.empty((cells, 3))
    with np.errstate(invalid="ignore"):
        for k in range(3):
            at, value = (cell, rgb[k]) if there[k].all() else (cell[there[k]], rgb[k][there[k]])
            out[:, k] = np.bincount(at, value, cells) / np.bincount(at, minlength=cells)
    return out.reshape(-1, slots, 3), (np.bincount(cell, minlength=cells) > 0).reshape(-1, slots)


def _channels(columns: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Channels along the first axis and where they are not null."""
    there = np.array([columns[c].is_valid().to_numpy(zero_copy_only=False) for c in ("r", "g", "b")])
    return np.array([columns[c].fill_null(np.nan).to_numpy(zero_copy_only=False) for c in ("r", "g", "b")]), there


def _by_image(patches: DataFrame) -> DataFrame:
    """(image_id, flat): the patches of an image with their references in one array.

    They are averaged per patch index, so at most 24 of them are left. Rows of
    an image are packed before they are dealt by image.
    """
    key_type = patches.schema["image_id"].dataType.simpleString()
    reference = np.array(REFERENCE_PATCHES, float)

    def meet(images: pa.RecordBatch, sizes: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        means, seen = _patch_means(sizes, columns["patch_idx"].to_numpy(), *_channels(columns))
        flat = np.concatenate([means, np.broadcast_to(reference, means.shape)], axis=2)
        offsets = np.append(0, np.cumsum(seen.sum(axis=1)) * 6)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[seen].ravel()))
        return pa.RecordBatch.from_arrays([images.column("image_id"), lists], names=["image_id", "flat"])

    packed = pack(_known(patches), ["image_id"])
    return map_groups(packed, ["image_id"], meet, f"image_id {key_type}, flat array<double>", nulls_meet=True)


def _coefficients(measured: np.ndarray, reference: np.ndarray, present: np.ndarray, method: str) -> np.ndarray:
    """(images, channels, features) from unit colours (images, 24, 3); rows of zeros stand for patches that are not present."""
    features, scale = METHODS[method]
    exponents = np.array(features)
    rescale = scale ** (1 - exponents.sum(axis=1).astype(float))
    x = _features(np.ascontiguousarray(np.moveaxis(measured, 2, 0)), exponents) * present
    return (_least_squares(x, reference) * rescale[None, :, None]).transpose(0, 2, 1)


def _solved(per_image: DataFrame, method: str) -> DataFrame:
    """Fits of many images together in each Arrow batch."""
    key_type = per_image.schema["image_id"].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = np.zeros((len(pdf), 24, 6))
            present = np.zeros((len(pdf), 24, 1))
            sizes = pdf["flat"].str.len().to_numpy() // 6
            image = np.repeat(np.arange(len(pdf)), sizes)
            slot = np.arange(len(image)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            values[image, slot] = np.concatenate(pdf["flat"].to_numpy()).reshape(-1, 6) / 255.0
            present[image, slot] = 1.0
            coef = _coefficients(values[:, :, :3], values[:, :, 3:], present, method)
            yield pd.DataFrame(
                {"image_id": pdf["image_id"], "method": method, "coef": [c.tolist() for c in coef]}
            )

    return per_image.mapInPandas(solve, f"image_id {key_type}, method string, coef array<array<double>>")


# --- whole cards --------------------------------------------------------------


@dataclass(frozen=True)
class CardBatch:
    """Patches of some images, one image after the other; channels are the first axis."""

    images: pa.Array
    sizes: np.ndarray
    patch_idx: np.ndarray
    rgb: np.ndarray
    there: np.ndarray  # where a channel is not null

    @cached_property
    def image(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @cached_property
    def means(self) -> tuple[np.ndarray, np.ndarray]:
        return _patch_means(self.sizes, self.patch_idx, self.rgb, self.there)

    def named(self) -> CardBatch:
        """Without patches of no image, which joins by image leave out as well."""
        if not self.images.null_count:
            return self
        keep = self.images.is_valid().to_numpy(zero_copy_only=False)
        rows = np.repeat(keep, self.sizes)
        return CardBatch(self.images.filter(pa.array(keep)), self.sizes[keep], self.patch_idx[rows], self.rgb[:, rows], self.there[:, rows])


@dataclass(frozen=True)
class Cards:
    """Packed patches, and the steps that tasks take one after the other with those of whole images.

    Fits, corrections and scores of an image need no other image: all of them are made where its patches
    meet, in one shuffle without joins.
    """

    packed: DataFrame
    steps: tuple[Callable[[CardBatch], CardBatch], ...] = ()


@dataclass(frozen=True)
class CardFits:
    """The fits of whole cards by one method, made where they are applied."""

    cards: Cards
    method: str


def cards(patches: DataFrame) -> Cards:
    """Patches for fits, corrections and scores that are all made in one go."""
    return Cards(pack(_known(patches), ["image_id"]))


def _card_coefficients(card: CardBatch, method: str) -> np.ndarray:
    """Of :class:`CardFits`."""
    means, seen = card.means
    present = seen[:, :, None].astype(float)
    reference = np.array(REFERENCE_PATCHES, float) / 255.0
    return _coefficients(np.where(seen[:, :, None], means, 0.0) / 255.0, reference * present, present, method)


def _corrected_card(card: CardBatch, coef: np.ndarray, method: str, truncate: bool) -> CardBatch:
    features, scale = METHODS[method]
    exponents, unit = np.array(features), 255.0 / scale
    x = _features(card.rgb / unit, exponents)
    value, starts = np.empty((len(x), 3)), np.cumsum(card.sizes) - card.sizes
    for size in np.unique(card.sizes):
        which = np.flatnonzero(card.sizes == size)
        at = slice(None) if len(which) == len(card.sizes) else (starts[which, None] + np.arange(size)).ravel()
        value[at] = (x[at].reshape(len(which), size, -1) @ coef[which].transpose(0, 2, 1)).reshape(-1, 3)
    # As in SQL, a number beyond a limit gives the limit, one that is no number the upper and a null the lower.
    value = np.ascontiguousarray((value * unit).T)
    value = np.minimum(np.maximum(value, 0.0), 255.0)
    if not card.there.all():
        value[:, ~card.there[exponents.any(axis=0)].all(axis=0)] = 0.0
    value[np.isnan(value)] = 255.0
    return replace(card, rgb=np.floor(value) if truncate else value, there=np.ones_like(card.there))


def _card_scores(card: CardBatch, space: str) -> tuple[pa.Array, pa.Array]:
    """Images and their mean colour differences."""
    reference, rgb = np.array(REFERENCE_PATCHES, float).T, card.rgb
    if space != "rgb":
        reference, rgb = lab_values(reference), lab_values(rgb)
    delta = np.sqrt(((rgb - reference[:, card.patch_idx]) ** 2).sum(axis=0))
    image, known = card.image, card.there.all(axis=0)
    if not known.all():
        image, delta = image[known], delta[known]
    n = np.bincount(image, minlength=len(card.sizes))
    total = np.bincount(image, delta, len(card.sizes))
    return card.images, pa.array(total / np.maximum(n, 1), mask=n == 0)


def _score_cards(variants: dict[str, Cards], space: str) -> DataFrame:
    """(image_id, method, mean_delta_e) of corrections of the same cards, whose patches meet once."""
    packed = next(iter(variants.values())).packed
    if any(variant.packed is not packed for variant in variants.values()):
        raise ValueError("corrections of other cards")
    steps = {method: variant.steps for method, variant in variants.items()}

    def scores(images: pa.RecordBatch, sizes: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        patch_idx, (rgb, there) = columns["patch_idx"].to_numpy(), _channels(columns)
        ends, found = np.append(0, np.cumsum(sizes)), []
        for i in range(0, len(sizes), CHUNK_CARDS):
            few = sizes[i : i + CHUNK_CARDS]
            rows = slice(ends[i], ends[i + len(few)])
            card = CardBatch(images.column("image_id").slice(i, len(few)), few, patch_idx[rows], rgb[:, rows], there[:, rows])
            for method in steps:
                scored, means = _card_scores(reduce(lambda done, step: step(done), steps[method], card), space)
                found.append((scored, pa.repeat(method, len(scored)), means))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found)], names=["image_id", "method", "mean_delta_e"])

    key_type = packed.schema["image_id"].dataType.simpleString()
    return map_groups(packed, ["image_id"], scores, f"image_id {key_type}, method string, mean_delta_e double", nulls_meet=True)


def coefficients(transforms: DataFrame) -> DataFrame:
    """Long form: (image_id, method, channel, feature, coef)."""
    return (
        transforms.select("image_id", "method", F.posexplode("coef").alias("channel", "_row"))
        .select("image_id", "method", "channel", F.posexplode("_row").alias("feature", "coef"))
    )


def apply_transform(
    pixels: DataFrame | Cards, transforms: DataFrame | CardFits, method: str = "linear", truncate: bool = True
) -> DataFrame | Cards:
    """Corrected r, g, b of every pixel, clipped to 0..255 and truncated. Whole cards take the fits made of them.

    Sizes of exploded rows and of fits are estimated far too low, so neither side may be broadcast by estimate.
    The products are added over arrays: written out, those of 20 features make code too long to be compiled.
    """
    if isinstance(pixels, Cards):
        if not isinstance(transforms, CardFits) or transforms.cards is not pixels or transforms.method != method:
            raise ValueError("cards are corrected by their own fits")
        step = lambda card: _corrected_card(card, _card_coefficients(card, method), method, truncate)
        return replace(pixels, steps=(*pixels.steps, CardBatch.named, step))
    features, scale = METHODS[method]
    unit = 255.0 / scale
    chosen = transforms.filter(F.col("method") == method).select("image_id", "coef")
    joined = pixels.join(chosen.hint("merge"), "image_id").select(
        "*", *[(F.col(c).cast("double") / unit).alias(f"_{c}") for c in ("r", "g", "b")]
    )
    joined = joined.withColumn("_t", F.array(*[feature(e, F.col("_r"), F.col("_g"), F.col("_b")) for e in features]))
    out = {}
    for k, channel in enumerate(("r", "g", "b")):
        products = F.zip_with(F.col("coef")[k], F.col("_t"), lambda c, t: c * t)
        value = F.aggregate(products, F.lit(0.0), lambda total, x: total + x) * unit
        out[channel] = to_byte(value) if truncate else F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))
    kept = [F.col(c) if c not in out else out[c].alias(c) for c in pixels.columns]
    return joined.select(*kept)


def patch_delta_e(patches: DataFrame, space: str = "lab") -> DataFrame:
    """Colour difference of each patch from its reference (Lab, or plain RGB on request)."""
    joined = with_reference(patches)
    if space == "rgb":
        a, b = ("r", "g", "b"), ("ref_r", "ref_g", "ref_b")
    else:
        a, b = ("_l", "_a", "_b"), ("_rl", "_ra", "_rb")
        joined = add_lab(add_lab(joined, "r", "g", "b", a), "ref_r", "ref_g", "ref_b", b)
    diff = delta_e(tuple(F.col(c) for c in a), tuple(F.col(c) for c in b))
    return joined.select(*patches.columns, diff.alias("delta_e"))


def mean_delta_e(patches: DataFrame | Cards, space: str = "lab", by=("image_id",)) -> DataFrame:
    if isinstance(patches, Cards):
        if tuple(by) != ("image_id",):
            raise ValueError("cards are scored by image")
        return _score_cards({"": patches}, space).drop("method")
    return patch_delta_e(patches, space).groupBy(*by).agg(F.avg("delta_e").alias("mean_delta_e"))


def mean_delta_e_each(variants: dict[str, DataFrame] | dict[str, Cards], space: str = "lab") -> DataFrame:
    """(image_id, method, mean_delta_e): :func:`mean_delta_e` of each correction, by the name of its method."""
    if all(isinstance(variant, Cards) for variant in variants.values()):
        return _score_cards(variants, space)
    scored = [mean_delta_e(variant, space).withColumn("method", F.lit(method)) for method, variant in variants.items()]
    return reduce(DataFrame.unionByName, scored).select("image_id", "method", "mean_delta_e")
