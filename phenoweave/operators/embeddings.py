"""Embedding statistics, clustering and cluster composition."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from phenoweave.operators.graph import connected_components
from phenoweave.operators.ordering import positions
from phenoweave.operators.runs import smallest_labels
from phenoweave.operators.topk import most_common, top_k_per_group
from phenoweave.session import durable

NOISE = -1
TILE_ROWS = 512
STRIP_ROWS = 2_048  # that TILE_ROWS rows of a tile are compared with at once
BLOCKS = 24  # that the points of a large cell are dealt to: each point is copied as often, whatever their number,
BLOCK_ENTRIES = 2**21  # unless a block would hold more numbers than these
DEALT_ROWS = 4_096  # points that one task copies
PIVOTS = 8  # of a cell that DBSCAN's metric tree splits
SEED_ROWS = 2_000  # rows that first centres of k-means are drawn from
WHOLE_BITS = 30  # bits of the largest entry as a whole number, for sums that do not depend on their order
WORTH = 0.8  # share of a cell's distances that a split may leave


def global_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Count, dimension and mean / population deviation / min / max over all entries."""
    entries = df.select(F.size(vector).alias("_d"), F.posexplode(vector).alias("_i", "_x"))
    x = F.col("_x").cast("double")
    return entries.agg(
        F.count_if(F.col("_i") == 0).cast("bigint").alias("num_samples"),
        F.max("_d").alias("embedding_dim"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


# --- clustering -----------------------------------------------------------


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))


def _ordered_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors dealt out and sorted by key, written once: fits do not depend on the input's layout."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(_vectors(df, key, vector).repartition(n, key).sortWithinPartitions(key), "vectors")


def _labels(predicted: DataFrame, key: str) -> DataFrame:
    """Cluster numbers in the order of the clusters' smallest keys."""
    first = predicted.groupBy("prediction").agg(F.min(key).alias("_first"))
    # One row per cluster: their number is a parameter.
    ranked = first.select("prediction", (F.row_number().over(Window.orderBy("_first")) - 1).cast("int").alias("cluster"))
    return predicted.join(F.broadcast(ranked), "prediction").select(key, "cluster")


def _first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k different points of the sample, each drawn with a chance in proportion to its squared distance from those before."""
    random = np.random.default_rng(seed)
    chosen = [int(random.integers(len(sample)))]
    gap = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and gap.any():
        chosen.append(int(np.searchsorted(np.cumsum(gap), random.random() * gap.sum(), "right").clip(0, len(sample) - 1)))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, each the same whatever other rows are there."""
    out = np.zeros((len(points), len(centres)))
    for i in range(points.shape[1]):
        out += (points[:, i, None] - centres[None, :, i]) ** 2
    return out


def _advance(data: DataFrame, starts: list[np.ndarray], unit: float) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """Per start the sums and sizes of the clusters of its centres, and the cost; one scan for all starts.

    Sums are of whole multiples of ``unit``, so that neither the layout nor the order of the rows matters.
    """
    shared = data.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["vec"])
            whole = np.rint(x / unit).astype(np.int64)
            for start, centres in enumerate(shared.value):
                gaps = _squares(x, centres)
                near = gaps.argmin(1)
                sizes = np.bincount(near, minlength=len(centres))
                sums = np.zeros((len(centres), x.shape[1]), np.int64)
                np.add.at(sums, near, whole)
                # A row per cluster: its sums, its size and its share of the cost.
                cost = np.zeros(len(centres), np.int64)
                np.add.at(cost, near, np.rint(gaps[np.arange(len(x)), near] / (unit * unit) / 2.0**20).astype(np.int64))
                totals = np.concatenate([sums, sizes[:, None], cost[:, None]], 1)
                yield pd.DataFrame({"start": start, "cluster": np.arange(len(centres)), "totals": list(totals)})

    parts = data.select("vec").mapInPandas(run, "start int, cluster int, totals array<bigint>")
    each = parts.select("start", "cluster", F.posexplode("totals").alias("i", "total"))
    rows = each.groupBy("start", "cluster", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    dimension = starts[0].shape[1]
    out = [np.zeros((len(c), dimension + 2), object) for c in starts]
    for r in rows:
        out[r["start"]][r["cluster"], r["i"]] = int(r["total"])
    shared.unpersist()
    return [o[:, :dimension] for o in out], [o[:, dimension] for o in out], [int(o[:, dimension + 1].sum()) for o in out]


def kmeans_centres(
    df: DataFrame, key: str, vector: str = "embedding", n_clusters: int = 5, seed: int = 42, n_init: int = 10,
    max_iter: int = 300, tol: float = 1e-4,
) -> np.ndarray:
    """Cluster means of lowest cost among ``n_init`` starts; every iteration is one scan for all starts that still move.

    The first centres are drawn from the ``SEED_ROWS`` rows whose keys have the smallest hashes. The means do not depend on
    the layout of the data or on the number of partitions.
    """
    data = df.select(key, F.col(vector).cast("array<double>").alias("vec"))
    sample = [r["vec"] for r in data.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(SEED_ROWS).select("vec").collect()]
    if not sample:
        return np.zeros((0, 0))
    largest = data.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))).head()[0] or 1.0
    unit = 2.0 ** (math.frexp(largest)[1] - WHOLE_BITS)
    starts = [_first_centres(np.array(sample), n_clusters, seed + i) for i in range(n_init)]
    moving, costs = list(range(n_init)), [0] * n_init
    for _ in range(max_iter):
        sums, sizes, cost = _advance(data, [starts[i] for i in moving], unit)
        still = []
        for i, total, n, c in zip(moving, sums, sizes, cost):
            costs[i] = c
            # A cluster without points keeps its centre.
            means = np.array([[t * unit / m for t in row] if m else old for row, m, old in zip(total.tolist(), n.tolist(), starts[i].tolist())])
            if ((means - starts[i]) ** 2).sum(1).max() > tol * tol:
                still.append(i)
            starts[i] = means
        moving = still
        if not moving:
            break
    return starts[min(range(n_init), key=lambda i: (costs[i], i))]


def nearest_centres(df: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """(key, prediction): the nearest centre of each row, the first of equals."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "prediction": _squares(np.stack(pdf["vec"]), shared.value).argmin(1)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(vector).cast("array<double>").alias("vec")).mapInPandas(run, f"`{key}` {kind}, prediction int")


def kmeans(df: DataFrame, key: str, vector: str = "embedding", n_clusters: int = 5, seed: int = 42, n_init: int = 10, **options) -> DataFrame:
    """(key, cluster) by :func:`kmeans_centres`."""
    data = durable(df.select(key, F.col(vector).alias(vector)), "kmeans-vectors")
    centres = kmeans_centres(data, key, vector, n_clusters, seed, n_init, **options)
    if not len(centres):
        return data.select(key, F.lit(None).cast("int").alias("cluster"))
    return _labels(durable(nearest_centres(data, key, vector, centres), "kmeans-labels"), key)


def gaussian_mixture(
    df: DataFrame, key: str, vector: str = "embedding", n_clusters: int = 5, seed: int = 42, components: int | None = None
):
    """Gaussian mixture with full covariances over all dimensions, or over ``components`` principal ones."""
    if components is not None:
        df, vector = principal_components(df, key, vector, components)[0], "components"
    data = _ordered_vectors(df, key, vector)
    if data.isEmpty():
        return data.select(key, F.lit(None).cast("int").alias("cluster"))
    return _labels(GaussianMixture(k=n_clusters, seed=seed).fit(data).transform(data), key)


def hierarchical(df: DataFrame, key: str, vector: str = "embedding", n_clusters: int = 5, seed: int = 42):
    """Top-down hierarchical clustering; labels differ from a bottom-up tree's."""
    data = _vectors(df, key, vector)
    return _labels(BisectingKMeans(k=n_clusters, seed=seed).fit(data).transform(data), key)


def principal_components(df: DataFrame, key: str, vector: str = "embedding", k: int = 2):
    """(scores, ratios): centred components per row, and the explained-variance table.

    The sign of a component makes its largest loading positive.
    """
    data = df.select(key, F.col(vector).cast("array<double>").alias("vec"))
    first = data.select("vec").head()
    ratios_schema = "component int, explained_variance_ratio double"
    if first is None:
        return (
            data.select(key, F.lit(None).cast("array<double>").alias("components")),
            df.sparkSession.createDataFrame([], ratios_schema),
        )
    mean, covariance = _covariance(data)
    k = min(k, len(mean))
    variance, axes = np.linalg.eigh(covariance)
    variance, loadings = np.maximum(variance[::-1], 0.0), axes[:, ::-1][:, :k]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "components": list((np.stack(pdf["vec"]) - mean) @ loadings)})

    out = data.mapInPandas(project, f"`{key}` {df.schema[key].dataType.simpleString()}, components array<double>")
    total = variance.sum()
    ratios = df.sparkSession.createDataFrame(
        [(i + 1, float(variance[i] / total) if total else float("nan")) for i in range(k)], ratios_schema
    )
    return out, ratios


def _covariance(data: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of ``vec``; every task adds up one matrix, of entries centred by the mean."""
    d = len(data.select("vec").head()[0])

    def total(batches: Iterator[pd.DataFrame], centre: np.ndarray, power: int) -> Iterator[pd.DataFrame]:
        rows, out = 0, np.zeros(d if power == 1 else d * d)
        for pdf in batches:
            x = np.stack(pdf["vec"]) - centre
            rows, out = rows + len(x), out + (x.sum(0) if power == 1 else (x.T @ x).ravel())
        yield pd.DataFrame({"n": [rows], "totals": [out]})

    def added(centre: np.ndarray, power: int) -> tuple[int, np.ndarray]:
        parts = data.select("vec").mapInPandas(lambda batches: total(batches, centre, power), "n bigint, totals array<double>")
        each = parts.select("n", F.posexplode("totals").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        # The size of one matrix.
        sums = each.orderBy("i").collect()
        return sums[0]["n"], np.array([r["x"] for r in sums])

    n, sums = added(np.zeros(d), 1)
    mean = sums / n
    return mean, added(mean, 2)[1].reshape(d, d) / max(n - 1, 1)


def _dimension_free_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise Euclidean distances without forming an n x m x d array."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(out)


def _entries(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors).astype(float)


class _Near:
    """Which rows of two tables are within ``eps``.

    By inner products in single precision; where these could be wrong by exact sums, or where that is often, by
    inner products in double precision before.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, eps: float):
        self.sides, self.eps = (a, b), eps
        finite = [np.isfinite(side).all(1) for side in self.sides]
        shift = a[finite[0]].mean(0) if finite[0].any() else np.zeros(a.shape[1])
        reach = np.abs(shift).max(initial=0.0) + max(np.abs(side[ok]).max(initial=0.0) for side, ok in zip(self.sides, finite))
        x, y = (np.where(ok[:, None], side - shift, 0.0) for side, ok in zip(self.sides, finite))
        # No entry is beyond 1, so that squares are within the range of single precision.
        unit = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0), eps) or 1.0
        x, y, limit = x / unit, y / unit, (eps / unit) ** 2
        # A row with an entry that is no finite number is near to none.
        sizes = [np.where(ok, (side * side).sum(1), np.inf)[:, None] for side, ok in zip((x, y), finite)]
        # The inner product of two such rows is their squared distance less that of eps.
        self.forms = {np.float64: (np.hstack([-2 * x, sizes[0], np.ones_like(sizes[0])]), np.hstack([y, np.ones_like(sizes[1]), sizes[1] - limit]))}
        self.forms[np.float32] = tuple(side.astype(np.float32) for side in self.forms[np.float64])
        # Far above the rounding of the inner products and of the shifted entries.
        largest = 2 * sum(size[ok].max(initial=0.0) for size, ok in zip(sizes, finite)) + limit
        moved = 1e-13 * a.shape[1] * (reach / unit) ** 2
        slack = lambda kind: max(2 * (a.shape[1] + 8) * float(np.finfo(kind).eps), 1e-9) * largest + moved
        self.slack = {kind: slack(kind) if math.isfinite(eps) else math.nan for kind in self.forms}

    def table(self, rows: np.ndarray | slice, cols: np.ndarray | slice) -> np.ndarray:
        """Whether each of these rows of the first table is near each of those of the second."""
        for kind in (np.float32, np.float64):
            left, right = self.forms[kind]
            gap = left[rows] @ right[cols].T
            # Not-a-numbers are unsure as well.
            close = ~(gap > self.slack[kind])
            at = np.flatnonzero(close)
            unsure = at[~(gap.ravel()[at] < -self.slack[kind])]
            if len(unsure) <= gap.size / 64:
                break
        a, b = self.sides[0][rows], self.sides[1][cols]
        for k in range(0, len(unsure), TILE_ROWS * TILE_ROWS):
            few = unsure[k : k + TILE_ROWS * TILE_ROWS]
            u, v = np.divmod(few, gap.shape[1])
            out = np.zeros(len(few))
            for c in range(a.shape[1]):
                out += (a[u, c] - b[v, c]) ** 2
            close.flat[few] = np.sqrt(out) <= self.eps
        return close


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs are within ``eps``."""
    return _Near(a, b, eps).table(slice(None), slice(None))


def _cells(points: DataFrame, eps: float) -> DataFrame:
    """(cell, id, weight, vec, home, gap): the leaves of a metric tree, each point at home in one of them.

    A cell is split at a few of its points, the pivots; a point goes to the nearest. Another point within ``eps`` of it
    is at most that far beyond the plane midway between both their pivots, so points so near to a plane are put
    into the cell behind it as well, as guests: all neighbours of a point are in its home cell. A split is made only where it
    saves distances, which wide neighbourhoods in many dimensions do not. ``gap`` is the distance to the cell's pivot.
    """
    key = points.schema["id"].dataType.simpleString()
    schema = f"cell string, id {key}, weight bigint, vec {points.schema['vec'].dataType.simpleString()}, home boolean, gap double"
    columns = ["cell", "id", "weight", "vec", "home", "gap"]

    def placed(pdf: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
        """Per cell its rows, their distances to the pivots, the pivots they belong to and the nearest one."""
        for cell, rows in pdf.groupby("cell", sort=False):
            pivots = np.stack(rows["pivots"].iloc[0]).astype(float)
            gaps, apart = _dimension_free_distance(_entries(rows["vec"]), pivots), _dimension_free_distance(pivots, pivots)
            own = gaps.argmin(1)
            square = gaps * gaps
            # Twice the distance to the plane, times that of the pivots; a hair more, for the rounding.
            member = square - square.min(1, keepdims=True) <= 2 * eps * (1 + 1e-9) * apart[own] + 1e-12 * square
            yield cell, rows, gaps, member, np.arange(gaps.shape[1]) == own[:, None]

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, rows, _, member, nearest in placed(pdf):
                homes = (nearest & rows["home"].to_numpy(bool)[:, None]).sum(0)
                yield pd.DataFrame({"cell": cell, "sub": np.arange(len(homes)), "homes": homes, "rows": member.sum(0)})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, rows, gaps, member, nearest in placed(pdf):
                at, sub = np.nonzero(member)
                out = rows.iloc[at][["id", "weight", "vec"]].assign(cell=[f"{cell}/{j}" for j in sub], gap=gaps[at, sub])
                yield out.assign(home=rows["home"].to_numpy(bool)[at] & nearest[at, sub])[columns]

    current = points.select(F.lit("").alias("cell"), "id", "weight", "vec", F.lit(True).alias("home"), F.lit(float("inf")).alias("gap"))
    work = lambda homes, rows: F.col(homes) * (F.col(rows) - F.col(homes) / 2)
    leaves: list[DataFrame] = []
    while True:
        counted = current.groupBy("cell").agg(F.count_if("home").cast("bigint").alias("homes"), F.count(F.lit(1)).alias("rows"))
        big = durable(counted.filter(F.col("rows") > TILE_ROWS), "dbscan-big")
        if big.isEmpty():
            leaves.append(current)
            break
        order = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(len(leaves))), "id")
        drawn = current.filter("home").join(big.select("cell"), "cell", "left_semi").withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= PIVOTS)
        pivots = durable(drawn.groupBy("cell").agg(F.collect_list("vec").alias("pivots")), "dbscan-pivots")
        ready = current.join(pivots, "cell")
        subs = ready.mapInPandas(sizes, "cell string, sub int, homes bigint, rows bigint").groupBy("cell", "sub").agg(F.sum("homes").alias("h"), F.sum("rows").alias("r"))
        after = subs.groupBy("cell").agg(F.sum(work("h", "r")).alias("_after"))
        better = durable(after.join(big, "cell").filter(F.col("_after") < WORTH * work("homes", "rows")).select("cell"), "dbscan-splits")
        leaves.append(current.join(better, "cell", "left_anti"))
        if better.isEmpty():
            break
        parts = durable(ready.join(better, "cell", "left_semi").mapInPandas(split, schema), "dbscan-cells")
        # Guests alone ask nothing.
        current = parts.join(parts.filter("home").select("cell").distinct(), "cell", "left_semi")
    return functools.reduce(DataFrame.unionByName, [x.select(*columns) for x in leaves])


def _blocks(points: DataFrame, eps: float) -> DataFrame:
    """The rows of :func:`_cells` with their ``block`` and the numbers of blocks of their leaf, ``homes`` and ``guests``.

    The home points of a leaf form blocks of about ``TILE_ROWS``, its guests too, but no more than ``BLOCKS`` unless
    they grew beyond ``BLOCK_ENTRIES``: what is sent grows with the points, not with their square.
    """
    cells = durable(_cells(points, eps), "dbscan-cells")
    blocks = lambda n: F.greatest(
        F.least(F.ceil(F.col(n) / TILE_ROWS), F.lit(BLOCKS)), F.ceil(F.col(n) * F.col("entries") / BLOCK_ENTRIES)
    )
    sizes = cells.groupBy("cell").agg(
        F.count_if("home").alias("n"), F.count_if(~F.col("home")).alias("g"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("entries")
    ).select("cell", blocks("n").alias("homes"), blocks("g").alias("guests"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests")))
    # The copies are made by many tasks, not by the few that read the file.
    return cells.join(sizes, "cell").withColumn("block", block).repartition(1 + cells.count() // DEALT_ROWS, "id")


def _tiles(points: DataFrame, eps: float) -> DataFrame:
    """(tile, side, itself, own, id, weight, vec, gap): points dealt to the pairs of blocks they meet."""
    return _meetings(_blocks(points, eps))


def _meetings(blocks: DataFrame, *more: str) -> DataFrame:
    """The tiles of :func:`_blocks`, with ``more`` of its columns.

    Two home blocks meet once, a block also itself; a home block meets every guest block, where only its own
    points ask (``own``).
    """
    until = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    place = lambda kind, a, b, side: F.struct(
        F.concat_ws(":", "cell", F.lit(kind), a, b).alias("tile"), F.lit(side).alias("side"), (F.lit(kind == "home") & (a == b)).alias("itself")
    )
    block = F.col("block")
    among = F.transform(
        until(F.col("homes")),
        lambda other: F.when(other >= block, place("home", block, other, 0)).otherwise(place("home", other, block, 1)),
    )
    asks = F.transform(until(F.col("guests")), lambda other: place("guest", block, other, 0))
    answers = F.transform(until(F.col("homes")), lambda other: place("guest", other, block, 1))
    meets = F.explode(F.when(F.col("home"), F.concat(among, asks)).otherwise(answers))
    return blocks.withColumn("_t", meets).select("_t.tile", "_t.side", "_t.itself", F.col("home").alias("own"), "id", "weight", "vec", "gap", *more)


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool] | None:
    """Both sides of a tile and whether they are one block, which meets itself once. None where a side has no points."""
    a = pdf[pdf["side"] == 0]
    itself = bool(pdf["itself"].iloc[0])
    b = a if itself else pdf[pdf["side"] == 1]
    return None if a.empty or b.empty else (a, b, itself)


def _all_close(a: pd.DataFrame, b: pd.DataFrame, eps: float) -> bool:
    """Whether both sides are so near the cell's pivot that no pair can be further apart."""
    return bool(a["gap"].max() + b["gap"].max() <= eps * (1 - 1e-9))


def _strips(rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(rows), TILE_ROWS):
        for j in range(0, len(cols), STRIP_ROWS):
            yield rows[i : i + TILE_ROWS], cols[j : j + STRIP_ROWS]


def _neighbours(a: pd.DataFrame, b: pd.DataFrame, eps: float, enough: int, answers: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the neighbours among b of each point of a, and where b asks as well (``answers``) the other way round.

    What is beyond ``enough`` need not be counted: points that have so much are only compared with those that have less.
    """
    left, right = (side["weight"].to_numpy(np.int64) for side in (a, b))
    if _all_close(a, b, eps):
        return np.full(len(a), right.sum()), np.full(len(b), left.sum())
    near = _Near(_entries(a["vec"]), _entries(b["vec"]), eps)
    n, m = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    for rows, cols in _strips(np.arange(len(a)), np.arange(len(b))):
        short, behind = n[rows] < enough, answers & (m[cols] < enough)
        for u, v in ((rows[short], cols), (rows[~short], cols[behind])):
            if len(u) and len(v):
                i, j = np.nonzero(near.table(u, v))
                n += np.bincount(u[i], right[v[j]], len(a)).astype(np.int64)
                m += np.bincount(v[j], left[u[i]], len(b)).astype(np.int64)
    return n, m


def _reached(a: pd.DataFrame, b: pd.DataFrame, itself: bool, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A label per point, equal for core points that reach each other in the tile; and the pairs (other point, core point).

    Points are numbered through a and, unless they are one block, b. Core points that reach each other already
    are not compared.
    """
    first, size = len(a), len(a) if itself else len(a) + len(b)
    core = a["core"].to_numpy(bool) if itself else np.concatenate([a["core"].to_numpy(bool), b["core"].to_numpy(bool)])
    shift = 0 if itself else first
    places = np.arange(first), np.arange(shift, size)
    near = None if _all_close(a, b, eps) else _Near(_entries(a["vec"]), _entries(b["vec"]), eps)

    def met(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(u) or not len(v):
            return u[:0], v[:0]
        i, j = np.nonzero(np.ones((len(u), len(v)), bool) if near is None else near.table(u, v - shift))
        return u[i], v[j]

    label, edges, held = np.arange(size), [], 0
    rows, cols = (p[core[p]] for p in places)
    for u, v in _strips(rows, cols):
        known, times = np.unique(label[np.concatenate([u, v])], return_counts=True)
        most = known[times.argmax()]
        in_u, in_v = label[u] == most, label[v] == most
        for x, y in (met(u[~in_u], v), met(u[in_u], v[~in_v])):
            apart = label[x] != label[y]
            if apart.any():
                edges.append((label[x[apart]], label[y[apart]]))
                held += len(edges[-1][0])
        if held >= STRIP_ROWS:
            label, edges, held = smallest_labels(size, *map(np.concatenate, zip(*edges)))[label], [], 0
    if edges:
        label = smallest_labels(size, *map(np.concatenate, zip(*edges)))[label]

    fringe = [met(u, v) for u, v in _strips(places[0][~core[places[0]]], cols)]
    # Guests ask in their own cell.
    if not itself and b["own"].iloc[0]:
        fringe += [met(u, v)[::-1] for u, v in _strips(rows, places[1][~core[places[1]]])]
    return label, *(np.concatenate([places[0][:0], *(pair[k] for pair in fringe)]) for k in (0, 1))


def dbscan(df: DataFrame, key: str, vector: str = "embedding", eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Exact DBSCAN: (key, cluster), noise -1, clusters numbered by their first core key.

    Identical vectors become one weighted point. Each tile of two blocks returns
    neighbour counts first, then a spanning star per group of mutually reachable
    core points and the few core neighbours of each non-core point; no list of
    close pairs is ever written.
    """
    key_type = df.schema[key].dataType.simpleString()
    # Floats are sent as such and become doubles where they are compared.
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    vectors = df.select(key, F.col(vector).cast(kind).alias("vec"))
    points = durable(
        vectors.groupBy("vec").agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("weight")), "dbscan-points"
    )
    blocks = _blocks(points, eps)

    def count_neighbours(pdf: pd.DataFrame) -> pd.DataFrame:
        met = _sides(pdf)
        if met is None:
            return pd.DataFrame({"id": [], "n": []})
        a, b, itself = met
        answers = not itself and bool(b["own"].iloc[0])
        n, m = _neighbours(a, b, eps, min_samples, answers)
        out = pd.DataFrame({"id": a["id"].to_numpy(), "n": n})
        return pd.concat([out, pd.DataFrame({"id": b["id"].to_numpy(), "n": m})]) if answers else out

    counts = _meetings(blocks).groupBy("tile").applyInPandas(count_neighbours, f"id {key_type}, n bigint")
    cores = durable(
        counts.groupBy("id").agg((F.sum("n") >= min_samples).alias("core")), "dbscan-cores"
    )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        met = _sides(pdf)
        if met is None:
            return pd.DataFrame({"src": [], "dst": [], "border": []})
        a, b, itself = met
        ids = a["id"].to_numpy() if itself else np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])
        label, other, core = _reached(a, b, itself, eps)
        star = np.flatnonzero(label != np.arange(len(ids)))
        links = np.concatenate([star, other]), np.concatenate([label[star], core])
        return pd.DataFrame({"src": ids[links[0]], "dst": ids[links[1]], "border": np.arange(len(links[0])) >= len(star)})

    links = durable(
        _meetings(blocks.join(cores, "id"), "core")
        .groupBy("tile")
        .applyInPandas(link, f"src {key_type}, dst {key_type}, border boolean"),
        "dbscan-links",
    )
    joined = connected_components(links.filter("not border").select("src", "dst"))
    roots = (
        cores.filter("core")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select("id", F.coalesce("component", "id").alias("root"))
    )
    numbered = positions(roots.select("root").distinct(), [], ["root"], "cluster")
    core_labels = roots.join(numbered, "root").select("id", "cluster")
    border_labels = (
        links.filter("border")
        .join(core_labels.select(F.col("id").alias("dst"), "cluster"), "dst")
        .groupBy(F.col("src").alias("id"))
        .agg(F.min("cluster").alias("cluster"))
    )
    labelled = points.join(core_labels.unionByName(border_labels), "id", "left").select(
        "vec", F.coalesce("cluster", F.lit(NOISE)).cast("int").alias("cluster")
    )
    return vectors.join(labelled, "vec").select(key, "cluster")


CLUSTERERS: dict[str, Callable[..., DataFrame]] = {
    "kmeans": kmeans,
    "gmm": gaussian_mixture,
    "hierarchical": hierarchical,
    "dbscan": dbscan,
}


def cluster(df: DataFrame, method: str, key: str, vector: str = "embedding", **parameters) -> DataFrame:
    """(key, method, cluster) by the named method."""
    if method not in CLUSTERERS:
        raise ValueError(f"unknown clustering method: {method}")
    return CLUSTERERS[method](df, key, vector, **parameters).select(
        key, F.lit(method).alias("method"), "cluster"
    )


# --- composition ----------------------------------------------------------


def without_noise(clusters: DataFrame) -> DataFrame:
    return clusters.filter(F.col("cluster") != NOISE)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Size per cluster, noise included, with the number of real clusters."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("images"))
    n = sizes.agg(F.count_if(F.col("cluster") != NOISE).cast("bigint").alias("n"))
    return sizes.withColumn("n_clusters", n.scalar())


def cluster_composition(clusters: DataFrame) -> DataFrame:
    """Size, share of all images and distinct genotypes per real cluster."""
    total = clusters.agg(F.count(F.lit(1)).alias("n"))
    per_pair = clusters.groupBy("cluster", "genotype").agg(F.count(F.lit(1)).alias("n"))
    return (
        without_noise(per_pair)
        .groupBy("cluster")
        .agg(F.sum("n").alias("images"), F.count("genotype").alias("genotypes"))
        .withColumn("percent", F.col("images") * 100.0 / total.scalar())
    )


def noise_summary(clusters: DataFrame) -> DataFrame:
    noise = F.count_if(F.col("cluster") == NOISE).cast("bigint")
    return clusters.agg(
        F.count(F.lit(1)).alias("images"),
        noise.alias("noise"),
        (noise * 100.0 / F.count(F.lit(1))).alias("noise_percent"),
    )


def top_genotypes_per_cluster(clusters: DataFrame, k: int = 5, label_length: int = 30) -> DataFrame:
    """The k most frequent genotypes of each cluster with their share of it."""
    pairs = without_noise(clusters).groupBy("cluster", "genotype").agg(F.count(F.lit(1)).alias("images"))
    sizes = pairs.groupBy("cluster").agg(F.sum("images").alias("size"))
    return (
        top_k_per_group(pairs, ["cluster"], "images", "genotype", k)
        .join(sizes, "cluster")
        .select(
            "cluster",
            "rank",
            F.substring(F.col("genotype").cast("string"), 1, label_length).alias("genotype"),
            "images",
            (F.col("images") * 100.0 / F.col("size")).alias("percent"),
        )
    )


def cluster_diversity(clusters: DataFrame) -> DataFrame:
    return without_noise(clusters).groupBy("cluster").agg(F.count_distinct("genotype").alias("genotypes"))


def contingency(clusters: DataFrame, cluster_ids: Sequence[int], k: int = 15) -> DataFrame:
    """Image counts of the k most common genotypes (rows) by cluster (columns c0, c1, ...)."""
    top = most_common(clusters, "genotype", k).select("genotype")
    counted = (
        clusters.join(top, "genotype", "left_semi")
        .groupBy("genotype")
        .pivot("cluster", list(cluster_ids))
        .agg(F.count(F.lit(1)))
    )
    return counted.select(
        "genotype", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"c{c}") for c in cluster_ids]
    )
