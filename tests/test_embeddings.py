import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phenoweave.operators import embeddings, graph


def brute_dbscan(points, eps, min_samples):
    n = len(points)
    close = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) <= eps
    core = close.sum(1) >= min_samples
    label = np.full(n, -1)
    cluster = 0
    for i in range(n):
        if not core[i] or label[i] != -1:
            continue
        stack, label[i] = [i], cluster
        while stack:
            p = stack.pop()
            for q in np.flatnonzero(close[p]):
                if label[q] == -1:
                    label[q] = cluster
                    if core[q]:
                        stack.append(q)
        cluster += 1
    return label


def frame(spark, points):
    pdf = pd.DataFrame({"id": np.arange(len(points)), "embedding": [p.tolist() for p in points]})
    return spark.createDataFrame(pdf, "id bigint, embedding array<double>")


@pytest.mark.parametrize("tile_rows", [7, 512])
def test_dbscan_equals_brute_force(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(embeddings, "TILE_ROWS", tile_rows)
    rng = np.random.default_rng(9)
    blobs = [rng.normal(c, 0.25, (25, 3)) for c in ((0, 0, 0), (2, 0, 0), (0, 3, 1))]
    copies = np.repeat(rng.normal(1, 1, (2, 3)), [40, 3], axis=0)  # a third of the rows are copies
    points = np.vstack([*blobs, copies, rng.uniform(-3, 5, (20, 3))])
    points = points[rng.permutation(len(points))]
    got = embeddings.cluster(frame(spark, points), "dbscan", "id", eps=0.4, min_samples=5).orderBy("id").toPandas()
    want = brute_dbscan(points, 0.4, 5)
    # Numbering by first core key; border points take the smallest cluster, as in the sequential scan.
    assert got.cluster.tolist() == want.tolist()
    assert -1 in want and want.max() >= 2


def evaluated(points, eps):
    """Distances that the tiles of these points take, those to pivots left out."""
    rows = points.select(F.col("embedding").alias("vec"), "id", F.lit(1).cast("bigint").alias("weight"))
    near, far = (F.when(F.col("side") == k, F.col("gap")) for k in (0, 1))
    sides = embeddings._tiles(rows, eps).groupBy("tile", "itself").agg(F.count(near).alias("a"), F.count(far).alias("b"), F.max(near).alias("ga"), F.max(far).alias("gb"))
    return sum(
        0 if (r.ga or 0) + ((r.ga if r.itself else r.gb) or 0) <= eps * (1 - 1e-9) else r.a * (r.a - 1) // 2 if r.itself else r.a * r.b
        for r in sides.collect()
    )


def test_metric_tree_saves_distances(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE_ROWS", 64)
    rng = np.random.default_rng(2)
    sizes, taken = (800, 3200), []
    for n in sizes:
        centres = rng.normal(0, 4, (n // 80, 16))
        points = np.repeat(centres, 80, axis=0) + rng.normal(0, 0.2, (n, 16))
        taken.append(evaluated(frame(spark, points), 1.0))
        got = embeddings.dbscan(frame(spark, points), "id", eps=1.0, min_samples=5).orderBy("id").toPandas()
        assert got.cluster.tolist() == brute_dbscan(points, 1.0, 5).tolist()
    # Four times the points in clusters of the same size: nearly four times the distances, not sixteen.
    assert taken[0] < sizes[0] ** 2 / 4 and taken[1] < 6 * taken[0]
    # Points nearly as far from each other as eps: no split helps, every pair is taken once.
    sphere = rng.normal(0, 1, (700, 64))
    sphere /= np.linalg.norm(sphere, axis=1)[:, None]
    assert evaluated(frame(spark, sphere), 1.16) <= 700 * 700 / 2
    # Everything within reach of the pivot: counts without distances.
    assert evaluated(frame(spark, rng.normal(0, 1e-3, (400, 8))), 0.9) <= 400 * 400 / 2


def test_dbscan_without_core_points(spark):
    points = np.arange(12.0).reshape(4, 3) * 10
    got = embeddings.dbscan(frame(spark, points), "id", eps=0.5, min_samples=2).collect()
    assert [r["cluster"] for r in got] == [-1] * 4


def test_components_of_long_paths_and_hubs(spark):
    path = [(1, i, i + 1) for i in range(0, 400)]
    hub = [(2, 0, i) for i in range(1, 400)]
    pairs = [(3, 2 * i, 2 * i + 1) for i in range(50)]
    df = spark.createDataFrame(path + hub + pairs + path[:10], "k int, src bigint, dst bigint")
    rows = graph.connected_components(df, ["k"]).toPandas()
    assert (rows[rows.k == 1].component == 0).all() and len(rows[rows.k == 1]) == 401
    assert (rows[rows.k == 2].component == 0).all() and len(rows[rows.k == 2]) == 400
    third = rows[rows.k == 3]
    assert (third.component == third.node // 2 * 2).all() and len(third) == 100


def test_kmeans_and_relatives_find_separate_blobs(spark):
    rng = np.random.default_rng(1)
    truth = np.repeat([0, 1, 2], 40)
    points = np.array([(0, 0, 0, 0), (9, 0, 9, 0), (0, 9, 0, 9)])[truth] + rng.normal(0, 0.3, (120, 4))
    df = frame(spark, points)
    for method, options in (
        ("kmeans", {"n_clusters": 3, "n_init": 3}), ("gmm", {"n_clusters": 3, "components": 2}), ("hierarchical", {"n_clusters": 3}),
    ):
        got = embeddings.cluster(df, method, "id", **options).toPandas().sort_values("id")
        assert len(set(zip(truth, got.cluster))) == 3, method
        assert set(got.method) == {method}
    with pytest.raises(ValueError):
        embeddings.cluster(df, "spectral", "id")


def test_kmeans_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(0, 1, (400, 6)) + 3 * rng.integers(0, 2, (400, 6))
    df = frame(spark, points)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts, setting in ((2, "3"), (7, "11")):
            spark.conf.set("spark.sql.shuffle.partitions", setting)
            centres = embeddings.kmeans_centres(df.repartition(parts), "id", n_clusters=4, n_init=3)
            labels = embeddings.kmeans(df.repartition(parts), "id", n_clusters=4, n_init=3).orderBy("id").toPandas().cluster.tolist()
            found.append((centres.tolist(), labels))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    # A fixed point of Lloyd's step: every point at its nearest mean, every centre the mean of its points.
    centres, labels = np.array(found[0][0]), np.array(found[0][1])
    near = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    assert len(set(zip(near, labels))) == 4
    assert np.array([points[near == k].mean(0) for k in range(4)]) == pytest.approx(centres, abs=1e-3)


def test_kmeans_of_few_points(spark):
    points = np.repeat(np.array([[0.0, 0.0], [5.0, 5.0]]), 4, axis=0)
    got = embeddings.kmeans(frame(spark, points), "id", n_clusters=5, n_init=2).orderBy("id").toPandas().cluster.tolist()
    assert got == [0] * 4 + [1] * 4
    assert embeddings.kmeans(frame(spark, points).filter("id < 0"), "id").collect() == []


def test_principal_components_match_numpy(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(0, 1, (200, 6)) @ rng.normal(0, 1, (6, 6)) + 5
    scores, ratios = embeddings.principal_components(frame(spark, points), "id")
    centred = points - points.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    signs = np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(1)])
    want = centred @ vt[:2].T * signs
    got = np.array([r["components"] for r in scores.orderBy("id").collect()])
    assert got == pytest.approx(want, abs=1e-8)
    assert [r[1] for r in ratios.orderBy("component").collect()] == pytest.approx(s[:2] ** 2 / (s**2).sum())


def test_distances_by_inner_products_are_exact_at_the_limit():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(60, 64)) + 1000.0, rng.normal(size=(50, 64)) + 1000.0
    far = embeddings._dimension_free_distance(a, b)
    for eps in (*far.ravel()[:20], *np.nextafter(far.ravel()[:20], 0), 0.0):
        assert (embeddings._within(a, b, eps) == (far <= eps)).all()
    assert embeddings._within(a, a, 0.0).diagonal().all()


def test_explained_variance_of_few_rows_and_equal_rows(spark):
    """A driver-side decomposition of the rows did not converge on some inputs; a symmetric matrix always does."""
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(4)]
    scores, ratios = embeddings.principal_components(spark.createDataFrame(rows, "k long, embedding array<double>"), "k")
    assert [r[1] for r in ratios.orderBy("component").collect()] == pytest.approx([1.0, 0.0])
    assert [r["components"][0] for r in scores.orderBy("k").collect()] == pytest.approx([(i - 1.5) * 5**0.5 for i in range(4)])


def test_dbscan_sends_each_point_to_few_blocks(spark, monkeypatch):
    """What is shuffled grew with the square of the points that no split parts."""
    monkeypatch.setattr(embeddings, "TILE_ROWS", 4)
    rng = np.random.default_rng(12)
    sphere = rng.normal(0, 1, (500, 64))
    sphere /= np.linalg.norm(sphere, axis=1)[:, None]
    rows = frame(spark, sphere).select(F.col("embedding").alias("vec"), "id", F.lit(1).cast("bigint").alias("weight"))
    tiles = embeddings._tiles(rows, 1.16)
    assert tiles.groupBy("id").count().agg(F.max("count")).head()[0] <= embeddings.BLOCKS < 500 / 4
    sides = tiles.groupBy("tile", "itself").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    # Still every pair once.
    assert sum(r.a * (r.a - 1) // 2 if r.itself else r.a * r.b for r in sides.collect()) == 500 * 499 // 2


@pytest.mark.parametrize("kind", ["float", "double"])
def test_dbscan_in_strips_of_few_blocks(spark, monkeypatch, kind):
    """Core points, border points, noise and vectors that are no numbers, in blocks of many strips."""
    for name, value in {"TILE_ROWS": 8, "STRIP_ROWS": 16, "BLOCKS": 2, "DEALT_ROWS": 40}.items():
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (4, 24))
    points = np.vstack([rng.normal(0, 1, (60, 24)), *(c + rng.normal(0, 0.13, (40, 24)) for c in centres)])
    points[[5, 70, 71], [0, 3, 9]] = np.nan, np.inf, -np.inf
    points = np.vstack([points, np.repeat(points[[1, 80]], [6, 2], axis=0)]).astype(np.float32 if kind == "float" else float)
    points = points[rng.permutation(len(points))]
    df = frame(spark, points).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    got = embeddings.dbscan(df, "id", eps=0.85, min_samples=5).orderBy("id").toPandas()
    with np.errstate(invalid="ignore"):
        want = brute_dbscan(points.astype(float), 0.85, 5)
    assert got.cluster.tolist() == want.tolist()
    assert (want == -1).sum() > 10 and want.max() >= 2


def test_pairs_in_single_precision_are_exact_at_the_limit():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(90, 64)), rng.normal(size=(80, 64))
    for scale in (1.0, 1e30, 1e-30):
        far = embeddings._dimension_free_distance(a * scale, b * scale)
        for eps in (*far.ravel()[:10], *np.nextafter(far.ravel()[:10], 0)):
            assert (embeddings._within(a * scale, b * scale, eps) == (far <= eps)).all()
    # Nearly all pairs too near the limit for single precision.
    close = a[:1] + 1e-5 * rng.normal(size=(70, 64))
    far = embeddings._dimension_free_distance(close, close)
    points = np.vstack([close, 50 * a])
    eps = np.median(far)
    assert (embeddings._within(points, points, eps) == (embeddings._dimension_free_distance(points, points) <= eps)).all()
