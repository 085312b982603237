"""Near-duplicate vectors by cross-polytope hashing.

Equal vectors are one node. A node is rotated by three rounds of random signs and
a fast Hadamard transform; the axis it lies closest to, with its sign, is one
hash. Each table joins ``HASHES`` of them to a bucket and also puts the node into
the buckets next most likely for it (multiprobe). Buckets are cut into blocks,
blocks of one bucket are compared pairwise in double precision, and a pair is
counted in the first bucket that its two nodes share only. A block pair returns
link counts and a spanning forest of its links, never the links themselves.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length never link; rows with
equal vectors link with each other; null ids link like others but never name a
component that has an id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoweave.operators.graph import connected_components
from phenoweave.session import durable

TABLES, HASHES, PROBES, BLOCK = 10, 3, 4, 1024
THRESHOLD = 0.95
PAIRS_AT_ONCE = 16_384


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (width a power of two)."""
    x, step = x.copy(), 1
    n = x.shape[1]
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-random rotation of the rows, padded to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    random = np.random.Generator(np.random.PCG64(seed))
    for _ in range(3):
        y = hadamard(y * random.choice([-1.0, 1.0], width))
    return y


def buckets(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers (rows x tables x probes): the likeliest first; a missing probe repeats the first."""
    n = len(unit)
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        scores, codes, base = [], [], np.zeros(n, np.int64)
        for k in range(hashes):
            y = rotated(unit, 1_000 * t + k)
            size = np.abs(y)
            two = np.argsort(-size, axis=1, kind="stable")[:, :2]
            code = two * 2 + (np.take_along_axis(y, two, 1) < 0)
            scores.append(np.take_along_axis(size, two, 1))
            codes.append(code)
            base = base * (2 * y.shape[1]) + code[:, 0]
        # Probes: replace one hash at a time by its runner-up, the closest first.
        place = (2 * y.shape[1]) ** np.arange(hashes - 1, -1, -1)
        gap = np.stack([s[:, 0] - s[:, 1] for s in scores], 1)
        moved = np.stack([base + (c[:, 1] - c[:, 0]) * p for c, p in zip(codes, place)], 1)
        order = np.argsort(gap, axis=1, kind="stable")
        out[:, t, 0] = base
        for p in range(1, probes):
            out[:, t, p] = np.take_along_axis(moved, order[:, [p - 1]], 1)[:, 0] if p <= hashes else base
        out[:, t] += t << 56
    return out


def usable(vectors: list) -> list[np.ndarray | None]:
    """Double vectors; None for those that link with nothing."""
    out = []
    for v in vectors:
        x = None if v is None or not len(v) else np.array([np.nan if c is None else c for c in v], np.float64)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _nodes(embeddings: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, node, vector): the node names the vector's components; null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = usable(batch.column(1).to_pylist())
            packed = [None if x is None else (x + 0.0).tobytes() for x in rows]
            names = [None if p is None else hashlib.blake2b(p, digest_size=16).digest() for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(packed, pa.binary())], ["id", "node", "vector"])

    return embeddings.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, node binary, vector binary")


def _placed(nodes: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """(node, n, vector, keys, dim): ``keys`` holds the buckets of each node, tables x probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.frombuffer(v.as_buffer()) for v in batch.column(2)]
            dims = np.array([len(v) for v in vectors], np.int32)
            keys = np.zeros((len(vectors), tables * probes), np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for i in range(0, len(rows), 2048):
                    part = rows[i : i + 2048]
                    keys[part] = buckets(normalised(np.stack([vectors[r] for r in part])), tables, hashes, probes).reshape(len(part), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists, pa.array(dims)], ["node", "n", "vector", "keys", "dim"])

    return nodes.select("node", "n", "vector").mapInArrow(run, "node binary, n long, vector binary, keys array<long>, dim int")


def first_shared(keys_a: np.ndarray, keys_b: np.ndarray, bucket: int) -> np.ndarray:
    """For each pair of rows (pairs x tables x probes): no bucket below ``bucket`` is shared.

    A bucket number begins with its table, so only the tables up to that of ``bucket`` can hold one.
    """
    tables = (bucket >> 56) + 1
    out = np.ones(len(keys_a), bool)
    for i in range(0, len(keys_a), PAIRS_AT_ONCE):
        a, b = keys_a[i : i + PAIRS_AT_ONCE, :tables], keys_b[i : i + PAIRS_AT_ONCE, :tables]
        shared = np.zeros(len(a), bool)
        for p in range(a.shape[2]):
            shared |= ((a[:, :, p, None] == b) & (a[:, :, p, None] < bucket)).any((1, 2))
        out[i : i + PAIRS_AT_ONCE] = ~shared
    return out


def compare_blocks(unit_a: np.ndarray, keys_a: np.ndarray, unit_b: np.ndarray, keys_b: np.ndarray, bucket: int, same: bool, threshold: float) -> np.ndarray:
    """Pairs (i, j) of at least ``threshold`` for which ``bucket`` is the first both share."""
    close = unit_a @ unit_b.T >= threshold
    i, j = np.nonzero(np.triu(close, 1) if same else close)
    if not len(i):
        return np.zeros((0, 2), np.int64)
    first = first_shared(keys_a[i], keys_b[j], bucket)
    return np.stack([i[first], j[first]], 1)


def _forest(nodes: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the pairs."""
    parent = list(range(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def near_vectors(
    embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows = durable(_nodes(embeddings, vec_id, vector), "vectors")
    groups = rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.first("vector").alias("vector"))
    placed = durable(_placed(groups, tables, hashes, probes), "vector-buckets")
    # Two probes may fall into one bucket.
    spread = placed.select("node", F.explode(F.array_distinct("keys")).alias("bucket"), "dim")
    sizes = spread.groupBy("bucket", "dim").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    # A node goes to one block of its bucket and meets every block of it.
    met = spread.join(sizes, ["bucket", "dim"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = met.select("node", "bucket", "dim", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", "dim", "node", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    )
    filled = tiles.join(placed.select("node", "n", "vector", "keys"), "node")

    def links_of_tile(bucket, cut, same, nodes, n, unit, keys):
        """Link counts and spanning forest of one tile whose first ``cut`` rows are the low block."""
        if same:
            pairs = compare_blocks(unit, keys, unit, keys, bucket, True, threshold)
        else:
            pairs = compare_blocks(unit[:cut], keys[:cut], unit[cut:], keys[cut:], bucket, False, threshold)
            pairs[:, 1] += cut
        if not len(pairs):
            return [], [], []
        counts = np.bincount(pairs[:, 0], n[pairs[:, 1]], len(n)) + np.bincount(pairs[:, 1], n[pairs[:, 0]], len(n))
        linked, forest = np.flatnonzero(counts).tolist(), _forest(len(n), pairs)
        return (
            [nodes[i].as_py() for i in linked] + [nodes[x].as_py() for x, _ in forest],
            [None] * len(linked) + [nodes[y].as_py() for _, y in forest],
            [int(counts[i]) for i in linked] + [0] * len(forest),
        )

    def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compare tile by tile; a tile's rows follow each other, its last ones may come with the next batch."""

        def compared(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
            out: tuple[list, list, list] = ([], [], [])
            bucket, dim, low, high, own, n = (rows.column(c).to_numpy() for c in ("bucket", "dim", "low", "high", "own", "n"))
            nodes, vectors, lists = (rows.column(c).combine_chunks() for c in ("node", "vector", "keys"))
            keys = lists.flatten().to_numpy().reshape(len(n), tables, probes)
            for a, b in zip(cuts, cuts[1:]):
                if b - a < 2 or low[a] != high[a] and own[a] == own[b - 1]:
                    continue
                unit = normalised(np.frombuffer(b"".join(v.as_buffer() for v in vectors[a:b])).reshape(b - a, dim[a]))
                cut = int((own[a:b] == low[a]).sum())
                for whole, part in zip(out, links_of_tile(int(bucket[a]), cut, low[a] == high[a], nodes[a:b], n[a:b], unit, keys[a:b])):
                    whole.extend(part)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["src", "dst", "links"])

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if rest is not None:
                rows = pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            of = [rows.column(c).to_numpy() for c in ("bucket", "dim", "low", "high")]
            starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in of], axis=0)]))
            rest = rows.slice(starts[-1])
            if len(starts) > 1:
                yield compared(rows.slice(0, starts[-1]), starts)
        if rest is not None:
            yield compared(rest, np.array([0, rest.num_rows]))

    tile = ["bucket", "dim", "low", "high"]
    # Many tiles are small: they are told apart within a sorted partition, not each grouped for Python.
    sorted_tiles = filled.select(*tile, "node", "n", "vector", "keys", "own").repartition(*tile).sortWithinPartitions(*tile, "own")
    found = durable(sorted_tiles.mapInArrow(tiles_of, "src binary, dst binary, links long"), "vector-links")
    links = found.filter("dst is null").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    components = connected_components(found.filter("dst is not null").select("src", "dst"))
    node_rows = placed.select("node", "n").join(links, "node", "left").join(components, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    labelled = rows.select("id", "node").join(node_rows, "node", "left")
    smallest = labelled.filter("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    return labelled.join(smallest, "component", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
