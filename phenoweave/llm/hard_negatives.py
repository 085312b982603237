"""Hard negatives of anchor vectors, found by filtering segment summaries.

Components become whole numbers, so that scores are exact inner products. Every
vector is stored with the mean and the deviation of its segments at two levels, few long
segments and within them more short ones. Over a segment of ``w`` components an
inner product is ``w * mean * mean``, give or take the product of both deviations; the sums
of these bounds decide which rows can still reach an answer, first by the long
segments, then by the short ones, and only the rest are scored.

Rows are dealt into blocks and every anchor visits every block: a task holds one
block and streams the anchors past it. A block answers with the best rows of
each anchor there, windows pick the best of all blocks. A first round
finds the positives, a second one the negatives in the band that each positive
score sets. Nothing is broadcast or collected but a row count.

Defined cases: rows with a null label, a null vector or null or non-finite
components take no part; vectors of different length have no score with each other;
empty vectors score 0; ties go to the smaller identifier, rows without one come
last among equal scores; a row is no positive of itself, but one with the same
identifier can be; whole numbers beyond 2^62 are held there and scores beyond a
long at its ends; extra columns are ignored; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoweave.session import durable

LEVELS = (4, 16)  # segments of a vector; each level cuts those of the one before
BLOCKS, BLOCK_ROWS, BLOCK_BYTES = 48, 65_536, 64 << 20  # fewest blocks, and the most a block holds on average
ANCHORS_AT_ONCE = 128
FAR = 2.0**62
STORED = "id long, label string, anchor boolean, dim int, vector binary, summary binary"
POSITIVE, NEGATIVE = "anchor long, row long, id long, score long", "anchor long, positive long, row long, id long, score long"


def segment_summary(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means, times the root of the width, and deviations of the segments of each row."""
    dim = x.shape[1]
    starts = np.unique(np.arange(segments) * dim // segments) if dim else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros((len(x), 0)), np.zeros((len(x), 0))
    width = np.diff(np.append(starts, dim))
    mean = np.add.reduceat(x, starts, axis=1) / width
    rest = x - np.repeat(mean, width, axis=1)
    return mean * np.sqrt(width), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))


def bounds(mean_a: np.ndarray, dev_a: np.ndarray, mean_b: np.ndarray, dev_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of all rows of a with all rows of b."""
    size = lambda mean, dev: np.sqrt((mean * mean).sum(1) + (dev * dev).sum(1))
    middle, reach = mean_a @ mean_b.T, dev_a @ dev_b.T
    # Summaries are stored in single precision.
    reach = reach + 1e-5 * np.outer(size(mean_a, dev_a), size(mean_b, dev_b)) + 1e-6
    return middle - reach, middle + reach


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows with one vector."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    most = float(np.abs(rows).max()) * float(np.abs(anchor).max()) * rows.shape[1]
    if most < 2.0**53:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    exact = rows.astype(object) @ anchor.astype(object)
    return np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in exact], np.int64)


def _packed(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with their whole-number vector and its summaries."""
    for batch in batches:
        lists = batch.column(3)
        usable = np.flatnonzero(~lists.is_null().to_numpy(zero_copy_only=False) & ~batch.column(1).is_null().to_numpy(zero_copy_only=False))
        lists = lists.take(pa.array(usable))
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])
        flat = lists.flatten().cast(pa.float64())
        flat = flat.fill_null(np.nan).to_numpy() if flat.null_count else flat.to_numpy()
        dims = np.diff(at)
        keep, vectors, summaries = [], [], []
        for dim in np.unique(dims):
            of = np.flatnonzero(dims == dim)
            x = flat[at[of][:, None] + np.arange(dim)]
            finite = np.isfinite(x).all(1)
            of, x = of[finite], np.clip(np.floor(scale * x[finite]), -FAR, FAR)
            levels = [part for level in LEVELS for part in segment_summary(x, level)]
            summary = np.concatenate(levels, axis=1).astype(np.float32)
            most = np.abs(x).max(initial=0)
            ints = x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)
            keep += usable[of].tolist()
            vectors += [v.tobytes() for v in ints]
            summaries += [v.tobytes() for v in summary]
        take = pa.array(np.array(keep, np.int64))
        dim_of = pa.array(dims[np.searchsorted(usable, keep)].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), dim_of, pa.array(vectors, pa.binary()), pa.array(summaries, pa.binary())],
            ["id", "label", "anchor", "dim", "vector", "summary"],
        )


def _whole(vectors: list[bytes], dim: int) -> np.ndarray:
    """The whole-number vectors of one length, however wide each is stored."""
    if not dim:
        return np.zeros((len(vectors), 0), np.int64)
    kinds = {2: np.int16, 4: np.int32, 8: np.int64}
    widths = {len(v) // dim for v in vectors}
    if len(widths) == 1:
        return np.frombuffer(b"".join(vectors), kinds[widths.pop()]).reshape(len(vectors), dim)
    return np.stack([np.frombuffer(v, kinds[len(v) // dim]).astype(np.int64) for v in vectors])


class _Rows:
    """Rows of one vector length, ordered by label."""

    def __init__(self, table: pa.Table, dim: int) -> None:
        labels = np.array(table.column("label").to_pylist(), object)
        order = np.argsort(labels.astype(str), kind="stable")
        table, self.labels = table.take(pa.array(order)), labels[order].astype(str)
        self.row = table.column("row").to_numpy()
        self.no_id = table.column("id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        self.id = table.column("id").combine_chunks().fill_null(0).to_numpy()
        self.ids = table.column("id").combine_chunks()
        self.whole = _whole(table.column("vector").to_pylist(), dim)
        parts = [min(level, dim) for level in LEVELS for _ in range(2)]
        summary = np.frombuffer(b"".join(table.column("summary").to_pylist()), np.float32).astype(np.float64).reshape(len(order), sum(parts))
        cut = np.split(summary, np.cumsum(parts)[:-1], axis=1)
        self.levels = list(zip(cut[::2], cut[1::2]))

    def same_label(self, label: str) -> slice:
        return slice(int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right")))

    def best(self, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places of the ``k`` best of ``rows``."""
        return np.lexsort((self.row[rows], self.id[rows], self.no_id[rows], -score.astype(object) if score.min(initial=0) == -(2**63) else -score))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best_positives(anchors: _Rows, i: int, rows: _Rows, low: np.ndarray, high: np.ndarray, start: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best rows of the anchor's label, the anchor itself left out; ``low`` and ``high`` bound those from ``start`` on."""
    alive = np.arange(start, start + len(low))
    other = rows.row[alive] != anchors.row[i]
    alive, low, high = alive[other], low[other], high[other]
    for mean, dev in rows.levels[1:]:
        alive = alive[high >= _kth(low, k)]
        of = (anchors.levels[1][0][[i]], anchors.levels[1][1][[i]])
        low, high = (b[0] for b in bounds(*of, mean[alive], dev[alive]))
    alive = alive[high >= _kth(low, k)]
    score = scores(rows.whole[alive], anchors.whole[i])
    first = rows.best(alive, score, k)
    return alive[first], score[first]


def best_negatives(
    anchors: _Rows, i: int, rows: _Rows, low: np.ndarray, high: np.ndarray, bands: list[tuple[int, int]], k: int,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each band of scores the ``k`` best rows of other labels in it."""
    alive = np.ones(len(low), bool)
    alive[rows.same_label(anchors.labels[i])] = False
    alive = np.flatnonzero(alive)
    low, high = low[alive], high[alive]

    def reaching(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows that can be among the best of a band: as good as the k-th that lies in it for certain."""
        out = np.zeros(len(low), bool)
        for least, most in bands:
            certain = low[(low >= least) & (high <= most)]
            out |= (high >= max(float(least), _kth(certain, k))) & (low <= most)
        return out

    for mean, dev in rows.levels[1:]:
        alive = alive[reaching(low, high)]
        of = (anchors.levels[1][0][[i]], anchors.levels[1][1][[i]])
        low, high = (b[0] for b in bounds(*of, mean[alive], dev[alive]))
    alive = alive[reaching(low, high)]
    score = scores(rows.whole[alive], anchors.whole[i])
    out = []
    for least, most in bands:
        inside = (score >= least) & (score <= most)
        there, value = alive[inside], score[inside]
        first = rows.best(there, value, k)
        out.append((there[first], value[first]))
    return out


def _tiles(batches: Iterator[pa.RecordBatch], visit) -> Iterator[pa.RecordBatch]:
    """Collect the rows of a block, then hand ``visit`` the anchors that come after them."""
    block, parts, rows = None, [], {}

    def by_dim(table: pa.Table) -> dict[int, pa.Table]:
        dims = table.column("dim").to_numpy()
        return {int(d): table.take(pa.array(np.flatnonzero(dims == d))) for d in np.unique(dims)}

    for batch in batches:
        table = pa.Table.from_batches([batch])
        blocks, visitor = table.column("block").to_numpy(), table.column("visitor").to_numpy()
        change = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (visitor[1:] != visitor[:-1])])) if len(blocks) else []
        for a, b in zip(change, [*change[1:], len(blocks)]):
            piece = table.slice(a, b - a)
            if blocks[a] != block:
                block, parts, rows = blocks[a], [], {}
            if not visitor[a]:
                parts.append(piece.drop_columns(["scores", "positives"]))
                continue
            if parts:
                rows, parts = {d: _Rows(t, d) for d, t in by_dim(pa.concat_tables(parts)).items()}, []
            for dim, found in by_dim(piece).items():
                for i in range(0, found.num_rows if dim in rows else 0, ANCHORS_AT_ONCE):
                    yield from visit(found.slice(i, ANCHORS_AT_ONCE), dim, rows[dim])


def _positives_of(table: pa.Table, dim: int, rows: _Rows, k: int) -> Iterator[pa.RecordBatch]:
    anchors, out = _Rows(table, dim), ([], [], [], [])
    for label in np.unique(anchors.labels):
        of, there = np.flatnonzero(anchors.labels == label), rows.same_label(label)
        (mean_a, dev_a), (mean_b, dev_b) = anchors.levels[0], rows.levels[0]
        low, high = bounds(mean_a[of], dev_a[of], mean_b[there], dev_b[there])
        for n, i in enumerate(of):
            first, score = best_positives(anchors, i, rows, low[n], high[n], there.start, k)
            for whole, part in zip(out, ([anchors.row[i]] * len(first), rows.row[first], rows.ids.take(pa.array(first)).to_pylist(), score)):
                whole.extend(part)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor", "row", "id", "score"])


def _negatives_of(table: pa.Table, dim: int, rows: _Rows, k: int, low_share: int, high_share: int) -> Iterator[pa.RecordBatch]:
    set_by = dict(zip(table.column("row").to_pylist(), zip(table.column("positives").to_pylist(), table.column("scores").to_pylist())))
    anchors, out = _Rows(table, dim), ([], [], [], [], [])
    low, high = bounds(*anchors.levels[0], *rows.levels[0])
    for i, row in enumerate(anchors.row.tolist()):
        # Whole numbers: low_share * positive <= 100 * negative <= high_share * positive.
        bands = [(p, -(-low_share * s // 100), high_share * s // 100) for p, s in zip(*set_by[row])]
        bands = [b for b in bands if b[1] <= b[2]]
        if not bands:
            continue
        for (positive, _, _), (first, score) in zip(bands, best_negatives(anchors, i, rows, low[i], high[i], [b[1:] for b in bands], k)):
            for whole, part in zip(out, ([row] * len(first), [positive] * len(first), rows.row[first], rows.ids.take(pa.array(first)).to_pylist(), score)):
                whole.extend(part)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor", "positive", "row", "id", "score"])


def _met(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Blocks of rows, each followed by all anchors."""
    none = F.lit(None).cast("array<long>")
    names = ["block", "visitor", "row", "id", "label", "dim", "vector", "summary", "positives", "scores"]
    at_home = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("visitor", F.lit(False)).withColumn("positives", none).withColumn("scores", none)
    visits = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("visitor", F.lit(True))
    both = at_home.select(*names).unionByName(visits.select(*names))
    return both.repartitionByRange(blocks, "block").sortWithinPartitions("block", "visitor")


def hard_negatives(
    embeddings: DataFrame, anchors: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchors`` holds.

    Positives are the best rows of the anchor's label; their negatives are the best rows of other labels that
    score between ``low`` and ``high`` hundredths of the positive.
    """
    taking = embeddings.select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vector")
    )
    stored = durable(taking.mapInArrow(lambda batches: _packed(batches, scale), STORED).withColumn("row", F.monotonically_increasing_id()), "negatives-vectors")
    size = stored.agg(F.count("*").alias("rows"), F.sum(F.octet_length("vector") * 8).alias("bytes")).head()
    blocks = max(BLOCKS, -(-size["rows"] // BLOCK_ROWS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    none = F.lit(None).cast("array<long>")
    asking = stored.filter("anchor")
    offered = _met(stored, asking.withColumn("positives", none).withColumn("scores", none), blocks).mapInArrow(
        lambda batches: _tiles(batches, lambda *t: _positives_of(*t, positives)), POSITIVE
    )
    order = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    chosen = durable(offered.withColumn("place", F.row_number().over(order("anchor"))).filter(F.col("place") <= positives), "negatives-positives")
    bands = chosen.groupBy("anchor").agg(F.collect_list(F.struct("row", "score")).alias("found"))
    ready = asking.join(bands.select(F.col("anchor").alias("row"), F.col("found.row").alias("positives"), F.col("found.score").alias("scores")), "row")
    answers = _met(stored, ready, blocks).mapInArrow(lambda batches: _tiles(batches, lambda *t: _negatives_of(*t, negatives, low, high)), NEGATIVE)
    ranked = answers.withColumn("rank", F.row_number().over(order("anchor", "positive")).cast("int")).filter(F.col("rank") <= negatives)
    named = chosen.select("anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor", "positive"]).join(asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
