"""Rows of one key travel together: packed into arrays before a shuffle, met whole after it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Rows in one packed row. Longer stretches become several, so an Arrow batch of them stays small.
STRETCH = 64


def _fresh(batch: pa.RecordBatch, keys: Sequence[str], nulls_meet: bool) -> np.ndarray:
    """Whether a row has other keys than the row before it."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = True
    for k in keys:
        here, before = batch.column(k)[1:], batch.column(k)[:-1]
        differ = pc.fill_null(pc.not_equal(here, before), True).to_numpy(zero_copy_only=False)
        if nulls_meet and batch.column(k).null_count:
            differ = differ & ~pc.and_(here.is_null(), before.is_null()).to_numpy(zero_copy_only=False)
        out[1:] |= differ
    return out


def pack(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, an array of every other column): neighbouring rows of equal keys in one row."""
    keys, types = list(keys), {f.name: f.dataType.simpleString() for f in df.schema.fields}
    others = [c for c in df.columns if c not in keys]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(_fresh(batch, keys, False))
            sizes = np.diff(starts, append=batch.num_rows)
            parts = -(-sizes // STRETCH)
            starts = np.repeat(starts, parts) + STRETCH * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(pa.array(starts)) for k in keys]
                + [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in others],
                names=[*keys, *others],
            )

    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"`{c}` array<{types[c]}>" for c in others])
    return df.select(*keys, *others).mapInArrow(stretches, schema)


def map_groups(
    packed: DataFrame,
    keys: Sequence[str],
    work: Callable[[pa.RecordBatch, np.ndarray, dict[str, pa.Array]], pa.RecordBatch],
    schema: str,
    nulls_meet: bool = False,
) -> DataFrame:
    """``work`` on many whole groups of :func:`pack` at a time, in one shuffle.

    It gets the groups' keys, their numbers of rows and the columns of those rows, group by group. Rows of a
    group come in no order; its stretches are held together in a task. A null key is a group of its own
    unless ``nulls_meet``.
    """
    keys, others = list(keys), [c for c in packed.columns if c not in keys]

    def done(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        columns = {c: batch.column(c).flatten() for c in others}
        lengths = pc.list_value_length(batch.column(others[0])).to_numpy(zero_copy_only=False)
        return work(batch.select(keys).take(pa.array(starts)), np.add.reduceat(lengths, starts), columns)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            starts = np.flatnonzero(_fresh(batch, keys, nulls_meet))
            # The last group may go on in the next batch.
            if len(starts) > 1:
                yield done(batch.slice(0, starts[-1]), starts[:-1])
            held = batch.slice(starts[-1])
        if held is not None:
            yield done(held, np.zeros(1, np.int64))

    return packed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(meet, schema)


def in_order(sizes: np.ndarray, row: np.ndarray) -> np.ndarray | None:
    """Places that sort the rows of each group, or None where they are sorted."""
    step = np.diff(row) < 0
    step[np.cumsum(sizes)[:-1] - 1] = False
    return np.lexsort((row, np.repeat(np.arange(len(sizes)), sizes))) if step.any() else None
