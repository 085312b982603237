"""Shards along a Hilbert curve over metadata dimensions.

Each dimension is quantised to ``2 ** bits`` cells at its own approximate
quantiles (strings by their first bytes, in order), the cells become an index on
the Hilbert curve, rows are sorted by that index, and the order is cut into runs
of equal row counts. A file then covers a small box of the dimensions, so
min / max statistics prune it for predicates on any of them.

Global positions come from a range-partitioned, sorted table and the row counts
of its partitions; no window runs over all rows.

Defined cases: null values lie in the lowest cell; equal rows are told apart by
their place in the input; an empty table gives no rows; texts count 8 bytes more
than their UTF-8 size, null texts 8; extra columns pass through.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from phenoweave.session import durable


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell numbers (rows x dimensions)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # Undo the rotations and reflections of the levels, from the coarsest.
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def _ordinal(df: DataFrame, name: str):
    """A number that keeps the order of the column's values."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        # Six bytes: a whole number that a double holds.
        head = F.rpad(F.hex(F.substring(F.encode(F.col(name).cast("string"), "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double")


def quantise(df: DataFrame, dims: Sequence[str], bits: int) -> list:
    """Cell number expressions: how many of the dimension's cut points a value reaches.

    The cut points are at most ``2 ** bits - 1`` numbers per dimension.
    """
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(_ordinal(df, d), steps, 10_000).alias(f"c{i}") for i, d in enumerate(dims)]).head()
    out = []
    for i, d in enumerate(dims):
        cuts = sorted({c for c in (row[f"c{i}"] or []) if c is not None})
        value, cell = _ordinal(df, d), F.lit(0)
        # Nested halving: a value meets `bits` comparisons, not all cut points.
        def halve(lo: int, hi: int):
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(value >= cuts[mid], halve(mid + 1, hi)).otherwise(halve(lo, mid))

        out.append(F.when(value.isNull(), F.lit(0)).otherwise(halve(0, len(cuts)) if cuts else cell).cast("int"))
    return out


def hilbert_shards(
    df: DataFrame, dims: Sequence[str], n_shards: int, ties: Sequence[str] = (), bits: int = 6,
    names: tuple[str, str, str] = ("curve", "shard", "slot"),
) -> DataFrame:
    """``df`` plus the curve index, its shard and its gapless position there.

    Shard sizes differ by one row at most; earlier shards have the more.
    """
    if set(names) & set(df.columns):
        raise ValueError(f"columns {names} are already there; give other names")
    spark, columns = df.sparkSession, df.columns
    index = F.pandas_udf(lambda *c: pd.Series(hilbert_index(np.stack([x.to_numpy() for x in c], 1), bits)), "long")
    table = durable(df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "shard-rows")
    flat = table.select("row.*", F.col("at").alias("__at"))
    cells = quantise(flat, dims, bits)
    curve, at = names[0], "__at"
    placed = flat.withColumn(curve, index(*cells))
    keys = [curve, *ties, at]
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The number within a partition is in the low 33 bits, the partition above.
    ordered = durable(ordered.withColumn("__place", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("__place", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    counts = {r["part"]: r["n"] for r in sizes}
    order = sorted(counts)
    before = dict(zip(order, itertools.accumulate([0] + [counts[p] for p in order])))
    total = sum(counts.values())
    offsets = spark.createDataFrame([(p, int(before[p])) for p in order], "part long, offset long")
    low, extra = divmod(total, n_shards)
    rank = F.col("offset") + F.col("__place").bitwiseAND((1 << 33) - 1)
    wide = (low + 1) * extra  # rows in the shards that have one more
    shard = F.when(rank < wide, F.floor(rank / (low + 1))).otherwise(extra + F.floor((rank - wide) / max(low, 1)))
    slot = F.when(rank < wide, rank % (low + 1)).otherwise((rank - wide) % max(low, 1))
    return ordered.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        *[F.col(f"`{c}`") for c in columns], F.col(curve), shard.cast("int").alias(names[1]), slot.cast("long").alias(names[2])
    )


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One Parquet folder per shard, rows in curve order."""
    sharded.repartition(shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def document_shards(documents: DataFrame, n_shards: int = 24) -> DataFrame:
    """Documents over language, source and size: sizes, check sums, shard and slot of each."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = documents.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), "lang", "source"
    )
    return hilbert_shards(narrow, ["lang", "source", "size"], n_shards, ties=["doc_id", "text_crc32"])
