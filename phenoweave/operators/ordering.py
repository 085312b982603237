"""Ordered computations that never place a whole group in one task.

A window partitioned by a key runs a key's rows in one task, so one hot key (or
no key at all) defeats it. Here the rows are written once, range-partitioned
and sorted by key and order (:func:`aligned`). The partitions cut every key's
ordered rows into parts; parts are scanned in parallel and the totals of a key's earlier
parts are carried over a window of one row per key and partition. A row's
number in its partition is in the file, so positions need no window over rows.

Quantiles are found by radix selection: values become 64-bit integers of the
same order, and counts of leading digits narrow each wanted rank down to a small bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoweave.session import durable

BLOCK_ROWS = 4096
DIGIT = 16  # bits of an order key that one pass of the selection reads
BUCKET_ROWS = 100_000  # rows of one value range that a task may rank
ROW_BITS = 33  # of an identifier: the row's number in its partition

_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def _packed(keys: Sequence[str]) -> Column:
    """The keys as one value that is never null, so that null keys join as well."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)


def aligned(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` written once in the order of ``keys`` and ``order``, with ``_key``, ``_part`` and ``_at``.

    ``_at`` rises with the order and has no gaps inside a part; ``parts`` sets how many there are, otherwise
    the session does.
    """
    by = [*keys, *order]
    spread = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    written = durable(spread.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    return written.withColumn("_part", F.shiftright("_at", ROW_BITS)).withColumn("_key", _packed(keys))


def _starts(base: DataFrame, carried: dict[str, tuple[str, Column]], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per key and part: its first row, the rows and measures of the key's earlier parts, and the key's totals."""
    per_part = base.groupBy("_key", "_part").agg(
        F.min("_at").alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
        *[_COMBINE[kind][0](expr).alias(f"_c_{n}") for n, (kind, expr) in carried.items()],
        *[_COMBINE[kind][0](expr).alias(f"_u_{n}") for n, (kind, expr) in totals.items()],
    )
    # Bounded: at most a row per key and partition.
    whole = Window.partitionBy("_key")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return durable(
        per_part.select(
            "_key", "_part", "_first",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
            F.sum("_rows").over(whole).alias("_total"),
            *[_COMBINE[kind][0](f"_c_{n}").over(before).alias(f"_p_{n}") for n, (kind, _) in carried.items()],
            *[_COMBINE[kind][0](f"_u_{n}").over(whole).alias(f"_w_{n}") for n, (kind, _) in totals.items()],
        ),
        "ordered-starts",
    )


def scan(
    base: DataFrame,
    measures: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    totals: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Running sum/min/max over an :func:`aligned` frame, whose columns stay for further scans."""
    totals, columns = totals or {}, base.columns
    starts = _starts(base, measures, totals)
    inside = Window.partitionBy("_key", "_part").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    scanned = base.select(
        "*", *[_COMBINE[kind][0](expr).over(inside).alias(f"_i_{n}") for n, (kind, expr) in measures.items()]
    )
    return scanned.join(starts, ["_key", "_part"]).select(
        *columns,
        *[_COMBINE[kind][1](F.col(f"_p_{n}"), F.col(f"_i_{n}")).alias(n) for n, (kind, _) in measures.items()],
        *[F.col(f"_w_{n}").alias(n) for n in totals],
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    totals: dict[str, tuple[str, Column]] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Running sum/min/max per key in ``order``, parallel inside a key.

    ``measures`` maps an output name to (``sum``/``min``/``max``, expression);
    ``order`` must identify a row within its key. With ``inclusive=False`` the
    row itself is left out. ``totals`` adds whole-key aggregates as well. For
    several scans in a row, use :func:`aligned` once and :func:`scan`.
    """
    base = aligned(df, keys, order, parts)
    return scan(base, measures, inclusive, totals).drop("_key", "_part", "_at")


def with_positions(base: DataFrame, name: str = "position", total: str | None = None) -> DataFrame:
    """An :func:`aligned` frame with each row's zero-based position in its key and, if named, the key's row count.

    The number of a row in its part is known, so rows only meet the starts of the parts.
    """
    joined = base.join(_starts(base, {}, {}), ["_key", "_part"])
    position = (F.col("_before") + F.col("_at") - F.col("_first")).cast("bigint")
    return joined.select(*base.columns, position.alias(name), *([F.col("_total").alias(total)] if total else []))


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", total: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Zero-based row position per key in ``order`` (a unique order) as a BIGINT; ``total`` names the key's row count."""
    return with_positions(aligned(df, keys, order, parts), name, total).drop("_key", "_part", "_at")


def framed(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    before: int,
    after: int,
    columns,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Window expressions over a bounded ROWS frame, cut into overlapping blocks.

    ``columns`` maps an output name to a function of the ordered WindowSpec.
    A row near a block edge is also sent to the neighbouring block, so every
    frame of at most ``before`` + ``after`` neighbours is complete there.
    """
    block_rows = max(block_rows, before + after + 1)
    home = F.floor(F.col(position) / block_rows)
    offset = F.pmod(F.col(position), F.lit(block_rows))
    targets = F.array_compact(
        F.array(
            home,
            F.when(offset >= block_rows - before, home + 1),
            F.when((offset < after) & (home > 0), home - 1),
        )
    )
    spread = df.withColumn("_home", home).withColumn("_block", F.explode(targets))
    spec = Window.partitionBy(*keys, "_block").orderBy(position)
    framed_rows = spread.repartition(*keys, "_block").select("*", *[make(spec).alias(n) for n, make in columns.items()])
    return framed_rows.filter(F.col("_block") == F.col("_home")).drop("_home", "_block")


def order_key(value: Column) -> Column:
    """A BIGINT that orders like the DOUBLE ``value``; equal values, both zeros included, have equal keys.

    Below the sign it is the number's exponent and fraction, computed exactly: scaling by powers of two loses nothing.
    """
    size = F.abs(value)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1022))
    # A logarithm can be off by a hair beside a power of two.
    exponent = guess + F.when(size >= F.pow(F.lit(2.0), guess) * 2.0, 1).when((size < F.pow(F.lit(2.0), guess)) & (guess > -1022), -1).otherwise(0)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1.0) * 2.0**52).cast("bigint")
    tiny = (size * 2.0**537 * 2.0**537).cast("bigint")
    key = (
        F.when(F.isnan(size), F.lit(0x7FF8 << 48))
        .when(size == float("inf"), F.lit(0x7FF << 52))
        .when(size < 2.0**-1022, tiny)
        .otherwise(F.shiftleft((exponent + 1023).cast("bigint"), 52) + fraction)
    )
    return F.when((value < 0) & ~F.isnan(value), -key).otherwise(key)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one output column per name.

    Each pass counts the next digit of the values' order keys inside the buckets that hold a wanted rank, until no such
    bucket has more than ``bucket_rows`` rows or it is one value; ranks are taken inside these only. A pass
    shuffles counts of digits, never values.
    """
    rows = durable(
        df.select(_packed(keys).alias("_key"), F.col(value).cast("double").alias("_v")).filter("_v is not null").withColumn("_o", order_key(F.col("_v"))),
        "quantile-rows",
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probabilities.items()]))
    rank = F.col("_w.p") * (F.col("_n") - 1)
    # One row per key and wanted rank: its place in the bucket of the keys with the leading bits ``_b``.
    targets = durable(
        rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).withColumn("_w", wanted)
        .select("_key", F.col("_w.name").alias("_name"), (rank - F.floor(rank)).alias("_f"), F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))).alias("_rank"), F.col("_n").alias("_size"))
        .select("*", F.col("_rank").alias("_place"), F.lit(0).cast("bigint").alias("_b")),
        "quantile-targets",
    )
    bits = 0
    while bits < 64 and not targets.filter(F.col("_size") > bucket_rows).isEmpty():
        bits += DIGIT
        digit = F.shiftright("_o", 64 - bits)
        above = F.lit(0).cast("bigint") if bits == DIGIT else F.shiftright("_o", 64 - bits + DIGIT)
        hit = rows.withColumn("_b", above).join(targets.select("_key", "_b").distinct(), ["_key", "_b"], "left_semi")
        counts = hit.groupBy("_key", "_b", digit.alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
        # At most 2 ** DIGIT rows per bucket.
        after = F.sum("_c").over(Window.partitionBy("_key", "_b").orderBy("_d"))
        found = counts.withColumn("_after", after).join(targets, ["_key", "_b"]).filter((F.col("_after") - F.col("_c") <= F.col("_place")) & (F.col("_place") < F.col("_after")))
        targets = durable(
            found.select("_key", "_name", "_f", "_rank", F.col("_c").alias("_size"), (F.col("_place") - F.col("_after") + F.col("_c")).alias("_place"), F.col("_d").alias("_b")),
            "quantile-targets",
        )
    bucket = F.lit(0).cast("bigint") if not bits else F.shiftright("_o", 64 - bits)
    hit = rows.withColumn("_b", bucket).join(targets.select("_key", "_b").distinct(), ["_key", "_b"], "left_semi")
    # A bucket holds few rows, or many that are equal: counted by value it is small.
    counted = hit.groupBy("_key", "_b", "_o").agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_v"))
    after = F.sum("_c").over(Window.partitionBy("_key", "_b").orderBy("_o"))
    picked = counted.withColumn("_after", after).join(targets, ["_key", "_b"]).filter((F.col("_after") - F.col("_c") <= F.col("_place")) & (F.col("_place") < F.col("_after")))
    # Of the two neighbouring ranks the lower one comes first; they may be the same.
    edges = picked.groupBy("_key").agg(
        *[e for n in probabilities for e in (
            F.min(F.when(F.col("_name") == n, F.struct("_rank", "_v"))).alias(f"_lo_{n}"),
            F.max(F.when(F.col("_name") == n, F.struct("_rank", "_v"))).alias(f"_hi_{n}"),
            F.max(F.when(F.col("_name") == n, F.col("_f"))).alias(f"_f_{n}"),
        )]
    )
    return edges.select(
        *[F.col("_key")[k].alias(k) for k in keys],
        *[
            (F.col(f"_lo_{n}")["_v"] + (F.col(f"_hi_{n}")["_v"] - F.col(f"_lo_{n}")["_v"]) * F.col(f"_f_{n}")).alias(n)
            for n in probabilities
        ],
    )
