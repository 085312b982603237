"""Variance components of crossed random factors by restricted maximum likelihood.

The data enter through sums over factor levels only. The factor with the most
levels is absorbed: in the mixed-model equations its own block is diagonal, so
its levels, however many, stay in a table that one scan reduces to matrices over the
levels of the other factors. On these the likelihood and its gradient are exact, and a
quasi-Newton search over the logarithms of the variance ratios finds the maximum.
All phenotypes take their steps in the same scan.

Where the maximum lies at a variance of zero, the component is returned as (nearly) zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from phenoweave.operators.variance import RESIDUAL, _complete
from phenoweave.session import durable

MOST_LEVELS = 3_000  # of all factors but the largest: the order of the dense matrices
LEVELS_AT_ONCE = 1_024
LEVELS_OF_TASK = 100_000
LEVELS_HERE = 20_000  # absorbed levels that the driver holds; more are scanned by tasks
FARTHEST = 16.0  # log of the residual's ratio to a component's variance
STEPS, ENOUGH = 100, 3e-9


@dataclass
class _Search:
    """State of one phenotype's search over the logarithms ``at`` of residual variance / component variance."""

    n: float
    square: float  # of the centred values
    counts: np.ndarray  # of pairs of levels of the small factors, the intercept first
    sums: np.ndarray  # of the centred values by these levels
    owner: np.ndarray  # factor of each, -1 for the intercept
    levels: np.ndarray  # number of levels by factor, the absorbed one first
    at: np.ndarray
    value: float = np.inf
    slope: np.ndarray | None = None
    bend: np.ndarray | None = None  # approximate inverse of the second derivatives
    tried: np.ndarray | None = None
    length: float = 1.0
    done: bool = False
    residual: float = 0.0
    history: list = field(default_factory=list)

    def evaluate(self, at: np.ndarray, found: dict) -> tuple[float, np.ndarray, float]:
        """Minus twice the likelihood, its gradient and the residual variance at ``at``."""
        ratio = np.exp(at)
        left = self.counts - found["t1"]
        ridge = np.array([0.0 if o < 0 else ratio[o] for o in self.owner])
        inverse = np.linalg.inv(left + np.diag(ridge))
        inverse = (inverse + inverse.T) / 2
        sign, log_det = np.linalg.slogdet(left + np.diag(ridge))
        right = self.sums - found["v1"]
        effects = inverse @ right
        rest = self.square - found["s1"] - effects @ right
        if sign <= 0 or rest <= 0:
            return np.inf, np.zeros_like(at), 0.0
        value = (self.n - 1) * np.log(rest) + found["log"] + log_det - self.levels @ at
        squares = [found["s2"] - 2 * effects @ found["v2"] + effects @ found["t2"] @ effects]
        traces = [found["one"] + (inverse * found["t2"]).sum()]
        for k in range(1, len(at)):
            mine = self.owner == k
            squares.append((effects[mine] ** 2).sum())
            traces.append(np.diag(inverse)[mine].sum())
        slope = ratio * ((self.n - 1) * np.array(squares) / rest + np.array(traces)) - self.levels
        return value, slope, rest / (self.n - 1)

    def step(self, found: dict) -> None:
        """Take what a scan found at ``tried`` and choose the next place."""
        value, slope, residual = self.evaluate(self.tried, found)
        if self.slope is not None and not value <= self.value + 1e-12 * abs(self.value):
            self.length /= 4
            self.done = self.length < 1e-12
        else:
            if self.slope is not None:
                moved, turned = self.tried - self.at, slope - self.slope
                if (curve := moved @ turned) > 1e-14:
                    if not self.history:
                        self.bend = np.eye(len(moved)) * curve / (turned @ turned)
                    side = np.eye(len(moved)) - np.outer(moved, turned) / curve
                    self.bend = side @ self.bend @ side.T + np.outer(moved, moved) / curve
                    self.history.append(value)
            else:
                self.bend = np.eye(len(self.at)) / max(1.0, np.abs(slope).max())
            self.at, self.value, self.slope, self.residual, self.length = self.tried, value, slope, residual, 1.0
        # Components at the far end with nothing to gain rest there.
        free = ~((self.at >= FARTHEST) & (self.slope < 0))
        self.done = self.done or np.abs(self.slope[free]).max(initial=0) < ENOUGH * self.n
        way = -np.where(free, self.bend @ np.where(free, self.slope, 0.0), 0.0)
        if way @ self.slope >= 0:
            way = -np.where(free, self.slope, 0.0) / max(1.0, np.abs(self.slope).max())
        way *= min(1.0, 3.0 / max(np.abs(way).max(), 1e-300))
        self.tried = np.clip(self.at + self.length * way, -FARTHEST, FARTHEST)


def _sums(batches: Iterator[pd.DataFrame], sizes: dict[str, int], ratios: dict[str, float]) -> Iterator[pd.DataFrame]:
    """Per phenotype the sums over the absorbed levels that the likelihood needs at the given ratios, in one array."""
    sums: dict[str, list] = {}
    for pdf in batches:
        for name, rows in pdf[pdf["phenotype"].isin(list(ratios))].groupby("phenotype"):
            m = sizes[name]
            total = sums.setdefault(name, [np.zeros((m, m)), np.zeros((m, m)), np.zeros(m), np.zeros(m), np.zeros(4)])
            for i in range(0, len(rows), LEVELS_AT_ONCE):
                part = rows.iloc[i : i + LEVELS_AT_ONCE]
                w = np.zeros((len(part), m))
                line = np.repeat(np.arange(len(part)), part["at"].map(len))
                w[line, np.concatenate(part["at"].to_list())] = np.concatenate(part["n"].to_list())
                d, y = part["rows"].to_numpy() + ratios[name], part["sum"].to_numpy()
                once, twice = w / d[:, None], w / (d * d)[:, None]
                total[0] += w.T @ once
                total[1] += w.T @ twice
                total[2] += once.T @ y
                total[3] += twice.T @ y
                total[4] += [(y * y / d).sum(), (y * y / (d * d)).sum(), np.log(d).sum(), (1 / d).sum()]
    for name, parts in sums.items():
        yield pd.DataFrame({"phenotype": [name], "sums": [np.concatenate([p.ravel() for p in parts])]})


def _scan(absorbed: DataFrame | pd.DataFrame, sizes: dict[str, int], ratios: dict[str, float]) -> dict[str, dict]:
    """The sums of :func:`_sums` over a table of levels, or over one that is here already."""
    if isinstance(absorbed, pd.DataFrame):
        rows = [r for part in _sums(iter([absorbed]), sizes, ratios) for r in part.to_dict("records")]
    else:
        rows = absorbed.mapInPandas(lambda batches: _sums(batches, sizes, ratios), "phenotype string, sums array<double>").collect()
    found: dict[str, dict] = {}
    for row in rows:
        m, flat = sizes[row["phenotype"]], np.array(row["sums"], np.float64)
        cut = np.split(flat, np.cumsum([m * m, m * m, m, m]))
        part = {"t1": cut[0].reshape(m, m), "t2": cut[1].reshape(m, m), "v1": cut[2], "v2": cut[3]} | dict(zip(("s1", "s2", "log", "one"), cut[4]))
        known = found.get(row["phenotype"])
        found[row["phenotype"]] = {k: known[k] + part[k] for k in part} if known else part
    return found


def reml_partition(
    df: DataFrame, phenotypes: Sequence[str], factors: Sequence[str], score: str | None = "sam_score", score_digits: int = 2,
) -> DataFrame:
    """(phenotype, component, variance, percent) at the maximum of the restricted likelihood.

    Rows with a missing factor are left out; a missing phenotype only leaves out its own row.
    """
    spark = df.sparkSession
    stacked = F.explode(F.array(*[F.struct(F.lit(p).alias("phenotype"), F.col(p).cast("double").alias("y")) for p in phenotypes])).alias("_p")
    base = durable(
        _complete(df, factors, score, score_digits).select(*[f"_f_{f}" for f in factors], stacked).select("*", "_p.phenotype", "_p.y").drop("_p").filter("y is not null and not isnan(y)"),
        "reml-rows",
    )
    levels = base.agg(*[F.count_distinct(f"_f_{f}").alias(f) for f in factors]).head()
    large = max(factors, key=lambda f: levels[f])
    small = [f for f in factors if f != large]
    if sum(levels[f] for f in small) > MOST_LEVELS:
        raise ValueError(f"factors {small} have more than {MOST_LEVELS} levels together")
    shift = base.groupBy("phenotype").agg(F.avg("y").alias("_mean"))
    centred = base.join(F.broadcast(shift), "phenotype").withColumn("y", F.col("y") - F.col("_mean")).drop("_mean")
    # Levels of the small factors by number; the intercept, a level of every row, is number 0.
    every = F.explode(F.array(F.struct(F.lit(-1).alias("k"), F.lit("").alias("level")), *[F.struct(F.lit(k).alias("k"), F.col(f"_f_{f}").alias("level")) for k, f in enumerate(small, 1)]))
    each = centred.withColumn("_l", every)
    totals = each.groupBy("phenotype", "_l").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).select("phenotype", "_l.*", "n", "s").collect()
    squares = {r["phenotype"]: r["q"] for r in centred.groupBy("phenotype").agg(F.sum(F.col("y") * F.col("y")).alias("q")).collect()}
    numbers: dict[str, dict] = {}
    for r in sorted(totals, key=lambda r: (r["phenotype"], r["k"], r["level"])):
        mine = numbers.setdefault(r["phenotype"], {})
        mine[(r["k"], r["level"])] = len(mine)
    index = spark.createDataFrame([(p, k, v, i) for p, m in numbers.items() for (k, v), i in m.items()], "phenotype string, k int, level string, at int")
    numbered = each.select("phenotype", F.col(f"_f_{large}").alias("large"), "y", "_l.*").join(F.broadcast(index), ["phenotype", "k", "level"])
    cells = numbered.groupBy("phenotype", "large", "at").agg(F.count(F.lit(1)).cast("double").alias("n"))
    own = centred.groupBy("phenotype", F.col(f"_f_{large}").alias("large")).agg(F.count(F.lit(1)).cast("double").alias("rows"), F.sum("y").alias("sum"))
    # A row per level of the absorbed factor: at most as many cells as the small factors have levels.
    per_level = cells.groupBy("phenotype", "large").agg(F.collect_list(F.struct("at", "n")).alias("c")).join(own, ["phenotype", "large"])
    absorbed = durable(
        per_level.select("phenotype", F.col("c.at").alias("at"), F.col("c.n").alias("n"), "rows", "sum").repartition(-(-levels[large] * len(phenotypes) // LEVELS_OF_TASK)),
        "reml-levels",
    )
    pairs = _pairs(centred, small, index)
    large_levels = {r["phenotype"]: r["q"] for r in absorbed.groupBy("phenotype").agg(F.count(F.lit(1)).alias("q")).collect()}
    searches: dict[str, _Search] = {}
    for name, mine in numbers.items():
        m = len(mine)
        owner = np.array([k for k, _ in mine])
        sums = np.zeros(m)
        for r in totals:
            if r["phenotype"] == name:
                sums[mine[(r["k"], r["level"])]] = r["s"]
        counts = np.zeros((m, m))
        for r in pairs:
            if r["phenotype"] == name:
                counts[r["a"], r["b"]] = counts[r["b"], r["a"]] = r["n"]
        quantity = np.array([large_levels[name], *[(owner == k).sum() for k in range(1, len(small) + 1)]], float)
        start = np.full(len(factors), np.log(len(factors)))
        searches[name] = _Search(counts[0, 0], squares[name], counts, sums, owner, quantity, start, tried=start)
    sizes = {name: len(mine) for name, mine in numbers.items()}
    # A table that one task would read is fetched once; its size is bounded by that.
    table = absorbed.toPandas() if sum(large_levels.values()) <= LEVELS_HERE else absorbed
    for _ in range(STEPS):
        active = {name: s for name, s in searches.items() if not s.done}
        if not active:
            break
        found = _scan(table, sizes, {name: float(np.exp(s.tried[0])) for name, s in active.items()})
        for name, s in active.items():
            s.step(found[name])
    order = [large, *small]
    rows = []
    for name, s in searches.items():
        variance = {RESIDUAL: s.residual} | {f: s.residual * float(np.exp(-a)) for f, a in zip(order, s.at)}
        whole = sum(variance.values())
        rows += [(name, c, float(variance[c]), float(100 * variance[c] / whole) if whole > 0 else None) for c in (RESIDUAL, *factors)]
    return spark.createDataFrame(rows, "phenotype string, component string, variance double, percent double")


def _pairs(centred: DataFrame, small: Sequence[str], index: DataFrame) -> list:
    """(phenotype, a, b, n) for a <= b: rows that have both levels; at most the square of ``MOST_LEVELS``."""
    names = [F.struct(F.lit(-1).alias("k"), F.lit("").alias("level")), *[F.struct(F.lit(k).alias("k"), F.col(f"_f_{f}").alias("level")) for k, f in enumerate(small, 1)]]
    both = F.explode(F.array(*[F.struct(a.alias("a"), b.alias("b")) for i, a in enumerate(names) for b in names[i:]]))
    counted = centred.withColumn("_b", both).groupBy("phenotype", "_b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    side = lambda name: F.broadcast(index.select("phenotype", F.struct("k", "level").alias(f"_{name}"), F.col("at").alias(name)))
    flat = counted.select("phenotype", F.col("_b.a").alias("_a"), F.col("_b.b").alias("_c"), "n")
    return flat.join(side("a"), ["phenotype", "_a"]).join(side("c"), ["phenotype", "_c"]).select("phenotype", "a", F.col("c").alias("b"), "n").collect()
