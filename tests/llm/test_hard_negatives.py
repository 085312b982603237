import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from phenoweave.llm import hard_negatives as hard

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
    # Names that the operator uses inside.
    T.StructField("row", T.StringType()), T.StructField("block", T.StringType()), T.StructField("anchor", T.LongType()), T.StructField("score", T.StringType()),
])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "r", None, 3, "s") for i, v, l in rows], SCHEMA)


def expected(rows, anchor, positives=5, negatives=10):
    """All answers as a multiset, by scoring every pair; Python numbers are exact."""
    usable = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (i, v, l) in enumerate(usable):
        if i is None or not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m, k) for m, (j, w, k) in enumerate(usable) if m != n and len(v) == len(w)]
        same, others = sorted(s for s in scored if s[4] == l)[:positives], sorted(s for s in scored if s[4] != l)
        for s in same:
            p = -s[0]
            inside = [o for o in others if 30 * p <= -100 * o[0] <= 90 * p][:negatives]
            out.update((i, None if s[1] else s[2], r + 1, None if o[1] else o[2], p, -o[0]) for r, o in enumerate(inside))
    return out


def answers(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [
        (None, [1.0, 0.5, 0.25], 1), (100, None, 1), (100, [1.0, None, 0.0], 1), (100, [nan, 0.0, 0.0], 1), (200, [inf, 0.0, 0.0], 2), (300, [1.0, 1.0, 1.0], None),
        (0, [], 1), (3, [], 1), (4, [], 2), (400, [0.0, 0.0, 0.0], 1), (500, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (6, [0.5, 1.5], 2),
        (600, [1e7, 1.0, -1.0], 3), (7, [1e7, 1.0, -1.0], 3), (8, [5e6, 3.0, 3.0], 4), (600, [1e7, 1.0, -1.0], 3),
    ]


@pytest.mark.parametrize("clustered", [False, True])
def test_equals_brute_force(spark, clustered):
    random = np.random.default_rng(5)
    centres = random.normal(size=(6, 24))
    rows = []
    for k in range(700):
        v = centres[k % 6] + 0.3 * random.normal(size=24) if clustered else random.normal(size=24)
        rows.append((k, [float(x) for x in np.round(v, 2)], int(random.integers(3)) if k % 9 else 0))
    # A third are copies of one row: every score of theirs is a tie.
    rows += [(1_000 + k, rows[11][1], k % 2) for k in range(350)] + [rows[20], rows[20]]
    rows += odd_rows()
    found = hard.hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0)
    assert answers(found) == expected(rows, lambda i: i % 100 == 0)


def test_no_rows(spark):
    assert hard.hard_negatives(frame(spark, []), F.lit(True)).collect() == []
    assert hard.hard_negatives(frame(spark, [(1, [1.0], 1)]), F.col("vec_id") > 1).collect() == []


def test_bounds_hold_and_filter():
    random = np.random.default_rng(1)
    x = np.floor(40 * np.repeat(random.normal(size=(300, 8)), 8, axis=1) + 3 * random.normal(size=(300, 64)))
    exact, width = x @ x.T, np.inf
    for level in (*hard.LEVELS, 64):
        low, high = hard.bounds(*hard.segment_summary(x, level), *hard.segment_summary(x, level))
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low).mean() < width
        width = (high - low).mean()
    # Piecewise even vectors: the short segments leave few rows to score.
    assert (high - low).max() < 1e-3 * np.abs(exact).max()


def test_far_scores_are_held():
    big = np.array([[2**62, 2**62], [-(2**62), 0], [3, 4]], np.int64)
    assert hard.scores(big, big[0]).tolist() == [2**63 - 1, -(2**63), 2**63 - 1]
    assert hard.scores(np.zeros((2, 0), np.int64), np.zeros(0, np.int64)).tolist() == [0, 0]


def test_few_rows_are_scored(monkeypatch):
    """On vectors whose segments are even, the summaries decide most rows."""
    random = np.random.default_rng(2)
    x = np.floor(256 * (np.repeat(random.normal(size=(2000, 16)), 4, axis=1) + 0.02 * random.normal(size=(2000, 64))))
    table = list(hard._packed(iter([pa.RecordBatch.from_arrays(
        [pa.array(range(2000)), pa.array(["a"] * 2000), pa.array([True] * 2000), pa.array(list(x / 256.0), pa.list_(pa.float64()))], ["id", "label", "anchor", "vector"])]), 256.0))[0]
    rows = hard._Rows(pa.Table.from_batches([table]).append_column("row", pa.array(range(2000))), 64)
    scored, real = [], hard.scores
    monkeypatch.setattr(hard, "scores", lambda r, a: scored.append(len(r)) or real(r, a))
    low, high = hard.bounds(*rows.levels[0], *rows.levels[0])
    for i in range(0, 2000, 100):
        best, score = hard.best_positives(rows, i, rows, low[i], high[i], 0, 5)
        want = sorted((-int(s), int(j)) for j, s in enumerate(rows.whole.astype(int) @ rows.whole[i].astype(int)) if j != i)[:5]
        assert [(-int(s), int(rows.id[b])) for b, s in zip(best, score)] == [(s, int(rows.id[j])) for s, j in want]
    assert np.mean(scored) < 100
