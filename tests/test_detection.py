import numpy as np
import pytest
import rasters
from pyspark.sql import functions as F

from phenoweave.operators import detection
from phenoweave.plans.detection import detect_strips

RNG = np.random.default_rng(6)


def gaussian(signal, sigma=5.0):
    weights = np.array(detection.gaussian_weights(sigma))
    radius = len(weights) // 2
    n = len(signal)
    at = np.arange(-radius, n + radius) % (2 * n)
    mirrored = np.asarray(signal, float)[np.where(at < n, at, 2 * n - 1 - at)]
    return np.convolve(mirrored, weights, mode="valid")


def profile_frame(spark, signals, value):
    rows = [(name, i, float(v)) for name, s in signals.items() for i, v in enumerate(s)]
    return spark.createDataFrame(rows, f"image_id string, row int, {value} double").repartition(4)


@pytest.fixture(scope="module")
def signals():
    return {"long": RNG.random(80) * 100, "short": RNG.random(7) * 100, "one": np.array([4.0]), "flat": np.zeros(30), "step": np.repeat([1.0, 50.0, 2.0], 20)}


def test_gaussian_smoothing_reflects(spark, signals):
    got = detection.smooth_gaussian(profile_frame(spark, signals, "brightness"), ["image_id"]).toPandas()
    for name, s in signals.items():
        mine = got[got.image_id == name].sort_values("row").smoothed.to_numpy()
        assert mine == pytest.approx(gaussian(s)), name


def test_moving_mean_pads_with_zeros(spark, signals):
    got = detection.smooth_mean(profile_frame(spark, signals, "brightness"), ["image_id"]).toPandas()
    for name, s in signals.items():
        mine = got[got.image_id == name].sort_values("row").smoothed.to_numpy()
        padded = np.concatenate([np.zeros(5), s, np.zeros(5)])
        assert mine == pytest.approx(np.convolve(padded, np.ones(11) / 11, mode="valid")), name


def midrib(s):
    lo, hi = len(s) // 3, 2 * len(s) // 3
    if hi <= lo:
        return None
    peak = lo + int(np.argmax(s[lo:hi]))
    mean = s[s > 0].mean() if (s > 0).any() else 0
    return peak if s[peak] > mean * 1.05 else None


def test_midrib_rule(spark, signals):
    got = detection.midrib_row(profile_frame(spark, signals, "smoothed"), ["image_id"]).collect()
    want = {n: midrib(s) for n, s in signals.items()}
    assert {r["image_id"]: r["midrib_row"] for r in got} == {n: v for n, v in want.items() if v is not None}


def prominent(x, minimum):
    """Peaks by definition, looking outward from every flat top."""
    found, i, n = [], 1, len(x)
    while i < n - 1:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < n and x[j + 1] < x[i]:
            left, a = x[i], i
            while a >= 0 and x[a] <= x[i]:
                left, a = min(left, x[a]), a - 1
            right, b = x[j], j
            while b < n and x[b] <= x[i]:
                right, b = min(right, x[b]), b + 1
            if x[i] - max(left, right) >= minimum:
                found.append((i + j) // 2)
        i = j + 1
    return found


def test_prominent_peaks_by_definition():
    for _ in range(300):
        x = RNG.integers(0, 8, RNG.integers(1, 40)).astype(float)
        assert detection._prominent_peaks(x, 2.0) == prominent(x, 2.0)


def test_valley_of_a_gap(spark):
    counts = np.concatenate([np.full(10, 50), [20, 5, 5, 5, 20], np.full(10, 50)])
    df = profile_frame(spark, {"a": counts, "b": np.full(20, 9)}, "pixels").withColumn("box_width", F.lit(60))
    assert [tuple(r) for r in detection.valley_row(df, ["image_id"]).collect()] == [("a", 12)]


def test_split_margin_and_clamp(spark):
    boxes = spark.createDataFrame([("a", 5, 100, 50, 200), ("b", 0, 10, 9, 20)], "image_id string, x1 int, y1 int, x2 int, y2 int")
    rows = detection.split_at(boxes, F.lit(110), 0.02).orderBy("image_id", "strip_id").collect()
    assert [tuple(r) for r in rows] == [("a", 0, 5, 100, 50, 108), ("a", 1, 5, 112, 50, 200), ("b", 0, 0, 10, 9, 110), ("b", 1, 0, 20, 9, 20)]


def test_score_bonus(spark):
    df = spark.createDataFrame([(60000, 5.0, 0.9), (60000, 1.0, 0.2), (100, 3.0, 0.5)], "area int, aspect double, extent double")
    got = [r[0] for r in df.select(detection.candidate_score(F.col("area"), F.col("aspect"), F.col("extent"))).collect()]
    assert got == pytest.approx([60000 * 1.5 * 1.3 * 1.2, 60000 * 1.2, 150])


# --- whole plan against a sequential version ---------------------------------


def sequential(mask, values, min_area, cleaned):
    """The choice of boxes on one image, written step by step."""
    filled = rasters.fill(cleaned)
    labels = rasters.label(filled)
    found = []
    for k in range(1, labels.max() + 1):
        ys, xs = np.nonzero(labels == k)
        x, y, w, h, area = xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, rasters.outline_area(labels == k)
        if area > min_area:
            score = area * (1.5 if w / h > 2 else 1) * (1.3 if area / (w * h) > 0.5 else 1) * (1.2 if area > 50000 else 1)
            found.append((-score, y, x, (x, y, x + w, y + h), y + h / 2))
    found.sort()
    chosen = []
    for c in found:
        if all(abs(c[4] - o[4]) >= 0.1 * mask.shape[0] for o in chosen):
            chosen.append(c)
        if len(chosen) == 2:
            break
    boxes = [c[3] for c in chosen]

    def rib(box):
        x1, y1, x2, y2 = box
        lit = np.where(cleaned[y1:y2, x1:x2], values[y1:y2, x1:x2], 0)
        return midrib(gaussian([r[r > 0].mean() if (r > 0).any() else 0 for r in lit]))

    def halves(box, cut, share):
        x1, y1, x2, y2 = box
        gap = int((y2 - y1) * share)
        return [(x1, y1, x2, max(y1, cut - gap)), (x1, min(y2, cut + gap), x2, y2)]

    if len(boxes) == 1 and len(found) == 1:
        row = rib(boxes[0])
        x1, y1, x2, y2 = boxes[0]
        if row is not None:
            boxes = halves(boxes[0], y1 + row, 0.02)
        else:
            valleys = prominent(-cleaned[y1:y2, x1:x2].sum(1).astype(float), 0.1 * (x2 - x1))
            if valleys:
                boxes = halves(boxes[0], y1 + valleys[len(valleys) // 2], 0)
    elif len(boxes) == 2:
        for outer, inner in (boxes, boxes[::-1]):
            if inner[0] >= outer[0] and inner[2] <= outer[2] and inner[1] >= outer[1] and inner[3] <= outer[3]:
                row = rib(outer)
                boxes = halves(outer, outer[1] + row, 0.02) if row is not None else halves(outer, (outer[1] + outer[3]) // 2, 0)
                break
    return sorted(boxes, key=lambda b: b[1])


def images():
    out = {}

    def new(name, shape=(60, 64)):
        out[name] = (np.zeros(shape, bool), np.full(shape, 100))
        return out[name]

    m, _ = new("two")
    m[5:15, 2:60] = m[30:44, 4:62] = True
    m, v = new("midrib")
    m[10:50, 2:60] = True
    v[27:31] = 220
    m, _ = new("valley")
    m[5:25, 2:60] = m[31:55, 2:60] = True
    m[25:31, 2:20] = True
    m, _ = new("plain")
    m[10:50, 2:60] = True
    m, _ = new("close_pair")
    m[5:14, 2:60] = True
    m[15:17, 2:30] = True
    m, v = new("nested")  # a frame-touching bracket around a bar
    m[4:56, 0:8] = m[4:10, 0:60] = m[50:56, 0:60] = True
    m[12:20, 14:50] = True
    m, v = new("nested_midrib")
    m[:] = out["nested"][0]
    v[28:32] = 240
    m, _ = new("small")
    m[3:6, 3:6] = True
    new("empty")
    m, _ = new("ring")
    m[10:50, 5:60] = True
    m[20:40, 20:50] = False
    m[28:34, 30:40] = True
    return out


@pytest.mark.parametrize("clean", [False, True])
def test_detection_plan(spark, clean):
    pictures = images()
    green = spark.createDataFrame(
        [r for n, (m, _) in pictures.items() for r in rasters.to_runs(m, n)], "image_id string, y int, x_start bigint, x_end bigint"
    )
    values = spark.createDataFrame(
        [(n, y, x, int(v[y, x])) for n, (_, v) in pictures.items() for y in range(60) for x in range(64)],
        "image_id string, y int, x int, v int",
    )
    frames = spark.createDataFrame([(n, 64, 60) for n in pictures], "image_id string, width int, height int")
    rows = detect_strips(green, values, frames, min_area=40, clean=clean).orderBy("image_id", "strip_id").collect()
    got = {}
    for r in rows:
        got.setdefault(r["image_id"], []).append((r["x1"], r["y1"], r["x2"], r["y2"]))
    for name, (mask, v) in pictures.items():
        cleaned = rasters.clean(mask) if clean else mask
        assert got.get(name, []) == sequential(mask, v, 40, cleaned), name


def test_every_image_gets_a_box_count(spark):
    from phenoweave.plans.detection import box_counts
    from phenoweave.plans.phenotyping import gate

    images = spark.createDataFrame([(n, f"/data/{n}.png") for n in ("two", "one", "none", "broken", "done")], "image_id string, image_path string")
    boxes = spark.createDataFrame([("two", 0), ("two", 1), ("one", 0)], "image_id string, strip_id int")
    unreadable = spark.createDataFrame([("/data/broken.png",), ("/data/broken.png",)], "image_path string")
    counts = box_counts(images, boxes, unreadable)
    assert {r.image_id: r.num_boxes_detected for r in counts.collect()} == {"two": 2, "one": 1, "none": 0, "broken": -1, "done": 0}
    done = spark.createDataFrame([("done",)], "image_id string")
    outcomes = {r.image_id: (r.outcome, r.needs_fallback) for r in gate(images, done, counts).collect()}
    assert outcomes == {"two": ("ready", False), "one": ("skipped", True), "none": ("skipped", True), "broken": ("failed", False)}
    # An image that detection has no row of counts as one without boxes, not as done.
    assert {r.image_id: r.num_boxes_detected for r in gate(images, done, counts.filter("image_id = 'two'")).collect()}["none"] == 0


def test_signals_travel_packed(spark):
    """Long and short signals and rows without a key; neighbouring rows are shuffled as one, the other columns stay with theirs."""
    from phenoweave.operators.packing import pack

    signals = {f"s{k}": RNG.random(n) * 100 for k, n in enumerate((1, 2, 63, 64, 65, 128, 200, 200, 41))}
    rows = [(name, i, float(v), f"{name}-{i}") for name, s in signals.items() for i, v in enumerate(s)] + [(None, 0, 5.0, "x"), (None, 3, 7.0, None)]
    shape = "image_id string, row int, brightness double, note string"
    whole = spark.createDataFrame(rows, shape).coalesce(1)
    assert pack(whole, ["image_id"]).count() == sum(-(-len(s) // 64) for s in signals.values()) + 2
    mixed = spark.createDataFrame([rows[i] for i in RNG.permutation(len(rows))], shape).repartition(3)
    for profile in (whole, mixed):
        found = detection.smooth_gaussian(profile, ["image_id"]).collect()
        assert len(found) == len(rows)
        for r in found:
            if r["image_id"] is None:
                assert r["smoothed"] == pytest.approx(r["brightness"]) and r["note"] == {0: "x", 3: None}[r["row"]]
            else:
                assert r["smoothed"] == pytest.approx(gaussian(signals[r["image_id"]])[r["row"]]) and r["note"] == f"{r['image_id']}-{r['row']}"


def test_batches_of_numbers_and_of_texts(spark):
    from phenoweave import session

    before = spark.conf.get(session.BATCH_BYTES)
    session.numeric_batches(spark)
    assert spark.conf.get(session.BATCH_BYTES) == str(2**31 - 1)
    session.text_batches(spark)
    assert int(spark.conf.get(session.BATCH_BYTES).rstrip("b")) < 2**31 - 1 and before
