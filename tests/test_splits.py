import pandas as pd
import pytest
from pyspark.sql import functions as F

from phenoweave.operators import catalog, splits, topk
from phenoweave.plans import genetics, splitting


@pytest.fixture(scope="module")
def images(spark):
    rows = [(f"i{g}_{k}", f"g{g:03d}") for g in range(120) for k in range(1 + g % 9)]
    rows += [(f"hot_{k}", "hot") for k in range(400)] + [("none", None)]
    return spark.createDataFrame(rows, "image_id string, genotype string")


def test_split_is_disjoint_complete_and_stable(images):
    a = splits.assign_groups(images.repartition(7), "genotype")
    b = splits.assign_groups(images.coalesce(1), "genotype")
    first = {r["genotype"]: (r["images"], r["split"]) for r in a.collect()}
    assert first == {r["genotype"]: (r["images"], r["split"]) for r in b.collect()}
    assert len(first) == 121
    assert all(split == "train" for n, split in first.values() if n < 3)
    large = [split for n, split in first.values() if n >= 3]
    n = len(large)
    assert (large.count("train"), large.count("val")) == (int(n * 0.70), int(n * 0.15))
    other = splits.assign_groups(images, "genotype", seed=7)
    assert first != {r["genotype"]: (r["images"], r["split"]) for r in other.collect()}
    rows = splits.split_rows(images, a, "genotype")
    assert rows.count() == images.count() - 1 and splits.leaking_groups(rows, "genotype").count() == 0


def test_published_split_golden(spark):
    """Published sizes: images and genotypes of the three splits."""
    sizes = {"train": (4316, 677), "val": (814, 141), "test": (820, 143)}
    rows = [(s, f"{s}{i % g}") for s, (n, g) in sizes.items() for i in range(n)]
    summary = {r["split"]: r for r in splits.split_summary(spark.createDataFrame(rows, "split string, genotype string"), "genotype").collect()}
    assert (summary["TOTAL"]["images"], summary["TOTAL"]["groups"]) == (5950, 961)
    assert {s: (round(r["percent"], 1), round(r["images_per_group"], 2)) for s, r in summary.items() if s != "TOTAL"} == {
        "train": (72.5, 6.38), "val": (13.7, 5.77), "test": (13.8, 5.73)
    }


def test_prepare_splits(spark):
    images = spark.createDataFrame(
        [(f"d1_{p}_{k}", 1, f"{p}_x{k}.jpg") for p in range(30) for k in range(4)] + [("bad", 1, "nopl.jpg")],
        "image_id string, device int, filename string",
    )
    masks = images.select("image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("strip_id")).filter(
        "not (image_id = 'd1_3_1' and strip_id = 1)"
    )
    field = spark.createDataFrame([(p, f"g{p % 10}", p) for p in range(29)] + [(5, "late", 99)], "plot int, genotype string, line int")
    rows, assigned = splitting.prepare_splits(images, masks, field, order="line")
    assert rows.count() == 29 * 4 - 1
    assert {r["genotype"] for r in rows.filter("plot = 5").collect()} == {"late"}
    assert assigned.count() == 11


def test_duplicate_plots_are_reported(spark):
    field = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "plot int, genotype string")
    with pytest.raises(ValueError, match=r"repeated: \[1\]"):
        catalog.with_field_map(spark.createDataFrame([(1,)], "plot int"), field)


def test_reprocessing_statuses(spark):
    skipped = spark.createDataFrame([(f"p{i}", "s", f"n{i}", i) for i in range(5)], "image_path string, subdirectory string, image_name string, num_boxes_detected int")
    found = spark.createDataFrame(
        [("p0", 2, None), ("p1", 3, None), ("p2", None, None), ("p3", None, "timeout")], "image_path string, new_num_boxes int, error string"
    )
    rows = {r["image_path"]: tuple(r)[3:] for r in catalog.reprocessing_results(skipped, found).collect()}
    assert rows == {
        "p0": (0, 2, "success_now_correct", "now_detects_2_boxes"), "p1": (1, 3, "success_still_wrong", "still_detects_3_boxes"),
        "p2": (2, -1, "unknown", "could_not_parse_output"), "p3": (3, -1, "failed", "timeout"), "p4": (4, -1, "failed", "image_not_found"),
    }
    summary = catalog.reprocessing_summary(catalog.reprocessing_results(skipped, found)).first()
    assert (summary["successful"], summary["failed"], summary["now_correct"]) == (3, 2, 1)
    assert summary["improvement_rate"] == pytest.approx(100 / 3)
    none = catalog.reprocessing_summary(catalog.reprocessing_results(skipped, found.filter("error is not null"))).first()
    assert none["improvement_rate"] is None


def test_box_gate_branches(spark):
    df = spark.createDataFrame([(f"i{n}", n) for n in (-1, 0, 1, 2, 3)], "image_id string, num_boxes_detected int")
    got = {r["num_boxes_detected"]: (r["outcome"], r["reason"], r["needs_fallback"]) for r in catalog.classify_boxes(df, 1, 1).collect()}
    assert got == {
        -1: ("failed", None, False), 0: ("skipped", "fewer_than_1_boxes", True), 1: ("ready", None, True),
        2: ("skipped", "more_than_1_boxes", False), 3: ("skipped", "more_than_1_boxes", False),
    }


def test_genotype_panel_golden(spark):
    """Names of the sequenced panel and the phenotype ids they stand for."""
    from phenoweave.functions.parse import phenotype_genotype

    names = {"PI534006": "PI 534006", "SC0448": "SC0448", "BTx378": "PI 655991", "RTx430": "PI 655996", "PIPI1": "PI PI1"}
    df = spark.createDataFrame([(n,) for n in names], "vcf_name string")
    got = df.select("vcf_name", phenotype_genotype(F.col("vcf_name"))).collect()
    assert {r[0]: r[1] for r in got} == names
    columns = ["mean_height_px", "median_height_px", "min_height_px", "max_height_px", "height_range_px", "area_px"]
    leaf = spark.createDataFrame([(g, *[float(i)] * 6) for i, g in enumerate(["PI 534006", "PI 655991", "PI 1", None])], ["genotype", *columns])
    table = genetics.association_table(leaf, df)
    assert sorted(r["genotype"] for r in table.collect()) == ["BTx378", "PI534006"]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "v double")
    rows = topk.histogram(df, "v", 10).collect()
    assert sum(r["n"] for r in rows) == 5 and len(rows) == 10


def test_evenly_spaced_follows_the_slice(images):
    rows = images.filter("genotype is not null").select("image_id")
    names = sorted(r[0] for r in rows.collect())
    for n in (5, 7, 10_000):
        got = sorted(r[0] for r in topk.evenly_spaced(rows, ["image_id"], n).collect())
        assert got == names[:: max(1, len(names) // n)][:n]


def test_worker_functions_travel_without_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from phenoweave.operators import runs

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(runs._filter_bands))
    code = (
        "import pickle, numpy as np; f = pickle.load(open('f.pkl', 'rb'));"
        "print(f(np.ones((1, 9, 9), bool), (('close', 3, 3, 1),)).sum())"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "81", out.stderr
