import json

import numpy as np
import pytest
import rasters
from pyspark.sql import functions as F

from phenoweave.functions import colour
from phenoweave.operators import runs as R
from phenoweave.plans import phenotyping
from phenoweave.sinks import tables as sinks
from phenoweave.sources import rasters as sources
from phenoweave.sources import tables as sources_tables

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Image tree with blanks and plus signs in names, a broken file and files to skip."""
    base = tmp_path_factory.mktemp("field data")
    photos, masks = base / "photos", base / "masks"
    stem = "1403_LeafPhotoA_2025-09-08 09_22_57.928-05_00+1"
    pictures = {}
    for device in (1, 2):
        folder = photos / f"device{device}"
        folder.mkdir(parents=True)
        picture = RNG.integers(0, 256, (9, 14, 3)).astype(np.uint8)
        picture[2:6, 3:11] = (40, 160, 50)
        rasters.write_png(folder / f"{stem}.png", picture)
        pictures[f"device{device}_{stem}"] = picture
    (photos / "device1" / "77_broken.PNG").write_bytes(b"not an image")
    (photos / "device1" / "notes.txt").write_text("x")
    rasters.write_png(photos / "root.png", np.zeros((2, 2)))
    shapes = {}
    for image_id in pictures:
        for strip in (0, 1):
            folder = masks / image_id
            folder.mkdir(parents=True, exist_ok=True)
            mask = (RNG.random((12, 20)) < 0.4) & (strip == 0)
            rasters.write_png(folder / f"strip_{strip:04d}_mask.png", mask * 255)
            shapes[(image_id, strip)] = mask
        (folder / "strip_0000_box.txt").write_text("Box: [0, 2415, 3060, 3082]\nScore: 0.987839\n")
    return base, pictures, shapes


def test_catalogue(spark, tree):
    base, pictures, _ = tree
    rows = {r["image_id"]: r for r in sources.list_images(spark, str(base / "photos")).collect()}
    assert set(rows) == set(pictures) | {"device1_77_broken"}
    first = rows[sorted(pictures)[0]]
    assert (first["device"], first["plot"], first["subdirectory"]) == (1, 1403, "device1")


def test_catalogue_does_not_read_contents(spark, tree):
    df = sources.list_images(spark, str(tree[0] / "photos"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_failed_rasters(spark, tree):
    photos = str(tree[0] / "photos")
    failed = sources.failed_rasters(sources.list_images(spark, photos), sources.read_rasters(spark, photos)).collect()
    assert [r[0].rsplit("/", 1)[1] for r in failed] == ["77_broken.PNG"]


def test_pixels_and_green_runs_agree(spark, tree):
    base, pictures, _ = tree
    raw = sources.read_rasters(spark, str(base / "photos"))
    keyed = raw.withColumn("image_id", F.regexp_replace(F.regexp_extract("path", r"([^/]+/[^/]+)\.\w+$", 1), "/", "_"))
    keyed = keyed.filter(F.col("image_id").startswith("device"))
    pixels = sources.pixel_rows(keyed, ["image_id"])
    found = {(r["image_id"], r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in pixels.collect()}
    assert len(found) == 2 * 9 * 14
    for image_id, picture in pictures.items():
        for y in range(9):
            for x in range(14):
                assert found[(image_id, y, x)] == tuple(picture[y, x])
    h, s, v = colour.hsv(F.col("r"), F.col("g"), F.col("b"))
    tested = pixels.withColumn("green", colour.is_green(h, s, v))
    marked = R.pixels_in_mask(tested, sources.green_runs(keyed, ["image_id"])).collect()
    assert any(r["green"] for r in marked) and all(r["green"] == r["in_mask"] for r in marked)


def test_masks_and_sidecars_give_the_measurement_table(spark, tree, tmp_path):
    base, _, shapes = tree
    read = sources.read_masks(spark, str(base / "masks"))
    runs = sources.mask_runs(read, ["image_id", "strip_id"])
    got = {}
    for r in runs.collect():
        got.setdefault((r["image_id"], r["strip_id"]), []).append(r)
    for key, mask in shapes.items():
        assert (rasters.from_runs(got.get(key, []), mask.shape) == mask).all()
    boxes = sources.read_box_sidecars(spark, str(base / "masks"))
    assert boxes.count() == 2
    table = phenotyping.measure_masks(read, runs, boxes)
    rows = {(r["image_id"], r["strip_id"]): r for r in table.collect()}
    assert len(rows) == 4
    for (image_id, strip), r in rows.items():
        assert r["area_px"] == shapes[(image_id, strip)].sum()
        assert r["box_coords"] == ("[0, 2415, 3060, 3082]" if strip == 0 else None)
        assert r["sam_score"] == (0.987839 if strip == 0 else None)
    sinks.write_measurements(table, str(tmp_path / "m"))
    back = sources_tables.read_measurements(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.drop("image_id").collect()))
    wide = table.withColumn("subdirectory", F.lit("device1"))
    sinks.write_measurements(wide, str(tmp_path / "w"), with_subdirectory=True, identifier_as_subdirectory=True)
    again = sources_tables.read_measurements(spark, str(tmp_path / "w"), with_subdirectory=True)
    assert again.filter("subdirectory <> image_name").count() == 0


def test_text_tables(spark, tmp_path):
    (tmp_path / "map.csv").write_text("plot , genotype,row,range \n1,PI 5,2,3\n2,BTx378,4,\n")
    got = [tuple(r) for r in sources_tables.read_field_map(spark, str(tmp_path / "map.csv")).collect()]
    assert got == [(1, "PI 5", 2, 3), (2, "BTx378", 4, None)]
    (tmp_path / "p.fam").write_text("0\tSC0448\t0\t0\t0\t-9\n0\tPI534006\t0\t0\t0\t-9\n")
    assert [r["vcf_name"] for r in sources_tables.read_fam(spark, str(tmp_path / "p.fam")).collect()] == ["SC0448", "PI534006"]
    (tmp_path / "s.csv").write_text("image_path,subdirectory,image_name,num_boxes_detected,reason\na/b.jpg,a,b,1,fewer_than_2_boxes\n")
    assert sources_tables.read_skipped(spark, str(tmp_path / "s.csv")).first()["num_boxes_detected"] == 1
    (tmp_path / "log.csv").write_text("epoch,train_loss,val_loss,learning_rate\n1,3.9,3.5,0.0001\n")
    assert sources_tables.read_training_log(spark, str(tmp_path / "log.csv"), "run").first()["run_id"] == "run"
    (tmp_path / "ids.txt").write_text("PI548797\nSC1166\n")
    assert sources_tables.read_genotype_list(spark, str(tmp_path / "ids.txt")).count() == 2


def test_json_documents(spark, tmp_path):
    (tmp_path / "splits.json").write_text(
        json.dumps({"train_genotypes": ["a", "b"], "val_genotypes": ["c"], "test_genotypes": []}, indent=2)
    )
    rows = sources_tables.read_genotype_splits(spark, str(tmp_path / "splits.json")).collect()
    assert sorted(map(tuple, rows)) == [("a", "train"), ("b", "train"), ("c", "val")]
    part = lambda v: {"total_loss": v, "reconstruction_loss": v / 2, "l1_loss": 0.1, "mean_weight": 1.5}
    (tmp_path / "history.json").write_text(
        json.dumps(
            {"train_losses": [part(4.0), part(3.0)], "val_losses": [part(5.0), part(2.0)], "best_val_loss": 2.0,
             "total_epochs": 2, "training_time_hours": 1.5},
            indent=2,
        )
    )
    rows = sources_tables.read_training_history(spark, str(tmp_path / "history.json")).orderBy("epoch").collect()
    assert [(r["epoch"], r["train_total_loss"], r["val_total_loss"], r["val_reconstruction_loss"]) for r in rows] == [
        (1, 4.0, 5.0, 2.5), (2, 3.0, 2.0, 1.0)
    ]
    image = {"device": 1, "plot": 3, "filename": "3_a.jpg", "genotype": "g"}
    (tmp_path / "images.json").write_text(json.dumps({"train": [image], "val": [], "test": [image]}, indent=2))
    assert sorted(r["split"] for r in sources_tables.read_image_splits(spark, str(tmp_path / "images.json")).collect()) == ["test", "train"]
    # Golden: 8-bit Lab statistics; their mean saturates the disease weight at 2.
    (tmp_path / "lab.json").write_text(
        json.dumps({"lab_mean": [56.60899862734766, 121.5206275555264, 138.4057507259372],
                    "lab_std": [15.300537451906097, 2.9269307149053305, 4.626063434365904]}, indent=2)
    )
    stats = sources_tables.read_lab_statistics(spark, str(tmp_path / "lab.json"))
    weight = stats.select(colour.disease_weight(F.col("mean_a"), F.col("mean_b")).alias("w")).first()["w"]
    assert weight == 2.0
    sinks.write_lab_statistics(stats, str(tmp_path / "lab-out"))
    assert sources_tables.read_lab_statistics(spark, str(tmp_path / "lab-out")).collect() == stats.collect()


def test_box_text_of_the_measurement_golden(spark):
    from phenoweave.functions.parse import box_from_text, device_of, plot_of

    rows = [("[0, 2415, 3060, 3082]", "device1_1403_LeafPhotoA"), ("[0, 1663, 3060, 2392]", "devicex_y"), ("nonsense", "plain"), (None, None)]
    df = spark.createDataFrame(rows, "t string, n string")
    got = df.select(box_from_text(F.col("t")), device_of(F.col("n")), plot_of(F.col("n"))).collect()
    assert got[0] == ([0, 2415, 3060, 3082], "1", 1403) and got[1] == ([0, 1663, 3060, 2392], "x", None)
    assert got[2][0] is None and got[2][2] is None and tuple(got[3]) == (None, None, None)
