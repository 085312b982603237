"""Explicit schemas of the file formats read and written."""

from __future__ import annotations

FAM = "fid INT, vcf_name STRING, father INT, mother INT, sex INT, pheno INT"

MEASUREMENTS = (
    "image_name STRING, strip_id INT, mean_height_px DOUBLE, median_height_px DOUBLE, min_height_px DOUBLE, "
    "max_height_px DOUBLE, height_range_px DOUBLE, area_px BIGINT, box_coords STRING, sam_score DOUBLE"
)
ALL_MEASUREMENTS = "subdirectory STRING, " + MEASUREMENTS
MEASUREMENT_COLUMNS = [c.split()[0] for c in MEASUREMENTS.split(", ")]

SKIPPED = "image_path STRING, subdirectory STRING, image_name STRING, num_boxes_detected INT, reason STRING"
REPROCESSED = (
    "image_path STRING, subdirectory STRING, image_name STRING, old_num_boxes INT, new_num_boxes INT, "
    "status STRING, reason STRING"
)
TRAINING_LOG = "epoch INT, train_loss DOUBLE, val_loss DOUBLE, learning_rate DOUBLE"

_LOSSES = "ARRAY<STRUCT<total_loss: DOUBLE, reconstruction_loss: DOUBLE, l1_loss: DOUBLE, mean_weight: DOUBLE>>"
TRAINING_HISTORY = (
    f"train_losses {_LOSSES}, val_losses {_LOSSES}, best_val_loss DOUBLE, total_epochs INT, training_time_hours DOUBLE"
)
GENOTYPE_SPLITS = "train_genotypes ARRAY<STRING>, val_genotypes ARRAY<STRING>, test_genotypes ARRAY<STRING>"
LAB_STATISTICS = "lab_mean ARRAY<DOUBLE>, lab_std ARRAY<DOUBLE>"

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
EMBEDDING_META = "filename STRING, plot INT, genotype STRING, device INT, split STRING"
