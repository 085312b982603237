"""The derived tables of :mod:`phenoweave.registry.tables` as oracle SQL."""

from __future__ import annotations

import re

from phenoweave.operators.colourfit import REFERENCE_PATCHES

_REFERENCE = ", ".join(
    f"({i}, {r}.0::DOUBLE, {g}.0::DOUBLE, {b}.0::DOUBLE)" for i, (r, g, b) in enumerate(REFERENCE_PATCHES)
)

# Merged runs of a raw run table: gaps and islands over sorted runs.
_MERGE = """
  SELECT {keys}, y, min(x_start) AS x_start, max(x_end) AS x_end FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY {keys}, y ORDER BY x_start, x_end ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN x_start <= max(x_end) OVER (PARTITION BY {keys}, y ORDER BY x_start, x_end
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM raw_runs) t) u
  GROUP BY {keys}, y, island"""

TABLES = {
    "images": """
  SELECT o_orderkey AS image_id, CAST(o_custkey % 8 + 1 AS INTEGER) AS device, CAST(o_custkey AS INTEGER) AS plot,
    o_custkey || '_LeafPhotoA_' || o_orderkey || '.jpg' AS filename,
    'device' || (o_custkey % 8 + 1) || '_' || o_custkey || '_LeafPhotoA_' || o_orderkey AS image_name,
    '/data/device' || (o_custkey % 8 + 1) || '/' || o_custkey || '_LeafPhotoA_' || o_orderkey || '.jpg' AS image_path
  FROM orders""",
    "field_map": """
  SELECT CAST(c_custkey AS INTEGER) AS plot, c_mktsegment || '-' || (c_custkey % 300) AS genotype,
    CAST(c_custkey % 30 AS INTEGER) AS "row", CAST(c_nationkey AS INTEGER) AS "range" FROM customer""",
    "image_genotypes": """
  SELECT i.*, f.genotype, f."row", f."range" FROM images i JOIN field_map f USING (plot)""",
    "strips": """
  SELECT s.*, i.image_name FROM (
    SELECT l_orderkey AS image_id, CAST(l_linenumber % 2 AS INTEGER) AS strip_id, avg(l_quantity) AS mean_height_px,
      median(l_quantity) AS median_height_px, min(l_quantity) AS min_height_px, max(l_quantity) AS max_height_px,
      max(l_quantity) - min(l_quantity) AS height_range_px, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS area_px,
      '[' || min(l_suppkey) || ', ' || min(l_partkey % 1000) || ', ' || (max(l_suppkey) + 100) || ', '
        || (max(l_partkey % 1000) + 30) || ']' AS box_coords,
      max(l_discount + 0.0) AS sam_score
    FROM lineitem GROUP BY 1, 2) s JOIN images i USING (image_id)""",
    "raw_runs": """
  SELECT l_orderkey AS image_id, CAST(l_linenumber % 2 AS INTEGER) AS strip_id, CAST(l_partkey % 50 AS INTEGER) AS y,
    l_suppkey % 100 AS x_start, l_suppkey % 100 + CAST(l_quantity AS BIGINT) - 1 AS x_end FROM lineitem""",
    "strip_runs": _MERGE.format(keys="image_id, strip_id"),
    "leaf_runs": _MERGE.format(keys="image_id"),
    "frames": "SELECT o_orderkey AS image_id, 150 AS width, 50 AS height FROM orders",
    "features": """
  SELECT *, w / h AS aspect_ratio, area / (w * h) AS extent, y + h / 2 AS centroid_y, 1210 AS image_height FROM (
    SELECT l_orderkey AS image_id, CAST(l_suppkey AS INTEGER) AS x, CAST(l_partkey % 1000 AS INTEGER) AS y,
      CAST(l_quantity * 20 AS INTEGER) AS w, l_linenumber * 30 AS h, CAST(floor(l_extendedprice) AS BIGINT) AS area
    FROM lineitem)""",
    "detections": """
  SELECT i.image_id, i.image_path, 'device' || i.device AS subdirectory, i.image_name,
    CAST(CASE WHEN n IS NULL AND o_orderpriority = '5-LOW' THEN -1 ELSE coalesce(n, 0) END AS INTEGER) AS num_boxes_detected
  FROM images i JOIN orders o ON o.o_orderkey = i.image_id
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = i.image_id""",
    "classified": """
  SELECT *, CASE WHEN num_boxes_detected < 0 THEN 'failed' WHEN num_boxes_detected <> 2 THEN 'skipped' ELSE 'ready' END AS outcome,
    CASE WHEN num_boxes_detected IN (0, 1) THEN 'fewer_than_2_boxes' WHEN num_boxes_detected > 2 THEN 'more_than_2_boxes' END AS reason,
    num_boxes_detected IN (0, 1) AS needs_fallback FROM detections""",
    "redetections": """
  SELECT i.image_path, CASE WHEN n < 7 THEN CAST(n AS INTEGER) END AS new_num_boxes, CASE WHEN q > 250 THEN 'timeout' END AS error
  FROM (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) l
  JOIN images i ON i.image_id = l.l_orderkey""",
    "reprocessed": """
  SELECT s.image_path, s.subdirectory, s.image_name, s.num_boxes_detected AS old_num_boxes,
    CASE WHEN r.image_path IS NULL OR r.error IS NOT NULL THEN -1 ELSE coalesce(r.new_num_boxes, -1) END AS new_num_boxes,
    CASE WHEN r.image_path IS NULL OR r.error IS NOT NULL THEN 'failed' WHEN r.new_num_boxes IS NULL THEN 'unknown'
      WHEN r.new_num_boxes = 2 THEN 'success_now_correct' ELSE 'success_still_wrong' END AS status,
    CASE WHEN r.image_path IS NULL THEN 'image_not_found' WHEN r.error IS NOT NULL THEN r.error
      WHEN r.new_num_boxes IS NULL THEN 'could_not_parse_output' WHEN r.new_num_boxes = 2 THEN 'now_detects_2_boxes'
      ELSE 'still_detects_' || r.new_num_boxes || '_boxes' END AS reason
  FROM (SELECT * FROM classified WHERE outcome = 'skipped') s LEFT JOIN redetections r USING (image_path)""",
    "pixels": """
  SELECT l_orderkey AS image_id, CAST(l_partkey % 50 AS INTEGER) AS y,
    CAST((l_partkey * 7 + l_linenumber) % 150 AS INTEGER) AS x, CAST(l_partkey % 256 AS INTEGER) AS r,
    CAST(l_suppkey * 7 % 256 AS INTEGER) AS g, CAST(l_orderkey % 256 AS INTEGER) AS b, l_returnflag <> 'R' AS in_mask
  FROM lineitem""",
    "reference": f"SELECT * FROM (VALUES {_REFERENCE}) v(patch_idx, ref_r, ref_g, ref_b)",
    "patches": """
  SELECT o_orderkey AS image_id, patch_idx,
    ref_r * 0.75::DOUBLE + ref_g * 0.125::DOUBLE + (o_orderkey % 7)::DOUBLE + ((patch_idx * 7 + o_orderkey) % 5)::DOUBLE AS r,
    ref_g * 0.875::DOUBLE + 4::DOUBLE + ((patch_idx * 7 + o_orderkey) % 5)::DOUBLE * 2 AS g,
    ref_b * 0.75::DOUBLE + ref_r * 0.0625::DOUBLE + (o_orderkey % 7)::DOUBLE * 2 + 3 AS b
  FROM orders, reference""",
    "recon_pixels": """
  SELECT l_orderkey AS image_id, CAST(l_linenumber % 3 AS INTEGER) AS channel, l_tax + 0.0 AS target, l_discount + 0.0 AS recon,
    l_returnflag <> 'R' AS in_mask FROM lineitem""",
    "image_errors": """
  SELECT image_id, mse, mae, 10 * log10(1.0 / (mse + 1e-8)) AS psnr, "L_mae", a_mae, b_mae FROM (
    SELECT image_id, sum(sq) / nullif(n0, 0) AS mse, sum(ab) / nullif(n0, 0) AS mae,
      sum(CASE WHEN channel = 0 THEN ab ELSE 0 END) / nullif(n0, 0) AS "L_mae",
      sum(CASE WHEN channel = 1 THEN ab ELSE 0 END) / nullif(n0, 0) AS a_mae,
      sum(CASE WHEN channel = 2 THEN ab ELSE 0 END) / nullif(n0, 0) AS b_mae
    FROM (SELECT *, CASE WHEN in_mask THEN (target - recon) * (target - recon) ELSE 0 END AS sq,
        CASE WHEN in_mask THEN abs(target - recon) ELSE 0 END AS ab,
        count(*) FILTER (WHERE in_mask AND channel = 0) OVER (PARTITION BY image_id) AS n0 FROM recon_pixels)
    GROUP BY image_id, n0)""",
    "recon_metrics": """
  SELECT e.*, g.genotype, g.device FROM image_errors e JOIN image_genotypes g USING (image_id) WHERE mse IS NOT NULL""",
    "vectors": """
  SELECT vec_id AS image_id, 'g' || label AS genotype, CAST(vec_id % 8 AS INTEGER) AS device, embedding FROM embeddings""",
    "clusters": """
  SELECT vec_id AS image_id, 'g' || label AS genotype, CAST(vec_id % 6 - 1 AS INTEGER) AS cluster FROM embeddings""",
    "training_log": """
  SELECT user_id AS run_id, CAST(day(ts) AS INTEGER) AS epoch,
    sum(CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END)::DOUBLE
      / nullif(count(*) FILTER (WHERE event_type <> 'error') * 100.0::DOUBLE, 0) AS train_loss,
    sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / (count(*) * 100.0::DOUBLE) AS val_loss
  FROM events GROUP BY 1, 2""",
}


def with_tables(sql: str) -> str:
    """Put the definitions of every derived table the SQL mentions in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in TABLES.items():
            if name not in needed and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    recursive = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    head = ",\n".join(f"{n} AS ({TABLES[n]})" for n in needed)
    if recursive:
        word = "WITH RECURSIVE" if recursive.group(1) else "WITH"
        return f"{word} {head},\n{sql[recursive.end():].strip()}"
    return f"WITH {head}\n{sql.strip()}"
