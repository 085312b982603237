"""Group splits, their summaries, category counts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoweave.operators import splits, topk
from phenoweave.registry.core import register, rounded

# Splits by plot: groups of 1 to 25 images, so the small-group rule applies too.
_SIZES = "sizes AS (SELECT plot, count(*) AS images FROM images GROUP BY 1)"
_CUTS = """ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42' || plot), plot) - 1 AS r, count(*) OVER () AS n FROM sizes WHERE images >= 3),
  assigned AS (
    SELECT plot, images, CASE WHEN r < floor(n * 0.7::DOUBLE) THEN 'train'
      WHEN r < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranked
    UNION ALL SELECT plot, images, 'train' FROM sizes WHERE images < 3)"""
_ASSIGNED = f"WITH {_SIZES}, {_CUTS}"


def _assigned(t):
    return splits.assign_groups(t.images, "plot")


def _split_images(t):
    return splits.split_rows(t.images, _assigned(t), "plot")


register(
    "group_size_buckets",
    lambda t: splits.size_buckets(t.images, "plot"),
    f"""WITH {_SIZES} SELECT count(*) AS groups, count(*) FILTER (WHERE images = 1) AS one,
      count(*) FILTER (WHERE images = 2) AS two, count(*) FILTER (WHERE images BETWEEN 3 AND 10) AS three_to_ten,
      count(*) FILTER (WHERE images > 10) AS over_ten FROM sizes""",
)
register("group_split", _assigned, f"{_ASSIGNED} SELECT plot, images, split FROM assigned")
register(
    "split_images",
    lambda t: _split_images(t).select("image_id", "plot", "split"),
    f"{_ASSIGNED} SELECT i.image_id, i.plot, a.split FROM images i JOIN assigned a USING (plot)",
)
register(
    "split_summary",
    lambda t: rounded(splits.split_summary(_split_images(t), "plot")),
    f"""{_ASSIGNED}, s AS (SELECT i.image_id, i.plot, a.split FROM images i JOIN assigned a USING (plot)),
      c AS (SELECT coalesce(split, 'TOTAL') AS split, count(*) AS images, count(DISTINCT plot) AS groups FROM s GROUP BY ROLLUP (split))
      SELECT split, images, round(images * 100.0::DOUBLE / max(images) OVER (), 6) AS percent, groups,
        round(images::DOUBLE / groups, 6) AS images_per_group FROM c""",
)
register(
    "leaking_groups",
    lambda t: splits.leaking_groups(_split_images(t), "plot"),
    """SELECT plot, NULL::VARCHAR AS first_split, NULL::VARCHAR AS last_split FROM images WHERE false""",
)
register(
    "leaking_groups_of_row_split",
    lambda t: splits.leaking_groups(
        t.image_genotypes.withColumn(
            "split", F.when(F.col("image_id") % 3 == 0, "test").when(F.col("image_id") % 3 == 1, "train").otherwise("val")
        ),
        "genotype",
    ),
    """SELECT genotype, min(s) AS first_split, max(s) AS last_split FROM (
      SELECT genotype, CASE image_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END AS s FROM image_genotypes)
      GROUP BY 1 HAVING count(DISTINCT s) > 1""",
)
register(
    "split_group_lists",
    lambda t: splits.group_lists(_assigned(t), "plot"),
    f"""{_ASSIGNED} SELECT split, plot, row_number() OVER (PARTITION BY split ORDER BY plot) - 1 AS position FROM assigned""",
)
register(
    "union_of_splits",
    lambda t: _split_images(t)
    .filter("split = 'train'")
    .unionByName(_split_images(t).filter("split = 'val'"))
    .unionByName(_split_images(t).filter("split = 'test'"))
    .groupBy("split", "device")
    .agg(F.count(F.lit(1)).alias("images")),
    f"""{_ASSIGNED} SELECT split, device, count(*) AS images FROM images JOIN assigned USING (plot) GROUP BY 1, 2""",
)
register(
    "top_genotypes_per_split",
    lambda t: topk.top_k_per_group(
        splits.split_rows(t.image_genotypes, splits.assign_groups(t.image_genotypes, "genotype"), "genotype")
        .groupBy("split", "genotype")
        .agg(F.count(F.lit(1)).alias("images")),
        ["split"],
        "images",
        "genotype",
        10,
    ).select("split", "rank", "genotype", "images"),
    f"""WITH sizes AS (SELECT genotype AS plot, count(*) AS images FROM image_genotypes GROUP BY 1),
      {_CUTS}
      SELECT split, CAST(rank AS INTEGER) AS rank, plot AS genotype, images FROM (
        SELECT *, row_number() OVER (PARTITION BY split ORDER BY images DESC, plot) AS rank FROM assigned) WHERE rank <= 10""",
)
register(
    "genotype_counts_top20",
    lambda t: topk.most_common(t.image_genotypes, "genotype", 20),
    "SELECT genotype, count(*) AS images FROM image_genotypes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
register(
    "restrict_to_top_genotypes",
    lambda t: topk.restrict_to_most_common(t.image_genotypes, "genotype", 10).select("image_id", "genotype"),
    """SELECT image_id, genotype FROM image_genotypes WHERE genotype IN (
      SELECT genotype FROM image_genotypes GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)""",
)
register(
    "outside_top_genotypes",
    lambda t: topk.outside_most_common(t.image_genotypes, "genotype", 10).groupBy("device").agg(F.count(F.lit(1)).alias("images")),
    """SELECT device, count(*) AS images FROM image_genotypes WHERE genotype NOT IN (
      SELECT genotype FROM image_genotypes GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) GROUP BY 1""",
)
register(
    "genotype_with_other_bucket",
    lambda t: topk.bucket_other(t.image_genotypes, "genotype", 10).groupBy("bucket").agg(F.count(F.lit(1)).alias("images")),
    """SELECT CASE WHEN t.genotype IS NULL THEN 'Other' ELSE g.genotype END AS bucket, count(*) AS images
      FROM image_genotypes g LEFT JOIN (SELECT genotype FROM image_genotypes GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) t
      ON t.genotype = g.genotype GROUP BY 1""",
)
register(
    "distinct_counts_per_device",
    lambda t: topk.distinct_counts(t.image_genotypes, ["device"], ["genotype", "plot"]),
    """SELECT device, count(DISTINCT genotype) AS distinct_genotype, count(DISTINCT plot) AS distinct_plot
      FROM image_genotypes GROUP BY 1""",
)
register(
    "evenly_spaced_images",
    lambda t: topk.evenly_spaced(t.images.select("image_path", "image_id"), ["image_path"], 40),
    """SELECT image_path, image_id FROM (SELECT *, row_number() OVER (ORDER BY image_path) - 1 AS r, count(*) OVER () AS n FROM images)
      WHERE r % greatest(1, n // 40) = 0 AND r < greatest(1, n // 40) * 40""",
)
register(
    "seeded_sample",
    lambda t: topk.seeded_sample(t.images.select("image_id", "image_path"), "image_id", 100, hashing="md5"),
    "SELECT image_id, image_path FROM images ORDER BY md5('42' || image_id), image_id LIMIT 100",
)
register("seeded_sample_fast_hash", lambda t: topk.seeded_sample(t.images.select("image_id", "image_path"), "image_id", 100))
