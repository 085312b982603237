"""Embedding statistics, clustering, and cluster composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoweave.functions import numeric
from phenoweave.operators import embeddings, topk
from phenoweave.registry.core import register, rounded

# Distance at which the given vectors form both clusters and noise.
_EPS, _MIN_SAMPLES = 1.16, 5

register(
    "embedding_global_stats",
    lambda t: rounded(embeddings.global_stats(t.embeddings)),
    """WITH e AS (SELECT unnest(embedding)::DOUBLE AS x FROM vectors) SELECT (SELECT count(*) FROM vectors) AS num_samples,
      (SELECT max(len(embedding)) FROM vectors)::INTEGER AS embedding_dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
      round(min(x), 6) AS min, round(max(x), 6) AS max FROM e""",
)
register(
    "embedding_row_stats",
    lambda t: rounded(
        t.embeddings.select(
            "image_id",
            numeric.vector_mean(F.col("embedding")).alias("mean"),
            numeric.vector_std(F.col("embedding")).alias("std"),
            numeric.vector_norm(F.col("embedding")).alias("norm"),
        )
    ),
    """SELECT image_id, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(sqrt(sum(x * x)), 6) AS norm
      FROM (SELECT image_id, unnest(embedding)::DOUBLE AS x FROM vectors) GROUP BY 1""",
)
register(
    "mean_cosine_to_next",
    lambda t: rounded(
        t.embeddings.join(
            t.embeddings.select((F.col("image_id") - 1).alias("image_id"), F.col("embedding").alias("other")), "image_id"
        ).agg(F.avg(numeric.cosine(F.col("embedding"), F.col("other"))).alias("cosine"), F.count(F.lit(1)).alias("pairs"))
    ),
    """SELECT round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine, count(*) AS pairs
      FROM vectors a JOIN vectors b ON b.image_id = a.image_id + 1""",
)
register(
    "wide_embeddings",
    lambda t: rounded(
        t.embeddings.select("image_id", *numeric.array_to_wide("embedding", 64)).select(
            "image_id", "emb_0", "emb_31", "emb_63",
            F.size(numeric.wide_to_array([f"emb_{i}" for i in range(64)])).alias("dim"),
        )
    ),
    """SELECT image_id, round(embedding[1]::DOUBLE, 6) AS emb_0, round(embedding[32]::DOUBLE, 6) AS emb_31, round(embedding[64]::DOUBLE, 6) AS emb_63,
      CAST(len(embedding) AS INTEGER) AS dim FROM vectors""",
)
register(
    "embedding_summary",
    lambda t: t.embeddings.agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.max(F.size("embedding")).alias("embedding_dim"),
        F.count_distinct("genotype").alias("num_genotypes"),
        F.count_distinct("device").alias("num_devices"),
    ),
    """SELECT count(*) AS num_samples, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim, count(DISTINCT genotype) AS num_genotypes,
      count(DISTINCT device) AS num_devices FROM vectors""",
)
register(
    "embedding_genotype_counts",
    lambda t: topk.most_common(t.embeddings, "genotype", 20),
    "SELECT genotype, count(*) AS images FROM vectors GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
register(
    "embeddings_with_metadata",
    lambda t: t.embeddings.select("image_id", F.size("embedding").alias("dim")).join(
        t.image_genotypes.select("image_id", "plot", "genotype", "device"), "image_id"
    ),
    """SELECT v.image_id, CAST(len(v.embedding) AS INTEGER) AS dim, g.plot, g.genotype, g.device FROM vectors v
      JOIN image_genotypes g USING (image_id)""",
)

# --- composition of given clusters ------------------------------------------------

register(
    "cluster_sizes",
    lambda t: embeddings.cluster_sizes(t.clusters),
    """SELECT cluster, count(*) AS images, (SELECT count(DISTINCT cluster) FROM clusters WHERE cluster <> -1) AS n_clusters
      FROM clusters GROUP BY 1""",
)
register(
    "cluster_composition",
    lambda t: rounded(embeddings.cluster_composition(t.clusters)),
    """SELECT cluster, count(*) AS images, count(DISTINCT genotype) AS genotypes,
      round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM clusters), 6) AS percent FROM clusters WHERE cluster <> -1 GROUP BY 1""",
)
register(
    "noise_summary",
    lambda t: rounded(embeddings.noise_summary(t.clusters)),
    """SELECT count(*) AS images, count(*) FILTER (WHERE cluster = -1) AS noise,
      round(count(*) FILTER (WHERE cluster = -1) * 100.0::DOUBLE / count(*), 6) AS noise_percent FROM clusters""",
)
register(
    "top_genotypes_per_cluster",
    lambda t: rounded(embeddings.top_genotypes_per_cluster(t.clusters)),
    """SELECT cluster, CAST(rank AS INTEGER) AS rank, genotype, n AS images, round(n * 100.0::DOUBLE / size, 6) AS percent FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, genotype) AS rank, CAST(sum(n) OVER (PARTITION BY cluster) AS BIGINT) AS size
      FROM (SELECT cluster, genotype, count(*) AS n FROM clusters WHERE cluster <> -1 GROUP BY 1, 2)) WHERE rank <= 5""",
)
register(
    "cluster_diversity",
    lambda t: embeddings.cluster_diversity(t.clusters),
    "SELECT cluster, count(DISTINCT genotype) AS genotypes FROM clusters WHERE cluster <> -1 GROUP BY 1",
)
register(
    "cluster_contingency",
    lambda t: embeddings.contingency(t.clusters, range(5)),
    f"""SELECT genotype, {", ".join(f"count(*) FILTER (WHERE cluster = {c}) AS c{c}" for c in range(5))} FROM clusters
      WHERE genotype IN (SELECT genotype FROM clusters GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15) GROUP BY 1""",
)

# --- clustering ---------------------------------------------------------------------

register(
    "dbscan_clusters",
    lambda t: embeddings.cluster(t.embeddings, "dbscan", "image_id", eps=_EPS, min_samples=_MIN_SAMPLES),
    f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
      near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON list_distance(a.e, b.e) <= {_EPS}),
      core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= {_MIN_SAMPLES}),
      edge AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
      reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
      root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY 1),
      numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM root),
      border AS (SELECT n.a AS id, min(c.cluster) AS cluster FROM near n JOIN numbered c ON c.id = n.b WHERE n.a NOT IN (FROM core) GROUP BY 1)
      SELECT v.id AS image_id, 'dbscan' AS method, CAST(coalesce(c.cluster, b.cluster, -1) AS INTEGER) AS cluster
      FROM v LEFT JOIN numbered c USING (id) LEFT JOIN border b USING (id)""",
)
register("kmeans_clusters", lambda t: embeddings.cluster(t.embeddings, "kmeans", "image_id"))
register("gaussian_mixture_clusters", lambda t: embeddings.cluster(t.embeddings, "gmm", "image_id"))
register("hierarchical_clusters", lambda t: embeddings.cluster(t.embeddings, "hierarchical", "image_id"))
register(
    "principal_components",
    lambda t: embeddings.principal_components(t.embeddings, "image_id")[0].select(
        "image_id", F.col("components")[0].alias("pc1"), F.col("components")[1].alias("pc2")
    ),
)
register("explained_variance", lambda t: embeddings.principal_components(t.embeddings, "image_id")[1])
