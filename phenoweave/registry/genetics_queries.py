"""Leaf totals, variance partition and the association-study tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from phenoweave.functions import parse
from phenoweave.operators import catalog, strips, variance
from phenoweave.operators.strips import PHENOTYPES
from phenoweave.plans import genetics
from phenoweave.registry.core import register, rounded


def field_strips(t):
    return catalog.with_field_map(
        t.strips.withColumn("plot", parse.plot_of(F.col("image_name"))).withColumn(
            "device", parse.device_of(F.col("image_name"))
        ),
        t.field_map,
    )


_FIELD = """field_strips AS (
  SELECT s.*, CAST(g.device AS VARCHAR) AS device, g.plot, g.genotype, g."row", g."range"
  FROM strips s JOIN image_genotypes g USING (image_id))"""
_SUMS = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in (*PHENOTYPES, "sam_score"))
_ROUND = lambda prefix="": ", ".join(
    f"CAST({prefix}{c} AS BIGINT) AS {c}" if c == "area_px" else f"round({prefix}{c}, 6) AS {c}"
    for c in (*PHENOTYPES, "sam_score")
)
_LEAF = f"""{_FIELD}, leaf AS (SELECT image_name, device, genotype, "row", "range", {_SUMS} FROM field_strips GROUP BY ALL)"""

register(
    "leaf_totals",
    lambda t: rounded(strips.leaf_totals(field_strips(t))),
    f"""WITH {_LEAF} SELECT image_name, device, genotype, "row", "range", {_ROUND()} FROM leaf""",
)
register(
    "strip_corpus_summary",
    lambda t: rounded(strips.corpus_summary(t.strips)),
    """SELECT count(*) AS strips, round(avg(mean_height_px), 6) AS mean_height, round(stddev_pop(mean_height_px), 6) AS std_height,
      round(quantile_cont(mean_height_px, 0.5), 6) AS median_height FROM strips""",
)
register(
    "measurements_with_boxes",
    lambda t: rounded(
        strips.attach_boxes(
            t.strips.select("image_id", "strip_id", "mean_height_px"),
            t.strips.filter("image_id % 4 <> 0").select("image_id", "strip_id", "box_coords", "sam_score"),
        )
    ),
    """SELECT image_id, strip_id, round(mean_height_px, 6) AS mean_height_px,
      CASE WHEN image_id % 4 <> 0 THEN box_coords END AS box_coords,
      CASE WHEN image_id % 4 <> 0 THEN round(sam_score, 6) END AS sam_score FROM strips""",
)


# --- variance partition ----------------------------------------------------


def _forms_sql(source: str, phenotypes, factors, score="sam_score") -> str:
    """CTEs ending in ``forms(phenotype, i, j, value)`` for MINQUE(0)."""
    level = lambda f: f"CAST(round({f}, 2) AS VARCHAR)" if f == score else f'CAST("{f}" AS VARCHAR)'
    columns = ", ".join(f"{level(f)} AS f{i + 1}" for i, f in enumerate(factors))
    base = " UNION ALL ".join(
        f"SELECT '{p}' AS phenotype, CAST({p} AS DOUBLE) AS y, {columns} FROM {source} WHERE {p} IS NOT NULL" for p in phenotypes
    )
    levels = " UNION ALL ".join(
        f"SELECT phenotype, {i} AS i, f{i} AS level, count(*)::DOUBLE AS n_a, sum(y) AS s_a FROM base GROUP BY 1, 2, 3"
        for i in range(1, len(factors) + 1)
    )
    pairs = " UNION ALL ".join(
        f"SELECT phenotype, {i} AS i, f{i} AS a, {j} AS j, f{j} AS b, count(*)::DOUBLE AS n_ab FROM base GROUP BY ALL"
        for i, j in combinations(range(1, len(factors) + 1), 2)
    )
    return f"""base AS ({base}),
  whole AS (SELECT phenotype, count(*)::DOUBLE AS n, avg(y) AS mean, var_pop(y) AS v FROM base GROUP BY 1),
  levels AS ({levels}),
  factor_sums AS (SELECT phenotype, i, sum((s_a - n_a * mean) ** 2) AS q, sum(n_a ** 2) AS n2, sum(n_a ** 3) AS n3, max(n) AS n,
    count(*)::DOUBLE AS levels FROM levels JOIN whole USING (phenotype) GROUP BY 1, 2),
  pairs AS ({pairs}),
  pair_sums AS (SELECT p.phenotype, p.i, p.j, sum(n_ab ** 2) AS ab2, sum(n_ab * x.n_a * z.n_a) AS ab3 FROM pairs p
    JOIN levels x ON x.phenotype = p.phenotype AND x.i = p.i AND x.level = p.a
    JOIN levels z ON z.phenotype = p.phenotype AND z.i = p.j AND z.level = p.b GROUP BY 1, 2, 3),
  crossed AS (SELECT s.phenotype, s.i, s.j, s.ab2 - 2 * s.ab3 / u.n + u.n2 * w.n2 / (u.n * u.n) AS value FROM pair_sums s
    JOIN factor_sums u ON u.phenotype = s.phenotype AND u.i = s.i JOIN factor_sums w ON w.phenotype = s.phenotype AND w.i = s.j),
  forms AS (
    SELECT phenotype, 0 AS i, -1 AS j, n * v AS value FROM whole UNION ALL SELECT phenotype, 0, 0, n - 1 FROM whole
    UNION ALL SELECT phenotype, i, -1, q FROM factor_sums UNION ALL SELECT phenotype, i, -2, levels FROM factor_sums
    UNION ALL SELECT phenotype, i, i, n2 - 2 * n3 / n + n2 * n2 / (n * n) FROM factor_sums
    UNION ALL SELECT phenotype, i, 0, n - n2 / n FROM factor_sums UNION ALL SELECT phenotype, 0, i, n - n2 / n FROM factor_sums
    UNION ALL SELECT phenotype, i, j, value FROM crossed UNION ALL SELECT phenotype, j, i, value FROM crossed)"""


def _solve_sql(factors) -> str:
    """Gauss-Jordan steps over ``forms`` ending in ``solved(phenotype, i, variance)``."""
    size = len(factors) + 1
    steps = [f"g0 AS (SELECT phenotype, i, CASE WHEN j = -1 THEN {size} ELSE j END AS j, value FROM forms WHERE j >= -1)"]
    for p in range(size):
        steps.append(
            f"""g{p + 1} AS (SELECT m.phenotype, m.i, m.j, CASE WHEN m.i = {p} THEN r.value / d.value
      ELSE m.value - c.value * r.value / d.value END AS value FROM g{p} m
    JOIN g{p} r ON r.phenotype = m.phenotype AND r.i = {p} AND r.j = m.j
    JOIN g{p} c ON c.phenotype = m.phenotype AND c.i = m.i AND c.j = {p}
    JOIN g{p} d ON d.phenotype = m.phenotype AND d.i = {p} AND d.j = {p})"""
        )
    steps.append(f"solved AS (SELECT phenotype, i, greatest(value, 0) AS variance FROM g{size} WHERE j = {size})")
    return ",\n  ".join(steps)


STRIP_FACTORS = ("genotype", "row", "range", "device", "strip_id", "sam_score")
LEAF_FACTORS = ("genotype", "row", "range", "device", "sam_score")

register(
    "strip_variance_forms",
    lambda t: variance.quadratic_forms(field_strips(t), ["mean_height_px", "area_px"], STRIP_FACTORS)
    .groupBy("phenotype", "i", "j")
    .agg(F.format_string("%.7e", F.sum("value")).alias("value")),
    f"""WITH {_FIELD}, {_forms_sql("field_strips", ["mean_height_px", "area_px"], STRIP_FACTORS)}
      SELECT phenotype, i, j, printf('%.7e', value) AS value FROM forms""",
)


def _partition(name, source, cte, phenotypes, factors, keep=""):
    names = ", ".join(f"({i + 1}, '{f}')" for i, f in enumerate(factors))
    register(
        name,
        lambda t: rounded(
            (variance.without_residual if keep else lambda d: d)(
                variance.variance_partition(source(t), phenotypes, factors)
            ).select("phenotype", "component", "percent"),
            4,
        ),
        f"""WITH {cte}, {_forms_sql(cte.split(" AS ")[0] if "leaf AS" not in cte else "leaf", phenotypes, factors)},
  {_solve_sql(factors)}
      SELECT phenotype, name AS component, round(percent, 4) AS percent FROM (
        SELECT *, 100 * variance / sum(variance) OVER (PARTITION BY phenotype) AS percent FROM solved) s
      JOIN (VALUES (0, 'Residual'), {names}) v(i, name) USING (i) {keep}""",
    )


_partition(
    "strip_variance_partition", field_strips, _FIELD, list(PHENOTYPES), STRIP_FACTORS, "WHERE name <> 'Residual'"
)
_partition(
    "leaf_variance_partition", lambda t: strips.leaf_totals(field_strips(t)), _LEAF, list(PHENOTYPES), LEAF_FACTORS
)

register(
    "labelled_variance_partition",
    lambda t: rounded(genetics.labelled_partition(
        variance.variance_partition(strips.leaf_totals(field_strips(t)), list(PHENOTYPES), LEAF_FACTORS)
    ), 4),
    f"""WITH {_LEAF}, {_forms_sql("leaf", list(PHENOTYPES), LEAF_FACTORS)},
  {_solve_sql(LEAF_FACTORS)}
      SELECT f.label AS factor, f.o AS factor_order, p.label AS phenotype_label, p.o AS phenotype_order, round(percent, 4) AS percent
      FROM (SELECT *, 100 * variance / sum(variance) OVER (PARTITION BY phenotype) AS percent FROM solved) s
      JOIN (VALUES (5, 'Segmentation Score', 1), (4, 'Device', 2), (2, 'Row', 3), (3, 'Range', 4), (1, 'Genotype', 5)) f(i, label, o) USING (i)
      JOIN (VALUES ('max_height_px', 'Maximum ' || chr(10) || 'Width', 1), ('median_height_px', 'Median ' || chr(10) || 'Width', 2),
        ('mean_height_px', 'Mean ' || chr(10) || 'Width', 3), ('area_px', 'Area', 4), ('height_range_px', 'Width ' || chr(10) || 'Range', 5),
        ('min_height_px', 'Minimum ' || chr(10) || 'Width', 6)) p(phenotype, label, o) USING (phenotype)""",
)

# --- association tables ------------------------------------------------------
# The panel: part names stand in for sequenced lines, market segments for ids.


def _panel(t):
    """Sequenced lines named after genotypes, the prefix written without its space."""
    return (
        t.field_map.filter("row % 3 <> 0")
        .select(F.concat(F.lit("PI"), "genotype").alias("vcf_name"))
        .distinct()
    )


def _pi_leaves(t):
    return strips.leaf_totals(field_strips(t)).withColumn("genotype", F.concat(F.lit("PI "), "genotype"))


_PANEL = f"""{_LEAF}, panel AS (SELECT DISTINCT genotype FROM field_map WHERE "row" % 3 <> 0)"""

register(
    "association_table",
    lambda t: rounded(
        genetics.association_table(_pi_leaves(t), _panel(t))
    ),
    f"""WITH {_PANEL} SELECT 'PI' || genotype AS genotype, {", ".join(
        f"CAST({c} AS BIGINT) AS {c}" if c == "area_px" else f"round({c}, 6) AS {c}" for c in PHENOTYPES)}
      FROM leaf JOIN panel USING (genotype)""",
)
register(
    "association_genotypes",
    lambda t: genetics.association_genotypes(genetics.association_table(_pi_leaves(t), _panel(t))),
    f"WITH {_PANEL} SELECT DISTINCT 'PI' || genotype AS genotype FROM leaf JOIN panel USING (genotype)",
)
register(
    "genotype_name_mapping",
    lambda t: t.read("part").select(
        F.concat("p_brand", F.lit("PIPI"), F.col("p_partkey")).alias("vcf_name")
    ).select("vcf_name", parse.phenotype_genotype(F.col("vcf_name"), {"Brand#1PIPI0": "PI 0"}).alias("pheno_name")),
    """SELECT p_brand || 'PIPI' || p_partkey AS vcf_name, CASE WHEN p_brand || 'PIPI' || p_partkey = 'Brand#1PIPI0' THEN 'PI 0'
      ELSE p_brand || 'PI PI' || p_partkey END AS pheno_name FROM part""",
)
