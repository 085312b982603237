"""Connected components by randomised contraction.

Each round every vertex points at the neighbour (or itself) with the smallest
hash under the round's seed, and the edges are rewritten to those targets. A
constant share of the vertices disappears per round, whatever the graph's
diameter. Degrees only meet a hash aggregate with map-side combine, so a hub
costs one partial row per task; no vertex's neighbours are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from phenoweave.session import durable


def connected_components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, component) for every node that has an edge.

    ``edges`` has the key columns plus ``src`` and ``dst``; components never
    cross keys. ``component`` is the smallest node id of the component.
    """
    keys = list(keys)
    current = durable(
        edges.select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .filter("src <> dst")
        .distinct(),
        "components-edges",
    )
    maps: list[DataFrame] = []
    while not current.isEmpty():
        seed = F.lit(len(maps))
        both = current.unionByName(
            current.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
        )
        ranked = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("id"))
        targets = durable(
            both.groupBy(*keys, "src")
            .agg(F.min(ranked("dst")).alias("best"))
            .select(*keys, F.col("src").alias("node"), F.least("best", ranked("src"))["id"].alias("target")),
            "components-map",
        )
        maps.append(targets)
        lookup_src = targets.select(*keys, F.col("node").alias("src"), F.col("target").alias("new_src"))
        lookup_dst = targets.select(*keys, F.col("node").alias("dst"), F.col("target").alias("new_dst"))
        current = durable(
            current.join(lookup_src, [*keys, "src"])
            .join(lookup_dst, [*keys, "dst"])
            .filter("new_src <> new_dst")
            .select(
                *keys,
                F.least("new_src", "new_dst").alias("src"),
                F.greatest("new_src", "new_dst").alias("dst"),
            )
            .distinct(),
            "components-edges",
        )
    if not maps:
        return current.select(*keys, F.col("src").alias("node"), F.col("src").alias("component"))
    # Compose the round maps from the last (smallest) to the first.
    labels = maps[-1].select(*keys, "node", F.col("target").alias("root"))
    for earlier in reversed(maps[:-1]):
        later = labels.select(*keys, F.col("node").alias("target"), "root")
        labels = earlier.join(later, [*keys, "target"], "left").select(
            *keys, "node", F.coalesce("root", "target").alias("root")
        )
    labels = durable(labels, "components-roots")
    smallest = labels.groupBy(*keys, "root").agg(F.min("node").alias("component"))
    return labels.join(smallest, [*keys, "root"]).select(*keys, "node", "component")
