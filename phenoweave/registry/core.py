"""Registration helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoweave.registry.oracle_tables import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable, sql: str | None = None) -> None:
    """Register ``build(tables)`` under ``name`` with optional oracle SQL.

    ``build`` gets a :class:`phenoweave.registry.tables.Tables`; the SQL may use
    the derived tables by name, their definitions are put in front.
    """
    from phenoweave.registry.tables import Tables

    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = with_tables(sql)


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Round double columns, so both engines' summation orders agree."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    chosen = doubles if only is None else set(only)
    return df.select(
        *[
            (F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) if c in chosen else F.col(c)
            for c in df.columns
        ]
    )
