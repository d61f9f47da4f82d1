"""All core queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.plans import camera, clouds, control, data_quality, extras, fusion, images, points, sinks, streams, telemetry

MODULES = [fusion, points, clouds, images, camera, control, sinks, streams, extras, telemetry, data_quality]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.QUERIES["fa1_fa2_voxel_confidence"](spark, sf_dir)
