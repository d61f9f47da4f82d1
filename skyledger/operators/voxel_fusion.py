"""Observations fused into voxels: the central aggregation.

Rows are first reduced to (voxel, frame), so the number of distinct frames becomes a plain
count and everything moved is already summed; a hot voxel costs one row per frame and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import confidence as C

MEANS = ["x", "y", "z", "consistency", "frame_quality", "pose_confidence"]


def voxel_key(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("bigint")


def fuse(observations: DataFrame, size: float, min_consistency: float = 0.0, means: list[str] | None = None) -> DataFrame:
    """One row per occupied voxel: means, distinct frames, view-angle range, rows.

    Observations below `min_consistency` or with a null coordinate take no part.
    """
    means = means or MEANS
    o = observations.where((F.col("consistency") >= min_consistency) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    o = o.withColumns({f"v{a}": voxel_key(F.col(a), size) for a in "xyz"})
    per_frame = o.groupBy("vx", "vy", "vz", "frame_idx").agg(
        F.count(F.lit(1)).alias("n"), F.min("view_angle").alias("a_min"), F.max("view_angle").alias("a_max"), *[F.sum(m).alias(f"s_{m}") for m in means]
    )
    n = F.sum("n")
    return per_frame.groupBy("vx", "vy", "vz").agg(
        *[(F.sum(f"s_{m}") / n).alias(m) for m in means],
        F.count("frame_idx").alias("observation_count"),
        F.min("a_min").alias("angle_min"),
        F.max("a_max").alias("angle_max"),
        (F.max("a_max") - F.min("a_min")).alias("view_angle_spread"),
        n.alias("n_raw_observations"),
    )


def score(points: DataFrame) -> DataFrame:
    """Fused points with their confidence, band and gate."""
    conf = C.confidence(F.col("observation_count"), F.col("view_angle_spread"), F.col("consistency"), F.col("frame_quality"), F.col("pose_confidence"))
    x = points.withColumn("confidence", conf)
    c = F.col("confidence")
    return x.withColumns(
        {
            "band": C.band(c),
            "single_view_capped": F.col("observation_count") <= 1,
            "keep": C.keep(c),
            "densify": C.densify(c),
            "flag_uncertain": C.keep(c) & (C.band(c) != C.HIGH),
        }
    )
