"""The capture tables (observation ledger, clouds, images, ...) as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.tables import table

c = F.col


def observations(spark: SparkSession, d: str) -> DataFrame:
    """The pixel observation ledger, from lineitem."""
    return table(spark, d, "lineitem").select(
        (c("l_extendedprice") / 1000.0).alias("x"),
        c("l_quantity").alias("y"),
        (c("l_tax") * 100.0).alias("z"),
        c("l_suppkey").alias("frame_idx"),
        c("l_discount").alias("view_angle"),
        (c("l_tax") / F.lit(0.08)).alias("consistency"),
        (F.lit(0.5) + c("l_linenumber").cast("double") / 14.0).alias("frame_quality"),
        (F.pmod(c("l_orderkey"), F.lit(100)).cast("double") / 100.0).alias("pose_confidence"),
    )


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Log samples, each once (rows received twice differ only in the time of receipt)."""
    return (
        table(spark, d, "telemetry")
        .groupBy("flight_id", "seq")
        .agg(*[F.min(x).alias(x) for x in ("t_sec", "lat", "lon", "height_m", "yaw_deg", "pitch_deg", "roll_deg", "focal_len_mm")], F.max("is_video").alias("is_video"), F.min("format_detected").alias("format_detected"))
    )


def poses(spark: SparkSession, d: str) -> DataFrame:
    """Fused poses, each once."""
    names = ["t", "pos_x", "pos_y", "pos_z", "vel_x", "vel_y", "vel_z", "yaw", "pitch", "roll", "position_std_m"]
    return table(spark, d, "fused_pose").groupBy("flight_id", "pose_no").agg(*[F.min(x).alias(x) for x in names], F.max("gps_used").alias("gps_used"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames with their quality scores, each once."""
    names = ["t", "blur", "exposure", "compression", "coverage", "overall", "blur_px", "jpeg_quality"]
    return table(spark, d, "frames").groupBy("flight_id", "idx").agg(*[F.min(x).alias(x) for x in names])


def _e(i: int):
    return c("embedding")[i].cast("double")


def gaussians(spark: SparkSession, d: str) -> DataFrame:
    """Points with normals, scales and rotations, from the embeddings; odd labels are the reference cloud."""
    g = table(spark, d, "embeddings").select(
        c("vec_id").alias("id"),
        (F.pmod(c("label"), F.lit(2)) == 1).alias("is_reference"),
        *[(_e(i) * 10.0).alias(n) for i, n in enumerate("xyz")],
        *[_e(3 + i).alias(f"n{n}") for i, n in enumerate("xyz")],
        *[F.exp(_e(6 + i)).alias(f"s{i}") for i in range(3)],
        *[_e(9 + i).alias(f"q{n}") for i, n in enumerate("wxyz")],
        *[_e(13 + i).alias(n) for i, n in enumerate(("dc", "opacity_logit", "m1", "m2"))],
    )
    return g


def patches(spark: SparkSession, d: str) -> DataFrame:
    """8x8 grey images as long pixels, from the embeddings."""
    return table(spark, d, "embeddings").select(c("vec_id").alias("frame_idx"), F.posexplode("embedding").alias("i", "e")).select(
        "frame_idx",
        F.floor(c("i") / 8).cast("int").alias("row"),
        F.pmod(c("i"), F.lit(8)).cast("int").alias("col"),
        F.least(F.lit(255.0), F.greatest(F.lit(0.0), (c("e").cast("double") + 1.0) * 127.5)).alias("gray"),
    )


def descriptors(spark: SparkSession, d: str) -> DataFrame:
    """64 sign bits of each embedding as one integer per keypoint; 200 keypoints in order make a frame."""
    bit = lambda i: F.when(c("embedding")[i] > 0, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    word = bit(0)
    for i in range(1, 64):
        word = word.bitwiseOR(bit(i))
    return table(spark, d, "embeddings").select(c("vec_id").alias("kp"), F.floor(c("vec_id") / 200).cast("bigint").alias("frame"), word.alias("bits"), _e(0).alias("px"), _e(1).alias("py"))


def buildings(spark: SparkSession, d: str) -> DataFrame:
    """Axis-aligned footprints with a height, from the suppliers."""
    k = c("s_suppkey").cast("double")
    return table(spark, d, "supplier").select(
        c("s_suppkey").alias("id"),
        (F.pmod(c("s_suppkey"), F.lit(10)).cast("double") * 10.0 + 2.0).alias("cx"),
        (F.floor(k / 10.0).cast("double") * 5.0 + 2.0).alias("cy"),
        F.lit(3.0).alias("hw"),
        (F.pmod(c("s_suppkey"), F.lit(7)).cast("double") + 1.0).alias("height"),
    )


def faces(spark: SparkSession, d: str, n: int | None = None) -> DataFrame:
    """Triangles over `n` vertices (as many as the table of vertices has), from lineitem."""
    m = F.lit(table(spark, d, "embeddings").count() if n is None else n)
    return table(spark, d, "lineitem").select(
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("fid"), F.pmod("l_orderkey", m).alias("a"), F.pmod("l_partkey", m).alias("b"), F.pmod("l_suppkey", m).alias("c")
    )


def visibility(spark: SparkSession, d: str) -> DataFrame:
    """Which frame sees which triangle at which angle, from lineitem."""
    return table(spark, d, "lineitem").select(c("l_suppkey").alias("frame_idx"), c("l_partkey").alias("triangle_id"), c("l_discount").alias("view_angle"))


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """A history of metrics per run, from the events of a user in order of time."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        c("user_id").alias("run"),
        (F.row_number().over(order) * 500).cast("bigint").alias("iter"),
        (c("value") / 500.0).alias("ssim"),
        (c("value") / 10.0).alias("psnr"),
        F.when(F.pmod("event_id", F.lit(3)) != 0, c("value") / 1000.0).alias("lpips"),
        (c("event_id") + 1000).alias("n_gaussians"),
    )
