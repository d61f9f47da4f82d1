"""Subtitle telemetry: blocks of text separated by blank lines, one sample each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(df: DataFrame, text: str) -> DataFrame:
    """One row per block of each text, numbered from 0. Carriage returns do no harm."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(F.regexp_replace(text, "\\r", ""), r"\n\s*\n")).alias("block_no", "block"))


def number(block: Column, pattern: str) -> Column:
    return F.regexp_extract(block, pattern, 1).try_cast("double")


def clock_seconds(block: Column) -> Column:
    part = lambda i: F.regexp_extract(block, r"(\d{2}):(\d{2}):(\d{2}),(\d{3}) -->", i).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000.0


def frame_count_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, frame_cnt, lat, lon, rel_alt, focal_len_mm) of texts with frame counts; blocks without all of them are skipped."""
    b = blocks(docs.where(F.col("text").contains("FrameCnt:")), "text")
    x = b.select(
        "doc_id",
        F.regexp_extract("block", r"FrameCnt:\s*(\d+)", 1).try_cast("bigint").alias("frame_cnt"),
        number(F.col("block"), r"\[latitude:\s*(-?[0-9.]+)\]").alias("lat"),
        number(F.col("block"), r"\[longitude:\s*(-?[0-9.]+)\]").alias("lon"),
        number(F.col("block"), r"rel_alt:\s*(-?[0-9.]+)").alias("rel_alt"),
        number(F.col("block"), r"\[focal_len:\s*([0-9.]+)\]").alias("focal_len_mm"),
    )
    return x.dropna()


def as_srt_text(samples: DataFrame) -> DataFrame:
    """A subtitle block per sample (sink and test input of the reader below)."""
    t = F.col("t_sec")
    stamp = F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3600).cast("int"), F.floor(F.pmod(t, F.lit(3600.0)) / 60).cast("int"), F.floor(F.pmod(t, F.lit(60.0))).cast("int"), F.floor(F.pmod(F.round(t * 1000), F.lit(1000.0))).cast("int"))
    line = F.format_string("%.7f, %.7f, %.2fm, %.1f°", "lat", "lon", "height_m", F.coalesce("yaw_deg", F.lit(0.0)))
    ok = samples.where("t_sec is not null and lat is not null and lon is not null and height_m is not null and not isnan(height_m)")
    return ok.select("flight_id", "seq", F.concat(F.col("seq").cast("string"), F.lit("\n"), stamp, F.lit(" --> "), stamp, F.lit("\n"), line).alias("block"))


def sample_blocks(blocks_: DataFrame, pitch_deg: float = -45.0, altitude_is_relative: bool = False) -> DataFrame:
    """Samples of subtitle blocks: time, position, altitude above the first block's, heading; a supplied pitch.

    Blocks without time or position are skipped.
    """
    from pyspark.sql import Window as W

    pos = r"(-?[0-9.]+), (-?[0-9.]+), (-?[0-9.]+)m, (-?[0-9.]+)°"
    num = lambda i: F.regexp_extract("block", pos, i).try_cast("double")
    x = blocks_.select("flight_id", "seq", clock_seconds(F.col("block")).alias("t_sec"), num(1).alias("lat"), num(2).alias("lon"), num(3).alias("alt"), num(4).alias("yaw_deg")).dropna()
    base = F.lit(0.0) if altitude_is_relative else F.first("alt").over(W.partitionBy("flight_id").orderBy("seq"))
    return x.select("flight_id", "seq", "t_sec", "lat", "lon", (F.col("alt") - base).alias("height_m"), "yaw_deg", F.lit(pitch_deg).alias("pitch_deg"), F.lit(0.0).alias("roll_deg"), F.lit(True).alias("is_video"))
