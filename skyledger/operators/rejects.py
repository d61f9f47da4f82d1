"""Separating rows that don't parse, with the reason, from those that load.

Method: each line's cells are exploded into (row, column, value), a rule table says what a
column must hold, the broken rules of a line are aggregated to its first one, and an anti-join
leaves the lines that load. Only cells that a rule names leave the scan's stage, and only
broken ones are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One field: blanks, a quoted value with doubled quotes inside, blanks; or a value without quotes.
FIELD = r'[ \t]*+"[^"]*+(?:""[^"]*+)*+"[ \t]*+|[^",]*+'
LINE = rf"^(?:{FIELD})(?:,(?:{FIELD}))*+$"

#: The columns of the two header formats that a rule names.
#: (format, column, rule, rank of the fault)
RULES = [
    ("A", "CUSTOM.updateTime", "time_a", 3),
    ("A", "OSD.latitude", "lat", 4),
    ("A", "CUSTOM.isVideo", "video_a", 5),
    ("B", "datetime(utc)", "time_b", 3),
    ("B", "latitude", "lat", 4),
    ("B", "isVideo", "video_b", 5),
]
BROADCAST_FILES = 10_000  # headers, a few hundred bytes each
FAULTS = {1: "quoting", 2: "column_count", 3: "t_sec", 4: "lat", 5: "is_video", 9: "no_header"}


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "fmt string, column string, rule string, rank int")


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\\x00", ""), "\\r$", "")


def _cells(text: Column) -> Column:
    """The fields of a well-quoted line, unquoted and trimmed. A comma goes in front, so that no match is empty."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(f",({FIELD})"), F.lit(1))

    def value(c: Column) -> Column:
        c = F.trim(c, F.lit(" \t"))
        return F.trim(F.when(c.startswith('"'), F.regexp_replace(F.substr(c, F.lit(2), F.length(c) - 2), '""', '"')).otherwise(c), F.lit(" \t"))

    return F.transform(raw, value)


def _holds(rule: Column, v: Column) -> Column:
    time_a = v.rlike(r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$") & F.try_to_timestamp(F.substring(v, 1, 19), F.lit("yyyy/MM/dd HH:mm:ss")).isNotNull()
    time_b = v.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$") & F.try_to_timestamp(v, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    number = v.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$")
    lat = number & F.coalesce(F.when(number, v.try_cast("double")).between(-90.0, 90.0), F.lit(False))
    return (
        F.when(rule == "time_a", time_a)
        .when(rule == "time_b", time_b)
        .when(rule == "lat", lat)
        .when(rule == "video_a", v.isin("", "0", "1", "True", "False", "true", "false"))
        .when(rule == "video_b", v.isin("0", "1"))
    )


def _lines(raw: DataFrame, salts: int) -> DataFrame:
    """Every line after the header with its cleaned text, its file's columns and format, its own cells.

    The headers are one small row per file. Up to `BROADCAST_FILES` of them (counted first, over the
    header lines alone) go to every executor and no line moves. Beyond that a file may hold a third of
    all lines: headers are repeated `salts` times and the lines meet them by (file, salt).
    """
    rows = raw.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("line_no").cast("int").alias("line_no"), _clean(F.col("line_text")).alias("text"))
    rows = rows.where(F.col("file_id").isNotNull() & F.col("line_no").isNotNull())
    head = rows.where("line_no = 1").groupBy("file_id").agg(F.min("text").alias("head"))
    head = head.withColumn("names", _cells(F.regexp_replace("head", "^\\ufeff", "")))
    fmt = F.when(F.array_contains("names", "CUSTOM.updateTime"), "A").when(F.array_contains("names", "datetime(utc)"), "B")
    head = head.select("file_id", "names", fmt.alias("fmt"))
    body = rows.where("line_no > 1")
    if raw.where("line_no = 1").select("file_id").distinct().limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        x = body.join(F.broadcast(head), "file_id", "left")
    else:
        salted = head.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        x = body.withColumn("salt", F.pmod(F.xxhash64("line_no"), F.lit(salts)).cast("int")).join(salted, ["file_id", "salt"], "left").drop("salt")
    quoted = F.col("text").rlike(LINE)
    return x.withColumns({"quoted": quoted, "cells": F.when(quoted, _cells(F.col("text")))})


def rejected_lines(raw: DataFrame, salts: int = 16) -> DataFrame:
    """(file_id, line_no, fault), one row per line after the header that doesn't parse.

    A null line is an empty one. Repeated lines count once; of different texts under one number
    each is judged and the first fault in order of FAULTS counts. A file whose line 1 is missing
    or of no known format gives `no_header` for each of its lines. Rows with a null file_id or
    line_no can't be named and are left out. An empty table gives no rows.
    """
    x = _lines(raw, salts)
    rules = F.broadcast(rule_table(raw.sparkSession))  # six rows
    whole = (
        F.when(F.col("fmt").isNull(), 9).when(~F.col("quoted"), 1).when(F.size("cells") != F.size("names"), 2)
    )
    x = x.withColumn("whole", whole)
    line_faults = x.where(F.col("whole").isNotNull()).select("file_id", "line_no", F.col("whole").alias("rank"))
    cells = x.where(F.col("whole").isNull()).select("file_id", "line_no", "fmt", F.inline(F.arrays_zip(F.col("names").alias("column"), F.col("cells").alias("value"))))
    cell_faults = cells.join(rules, ["fmt", "column"]).where(~F.coalesce(_holds(F.col("rule"), F.col("value")), F.lit(False))).select("file_id", "line_no", "rank")
    first = line_faults.unionByName(cell_faults).groupBy("file_id", "line_no").agg(F.min("rank").alias("rank"))
    names = F.create_map(*[F.lit(x) for kv in FAULTS.items() for x in kv])
    return first.select("file_id", "line_no", names[F.col("rank")].alias("fault"))


def loaded_lines(raw: DataFrame, salts: int = 16) -> DataFrame:
    """The lines that parse, as typed samples: an anti-join with the rejected ones.

    Times keep their fraction of a second, to microseconds. A value no rule of `RULES` names (the
    longitude, height and angles) that is no number is null in its row; the line loads. Of a name
    that stands twice in a header the first column counts. Cells are picked by position, with no
    lookup that can fail, so a filter may be evaluated on any line. Repeated lines count once. An
    empty table gives no rows.
    """
    good = _lines(raw, salts).join(rejected_lines(raw, salts).select("file_id", "line_no"), ["file_id", "line_no"], "left_anti")

    def of(*names: str) -> Column:
        return F.coalesce(*[F.get("cells", F.array_position("names", F.lit(n)) - 1) for n in names])

    time = F.coalesce(F.replace(of("CUSTOM.updateTime"), F.lit("/"), F.lit("-")), of("datetime(utc)"))
    time = F.substring(time, 1, 26).try_cast("timestamp")
    video = of("CUSTOM.isVideo", "isVideo")
    return good.select(
        "file_id",
        "line_no",
        F.col("fmt").alias("format"),
        time.alias("sampled_at"),
        of("OSD.latitude", "latitude").try_cast("double").alias("lat"),
        of("OSD.longitude", "longitude").try_cast("double").alias("lon"),
        of("OSD.height [m]", "height_above_takeoff(meters)").try_cast("double").alias("height_m"),
        F.when(F.col("fmt") == "A", ~video.isin("", "0", "False", "false")).otherwise(video == "1").alias("is_video"),
        of("GIMBAL.yaw", "gimbal_heading(degrees)").try_cast("double").alias("yaw_deg"),
        of("GIMBAL.pitch", "gimbal_pitch(degrees)").try_cast("double").alias("pitch_deg"),
        of("GIMBAL.roll", "gimbal_roll(degrees)").try_cast("double").alias("roll_deg"),
    ).distinct()
