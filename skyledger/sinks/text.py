"""Text sinks. Each function gives a DataFrame of lines (or documents) in order; `write_lines` stores it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def ply_lines(points: DataFrame, key: str = "id") -> DataFrame:
    """(line_no, line) of an ASCII point cloud x, y, z, r, g, b; colours in 0-1 are scaled to 0-255."""
    top = points.agg(F.greatest(F.max("r"), F.max("g"), F.max("b")).alias("top"), F.count(F.lit(1)).alias("n"))  # one row
    scale = F.when(c("top") <= 1.0, 255.0).otherwise(1.0)
    byte = lambda n: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c(n) * scale))).cast("int")
    body = points.crossJoin(F.broadcast(top)).select(c(key).alias("line_no"), F.format_string("%.4f %.4f %.4f %d %d %d", "x", "y", "z", byte("r"), byte("g"), byte("b")).alias("line"))
    head = ["ply", "format ascii 1.0", None, *[f"property float {a}" for a in "xyz"], *[f"property uchar {a}" for a in ("red", "green", "blue")], "end_header"]
    lines = F.array(*[F.concat(F.lit("element vertex "), c("n").cast("string")) if t is None else F.lit(t) for t in head])
    header = top.select(F.posexplode(lines).alias("i", "line")).select((c("i") - len(head)).cast("bigint").alias("line_no"), "line")
    return header.unionByName(body.select(c("line_no").cast("bigint").alias("line_no"), "line"))


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(kind, no, line): vertices with colour, then faces by vertex number from 1."""
    v = vertices.select(F.lit("v").alias("kind"), c("id").alias("no"), F.format_string("v %.4f %.4f %.4f %.4f %.4f %.4f", "x", "y", "z", "r", "g", "b").alias("line"))
    f = faces.select(F.lit("f").alias("kind"), c("fid").alias("no"), F.format_string("f %d %d %d", c("a") + 1, c("b") + 1, c("c") + 1).alias("line"))
    return v.unionByName(f)


def markdown_rows(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """(line) of a table row per row, floats rounded."""
    kinds = dict(df.dtypes)
    cell = lambda n: F.coalesce((F.format_string(f"%.{digits}f", c(n)) if kinds[n] in ("double", "float") else c(n).cast("string")), F.lit(""))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(n) for n in columns]), F.lit(" |")).alias("line"))


def geojson_point(lon: Column, lat: Column, props: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), props.alias("properties")))


def geojson_box(lon0: Column, lat0: Column, lon1: Column, lat1: Column, props: Column) -> Column:
    """A rectangle as a closed ring of five positions."""
    ring = F.array(F.array(lon0, lat0), F.array(lon1, lat0), F.array(lon1, lat1), F.array(lon0, lat1), F.array(lon0, lat0))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), props.alias("properties")))


def write_lines(df: DataFrame, path: str, order: str) -> None:
    """Lines in order, in files that concatenate to the whole by name: a range partitioning, not one task."""
    df.repartitionByRange(order).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_checkpoint(df: DataFrame, path: str) -> None:
    """All parameters and accumulators of a state, as parquet; older files may lack columns (read with mergeSchema)."""
    df.write.mode("overwrite").parquet(path)


def read_checkpoint(spark, path: str, defaults: dict[str, float]) -> DataFrame:
    """A state with the columns an older file lacks filled in."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for k, v in defaults.items():
        df = df.withColumn(k, F.coalesce(c(k), F.lit(v)) if k in df.columns else F.lit(v))
    return df


def require(df: DataFrame, columns: list[str], least_rows: int = 0) -> DataFrame:
    """The table itself, or an error that names what it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if least_rows and df.limit(least_rows).count() < least_rows:
        raise ValueError(f"fewer than {least_rows} rows")
    return df
