"""Streaming twins: windows over event time with a watermark, and the position filter as keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import ensure_checkpoint_dir

c = F.col


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table of files as a stream; its timestamps get a zone, which watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory():
        df = reader.parquet(path)
    else:
        df = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return df.withColumn("ts", c("ts").cast("timestamp"))


def run_to_end(df: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is there, through the stream, into parquet in the shared folder."""
    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def windowed(stream: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", F.round("total", 6).alias("total"))


def sessions(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_seconds("w.start").alias("start_s"), "n")


def filtered_positions(stream: DataFrame) -> DataFrame:
    """The position filter per key over a stream of (user_id, t, x): its state is six numbers and six variances."""
    from skyledger.operators.windows import KalmanState

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        k, last = None, None
        if state.exists:
            flat, last = state.get
            k = KalmanState((0.0, 0.0, 0.0), 0.15, 2.5, 5.0, 9.0)
            k.x, k.P = list(flat[:6]), list(flat[6:])
        pdf = pd.concat(list(pdfs)).sort_values("t")
        out = []
        for t, x in zip(pdf.t, pdf.x, strict=True):
            z = (x, 0.0, 0.0)
            dt = 0.1 if k is None else t - last
            k = k or KalmanState(z, 0.15, 2.5, 5.0, 9.0)
            used, std = k.step(dt, z)
            out.append((key[0], t, k.x[0], std, used))
            last = t
        state.update(([*k.x, *k.P], last))
        yield pd.DataFrame(out, columns=["user_id", "t", "x", "position_std_m", "used"])

    g = stream.select("user_id", F.unix_micros("ts").cast("double").alias("us"), "value").select("user_id", (c("us") / 1e6).alias("t"), c("value").alias("x"))
    return g.groupBy("user_id").applyInPandasWithState(step, "user_id long, t double, x double, position_std_m double, used boolean", "flat array<double>, last double", "append", "NoTimeout")
