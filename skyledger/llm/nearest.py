"""Pairing records with the nearest record in time of the same entity.

Method: both sides are hash-partitioned by (entity, time block) into Arrow groups; inside each,
DuckDB performs a backward and a forward ASOF join, and the nearer candidate within the
tolerance is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.blocks import block_of, with_halo

_MATCH = """
WITH l AS (SELECT DISTINCT k, blk, no, t, tol FROM rows WHERE side = 'left' AND t IS NOT NULL),
r AS (SELECT k, blk, side, t, min(no) AS no FROM rows WHERE side <> 'left' GROUP BY ALL),
s AS (SELECT DISTINCT side FROM r),
q AS (SELECT l.*, s.side FROM l, s),
b AS (SELECT q.k, q.no, q.side, q.tol, q.t - r.t AS d, r.no AS hit FROM q ASOF JOIN r ON q.k = r.k AND q.blk = r.blk AND q.side = r.side AND q.t >= r.t),
f AS (SELECT q.k, q.no, q.side, q.tol, r.t - q.t AS d, r.no AS hit FROM q ASOF JOIN r ON q.k = r.k AND q.blk = r.blk AND q.side = r.side AND q.t <= r.t),
c AS (SELECT * FROM b UNION ALL SELECT * FROM f)
SELECT k, no, side, arg_min(hit, struct_pack(d := d, hit := hit)) AS hit FROM c WHERE d <= tol GROUP BY k, no, side
"""


@dataclass(frozen=True)
class NearestParams:
    block_s: float = 300.0
    rows_per_group: int = 200_000
    salts: int = 8


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One Arrow group: all rows of its (entity, block) pairs."""
    import duckdb

    got = list(batches)
    if not got or not sum(b.num_rows for b in got):
        return
    rows = pa.Table.from_batches(got)
    # a group is bounded in rows, so nothing need be spilled; an empty folder name keeps DuckDB from using the worker's disk
    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.register("rows", rows)
    out = con.sql(_MATCH).to_arrow_table()
    con.close()
    schema = pa.schema([("k", pa.string()), ("no", pa.int64()), ("side", pa.string()), ("hit", pa.int64())])
    yield from out.cast(schema).combine_chunks().to_batches()


def nearest_in_time(left: DataFrame, rights: dict[str, DataFrame], max_tol: float, params: NearestParams = NearestParams()) -> DataFrame:
    """(k, no, side, hit) of each row of `left` and each of `rights` that has a row near enough.

    `left` has (k, no, t, tol), each of `rights` (k, no, t); `max_tol` bounds every tol. Rows with
    a null k, no, t or NaN t (and left rows with a null tol) match nothing. Repeated rows count
    once. Of rows equally near the one with the lower number is taken; of rows of one side at one
    time as well. Empty tables give no rows.
    """
    p = params

    def clean(df: DataFrame, side: str, tol) -> DataFrame:
        x = df.select(F.col("k").cast("string").alias("k"), F.col("no").cast("bigint").alias("no"), F.col("t").cast("double").alias("t"), tol.cast("double").alias("tol"), F.lit(side).alias("side"))
        return x.where("k is not null and no is not null and t is not null and not isnan(t)")

    lefts = clean(left, "left", F.col("tol")).where("tol is not null")
    lefts = lefts.withColumn("blk", block_of(F.col("t"), p.block_s))
    both, n = lefts, 0
    for side, df in rights.items():
        r = with_halo(clean(df, side, F.lit(None)), F.col("t"), p.block_s, max_tol, max_tol).drop("blk_home")
        both = both.unionByName(r)
        n += df.count()  # from the file footers
    n = int((n + left.count()) * (1 + 2 * max_tol / p.block_s))  # with the rows listed under two blocks
    spark = left.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n // p.rows_per_group)
    return both.repartition(groups, "k", "blk").mapInArrow(_match, "k string, no bigint, side string, hit bigint")


def matched_frames(frames: DataFrame, telemetry: DataFrame, fused_pose: DataFrame, log_formats: DataFrame, params: NearestParams = NearestParams()) -> DataFrame:
    """(flight_id, idx, matched_table, matched_no): each frame with its nearest sample and pose.

    A flight's tolerance is that of its format, found in its telemetry; frames of a flight without
    a known format match nothing.
    """
    p = params
    tol = log_formats.groupBy("format_detected").agg(F.min("match_tol_s").alias("tol"))  # fixed: a row per format
    flights = telemetry.select("flight_id", "format_detected").where("flight_id is not null and format_detected is not null")
    flights = flights.groupBy("flight_id", "format_detected").count().join(F.broadcast(tol), "format_detected").groupBy("flight_id").agg(F.min("tol").alias("tol"))
    # a flight may hold a third of the frames: its one row meets them under several salts
    salted = flights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    f = frames.select("flight_id", "idx", "t").withColumn("salt", F.pmod(F.xxhash64("idx"), F.lit(p.salts)).cast("int"))
    left = f.join(salted, ["flight_id", "salt"]).select(F.col("flight_id").alias("k"), F.col("idx").alias("no"), "t", "tol")
    rights = {
        "telemetry": telemetry.select(F.col("flight_id").alias("k"), F.col("seq").alias("no"), F.col("t_sec").alias("t")),
        "fused_pose": fused_pose.select(F.col("flight_id").alias("k"), F.col("pose_no").alias("no"), "t"),
    }
    hits = nearest_in_time(left, rights, max_tolerance(log_formats), p)
    return hits.select(F.col("k").alias("flight_id"), F.col("no").alias("idx"), F.col("side").alias("matched_table"), F.col("hit").alias("matched_no"))


def max_tolerance(log_formats: DataFrame) -> float:
    """The largest tolerance of the fixed table of formats: one number."""
    return float(log_formats.agg(F.max("match_tol_s")).first()[0] or 0.0)
