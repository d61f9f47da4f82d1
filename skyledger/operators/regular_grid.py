"""Irregular readings of a source onto a regular time grid.

Method: the readings of a cell are reduced to its first and last reading before anything is
moved; `lead` pairs consecutive occupied cells, only the grid cells between two of them are
exploded, and each is interpolated, held or marked inline by the length of its gap. A run is
extended explicitly from its first to its last cell.

Cells are worked on in blocks of time with a halo of one landing gap, so a source of any
length is spread over its blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.operators.blocks import with_halo


@dataclass(frozen=True)
class GridParams:
    new_run_s: float = 900.0  # a longer pause between two samples begins a new run
    block_s: float = 7200.0
    fill_steps: float = 10.0  # gaps of up to so many steps are filled, longer ones are marked


def regular_grid(df: DataFrame, key: str, time: str, step: Column, fields: list[str], params: GridParams = GridParams()) -> DataFrame:
    """(key, cell_no, field_name, value, status), one row per cell of every run and field.

    Cell k is [k*step, (k+1)*step). status: `observed` (the cell's first reading), `interpolated`
    (linearly, at the cell's start, between the readings around a gap of at most `fill_steps`
    steps), `held` (nearest reading, where a field begins late or ends early in its run, within
    the same length) or `gap` (null value). Rows with a null key, null or NaN time, or a null or
    non-positive step are left out; null and NaN are no readings. Repeated rows change nothing;
    of readings at one time the least counts. An empty table gives no rows; other columns are
    not read.
    """
    p = params
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(time).cast("double").alias("t"), step.cast("double").alias("g"), *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(fields)])
    rows = rows.where(F.col("k").isNotNull() & F.col("t").isNotNull() & ~F.isnan("t") & (F.col("g") > 0)).withColumn("c", F.floor(F.col("t") / F.col("g")).cast("bigint"))
    aggs = [F.min("t").alias("t_min"), F.max("t").alias("t_max")]
    for i in range(len(fields)):
        v = F.col(f"v{i}")
        ok = v.isNotNull() & ~F.isnan(v)
        t_ok = F.when(ok, F.col("t"))
        aggs += [F.min(t_ok).alias(f"ft{i}"), F.max(t_ok).alias(f"lt{i}"), F.min_by(v, t_ok).alias(f"fv{i}"), F.max_by(v, t_ok).alias(f"lv{i}")]
    cells = rows.groupBy("k", "g", "c").agg(*aggs)  # reduced before the exchange, by map-side combining
    halo = p.new_run_s + 60.0
    x = with_halo(cells, F.col("t_min"), p.block_s, halo, halo)
    w = W.partitionBy("k", "g", "blk").orderBy("c")
    back = W.partitionBy("k", "g", "blk").orderBy(F.col("c").desc())
    x = x.withColumns({"nc": F.lead("c").over(w), "nt": F.lead("t_min").over(w)})
    x = x.withColumn("nc", F.when(F.col("nt") - F.col("t_max") <= p.new_run_s, F.col("nc")))
    prior, after = w.rowsBetween(W.unboundedPreceding, 0), back.rowsBetween(W.unboundedPreceding, -1)
    cols: dict[str, Column] = {}
    for i in range(len(fields)):
        cols |= {f"pt{i}": F.last(f"lt{i}", ignorenulls=True).over(prior), f"pv{i}": F.last(f"lv{i}", ignorenulls=True).over(prior)}
    x = x.withColumns(cols)
    cols = {}
    for i in range(len(fields)):
        cols |= {f"nt{i}": F.last(f"ft{i}", ignorenulls=True).over(after), f"nv{i}": F.last(f"fv{i}", ignorenulls=True).over(after)}
    x = x.withColumns(cols).where(F.col("blk_home"))
    # only the grid cells between two occupied ones are made
    upto = F.coalesce(F.col("nc") - 1, F.col("c"))
    x = x.withColumn("cell_no", F.explode(F.sequence(F.col("c"), upto)))
    at = F.col("cell_no") * F.col("g")
    reach = F.col("g") * p.fill_steps
    out = []
    for i, f in enumerate(fields):
        pt, pv, nt, nv = (F.col(f"{n}{i}") for n in ("pt", "pv", "nt", "nv"))
        seen = (F.col("cell_no") == F.col("c")) & F.col(f"ft{i}").isNotNull()
        near_p = F.coalesce((at - pt <= reach) & (at - pt <= p.new_run_s), F.lit(False))
        near_n = F.coalesce((nt - at <= reach) & (nt - at <= p.new_run_s), F.lit(False))
        both = F.coalesce(nt - pt <= reach, F.lit(False))
        alone = F.coalesce(nt - pt > p.new_run_s, F.lit(True))  # the other side lies in another run, or nowhere
        status = F.when(seen, "observed").when(both, "interpolated").when(alone & (near_p | near_n), "held").otherwise("gap")
        value = (
            F.when(seen, F.col(f"fv{i}"))
            .when(both, F.when(nt > pt, pv + (nv - pv) * (F.greatest(at, pt) - pt) / (nt - pt)).otherwise(pv))
            .when(alone & near_p, pv)
            .when(alone & near_n, nv)
        )
        out.append(F.struct(F.lit(f).alias("field_name"), value.alias("value"), status.alias("status")))
    return x.select(F.col("k").alias(key), "cell_no", F.inline(F.array(*out)))


def telemetry_grid(telemetry: DataFrame, log_formats: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """The samples of each flight on the grid of its format; `log_formats` is fixed (a row per format)."""
    steps = log_formats.select("format_detected", "grid_s").dropDuplicates(["format_detected"])
    samples = telemetry.select("flight_id", "t_sec", "lat", "lon", "height_m", "format_detected").join(F.broadcast(steps), "format_detected")
    return regular_grid(samples, "flight_id", "t_sec", F.col("grid_s"), ["lat", "lon", "height_m"], params)


def unobserved_cells(telemetry: DataFrame, log_formats: DataFrame) -> DataFrame:
    """(flight_id, cell_no, field_name) of the grid's cells without a reading."""
    return telemetry_grid(telemetry, log_formats).where(F.col("status") != "observed").select("flight_id", "cell_no", "field_name")
