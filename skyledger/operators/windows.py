"""Time-series operators of a source: smoothing, gradients, interpolation, segments, state."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import atan2, ceil, floor, hypot, sqrt
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.operators.blocks import meet_salted, previous_row
from skyledger.session import ensure_checkpoint_dir


def moving_average(value: str, key: str, order: str, width: int = 5) -> Column:
    """Centred mean whose ends repeat the first and last value; a source shorter than the window stays as it is."""
    w = W.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    total = F.col(value)
    for k in range(1, width // 2 + 1):
        total = total + F.coalesce(F.lag(value, k).over(w), first) + F.coalesce(F.lead(value, k).over(w), last)
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    return F.when(n < width, F.col(value)).otherwise(total / float(width))


def with_neighbours(df: DataFrame, key: str, order: str, carry: list[str], size: float = 8192.0) -> DataFrame:
    """`df` with prev_<c> and next_<c> of each of `carry`, along `order` within `key`; a source of any length is many tasks (see `previous_row`)."""
    bucket = F.floor(F.col(order) / F.lit(size))
    x = previous_row(df, key, [order], bucket, carry, "prev_").withColumn("_down", -F.col(order))
    return previous_row(x, key, ["_down"], -bucket, carry, "next_").drop("_down")


def running_sum(df: DataFrame, key: str, order: str, value: Column, out: str, size: float = 8192.0) -> DataFrame:
    """`df` with the sum of `value` up to each row along `order` within `key`: sums inside blocks, and the blocks before each, a row per block, as offset."""
    x = df.withColumns({"_v": value, "_blk": F.floor(F.col(order) / F.lit(size))})
    blocks = x.groupBy(F.col(key).alias("_k"), F.col("_blk").alias("_b")).agg(F.sum("_v").alias("_sum"))
    upto = F.sum("_sum").over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("_k", "_b", F.coalesce(upto, F.lit(0.0)).alias("_before"))
    inside = F.sum("_v").over(W.partitionBy(key, "_blk").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("_in", inside).join(blocks, (F.col(key) == F.col("_k")) & (F.col("_blk") == F.col("_b")))
    return x.withColumn(out, F.col("_before") + F.coalesce("_in", F.lit(0.0))).drop("_v", "_blk", "_in", "_k", "_b", "_before")


def gradient(value: str, time: str) -> Column:
    """Derivative over uneven steps, of a table `with_neighbours`: second order inside, one-sided at the ends; null where two rows share a time."""
    v, t, vp, vn, tp, tn = (F.col(n) for n in (value, time, f"prev_{value}", f"next_{value}", f"prev_{time}", f"next_{time}"))
    hs, hd = t - tp, tn - t
    inner = F.try_divide(hs * hs * vn + (hd * hd - hs * hs) * v - hd * hd * vp, hs * hd * (hd + hs))
    return F.when(tp.isNull() & tn.isNull(), None).when(tp.isNull(), F.try_divide(vn - v, hd)).when(tn.isNull(), F.try_divide(v - vp, hs)).otherwise(inner)


def bearing(x: str, y: str) -> Column:
    """Course over ground in degrees from north, of a table `with_neighbours`; the last row repeats the one before."""
    at = F.col
    ahead = F.degrees(F.atan2(at(f"next_{x}") - at(x), at(f"next_{y}") - at(y)))
    behind = F.degrees(F.atan2(at(x) - at(f"prev_{x}"), at(y) - at(f"prev_{y}")))
    return F.when(at(f"next_{x}").isNull(), behind).otherwise(ahead)


def unwrap(df: DataFrame, angle: str, key: str, order: str, out: str) -> DataFrame:
    """Radians without jumps of a turn: the sum of the wraps so far is taken off."""
    x = previous_row(df, key, [order], F.floor(F.col(order) / F.lit(8192.0)), [angle], "_p_")
    turns = F.coalesce(F.round((F.col(angle) - F.col(f"_p_{angle}")) / float(2 * np.pi)), F.lit(0.0))
    return running_sum(x, key, order, turns, "_turns").withColumn(out, F.col(angle) - F.col("_turns") * float(2 * np.pi)).drop("_turns", f"_p_{angle}")


def true_segments(df: DataFrame, key: str, time: str, order: str, flag: str) -> DataFrame:
    """(key, segment_no, start_t, end_t, n): contiguous true stretches; one ends at the first false time after it, else at the last time."""
    w = W.partitionBy(key).orderBy(order)
    f = F.coalesce(F.col(flag), F.lit(False))
    x = df.withColumns({"_f": f, "_new": (f & ~F.coalesce(F.lag(f).over(w), F.lit(False))).cast("int"), "_next": F.lead(time).over(w)})
    x = x.withColumn("_seg", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("_f")
    return x.groupBy(key, F.col("_seg").cast("bigint").alias("segment_no")).agg(
        F.min(time).alias("start_t"), F.coalesce(F.max_by("_next", order), F.max(time)).alias("end_t"), F.count(F.lit(1)).alias("n")
    )


def interpolate_at(queries: DataFrame, samples: DataFrame, key: str, t_query: str, t_sample: str, values: list[str], angles: list[str] | None = None, block_s: float = 600.0) -> DataFrame:
    """Each query row with the samples' values interpolated at its time, held beyond the ends.

    Samples become intervals to their successor (found inside blocks of time, see `previous_row`); interval and query meet by (key, time
    block), an interval being listed under every block it touches, so no source is one task and no
    pair outside its block arises. Angles (degrees) are interpolated by sine and cosine.
    """
    angles = angles or []
    known = samples.where(F.col(t_sample).isNotNull())
    s = known.groupBy(key, t_sample).agg(*[F.min(v).alias(v) for v in [*values, *angles]]).withColumn("_down", -F.col(t_sample))
    nxt = [f"_n_{v}" for v in [*values, *angles]]
    s = previous_row(s, key, ["_down"], -F.floor(F.col(t_sample) / F.lit(block_s)), [t_sample, *values, *angles], "_n_")
    s = s.withColumnRenamed(f"_n_{t_sample}", "_t1").withColumnRenamed(t_sample, "_t0").drop("_down")
    blk = lambda c: F.floor(c / F.lit(block_s)).cast("bigint")
    ends = known.groupBy(key).agg(F.min(t_sample).alias("_lo"), F.max(t_sample).alias("_hi"))
    q = meet_salted(queries.where(F.col(t_query).isNotNull()), ends, [key], F.col(t_query)).withColumn("_t", F.least(F.greatest(F.col(t_query), F.col("_lo")), F.col("_hi"))).drop("_lo", "_hi")
    q = q.withColumn("_blk", blk(F.col("_t")))
    s = s.withColumn("_blk", F.explode(F.sequence(blk(F.col("_t0")), blk(F.coalesce("_t1", "_t0")))))
    meets = (F.col("_t") >= F.col("_t0")) & (F.col("_t") < F.coalesce(F.col("_t1"), F.lit(float("inf"))))
    j = q.join(s, [key, "_blk"]).where(meets)
    a = F.when(F.col("_t1").isNull(), 0.0).otherwise((F.col("_t") - F.col("_t0")) / (F.col("_t1") - F.col("_t0")))
    lerp = lambda u, v: u + (F.coalesce(v, u) - u) * a
    cols = {v: lerp(F.col(v), F.col(f"_n_{v}")) for v in values}
    for v in angles:
        r0, r1 = F.radians(F.col(v)), F.radians(F.coalesce(f"_n_{v}", v))
        cols[v] = F.degrees(F.atan2(lerp(F.sin(r0), F.sin(r1)), lerp(F.cos(r0), F.cos(r1))))
    return j.withColumns(cols).drop("_t", "_blk", "_t0", "_t1", *nxt)


def running_best(value: str, key: str, order: str) -> Column:
    return F.max(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def ema(df: DataFrame, keys: list[str], order: str, value: str, gamma: float = 0.85, out: str = "ema") -> DataFrame:
    """Last value per key of g*previous + (1-g)*new, the first value starting it; rows of equal order go by value.

    The fold is a weighted sum: the k-th value from the end has the weight (1-g)*g^(k-1), the first
    one of all g^(n-1). Weights below 1e-20 are beyond the digits of a double, so a key of any
    length needs its last few hundred values only (a group limit, pruned before the exchange).
    """
    reach = int(np.ceil(np.log(1e-20) / np.log(gamma)))
    x = df.where(F.col(value).isNotNull())
    w = W.partitionBy(*keys).orderBy(F.col(order).desc(), F.col(value).desc())
    last = x.select(*keys, F.col(value).alias("_v"), F.row_number().over(w).alias("_k")).where(F.col("_k") <= reach)
    last = last.groupBy(*keys).agg(F.sum(F.col("_v") * (1.0 - gamma) * F.pow(F.lit(gamma), F.col("_k") - 1)).alias("_s"), F.max_by("_v", "_k").alias("_first"))
    n = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = F.col("_s") + F.when(F.col("n") <= reach, F.col("_first") * F.pow(F.lit(gamma), F.col("n"))).otherwise(0.0)
    return last.join(n, keys).select(*keys, total.alias(out), "n")


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): the average rank of each distinct value among all rows.

    Values are counted, put into ranges and written; the ranges' totals, a row per task, give each
    range its offset, and the running count goes through one range at a time.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = df.groupBy(value).count().repartitionByRange(F.col(value)).withColumn("_part", F.spark_partition_id()).checkpoint()
    parts = n.groupBy("_part").agg(F.sum("count").alias("_total"))
    parts = parts.select("_part", (F.sum("_total").over(W.orderBy("_part")) - F.col("_total")).alias("_before"))  # a row per task
    run = F.sum("count").over(W.partitionBy("_part").orderBy(value))
    return n.join(F.broadcast(parts), "_part").select(value, (F.col("_before") + run - (F.col("count") - 1) / 2.0).alias(out))


def percentiles(df: DataFrame, value: str, at: dict[str, float], sums: dict[str, Column]) -> DataFrame:
    """One row: the `sums` over all rows and the exact percentiles `at` (name: share) as Spark's `percentile` interpolates them.

    A first pass counts the values by sign and 256th of a power of two, which follow in the order of
    the values and are at most a million counts however many rows there are. Only values of the few
    counts that hold a wanted rank are taken in the second pass; they are counted, put into ranges and
    ranked as in `average_ranks`, so no task meets all values even if they are nearly equal. Nulls
    count for the sums only, NaN is the largest value; without values the percentiles are null.
    `df` is read twice; the counts that hold a rank come to the driver, two a percentile at most.
    """
    ensure_checkpoint_dir(df.sparkSession)
    v, whole, by_size = F.col(value), W.partitionBy(), W.orderBy("_c")  # a row per count
    size = F.floor((F.least(F.log2(F.abs(v)), F.lit(1025.0)) + 1075.0) * 256.0) + 1  # infinity and NaN share the last one
    df = df.withColumn("_c", F.when(v == 0, F.lit(0).cast("bigint")).when(v < 0, -size).when(v > 0, size))
    hist = df.groupBy("_c").agg(F.count(value).alias("_n"), *[F.sum(x).alias(k) for k, x in sums.items()])
    hist = hist.select("_c", "_n", F.row_number().over(by_size).alias("_k"), F.sum("_n").over(by_size).alias("_end"), F.sum("_n").over(whole).alias("_total"), *[F.sum(k).over(whole).alias(k) for k in sums])
    ranks = [f((F.col("_total") - 1) * F.lit(p)) for p in at.values() for f in (F.floor, F.ceil)]
    rows = hist.where(reduce(or_, [(k >= F.col("_end") - F.col("_n")) & (k < F.col("_end")) for k in ranks], F.col("_k") == 1)).collect()
    totals = [F.lit(rows[0][k] if rows else None).cast(hist.schema[k].dataType).alias(k) for k in sums]
    total = rows[0]["_total"] if rows else 0
    if not total:
        return df.sparkSession.range(1).select(*totals, *[F.lit(None).cast("double").alias(k) for k in at])
    pos = {k: (total - 1) * p for k, p in at.items()}
    ranks = {f(x) for x in pos.values() for f in (floor, ceil)}
    start = {x["_c"]: x["_end"] - x["_n"] for x in rows if any(x["_end"] - x["_n"] <= k < x["_end"] for k in ranks)}

    keys = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k).cast("bigint") for k in start])).alias("_c"))
    x = df.join(F.broadcast(keys), "_c", "left_semi")  # as a filter it would go into the plan of `df`, which repeats the value's expression
    n = x.groupBy("_c", value).count().repartitionByRange(v).withColumn("_part", F.spark_partition_id()).checkpoint()
    parts = n.groupBy("_c", "_part").agg(F.sum("count").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy("_c").orderBy("_part")) - F.col("_sum")  # a row per task
    parts = parts.select("_c", "_part", (before + F.coalesce(*[F.when(F.col("_c") == k, F.lit(low)) for k, low in start.items()])).alias("_before"))
    end = F.col("_before") + F.sum("count").over(W.partitionBy("_c", "_part").orderBy(value))
    n = n.join(F.broadcast(parts), ["_c", "_part"]).select(value, "count", end.alias("_end"))
    got = n.agg(*[F.max(F.when((F.col("_end") > k) & (F.col("_end") - F.col("count") <= k), v)).cast("double").alias(f"_{k}") for k in ranks])

    def between(x: float) -> Column:
        lo, hi = F.col(f"_{floor(x)}"), F.col(f"_{ceil(x)}")
        return F.when(lo == hi, lo).otherwise(F.lit(ceil(x) - x) * lo + F.lit(x - floor(x)) * hi)

    return got.select(*totals, *[between(x).alias(k) for k, x in pos.items()])


def stable_runs(df: DataFrame, key: str, order: str, value: str, drift: float = 0.1) -> DataFrame:
    """(key, order, value, run): greedy runs, named by the order of their first row; a value further than `drift` from the run's first starts the next.

    Where a run ends depends on where it began, so a source is read in order. Rows stream by in
    Arrow batches, sorted inside hash partitions; what is kept between batches is one run's start,
    and within a batch each run is one vectorised search for its end.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, base, name = None, 0.0, 0
        for pdf in batches:
            ks, os, vs = pdf[key].to_numpy(), pdf[order].to_numpy(), pdf[value].to_numpy(float)
            names = np.empty(len(pdf), dtype=np.int64)
            cuts = [*(np.flatnonzero(ks[1:] != ks[:-1]) + 1), len(pdf)]
            at = 0
            for stop in cuts:
                if ks[at] != source:
                    source, base, name = ks[at], vs[at], os[at]
                while at < stop:
                    leaves = np.abs(vs[at:stop] - base) > drift * base
                    end = at + int(leaves.argmax()) if leaves.any() else stop
                    names[at:end] = name
                    if end < stop:
                        base, name = vs[end], os[end]
                    at = end
            yield pdf.assign(run=names)

    t = dict(df.dtypes)
    rows = df.select(key, order, value).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInPandas(stream, f"{key} {t[key]}, {order} {t[order]}, {value} {t[value]}, run long")


class KalmanState:
    """Six-state position and velocity filter with gated position updates; the step is shared by batch and stream.

    The model moves each axis by itself and x and y have one noise, so the covariance is two blocks
    of position, cross and velocity variance (x and y, z) and a step is a few dozen operations.
    """

    __slots__ = ("x", "P", "q", "r_xy", "r_z", "gate", "yaw")

    def __init__(self, p0, q_accel: float, sigma_xy: float, sigma_z: float, gate: float):
        self.x = [float(p0[0]), float(p0[1]), float(p0[2]), 0.0, 0.0, 0.0]
        self.P = [25.0, 0.0, 25.0, 25.0, 0.0, 25.0]
        self.q = max(q_accel, 1e-3) ** 2
        self.r_xy, self.r_z, self.gate, self.yaw = sigma_xy**2, sigma_z**2, gate, 0.0

    def step(self, dt: float, z, accel=(0.0, 0.0, 0.0)) -> tuple[bool, float]:
        dt = max(dt, 1e-3)
        half = 0.5 * dt * dt
        x0, x1, x2, v0, v1, v2 = self.x
        a0, a1, a2 = accel
        x0, x1, x2 = x0 + dt * v0 + half * a0, x1 + dt * v1 + half * a1, x2 + dt * v2 + half * a2
        v0, v1, v2 = v0 + dt * a0, v1 + dt * a1, v2 + dt * a2
        pp, pv, vv, zp, zc, zv = self.P
        pp, pv, vv = pp + dt * (2 * pv + dt * vv) + self.q * half * half, pv + dt * vv + self.q * half * dt, vv + self.q * dt * dt
        zp, zc, zv = zp + dt * (2 * zc + dt * zv) + self.q * half * half, zc + dt * zv + self.q * half * dt, zv + self.q * dt * dt
        s, sz = pp + self.r_xy, zp + self.r_z
        d0, d1, d2 = z[0] - x0, z[1] - x1, z[2] - x2
        used = (d0 * d0 + d1 * d1) / s + d2 * d2 / sz <= self.gate
        if used:
            k, kv, kz, kzv = pp / s, pv / s, zp / sz, zc / sz
            x0, x1, x2 = x0 + k * d0, x1 + k * d1, x2 + kz * d2
            v0, v1, v2 = v0 + kv * d0, v1 + kv * d1, v2 + kzv * d2
            pp, pv, vv = pp - k * pp, pv - k * pv, vv - kv * pv
            zp, zc, zv = zp - kz * zp, zc - kz * zc, zv - kzv * zc
        self.x, self.P = [x0, x1, x2, v0, v1, v2], [pp, pv, vv, zp, zc, zv]
        if hypot(v0, v1) > 0.5:
            self.yaw = atan2(v1, v0)
        return used, sqrt(max(2 * pp + zp, 0.0) / 3.0)


def attitude(df: DataFrame, key: str, time: str, rate: str, nominal: float, out: str, alpha: float = 0.85) -> DataFrame:
    """`df` with an angle (radians) per row from turning rates (degrees per second), drawn to `nominal`: a' = alpha*(a + rate*dt) + (1-alpha)*nominal.

    The recursion forgets by alpha a step, so a row needs only the last rows whose weight a double
    can still hold; they are summed in a bounded frame. The first step lasts .1 s, none less than a
    millisecond; a null rate counts as 0. The series starts at `nominal`.
    """
    reach = int(np.ceil(np.log(1e-18) / np.log(alpha)))
    w = W.partitionBy(key).orderBy(time)
    dt = F.greatest(F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0.1)), F.lit(1e-3))
    x = df.withColumn("_turn", F.radians(F.coalesce(rate, F.lit(0.0))) * dt)
    turns = F.collect_list("_turn").over(w.rowsBetween(1 - reach, 0))
    drawn = F.aggregate(turns, F.lit(0.0), lambda acc, v: (acc + v) * alpha)
    return x.withColumn(out, F.lit(nominal) + drawn).drop("_turn")


def kalman(df: DataFrame, key: str, time: str, xyz: list[str], q_accel: float = 0.15, sigma_xy: float = 2.5, sigma_z: float = 5.0, gate: float = 9.0, accel: list[str] | None = None) -> DataFrame:
    """(key, time, fx, fy, fz, fvx, fvy, fvz, yaw, position_std_m, gps_used) per row of each source.

    The filter is a recursion over a whole source. Rows arrive sorted by (key, time) inside hash
    partitions and are filtered as they stream by, so a long source needs no memory; what it can't
    have is two tasks. `accel` names measured accelerations, the input of the prediction; a null one counts as 0.
    """
    names = [key, time, *xyz, *(accel or [])]
    rows = df.select(*names).dropna(subset=[key, time, *xyz]).repartition(key).sortWithinPartitions(key, time)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current, last, still = None, None, 0.0, (0.0, 0.0, 0.0)
        for pdf in batches:
            out = []
            for k, t, x, y, z, *a in zip(*[pdf[n].tolist() for n in names], strict=True):
                if k != current:
                    state, current, dt = KalmanState((x, y, z), q_accel, sigma_xy, sigma_z, gate), k, 0.1
                else:
                    dt = t - last
                last = t
                used, std = state.step(dt, (x, y, z), [0.0 if v is None or v != v else v for v in a] or still)
                out.append((k, t, *state.x, state.yaw, std, used))
            yield pd.DataFrame(out, columns=[key, time, "fx", "fy", "fz", "fvx", "fvy", "fvz", "yaw", "position_std_m", "gps_used"])

    kind = dict(df.dtypes)[key]
    return rows.mapInPandas(run, f"{key} {kind}, {time} double, fx double, fy double, fz double, fvx double, fvy double, fvz double, yaw double, position_std_m double, gps_used boolean")
