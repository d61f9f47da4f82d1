"""Neighbour and range joins over points, without comparing all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.session import ensure_checkpoint_dir

c = F.col


def _cell(axes: list[str], size: float) -> list[Column]:
    return [F.floor(c(a) / F.lit(size)).cast("bigint").alias(f"c{i}") for i, a in enumerate(axes)]


def start_size(points: DataFrame, axes: list[str], per_cell: float = 8.0, levels: int = 12) -> tuple[float, float]:
    """(cell, extent): the largest power-of-two part of the extent whose occupied cells hold few points.

    One pass with a distinct-count sketch per level; one row comes back.
    """
    ext = points.agg(*[F.max(a).alias(f"hi{i}") for i, a in enumerate(axes)], *[F.min(a).alias(f"lo{i}") for i, a in enumerate(axes)], F.count(F.lit(1)).alias("n")).first()
    if not ext["n"]:
        return 1.0, 1.0
    extent = max(max(ext[f"hi{i}"] - ext[f"lo{i}"] for i in range(len(axes))), 1e-6)
    sizes = [extent / 2**k for k in range(levels)]
    row = points.agg(*[F.approx_count_distinct(F.struct(*_cell(axes, s))).alias(f"d{k}") for k, s in enumerate(sizes)]).first()
    for k, s in enumerate(sizes):
        if ext["n"] / max(row[f"d{k}"], 1) <= per_cell:
            return s, extent
    return sizes[-1], extent


def k_nearest(left: DataFrame, right: DataFrame, k: int = 1, axes: tuple[str, ...] = ("x", "y", "z"), exclude_self: bool = False) -> DataFrame:
    """(id, hits): for each left row its k nearest right rows as an array of (d, id), exact, nearest first, ties by id.

    Points meet in grid cells: the left point's cell and its neighbours. A result counts once its
    k-th distance is within one cell; the others try again with cells twice as large, at the latest
    when a cell covers everything. Cells start small enough to hold few points, so dense places are
    settled by near candidates only. Rows with a null coordinate are left out; fewer than k rows give
    what there is; an empty right side gives no rows.
    """
    ax = list(axes)
    ensure_checkpoint_dir(left.sparkSession)
    ok = reduce(lambda a, b: a & b, [c(a).isNotNull() & ~F.isnan(a) for a in ax])
    rgt = right.where(ok).select("id", *[c(a).cast("double").alias(a) for a in ax])
    rest = left.where(ok).select("id", *[c(a).cast("double").alias(a) for a in ax])
    size, extent = start_size(rgt, ax)
    both = rest.unionByName(rgt).agg(*[(F.max(a) - F.min(a)).alias(a) for a in ax]).first()
    extent = max([extent, *[v for v in both if v is not None]])
    done = []
    while True:
        last = size >= extent
        near = rgt.select(c("id").alias("rid"), *[c(a).alias(f"r{a}") for a in ax], *_cell(ax, size))
        probe = rest.select("*", *_cell(ax, size))
        for i in range(len(ax)):
            probe = probe.withColumn(f"c{i}", F.explode(F.array(*[c(f"c{i}") + o for o in (-1, 0, 1)])))
        pairs = probe.join(near, [f"c{i}" for i in range(len(ax))])
        if exclude_self:
            pairs = pairs.where(c("id") != c("rid"))
        d = F.sqrt(reduce(lambda a, b: a + b, [(c(a) - c(f"r{a}")) * (c(a) - c(f"r{a}")) for a in ax]))
        hit = F.struct(d.alias("d"), c("rid").alias("id"))
        if k == 1:
            best = pairs.groupBy("id").agg(F.array(F.min(hit)).alias("hits"))
        else:
            # a group limit: no more than k candidates of a row are ever held
            first = F.row_number().over(W.partitionBy("id").orderBy("d", "rid"))
            near_k = pairs.select("id", d.alias("d"), "rid").withColumn("_k", first).where(c("_k") <= k)
            best = near_k.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", c("rid").alias("id")))).alias("hits"))
        best = best.checkpoint()
        if last:
            done.append(best)
            break
        settled = best.where((F.size("hits") == k) & (F.element_at("hits", -1)["d"] <= size))
        done.append(settled)
        rest = rest.join(settled.select("id"), "id", "left_anti").checkpoint()
        if rest.limit(1).count() == 0:
            break
        size *= 2
    return reduce(DataFrame.unionByName, done)


def nearest(left: DataFrame, right: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), exclude_self: bool = False) -> DataFrame:
    """(id, near_id, distance) of each left row's nearest right row."""
    h = c("hits")[0]
    return k_nearest(left, right, 1, axes, exclude_self).select("id", h["id"].alias("near_id"), h["d"].alias("distance"))


def in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Every (point, box) with the point inside the box's closed bounds x0..x1, y0..y1.

    A box is listed under each grid cell it touches and meets the cell's points by equality.
    """
    b = boxes
    for a, i in (("x", 0), ("y", 1)):
        b = b.withColumn(f"c{i}", F.explode(F.sequence(F.floor(c(f"{a}0") / size).cast("bigint"), F.floor(c(f"{a}1") / size).cast("bigint"))))
    p = points.select("*", *_cell(["x", "y"], size))
    return p.join(b, ["c0", "c1"]).where(c("x").between(c("x0"), c("x1")) & c("y").between(c("y0"), c("y1"))).drop("c0", "c1")
