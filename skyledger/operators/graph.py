"""Connected components and edge statistics of meshes given as faces or edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.session import ensure_checkpoint_dir

c = F.col


def face_edges(faces: DataFrame) -> DataFrame:
    """(a, b, n): the undirected edges of faces (a, b, c), each with its number of faces."""
    e = F.array(F.struct("a", "b"), F.struct(c("b").alias("a"), c("c").alias("b")), F.struct(c("c").alias("a"), c("a").alias("b")))
    x = faces.select(F.explode(e).alias("e")).select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"))
    return x.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(v, component): the least vertex reachable from each vertex of `edges` (a, b), and of `vertices` (v).

    Alternating large-star and small-star steps: each vertex hands its larger neighbours, then its
    smaller ones, to the least vertex it knows. The number of edges never grows, and few rounds
    suffice for any shape. Each round is written to the shared folder, so lineage stays short and
    lost executors cost one round.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    loops = e.where("u = v").select(c("u").alias("v"))
    cur = e.where("u <> v").distinct().checkpoint()
    sign = None
    while True:  # until nothing changes: a label is never handed out before it is the least one
        both = cur.unionByName(cur.select(c("v").alias("u"), c("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(c("v").alias("u"), c("m").alias("v")).where("u <> v")
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(c("v").alias("u"), c("m").alias("v"))
        nxt = small.unionByName(down.select("u", c("m").alias("v"))).where("u <> v").distinct().checkpoint()
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cur = nxt
        if tuple(now) == sign:
            break
        sign = tuple(now)
    found = cur.groupBy(c("u").alias("v")).agg(F.min("v").alias("component"))
    every = e.select(c("u").alias("v")).unionByName(e.select("v")).unionByName(loops)
    if vertices is not None:
        every = every.unionByName(vertices.select("v"))
    return every.distinct().join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def small_components(labels: DataFrame, min_vertices: int = 0, keep_largest: int | None = None) -> DataFrame:
    """The labels of the components that stay: large enough, and among the largest."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    kept = sizes.where(c("size") >= min_vertices)
    if keep_largest:
        kept = kept.orderBy(c("size").desc(), "component").limit(keep_largest)
    return labels.join(kept.select("component"), "component", "left_semi")
