"""Queries whose result is what a sink writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import geometry as G
from skyledger.plans.points import spatial_grid
from skyledger.plans.fusion import SCORED_SQL, scored
from skyledger.plans.points import GRID_SQL
from skyledger.sinks import text as X
from skyledger.sources import adapters as A

c = F.col
QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def colored(s, d):
    g = A.gaussians(s, d)
    return g.select("id", "x", "y", "z", *[F.lit(0.5).alias(n) for n in "rgb"])


@query("b1_ply", "WITH g AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings) SELECT id AS line_no, format('{:.4f} {:.4f} {:.4f} 127 127 127', x, y, z) AS line FROM g UNION ALL SELECT i - 10, l FROM (SELECT unnest(range(10)) AS i, unnest(['ply', 'format ascii 1.0', 'element vertex ' || (SELECT count(*) FROM g), 'property float x', 'property float y', 'property float z', 'property uchar red', 'property uchar green', 'property uchar blue', 'end_header']) AS l)")
def _(s, d):
    return X.ply_lines(colored(s, d))


@query("b2_obj", "WITH g AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings) SELECT 'v' AS kind, id AS no, format('v {:.4f} {:.4f} {:.4f} 0.5000 0.5000 0.5000', x, y, z) AS line FROM g UNION ALL SELECT 'f', l_orderkey * 8 + l_linenumber, 'f ' || (l_orderkey % 500 + 1) || ' ' || (l_partkey % 500 + 1) || ' ' || (l_suppkey % 500 + 1) FROM lineitem")
def _(s, d):
    return X.obj_lines(colored(s, d), A.faces(s, d))


@query("b3_markdown_table", f"WITH {GRID_SQL} SELECT '| ' || cell_x || ' | ' || cell_y || ' | ' || n_points || ' |' AS line FROM grid")
def _(s, d):
    return X.markdown_rows(spatial_grid(scored(s, d)), ["cell_x", "cell_y", "n_points"])


@query("b4_b12_summary_json", f"WITH {SCORED_SQL} SELECT json_object('n_points', count(*), 'n_kept', count(*) FILTER (WHERE conf >= 0.12), 'n_high', count(*) FILTER (WHERE band = 'High'))::VARCHAR AS summary FROM points")
def _(s, d):
    p = scored(s, d).agg(F.count(F.lit(1)).alias("n_points"), F.count(F.when(c("keep"), 1)).alias("n_kept"), F.count(F.when(c("band") == "High", 1)).alias("n_high"))
    return p.select(F.to_json(F.struct("*")).alias("summary"))


@query("b6_geojson")
def _(s, d):
    """Each occupied grid cell as a closed rectangle around an origin, with its share of low confidence."""
    g = spatial_grid(scored(s, d))
    half = 5.0
    la0, lo0 = G.from_enu(c("center_x") - half, c("center_y") - half, F.lit(17.5), F.lit(78.2))
    la1, lo1 = G.from_enu(c("center_x") + half, c("center_y") + half, F.lit(17.5), F.lit(78.2))
    props = F.struct(F.when(c("low_fraction") > 0.2, "weak").otherwise("ok").alias("status"), "n_points")
    return g.select("cell_x", "cell_y", X.geojson_box(lo0, la0, lo1, la1, props).alias("feature"))
