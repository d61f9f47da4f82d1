"""Queries over point sets, Gaussians, buildings, meshes and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from skyledger.functions import geometry as G
from skyledger.operators.graph import components, face_edges, small_components
from skyledger.operators.spatial import in_boxes, k_nearest, nearest
from skyledger.operators.windows import average_ranks, percentiles
from skyledger.plans.fusion import SCORED_SQL, scored
from skyledger.session import ensure_checkpoint_dir
from skyledger.sources import adapters as A
from skyledger.tables import table

c = F.col
r = lambda x, n=9: F.round(x, n)
SMALL_MESH = 200_000  # vertices that are sent to every task, 32 bytes each
QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


E = lambda i: f"embedding[{i + 1}]::DOUBLE"
GS = f"""g AS (SELECT vec_id AS id, label % 2 = 1 AS is_reference, {E(0)} * 10 AS x, {E(1)} * 10 AS y, {E(2)} * 10 AS z, {E(3)} AS nx, {E(4)} AS ny, {E(5)} AS nz,
  exp({E(6)}) AS s0, exp({E(7)}) AS s1, exp({E(8)}) AS s2, {E(9)} AS qw, {E(10)} AS qx, {E(11)} AS qy, {E(12)} AS qz, {E(13)} AS dc, {E(14)} AS opacity_logit FROM embeddings),
rec AS (SELECT * FROM g WHERE NOT is_reference), ref AS (SELECT * FROM g WHERE is_reference)"""
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
NN = f"""{GS}, nn AS (SELECT a.id, arg_min(b.id, ({DIST}, b.id)) AS near_id, min({DIST}) AS distance FROM rec a, ref b GROUP BY a.id),
back AS (SELECT a.id, min({DIST}) AS distance FROM ref a, rec b GROUP BY a.id)"""


def clouds(s, d):
    g = A.gaussians(s, d)
    return g.where(~c("is_reference")), g.where(c("is_reference"))


@query("e1_nearest_neighbour", f"WITH {NN} SELECT id, near_id, round(distance, 9) AS distance FROM nn")
def _(s, d):
    rec, ref = clouds(s, d)
    return nearest(rec, ref).withColumn("distance", r(c("distance")))


@query("fa8_geometry_metrics", f"WITH {NN} SELECT round(0.5 * (avg(nn.distance) + (SELECT avg(distance) FROM back)), 9) AS chamfer, round(sqrt(avg(nn.distance * nn.distance)), 9) AS rmse, round(sqrt(avg(pow((rec.x - ref.x) * ref.nx + (rec.y - ref.y) * ref.ny + (rec.z - ref.z) * ref.nz, 2))), 9) AS plane_rmse FROM nn JOIN rec ON nn.id = rec.id JOIN ref ON nn.near_id = ref.id")
def _(s, d):
    rec, ref = clouds(s, d)
    there = nearest(rec, ref)
    back = nearest(ref, rec).agg(F.avg("distance").alias("back"))
    n = ref.select(c("id").alias("near_id"), *[c(a).alias(f"r{a}") for a in "xyz"], "nx", "ny", "nz")
    x = there.join(rec.select("id", "x", "y", "z"), "id").join(n, "near_id")
    off = (c("x") - c("rx")) * c("nx") + (c("y") - c("ry")) * c("ny") + (c("z") - c("rz")) * c("nz")
    m = x.agg(F.avg("distance").alias("there"), F.sqrt(F.avg(c("distance") * c("distance"))).alias("rmse"), F.sqrt(F.avg(off * off)).alias("plane"))
    return m.crossJoin(F.broadcast(back)).select(r((c("there") + c("back")) * 0.5).alias("chamfer"), r(c("rmse")).alias("rmse"), r(c("plane")).alias("plane_rmse"))


@query("e2_fa10_completeness", f"WITH {GS}, rd AS (SELECT a.id, min({DIST}) AS d, min({DIST}) FILTER (WHERE b.opacity_logit > 0) AS dh FROM ref a, rec b GROUP BY a.id) SELECT count(*) AS n_reference, round(avg(CASE WHEN d <= 1.5 THEN 1.0 ELSE 0.0 END), 9) AS completeness, round(avg(CASE WHEN dh <= 1.5 THEN 1.0 ELSE 0.0 END), 9) AS high_completeness FROM rd")
def _(s, d):
    rec, ref = clouds(s, d)
    a = nearest(ref, rec).select("id", c("distance").alias("d"))
    h = nearest(ref, rec.where("opacity_logit > 0")).select("id", c("distance").alias("dh"))
    share = lambda v: r(F.avg(F.when(c(v) <= 1.5, 1.0).otherwise(0.0)))
    return a.join(h, "id", "left").agg(F.count(F.lit(1)).alias("n_reference"), share("d").alias("completeness"), share("dh").alias("high_completeness"))


@query("e5_scale_seed", f"WITH {GS} SELECT a.id, round(greatest(min({DIST}), 1e-6), 9) AS seed_scale FROM g a, g b WHERE a.id <> b.id GROUP BY a.id")
def _(s, d):
    g = A.gaussians(s, d)
    return nearest(g, g, exclude_self=True).select("id", r(F.greatest(c("distance"), F.lit(1e-6))).alias("seed_scale"))


@query("d11_outlier_removal", f"WITH {GS}, n AS (SELECT a.id, {DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS k FROM g a, g b WHERE a.id <> b.id), m AS (SELECT id, avg(d) AS mean_d FROM n WHERE k <= 20 GROUP BY 1), t AS (SELECT avg(mean_d) + 2 * stddev_samp(mean_d) AS t FROM m) SELECT id, round(mean_d, 9) AS mean_distance, mean_d > t AS outlier FROM m, t")
def _(s, d):
    g = A.gaussians(s, d)
    m = k_nearest(g, g, 20, exclude_self=True).select("id", (F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["d"]) / F.size("hits")).alias("m"))
    t = m.agg((F.avg("m") + F.stddev_samp("m") * 2).alias("t"))
    return m.crossJoin(F.broadcast(t)).select("id", r(c("m")).alias("mean_distance"), (c("m") > c("t")).alias("outlier"))


CE = f"{NN}, ce AS (SELECT nn.id, 1.0 / (1.0 + exp(-rec.opacity_logit)) AS conf, distance AS err FROM nn JOIN rec USING (id))"


def conf_error(s, d):
    rec, ref = clouds(s, d)
    return nearest(rec, ref).join(rec.select("id", G.sigmoid(c("opacity_logit")).alias("conf")), "id").select("id", "conf", c("distance").alias("err"))


@query("e4_fa18_fa19_correlation", f"WITH {CE}, k AS (SELECT conf, err, (rank() OVER (ORDER BY conf))::DOUBLE + (count(*) OVER (PARTITION BY conf) - 1) / 2.0::DOUBLE AS rc, (rank() OVER (ORDER BY err))::DOUBLE + (count(*) OVER (PARTITION BY err) - 1) / 2.0::DOUBLE AS re FROM ce) SELECT round(corr(conf, err), 9) AS pearson, round(corr(rc, re), 9) AS spearman FROM k")
def _(s, d):
    x = conf_error(s, d)
    y = x.join(average_ranks(x, "conf", "r_conf"), "conf").join(average_ranks(x, "err", "r_err"), "err")
    return y.agg(r(F.corr("conf", "err")).alias("pearson"), r(F.corr("r_conf", "r_err")).alias("spearman"))


@query("fa20_quantile_bins", f"WITH {CE}, e AS (SELECT i, quantile_cont(conf, 0.1) AS q1, quantile_cont(conf, 0.2) AS q2, quantile_cont(conf, 0.3) AS q3, quantile_cont(conf, 0.4) AS q4, quantile_cont(conf, 0.5) AS q5, quantile_cont(conf, 0.6) AS q6, quantile_cont(conf, 0.7) AS q7, quantile_cont(conf, 0.8) AS q8, quantile_cont(conf, 0.9) AS q9 FROM ce, (SELECT 1 AS i) GROUP BY i) SELECT ((conf > q1)::BIGINT + (conf > q2)::BIGINT + (conf > q3)::BIGINT + (conf > q4)::BIGINT + (conf > q5)::BIGINT + (conf > q6)::BIGINT + (conf > q7)::BIGINT + (conf > q8)::BIGINT + (conf > q9)::BIGINT) AS bin, count(*) AS n, round(avg(conf), 9) AS mean_conf, round(avg(err), 9) AS mean_err, round(quantile_cont(err, 0.5), 9) AS median_err FROM ce, e GROUP BY 1")
def _(s, d):
    """Ten bins by exact quantile edges; a value on an edge belongs to the lower bin."""
    x = conf_error(s, d)
    q = x.agg(F.percentile("conf", F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("q"))
    b = x.crossJoin(F.broadcast(q)).withColumn("bin", F.size(F.filter("q", lambda e: c("conf") > e)).cast("bigint"))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r(F.avg("conf")).alias("mean_conf"), r(F.avg("err")).alias("mean_err"), r(F.percentile("err", F.lit(0.5))).alias("median_err"))


# --- Gaussians -----------------------------------------------------------------------------

QN = "qn AS (SELECT *, greatest(sqrt(qw * qw + qx * qx + qy * qy + qz * qz), 1e-12) AS qq FROM g), m AS (SELECT *, qw / qq AS w, qx / qq AS a, qy / qq AS b, qz / qq AS c FROM qn), k AS (SELECT *, CASE WHEN s0 <= s1 AND s0 <= s2 THEN 0 WHEN s1 <= s2 THEN 1 ELSE 2 END AS thin FROM m)"


@query("c19_c20_normals_anisotropy", f"WITH {GS}, {QN} SELECT id, round(CASE thin WHEN 0 THEN 1 - 2 * (b * b + c * c) WHEN 1 THEN 2 * (a * b - w * c) ELSE 2 * (a * c + w * b) END, 9) AS nx, round(CASE thin WHEN 0 THEN 2 * (a * b + w * c) WHEN 1 THEN 1 - 2 * (a * a + c * c) ELSE 2 * (b * c - w * a) END, 9) AS ny, round(CASE thin WHEN 0 THEN 2 * (a * c - w * b) WHEN 1 THEN 2 * (b * c + w * a) ELSE 1 - 2 * (a * a + b * b) END, 9) AS nz, round(greatest(s0, s1, s2) / greatest(least(s0, s1, s2), 1e-9), 9) AS anisotropy, round((s0 + s1 + s2) / 3, 9) AS scale_mean FROM k")
def _(s, d):
    sc = (c("s0"), c("s1"), c("s2"))
    n = G.normal(G.quaternion_matrix(c("qw"), c("qx"), c("qy"), c("qz")), sc)
    return A.gaussians(s, d).select("id", *[r(v).alias(f"n{a}") for a, v in zip("xyz", n)], r(G.anisotropy(sc)).alias("anisotropy"), r((c("s0") + c("s1") + c("s2")) / 3.0).alias("scale_mean"))


@query("d6_floaters", f"WITH {GS}, t AS (SELECT quantile_cont((s0 + s1 + s2) / 3, 0.9) AS t FROM g) SELECT id FROM g, t WHERE greatest(s0, s1, s2) / greatest(least(s0, s1, s2), 1e-9) < 3 AND (s0 + s1 + s2) / 3 > t")
def _(s, d):
    g = A.gaussians(s, d).select("id", G.anisotropy((c("s0"), c("s1"), c("s2"))).alias("an"), ((c("s0") + c("s1") + c("s2")) / 3.0).alias("m"))
    t = g.agg(F.percentile("m", F.lit(0.9)).alias("t"))
    return g.crossJoin(F.broadcast(t)).where("an < 3 and m > t").select("id")


@query("d7_oversize_prune", f"WITH {GS}, e AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM g), f AS (SELECT id, greatest(s0, s1, s2) > 0.1 * e AS big FROM g, e), a AS (SELECT avg(big::INT) AS share FROM f) SELECT id, big AND share <= 0.2 AS prune FROM f, a")
def _(s, d):
    """Too large Gaussians go, unless that would be more than a fifth of them."""
    g = A.gaussians(s, d)
    e = g.agg(F.greatest(*[F.max(a) - F.min(a) for a in "xyz"]).alias("e"))
    f = g.crossJoin(F.broadcast(e)).select("id", (F.greatest("s0", "s1", "s2") > c("e") * 0.1).alias("big"))
    share = f.agg(F.avg(c("big").cast("int")).alias("share"))
    return f.crossJoin(F.broadcast(share)).select("id", (c("big") & (c("share") <= 0.2)).alias("prune"))


@query("c21_c22_color_opacity", f"WITH {GS} SELECT id, round(greatest(0, least(1, dc * 0.28209479::DOUBLE + 0.5)), 9) AS color, round((greatest(0, least(1, dc * 0.28209479::DOUBLE + 0.5)) - 0.5) / 0.28209479::DOUBLE, 9) AS dc_back, round(1 / (1 + exp(-opacity_logit)), 9) AS opacity, round(ln(greatest(1e-4, least(1 - 1e-4, 0.5 * (0.3 + 0.7 * (1 / (1 + exp(-opacity_logit)))))) / (1 - greatest(1e-4, least(1 - 1e-4, 0.5 * (0.3 + 0.7 * (1 / (1 + exp(-opacity_logit)))))))), 9) AS init_logit FROM g")
def _(s, d):
    col, op = G.sh_to_color(c("dc")), G.sigmoid(c("opacity_logit"))
    return A.gaussians(s, d).select("id", r(col).alias("color"), r(G.color_to_sh(col)).alias("dc_back"), r(op).alias("opacity"), r(G.logit(G.initial_opacity(op))).alias("init_logit"))


@query("fa32_view_gradient", "SELECT label AS id, round(sum(abs(embedding[1]::DOUBLE)) FILTER (WHERE embedding[2] > 0) / greatest(count(*) FILTER (WHERE embedding[2] > 0), 1), 9) AS mean_gradient FROM embeddings GROUP BY 1")
def _(s, d):
    e = table(s, d, "embeddings").select(c("label").alias("id"), F.abs(c("embedding")[0].cast("double")).alias("g"), (c("embedding")[1] > 0).alias("seen"))
    return e.groupBy("id").agg(r(F.sum(F.when(c("seen"), c("g"))) / F.greatest(F.count(F.when(c("seen"), 1)), F.lit(1))).alias("mean_gradient"))


# --- buildings -----------------------------------------------------------------------------

BLD = f"""{SCORED_SQL}, bld AS (SELECT s_suppkey AS id, (s_suppkey % 10)::DOUBLE * 10 + 2 AS cx, floor(s_suppkey::DOUBLE / 10) * 5 + 2 AS cy, 3.0 AS hw, (s_suppkey % 7)::DOUBLE + 1 AS h FROM supplier),
inb AS (SELECT bld.id, bld.cx, bld.cy, bld.h, p.x, p.y, p.z FROM points p JOIN bld ON p.x BETWEEN cx - hw - 1.5 AND cx + hw + 1.5 AND p.y BETWEEN cy - hw - 1.5 AND cy + hw + 1.5),
hts AS (SELECT id, any_value(cx) AS cx, any_value(cy) AS cy, any_value(h) AS h, count(*) AS n, avg(x) AS mx, avg(y) AS my, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS measured FROM inb GROUP BY 1)"""


def heights(s, d):
    """Points of each footprint (margin 1.5 m): their number, centre and robust height."""
    b = A.buildings(s, d)
    m = 1.5
    box = b.select("id", "cx", "cy", "height", (c("cx") - c("hw") - m).alias("x0"), (c("cx") + c("hw") + m).alias("x1"), (c("cy") - c("hw") - m).alias("y0"), (c("cy") + c("hw") + m).alias("y1"))
    x = in_boxes(scored(s, d).select("x", "y", "z"), box, 8.0)
    return x.groupBy("id").agg(
        F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("height").alias("h"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.percentile("z", F.lit(0.95)) - F.percentile("z", F.lit(0.05))).alias("measured")
    )


@query("e7_d10_c32_fa11_heights", f"WITH {BLD} SELECT bld.id, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN round(measured, 9) END AS measured, CASE WHEN n >= 5 THEN round(measured - bld.h, 9) END AS error, CASE WHEN n >= 5 THEN round(100 * (measured - bld.h) / greatest(bld.h, 1e-6), 6) END AS error_pct FROM bld LEFT JOIN hts USING (id)")
def _(s, d):
    x = A.buildings(s, d).select("id", "height").join(heights(s, d).select("id", "n", "measured"), "id", "left")
    ok = c("n") >= 5
    err = c("measured") - c("height")
    return x.select("id", F.coalesce("n", F.lit(0)).alias("n"), F.when(ok, r(c("measured"))).alias("measured"), F.when(ok, r(err)).alias("error"), F.when(ok, r(F.lit(100.0) * err / F.greatest("height", F.lit(1e-6)), 6)).alias("error_pct"))


@query("fa13_height_summary", f"WITH {BLD}, k AS (SELECT * FROM hts WHERE n >= 5) SELECT count(*) AS n_measured, (SELECT count(*) FROM hts) AS n_total, round(avg(abs(measured - h)), 9) AS mean_abs_m, round(avg(abs(100.0 * (measured - h) / greatest(h, 1e-6))), 6) AS mean_abs_pct FROM k")
def _(s, d):
    """How far the measured heights of the buildings are off, in metres and per cent."""
    x = heights(s, d)
    err = F.when(c("n") >= 5, F.abs(c("measured") - c("h")))
    return x.agg(F.count(err).alias("n_measured"), F.count(F.lit(1)).alias("n_total"), r(F.avg(err)).alias("mean_abs_m"), r(F.avg(err * 100.0 / F.greatest("h", F.lit(1e-6))), 6).alias("mean_abs_pct"))


@query("e8_fa12_distances", f"WITH {BLD}, k AS (SELECT * FROM hts WHERE n >= 5) SELECT a.id AS id_a, b.id AS id_b, round(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)), 9) AS true_d, round(sqrt(pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2)) - sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)), 6) AS error FROM k a JOIN k b ON a.id < b.id")
def _(s, d):
    """Distances between all buildings with points, each pair once.

    Buildings meet in pairs of blocks of about 128: every building is listed once for each block
    its own is paired with, so no task holds them all and every pair meets in one place.
    """
    blocks = F.lit(-(-A.buildings(s, d).count() // 128) or 1)
    k = heights(s, d).where("n >= 5").select("id", "cx", "cy", "mx", "my", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"))
    others = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    x = k.select("*", others)
    left = x.where("own <= other").select("id", "cx", "cy", "mx", "my", c("own").alias("p"), c("other").alias("q"))
    right = x.where("other <= own").select(F.struct("id", "cx", "cy", "mx", "my").alias("o"), c("other").alias("p"), c("own").alias("q"))
    p = left.join(right, ["p", "q"]).where((c("p") < c("q")) | (c("id") < c("o.id")))
    p = p.select(F.least("id", "o.id").alias("id_a"), F.greatest("id", "o.id").alias("id_b"), "cx", "cy", "mx", "my", "o")
    true = F.sqrt(F.pow(c("cx") - c("o.cx"), 2) + F.pow(c("cy") - c("o.cy"), 2))
    got = F.sqrt(F.pow(c("mx") - c("o.mx"), 2) + F.pow(c("my") - c("o.my"), 2))
    return p.select("id_a", "id_b", r(true).alias("true_d"), r(got - true, 6).alias("error"))


CTRL = f"{BLD}, cp AS (SELECT bld.id, min(sqrt(pow(p.x - cx, 2) + pow(p.y - cy, 2) + pow(p.z - h, 2))) AS d FROM bld, points p GROUP BY 1)"


@query("e3_fa13_control_points", f"WITH {CTRL} SELECT count(*) AS n_total, count(*) FILTER (WHERE d <= 4) AS n_matched, round(sqrt(avg(d * d) FILTER (WHERE d <= 4)), 9) AS rmse, round(avg(d) FILTER (WHERE d <= 4), 9) AS mean, (count(*) FILTER (WHERE d <= 4))::VARCHAR || '/' || count(*)::VARCHAR AS control_points_matched FROM cp")
def _(s, d):
    apex = A.buildings(s, d).select("id", c("cx").alias("x"), c("cy").alias("y"), c("height").alias("z"))
    p = scored(s, d).select(F.xxhash64("vx", "vy", "vz").alias("id"), "x", "y", "z")
    n = nearest(apex, p)
    near = F.when(c("distance") <= 4, c("distance"))
    return n.agg(
        F.count(F.lit(1)).alias("n_total"), F.count(near).alias("n_matched"), r(F.sqrt(F.avg(near * near))).alias("rmse"), r(F.avg(near)).alias("mean"), F.concat(F.count(near).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("control_points_matched")
    )


DIST = "q AS (SELECT err AS d FROM ce), m AS (SELECT avg(d) AS mean, sqrt(avg(d * d)) AS rmse, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.9) AS p90, quantile_cont(d, 0.95) AS p95, max(d) AS worst, avg((d <= 0.4)::INT) AS within_04, avg((d <= 1.0)::INT) AS within_1, avg((d <= 2.0)::INT) AS within_2 FROM q)"


@query("fa22_surface_consistency", f"WITH {CE}, {DIST} SELECT " + ", ".join(f"round({n}, 9) AS {n}" for n in ("mean", "rmse", "p50", "p90", "p95", "worst", "within_04", "within_1", "within_2")) + ", (mean <= 1.0)::INT + (rmse <= 1.2)::INT + (p90 <= 1.0)::INT + (within_1 >= 0.5)::INT + (within_04 >= 0.9)::INT AS n_met FROM m")
def _(s, d):
    """Distances of the reconstructed points to their nearest reference points, against the five targets."""
    e = c("err")
    within = lambda v: F.avg((e <= v).cast("int"))
    m = conf_error(s, d).agg(F.avg(e).alias("mean"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(e, F.array(*[F.lit(q) for q in (0.5, 0.9, 0.95)])).alias("q"), F.max(e).alias("worst"), within(0.4).alias("within_04"), within(1.0).alias("within_1"), within(2.0).alias("within_2"))
    m = m.withColumns({n: c("q")[i] for i, n in enumerate(("p50", "p90", "p95"))})
    met = reduce(lambda a, b: a + b, [t.cast("int") for t in (c("mean") <= 1.0, c("rmse") <= 1.2, c("p90") <= 1.0, c("within_1") >= 0.5, c("within_04") >= 0.9)])
    return m.select(*[r(c(n)).alias(n) for n in ("mean", "rmse", "p50", "p90", "p95", "worst", "within_04", "within_1", "within_2")], met.alias("n_met"))


# --- coverage ------------------------------------------------------------------------------

COV = """v AS (SELECT l_partkey AS tri, bool_or(true) AS seen, bool_or(l_suppkey % 2 = 0) AS kept, min(l_discount) AS best FROM lineitem GROUP BY 1),
st AS (SELECT p_partkey AS triangle_id, p_type AS semantic, CASE WHEN kept THEN 'observed' WHEN seen THEN 'observable_but_dropped' ELSE 'never_observable' END AS status, best FROM part LEFT JOIN v ON p_partkey = tri)"""


def coverage(s, d):
    """Triangles by whether any frame, or a kept frame, sees them, over every row of the ledger (even frames are kept)."""
    v = A.visibility(s, d).groupBy(c("triangle_id").alias("tri")).agg(F.max(F.pmod("frame_idx", F.lit(2)) == 0).alias("kept"), F.min("view_angle").alias("best"))
    t = table(s, d, "part").select(c("p_partkey").alias("triangle_id"), c("p_type").alias("semantic"))
    x = t.join(v, c("triangle_id") == c("tri"), "left")
    return x.select("triangle_id", "semantic", F.when(c("kept"), "observed").when(c("tri").isNotNull(), "observable_but_dropped").otherwise("never_observable").alias("status"), "best")


@query("e16_e17_fa15_coverage", f"WITH {COV} SELECT triangle_id, semantic, status, best AS best_view_angle FROM st")
def _(s, d):
    return coverage(s, d).select("triangle_id", "semantic", "status", c("best").alias("best_view_angle"))


@query("fa14_coverage_by_semantic", f"WITH {COV} SELECT coalesce(semantic, 'all') AS semantic, count(*) AS n, round(avg((status = 'observed')::INT), 9) AS observed, round(avg((status = 'observable_but_dropped')::INT), 9) AS dropped, round(avg((status = 'never_observable')::INT), 9) AS never FROM st GROUP BY ROLLUP (semantic)")
def _(s, d):
    share = lambda v: r(F.avg((c("status") == v).cast("int")))
    x = coverage(s, d).rollup("semantic").agg(F.count(F.lit(1)).alias("n"), share("observed").alias("observed"), share("observable_but_dropped").alias("dropped"), share("never_observable").alias("never"))
    return x.withColumn("semantic", F.coalesce("semantic", F.lit("all")))


# --- meshes --------------------------------------------------------------------------------

FACE = "fc AS (SELECT l_orderkey * 8 + l_linenumber AS fid, l_orderkey % nv AS a, l_partkey % nv AS b, l_suppkey % nv AS c FROM lineitem, (SELECT count(*) AS nv FROM embeddings)), ed AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM fc UNION ALL SELECT least(b, c), greatest(b, c) FROM fc UNION ALL SELECT least(c, a), greatest(c, a) FROM fc), ec AS (SELECT a, b, count(*) AS n FROM ed GROUP BY ALL)"


@query("e19_fa21_edge_topology", f"WITH {FACE} SELECT count(*) AS n_edges, count(*) FILTER (WHERE n = 1) AS boundary_edges, count(*) FILTER (WHERE n > 2) AS nonmanifold_edges, (SELECT count(*) FROM fc WHERE a = b OR b = c OR a = c) AS degenerate FROM ec")
def _(s, d):
    f = A.faces(s, d)
    bad = f.agg(F.count(F.when((c("a") == c("b")) | (c("b") == c("c")) | (c("a") == c("c")), 1)).alias("degenerate"))
    e = face_edges(f).agg(F.count(F.lit(1)).alias("n_edges"), F.count(F.when(c("n") == 1, 1)).alias("boundary_edges"), F.count(F.when(c("n") > 2, 1)).alias("nonmanifold_edges"))
    return e.crossJoin(F.broadcast(bad))


@query("d14_clean_faces", f"WITH {FACE}, s AS (SELECT fid, list_sort([a, b, c]) AS k FROM fc WHERE a <> b AND b <> c AND a <> c) SELECT min(fid) AS fid FROM s GROUP BY k")
def _(s, d):
    """Faces without repeated corners, each set of corners once (the lowest number stays)."""
    f = A.faces(s, d).where("a <> b and b <> c and a <> c")
    return f.groupBy(F.sort_array(F.array("a", "b", "c")).alias("k")).agg(F.min("fid").alias("fid")).select("fid")


@query("fa21_face_areas", f"WITH {GS}, t AS (SELECT l_orderkey * 8 + l_linenumber AS fid, l_orderkey % nv AS a, l_partkey % nv AS b, l_suppkey % nv AS c FROM lineitem, (SELECT count(*) AS nv FROM embeddings)), v AS (SELECT t.*, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, w.x - p.x AS vx, w.y - p.y AS vy, w.z - p.z AS vz FROM t JOIN g p ON p.id = a JOIN g q ON q.id = b JOIN g w ON w.id = c), s AS (SELECT 0.5 * sqrt(pow(uy * vz - uz * vy, 2) + pow(uz * vx - ux * vz, 2) + pow(ux * vy - uy * vx, 2)) AS area FROM v) SELECT count(*) AS n, round(sum(area), 3) AS area, round(quantile_cont(area, 0.5), 9) AS area_p50, round(quantile_cont(area, 0.99), 9) AS area_p99, count(*) FILTER (WHERE area < 1e-10) AS n_flat FROM s")
def _(s, d):
    """Number, sum and exact percentiles of the areas; the vertices are counted first, and up to a bound go to the faces."""
    g = A.gaussians(s, d).select("id", "x", "y", "z")
    n = g.count()
    small = n <= SMALL_MESH
    t = A.faces(s, d, n)
    for k in "abc":
        corner = g.select(c("id").alias(k), *[c(m).alias(f"{k}{m}") for m in "xyz"])
        t = t.join(F.broadcast(corner) if small else corner, k)
    u, v = [c(f"b{m}") - c(f"a{m}") for m in "xyz"], [c(f"c{m}") - c(f"a{m}") for m in "xyz"]
    cross = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    t = t.select((F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) * 0.5).alias("area"))
    if not small:  # read twice; the exchanges of the joins only once
        ensure_checkpoint_dir(s)
        t = t.checkpoint()
    t = percentiles(t, "area", {"area_p50": 0.5, "area_p99": 0.99}, {"n": F.lit(1), "area": c("area"), "n_flat": F.when(c("area") < 1e-10, 1).otherwise(0)})
    return t.select(F.coalesce("n", F.lit(0)).alias("n"), r(c("area"), 3).alias("area"), r(c("area_p50")).alias("area_p50"), r(c("area_p99")).alias("area_p99"), F.coalesce("n_flat", F.lit(0)).alias("n_flat"))


@query("fa21_mesh_components")
def _(s, d):
    """Connected parts of the whole mesh (a vertex without faces is its own), the share of the largest, and the extent."""
    v = A.gaussians(s, d).select("id", "x", "y", "z")
    labels = components(face_edges(A.faces(s, d)).select("a", "b"), v.select(c("id").alias("v")))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    n = sizes.agg(F.count(F.lit(1)).alias("n_components"), (F.max("size") / F.sum("size")).alias("largest_frac"))
    box = v.agg(*[f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"])
    return n.crossJoin(F.broadcast(box)).select(F.coalesce("n_components", F.lit(0)).alias("n_components"), r(F.coalesce("largest_frac", F.lit(0.0))).alias("largest_frac"), *[r(c(x)).alias(x) for x in box.columns])


def _edges(s, d):
    """Orders and the parts in them, every row an edge; even numbers are orders, odd ones parts."""
    return table(s, d, "lineitem").select((c("l_orderkey") * 2).alias("a"), (c("l_partkey") * 2 + 1).alias("b"))


@query("k10_components")
def _(s, d):
    return components(_edges(s, d))


@query("d13_h4_small_components")
def _(s, d):
    return small_components(components(_edges(s, d)), 4, 5).select("v", "component")
