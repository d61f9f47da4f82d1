"""Queries over camera models, poses and the generators' closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import geometry as G
from skyledger.sources import adapters as A
from skyledger.tables import table

c = F.col
r = lambda x, n=9: F.round(x, n)
QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("c1_c2_c3_intrinsics", "WITH k AS (SELECT p_partkey AS id, p_size + 600 AS width, p_size + 400 AS height, 40.0 + (p_partkey % 60) AS hfov FROM part) SELECT id, round((width / 2.0::DOUBLE) / tan(radians(hfov) / 2), 9) AS fx, round(degrees(2 * atan(width / (2 * ((width / 2.0::DOUBLE) / tan(radians(hfov) / 2))))), 9) AS hfov, round(degrees(2 * atan(tan(radians(hfov) / 2) * height / width)), 9) AS vfov FROM k")
def _(s, d):
    k = table(s, d, "part").select(c("p_partkey").alias("id"), (c("p_size") + 600).alias("width"), (c("p_size") + 400).alias("height"), (F.lit(40.0) + c("p_partkey") % 60).alias("h"))
    fx = G.focal_from_hfov(c("width"), c("h"))
    return k.select("id", r(fx).alias("fx"), r(G.hfov_from_focal(c("width"), fx)).alias("hfov"), r(G.vfov_from_hfov(c("h"), c("width"), c("height"))).alias("vfov"))


POSE = """p AS (SELECT flight_id, pose_no, min(pos_x) AS px, min(pos_y) AS py, min(pos_z) AS pz, min(yaw) AS yw, min(pitch) AS pt, min(roll) AS rl FROM fused_pose GROUP BY ALL),
m AS (SELECT *, cos(yw) * cos(pt) AS r00, -cos(yw) * sin(pt) * sin(rl) - sin(yw) * cos(rl) AS r01, -cos(yw) * sin(pt) * cos(rl) + sin(yw) * sin(rl) AS r02, sin(yw) * cos(pt) AS r10, -sin(yw) * sin(pt) * sin(rl) + cos(yw) * cos(rl) AS r11, -sin(yw) * sin(pt) * cos(rl) - cos(yw) * sin(rl) AS r12, sin(pt) AS r20, cos(pt) * sin(rl) AS r21, cos(pt) * cos(rl) AS r22 FROM p),
w AS (SELECT *, r01 AS w00, -r02 AS w01, r00 AS w02, r11 AS w10, -r12 AS w11, r10 AS w12, r21 AS w20, -r22 AS w21, r20 AS w22 FROM m),
q AS (SELECT *, (10 - px) * w00 + (20 - py) * w10 + (0 - pz) * w20 AS cx, (10 - px) * w01 + (20 - py) * w11 + (0 - pz) * w21 AS cy, (10 - px) * w02 + (20 - py) * w12 + (0 - pz) * w22 AS cz FROM w)"""


def poses(s, d):
    p = A.poses(s, d)
    return p, G.camera_pose(c("yaw"), c("pitch"), c("roll"))


@query("c4_c5_c8_pose_axis", f"WITH {POSE} SELECT flight_id, pose_no, round(w02, 9) AS fx, round(w12, 9) AS fy, round(w22, 9) AS fz, round(CASE WHEN sqrt(pow(10 - px, 2) + pow(20 - py, 2) + pow(pz, 2)) < 1e-9 THEN 0 ELSE acos(greatest(-1, least(1, ((10 - px) * w02 + (20 - py) * w12 - pz * w22) / sqrt(pow(10 - px, 2) + pow(20 - py, 2) + pow(pz, 2))))) END, 6) AS angle FROM w")
def _(s, d):
    p, m = poses(s, d)
    axis = (m["02"], m["12"], m["22"])
    to = (F.lit(10.0) - c("pos_x"), F.lit(20.0) - c("pos_y"), -c("pos_z"))
    return p.select("flight_id", "pose_no", *[r(a).alias(n) for a, n in zip(axis, ("fx", "fy", "fz"))], r(G.ray_angle(axis, to), 6).alias("angle"))


@query("c6_c7_project_landmark", f"WITH {POSE} SELECT flight_id, pose_no, round(cz, 6) AS depth, CASE WHEN cz > 1 THEN round(300 * cx / cz + 160, 4) END AS u, CASE WHEN cz > 1 THEN round(300 * cy / cz + 120, 4) END AS v FROM q")
def _(s, d):
    """The landmark (10, 20, 0) in each camera and, where it lies in front, its pixel."""
    p, m = poses(s, d)
    cam = G.to_camera(m, (F.lit(10.0), F.lit(20.0), F.lit(0.0)), (c("pos_x"), c("pos_y"), c("pos_z")))
    u, v = G.project(cam, F.lit(300.0), F.lit(300.0), F.lit(160.0), F.lit(120.0))
    ok = cam[2] > 1
    return p.select("flight_id", "pose_no", r(cam[2], 6).alias("depth"), F.when(ok, r(u, 4)).alias("u"), F.when(ok, r(v, 4)).alias("v"))


@query("c9_c10_c17_backproject", f"WITH {POSE}, b AS (SELECT *, (40.0 - 160) / 300 AS rx, (200.0 - 120) / 300 AS ry FROM w) SELECT flight_id, pose_no, round(acos(1 / sqrt(rx * rx + ry * ry + 1)), 9) AS view_angle, round(25 * rx * w00 + 25 * ry * w01 + 25 * w02 + px, 6) AS x, round(25 * rx * w10 + 25 * ry * w11 + 25 * w12 + py, 6) AS y, round(25 * rx * w20 + 25 * ry * w21 + 25 * w22 + pz, 6) AS z FROM b")
def _(s, d):
    """Pixel (40, 200) at depth 25 in the world, with each pose's own intrinsics."""
    p, m = poses(s, d)
    rx, ry = G.ray(F.lit(40.0), F.lit(200.0), F.lit(300.0), F.lit(300.0), F.lit(160.0), F.lit(120.0))
    w = G.to_world(m, (rx * 25.0, ry * 25.0, F.lit(25.0)), (c("pos_x"), c("pos_y"), c("pos_z")))
    return p.select("flight_id", "pose_no", r(G.pixel_angle(rx, ry)).alias("view_angle"), *[r(v, 6).alias(n) for v, n in zip(w, "xyz")])


@query("c15_invert_pose", f"WITH {POSE} SELECT flight_id, pose_no, round(-(w00 * px + w10 * py + w20 * pz), 6) AS cx, round(-(w01 * px + w11 * py + w21 * pz), 6) AS cy, round(-(w02 * px + w12 * py + w22 * pz), 6) AS cz FROM w")
def _(s, d):
    p, m = poses(s, d)
    _, pos = G.invert_pose(m, (c("pos_x"), c("pos_y"), c("pos_z")))
    return p.select("flight_id", "pose_no", *[r(v, 6).alias(n) for v, n in zip(pos, ("cx", "cy", "cz"))])


@query("c18_clip_matrix", "WITH k AS (SELECT p_partkey AS id, 40.0::DOUBLE + (p_partkey % 60) AS hfov FROM part) SELECT id, round(1 / tan(radians(hfov) / 2), 9) AS m00, round(500.0::DOUBLE / (500.0::DOUBLE - 0.05), 9) AS m22, round(-(500.0::DOUBLE * 0.05) / (500.0::DOUBLE - 0.05), 9) AS m23 FROM k")
def _(s, d):
    k = table(s, d, "part").select(c("p_partkey").alias("id"), (F.lit(40.0) + c("p_partkey") % 60).alias("h"))
    near, far = 0.05, 500.0
    return k.select("id", r(F.lit(1.0) / F.tan(F.radians("h") / 2.0)).alias("m00"), r(F.lit(far / (far - near))).alias("m22"), r(F.lit(-(far * near) / (far - near))).alias("m23"))


@query("c28_safe_numbers", "SELECT flight_id, count(*) AS n, count(height_m) FILTER (WHERE isnan(height_m)) AS n_nan, round(avg(CASE WHEN isnan(height_m) THEN NULL ELSE height_m END), 9) AS mean_height FROM (SELECT DISTINCT flight_id, seq, height_m FROM telemetry) GROUP BY 1")
def _(s, d):
    t = table(s, d, "telemetry").select("flight_id", "seq", "height_m").distinct()
    return t.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.isnan("height_m"), 1)).alias("n_nan"), F.round(F.avg(G.finite(c("height_m"))), 9).alias("mean_height"))


@query("c29_padding_geometry", """WITH s AS (SELECT o_orderkey AS id, 320 + o_orderkey % 400 AS w, 240 + o_orderkey % 300 AS h FROM orders),
g AS (SELECT id, CASE WHEN w >= h THEN 518 ELSE least(518, CAST(round_even(w * (518::DOUBLE / h) / 14.0, 0) AS BIGINT) * 14) END::BIGINT AS width,
CASE WHEN w >= h THEN least(518, CAST(round_even(h * (518::DOUBLE / w) / 14.0, 0) AS BIGINT) * 14) ELSE 518 END::BIGINT AS height FROM s)
SELECT id, (518 - width) // 2 AS pad_left, width, (518 - height) // 2 AS pad_top, height, CAST(round_even(height * 0.08::DOUBLE, 0) AS BIGINT) AS crop_top FROM g""")
def _(s, d):
    """The longest side scaled to 518, the other to a multiple of 14, both centred, the top 8 % of the image masked.

    Images are 320 to 719 wide and 240 to 539 high by order number. Halves round to even, as in Python.
    """
    size, top = F.lit(518), 0.08
    w0, h0 = F.lit(320) + c("o_orderkey") % 400, F.lit(240) + c("o_orderkey") % 300
    short = lambda a, b: F.least(size, F.rint(a * (size / b) / 14.0).cast("bigint") * 14).cast("bigint")
    wide = w0 >= h0
    x = table(s, d, "orders").select(c("o_orderkey").alias("id"), F.when(wide, size).otherwise(short(w0, h0)).cast("bigint").alias("width"), F.when(wide, short(h0, w0)).otherwise(size).cast("bigint").alias("height"))
    pad = lambda n: F.floor((size - c(n)) / 2).cast("bigint")
    return x.select("id", pad("width").alias("pad_left"), "width", pad("height").alias("pad_top"), "height", F.rint(c("height") * top).cast("bigint").alias("crop_top"))


@query("c30_k6_expected_flow", f"WITH {POSE}, n AS (SELECT *, lead(px) OVER o AS nx, lead(py) OVER o AS ny, lead(pz) OVER o AS nz FROM q WINDOW o AS (PARTITION BY flight_id ORDER BY pose_no)), f AS (SELECT flight_id, pose_no, cx, cy, cz, (10 - nx) * w00 + (20 - ny) * w10 - nz * w20 AS ex, (10 - nx) * w01 + (20 - ny) * w11 - nz * w21 AS ey, (10 - nx) * w02 + (20 - ny) * w12 - nz * w22 AS ez FROM n WHERE nx IS NOT NULL) SELECT flight_id, pose_no, cz > 1 AND ez > 1 AS valid, CASE WHEN cz > 1 AND ez > 1 THEN round(sqrt(pow(300 * ex / ez - 300 * cx / cz, 2) + pow(300 * ey / ez - 300 * cy / cz, 2)), 3) END AS flow_px FROM f")
def _(s, d):
    """How far a static landmark moves in the image when the camera moves on without turning."""
    from pyspark.sql import Window as W

    o = W.partitionBy("flight_id").orderBy("pose_no")
    p, m = poses(s, d)
    p = p.withColumns({f"n{a}": F.lead(f"pos_{a}").over(o) for a in "xyz"}).where("nx is not null")
    land = (F.lit(10.0), F.lit(20.0), F.lit(0.0))
    a, b = G.to_camera(m, land, (c("pos_x"), c("pos_y"), c("pos_z"))), G.to_camera(m, land, (c("nx"), c("ny"), c("nz")))
    k = (F.lit(300.0), F.lit(300.0), F.lit(0.0), F.lit(0.0))
    (u0, v0), (u1, v1) = G.project(a, *k), G.project(b, *k)
    valid = (a[2] > 1) & (b[2] > 1)
    return p.select("flight_id", "pose_no", valid.alias("valid"), F.when(valid, r(F.sqrt(F.pow(u1 - u0, 2) + F.pow(v1 - v0, 2)), 3)).alias("flow_px"))


@query("c31_camera_clearance", "WITH p AS (SELECT flight_id, pose_no, min(pos_z) AS z FROM fused_pose GROUP BY ALL) SELECT flight_id, round(quantile_cont(z, 0.5), 9) AS median_altitude, round(greatest(15, least(120, quantile_cont(z, 0.5) * 0.5)), 9) AS clearance FROM p GROUP BY 1")
def _(s, d):
    m = F.percentile("pos_z", F.lit(0.5))
    return A.poses(s, d).groupBy("flight_id").agg(r(m).alias("median_altitude"), r(G.clip(m * 0.5, 15, 120)).alias("clearance"))


@query("d8_downward_views", f"WITH {POSE} SELECT flight_id, count(*) AS n, count(*) FILTER (WHERE w22 <= -0.5) AS n_down, count(*) FILTER (WHERE w22 <= -0.5) >= 8 AS enough FROM w GROUP BY 1")
def _(s, d):
    p, m = poses(s, d)
    n = F.count(F.when(m["22"] <= -0.5, 1))
    return p.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n"), n.alias("n_down"), (n >= 8).alias("enough"))


@query("a8_trajectory", "SELECT s_suppkey AS run, k.i AS i, round(k.i / 10.0::DOUBLE, 9) AS t, round(5.0 * k.i / 10.0::DOUBLE * 0.7071067811865476::DOUBLE, 9) AS x, round(5.0 * k.i / 10.0::DOUBLE * 0.7071067811865476::DOUBLE + 1.5 * sin(k.i / 10.0::DOUBLE), 9) AS y FROM supplier, range(50) AS k(i)")
def _(s, d):
    """A diagonal single pass with a sinusoidal wobble, in closed form."""
    x = table(s, d, "supplier").select(c("s_suppkey").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(49)).cast("array<bigint>")).alias("i"))
    t = c("i") / F.lit(10.0)
    along = F.lit(5.0) * t * 0.7071067811865476
    return x.select("run", "i", r(t).alias("t"), r(along).alias("x"), r(along + F.sin(t) * 1.5).alias("y"))


@query("a11_surface_sample_counts", "SELECT p_partkey AS triangle_id, greatest(1, round_even(p_size * 0.37::DOUBLE, 0))::BIGINT AS n FROM part")
def _(s, d):
    return table(s, d, "part").select(c("p_partkey").alias("triangle_id"), F.greatest(F.lit(1), F.bround(c("p_size") * 0.37).cast("bigint")).alias("n"))


@query("a11_surface_points")
def _(s, d):
    """Points on a triangle by seeded square-root barycentric coordinates, one row per point."""
    t = table(s, d, "part").select(c("p_partkey").alias("triangle_id"), F.greatest(F.lit(1), F.bround(c("p_size") * 0.37).cast("int")).alias("n"))
    x = t.select("triangle_id", F.explode(F.sequence(F.lit(1), c("n"))).alias("i"))
    u = lambda k: F.shiftrightunsigned(F.xxhash64("triangle_id", "i", F.lit(k)), 11).cast("double") / float(1 << 53)
    s1 = F.sqrt(u(1))
    return x.select("triangle_id", "i", (F.lit(1.0) - s1).alias("a"), (s1 * (F.lit(1.0) - u(2))).alias("b"), (s1 * u(2)).alias("c"))
