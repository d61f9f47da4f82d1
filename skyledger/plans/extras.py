"""Queries of the remaining sources, sinks and chains."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.operators.alignment import keyframe_chain, pair_sums, planar_chain
from skyledger.operators.blocks import meet_salted
from skyledger.operators.graph import components
from skyledger.operators.rejects import loaded_lines
from skyledger.plans.control import H
from skyledger.plans.data_quality import LOADED
from skyledger.plans.images import PX
from skyledger.plans.telemetry import P
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


@query("a1_csv_samples", f"""WITH x AS ({LOADED}), f AS (SELECT file_id, arg_min(sampled_at, line_no) AS t0 FROM x GROUP BY 1 HAVING count(*) >= 2)
SELECT file_id, line_no, format, (epoch_us(sampled_at) - epoch_us(t0)) / 1e6 AS t_sec, lat, lon, height_m, is_video, yaw_deg, pitch_deg, roll_deg FROM x JOIN f USING (file_id)""")
def _(s, d):
    """Samples of the CSV logs with seconds (to microseconds) since the file's first good row; files with fewer than two rows give none."""
    x = loaded_lines(table(s, d, "raw_lines"))
    f = x.groupBy("file_id").agg(F.min_by("sampled_at", "line_no").alias("t0"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    x = meet_salted(x, f, ["file_id"], c("line_no"))
    return x.select("file_id", "line_no", "format", ((F.unix_micros("sampled_at") - F.unix_micros("t0")) / 1e6).alias("t_sec"), "lat", "lon", "height_m", "is_video", "yaw_deg", "pitch_deg", "roll_deg")


@query("a9_sensor_simulator")
def _(s, d):
    """Noisy positions of the fused path: seeded normal noise (2.5 m, 5 m), 3 % outliers of 12 m, a drifting barometer."""
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("flight_id", "pose_no", F.lit(k)), 11).cast("double") + 0.5) / float(1 << 53)
    normal = lambda k: F.sqrt(F.log(u(k)) * -2.0) * F.cos(u(k + 100) * 6.283185307179586)
    w = W.partitionBy("flight_id").orderBy("pose_no").rowsBetween(W.unboundedPreceding, 0)
    out = F.when(u(50) < 0.03, 12.0).otherwise(0.0)
    x = A.poses(s, d)
    return x.select(
        "flight_id", "pose_no", (c("pos_x") + normal(1) * 2.5 + out * normal(5)).alias("gps_x"), (c("pos_y") + normal(2) * 2.5 + out * normal(6)).alias("gps_y"), (c("pos_z") + normal(3) * 5.0).alias("gps_z"), (u(50) < 0.03).alias("is_outlier"), (c("pos_z") + F.sum(normal(4) * 0.02).over(w)).alias("baro_alt")
    )


@query("a16_b7_session_json", """WITH j AS (SELECT event_id, '{"schema": "' || CASE WHEN event_id % 3 = 0 THEN 'annotation-session-v1' ELSE 'other' END || '", "annotations": [{"kind": "' || event_type || '", "value": ' || value || '}]}' AS doc FROM events) SELECT event_id, doc->>'$.annotations[0].kind' AS kind, CAST(doc->>'$.annotations[0].value' AS DOUBLE) AS value FROM j WHERE doc->>'$.schema' = 'annotation-session-v1'""")
def _(s, d):
    """Session documents written and read back with an explicit schema; others than the known version are refused."""
    version = F.when(c("event_id") % 3 == 0, "annotation-session-v1").otherwise("other")
    doc = F.to_json(F.struct(version.alias("schema"), F.array(F.struct(c("event_type").alias("kind"), "value")).alias("annotations")))
    x = table(s, d, "events").select("event_id", F.from_json(doc, "schema string, annotations array<struct<kind string, value double>>").alias("j"))
    return x.where("j.schema = 'annotation-session-v1'").select("event_id", c("j.annotations")[0]["kind"].alias("kind"), c("j.annotations")[0]["value"].alias("value"))


@query("b8_b9_history_lines", f"WITH {H} SELECT run, iter, '{{\"iter\":' || iter || ',\"n_gaussians\":' || n_gaussians || '}}' AS line FROM h")
def _(s, d):
    return A.checkpoints(s, d).select("run", "iter", F.to_json(F.struct("iter", "n_gaussians")).alias("line"))


@query("j16_report_lines", f"WITH {P} SELECT flight_id, format('{{:s}}: {{:d}} poses, mean std {{:.3f}} m', flight_id, count(*), avg(position_std_m)) AS line FROM p GROUP BY 1")
def _(s, d):
    g = A.poses(s, d).groupBy("flight_id").agg(F.count(F.lit(1)).alias("n"), F.avg("position_std_m").alias("m"))
    return g.select("flight_id", F.format_string("%s: %d poses, mean std %.3f m", "flight_id", "n", "m").alias("line"))


@query("fa29_evaluation_context", f"WITH {P} SELECT flight_id, json_object('n_poses', count(*), 'n_rejected', count(*) FILTER (WHERE NOT gps_used))::VARCHAR AS context FROM p GROUP BY 1")
def _(s, d):
    g = A.poses(s, d).groupBy("flight_id").agg(F.count(F.lit(1)).alias("n_poses"), F.count(F.when(~c("gps_used"), 1)).alias("n_rejected"))
    return g.select("flight_id", F.to_json(F.struct("n_poses", "n_rejected")).alias("context"))


@query("c16_pose_chain", f"WITH {P}, h AS (SELECT flight_id, pose_no, sum(yaw / 100) OVER w AS heading, 0.5 + position_std_m / 10 AS step FROM p WINDOW w AS (PARTITION BY flight_id ORDER BY pose_no ROWS UNBOUNDED PRECEDING)) SELECT flight_id, pose_no, round(sum(step * cos(heading)) OVER w, 6) AS x, round(sum(step * sin(heading)) OVER w, 6) AS y FROM h WINDOW w AS (PARTITION BY flight_id ORDER BY pose_no ROWS UNBOUNDED PRECEDING)")
def _(s, d):
    w = W.partitionBy("flight_id").orderBy("pose_no").rowsBetween(W.unboundedPreceding, 0)
    x = A.poses(s, d).withColumns(planar_chain("flight_id", "pose_no", c("yaw") / 100.0, F.lit(0.5) + c("position_std_m") / 10.0))
    return x.select("flight_id", "pose_no", r(F.sum("_dx").over(w), 6).alias("x"), r(F.sum("_dy").over(w), 6).alias("y"))


@query("g20_keyframe_chain")
def _(s, d):
    return keyframe_chain(A.frames(s, d), "flight_id", "idx", "overall")


@query("k16_k17_similarity_sums", f"WITH {P}, q AS (SELECT pos_x AS ax, pos_y AS ay, pos_z AS az, 2 * pos_y + 5 AS bx, -2 * pos_x + 1 AS bz FROM p) SELECT count(*) AS n, round(avg(ax), 6) AS m_ax, round(avg(bx), 6) AS m_bx, round(var_pop(ax) + var_pop(ay) + var_pop(az), 3) AS var, round(covar_pop(ay, bx), 3) AS k_01 FROM q")
def _(s, d):
    q = A.poses(s, d).select(c("pos_x").alias("ax"), c("pos_y").alias("ay"), c("pos_z").alias("az"), (c("pos_y") * 2.0 + 5.0).alias("bx"), (c("pos_x") * -2.0 + 1.0).alias("by"), (c("pos_z") * 2.0).alias("bz"))
    p = pair_sums(q, ("ax", "ay", "az"), ("bx", "by", "bz"))
    return p.select("n", r(c("m_ax"), 6).alias("m_ax"), r(c("m_bx"), 6).alias("m_bx"), r(c("var"), 3).alias("var"), r(c("k_01"), 3).alias("k_01"))


K6 = f"WITH RECURSIVE {PX}, b AS (SELECT frame_idx * 64 + row * 8 + col AS v, frame_idx, row, col FROM px WHERE v > 140), e AS (SELECT a.v AS a, o.v AS b FROM b a JOIN b o ON a.frame_idx = o.frame_idx AND abs(a.row - o.row) <= 1 AND abs(a.col - o.col) <= 1), reach(v, m) AS (SELECT v, v FROM b UNION SELECT e.b, reach.m FROM reach JOIN e ON reach.v = e.a), lab AS (SELECT v, min(m) AS component FROM reach GROUP BY 1)"


@query("k6_pixel_components", f"{K6} SELECT component // 64 AS frame_idx, component, count(*) AS n FROM lab GROUP BY 1, 2 HAVING count(*) >= 8")
def _(s, d):
    """Bright regions of each image, 8-connected, of at least 8 pixels."""
    b = A.patches(s, d).where("gray > 140").select("frame_idx", "row", "col", (c("frame_idx") * 64 + c("row") * 8 + c("col")).alias("v"))
    near = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])
    a = b.select("frame_idx", c("v").alias("a"), "row", "col", F.inline(near)).select("frame_idx", "a", (c("row") + c("di")).alias("row"), (c("col") + c("dj")).alias("col"))
    e = a.join(b.withColumnRenamed("v", "b"), ["frame_idx", "row", "col"]).select("a", "b")
    lab = components(e, b.select("v"))
    return lab.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n >= 8").select(F.floor(c("component") / 64).cast("bigint").alias("frame_idx"), "component", "n")


@query("e15_frame_attributes", "SELECT l_suppkey AS frame_idx, s_nationkey AS camera, count(*) AS n, round(avg(l_discount), 9) AS mean_angle FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def _(s, d):
    """Observations with their frame's attributes: reduced per frame first, so the join moves one row a frame."""
    o = table(s, d, "lineitem").groupBy(c("l_suppkey").alias("frame_idx")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("m"))
    f = table(s, d, "supplier").select(c("s_suppkey").alias("frame_idx"), c("s_nationkey").alias("camera"))
    return o.join(f, "frame_idx").select("frame_idx", "camera", "n", r(c("m")).alias("mean_angle"))


@query("h6_sampling_cap")
def _(s, d):
    """A seeded sample of at most 40 000 rows (a sampling operator): the least hashes, whatever the partitioning."""
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber").orderBy(F.xxhash64("l_orderkey", "l_linenumber", F.lit(11)), "l_orderkey", "l_linenumber").limit(40_000)


@query("j14_settings_echo", "SELECT p_partkey AS id, json_object('p_size', p_size, 'p_brand', p_brand)::VARCHAR AS echo FROM part")
def _(s, d):
    """Only the tunable settings of a configuration, as a document."""
    return table(s, d, "part").select(c("p_partkey").alias("id"), F.to_json(F.struct("p_size", "p_brand")).alias("echo"))


@query("k19_degradation", f"WITH {PX}, n AS (SELECT frame_idx, row, col, v, 255 * pow(v / 255, 1.4) AS g FROM px) SELECT frame_idx, round(avg(g), 6) AS mean_gamma, round(avg(CASE WHEN col < 4 THEN g * 0.6 ELSE g END), 6) AS mean_shadow FROM n GROUP BY 1")
def _(s, d):
    """Gamma and a shadow over the left half of each image."""
    g = F.pow(c("gray") / 255.0, F.lit(1.4)) * 255.0
    return A.patches(s, d).groupBy("frame_idx").agg(r(F.avg(g), 6).alias("mean_gamma"), r(F.avg(F.when(c("col") < 4, g * 0.6).otherwise(g)), 6).alias("mean_shadow"))


TRI = """t AS (SELECT p_partkey AS id, (p_partkey * 7 % 53)::DOUBLE AS x0, (p_partkey * 11 % 47)::DOUBLE AS y0, (p_partkey * 13 % 53)::DOUBLE + 3 AS x1, (p_partkey * 5 % 47)::DOUBLE + 1 AS y1, (p_partkey * 3 % 53)::DOUBLE AS x2, (p_partkey * 17 % 47)::DOUBLE + 4 AS y2, 5.0::DOUBLE + p_size AS z FROM part),
k AS (SELECT *, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS area FROM t WHERE (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) > 0),
q AS (SELECT k.*, gx.i AS px, gy.i AS py FROM k, range(60) AS gx(i), range(60) AS gy(i) WHERE gx.i BETWEEN floor(least(x0, x1, x2)) AND ceil(greatest(x0, x1, x2)) AND gy.i BETWEEN floor(least(y0, y1, y2)) AND ceil(greatest(y0, y1, y2))),
h AS (SELECT * FROM q WHERE (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0) >= 0 AND (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) >= 0 AND (x0 - x2) * (py - y2) - (y0 - y2) * (px - x2) >= 0)"""


@query("k18_rasterise", f"WITH {TRI} SELECT py AS row, px AS col, arg_min(id, (z, id)) AS triangle_id, min(z) AS depth, count(*) AS n_candidates FROM h GROUP BY 1, 2")
def _(s, d):
    """Nearest front-facing triangle per pixel: each triangle lists the pixels of its bounding box, edge functions decide."""
    k = c("p_partkey")
    f = lambda m, n: (k * m % n).cast("double")
    t = table(s, d, "part").select(k.alias("id"), f(7, 53).alias("ax"), f(11, 47).alias("ay"), (f(13, 53) + 3).alias("bx"), (f(5, 47) + 1).alias("by"), f(3, 53).alias("cx"), (f(17, 47) + 4).alias("cy"), (F.lit(5.0) + c("p_size")).alias("z"))
    edge = lambda p, q, x, y: (c(f"{q}x") - c(f"{p}x")) * (y - c(f"{p}y")) - (c(f"{q}y") - c(f"{p}y")) * (x - c(f"{p}x"))
    t = t.where(edge("a", "b", c("cx"), c("cy")) > 0)
    span = lambda a: F.sequence(F.greatest(F.floor(F.least(*[c(f"{v}{a}") for v in "abc"])), F.lit(0)).cast("bigint"), F.least(F.ceil(F.greatest(*[c(f"{v}{a}") for v in "abc"])), F.lit(59)).cast("bigint"))
    q = t.withColumn("px", F.explode(span("x"))).withColumn("py", F.explode(span("y")))
    inside = (edge("a", "b", c("px"), c("py")) >= 0) & (edge("b", "c", c("px"), c("py")) >= 0) & (edge("c", "a", c("px"), c("py")) >= 0)
    return q.where(inside).groupBy(c("py").alias("row"), c("px").alias("col")).agg(F.min_by("id", F.struct("z", "id")).alias("triangle_id"), F.min("z").alias("depth"), F.count(F.lit(1)).alias("n_candidates"))
