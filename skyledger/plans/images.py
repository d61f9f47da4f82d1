"""Queries over images, descriptors, cost volumes and splats."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions import geometry as G
from skyledger.functions import images as I
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


def pictures(s, d):
    """8x8 grey images as arrays, from the embeddings."""
    px = F.transform("embedding", lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), (e.cast("double") + 1.0) * 127.5)))
    return table(s, d, "embeddings").select(c("vec_id").alias("frame_idx"), px.alias("px"))


PX = """px AS (SELECT vec_id AS frame_idx, CAST(i // 8 AS INT) AS row, CAST(i % 8 AS INT) AS col, least(255.0, greatest(0.0, (embedding[i + 1]::DOUBLE + 1.0) * 127.5)) AS v FROM embeddings, range(64) AS t(i))"""
LAP = f"""{PX}, nb AS (SELECT p.frame_idx, p.row, p.col, p.v, CASE WHEN p.row = 0 THEN 1 ELSE p.row - 1 END AS up, CASE WHEN p.row = 7 THEN 6 ELSE p.row + 1 END AS dn, CASE WHEN p.col = 0 THEN 1 ELSE p.col - 1 END AS lf, CASE WHEN p.col = 7 THEN 6 ELSE p.col + 1 END AS rt FROM px p),
lap AS (SELECT n.frame_idx, a.v + b.v + l.v + r.v - 4 * n.v AS q FROM nb n JOIN px a ON a.frame_idx = n.frame_idx AND a.row = n.up AND a.col = n.col JOIN px b ON b.frame_idx = n.frame_idx AND b.row = n.dn AND b.col = n.col JOIN px l ON l.frame_idx = n.frame_idx AND l.row = n.row AND l.col = n.lf JOIN px r ON r.frame_idx = n.frame_idx AND r.row = n.row AND r.col = n.rt),
k1 AS (SELECT frame_idx, greatest(0, least(1, var_pop(q) / 150.0)) AS blur FROM lap GROUP BY 1),
k24 AS (SELECT frame_idx, greatest(0, least(1, 1 - 2 * (avg((floor(v) < 5)::INT) + avg((floor(v) >= 251)::INT)))) * 0.6 + count(DISTINCT floor(v)) / 256.0::DOUBLE * 0.4 AS exposure, avg((v > 3)::INT) AS coverage FROM px GROUP BY 1)"""


@query("k1_k2_k3_k4_image_quality", f"WITH {LAP} SELECT frame_idx, round(blur, 9) AS blur, round(exposure, 9) AS exposure, 1.0::DOUBLE AS compression, round(coverage, 9) AS coverage, round(greatest(0, least(1, 0.4 * blur + 0.2 * exposure + 0.2 + 0.2 * coverage)), 9) AS overall FROM k1 JOIN k24 USING (frame_idx)")
def _(s, d):
    p = pictures(s, d).select("frame_idx", *[I.measure(f, 8, 8)("px").alias(f.__name__) for f in (I.blur, I.exposure, I.compression, I.coverage)])
    q = G.quality_overall(c("blur"), c("exposure"), c("compression"), c("coverage"))
    return p.select("frame_idx", *[r(c(n)).alias(n) for n in ("blur", "exposure", "compression", "coverage")], r(q).alias("overall"))


BLK = "px AS (SELECT b AS frame_idx, CAST(i // 16 AS INT) AS row, CAST(i % 16 AS INT) AS col, least(255.0, greatest(0.0, (embedding[i % 64 + 1]::DOUBLE + 1.0) * 127.5)) AS v FROM (SELECT vec_id AS b, embedding FROM embeddings), range(256) AS t(i))"


@query("k3_blockiness", f"WITH {BLK}, g AS (SELECT a.frame_idx, a.col, abs(b.v - a.v) AS g FROM px a JOIN px b ON a.frame_idx = b.frame_idx AND a.row = b.row AND b.col = a.col + 1) SELECT frame_idx, round(greatest(0, least(1, 2 - avg(g) FILTER (WHERE col = 7) / (avg(g) + 1e-6))), 9) AS compression FROM g GROUP BY 1")
def _(s, d):
    """The same on 16x16 images (four copies of the 64 values)."""
    p = pictures(s, d).select("frame_idx", F.concat("px", "px", "px", "px").alias("px"))
    return p.select("frame_idx", r(I.measure(I.compression, 16, 16)("px")).alias("compression"))


PAIR = f"{PX}, pr AS (SELECT a.frame_idx, a.row, a.col, a.v / 255.0 AS a, b.v / 255.0 AS b FROM px a JOIN px b ON b.frame_idx = a.frame_idx + 1 AND a.row = b.row AND a.col = b.col)"


def pairs(s, d):
    p = pictures(s, d).select("frame_idx", F.transform("px", lambda v: v / 255.0).alias("a"))
    return p.join(p.select((c("frame_idx") - 1).alias("frame_idx"), c("a").alias("b")), "frame_idx")


@query("fa26_d19_psnr", f"WITH {PAIR} SELECT frame_idx, round(CASE WHEN count(*) < 16 THEN NULL WHEN avg(pow((a - b) * 255, 2)) <= 1e-12 THEN 99.0 ELSE 10 * log10(65025.0 / avg(pow((a - b) * 255, 2))) END, 6) AS psnr FROM pr GROUP BY 1")
def _(s, d):
    x = pairs(s, d)
    up = lambda n: F.transform(n, lambda v: v * 255.0)
    return x.select("frame_idx", r(I.compare(I.psnr, 8, 8)(up("a"), up("b")), 6).alias("psnr"))


BOX = f"""{PAIR}, bx AS (SELECT p.frame_idx, p.row, p.col, sum(q.a) / 121.0 AS ma, sum(q.b) / 121.0 AS mb, sum(q.a * q.a) / 121.0 AS maa, sum(q.b * q.b) / 121.0 AS mbb, sum(q.a * q.b) / 121.0 AS mab FROM pr p JOIN pr q ON p.frame_idx = q.frame_idx AND abs(p.row - q.row) <= 5 AND abs(p.col - q.col) <= 5 GROUP BY ALL),
ss AS (SELECT frame_idx, avg((2 * ma * mb + 1e-4) * (2 * (mab - ma * mb) + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (maa - ma * ma + mbb - mb * mb + 9e-4))) AS ssim FROM bx GROUP BY 1)"""


@query("k8_ssim", f"WITH {BOX} SELECT frame_idx, round(ssim, 6) AS ssim FROM ss")
def _(s, d):
    return pairs(s, d).select("frame_idx", r(I.compare(I.ssim, 8, 8)("a", "b"), 6).alias("ssim"))


@query("k9_combined_loss", f"WITH {BOX}, e AS (SELECT p.frame_idx, p.row, p.col, abs(p.a - p.b) AS l, sqrt(pow(coalesce(x.b - p.b, 0), 2) + pow(coalesce(y.b - p.b, 0), 2) + 1e-8) AS g FROM pr p LEFT JOIN pr x ON x.frame_idx = p.frame_idx AND x.row = p.row AND x.col = p.col + 1 LEFT JOIN pr y ON y.frame_idx = p.frame_idx AND y.col = p.col AND y.row = p.row + 1), m AS (SELECT frame_idx, avg(g) AS mg FROM e GROUP BY 1), l AS (SELECT frame_idx, avg(l * (1 + 2 * g / (mg + 1e-8))) AS l1 FROM e JOIN m USING (frame_idx) GROUP BY 1) SELECT frame_idx, round(l1, 6) AS l1, round(1 - ssim, 6) AS ssim_loss, round(0.8 * l1 + 0.2 * (1 - ssim), 6) AS total FROM l JOIN ss USING (frame_idx)")
def _(s, d):
    x = pairs(s, d).select("frame_idx", I.compare(I.edge_l1, 8, 8)("a", "b").alias("l1"), (F.lit(1.0) - I.compare(I.ssim, 8, 8)("a", "b")).alias("loss"))
    return x.select("frame_idx", r(c("l1"), 6).alias("l1"), r(c("loss"), 6).alias("ssim_loss"), r(c("l1") * 0.8 + c("loss") * 0.2, 6).alias("total"))


# --- overlap of consecutive frames ------------------------------------------------------------

BITS = " + ".join(f"(embedding[{i + 1}] > 0)::UBIGINT * {1 << i}::UBIGINT" for i in range(64))
OV = f"""ds AS (SELECT vec_id AS kp, (vec_id // 200)::BIGINT AS frame, {BITS} AS bits, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py FROM embeddings),
pr AS (SELECT a.frame AS i, a.kp, b.kp AS other, bit_count(xor(a.bits, b.bits))::BIGINT AS h, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) AS disp FROM ds a JOIN ds b ON b.frame = a.frame + 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY i, kp ORDER BY h, other) AS k FROM pr),
mt AS (SELECT i, kp, max(h) FILTER (WHERE k = 1) AS best, max(h) FILTER (WHERE k = 2) AS second, max(disp) FILTER (WHERE k = 1) AS disp FROM rk WHERE k <= 2 GROUP BY 1, 2),
nk AS (SELECT frame, count(*) AS n FROM ds GROUP BY 1),
ov AS (SELECT a.frame AS i, b.frame AS j, a.n AS n_i, b.n AS n_j, coalesce(m.n, 0) AS n_matches, coalesce(m.n, 0)::DOUBLE / greatest(1, least(a.n, b.n)) AS ratio, m.disp AS disp FROM nk a JOIN nk b ON b.frame = a.frame + 1 LEFT JOIN (SELECT i, count(*) AS n, quantile_cont(disp, 0.5) AS disp FROM mt WHERE best < 0.75 * second GROUP BY 1) m ON m.i = a.frame),
stt AS (SELECT *, CASE WHEN n_i < 12 OR n_j < 12 THEN 'indeterminate' WHEN ratio >= 0.85 AND disp <= 1.5 THEN 'duplicate_risk' WHEN ratio < 0.12 THEN 'gap_risk' ELSE 'ok' END AS status FROM ov)"""


def matches(s, d, ratio=0.75):
    """Each keypoint's nearest and second descriptor of the next frame, kept where the first is clearly nearer.

    Frames meet by number; a detector gives a frame a bounded number of keypoints (here 200), which
    bounds the candidates of a keypoint and makes the pairs grow with the frames, not with their square.
    """
    a = A.descriptors(s, d)
    b = a.select((c("frame") - 1).alias("frame"), c("kp").alias("other"), c("bits").alias("b2"), c("px").alias("px2"), c("py").alias("py2"))
    h = F.bit_count(c("bits").bitwiseXOR(c("b2"))).cast("bigint")
    disp = F.sqrt(F.pow(c("px") - c("px2"), 2) + F.pow(c("py") - c("py2"), 2))
    two = F.slice(F.array_sort(F.collect_list(F.struct(h.alias("h"), c("other"), disp.alias("disp")))), 1, 2)
    m = a.join(b, "frame").groupBy("frame", "kp").agg(two.alias("t")).where(F.size("t") == 2)
    return m.where(c("t")[0]["h"] < c("t")[1]["h"] * ratio).select(c("frame").alias("i"), "kp", c("t")[0]["disp"].alias("disp"))


def overlap(s, d):
    n = A.descriptors(s, d).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    p = n.select(c("frame").alias("i"), (c("frame") + 1).alias("j"), c("n").alias("n_i")).join(n.select(c("frame").alias("j"), c("n").alias("n_j")), "j")
    m = matches(s, d).groupBy("i").agg(F.count(F.lit(1)).alias("n_matches"), F.percentile("disp", F.lit(0.5)).alias("disp"))
    x = p.join(m, "i", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    x = x.withColumn("ratio", c("n_matches") / F.greatest(F.lit(1), F.least("n_i", "n_j")))
    status = F.when((c("n_i") < 12) | (c("n_j") < 12), "indeterminate").when((c("ratio") >= 0.85) & (c("disp") <= 1.5), "duplicate_risk").when(c("ratio") < 0.12, "gap_risk").otherwise("ok")
    return x.withColumn("status", status)


@query("e6_k5_frame_overlap", f"WITH {OV} SELECT i, j, n_i, n_j, n_matches, round(ratio, 9) AS match_ratio, round(disp, 9) AS median_disp, status FROM stt")
def _(s, d):
    return overlap(s, d).select("i", "j", "n_i", "n_j", "n_matches", r(c("ratio")).alias("match_ratio"), r(c("disp")).alias("median_disp"), "status")


@query("fa7_overlap_summary", f"WITH {OV} SELECT count(*) AS n_pairs, count(*) FILTER (WHERE status = 'gap_risk') AS n_gap, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'indeterminate') AS n_indeterminate, round(avg(ratio) FILTER (WHERE status <> 'indeterminate'), 9) AS mean_ratio FROM stt")
def _(s, d):
    n = lambda v: F.count(F.when(c("status") == v, 1))
    return overlap(s, d).agg(F.count(F.lit(1)).alias("n_pairs"), n("gap_risk").alias("n_gap"), n("ok").alias("n_ok"), n("indeterminate").alias("n_indeterminate"), r(F.avg(F.when(c("status") != "indeterminate", c("ratio")))).alias("mean_ratio"))


@query("h1_worst_gaps", f"WITH {OV} SELECT i, j, round(ratio, 9) AS match_ratio FROM stt WHERE status = 'gap_risk' ORDER BY ratio, i LIMIT 3")
def _(s, d):
    return overlap(s, d).where("status = 'gap_risk'").orderBy("ratio", "i").limit(3).select("i", "j", r(c("ratio")).alias("match_ratio"))


# --- cost volumes, depth, splats ----------------------------------------------------------------

CV = """cv AS (SELECT l_suppkey AS row, l_linenumber AS col, l_partkey % 16 AS di, avg(l_discount * 10 + l_tax) AS cost FROM lineitem GROUP BY 1, 2, 3),
bs AS (SELECT row, col, arg_min(di, (cost, di)) AS best, min(cost) AS min_cost FROM cv GROUP BY 1, 2),
sc AS (SELECT cv.row, cv.col, min(cost) FILTER (WHERE abs(di - best) > 1) AS second FROM cv JOIN bs USING (row, col) GROUP BY 1, 2),
dm AS (SELECT row, col, best, min_cost, second, best IN (0, 15) AS boundary, CASE WHEN min_cost < 3.9 THEN 3.0 * pow(100.0 / 3.0, best / 15.0::DOUBLE) ELSE 0.0 END AS depth, greatest(0, least(1, (coalesce(second, 4.0) - min_cost) / 0.15)) AS consistency FROM bs JOIN sc USING (row, col))"""


def depth_map(s, d):
    """The best depth hypothesis of each pixel from its costs, with the margin to the best one elsewhere.

    One aggregation: a pixel's costs (one per hypothesis, 16 at most) are folded in place.
    """
    v = table(s, d, "lineitem").groupBy(c("l_suppkey").alias("row"), c("l_linenumber").alias("col"), (c("l_partkey") % 16).alias("di")).agg(F.avg(c("l_discount") * 10.0 + c("l_tax")).alias("cost"))
    x = v.groupBy("row", "col").agg(F.array_sort(F.collect_list(F.struct("cost", "di"))).alias("k"))
    best = c("k")[0]
    x = x.withColumns({"best": best["di"], "min_cost": best["cost"]})
    second = F.array_min(F.transform(F.filter("k", lambda e: F.abs(e["di"] - c("best")) > 1), lambda e: e["cost"]))
    x = x.withColumns({"second": second, "boundary": c("best").isin(0, 15)})
    depth = F.when(c("min_cost") < 3.9, F.pow(F.lit(100.0 / 3.0), c("best") / F.lit(15.0)) * 3.0).otherwise(0.0)
    return x.select("row", "col", "best", "min_cost", "boundary", depth.alias("depth"), G.clip((F.coalesce("second", F.lit(4.0)) - c("min_cost")) / 0.15, 0, 1).alias("consistency"))


@query("h7_k7_d16_depth_selection", f"WITH {CV} SELECT row, col, best, round(min_cost, 9) AS min_cost, boundary, round(CASE WHEN boundary THEN 0.0 ELSE depth END, 6) AS depth, round(consistency, 6) AS consistency FROM dm")
def _(s, d):
    x = depth_map(s, d)
    return x.select("row", "col", "best", r(c("min_cost")).alias("min_cost"), "boundary", r(F.when(c("boundary"), 0.0).otherwise(c("depth")), 6).alias("depth"), r(c("consistency"), 6).alias("consistency"))


@query("fa16_fa17_depth_coverage", f"WITH {CV} SELECT round(avg((depth > 0)::INT), 9) AS resolved, round(avg((depth >= 100 - 0.05 * 97)::INT) FILTER (WHERE depth > 0), 9) AS near_max, round(avg((depth <= 3 + 0.05 * 97)::INT) FILTER (WHERE depth > 0), 9) AS near_min, avg((depth >= 100 - 0.05 * 97)::INT) FILTER (WHERE depth > 0) > 0.15 AS range_too_small, round(avg(boundary::INT), 9) AS boundary_fraction FROM dm")
def _(s, d):
    ok = c("depth") > 0
    frac = lambda t: F.avg(F.when(ok, t.cast("int")))
    hi = frac(c("depth") >= 100 - 0.05 * 97)
    return depth_map(s, d).agg(r(F.avg(ok.cast("int"))).alias("resolved"), r(hi).alias("near_max"), r(frac(c("depth") <= 3 + 0.05 * 97)).alias("near_min"), (hi > 0.15).alias("range_too_small"), r(F.avg(c("boundary").cast("int"))).alias("boundary_fraction"))


@query("fa9_depth_accuracy", f"WITH {CV}, t AS (SELECT depth AS e, 3.0 + (row * 7 + col) % 97 AS g FROM dm) SELECT round(sqrt(avg(pow(e - g, 2))), 6) AS rmse, round(avg(abs(e - g)), 6) AS mae, round(avg(abs(e - g)) / avg(g), 9) AS relative FROM t WHERE e > 0 AND g > 0")
def _(s, d):
    t = depth_map(s, d).select(c("depth").alias("e"), (F.lit(3.0) + (c("row") * 7 + c("col")) % 97).alias("g")).where("e > 0 and g > 0")
    err = F.abs(c("e") - c("g"))
    return t.agg(r(F.sqrt(F.avg(err * err)), 6).alias("rmse"), r(F.avg(err), 6).alias("mae"), r(F.avg(err) / F.avg("g")).alias("relative"))


SP = """o AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_extendedprice / 1000 - 50 AS x, l_quantity - 25 AS y, 20 + l_tax * 100 AS z, (l_partkey % 256)::DOUBLE AS color FROM lineitem),
p AS (SELECT id, CAST(floor(40 * x / z + 64) AS BIGINT) AS col, CAST(floor(40 * y / z + 48) AS BIGINT) AS row, z, color FROM o)"""


def projected(s, d):
    o = table(s, d, "lineitem").select((c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), (c("l_extendedprice") / 1000.0 - 50.0).alias("x"), (c("l_quantity") - 25.0).alias("y"), (F.lit(20.0) + c("l_tax") * 100.0).alias("z"), (c("l_partkey") % 256).cast("double").alias("color"))
    u, v = G.project((c("x"), c("y"), c("z")), F.lit(40.0), F.lit(40.0), F.lit(64.0), F.lit(48.0))
    return o.select("id", F.floor(u).cast("bigint").alias("col"), F.floor(v).cast("bigint").alias("row"), "z", "color")


@query("h5_z_buffer", f"WITH {SP} SELECT row, col, arg_min(color, (z, id)) AS color, min(z) AS depth, count(*) AS n FROM p GROUP BY 1, 2")
def _(s, d):
    return projected(s, d).groupBy("row", "col").agg(F.min_by("color", F.struct("z", "id")).alias("color"), F.min("z").alias("depth"), F.count(F.lit(1)).alias("n"))


@query("k11_splat_render", f"WITH {SP}, b AS (SELECT row, col, arg_min(color, (z, id)) AS color FROM p GROUP BY 1, 2) SELECT row + dy AS row, col + dx AS col, max(color) AS color FROM b, range(-2, 3) AS ty(dy), range(-2, 3) AS tx(dx) WHERE dx * dx + dy * dy <= 4 AND row + dy BETWEEN 0 AND 95 AND col + dx BETWEEN 0 AND 127 GROUP BY 1, 2")
def _(s, d):
    """Nearest colour per pixel, then dilated by a disc of radius 2."""
    b = projected(s, d).groupBy("row", "col").agg(F.min_by("color", F.struct("z", "id")).alias("color"))
    disc = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y in range(-2, 3) for x in range(-2, 3) if x * x + y * y <= 4])
    b = b.select("row", "col", "color", F.inline(disc)).select((c("row") + c("dy")).alias("row"), (c("col") + c("dx")).alias("col"), "color")
    return b.where(c("row").between(0, 95) & c("col").between(0, 127)).groupBy("row", "col").agg(F.max("color").alias("color"))


@query("k22_h8_k25_composite", "WITH o AS (SELECT l_orderkey AS px, l_tax AS a, l_quantity AS z, l_linenumber AS k FROM lineitem), w AS (SELECT *, a * exp(coalesce(sum(ln(1 - a)) OVER (PARTITION BY px ORDER BY z, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS wt FROM o) SELECT px, round(sum(wt), 9) AS alpha, round(CASE WHEN sum(wt) > 0.05 THEN sum(wt * z) / sum(wt) END, 6) AS depth FROM w GROUP BY 1")
def _(s, d):
    """Front-to-back compositing per pixel; depth is the weighted mean where alpha exceeds .05."""
    w = W.partitionBy("px").orderBy("z", "k").rowsBetween(W.unboundedPreceding, -1)
    o = table(s, d, "lineitem").select(c("l_orderkey").alias("px"), c("l_tax").alias("a"), c("l_quantity").alias("z"), c("l_linenumber").alias("k"))
    o = o.withColumn("wt", c("a") * F.exp(F.coalesce(F.sum(F.log(F.lit(1.0) - c("a"))).over(w), F.lit(0.0))))
    return o.groupBy("px").agg(r(F.sum("wt")).alias("alpha"), r(F.when(F.sum("wt") > 0.05, F.sum(c("wt") * c("z")) / F.sum("wt")), 6).alias("depth"))


@query("k12_tsdf_fusion", "WITH o AS (SELECT CAST(floor(l_extendedprice / 1000 / 2) AS BIGINT) AS vx, CAST(floor(l_quantity / 2) AS BIGINT) AS vy, greatest(-1, least(1, (l_tax * 100 - 4) / 8.0)) AS sdf, 1.0 + l_discount AS w FROM lineitem WHERE l_discount >= 0.02) SELECT vx, vy, round(sum(w * sdf) / sum(w), 9) AS tsdf, round(sum(w), 6) AS weight FROM o GROUP BY 1, 2")
def _(s, d):
    o = table(s, d, "lineitem").where("l_discount >= 0.02")
    o = o.select(F.floor(c("l_extendedprice") / 1000.0 / 2.0).cast("bigint").alias("vx"), F.floor(c("l_quantity") / 2.0).cast("bigint").alias("vy"), G.clip((c("l_tax") * 100.0 - 4.0) / 8.0, -1, 1).alias("sdf"), (F.lit(1.0) + c("l_discount")).alias("w"))
    return o.groupBy("vx", "vy").agg(r(F.sum(c("w") * c("sdf")) / F.sum("w")).alias("tsdf"), r(F.sum("w"), 6).alias("weight"))


@query("fa22_mesh_consistency", "WITH q AS (SELECT l_tax * 20 AS d FROM lineitem), m AS (SELECT avg(d) AS mean, sqrt(avg(d * d)) AS rmse, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.9) AS p90, max(d) AS worst, avg((d <= 0.4)::INT) AS within_04, avg((d <= 1.0)::INT) AS within_1 FROM q) SELECT round(mean, 9) AS mean, round(rmse, 9) AS rmse, round(p50, 9) AS p50, round(p90, 9) AS p90, round(worst, 9) AS worst, round(within_04, 9) AS within_04, round(within_1, 9) AS within_1, (mean <= 1.0)::INT + (rmse <= 1.2)::INT + (p90 <= 1.0)::INT + (within_1 >= 0.5)::INT + (within_04 >= 0.9)::INT AS n_met FROM m")
def _(s, d):
    q = table(s, d, "lineitem").select((c("l_tax") * 20.0).alias("d"))
    share = lambda t: F.avg((c("d") <= t).cast("int"))
    m = q.agg(F.avg("d").alias("mean"), F.sqrt(F.avg(c("d") * c("d"))).alias("rmse"), F.percentile("d", F.array(F.lit(0.5), F.lit(0.9))).alias("p"), F.max("d").alias("worst"), share(0.4).alias("within_04"), share(1.0).alias("within_1"))
    m = m.withColumns({"p50": c("p")[0], "p90": c("p")[1]})
    met = sum(((t).cast("int") for t in (c("mean") <= 1.0, c("rmse") <= 1.2, c("p90") <= 1.0, c("within_1") >= 0.5, c("within_04") >= 0.9)), F.lit(0))
    return m.select(*[r(c(n)).alias(n) for n in ("mean", "rmse", "p50", "p90", "worst", "within_04", "within_1")], met.alias("n_met"))
