"""Time-series queries over samples, poses and frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions import geometry as G
from skyledger.operators.blocks import meet_salted, previous_row
from skyledger.operators import windows as T
from skyledger.sources import adapters as A
from skyledger.sources.srt import frame_count_blocks, sample_blocks, as_srt_text
from skyledger.tables import table

c = F.col
r = lambda x, n=9: F.round(x, n)

S = """s AS (SELECT flight_id, seq, min(t_sec) AS t_sec, min(lat) AS lat, min(lon) AS lon, min(height_m) AS height_m, min(yaw_deg) AS yaw_deg, min(pitch_deg) AS pitch_deg,
  min(roll_deg) AS roll_deg, min(focal_len_mm) AS focal_len_mm, max(is_video) AS is_video, min(format_detected) AS format_detected FROM telemetry GROUP BY ALL)"""
P = """p AS (SELECT flight_id, pose_no, min(t) AS t, min(pos_x) AS pos_x, min(pos_y) AS pos_y, min(pos_z) AS pos_z, min(vel_x) AS vel_x, min(vel_y) AS vel_y, min(yaw) AS yaw,
  min(pitch) AS pitch, min(roll) AS roll, min(position_std_m) AS position_std_m, max(gps_used) AS gps_used FROM fused_pose GROUP BY ALL)"""
FR = """f AS (SELECT flight_id, idx, min(t) AS t, min(blur) AS blur, min(exposure) AS exposure, min(compression) AS compression, min(coverage) AS coverage, min(overall) AS overall FROM frames GROUP BY ALL)"""
GOOD = "WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)"

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("a4_d18_valid_gps", f"WITH {S} SELECT format_detected, count(*) AS n, count(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)) AS n_valid FROM s GROUP BY 1")
def _(s, d):
    x = A.samples(s, d)
    return x.groupBy("format_detected").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(G.valid_gps(c("lat"), c("lon")), 1)).alias("n_valid"))


@query("a5_frame_sampling", f"WITH {FR}, n AS (SELECT flight_id, idx, row_number() OVER (PARTITION BY flight_id ORDER BY idx) - 1 AS i FROM f) SELECT flight_id, idx, CAST(i // 3 AS BIGINT) AS sample_no FROM n WHERE i % 3 = 0 AND i // 3 < 40")
def _(s, d):
    """Every third frame of a flight (a source of 30 frames a second sampled at 10), at most 40."""
    w = W.partitionBy("flight_id").orderBy("idx")
    x = A.frames(s, d).select("flight_id", "idx").withColumn("i", F.row_number().over(w) - 1)
    return x.where((c("i") % 3 == 0) & (c("i") / 3 < 40)).select("flight_id", "idx", F.floor(c("i") / 3).cast("bigint").alias("sample_no"))


@query("c11_c12_enu", f"WITH {S}, o AS (SELECT flight_id, arg_min(lat, seq) AS lat0, arg_min(lon, seq) AS lon0 FROM s {GOOD} GROUP BY 1), e AS (SELECT s.flight_id, seq, lat, lon, lat0, lon0, (lon - lon0) * 110540.0::DOUBLE * cos(radians(lat0)) AS x, (lat - lat0) * 110540.0::DOUBLE AS y FROM s JOIN o USING (flight_id) {GOOD}) SELECT flight_id, seq, round(x, 6) AS x, round(y, 6) AS y, round(lat0 + y / 110540.0::DOUBLE, 9) AS lat_back, round(lon0 + x / (110540.0::DOUBLE * cos(radians(lat0))), 9) AS lon_back FROM e")
def _(s, d):
    x = A.samples(s, d).where(G.valid_gps(c("lat"), c("lon"))).select("flight_id", "seq", "lat", "lon")
    o = x.groupBy("flight_id").agg(F.min_by("lat", "seq").alias("lat0"), F.min_by("lon", "seq").alias("lon0"))
    e, n = G.to_enu(c("lat"), c("lon"), c("lat0"), c("lon0"))
    x = x.join(o, "flight_id").withColumns({"x": e, "y": n})
    la, lo = G.from_enu(c("x"), c("y"), c("lat0"), c("lon0"))
    return x.select("flight_id", "seq", r(c("x"), 6).alias("x"), r(c("y"), 6).alias("y"), r(la).alias("lat_back"), r(lo).alias("lon_back"))


@query("c13_fa24_haversine_path", f"WITH {S}, g AS (SELECT flight_id, seq, lat, lon, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM s {GOOD} WINDOW w AS (PARTITION BY flight_id ORDER BY seq)), h AS (SELECT flight_id, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))) AS m FROM g) SELECT flight_id, count(*) AS n, round(coalesce(sum(m), 0), 3) AS path_m FROM h GROUP BY 1")
def _(s, d):
    x = A.samples(s, d).where(G.valid_gps(c("lat"), c("lon"))).select("flight_id", "seq", "lat", "lon")
    x = previous_row(x, "flight_id", ["seq"], F.floor(c("seq") / 8192), ["lat", "lon"])
    x = x.withColumn("m", G.haversine(c("prev_lat"), c("prev_lon"), c("lat"), c("lon")))
    return x.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n"), r(F.coalesce(F.sum("m"), F.lit(0.0)), 3).alias("path_m"))


@query("c23_pose_confidence", f"WITH {P}, m AS (SELECT flight_id, quantile_cont(position_std_m, 0.5) AS med FROM p GROUP BY 1) SELECT flight_id, pose_no, round(greatest(0.0, least(1.0, 1.0 - position_std_m / 4.0)), 9) AS by_std, round(greatest(0.0, least(1.0, 1.0 - position_std_m / 3.0)), 9) AS by_residual, round(greatest(0.05, least(1.0, 1.0 - position_std_m / (3.0 * greatest(med, 0.5)))), 9) AS by_median FROM p JOIN m USING (flight_id)")
def _(s, d):
    x = A.poses(s, d).select("flight_id", "pose_no", "position_std_m")
    m = x.groupBy("flight_id").agg(F.percentile("position_std_m", F.lit(0.5)).alias("med"))
    v = c("position_std_m")
    return x.join(m, "flight_id").select("flight_id", "pose_no", r(G.pose_confidence_std(v)).alias("by_std"), r(G.pose_confidence_residual(v)).alias("by_residual"), r(G.pose_confidence_relative(v, c("med"))).alias("by_median"))


@query("c33_quality_overall", f"WITH {FR} SELECT flight_id, idx, round(greatest(0.0, least(1.0, 0.40 * blur + 0.20 * exposure + 0.20 * compression + 0.20 * coverage)), 9) AS overall FROM f")
def _(s, d):
    return A.frames(s, d).select("flight_id", "idx", r(G.quality_overall(c("blur"), c("exposure"), c("compression"), c("coverage"))).alias("overall"))


@query("d1_i2_select_frames", f"WITH {FR}, n AS (SELECT *, count(*) OVER (PARTITION BY flight_id) AS n FROM f WHERE overall >= 0.15), k AS (SELECT flight_id, idx, overall, n, row_number() OVER (PARTITION BY flight_id ORDER BY overall DESC, idx) AS rk FROM n WHERE overall >= 0.15) SELECT f.flight_id, f.idx, coalesce(k.rk <= greatest(3, round_even(k.n * 0.7::DOUBLE, 0)), false) AS kept FROM f LEFT JOIN k USING (flight_id, idx)")
def _(s, d):
    """The best 70 % (at least 3) of those frames of a flight that reach the floor; all others are rejected."""
    x = A.frames(s, d).select("flight_id", "idx", "overall")
    ok = c("overall") >= 0.15
    x = x.withColumn("n", F.count(F.when(ok, 1)).over(W.partitionBy("flight_id")))
    rank = F.row_number().over(W.partitionBy("flight_id", ok).orderBy(c("overall").desc(), "idx"))
    return x.select("flight_id", "idx", F.coalesce(ok & (rank <= F.greatest(F.lit(3.0), F.bround(c("n") * 0.7))), F.lit(False)).alias("kept"))


@query("e11_e14_neighbours", f"WITH {FR} SELECT flight_id, idx, lead(idx) OVER w AS next_idx, coalesce(lead(idx, 2) OVER w, lead(idx, 1) OVER w) AS partner_idx FROM f WHERE overall >= 0.5 WINDOW w AS (PARTITION BY flight_id ORDER BY idx)")
def _(s, d):
    w = W.partitionBy("flight_id").orderBy("idx")
    x = A.frames(s, d).where("overall >= 0.5")
    return x.select("flight_id", "idx", F.lead("idx").over(w).alias("next_idx"), F.coalesce(F.lead("idx", 2).over(w), F.lead("idx", 1).over(w)).alias("partner_idx"))


@query("e13_band_join", f"WITH {FR}, k AS (SELECT flight_id, idx, row_number() OVER (PARTITION BY flight_id ORDER BY idx) AS i FROM f WHERE overall >= 0.5) SELECT a.flight_id, a.idx, b.idx AS neighbour FROM k a JOIN k b ON a.flight_id = b.flight_id AND b.i BETWEEN a.i - 2 AND a.i + 2 AND a.i <> b.i")
def _(s, d):
    """Neighbours within two ranks: each row lists the ranks around it and meets them by equality."""
    x = A.frames(s, d).where("overall >= 0.5").select("flight_id", "idx", F.row_number().over(W.partitionBy("flight_id").orderBy("idx")).alias("i"))
    b = x.select("flight_id", c("idx").alias("neighbour"), c("i").alias("j"))
    a = x.withColumn("j", F.explode(F.array(*[c("i") + o for o in (-2, -1, 1, 2)])))
    return a.join(b, ["flight_id", "j"]).select("flight_id", "idx", "neighbour")


@query("e9_g5_asof_interpolation", f"WITH {S}, {FR}, t AS (SELECT flight_id, t_sec AS t0, min(height_m) AS h, min(pitch_deg) AS pit, min(roll_deg) AS rol FROM s WHERE t_sec IS NOT NULL AND height_m IS NOT NULL AND NOT isnan(height_m) GROUP BY ALL), n AS (SELECT *, lead(t0) OVER w AS t1, lead(h) OVER w AS h1, lead(pit) OVER w AS pit1 FROM t WINDOW w AS (PARTITION BY flight_id ORDER BY t0)), e AS (SELECT flight_id, min(t0) AS lo, max(t0) AS hi FROM t GROUP BY 1), q AS (SELECT f.flight_id, idx, least(greatest(t, lo), hi) AS tq FROM f JOIN e USING (flight_id) WHERE t IS NOT NULL), j AS (SELECT q.flight_id, idx, h, coalesce(h1, h) AS h1, radians(pit) AS a0, radians(coalesce(pit1, pit)) AS a1, CASE WHEN t1 IS NULL THEN 0.0 ELSE (tq - t0) / (t1 - t0) END AS a FROM q ASOF JOIN n ON q.flight_id = n.flight_id AND q.tq >= n.t0) SELECT flight_id, idx, round(h + (h1 - h) * a, 6) AS height_m, round(degrees(atan2(sin(a0) + (sin(a1) - sin(a0)) * a, cos(a0) + (cos(a1) - cos(a0)) * a)), 6) AS pitch_deg FROM j")
def _(s, d):
    tel = A.samples(s, d).where("height_m is not null and not isnan(height_m)")
    x = T.interpolate_at(A.frames(s, d).select("flight_id", "idx", "t"), tel, "flight_id", "t", "t_sec", ["height_m"], ["pitch_deg"])
    return x.select("flight_id", "idx", r(c("height_m"), 6).alias("height_m"), r(c("pitch_deg"), 6).alias("pitch_deg"))


SEG = "i AS (SELECT *, coalesce(is_video, false) AS v, lead(t_sec) OVER w AS nt, CASE WHEN coalesce(is_video, false) AND NOT coalesce(lag(coalesce(is_video, false)) OVER w, false) THEN 1 ELSE 0 END AS st FROM s WHERE t_sec IS NOT NULL WINDOW w AS (PARTITION BY flight_id ORDER BY seq)), k AS (SELECT *, sum(st) OVER (PARTITION BY flight_id ORDER BY seq) AS seg FROM i), seg AS (SELECT flight_id, CAST(seg AS BIGINT) AS segment_no, min(t_sec) AS start_t, coalesce(arg_max_null(nt, seq), max(t_sec)) AS end_t, count(*) AS n FROM k WHERE v GROUP BY 1, 2)"


@query("g8_video_segments", f"WITH {S}, {SEG} SELECT * FROM seg")
def _(s, d):
    return T.true_segments(A.samples(s, d).where("t_sec is not null"), "flight_id", "t_sec", "seq", "is_video")


@query("e10_video_offset", f"WITH {S}, {SEG} SELECT flight_id, arg_min(start_t, (abs(end_t - start_t - 20.0), segment_no)) AS offset_t FROM seg GROUP BY 1")
def _(s, d):
    x = T.true_segments(A.samples(s, d).where("t_sec is not null"), "flight_id", "t_sec", "seq", "is_video")
    return x.groupBy("flight_id").agg(F.min_by("start_t", F.struct(F.abs(c("end_t") - c("start_t") - 20.0), "segment_no")).alias("offset_t"))


@query("g1_moving_average", f"WITH {P} SELECT flight_id, pose_no, round(CASE WHEN count(*) OVER (PARTITION BY flight_id) < 5 THEN pos_x ELSE (pos_x + coalesce(lag(pos_x, 1) OVER w, first_value(pos_x) OVER a) + coalesce(lag(pos_x, 2) OVER w, first_value(pos_x) OVER a) + coalesce(lead(pos_x, 1) OVER w, last_value(pos_x) OVER a) + coalesce(lead(pos_x, 2) OVER w, last_value(pos_x) OVER a)) / 5.0 END, 6) AS x FROM p WINDOW w AS (PARTITION BY flight_id ORDER BY pose_no), a AS (PARTITION BY flight_id ORDER BY pose_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(s, d):
    return A.poses(s, d).select("flight_id", "pose_no", r(T.moving_average("pos_x", "flight_id", "pose_no"), 6).alias("x"))


G3 = "g AS (SELECT flight_id, pose_no, t, pos_x AS v, pos_y AS y, lag(pos_x) OVER w AS vp, lead(pos_x) OVER w AS vn, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd FROM p WHERE t IS NOT NULL WINDOW w AS (PARTITION BY flight_id ORDER BY t))"


@query("g2_g3_g10_gradient", f"WITH {P}, {G3} SELECT flight_id, pose_no, round(hs, 9) AS dt, round(CASE WHEN hs IS NULL AND hd IS NULL THEN NULL WHEN hs IS NULL THEN (vn - v) / hd WHEN hd IS NULL THEN (v - vp) / hs ELSE (hs * hs * vn + (hd * hd - hs * hs) * v - hd * hd * vp) / (hs * hd * (hd + hs)) END, 6) AS vel_x, 5.0::DOUBLE AS position_std_m FROM g")
def _(s, d):
    x = T.with_neighbours(A.poses(s, d).where("t is not null").select("flight_id", "pose_no", "t", "pos_x"), "flight_id", "t", ["t", "pos_x"])
    return x.select("flight_id", "pose_no", r(c("t") - c("prev_t")).alias("dt"), r(T.gradient("pos_x", "t"), 6).alias("vel_x"), F.lit(5.0).alias("position_std_m"))


@query("g4_bearing", f"WITH {P}, b AS (SELECT flight_id, pose_no, degrees(atan2(lead(pos_x) OVER w - pos_x, lead(pos_y) OVER w - pos_y)) AS a, degrees(atan2(pos_x - lag(pos_x) OVER w, pos_y - lag(pos_y) OVER w)) AS b FROM p WINDOW w AS (PARTITION BY flight_id ORDER BY pose_no)) SELECT flight_id, pose_no, round(coalesce(a, b), 6) AS bearing_deg FROM b")
def _(s, d):
    x = T.with_neighbours(A.poses(s, d).select("flight_id", "pose_no", "pos_x", "pos_y"), "flight_id", "pose_no", ["pos_x", "pos_y"])
    return x.select("flight_id", "pose_no", r(T.bearing("pos_x", "pos_y"), 6).alias("bearing_deg"))


@query("g6_unwrap", f"WITH {P}, u AS (SELECT flight_id, pose_no, yaw, coalesce(round((yaw - lag(yaw) OVER w) / (2 * pi())), 0) AS k FROM p WINDOW w AS (PARTITION BY flight_id ORDER BY pose_no)) SELECT flight_id, pose_no, round(yaw - sum(k) OVER (PARTITION BY flight_id ORDER BY pose_no) * 2 * pi(), 6) AS yaw FROM u")
def _(s, d):
    x = T.unwrap(A.poses(s, d).select("flight_id", "pose_no", c("yaw").alias("y")), "y", "flight_id", "pose_no", "yaw")
    return x.select("flight_id", "pose_no", r(c("yaw"), 6).alias("yaw"))


@query("g7_cumulative_drift", f"WITH {P} SELECT flight_id, pose_no, round(sum(position_std_m - 1.0) OVER (PARTITION BY flight_id ORDER BY pose_no ROWS UNBOUNDED PRECEDING), 6) AS drift FROM p")
def _(s, d):
    x = T.running_sum(A.poses(s, d).select("flight_id", "pose_no", "position_std_m"), "flight_id", "pose_no", c("position_std_m") - 1.0, "drift")
    return x.select("flight_id", "pose_no", r(c("drift"), 6).alias("drift"))


@query("g9_kalman")
def _(s, d):
    x = A.poses(s, d).select("flight_id", "t", "pos_x", "pos_y", "pos_z")
    return T.kalman(x, "flight_id", "t", ["pos_x", "pos_y", "pos_z"])


@query("d9_h9_stable_focal", None)
def _(s, d):
    """Longest run of each flight whose focal length stays within a tenth of its first; the first of equal ones.

    A flight that lacks a focal length anywhere is left as it is: one run of all its samples.
    """
    v = A.samples(s, d).select("flight_id", "seq", "focal_len_mm")
    lacks = v.groupBy("flight_id").agg(F.max(c("focal_len_mm").isNull()).alias("lacks"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"))
    whole = lacks.where("lacks").select("flight_id", "first_seq", "last_seq", "n")
    x = T.stable_runs(meet_salted(v, lacks.where("not lacks").select("flight_id"), ["flight_id"], c("seq")), "flight_id", "seq", "focal_len_mm")
    n = x.groupBy("flight_id", "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"))
    best = n.groupBy("flight_id").agg(F.max_by(F.struct("first_seq", "last_seq", "n"), F.struct("n", -c("first_seq"))).alias("b"))
    return best.select("flight_id", "b.*").unionByName(whole)


@query("c14_zoomed_intrinsics", f"WITH {S}, z AS (SELECT flight_id, seq, focal_len_mm, first_value(focal_len_mm) OVER (PARTITION BY flight_id ORDER BY seq) AS f0 FROM s WHERE focal_len_mm IS NOT NULL) SELECT flight_id, seq, round(CASE WHEN f0 > 1e-6 THEN 355.5 * focal_len_mm / f0 ELSE 355.5 END, 9) AS fx FROM z")
def _(s, d):
    w = W.partitionBy("flight_id").orderBy("seq")
    x = A.samples(s, d).where("focal_len_mm is not null")
    return x.select("flight_id", "seq", r(G.zoomed_focal(F.lit(355.5), c("focal_len_mm"), F.first("focal_len_mm").over(w))).alias("fx"))


@query("fa27_frame_context", f"WITH {FR} SELECT flight_id, count(*) AS n_frames, round(avg(overall), 9) AS mean_overall, min(overall) AS min_overall, round(quantile_cont(overall, 0.1), 9) AS p10_overall, round(avg(blur), 9) AS mean_blur, round(avg(CASE WHEN overall < 0.15 THEN 1.0 ELSE 0.0 END), 9) AS fraction_below FROM f WHERE overall IS NOT NULL GROUP BY 1")
def _(s, d):
    x = A.frames(s, d).where("overall is not null")
    return x.groupBy("flight_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        r(F.avg("overall")).alias("mean_overall"),
        F.min("overall").alias("min_overall"),
        r(F.percentile("overall", F.lit(0.1))).alias("p10_overall"),
        r(F.avg("blur")).alias("mean_blur"),
        r(F.avg(F.when(c("overall") < 0.15, 1.0).otherwise(0.0))).alias("fraction_below"),
    )


@query("fa23_residuals", f"WITH {P} SELECT flight_id, round(avg(position_std_m), 9) AS mean_m, round(quantile_cont(position_std_m, 0.5), 9) AS median_m, max(position_std_m) AS max_m, arg_max(pose_no, (position_std_m, -pose_no)) AS worst_pose FROM p GROUP BY 1")
def _(s, d):
    v = "position_std_m"
    return A.poses(s, d).groupBy("flight_id").agg(r(F.avg(v)).alias("mean_m"), r(F.percentile(v, F.lit(0.5))).alias("median_m"), F.max(v).alias("max_m"), F.max_by("pose_no", F.struct(v, -c("pose_no"))).alias("worst_pose"))


@query("fa34_gating_rmse", f"WITH {P} SELECT flight_id, count(*) FILTER (WHERE gps_used = false) AS n_gated, round(sqrt(avg(position_std_m * position_std_m)), 9) AS rmse_all, round(sqrt(avg(position_std_m * position_std_m) FILTER (WHERE gps_used)), 9) AS rmse_used FROM p GROUP BY 1")
def _(s, d):
    sq = c("position_std_m") * c("position_std_m")
    return A.poses(s, d).groupBy("flight_id").agg(F.count(F.when(~c("gps_used"), 1)).alias("n_gated"), r(F.sqrt(F.avg(sq))).alias("rmse_all"), r(F.sqrt(F.avg(F.when(c("gps_used"), sq)))).alias("rmse_used"))


@query("g16_even_pick", f"WITH {FR}, n AS (SELECT flight_id, idx, row_number() OVER (PARTITION BY flight_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY flight_id) AS n FROM f), k AS (SELECT DISTINCT flight_id, n, CAST(round_even(j * (n - 1)::DOUBLE / 4.0, 0) AS BIGINT) AS i FROM n, range(5) AS r(j)) SELECT n.flight_id, n.idx FROM n JOIN k USING (flight_id, i)")
def _(s, d):
    """Five frames spread evenly over each flight."""
    w = W.partitionBy("flight_id")
    x = A.frames(s, d).select("flight_id", "idx", (F.row_number().over(w.orderBy("idx")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    picks = F.array(*[F.bround(F.lit(float(j)) * (c("n") - 1).cast("double") / 4.0).cast("int") for j in range(5)])
    return x.where(F.array_contains(picks, c("i"))).select("flight_id", "idx")


@query("g17_i4_holdout", f"WITH {FR} SELECT flight_id, idx, (row_number() OVER (PARTITION BY flight_id ORDER BY idx) - 1) % 7 = 0 AS held_out FROM f")
def _(s, d):
    """Every seventh camera (a fraction of .15) is held out, the first one included."""
    return A.frames(s, d).select("flight_id", "idx", ((F.row_number().over(W.partitionBy("flight_id").orderBy("idx")) - 1) % 7 == 0).alias("held_out"))


@query("a10_sparse_thinning")
def _(s, d):
    """A seeded 30 % of each flight's frames, at least two, in order."""
    w = W.partitionBy("flight_id")
    x = A.frames(s, d).select("flight_id", "idx")
    x = x.withColumns({"n": F.count(F.lit(1)).over(w), "k": F.row_number().over(w.orderBy(F.xxhash64("flight_id", "idx", F.lit(7)), "idx"))})
    return x.where(c("k") <= F.greatest(F.lit(2.0), F.bround(c("n") * 0.3))).select("flight_id", "idx")


QUERIES["a2_srt_reader"] = lambda s, d: sample_blocks(as_srt_text(A.samples(s, d)))


@query("a3_frame_count_reader", r"""WITH b AS (SELECT doc_id, unnest(string_split_regex(replace(text, chr(13), ''), '\n\s*\n')) AS blk FROM (SELECT doc_id, min(text) AS text FROM documents WHERE lower(trim(source)) = 'srt_block' AND text LIKE '%FrameCnt:%' GROUP BY 1)),
p AS (SELECT doc_id, regexp_extract(blk, 'FrameCnt:\s*(\d+)', 1) AS n, regexp_extract(blk, '\[latitude:\s*(-?[0-9.]+)\]', 1) AS la, regexp_extract(blk, '\[longitude:\s*(-?[0-9.]+)\]', 1) AS lo, regexp_extract(blk, 'rel_alt:\s*(-?[0-9.]+)', 1) AS al, regexp_extract(blk, '\[focal_len:\s*([0-9.]+)\]', 1) AS fo FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS frame_cnt, CAST(la AS DOUBLE) AS lat, CAST(lo AS DOUBLE) AS lon, CAST(al AS DOUBLE) AS rel_alt, CAST(fo AS DOUBLE) AS focal_len_mm FROM p WHERE n <> '' AND la <> '' AND lo <> '' AND al <> '' AND fo <> ''""")
def _(s, d):
    docs = table(s, d, "documents").where(F.lower(F.trim("source")) == "srt_block").groupBy("doc_id").agg(F.min("text").alias("text"))
    return frame_count_blocks(docs)
