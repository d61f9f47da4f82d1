"""Operators of the capture engine on analytic inputs and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skyledger.functions import confidence as C
from skyledger.functions import geometry as G
from skyledger.functions import images as I
from skyledger.functions.decisions import frame_decision, reconstruction_decision
from skyledger.operators import windows as T
from skyledger.operators.graph import components, face_edges, small_components
from skyledger.operators.spatial import in_boxes, k_nearest, nearest
from skyledger.operators.thresholds import frustum_verdict, valley_threshold
from skyledger.operators.voxel_fusion import fuse, score
from skyledger.sinks import text as X
from skyledger.sources.srt import frame_count_blocks, sample_blocks

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def conf(spark, n, spread, k, q, p):
    return one(spark, C.confidence(F.lit(n), F.lit(spread), F.lit(k), F.lit(q), F.lit(p)).alias("c")).c


def test_more_observations_give_more_confidence_and_single_views_are_capped(spark):
    assert conf(spark, 4, 0.15, 0.8, 0.8, 0.8) > conf(spark, 1, 0.15, 0.8, 0.8, 0.8)
    assert conf(spark, 1, 0.5, 0.99, 0.99, 0.99) <= 0.55
    assert conf(spark, 1, 0.0, 0.02, 0.1, 0.1) < 0.12 < conf(spark, 5, 0.3, 0.9, 0.9, 0.9)


def test_fusion_counts_frames_not_rows(spark):
    rows = [(0.1, 0.1, 0.1, 1, 0.0, 0.9, 0.9, 0.9), (0.2, 0.2, 0.2, 1, 0.1, 0.9, 0.9, 0.9), (0.3, 0.3, 0.3, 2, 0.2, 0.9, 0.9, 0.9), (-0.1, 0.1, 0.1, 1, 0.0, 0.9, 0.9, 0.9), (None, 0.1, 0.1, 1, 0.0, 0.9, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "x double, y double, z double, frame_idx int, view_angle double, consistency double, frame_quality double, pose_confidence double")
    got = {r.vx: r for r in score(fuse(df, 1.0)).collect()}
    assert set(got) == {0, -1}
    assert got[0].observation_count == 2 and got[0].n_raw_observations == 3 and got[0].x == pytest.approx(0.2) and got[0].view_angle_spread == pytest.approx(0.2)
    assert got[-1].single_view_capped and got[-1].confidence <= 0.55
    assert fuse(df.limit(0), 1.0).count() == 0


def test_enu_agrees_with_haversine_and_inverts(spark):
    lat, lon, la0, lo0 = (F.lit(v) for v in (55.471, 10.324, 55.470, 10.323))
    x, y = G.to_enu(lat, lon, la0, lo0)
    back = G.from_enu(x, y, la0, lo0)
    r = one(spark, x.alias("x"), y.alias("y"), G.haversine(la0, lo0, lat, lon).alias("h"), back[0].alias("la"), back[1].alias("lo"))
    assert abs(math.hypot(r.x, r.y) - r.h) / r.h < 0.01 and r.la == pytest.approx(55.471) and r.lo == pytest.approx(10.324)


def test_camera_looks_down_for_negative_pitch_and_projection_inverts(spark):
    m = G.camera_pose(F.lit(0.3), F.lit(-1.2), F.lit(0.1))
    c = (F.lit(1.0), F.lit(2.0), F.lit(50.0))
    w = G.to_world(m, (F.lit(3.0), F.lit(-2.0), F.lit(20.0)), c)
    p = G.to_camera(m, w, c)
    r = one(spark, m["22"].alias("down"), *[v.alias(f"p{i}") for i, v in enumerate(p)])
    assert r.down < 0 and (r.p0, r.p1, r.p2) == pytest.approx((3.0, -2.0, 20.0))


def test_quaternion_identity_and_thin_axis(spark):
    n = G.normal(G.quaternion_matrix(*[F.lit(float(v)) for v in (2, 0, 0, 0)]), (F.lit(1.0), F.lit(1.0), F.lit(0.02)))
    r = one(spark, *[v.alias(a) for v, a in zip(n, "xyz")], G.anisotropy((F.lit(1.0), F.lit(1.0), F.lit(0.02))).alias("an"))
    assert (r.x, r.y, r.z) == (0, 0, 1) and r.an == pytest.approx(50)


def cloud(spark, pts):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, x double, y double, z double")


@pytest.mark.parametrize("k", [1, 3])
def test_neighbours_equal_brute_force_on_uneven_density(spark, k):
    rng = np.random.default_rng(0)
    a = rng.uniform(0, 100, (150, 3))
    b = np.concatenate([rng.normal(20, 0.05, (300, 3)), rng.uniform(0, 300, (60, 3)), rng.normal(20, 0.05, (1, 3)).repeat(3, 0)])
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    got = {r.id: [h.d for h in r.hits] for r in k_nearest(cloud(spark, a), cloud(spark, b), k).collect()}
    for i in range(len(a)):
        assert got[i] == pytest.approx(np.sort(d[i])[:k].tolist())


def test_neighbours_of_self_and_of_nothing(spark):
    p = cloud(spark, [(0, 0, 0), (0, 0, 0), (5, 0, 0)])
    got = {r.id: (r.near_id, r.distance) for r in nearest(p, p, exclude_self=True).collect()}
    assert got == {0: (1, 0.0), 1: (0, 0.0), 2: (0, 5.0)}
    assert nearest(p, p.limit(0)).count() == 0 and nearest(p.limit(0), p).count() == 0
    nulls = spark.createDataFrame([(9, None, 1.0, 1.0)], p.schema)
    assert nearest(p.union(nulls), p).count() == 3


def test_boxes(spark):
    b = spark.createDataFrame([(7, -1.0, 1.0, -1.0, 12.0)], "bid long, x0 double, x1 double, y0 double, y1 double")
    got = {r.id for r in in_boxes(cloud(spark, [(0, 0, 0), (1, 12, 0), (1.1, 0, 0), (-1, -1, 5)]), b, 4.0).collect()}
    assert got == {0, 1, 3}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(500, 500), (None, 3)]
    rng = np.random.default_rng(1)
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.v: r.component for r in components(df, spark.createDataFrame([(900,)], "v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 40)) and got[500] == 500 and got[900] == 900
    lab = components(df)
    assert {r.component for r in small_components(lab, 2, 1).collect()} == {100}
    assert components(df.limit(0)).count() == 0


def test_edge_counts(spark):
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3)], "fid long, a long, b long, c long")
    got = {(r.a, r.b): r.n for r in face_edges(f).collect()}
    assert got == {(0, 1): 1, (1, 2): 2, (0, 2): 1, (1, 3): 1, (2, 3): 1}


def test_valley_and_its_fallbacks(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0.35, 0.05, 2000), rng.normal(0.85, 0.05, 8000)]).clip(0, 1)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    assert 0.5 <= valley_threshold(df, "v").first().threshold <= 0.7
    mono = rng.exponential(0.2, 20000).clip(0, 1)
    assert 0 < valley_threshold(spark.createDataFrame(pd.DataFrame({"v": mono})), "v").first().threshold < 0.5
    few = spark.createDataFrame([(0.1,), (0.2,)], "v double")
    assert valley_threshold(few, "v").first().threshold == pytest.approx(0.12)


def test_frustum_is_flagged_and_a_city_is_not(spark):
    rng = np.random.default_rng(0)
    d = rng.uniform(3, 100, 20000)
    tx, ty = np.tan(np.radians(42)), np.tan(np.radians(53.7 / 2))
    view = pd.DataFrame({"x": d * rng.uniform(-tx, tx, len(d)), "y": d * rng.uniform(-ty, ty, len(d)), "z": d})
    r = frustum_verdict(spark.createDataFrame(view), 84.0).first()
    assert r.is_frustum and r.r2 > 0.95 and abs(r.wide - 84) < 5
    city = pd.DataFrame({"x": rng.uniform(-120, 120, 20000), "y": rng.uniform(-120, 120, 20000), "z": np.where(rng.random(20000) < 0.6, rng.normal(0, 0.2, 20000), rng.uniform(0, 30, 20000))})
    assert not frustum_verdict(spark.createDataFrame(city), 84.0).first().is_frustum


def series(spark, v, t=None):
    t = np.arange(len(v), dtype=float) if t is None else t
    return spark.createDataFrame([("k", int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(t, v))], "k string, i long, t double, v double")


def test_moving_average_gradient_and_unwrap_equal_numpy(spark):
    rng = np.random.default_rng(0)
    v, t = rng.normal(size=40), np.cumsum(rng.uniform(0.5, 2, 40))
    df = series(spark, v, t)
    x = T.with_neighbours(df.withColumn("m", T.moving_average("v", "k", "i")), "k", "t", ["v", "t"], 5.0)
    x = x.select("i", "m", T.gradient("v", "t").alias("g")).orderBy("i").toPandas()
    assert np.allclose(x.m, np.convolve(np.pad(v, 2, mode="edge"), np.ones(5) / 5, mode="valid"))
    assert np.allclose(x.g, np.gradient(v, t))
    a = (np.cumsum(rng.uniform(0, 1.5, 60)) + np.pi) % (2 * np.pi) - np.pi
    u = T.unwrap(series(spark, a), "v", "k", "i", "u").orderBy("i").toPandas().u
    assert np.allclose(u, np.unwrap(a))


@pytest.mark.parametrize("block", [3.0, 600.0])
def test_interpolation_equals_numpy(spark, block):
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 100, 50))
    v = rng.normal(size=50)
    q = rng.uniform(-10, 110, 80)
    qs = spark.createDataFrame([("k", float(x)) for x in q], "k string, q double")
    got = T.interpolate_at(qs, series(spark, v, t), "k", "q", "t", ["v"], block_s=block).toPandas().set_index("q").v
    assert np.allclose(got[q], np.interp(q, t, v))


def test_segments_and_ema_and_runs(spark):
    df = spark.createDataFrame([("k", i, float(i), f) for i, f in enumerate([False, True, True, False, True, None, True])], "k string, i long, t double, f boolean")
    got = [(r.start_t, r.end_t, r.n) for r in T.true_segments(df, "k", "t", "i", "f").orderBy("start_t").collect()]
    assert got == [(1.0, 3.0, 2), (4.0, 5.0, 1), (6.0, 6.0, 1)]
    assert T.ema(series(spark, [1.0, 0.0, 1.0]), ["k"], "i", "v", 0.5).first().ema == pytest.approx(0.75)
    r = T.stable_runs(series(spark, [24, 24.5, 26, 27, 70, 70]), "k", "i", "v").orderBy("i").toPandas().run.tolist()
    assert r == [0, 0, 0, 3, 4, 4]


def test_filter_smooths_and_rejects_outliers(spark):
    rng = np.random.default_rng(0)
    t = np.arange(0, 60, 0.2)
    truth = 3 * t
    z = truth + rng.normal(0, 2.5, len(t))
    z[150] += 200
    df = spark.createDataFrame([("f", float(a), float(b), 0.0, 50.0) for a, b in zip(t, z)], "flight_id string, t double, x double, y double, z double")
    out = T.kalman(df, "flight_id", "t", ["x", "y", "z"]).orderBy("t").toPandas()
    keep = np.arange(len(t)) != 150
    assert not out.gps_used[150] and np.sqrt(((out.fx - truth)[keep] ** 2).mean()) < np.sqrt(((z - truth)[keep] ** 2).mean())


def test_filter_equals_the_matrix_form(spark):
    """Two 2x2 blocks instead of a 6x6 covariance, with accelerations, against the textbook's matrices."""
    rng = np.random.default_rng(4)
    n = 120
    t, z, a = np.cumsum(rng.uniform(0.05, 0.4, n)), rng.normal(0, 4, (n, 3)).cumsum(0), rng.normal(0, 1, (n, 3))
    z[40] += 90
    df = spark.createDataFrame([("f", float(t[i]), *map(float, z[i]), *map(float, a[i])) for i in range(n)], "k string, t double, x double, y double, z double, ax double, ay double, az double")
    got = T.kalman(df, "k", "t", ["x", "y", "z"], accel=["ax", "ay", "az"]).orderBy("t").toPandas()
    x, p, last = np.r_[z[0], 0, 0, 0], np.eye(6) * 25, t[0] - 0.1
    r = np.diag([2.5**2, 2.5**2, 25.0])
    for i in range(n):
        dt, last = t[i] - last, t[i]
        f = np.eye(6)
        f[:3, 3:] = dt * np.eye(3)
        g = np.vstack([0.5 * dt * dt * np.eye(3), dt * np.eye(3)])
        x, p = f @ x + g @ a[i], f @ p @ f.T + 0.15**2 * g @ g.T
        s, y = p[:3, :3] + r, z[i] - x[:3]
        used = y @ np.linalg.solve(s, y) <= 9
        if used:
            k = p[:, :3] @ np.linalg.inv(s)
            x, p = x + k @ y, p - k @ p[:3]
        row = got.iloc[i]
        assert row.gps_used == used and np.allclose([row.fx, row.fy, row.fz, row.fvx, row.fvy, row.fvz], x) and np.isclose(row.position_std_m, np.sqrt(np.trace(p[:3, :3]) / 3))


def test_attitude_equals_the_recursion(spark):
    rng = np.random.default_rng(5)
    t, rate = np.cumsum(rng.uniform(0.05, 0.3, 400)), rng.normal(0, 20, 400)
    df = spark.createDataFrame([("f", float(a), float(b)) for a, b in zip(t, rate)], "k string, t double, g double")
    got = T.attitude(df, "k", "t", "g", -0.7, "pitch").orderBy("t").toPandas().pitch
    a, want = -0.7, []
    for i in range(400):
        a = 0.85 * (a + np.radians(rate[i]) * (t[i] - t[i - 1] if i else 0.1)) + 0.15 * -0.7
        want.append(a)
    assert np.allclose(got, want)


def test_ema_of_long_and_short_keys(spark):
    rng = np.random.default_rng(6)
    data = {"long": rng.normal(0, 1, 1500), "short": rng.normal(0, 1, 5), "one": [3.0]}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in data.items() for i, v in enumerate(vs)] + [("long", 5000, None)], "k string, i int, v double")
    for row in T.ema(df, ["k"], "i", "v").collect():
        want = data[row.k][0]
        for v in data[row.k][1:]:
            want = 0.85 * want + 0.15 * v
        assert row.ema == pytest.approx(want, abs=1e-12) and row.n == len(data[row.k])


def test_average_ranks_equal_scipy_style_ranks(spark):
    v = [5.0, 1.0, 1.0, 7.0, 5.0, 5.0, -2.0]
    got = {r.v: r.rank for r in T.average_ranks(spark.createDataFrame([(x,) for x in v], "v double"), "v", "rank").collect()}
    assert got == {-2.0: 1.0, 1.0: 2.5, 5.0: 5.0, 7.0: 7.0}


def test_gradient_of_two_rows_at_one_time_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 0.0, 0.0), ("b", 2.0, 4.0)], "k string, t double, v double")
    got = T.with_neighbours(df, "k", "t", ["v", "t"]).select("k", T.gradient("v", "t").alias("g")).collect()
    assert [r.g for r in got if r.k == "a"] == [None, None] and [r.g for r in got if r.k == "b"] == [2.0, 2.0]


def test_a_flat_cloud_is_no_frustum(spark):
    from skyledger.operators.thresholds import frustum_verdict

    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(float(a), float(b), 5.0) for a, b in rng.uniform(0, 10, (400, 2))], "x double, y double, z double")
    assert not frustum_verdict(df).first().is_frustum
    assert not frustum_verdict(spark.createDataFrame([(1.0, 1.0, 1.0)] * 300, "x double, y double, z double")).first().is_frustum


def test_image_measures():
    flat, rng = np.full((1, 16, 16), 100.0), np.random.default_rng(0)
    noisy = rng.uniform(0, 255, (1, 16, 16))
    assert I.blur(flat)[0] == 0 and I.blur(noisy)[0] == 1 and I.coverage(flat)[0] == 1
    assert I.psnr(flat, flat)[0] == 99 and I.psnr(flat, flat + 5)[0] > I.psnr(flat, flat + 40)[0]
    assert I.ssim(noisy / 255, noisy / 255)[0] == pytest.approx(1.0)
    blocky = np.kron(rng.uniform(0, 255, (1, 2, 2)), np.ones((8, 8)))
    assert I.compression(blocky)[0] < 0.1 < I.compression(noisy)[0]


def test_decisions_never_fail(spark):
    rows = ["", None, "nope", "[1]", '{"__error__":"x"}', '```json\n{"keep_fraction": 0.9}\n```', '{"keep_fraction": "abc", "min_overall": 9, "flags": ["a", "b"]}', '{"keep_fraction": null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r for r in frame_decision(df, "t").collect()}
    assert [got[i].valid for i in range(8)] == [False] * 5 + [True] * 3
    assert all(got[i].keep_fraction == 0.75 and len(got[i].warnings) == 1 for i in range(5))
    assert got[5].keep_fraction == 0.9 and got[6].keep_fraction == 0.75 and got[6].min_overall == 0.5 and len(got[6].warnings) == 2 and got[6].flags == ["a", "b"]
    rec = spark.createDataFrame([(0, '{"action":"retry","depth_min":9,"depth_max":3,"n_depths":7.4}'), (1, "x")], "i int, t string")
    got = {r.i: r for r in reconstruction_decision(rec, "t").collect()}
    assert got[0].action == "retry" and got[0].depth_min is None and got[0].depth_max is None and got[0].n_depths == 8
    assert got[1].action == "accept" and got[1].agent_confidence == 0.0


def test_reports_and_training_decisions(spark):
    from skyledger.functions.decisions import evaluation_report, training_control

    rows = [(0, '{"verdict":"accept","diagnosis":"' + "x" * 3000 + '","suggested_next_step":5}'), (1, '{"verdict":"best"}'), (2, None), (3, '```\n{"action":"early_stop","agent_confidence":7,"reasoning":"r"}\n```'), (4, "{bad}"), (5, '{"action":null,"agent_confidence":"x"}')]
    df = spark.createDataFrame(rows, "i int, t string")
    e = {r.i: r for r in evaluation_report(df, "t").collect()}
    assert (e[0].verdict, len(e[0].diagnosis), e[0].suggested_next_step, e[0].warnings) == ("accept", 2000, "", [])
    assert (e[1].verdict, e[1].warnings) == ("needs_more_data", ["other_verdict"]) and (e[2].valid, e[2].warnings) == (False, ["no_text"]) and e[4].warnings == ["broken_object"]
    g = {r.i: r for r in training_control(df, "t").collect()}
    assert (g[3].action, g[3].agent_confidence, g[3].reasoning, len(g[3].warnings)) == ("early_stop", 1.0, "r", 1)
    assert (g[2].action, g[2].agent_confidence) == ("continue", 0.0) and (g[5].action, g[5].agent_confidence, len(g[5].warnings)) == ("continue", 0.5, 2)
    flags = spark.createDataFrame([(0, '{"flags": ["a", 2, {"x": 1}, null, [1], "' + "y" * 300 + '"]}'), (1, '{"flags": "a"}')], "i int, t string")
    f = {r.i: r.flags for r in frame_decision(flags, "t").collect()}
    assert f[0] == ["a", "2", "y" * 200] and f[1] == []


def test_sinks(spark, tmp_path):
    pts = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 0.0, 0.5, 1.0), (1, 4.0, 5.0, 6.0, 1.0, 1.0, 1.0)], "id long, x double, y double, z double, r double, g double, b double")
    X.write_lines(X.ply_lines(pts), str(tmp_path / "ply"), "line_no")
    text = "".join(p.read_text() for p in sorted((tmp_path / "ply").glob("part-*")))
    assert text.splitlines()[2] == "element vertex 2" and text.splitlines()[-2] == "1.0000 2.0000 3.0000 0 127 255"
    X.write_checkpoint(pts.drop("b"), str(tmp_path / "ck"))
    assert {r.b for r in X.read_checkpoint(spark, str(tmp_path / "ck"), {"b": 0.0}).collect()} == {0.0}
    with pytest.raises(ValueError, match="missing columns: q"):
        X.require(pts, ["x", "q"])
    f = one(spark, X.geojson_box(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0), F.struct(F.lit("ok").alias("s"))).alias("j")).j
    assert f.count("[1.0,2.0]") == 2


def test_subtitles(spark):
    t = 'x\n<font>FrameCnt: 7, DiffTime: 33ms\n[focal_len: 24.00] [latitude: 1.5] [longitude: -2.5]\n[rel_alt: 3.0 abs_alt: 9.0]</font>\r\n\r\nFrameCnt: 8 [latitude: 1.5]'
    got = frame_count_blocks(spark.createDataFrame([(1, t), (2, "none"), (3, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 7, 1.5, -2.5, 3.0, 24.0)]
    b = "1\n00:00:01,500 --> 00:00:02,000\n1.5, 2.5, 100.0m, 90.0°"
    s = sample_blocks(spark.createDataFrame([("f", 1, b), ("f", 2, b.replace("100.0", "107.5")), ("f", 3, "junk")], "flight_id string, seq long, block string")).collect()
    assert [(r.t_sec, r.height_m) for r in s] == [(1.5, 0.0), (1.5, 7.5)]


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert all(f"p{n}_found" in q for n in (1, 2, 3, 5))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_similarity_recovers_a_known_transform(spark):
    from skyledger.operators.alignment import similarity

    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 3)) * 30
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    b = 0.37 * a @ q.T + np.array([120.0, -40.0, 300.0])
    df = spark.createDataFrame([(*map(float, x), *map(float, y)) for x, y in zip(a, b)], "ax double, ay double, az double, bx double, by double, bz double")
    scale, rot, t = similarity(df, ("ax", "ay", "az"), ("bx", "by", "bz"))
    assert scale == pytest.approx(0.37, abs=1e-6) and np.allclose(rot, q, atol=1e-6) and np.allclose(t, [120, -40, 300], atol=1e-4)
    with pytest.raises(ValueError, match="three"):
        similarity(df.limit(2), ("ax", "ay", "az"), ("bx", "by", "bz"))


def test_keyframe_chain_breaks_after_a_gap(spark):
    from skyledger.operators.alignment import keyframe_chain

    q = [1, 1, 0, 0, 1, 0, 0, 0, 1, 1]
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(q)], "k string, i long, q double")
    assert [r.i for r in keyframe_chain(df, "k", "i", "q").orderBy("i").collect()] == [0, 1, 4]
