"""The operators of problems 1, 2, 3 and 5 against brute force and on edge cases."""

import json
import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from skyledger.operators.blocks import previous_row, with_halo
from skyledger.operators.regular_grid import GridParams, regular_grid, telemetry_grid, unobserved_cells
from skyledger.operators.rejects import loaded_lines, rejected_lines
from skyledger.operators.schema_drift import consistent_records, migration_steps, schema_changes, schema_registry
from skyledger.operators.spikes import SpikeParams, StretchParams, TELEMETRY_MEASURES, implausible_readings, implausible_telemetry, long_false_stretches

TEL = "flight_id string, seq long, t_sec double, lat double, lon double, height_m double, format_detected string, extra string"


def flight(fid, n, seed, noise=0.3, step=0.1):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.uniform(0.9, 1.1, n) * step).round(3)
    lat = 40 + (50 * np.sin(t / 20) + rng.normal(0, noise, n)) / 110540
    lon = 10 + (50 * np.cos(t / 20) + rng.normal(0, noise, n)) / 111320
    h = 50 + 5 * np.sin(t / 10) + rng.normal(0, 0.2, n)
    return [[fid, i, float(t[i]), float(round(lat[i], 7)), float(round(lon[i], 7)), float(round(h[i], 2)), "A", "x"] for i in range(n)]


def found(df):
    got = [tuple(r) for r in df.select("flight_id", "rec_no", "field_name").collect()]
    assert len(got) == len(set(got))
    return set(got)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, TEL)
    return found(implausible_readings(df, "flight_id", "seq", "t_sec", TELEMETRY_MEASURES, null_pair=("lat", "lon"), params=SpikeParams(**kw)))


@pytest.mark.parametrize("block", [100_000, 256])
def test_spikes_frozen_runs_and_impossible_values(spark, block):
    rows = flight("a", 1200, 1) + flight("b", 300, 2, noise=1.5)
    want = set()

    def hit(i, field, k):
        want.add((rows[i][0], rows[i][1], field))
        rows[i][3 + ["lat", "lon", "height_m"].index(field)] = k

    hit(100, "lat", rows[100][3] + 20 / 110540)  # one reading
    for i in (300, 301, 302):  # an excursion of three
        hit(i, "lon", rows[i][4] - 30 / 111320)
    for i in range(1000, 1006):  # feet taken for metres
        hit(i, "height_m", round(rows[i][5] * 3.28, 2))
    for i in range(601, 630):  # frozen
        hit(i, "height_m", rows[600][5])
    hit(800, "lat", 0.0)
    hit(800, "lon", 0.0)
    hit(900, "lat", 91.0)
    hit(1250, "height_m", -9999.0)
    for i in (50, 51):
        rows[i][3] = None
    rows[52][5] = math.nan
    rows[400][2] = None
    got = run(spark, rows + [list(r) for r in rows[::7]] + [[None, 1, 0.0, 1.0, 1.0, 1.0, "A", ""], ["a", None, 0.0, 1.0, 1.0, 1.0, "A", ""]], block_rows=block, halo_rows=64)
    assert got == want


@pytest.mark.parametrize("block, length", [(100_000, 7), (100_000, 200), (512, 20), (128, 1400)])
def test_excursions_of_any_length(spark, block, length):
    """An excursion ends where the series returns, however many readings and blocks lie between."""
    rows = flight("a", 3000, 6) + flight("b", 500, 7)
    want = set()
    for i in range(900, 900 + length):
        if i % 50 == 7:
            rows[i][3] = None
        else:
            rows[i][3] += 500 / 110540
            want.add(("a", i, "lat"))
    assert run(spark, rows, block_rows=block, halo_rows=64) == want


def test_jumps_that_are_no_excursion(spark):
    """A lasting change of place, a change across a gap and back, and two ends of frozen runs enclose nothing."""
    a, b, f = flight("a", 900, 8), flight("b", 900, 9), flight("f", 900, 10)
    for r in a[400:]:
        r[3] += 300 / 110540
    for r in b[300:600]:
        r[2] += 400
        r[3] += 300 / 110540
    for r in b[600:]:
        r[2] += 900
    want = set()
    for at in (200, 500):
        for i in range(at, at + 40):
            want.add(("f", i, "lat"))
            f[i][3] = f[at - 1][3]
    assert run(spark, a + b + f) == want


def test_each_hour_is_judged_by_its_own_noise(spark):
    """A spike of a calm hour is one, though the same step is nothing in the rough hour of the same block."""
    calm, rough = flight("a", 3000, 11, noise=0.2, step=1.0), flight("a", 3000, 12, noise=6.0, step=1.0)
    for i, r in enumerate(rough):
        r[1], r[2] = 3600 + i, r[2] + 3700
    calm[1500][3] += 12 / 110540
    assert ("a", 1500, "lat") in run(spark, calm + rough, hour_rows=500)


def test_moves_across_gaps_rounding_and_standing_are_no_cases(spark):
    a, b = flight("a", 400, 3), flight("a", 400, 4)
    for i, r in enumerate(b):
        r[1], r[2], r[3] = 400 + i, r[2] + 500, r[3] + 0.01  # another place after a gap
    for r in a + b:
        r[3], r[4] = round(r[3], 5), round(r[4], 5)  # about a metre
    for r in a[:80]:
        r[5] = 0.0
    assert run(spark, a + b) == set()


def test_empty_constant_and_tiny_sources(spark):
    assert run(spark, []) == set()
    assert run(spark, [["a", 0, 0.0, 1.0, 1.0, None, "A", ""]]) == set()
    assert run(spark, [["a", i, None, None, None, None, "A", ""] for i in range(20)]) == set()


@pytest.mark.parametrize("block", [4096, 64])
def test_long_false_stretches(spark, block):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    flags = [bool(x) for x in rng.random(1000) > 0.06]
    for i in range(500, 560):
        flags[i] = False
    flags[498] = flags[499] = flags[560] = flags[561] = True
    flags[520] = True
    rows = [("f", i, v) for i, v in enumerate(flags)] + [("f", 3000, None), (None, 1, False), ("f", None, False)]
    df = spark.createDataFrame(rows + rows[:50], "flight_id string, pose_no long, gps_used boolean").withColumn("t", F.lit(None).cast("double"))
    got = {r.rec_no for r in long_false_stretches(df, "flight_id", "pose_no", "gps_used", StretchParams(block_rows=block)).collect()}
    assert got == {i for i in range(500, 560) if i != 520}
    assert long_false_stretches(df.limit(0), "flight_id", "pose_no", "gps_used").count() == 0
    tel = spark.createDataFrame([], TEL)
    assert {r.field_name for r in implausible_telemetry(tel, df).collect()} == {"gps_used"}


def brute_grid(rows, g):
    want = set()
    by = defaultdict(list)
    for f, _, t, lat, lon, h, *_ in rows:
        if t is not None and not math.isnan(t):
            by[f].append((t, {"lat": lat, "lon": lon, "height_m": h}))
    for f, s in by.items():
        s.sort(key=lambda x: x[0])
        runs = [[s[0]]]
        for x in s[1:]:
            runs.append([x]) if x[0] - runs[-1][-1][0] > 900 else runs[-1].append(x)
        for run_ in runs:
            for k in range(math.floor(run_[0][0] / g), math.floor(run_[-1][0] / g) + 1):
                for n in ("lat", "lon", "height_m"):
                    if not any(math.floor(t / g) == k and v[n] is not None and not math.isnan(v[n]) for t, v in s):
                        want.add((f, k, n))
    return want


@pytest.mark.parametrize("block", [7200.0, 2500.0])
def test_grid_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for f in ("a", "b"):
        t = np.cumsum(rng.choice([0.3, 1.0, 7.0, 80.0, 880.0, 905.0, 2000.0], 250, p=[0.4, 0.3, 0.15, 0.09, 0.02, 0.02, 0.02]))
        rows += [(f, i, float(x), None if rng.random() < 0.3 else 1.0, 2.0, math.nan if rng.random() < 0.2 else 3.0, "A", "") for i, x in enumerate(t)]
    rows += rows[:40] + [("a", 9999, None, 1.0, 1.0, 1.0, "A", ""), (None, 1, 5.0, 1.0, 1.0, 1.0, "A", ""), ("z", 0, 4.0, None, 1.0, 1.0, "A", "")]
    df = spark.createDataFrame(rows, TEL)
    fmt = spark.createDataFrame([("A", 1.0), ("B", 2.0), (None, 3.0)], "format_detected string, grid_s double")
    g = telemetry_grid(df, fmt, GridParams(block_s=block))
    got = {(r.flight_id, r.cell_no, r.field_name) for r in g.where("status <> 'observed'").collect()}
    assert got == brute_grid([r for r in rows if r[0]], 1.0)
    assert g.count() == g.select("flight_id", "cell_no", "field_name").distinct().count()
    assert g.where("status = 'gap' and value is not null").count() == 0 and g.where("status <> 'gap' and value is null").count() == 0
    assert unobserved_cells(df.limit(0), fmt).count() == 0


def test_grid_values(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 0.0, 10.0), ("a", 4.0, 18.0), ("a", 5.0, None), ("a", 40.0, 1.0)], "k string, t double, v double")
    got = {r.cell_no: (r.status, r.value) for r in regular_grid(df, "k", "t", F.lit(1.0), ["v"]).collect()}
    assert got[0] == ("observed", 10.0) and got[2] == ("interpolated", 14.0) and got[5][0] == "gap" and got[20] == ("gap", None) and len(got) == 41


HEAD = "CUSTOM.updateTime,GIMBAL.yaw,GIMBAL.pitch,GIMBAL.roll,OSD.height [m],CUSTOM.isVideo,OSD.latitude,OSD.longitude"


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_rejected_lines(spark, monkeypatch, broadcast):
    monkeypatch.setattr("skyledger.operators.rejects.BROADCAST_FILES", broadcast)
    good = ["2025/01/22 08:37:13.009,1,2,3,4,False,35.27,41.7", '"2025/01/22 08:37:13","1","2","3","4","","+3.5e1"," 41.7 "', "2025/01/22 08:37:13,1,2,3,4, True ,-.5,41\r", "2025/\x0001/22 08:37:13,,,,,1,90.0,"]
    bad = {
        '2025/01/22 08:37:13,1,2,3,4,0,35"1,41': "quoting",
        '2025/01/22 08:37:13,1,2,3,"4,0,35.1,41': "quoting",
        '"2025/01/22" 08:37:13,1,2,3,4,0,35.1,41': "quoting",
        "2025/01/22 08:37:13,1,2,3,4,0,35.1": "column_count",
        "": "column_count",
        "2025/02/30 08:37:13,1,2,3,4,0,35.1,41": "t_sec",
        "2025-01-22 08:37:13,1,2,3,4,9,x,41": "t_sec",
        "2025/01/22 24:00:00,1,2,3,4,0,35.1,41": "t_sec",
        "2025/01/22 08:37:13,1,2,3,4,9,nan,41": "lat",
        '2025/01/22 08:37:13,1,2,3,4,0,"35,1",41': "lat",
        "2025/01/22 08:37:13,1,2,3,4,0,90.1,41": "lat",
        "2025/01/22 08:37:13,1,2,3,4,TRUE,35.1,41": "is_video",
    }
    b_head = "time(millisecond),datetime(utc),latitude,longitude,height_above_takeoff(meters),isVideo,gimbal_heading(degrees),gimbal_pitch(degrees),gimbal_roll(degrees),message\r"
    rows = [(1, 1, HEAD + "\r")] + [(1, 2 + i, t) for i, t in enumerate(good)] + [(1, 100 + i, t) for i, t in enumerate(bad)] + [(1, 500, None)]
    rows += [(2, 1, b_head), (2, 2, "0,2025-01-22 08:37:13,35.1,41.0,3,1,1,1,1,ok"), (2, 3, "0,2025-01-22 08:37:13.5,35.1,41.0,3,1,1,1,1,ok"), (2, 4, '0,2025-01-22 08:37:13,35.1,41.0,3,,1,1,1,"a ""b"", c"')]
    rows += [(3, 2, "1,2"), (None, 2, "x"), (1, None, "x")]
    df = spark.createDataFrame([r + ("n",) for r in rows + rows[3:9]], "file_id long, line_no int, line_text string, names string")
    got = [tuple(r) for r in rejected_lines(df).collect()]
    want = {(1, 100 + i, f) for i, f in enumerate(bad.values())} | {(1, 500, "column_count"), (2, 3, "t_sec"), (2, 4, "is_video"), (3, 2, "no_header")}
    assert len(got) == len(set(got)) and set(got) == want
    ok = {(r.file_id, r.line_no): r for r in loaded_lines(df).collect()}
    assert set(ok) == {(1, 2), (1, 3), (1, 4), (1, 5), (2, 2)}
    assert ok[1, 3].lat == 35.0 and ok[1, 3].is_video is False and ok[1, 4].is_video is True and ok[2, 2].height_m == 3.0
    assert rejected_lines(df.limit(0)).count() == 0


def test_loaded_lines_bear_filters_fractions_and_repeated_names(spark):
    """A filter may reach any line before the rejected ones are taken out: none may fail."""
    rows = [(1, 1, HEAD + ",OSD.latitude"), (1, 2, "2025/01/22 08:37:13.009,1,2,3,4,1,35.27,x,7.5"), (1, 3, "2025/01/22 08:37:13.1234567,1,2,3,4,1,-5.5,41.7,7.5"), (1, 4, "short"), (1, 5, '"open'), (1, 6, None), (1, 7, "2025/01/22 08:37:14,1,2,3,4,1,35.5,1.0,2.0,more")]
    df = spark.createDataFrame([r + ("n",) for r in rows], "file_id long, line_no int, line_text string, names string")
    x = loaded_lines(df)
    got = {r.line_no: r for r in x.collect()}
    assert set(got) == {2, 3}
    assert (got[2].sampled_at.microsecond, got[3].sampled_at.microsecond) == (9000, 123456)
    assert got[2].lat == 35.27 and got[2].lon is None and got[3].lon == 41.7
    for name, kind in x.dtypes:
        assert x.where(f"{name} is not null").count() == (1 if name == "lon" else 2), kind
    assert [r.line_no for r in x.where("lat > 0 and is_video and format = 'A' and sampled_at > '2025-01-01'").collect()] == [2]


def test_rejects_a_very_long_line(spark):
    df = spark.createDataFrame([(1, 1, HEAD), (1, 2, '2025/01/22 08:37:13,"' + '""' * 200_000 + '",2,3,4,0,35.1,41'), (1, 3, "x" * 500_000)], "file_id long, line_no int, line_text string")
    assert [tuple(r) for r in rejected_lines(df).collect()] == [(1, 3, "column_count")]


def drift_tables(spark, files, records):
    f = spark.createDataFrame([(i, a, "json", t) for i, a, t in files] + [(99, "A", "csv", "2025-01-01 00:00:00")], "file_id long, aircraft_id string, file_kind string, e string")
    from pyspark.sql import functions as F

    f = f.withColumn("exported_at", F.to_timestamp("e"))
    r = spark.createDataFrame([(i, n, p if p is None or isinstance(p, str) else json.dumps(p)) for i, n, p in records], "file_id long, rec_no int, payload string")
    return f.union(f), r.union(r)


def test_schema_changes(spark):
    files = [(3, "A", "2025-01-01 00:00:00"), (1, "A", "2025-03-01 00:00:00"), (2, "A", "2025-09-01 00:00:00"), (7, "B", "2025-02-01 00:00:00"), (8, None, "2025-02-01 00:00:00"), (9, "A", None)]
    records = [(3, 1, {"lat": 1.5, "yaw_deg": 1, "Wind.speed [m/s]": 2}), (3, 2, {"lat": "--", "yaw_deg": 2.5, "f": None})]
    records += [(1, 1, {"gps_lat": 1.5, "yaw_deg": "90°", "wind_speed": 3, "f": 1}), (1, 2, {"gps_lat": 2, "yaw_deg": "91°"}), (1, 3, "no json"), (1, 4, None), (1, 5, "[1]")]
    records += [(2, 1, {"gps_lat": 2, "heading": 5.0, "wind_speed": 3, "f": 1, "iso": 100})]
    records += [(7, 1, {"a": 1}), (8, 1, {"b": 1})]
    f, r = drift_tables(spark, files, records)
    alias = [("heading", "yaw_deg")]  # their values here have nothing in common, so no evidence could link them
    got = [tuple(x) for x in schema_changes(f, r, alias).collect()]
    want = {
        (1, "renamed", "lat", "gps_lat"),
        (1, "retyped", "yaw_deg", "yaw_deg"),
        (1, "renamed", "Wind.speed [m/s]", "wind_speed"),
        (2, "renamed", "yaw_deg", "heading"),
        (2, "retyped", "heading", "heading"),
        (2, "added", "", "iso"),
    }
    assert len(got) == len(set(got)) and set(got) == want
    t = {(x.file_id, x.rec_no): x for x in consistent_records(f, r, aliases=alias).collect()}
    assert t[1, 1].lat == 1.5 and t[1, 1].yaw_deg == 90.0 and t[3, 2].lat is None and t[1, 3].lat is None and len(t) == 10
    assert schema_registry(f, r).where("aircraft_id = 'A'").count() == 4
    assert schema_changes(f.limit(0), r.limit(0)).count() == 0


def test_casts_of_drifting_values(spark):
    f, r = drift_tables(spark, [(1, "A", "2025-01-01 00:00:00")], [(1, 1, {"t_sec": "00:01:02.5", "focal_len": "70 mm", "is_video": 1, "log_format": 3, "x": "k"}), (1, 2, {"recording": "False", "seconds": "--"})])
    alias = [("focal_len", "focal_len_mm"), ("log_format", "format_detected"), ("recording", "is_video"), ("seconds", "t_sec")]  # one file shows no rename
    t = {x.rec_no: x for x in consistent_records(f, r, aliases=alias).collect()}
    assert (t[1].t_sec, t[1].focal_len_mm, t[1].is_video, t[1].format_detected, t[1].other) == (62.5, 70.0, True, "C (SRT subtitle)", '{"x":"k"}')
    assert (t[2].is_video, t[2].t_sec) == (False, None)


def test_renames_follow_from_evidence_alone(spark):
    """Spellings no list knows: values that go on under another name are renamed, equal-looking names of other things aren't."""
    at = lambda m: f"2025-0{m}-01 00:00:00"
    old = [{"altitude_agl": 50 + i, "wind_speed": 3.1 + 0.1 * i, "pitch": -40.5 + i, "app.mode": ["auto", "hold"][i % 2], "armed": i > 2, "gone": "x"} for i in range(6)]
    new = [{"rel_height": 50 + i, "windspd": 3.1 + 0.1 * i, "camera_tilt": f"{-40.5 + i} deg", "rc.mode": ["P", "S"][i % 2], "armed": int(i > 2), "come": 7000} for i in range(6)]
    files = [(1, "A", at(1)), (2, "A", at(2)), (3, "A", at(3))]
    records = [(1, i, x) for i, x in enumerate(old)] + [(2, i, x) for i, x in enumerate(new)] + [(3, i, dict(reversed(x.items()))) for i, x in enumerate(new)]
    f, r = drift_tables(spark, files, records)
    got = {tuple(x) for x in schema_changes(f, r).collect()}
    assert got == {
        (2, "renamed", "altitude_agl", "rel_height"), (2, "renamed", "wind_speed", "windspd"), (2, "renamed", "pitch", "camera_tilt"),
        (2, "retyped", "camera_tilt", "camera_tilt"), (2, "retyped", "armed", "armed"),
        (2, "removed", "app.mode", ""), (2, "added", "", "rc.mode"), (2, "removed", "gone", ""), (2, "added", "", "come"),
    }
    t = {(x.file_id, x.rec_no): x for x in consistent_records(f, r, {"rel_height": "number", "armed": "flag"}).collect()}
    assert t[1, 3].rel_height == 53.0 and t[2, 3].rel_height == 53.0 and t[2, 3].armed is True and t[1, 0].armed is False
    assert json.loads(t[3, 0].other)["rc.mode"] == "P"
    steps = migration_steps(f, r).collect()
    assert {(x.from_version, x.to_version) for x in steps} == {(1, 2)} and len(steps) == 9


def test_repeated_keys_and_numbers_in_drifting_records(spark):
    """Two payloads under one number, one key twice in a payload, a key with a separator in it, a file in no list."""
    payloads = [(1, 1, '{"lat": 1.0, "x": "a"}'), (1, 1, '{"lat": 2.0, "x": "b"}'), (1, 2, '{"x": 1, "x": 2}'), (1, 3, '{"": 1, "lat": 3}'), (50, 1, '{"lat": 4}'), (None, 1, "{}"), (1, None, '{"lat": 5}')]
    f, r = drift_tables(spark, [(1, "A", "2025-01-01 00:00:00")], payloads)
    t = {(x.file_id, x.rec_no): x for x in consistent_records(f, r).collect()}
    assert len(t) == 6 and t[1, 1].lat == 1.0 and json.loads(t[1, 1].other) == {"x": "a"} and t[1, 3].lat == 3.0 and t[50, 1].lat == 4.0 and t[1, None].lat == 5.0
    assert schema_changes(f, r).count() == 0 and migration_steps(f, r).count() == 0
    assert consistent_records(f.limit(0), r.limit(0)).count() == 0


def test_previous_row_needs_no_whole_key(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", i) for i in (1, 2, 50, 51, 900)] + [("b", 3)], "k string, o int")
    got = {(r.k, r.o): r.prev_o for r in previous_row(df, "k", ["o"], F.floor(F.col("o") / 10), ["o"]).collect()}
    assert got == {("a", 1): None, ("a", 2): 1, ("a", 50): 2, ("a", 51): 50, ("a", 900): 51, ("b", 3): None}


def test_halo_lists_a_row_under_each_block_that_needs_it(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(float(x),) for x in (0, 49, 51, 100)] + [(None,)], "p double")
    got = sorted((r.p, r.blk, r.blk_home) for r in with_halo(df, F.col("p"), 100.0, 5.0, 5.0).collect())
    assert got == [(0.0, 0, True), (49.0, 0, True), (49.0, 1, False), (51.0, 0, False), (51.0, 1, True), (100.0, 1, True)]
