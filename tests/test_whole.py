"""Queries that once worked on a part of their tables, against the whole job in plain Python or DuckDB."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skyledger.operators import windows as T

D = "/root/testdata/sf0.001"


def save(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")


def run(spark, name, d=D):
    return [tuple(x) for x in entry.queries()[name](spark, str(d)).collect()]


def sql(text, d=D):
    """`text` with {table} for the files of a table."""
    import os
    import re

    at = lambda n: f"'{d}/{n}.parquet/*.parquet'" if os.path.isdir(f"{d}/{n}.parquet") else f"'{d}/{n}.parquet'"
    return duckdb.sql(re.sub(r"\{(\w+)\}", lambda m: at(m[1]), text)).fetchall()


def test_coverage_takes_every_row_of_the_ledger(spark, tmp_path):
    rows = [
        (1, 7, 12, 0.05), (1, 1, 13, 0.01),  # an even frame beyond line 2 keeps the triangle, an odd one has the best angle
        (2, 6, 99, 0.03), (2, 7, 97, 0.02),  # odd frames only
    ]
    save(spark, tmp_path, "lineitem", rows, "l_partkey long, l_linenumber long, l_suppkey long, l_discount double")
    save(spark, tmp_path, "part", [(1, "roof"), (2, "wall"), (3, "wall")], "p_partkey long, p_type string")
    assert sorted(run(spark, "e16_e17_fa15_coverage", tmp_path)) == [(1, "roof", "observed", 0.01), (2, "wall", "observable_but_dropped", 0.02), (3, "wall", "never_observable", None)]
    assert sorted(run(spark, "fa14_coverage_by_semantic", tmp_path)) == [("all", 3, pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3)), ("roof", 1, 1, 0, 0), ("wall", 2, 0, 0.5, 0.5)]


def test_coverage_equals_the_whole_ledger_in_duckdb(spark):
    want = sql("SELECT p_partkey, p_type, CASE WHEN bool_or(l_suppkey % 2 = 0) THEN 'observed' WHEN count(l_suppkey) > 0 THEN 'observable_but_dropped' ELSE 'never_observable' END, min(l_discount) FROM {part} LEFT JOIN {lineitem} ON p_partkey = l_partkey GROUP BY ALL")
    assert sorted(run(spark, "e16_e17_fa15_coverage")) == sorted(want)


def least_reachable(edges):
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            up[v] = v = up[up[v]]
        return v

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {v: top(v) for v in up}


def test_components_take_every_edge_and_fold_no_vertex(spark, tmp_path):
    # orders 1 and 3001 share no part, nor do parts 5 and 3005; an order and a part of equal number are two vertices
    rows = [(1, 5, 1, 50.0), (1, 6, 2, 1.0), (3001, 3005, 7, 1.0), (3001, 7, 7, 30.0), (9, 1, 7, 1.0)]
    save(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_partkey long, l_linenumber long, l_quantity double")
    want = {2: 2, 11: 2, 13: 2, 6002: 15, 6011: 15, 15: 15, 18: 3, 3: 3}
    assert dict(run(spark, "k10_components", tmp_path)) == want


def test_components_of_the_whole_table(spark):
    want = least_reachable(sql("SELECT l_orderkey * 2, l_partkey * 2 + 1 FROM {lineitem}"))
    assert dict(run(spark, "k10_components")) == want


def test_the_five_largest_components_of_four_vertices_stay(spark, tmp_path):
    rows = [(100 * g + o, 100 * g, 1, 50.0) for g in range(1, 8) for o in range(1, g + 1)]  # g orders at one part: g + 1 vertices
    save(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_partkey long, l_linenumber long, l_quantity double")
    labels = run(spark, "d13_h4_small_components", tmp_path)
    sizes = sorted(sum(x[1] == m for x in labels) for m in {x[1] for x in labels})
    assert sizes == [4, 5, 6, 7, 8]


def test_accumulators_keep_every_primitive_apart(spark, tmp_path):
    rows = [(5, 1, 1, 0.01, 0.04), (1005, 2, 2, 0.03, 0.08), (1005, 3, 1, 0.02, 0.08), (2950, 4, 1, 0.05, 0.0)]
    save(spark, tmp_path, "lineitem", rows, "l_partkey long, l_orderkey long, l_linenumber long, l_discount double, l_tax double")
    save(spark, tmp_path, "part", [(5, 10), (1005, 20), (2950, 30), (7000, 40)], "p_partkey long, p_size int")
    assert {x[0]: x[1:4] for x in run(spark, "fa3_accumulators", tmp_path)} == {5: (1, 0.01, 0.01), 1005: (2, 0.02, 0.03), 2950: (1, 0.05, 0.05)}
    assert {x[0] for x in run(spark, "fa4_accumulator_confidence", tmp_path)} == {5, 1005, 2950}
    blended = {x[0]: x[1:] for x in run(spark, "fa5_a14_blended", tmp_path)}
    assert {k: v[1] for k, v in blended.items()} == {5: 1, 1005: 2, 2950: 1, 7000: 0}
    assert blended[7000] == (0.8, 0, 0.8)  # a part without rows keeps its prior


WHOLE = {
    "l_partkey % 1000 AS id": "l_partkey AS id", " WHERE l_partkey % 1000 < 900": "", " WHERE p_partkey < 1000": "",
    " AND id < 40": "",
}


def whole_sql(name, d):
    """The registered SQL without the filters that made it state a part, run by DuckDB."""
    import os

    text = entry.oracle_sql()[name]
    for old, new in WHOLE.items():
        text = text.replace(old, new)
    con = duckdb.connect()
    for n in ("lineitem", "part", "supplier"):
        at = f"{d}/{n}.parquet"
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con.execute(text).fetchall()


def same(got, want, within=1e-6):
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert all(x == (pytest.approx(y, abs=within) if isinstance(y, float) else y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ["fa3_accumulators", "fa4_accumulator_confidence", "fa5_a14_blended", "d15_densify_prune", "h3_densify_budget", "k20_k24_clone_split_resize"])
def test_gates_and_budget_report_on_all_parts(spark, name):
    d = "/root/testdata/sf0.01"
    same(run(spark, name, d), whole_sql(name, d), 2e-6)


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])  # one block and eight
def test_distances_are_of_every_pair_of_buildings(spark, d):
    want = whole_sql("e8_fa12_distances", d)
    assert any(b >= 40 for _, b, *_ in want)
    same(run(spark, "e8_fa12_distances", d), want, 2e-6)


def test_padding_loses_no_image(spark):
    got = {x[0]: x[1:] for x in run(spark, "c29_padding_geometry")}
    ids = [x[0] for x in sql("SELECT o_orderkey FROM {orders}")]
    assert len(got) == len(ids)
    for i in ids:
        w, h = 320 + i % 400, 240 + i % 300
        long = 518 / max(w, h)
        new_w = 518 if w >= h else min(518, round(w * long / 14) * 14)
        new_h = 518 if w < h else min(518, round(h * long / 14) * 14)
        assert got[i] == ((518 - new_w) // 2, new_w, (518 - new_h) // 2, new_h, round(new_h * 0.08)), i


def mesh(spark, path, faces, n):
    save(spark, path, "lineitem", [(o, p, s, 1) for o, p, s in faces], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long")
    save(spark, path, "embeddings", [(i, 0, [i / 10.0, -i / 10.0, 0.5] + [0.0] * 61) for i in range(n)], "vec_id long, label int, embedding array<double>")


def test_the_mesh_grows_with_its_vertices(spark, tmp_path):
    mesh(spark, tmp_path, [(1, 2, 3), (501, 502, 503), (601, 602, 603)], 700)
    assert run(spark, "e19_fa21_edge_topology", tmp_path) == [(9, 9, 0, 0)]  # (1, 2, 3) and (501, 502, 503) share no edge
    assert len(run(spark, "d14_clean_faces", tmp_path)) == 3
    assert run(spark, "fa21_face_areas", tmp_path)[0][0] == 3
    assert {x[2] for x in run(spark, "b2_obj", tmp_path) if x[0] == "f"} == {"f 2 3 4", "f 502 503 504", "f 602 603 604"}


def test_parts_share_and_extent_of_a_mesh(spark, tmp_path):
    mesh(spark, tmp_path, [(1, 2, 3), (3, 4, 5), (6, 7, 8)], 10)  # parts of 5 and 3; 0 and 9 alone
    got = run(spark, "fa21_mesh_components", tmp_path)[0]
    assert got == pytest.approx((4, 0.5, 0.0, -9.0, 5.0, 9.0, 0.0, 5.0))


def most_read_by_a_task(spark, since):
    """MB of shuffled data that the tasks of a stage read on the average, of the worst stage that ran from stage `since` on."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    stages = [stages.apply(i) for i in range(stages.size())]
    return max(x.stageId() for x in stages), max([x.shuffleReadBytes() / x.numTasks() / 1e6 for x in stages if x.stageId() >= since])


@pytest.mark.parametrize("bound", [200_000, 0])  # vertices sent to the faces, and met by an exchange
def test_areas_of_many_faces_meet_in_no_task(spark, tmp_path, monkeypatch, bound):
    from skyledger.plans import clouds

    monkeypatch.setattr(clouds, "SMALL_MESH", bound, raising=False)
    n, m = 300, 200_000
    rng = np.random.default_rng(7)
    xyz, f = rng.normal(size=(n, 3)).astype(np.float32), rng.integers(0, n, size=(m, 3))
    f[:3, 1] = f[:3, 0]  # flat
    duckdb.from_arrow(pa.table({"l_orderkey": f[:, 0], "l_partkey": f[:, 1], "l_suppkey": f[:, 2], "l_linenumber": np.ones(m, int)})).write_parquet(f"{tmp_path}/lineitem.parquet")
    save(spark, tmp_path, "embeddings", [(i, 0, [float(v) for v in xyz[i]] + [0.0] * 61) for i in range(n)], "vec_id long, label int, embedding array<float>")
    since, _ = most_read_by_a_task(spark, 0)
    got = run(spark, "fa21_face_areas", tmp_path)[0]
    p = xyz.astype(float) * 10
    area = np.linalg.norm(np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]]), axis=1) / 2
    assert got == (m, pytest.approx(area.sum(), abs=6e-4), pytest.approx(np.quantile(area, 0.5), abs=2e-9), pytest.approx(np.quantile(area, 0.99), abs=2e-9), (area < 1e-10).sum())
    assert got[4] >= 3
    assert bound == 0 or most_read_by_a_task(spark, since + 1)[1] < 1.0  # all areas once are 1.6 MB


NEAR = [1.0 + k * 2.0**-52 for k in range(999)]  # all of one size
ODD = {
    "none": [], "nulls": [None, None], "one": [-3.5], "two": [2.0, -1.0], "ties": [1.0] * 50 + [2.0] * 51, "zeros": [0.0, -0.0, 5e-324, -5e-324, None, 0.0], "near": NEAR,
    "wide": [s * 10.0**e for s in (-1, 1) for e in range(-320, 309, 7)], "ends": [float("-inf"), -1.0, 1.7e308, float("inf"), float("nan"), float("nan")], "nan": [float("nan"), 1.0, None],
}


@pytest.mark.parametrize("kind", ODD)
def test_percentiles_are_those_of_spark(spark, kind):
    df = spark.createDataFrame([(x,) for x in ODD[kind]], "x double").repartition(3)
    at = {f"p{k}": k / 100 for k in (0, 1, 33, 50, 99, 100)}
    got = T.percentiles(df, "x", at, {"n": F.lit(1), "above": F.when(F.col("x") > 1, 1).otherwise(0)}).first()
    want = df.agg(F.sum(F.lit(1)), F.sum(F.when(F.col("x") > 1, 1).otherwise(0)), *[F.percentile("x", F.lit(p)) for p in at.values()]).first()
    assert got.__fields__ == ["n", "above", *at]
    assert [str(v if v is None else v + 0) for v in got] == [str(v if v is None else v + 0) for v in want]  # -0.0 is 0
