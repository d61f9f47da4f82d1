"""Queries over observations and fused points: accumulators, gates, grids, diffusion, thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions import confidence as C
from skyledger.functions import geometry as G
from skyledger.operators.thresholds import frustum_fits, frustum_verdict, valley_threshold
from skyledger.operators.voxel_fusion import fuse, score
from skyledger.operators.windows import ema
from skyledger.plans.fusion import OBS_SQL, SCORED_SQL, VOXEL, scored
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


@query("d3_valid_observations", f"WITH {OBS_SQL} SELECT frame_idx, count(*) AS n, count(*) FILTER (WHERE z > 0 AND consistency >= 0.25 AND frame_idx % 5 <> 0) AS n_valid FROM obs GROUP BY 1")
def _(s, d):
    """Depth above zero, consistent, and not in a dynamic frame (the mask table meets by a left anti-like flag)."""
    o = A.observations(s, d)
    mask = table(s, d, "supplier").where("s_suppkey % 5 = 0").select(c("s_suppkey").alias("frame_idx"), F.lit(True).alias("dynamic"))
    x = o.join(mask, "frame_idx", "left")
    ok = (c("z") > 0) & (c("consistency") >= 0.25) & c("dynamic").isNull()
    return x.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("n_valid"))


ACC = f"""{OBS_SQL}, o2 AS (SELECT l_partkey AS id, l_discount AS view_angle, l_tax / 0.08::DOUBLE AS consistency, 0.5::DOUBLE + l_linenumber::DOUBLE / 14.0::DOUBLE AS frame_quality, (l_orderkey % 100)::DOUBLE / 100.0::DOUBLE AS pose_confidence FROM lineitem),
acc AS (SELECT id, count(*) AS obs_count, min(view_angle) AS angle_min, max(view_angle) AS angle_max, sum(consistency) AS consistency_sum, sum(frame_quality) AS quality_sum, sum(pose_confidence) AS pose_sum FROM o2 GROUP BY 1),
onl AS (SELECT *, exp(0.30 * ln(1.0 - exp(-greatest(obs_count::DOUBLE - 1.0, 0.0) / 1.5) + 1e-6) + 0.20 * ln(greatest(0.0, least(1.0, (angle_max - angle_min) / radians(6.0))) + 1e-6) + 0.25 * ln(greatest(0.0, least(1.0, consistency_sum / obs_count)) + 1e-6) + 0.15 * ln(greatest(0.0, least(1.0, quality_sum / obs_count)) + 1e-6) + 0.10 * ln(greatest(0.0, least(1.0, pose_sum / obs_count)) + 1e-6)) AS c0 FROM acc),
online AS (SELECT *, CASE WHEN obs_count <= 1 THEN least(c0, 0.55) ELSE c0 END AS conf FROM onl)"""


def accumulate(s, d):
    """Mergeable evidence per primitive: every part is a count, sum, minimum or maximum."""
    o = table(s, d, "lineitem").select(
        c("l_partkey").alias("id"),
        c("l_discount").alias("a"),
        (c("l_tax") / F.lit(0.08)).alias("k"),
        (F.lit(0.5) + c("l_linenumber").cast("double") / 14.0).alias("q"),
        (F.pmod(c("l_orderkey"), F.lit(100)).cast("double") / 100.0).alias("p"),
    )
    return o.groupBy("id").agg(
        F.count(F.lit(1)).alias("obs_count"), F.min("a").alias("angle_min"), F.max("a").alias("angle_max"), F.sum("k").alias("consistency_sum"), F.sum("q").alias("quality_sum"), F.sum("p").alias("pose_sum")
    )


def online_confidence(acc: DataFrame) -> DataFrame:
    n = F.greatest(c("obs_count"), F.lit(1))
    conf = C.confidence(c("obs_count"), c("angle_max") - c("angle_min"), c("consistency_sum") / n, c("quality_sum") / n, c("pose_sum") / n, clamp_obs=True)
    return acc.withColumn("confidence", conf)


@query("fa3_accumulators", f"WITH {ACC} SELECT id, obs_count, angle_min, angle_max, round(consistency_sum, 6) AS consistency_sum, round(quality_sum, 6) AS quality_sum, round(pose_sum, 6) AS pose_sum FROM acc")
def _(s, d):
    return accumulate(s, d).select("id", "obs_count", "angle_min", "angle_max", *[r(c(x), 6).alias(x) for x in ("consistency_sum", "quality_sum", "pose_sum")])


@query("fa4_accumulator_confidence", f"WITH {ACC} SELECT id, round(conf, 9) AS confidence FROM online")
def _(s, d):
    return online_confidence(accumulate(s, d)).select("id", r(c("confidence")).alias("confidence"))


PRIOR_SQL = "prior AS (SELECT p_partkey AS id, p_size::DOUBLE / 50.0 AS prior FROM part)"
BLEND_SQL = f"{ACC}, {PRIOR_SQL}, blend AS (SELECT prior.id, prior, coalesce(obs_count, 0) AS obs_count, CASE WHEN obs_count > 0 THEN 0.5 * conf + 0.5 * prior ELSE prior END AS conf FROM prior LEFT JOIN online USING (id))"


def blended(s, d):
    """A primitive with evidence takes half of it and half its prior; one without keeps its prior."""
    prior = table(s, d, "part").select(c("p_partkey").alias("id"), (c("p_size").cast("double") / 50.0).alias("prior"))
    x = prior.join(online_confidence(accumulate(s, d)).select("id", "obs_count", "confidence"), "id", "left")
    conf = F.when(c("obs_count") > 0, F.lit(0.5) * c("confidence") + F.lit(0.5) * c("prior")).otherwise(c("prior"))
    return x.select("id", "prior", F.coalesce("obs_count", F.lit(0)).alias("obs_count"), conf.alias("confidence"))


@query("fa5_a14_blended", f"WITH {BLEND_SQL} SELECT id, prior, obs_count, round(conf, 9) AS confidence FROM blend")
def _(s, d):
    return blended(s, d).withColumn("confidence", r(c("confidence")))


GATE_SQL = f"{BLEND_SQL}, g AS (SELECT *, (id % 97)::DOUBLE / 97.0 AS opacity, (id % 11)::DOUBLE / 10000.0 AS grad, (id % 7)::DOUBLE AS struggle FROM blend), gate AS (SELECT *, opacity < 0.05 OR conf < 0.12 AS prune, (grad > 0.0002 OR struggle > 3) AND conf >= 0.6 AND NOT (opacity < 0.05 OR conf < 0.12) AS densify FROM g)"


def gated(s, d):
    x = blended(s, d).withColumns({"opacity": F.pmod("id", F.lit(97)).cast("double") / 97.0, "grad": F.pmod("id", F.lit(11)).cast("double") / 10000.0, "struggle": F.pmod("id", F.lit(7)).cast("double")})
    prune = (c("opacity") < 0.05) | (c("confidence") < 0.12)
    return x.withColumns({"prune": prune, "densify": ((c("grad") > 0.0002) | (c("struggle") > 3)) & (c("confidence") >= 0.6) & ~prune})


@query("d15_densify_prune", f"WITH {GATE_SQL} SELECT id, prune, densify FROM gate")
def _(s, d):
    return gated(s, d).select("id", "prune", "densify")


@query("h3_densify_budget", f"WITH {GATE_SQL} SELECT id, grad FROM gate WHERE densify AND obs_count >= 3 ORDER BY grad DESC, id LIMIT 50")
def _(s, d):
    """The 50 densification candidates with evidence that have the steepest gradient."""
    return gated(s, d).where("densify and obs_count >= 3").orderBy(c("grad").desc(), "id").limit(50).select("id", "grad")


@query("k20_k24_clone_split_resize", f"WITH {GATE_SQL}, k AS (SELECT id, 'kept' AS kind, conf FROM gate WHERE NOT prune AND NOT (densify AND opacity > 0.5) UNION ALL SELECT id, 'clone', conf FROM gate WHERE densify AND opacity <= 0.5 UNION ALL SELECT id, 'split', conf FROM gate, range(2) WHERE densify AND opacity > 0.5) SELECT kind, count(*) AS n, round(sum(conf), 6) AS confidence_sum FROM k GROUP BY 1")
def _(s, d):
    """Row algebra of densification: small ones are copied, large ones give two and go, pruned ones go; children inherit confidence."""
    x = gated(s, d).select("id", "prune", "densify", "opacity", "confidence")
    split = c("densify") & (c("opacity") > 0.5)
    kinds = F.flatten(
        F.array(
            F.when(~c("prune") & ~split, F.array(F.lit("kept"))).otherwise(F.array().cast("array<string>")),
            F.when(c("densify") & (c("opacity") <= 0.5), F.array(F.lit("clone"))).otherwise(F.array().cast("array<string>")),
            F.when(split, F.array(F.lit("split"), F.lit("split"))).otherwise(F.array().cast("array<string>")),
        )
    )
    return x.select("confidence", F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r(F.sum("confidence"), 6).alias("confidence_sum"))


@query("k20_child_rows", f"""WITH {GATE_SQL}, z AS (SELECT *, 0.001 + (id % 50)::DOUBLE / 1000.0 AS scale FROM gate), k AS (SELECT id, 0 AS child, scale, opacity, conf FROM z WHERE NOT prune AND NOT (densify AND scale > 0.01)
UNION ALL SELECT id, 1, scale, opacity, conf FROM z WHERE densify AND scale <= 0.01 UNION ALL SELECT id, i::INT, scale / 1.6::DOUBLE, opacity, conf FROM z, (VALUES (1), (2)) AS v(i) WHERE densify AND scale > 0.01)
SELECT id, child, round(scale, 9) AS scale, round(least(opacity, 0.01), 9) AS reset_opacity, round(conf, 9) AS confidence FROM k""")
def _(s, d):
    """The rows after densification: a small primitive stays and is copied, a large one gives way to two children of scale / 1.6.

    Children keep the parent's confidence and opacity; the opacity reset caps the latter at .01.
    Child 0 is the row itself.
    """
    x = gated(s, d).withColumn("scale", F.lit(0.001) + F.pmod("id", F.lit(50)).cast("double") / 1000.0)
    large = c("scale") > 0.01
    none = F.array().cast("array<struct<child:int,scale:double>>")
    row = lambda i, v: F.struct(F.lit(i).alias("child"), v.alias("scale"))
    itself = F.when(~c("prune") & ~(c("densify") & large), F.array(row(0, c("scale")))).otherwise(none)
    children = F.when(c("densify") & large, F.array(*[row(i, c("scale") / 1.6) for i in (1, 2)])).when(c("densify"), F.array(row(1, c("scale")))).otherwise(none)
    x = x.select("id", "opacity", "confidence", F.inline(F.concat(itself, children)))
    return x.select("id", "child", r(c("scale")).alias("scale"), r(F.least("opacity", F.lit(0.01))).alias("reset_opacity"), r(c("confidence")).alias("confidence"))


@query("k21_struggle", "SELECT vec_id AS id, round(CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE sqrt(pow(embedding[14]::DOUBLE, 2) + pow(embedding[15]::DOUBLE, 2)) / (sqrt(abs(embedding[16]::DOUBLE)) + 1e-8) END, 9) AS struggle FROM embeddings")
def _(s, d):
    """Optimizer moment over the root of the second moment; zero before warm-up."""
    g = table(s, d, "embeddings")
    e = lambda i: c("embedding")[i].cast("double")
    v = F.sqrt(F.pow(e(13), 2) + F.pow(e(14), 2)) / (F.sqrt(F.abs(e(15))) + 1e-8)
    return g.select(c("vec_id").alias("id"), r(F.when(c("vec_id") % 10 == 0, 0.0).otherwise(v)).alias("struggle"))


@query("d4_seed_mask", f"WITH {SCORED_SQL} SELECT count(*) AS n_points, count(*) FILTER (WHERE observation_count >= 2 AND consistency >= 0.25 AND conf >= 0.12) AS n_seeds, count(*) FILTER (WHERE observation_count >= 2 AND consistency >= 0.25 AND conf >= 0.12) >= 500 AS enough FROM points")
def _(s, d):
    seed = (c("observation_count") >= 2) & (c("consistency") >= 0.25) & (c("confidence") >= 0.12)
    n = F.count(F.when(seed, 1))
    return scored(s, d).agg(F.count(F.lit(1)).alias("n_points"), n.alias("n_seeds"), (n >= 500).alias("enough"))


@query("c26_d2_fa28_fa30_bands", f"WITH {SCORED_SQL} SELECT band, count(*) AS n, count(*) FILTER (WHERE conf >= 0.12) AS n_kept, count(*) FILTER (WHERE conf >= 0.6) AS n_densify, round(avg(conf), 9) AS mean_confidence, count(*) FILTER (WHERE observation_count <= 1) AS n_single_view, sum(n_raw_observations)::BIGINT AS n_observations FROM points GROUP BY 1")
def _(s, d):
    return scored(s, d).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(c("keep"), 1)).alias("n_kept"),
        F.count(F.when(c("densify"), 1)).alias("n_densify"),
        r(F.avg("confidence")).alias("mean_confidence"),
        F.count(F.when(c("single_view_capped"), 1)).alias("n_single_view"),
        F.sum("n_raw_observations").alias("n_observations"),
    )


GRID_SQL = f"""{SCORED_SQL}, lo AS (SELECT min(x) AS x0, min(y) AS y0 FROM points WHERE conf >= 0.12),
cells AS (SELECT CAST(floor((x - x0) / 10.0) AS BIGINT) AS cell_x, CAST(floor((y - y0) / 10.0) AS BIGINT) AS cell_y, count(*) AS n_points, avg(conf) AS mean_confidence, count(*) FILTER (WHERE band = 'High') AS n_high, count(*) FILTER (WHERE band = 'Moderate') AS n_moderate, count(*) FILTER (WHERE band = 'Low / insufficient observation') AS n_low, any_value(x0) AS x0, any_value(y0) AS y0 FROM points, lo WHERE conf >= 0.12 GROUP BY 1, 2),
grid AS (SELECT *, n_low::DOUBLE / n_points AS low_fraction, x0 + (cell_x + 0.5::DOUBLE) * 10.0 AS center_x, y0 + (cell_y + 0.5::DOUBLE) * 10.0 AS center_y FROM cells)"""


def spatial_grid(points: DataFrame, size: float = 10.0) -> DataFrame:
    """Occupied plan-view cells of the kept points, from the data's own minimum."""
    kept = points.where("keep")
    lo = kept.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))  # one row
    k = kept.crossJoin(F.broadcast(lo))
    cell = lambda a: F.floor((c(a) - c(f"{a}0")) / F.lit(size)).cast("bigint").alias(f"cell_{a}")
    n_band = lambda b: F.count(F.when(c("band") == b, 1))
    g = k.groupBy(cell("x"), cell("y"), "x0", "y0").agg(F.count(F.lit(1)).alias("n_points"), F.avg("confidence").alias("mean_confidence"), n_band(C.HIGH).alias("n_high"), n_band(C.MODERATE).alias("n_moderate"), n_band(C.LOW).alias("n_low"))
    return g.withColumns(
        {"low_fraction": c("n_low") / c("n_points"), "center_x": c("x0") + (c("cell_x") + F.lit(0.5)) * size, "center_y": c("y0") + (c("cell_y") + F.lit(0.5)) * size}
    )


@query("fa6_spatial_grid", f"WITH {GRID_SQL} SELECT cell_x, cell_y, n_points, n_high, n_moderate, n_low, round(mean_confidence, 9) AS mean_confidence, round(low_fraction, 9) AS low_fraction, round(center_x, 6) AS center_x, round(center_y, 6) AS center_y FROM grid")
def _(s, d):
    return spatial_grid(scored(s, d)).select("cell_x", "cell_y", "n_points", "n_high", "n_moderate", "n_low", r(c("mean_confidence")).alias("mean_confidence"), r(c("low_fraction")).alias("low_fraction"), r(c("center_x"), 6).alias("center_x"), r(c("center_y"), 6).alias("center_y"))


@query("fa6_empty_cells", f"WITH {GRID_SQL} SELECT count(*) AS n_occupied, (max(cell_x) + 1) * (max(cell_y) + 1) - count(*) AS n_empty FROM grid")
def _(s, d):
    return spatial_grid(scored(s, d)).agg(F.count(F.lit(1)).alias("n_occupied"), ((F.max("cell_x") + 1) * (F.max("cell_y") + 1) - F.count(F.lit(1))).alias("n_empty"))


@query("h2_d17_c27_weak_regions", f"""WITH {GRID_SQL}, m AS (SELECT avg(center_x) AS mx, avg(center_y) AS my FROM grid), w AS (SELECT *, center_x - mx AS dx, center_y - my AS dy FROM grid, m WHERE n_points >= 5 AND low_fraction > 0.2)
SELECT cell_x, cell_y, n_points, round(low_fraction, 3) AS low_fraction, CASE WHEN abs(dx) < 1e-6 AND abs(dy) < 1e-6 THEN 'central' WHEN abs(dy) < 0.4 * abs(dx) THEN CASE WHEN dx > 0 THEN 'east' ELSE 'west' END WHEN abs(dx) < 0.4 * abs(dy) THEN CASE WHEN dy > 0 THEN 'north' ELSE 'south' END ELSE CASE WHEN dy > 0 THEN 'north' ELSE 'south' END || CASE WHEN dx > 0 THEN 'east' ELSE 'west' END END AS direction
FROM w ORDER BY low_fraction DESC, n_points, cell_x, cell_y LIMIT 10""")
def _(s, d):
    """The ten weakest cells with enough points (a top-k report)."""
    g = spatial_grid(scored(s, d))
    m = g.agg(F.avg("center_x").alias("mx"), F.avg("center_y").alias("my"))
    w = g.where("n_points >= 5 and low_fraction > 0.2").crossJoin(F.broadcast(m))
    w = w.orderBy(c("low_fraction").desc(), "n_points", "cell_x", "cell_y").limit(10)
    return w.select("cell_x", "cell_y", "n_points", r(c("low_fraction"), 3).alias("low_fraction"), G.compass(c("center_x") - c("mx"), c("center_y") - c("my")).alias("direction"))


@query("g19_e18_voxel_diffusion", f"WITH {SCORED_SQL}, v AS (SELECT vx, vy, vz, conf, avg(conf) OVER (PARTITION BY floor(x / 8.0), floor(y / 8.0), floor(z / 8.0)) AS m FROM points) SELECT vx, vy, vz, round(0.7 * conf + 0.3 * m, 9) AS diffused FROM v")
def _(s, d):
    """Each point moves by .3 to the mean of its coarse voxel."""
    w = W.partitionBy(*[F.floor(c(a) / 8.0) for a in "xyz"])
    return scored(s, d).select("vx", "vy", "vz", r(F.lit(0.7) * c("confidence") + F.lit(0.3) * F.avg("confidence").over(w)).alias("diffused"))


@query("g11_temporal_ema", "WITH RECURSIVE o AS (SELECT l_partkey AS id, l_discount AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS i FROM lineitem), e AS (SELECT id, i, v AS ema FROM o WHERE i = 1 UNION ALL SELECT o.id, o.i, 0.85 * e.ema + 0.15 * o.v FROM e JOIN o ON o.id = e.id AND o.i = e.i + 1) SELECT id, i AS n, round(ema, 9) AS ema FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1")
def _(s, d):
    li = table(s, d, "lineitem").select(c("l_partkey").alias("id"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("o"), c("l_discount").alias("v"))
    return ema(li, ["id"], "o", "v").select("id", "n", r(c("ema")).alias("ema"))


def _ablation_sql():
    one = []
    for name, size, gate in CONFIGS:
        sql = SCORED_SQL.replace("/ 2.0)", f"/ {size})")
        one.append(f"SELECT '{name}' AS run_name, count(*) AS n_points, round(avg(conf), 9) AS mean_confidence, count(*) FILTER (WHERE conf >= {gate}) AS n_kept, count(*) FILTER (WHERE conf >= {gate})::VARCHAR || '/' || count(*)::VARCHAR AS kept_of FROM (WITH {sql} SELECT * FROM points)")
    return " UNION ALL ".join(one)


CONFIGS = [("voxel_1_gated", 1.0, 0.12), ("voxel_2_gated", 2.0, 0.12), ("voxel_2_ungated", 2.0, 0.0), ("voxel_4_gated", 4.0, 0.12)]


@query("l8_e21_i1_ablation", _ablation_sql())
def _(s, d):
    """One row of metrics per configuration; runs that share a voxel size share its fusion."""
    out = []
    obs = A.observations(s, d)
    for name, size, gate in CONFIGS:
        n = F.count(F.when(c("confidence") >= gate, 1))
        p = score(fuse(obs, size))
        out.append(p.agg(F.count(F.lit(1)).alias("n_points"), r(F.avg("confidence")).alias("mean_confidence"), n.alias("n_kept"), F.concat(n.cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("kept_of")).select(F.lit(name).alias("run_name"), "*"))
    return reduce(DataFrame.unionByName, out)


@query("c24_percentile_normalise", "WITH p AS (SELECT l_suppkey AS f, quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem GROUP BY 1) SELECT l_suppkey AS frame_idx, count(*) AS n, round(sum(CASE WHEN b - a < 1e-6 THEN 0.5 ELSE greatest(0.0, least(1.0, (l_extendedprice - a) / (b - a))) END), 6) AS total FROM lineitem JOIN p ON l_suppkey = f GROUP BY 1")
def _(s, d):
    li = table(s, d, "lineitem").select(c("l_suppkey").alias("frame_idx"), "l_extendedprice")
    p = li.groupBy("frame_idx").agg(F.percentile("l_extendedprice", F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    span = c("p")[1] - c("p")[0]
    v = F.when(span < 1e-6, 0.5).otherwise(G.clip((c("l_extendedprice") - c("p")[0]) / span, 0, 1))
    return li.join(p, "frame_idx").groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"), r(F.sum(v), 6).alias("total"))


@query("c25_color_normalise", "WITH m AS (SELECT max(p_size)::DOUBLE AS m FROM part) SELECT p_partkey, round(greatest(0.0, least(1.0, CASE WHEN m > 1.0001 THEN p_size::DOUBLE / 255.0 ELSE p_size::DOUBLE END)), 9) AS color FROM part, m")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", c("p_size").cast("double").alias("v"))
    m = p.agg(F.max("v").alias("m"))
    return p.crossJoin(F.broadcast(m)).select("p_partkey", r(G.clip(F.when(c("m") > 1.0001, c("v") / 255.0).otherwise(c("v")), 0, 1)).alias("color"))


@query("fa25_fa35_percentiles_extent", f"WITH {SCORED_SQL} SELECT round(quantile_cont(conf, 0.01), 9) AS p1, round(quantile_cont(conf, 0.5), 9) AS p50, round(quantile_cont(conf, 0.99), 9) AS p99, round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)), 6) AS diagonal FROM points")
def _(s, d):
    span = lambda a: F.pow(F.max(a) - F.min(a), 2)
    q = F.percentile("confidence", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    x = scored(s, d).agg(q.alias("q"), r(F.sqrt(span("x") + span("y") + span("z")), 6).alias("diagonal"))
    return x.select(*[r(c("q")[i]).alias(n) for i, n in enumerate(("p1", "p50", "p99"))], "diagonal")


@query("d5_usable_pixels", "SELECT l_suppkey AS frame_idx, count(*) FILTER (WHERE l_linenumber >= 2 AND l_quantity >= 1.5 AND l_tax > 0 AND l_tax <= 0.06) AS n_usable, count(*) FILTER (WHERE l_linenumber >= 2 AND l_quantity >= 1.5 AND l_tax > 0 AND l_tax <= 0.06) >= 100 AS enough FROM lineitem GROUP BY 1")
def _(s, d):
    ok = (c("l_linenumber") >= 2) & (c("l_quantity") >= 1.5) & (c("l_tax") > 0) & (c("l_tax") <= 0.06)
    n = F.count(F.when(ok, 1))
    return table(s, d, "lineitem").groupBy(c("l_suppkey").alias("frame_idx")).agg(n.alias("n_usable"), (n >= 100).alias("enough"))


@query("d12_density_trim", f"WITH {SCORED_SQL}, q AS (SELECT quantile_cont(n_raw_observations, 0.03) AS q FROM points) SELECT vx, vy, vz, n_raw_observations FROM points, q WHERE n_raw_observations >= q")
def _(s, d):
    p = fuse(A.observations(s, d), VOXEL)
    q = p.agg(F.percentile("n_raw_observations", F.lit(0.03)).alias("q"))
    return p.crossJoin(F.broadcast(q)).where(c("n_raw_observations") >= c("q")).select("vx", "vy", "vz", "n_raw_observations")


@query("k14_valley_threshold", f"""WITH {SCORED_SQL}, h AS (SELECT b, coalesce(n, 0)::DOUBLE AS n FROM range(40) AS r(b) LEFT JOIN (SELECT least(floor(conf * 40), 39)::BIGINT AS b, count(*) AS n FROM points GROUP BY 1) USING (b)),
s AS (SELECT b, coalesce(lag(n) OVER (ORDER BY b), 0) * 0.25::DOUBLE + n * 0.5::DOUBLE + coalesce(lead(n) OVER (ORDER BY b), 0) * 0.25::DOUBLE AS s FROM h),
k AS (SELECT *, b BETWEEN 1 AND 38 AND s > lag(s) OVER (ORDER BY b) AND s > lead(s) OVER (ORDER BY b) AND s >= 0.05 * max(s) OVER () AS peak FROM s),
t AS (SELECT b, row_number() OVER (ORDER BY s DESC, b) AS rk FROM k WHERE peak), e AS (SELECT min(b) AS p1, max(b) AS p2, (SELECT count(*) FROM t) AS np FROM t WHERE rk <= 2),
v AS (SELECT arg_min(b, (s, b)) AS valley, any_value(np) AS np FROM k, e WHERE b BETWEEN p1 AND p2)
SELECT count(*) AS n, round(CASE WHEN count(*) >= 20 AND any_value(np) >= 2 THEN greatest(0.02, least(0.7, (any_value(valley) + 0.5::DOUBLE) / 40.0)) ELSE quantile_cont(conf, 0.2) END, 9) AS threshold FROM points, v""")
def _(s, d):
    return valley_threshold(scored(s, d), "confidence").select("n", r(c("threshold")).alias("threshold"))


@query("k15_frustum_fits", f"""WITH {OBS_SQL}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM obs),
l AS (SELECT 0 AS axis, (x - x0) / (x1 - x0) AS u, x1 - x0 AS span, y AS v0, z AS v1 FROM obs, e UNION ALL SELECT 1, (y - y0) / (y1 - y0), y1 - y0, x, z FROM obs, e UNION ALL SELECT 2, (z - z0) / (z1 - z0), z1 - z0, x, y FROM obs, e),
b AS (SELECT *, round((u - 0.1::DOUBLE) / (0.8::DOUBLE / 11))::INT AS band FROM l), k AS (SELECT axis, band, count(*) AS n, max(span) AS span, (quantile_cont(v0, 0.98) - quantile_cont(v0, 0.02)) / 2 AS w0, (quantile_cont(v1, 0.98) - quantile_cont(v1, 0.02)) / 2 AS w1 FROM b WHERE band BETWEEN 0 AND 11 AND abs(u - (0.1::DOUBLE + band * (0.8::DOUBLE / 11))) < 0.015::DOUBLE GROUP BY 1, 2 HAVING count(*) >= 40),
m AS (SELECT axis, span, false AS apex_at_max, (0.1::DOUBLE + band * (0.8::DOUBLE / 11)) * span AS d, w0, w1 FROM k UNION ALL SELECT axis, span, true, (1.0 - (0.1::DOUBLE + band * (0.8::DOUBLE / 11))) * span, w0, w1 FROM k),
c AS (SELECT axis, span, apex_at_max, d, 0 AS cross_axis, w0 AS w FROM m UNION ALL SELECT axis, span, apex_at_max, d, 1, w1 FROM m)
SELECT axis, apex_at_max, cross_axis, count(*) AS n_bands, round(regr_slope(w, d), 6) AS slope, round(regr_intercept(w, d), 6) AS intercept FROM c GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def _(s, d):
    f = frustum_fits(A.observations(s, d))
    return f.select("axis", "apex_at_max", "cross_axis", "n_bands", r(c("slope"), 6).alias("slope"), r(c("intercept"), 6).alias("intercept"))


QUERIES["k15_frustum_verdict"] = lambda s, d: frustum_verdict(A.observations(s, d), 84.0)
