"""Queries over training histories and model decisions: windows, JSON validation, set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions.decisions import evaluation_report, frame_decision, reconstruction_decision, training_control
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


H = """h AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 500 AS iter, value / 500 AS ssim, value / 10 AS psnr, CASE WHEN event_id % 3 <> 0 THEN value / 1000 END AS lpips, event_id + 1000 AS n_gaussians FROM events),
b AS (SELECT *, max(ssim) OVER w AS best, min(lpips) OVER w AS best_lpips, arg_max(iter, (ssim, -iter)) OVER w AS best_iter, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY run ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def history(s, d):
    w = W.partitionBy("run").orderBy("iter").rowsBetween(W.unboundedPreceding, 0)
    h = A.checkpoints(s, d)
    return h.withColumns({"best": F.max("ssim").over(w), "best_lpips": F.min("lpips").over(w), "best_iter": F.max_by("iter", F.struct("ssim", -c("iter"))).over(w), "n": F.count(F.lit(1)).over(w)})


@query("g12_running_best", f"WITH {H} SELECT run, iter, best AS best_ssim, best_lpips, best_iter FROM b")
def _(s, d):
    return history(s, d).select("run", "iter", c("best").alias("best_ssim"), "best_lpips", "best_iter")


@query("g13_running_mean", f"WITH {H} SELECT run, iter, round(avg(psnr) OVER (PARTITION BY run ORDER BY iter ROWS 9 PRECEDING), 9) AS mean_psnr FROM h")
def _(s, d):
    return A.checkpoints(s, d).select("run", "iter", r(F.avg("psnr").over(W.partitionBy("run").orderBy("iter").rowsBetween(-9, 0))).alias("mean_psnr"))


@query("g14_staleness", f"WITH {H} SELECT run, iter, (iter - best_iter) // 500 AS stale_checkpoints, CASE WHEN n >= 3 THEN ssim < best * 0.97::DOUBLE END AS declining FROM b")
def _(s, d):
    return history(s, d).select("run", "iter", F.floor((c("iter") - c("best_iter")) / 500).cast("bigint").alias("stale_checkpoints"), F.when(c("n") >= 3, c("ssim") < c("best") * 0.97).alias("declining"))


@query("g15_last_ten", f"WITH {H} SELECT run, iter, ssim FROM h QUALIFY row_number() OVER (PARTITION BY run ORDER BY iter DESC) <= 10")
def _(s, d):
    """The history window a decision sees: a run's last ten checkpoints."""
    w = W.partitionBy("run").orderBy(c("iter").desc())
    return A.checkpoints(s, d).withColumn("k", F.row_number().over(w)).where("k <= 10").select("run", "iter", "ssim")


@query("g18_attempt_counter", "SELECT user_id, event_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS errors_before FROM events")
def _(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return table(s, d, "events").select("user_id", "event_id", F.count(F.when(c("event_type") == "error", 1)).over(w).alias("errors_before"))


@query("fa33_checkpoint_means", f"WITH {H} SELECT run, count(*) AS n, round(avg(psnr), 9) AS psnr, round(avg(ssim), 9) AS ssim, round(avg(lpips), 9) AS lpips FROM h GROUP BY 1")
def _(s, d):
    return A.checkpoints(s, d).groupBy("run").agg(F.count(F.lit(1)).alias("n"), *[r(F.avg(m)).alias(m) for m in ("psnr", "ssim", "lpips")])


@query("fa31_stage_totals", "SELECT user_id AS run, round(sum(value), 4) AS total, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view FROM events GROUP BY 1")
def _(s, d):
    n = lambda t: F.count(F.when(c("event_type") == t, 1))
    return table(s, d, "events").groupBy(c("user_id").alias("run")).agg(F.round(F.sum("value"), 4).alias("total"), n("click").alias("n_click"), n("view").alias("n_view"))


RAW = """e AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '{"action":"retry","keep_fraction":' || value || ',"min_overall":0.2,"depth_min":5,"depth_max":3,"agent_confidence":0.9}' WHEN 1 THEN '```json' || chr(10) || '{"action":"accept","keep_fraction":0.5,"voxel_size":' || value || '}' || chr(10) || '```' WHEN 2 THEN 'no json here' WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{"__error__":"timeout"}' WHEN 5 THEN '{"action":"explode","keep_fraction":"0.6","agent_confidence":"high"}' WHEN 6 THEN '{"keep_fraction":0.01,"min_overall":0.9,"prune_below":0.8,"densify_above":0.4}' ELSE '{"action":"flag_and_accept","keep_fraction":0.8,"n_depths":200}' END AS raw FROM events)"""


def raw_decisions(s, d):
    k, v = F.pmod("event_id", F.lit(8)), c("value").cast("string")
    cat = F.concat
    raw = (
        F.when(k == 0, cat(F.lit('{"action":"retry","keep_fraction":'), v, F.lit(',"min_overall":0.2,"depth_min":5,"depth_max":3,"agent_confidence":0.9}')))
        .when(k == 1, cat(F.lit('```json\n{"action":"accept","keep_fraction":0.5,"voxel_size":'), v, F.lit("}\n```")))
        .when(k == 2, "no json here")
        .when(k == 3, "[1, 2]")
        .when(k == 4, '{"__error__":"timeout"}')
        .when(k == 5, '{"action":"explode","keep_fraction":"0.6","agent_confidence":"high"}')
        .when(k == 6, '{"keep_fraction":0.01,"min_overall":0.9,"prune_below":0.8,"densify_above":0.4}')
        .otherwise('{"action":"flag_and_accept","keep_fraction":0.8,"n_depths":200}')
    )
    return table(s, d, "events").select("event_id", raw.alias("raw"))


CLEAN = RAW + r""", o AS (SELECT event_id, regexp_replace(raw, '^```(?:json)?\s*|\s*```$', '', 'g') AS t FROM e), j AS (SELECT event_id, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' AND json_extract_string(t, '$.__error__') IS NULL THEN t::JSON END AS o FROM o)"""


@query("j8_j9_j10_j11_l5_frame_decision", f"WITH {CLEAN}, f AS (SELECT event_id, o IS NOT NULL AS valid, coalesce(try_cast(o->>'keep_fraction' AS DOUBLE), 0.75) AS kf, coalesce(try_cast(o->>'min_overall' AS DOUBLE), 0.15) AS mo FROM j) SELECT event_id, valid, greatest(0.3, least(1.0, kf))::DOUBLE AS keep_fraction, greatest(0.0, least(0.5, mo))::DOUBLE AS min_overall, ((valid AND (kf < 0.3 OR kf > 1))::INT + (valid AND (mo < 0 OR mo > 0.5))::INT + (NOT valid)::INT)::BIGINT AS n_warnings FROM f")
def _(s, d):
    x = frame_decision(raw_decisions(s, d), "raw")
    return x.select("event_id", "valid", "keep_fraction", "min_overall", F.size("warnings").cast("bigint").alias("n_warnings"))


@query("j12_j13_l5_reconstruction_decision", f"""WITH {CLEAN}, f AS (SELECT event_id, o IS NOT NULL AS valid, CASE WHEN o->>'action' IN ('accept', 'retry', 'flag_and_accept') THEN o->>'action' ELSE 'accept' END AS action, greatest(0.3, least(10.0, try_cast(o->>'voxel_size' AS DOUBLE))) AS vs0, try_cast(o->>'voxel_size' AS DOUBLE) AS vsr,
greatest(0.3, least(500.0, try_cast(o->>'depth_min' AS DOUBLE))) AS dmin, greatest(1.0, least(1000.0, try_cast(o->>'depth_max' AS DOUBLE))) AS dmax, try_cast(o->>'depth_min' AS DOUBLE) AS dminr, try_cast(o->>'depth_max' AS DOUBLE) AS dmaxr, try_cast(o->>'prune_below' AS DOUBLE) AS pb, try_cast(o->>'densify_above' AS DOUBLE) AS da, try_cast(o->>'n_depths' AS DOUBLE) AS nd, try_cast(o->>'agent_confidence' AS DOUBLE) AS ac FROM j)
SELECT event_id, valid, action, CASE WHEN vsr IS NOT NULL THEN vs0::DOUBLE END AS voxel_size, CASE WHEN dminr IS NOT NULL AND NOT coalesce(dmaxr IS NOT NULL AND dmin >= dmax, false) THEN dmin::DOUBLE END AS depth_min, CASE WHEN dmaxr IS NOT NULL AND NOT coalesce(dminr IS NOT NULL AND dmin >= dmax, false) THEN dmax::DOUBLE END AS depth_max,
CASE WHEN pb IS NOT NULL AND NOT coalesce(greatest(0, least(0.9, pb)) >= greatest(0.1, least(1, da)), false) THEN greatest(0, least(0.9, pb))::DOUBLE END AS prune_below, CASE WHEN nd IS NOT NULL THEN greatest(8, least(96, round_even(nd, 0)))::BIGINT END AS n_depths, CASE WHEN NOT valid THEN 0.0 ELSE greatest(0, least(1, coalesce(ac, 0.5))) END::DOUBLE AS agent_confidence FROM f""")
def _(s, d):
    x = reconstruction_decision(raw_decisions(s, d), "raw")
    return x.select("event_id", "valid", "action", "voxel_size", "depth_min", "depth_max", "prune_below", c("n_depths").cast("bigint").alias("n_depths"), "agent_confidence")


REPORTS = """e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"verdict":"accept","diagnosis":"' || repeat(event_type || ' ', 500) || '","suggested_next_step":"hold"}' WHEN 1 THEN '```json' || chr(10) || '{"verdict":"maybe","diagnosis":7}' || chr(10) || '```'
WHEN 2 THEN 'prose' WHEN 3 THEN '{"action":"early_stop","reasoning":"' || repeat('flat ', 300) || '","agent_confidence":' || value || '}' WHEN 4 THEN '{"__error__":"timeout"}' ELSE '{"verdict":"reject","action":"explode","agent_confidence":"high"}' END AS raw FROM events),
o AS (SELECT event_id, regexp_replace(raw, '^```(?:json)?\\s*|\\s*```$', '', 'g') AS t FROM e), j AS (SELECT event_id, CASE WHEN json_valid(t) AND json_extract_string(t, '$.__error__') IS NULL THEN t::JSON END AS o FROM o)"""


def raw_reports(s, d):
    k = F.pmod("event_id", F.lit(6))
    raw = (
        F.when(k == 0, F.concat(F.lit('{"verdict":"accept","diagnosis":"'), F.repeat(F.concat("event_type", F.lit(" ")), F.lit(500)), F.lit('","suggested_next_step":"hold"}')))
        .when(k == 1, '```json\n{"verdict":"maybe","diagnosis":7}\n```')
        .when(k == 2, "prose")
        .when(k == 3, F.concat(F.lit('{"action":"early_stop","reasoning":"'), F.repeat(F.lit("flat "), F.lit(300)), F.lit('","agent_confidence":'), c("value").cast("string"), F.lit("}")))
        .when(k == 4, '{"__error__":"timeout"}')
        .otherwise('{"verdict":"reject","action":"explode","agent_confidence":"high"}')
    )
    return table(s, d, "events").select("event_id", raw.alias("raw"))


@query("l5_evaluation_report", f"""WITH {REPORTS} SELECT event_id, o IS NOT NULL AS valid, CASE WHEN o->>'verdict' IN ('accept', 'needs_more_data', 'reject') THEN o->>'verdict' ELSE 'needs_more_data' END AS verdict,
CASE WHEN json_type(o, '$.diagnosis') = 'VARCHAR' THEN left(o->>'diagnosis', 2000) ELSE '' END AS diagnosis, CASE WHEN json_type(o, '$.suggested_next_step') = 'VARCHAR' THEN left(o->>'suggested_next_step', 500) ELSE '' END AS suggested_next_step,
(o IS NULL OR NOT coalesce(o->>'verdict' IN ('accept', 'needs_more_data', 'reject'), false))::BIGINT AS n_warnings FROM j""")
def _(s, d):
    x = evaluation_report(raw_reports(s, d), "raw")
    return x.select("event_id", "valid", "verdict", "diagnosis", "suggested_next_step", F.size("warnings").cast("bigint").alias("n_warnings"))


@query("l5_training_control", f"""WITH {REPORTS}, v AS (SELECT *, coalesce(try_cast(o->>'agent_confidence' AS DOUBLE), 0.5) AS ac FROM j) SELECT event_id, o IS NOT NULL AS valid, CASE WHEN o->>'action' IN ('continue', 'stop_densifying', 'early_stop') THEN o->>'action' ELSE 'continue' END AS action,
CASE WHEN json_type(o, '$.reasoning') = 'VARCHAR' THEN left(o->>'reasoning', 800) ELSE '' END AS reasoning, CASE WHEN o IS NULL THEN 0.0 ELSE greatest(0, least(1, ac)) END::DOUBLE AS agent_confidence,
CASE WHEN o IS NULL THEN 1 ELSE (NOT coalesce(o->>'action' IN ('continue', 'stop_densifying', 'early_stop'), false))::INT + (o->>'agent_confidence' IS NOT NULL AND try_cast(o->>'agent_confidence' AS DOUBLE) IS NULL)::INT + (ac < 0 OR ac > 1)::INT END::BIGINT AS n_warnings FROM v""")
def _(s, d):
    x = training_control(raw_reports(s, d), "raw")
    return x.select("event_id", "valid", "action", "reasoning", "agent_confidence", F.size("warnings").cast("bigint").alias("n_warnings"))


@query("j15_apply_overrides", f"WITH {CLEAN} SELECT event_id, coalesce(greatest(0.3, least(10.0, try_cast(o->>'voxel_size' AS DOUBLE))), 0.4)::DOUBLE AS voxel_size FROM j WHERE o->>'voxel_size' IS NOT NULL")
def _(s, d):
    """A decision's non-null fields replace the configuration's."""
    x = reconstruction_decision(raw_decisions(s, d), "raw").where("voxel_size is not null")
    return x.select("event_id", F.coalesce("voxel_size", F.lit(0.4)).alias("voxel_size"))


@query("i5_i6_set_operations", "SELECT 'intersect' AS op, count(*) AS n FROM (SELECT l_suppkey % 500 AS k FROM lineitem INTERSECT SELECT o_custkey % 700 FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey % 700 AS k FROM orders EXCEPT SELECT l_suppkey % 500 FROM lineitem) UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT l_suppkey % 500 FROM lineitem)")
def _(s, d):
    a = table(s, d, "lineitem").select((c("l_suppkey") % 500).alias("k"))
    b = table(s, d, "orders").select((c("o_custkey") % 700).alias("k"))
    n = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return n("intersect", a.intersect(b)).unionByName(n("except", b.subtract(a))).unionByName(n("distinct", a.distinct()))


@query("f_cube_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 9) AS mean_quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_quantity")).alias("mean_quantity"))


@query("d20_bounds_match", "SELECT flight_id, coalesce(greatest(" + ", ".join(f"abs({f}({a}) - {f}({a}) FILTER (WHERE gps_used))" for f in ("min", "max") for a in ("pos_x", "pos_y", "pos_z")) + ") <= 0.5, false) AS matches FROM fused_pose GROUP BY 1")
def _(s, d):
    """Whether the bounds of the poses with a position fix are those of all poses, to half a metre; a flight without fixes has none."""
    off = [F.abs(f(a) - f(F.when(c("gps_used"), c(a)))) for f in (F.min, F.max) for a in ("pos_x", "pos_y", "pos_z")]
    return table(s, d, "fused_pose").groupBy("flight_id").agg(F.coalesce(F.greatest(*off) <= 0.5, F.lit(False)).alias("matches"))
