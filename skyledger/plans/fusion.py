"""Flagship: voxel fusion, confidence, band and gate."""

from __future__ import annotations

from skyledger.operators.voxel_fusion import fuse, score
from skyledger.sources.adapters import observations

VOXEL = 2.0

OBS_SQL = """obs AS (SELECT l_extendedprice / 1000.0::DOUBLE AS x, l_quantity AS y, l_tax * 100.0::DOUBLE AS z, l_suppkey AS frame_idx, l_discount AS view_angle,
  l_tax / 0.08::DOUBLE AS consistency, 0.5::DOUBLE + l_linenumber::DOUBLE / 14.0::DOUBLE AS frame_quality, (l_orderkey % 100)::DOUBLE / 100.0::DOUBLE AS pose_confidence FROM lineitem)"""
FUSED_SQL = f"""{OBS_SQL},
fused AS (SELECT CAST(FLOOR(x / 2.0) AS BIGINT) AS vx, CAST(FLOOR(y / 2.0) AS BIGINT) AS vy, CAST(FLOOR(z / 2.0) AS BIGINT) AS vz,
  AVG(x) AS x, AVG(y) AS y, AVG(z) AS z, AVG(consistency) AS consistency, AVG(frame_quality) AS frame_quality, AVG(pose_confidence) AS pose_confidence,
  COUNT(DISTINCT frame_idx) AS observation_count, MIN(view_angle) AS angle_min, MAX(view_angle) AS angle_max, MAX(view_angle) - MIN(view_angle) AS view_angle_spread, COUNT(*) AS n_raw_observations
  FROM obs GROUP BY 1, 2, 3)"""
SCORED_SQL = f"""{FUSED_SQL},
raw AS (SELECT *, exp(0.30 * ln(1.0 - exp(-(observation_count::DOUBLE - 1.0) / 1.5) + 1e-6) + 0.20 * ln(greatest(0.0, least(1.0, view_angle_spread / radians(6.0))) + 1e-6)
  + 0.25 * ln(greatest(0.0, least(1.0, consistency)) + 1e-6) + 0.15 * ln(greatest(0.0, least(1.0, frame_quality)) + 1e-6) + 0.10 * ln(greatest(0.0, least(1.0, pose_confidence)) + 1e-6)) AS c0 FROM fused),
scored AS (SELECT *, CASE WHEN observation_count <= 1 THEN least(c0, 0.55) ELSE c0 END AS conf FROM raw),
points AS (SELECT *, CASE WHEN conf >= 0.60 THEN 'High' WHEN conf >= 0.35 THEN 'Moderate' ELSE 'Low / insufficient observation' END AS band FROM scored)"""

COLS = ["vx", "vy", "vz", "observation_count", "n_raw_observations"]


def scored(s, d):
    return score(fuse(observations(s, d), VOXEL))


def flagship(s, d):
    from pyspark.sql import functions as F

    p = scored(s, d)
    rounded = [F.round(c, 9).alias(c) for c in ("x", "y", "z", "view_angle_spread", "confidence")]
    return p.select(*COLS, *rounded, "band", "single_view_capped", "keep", "densify", "flag_uncertain")


QUERIES = {"fa1_fa2_voxel_confidence": flagship}
SQL = {
    "fa1_fa2_voxel_confidence": f"""WITH {SCORED_SQL}
SELECT vx, vy, vz, observation_count, n_raw_observations, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, round(view_angle_spread, 9) AS view_angle_spread, round(conf, 9) AS confidence, band,
  observation_count <= 1 AS single_view_capped, conf >= 0.12 AS keep, conf >= 0.60 AS densify, conf >= 0.12 AND band <> 'High' AS flag_uncertain FROM points"""
}
