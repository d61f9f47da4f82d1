"""Camera, frame and geodesy mathematics as Column expressions (radians and metres, Z up, X east, Y north)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

M_PER_DEG = 110540.0  # fixed value: metres of one degree of latitude
EARTH_R = 6371000.0  # fixed value: radius of the sphere of the haversine formula
SH0 = 0.28209479  # fixed value: zeroth spherical-harmonic coefficient

Vec = tuple[Column, Column, Column]
Mat = dict[str, Column]  # "00".."22"


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


# --- intrinsics ---------------------------------------------------------------------------


def focal_from_hfov(width: Column, hfov_deg: Column) -> Column:
    return (width.cast("double") / 2.0) / F.tan(F.radians(hfov_deg) / 2.0)


def hfov_from_focal(width: Column, fx: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(width.cast("double") / (F.lit(2.0) * fx)))


def vfov_from_hfov(hfov_deg: Column, width: Column, height: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.tan(F.radians(hfov_deg) / 2.0) * height.cast("double") / width.cast("double")))


def zoomed_focal(fx: Column, focal: Column, focal0: Column) -> Column:
    """Focal length in pixels of a zoomed frame; unchanged where the first focal length is unknown or 0."""
    return F.when(focal0 > 1e-6, fx * focal / focal0).otherwise(fx)


# --- rotations and poses ------------------------------------------------------------------


def euler_matrix(yaw: Column, pitch: Column, roll: Column) -> Mat:
    """Body-to-world rotation, yaw then pitch then roll; a negative pitch turns the nose down."""
    cy, sy, cp, sp, cr, sr = F.cos(yaw), F.sin(yaw), F.cos(pitch), F.sin(pitch), F.cos(roll), F.sin(roll)
    return {
        "00": cy * cp,
        "01": -cy * sp * sr - sy * cr,
        "02": -cy * sp * cr + sy * sr,
        "10": sy * cp,
        "11": -sy * sp * sr + cy * cr,
        "12": -sy * sp * cr - cy * sr,
        "20": sp,
        "21": cp * sr,
        "22": cp * cr,
    }


def camera_pose(yaw: Column, pitch: Column, roll: Column) -> Mat:
    """Camera-to-world rotation of a flight attitude: the optical axis is body X, the image's right body Y, its down -Z."""
    r = euler_matrix(yaw, pitch, roll)
    return {f"{i}{j}": c for i in range(3) for j, c in enumerate((r[f"{i}1"], -r[f"{i}2"], r[f"{i}0"]))}


def to_camera(r: Mat, p: Vec, c: Vec) -> Vec:
    d = [p[i] - c[i] for i in range(3)]
    return tuple(d[0] * r[f"0{j}"] + d[1] * r[f"1{j}"] + d[2] * r[f"2{j}"] for j in range(3))  # type: ignore[return-value]


def to_world(r: Mat, p: Vec, c: Vec) -> Vec:
    return tuple(p[0] * r[f"{i}0"] + p[1] * r[f"{i}1"] + p[2] * r[f"{i}2"] + c[i] for i in range(3))  # type: ignore[return-value]


def invert_pose(r: Mat, t: Vec) -> tuple[Mat, Vec]:
    """World-to-camera rotation and translation to camera-to-world rotation and centre."""
    rt = {f"{i}{j}": r[f"{j}{i}"] for i in range(3) for j in range(3)}
    pos = tuple(-(r[f"0{i}"] * t[0] + r[f"1{i}"] * t[1] + r[f"2{i}"] * t[2]) for i in range(3))
    return rt, pos  # type: ignore[return-value]


def project(p: Vec, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    z = F.when(F.abs(p[2]) < 1e-6, F.lit(1e-6)).otherwise(p[2])
    return fx * p[0] / z + cx, fy * p[1] / z + cy


def ray(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    return (u - cx) / fx, (v - cy) / fy


def pixel_angle(rx: Column, ry: Column) -> Column:
    return F.acos(F.lit(1.0) / F.sqrt(rx * rx + ry * ry + 1.0))


def ray_angle(axis: Vec, d: Vec) -> Column:
    """Angle between the optical axis and a direction; 0 for a direction shorter than 1e-9."""
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    dot = (axis[0] * d[0] + axis[1] * d[1] + axis[2] * d[2]) / F.when(n < 1e-9, F.lit(1.0)).otherwise(n)
    return F.when(n < 1e-9, F.lit(0.0)).otherwise(F.acos(clip(dot, -1.0, 1.0)))


# --- geodesy ------------------------------------------------------------------------------


def to_enu(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return (lon - lon0) * M_PER_DEG * F.cos(F.radians(lat0)), (lat - lat0) * M_PER_DEG


def from_enu(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return lat0 + y / M_PER_DEG, lon0 + x / (F.lit(M_PER_DEG) * F.cos(F.radians(lat0)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), 2)
    return F.lit(2.0 * EARTH_R) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def valid_gps(lat: Column, lon: Column) -> Column:
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


# --- Gaussians ----------------------------------------------------------------------------


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> Mat:
    n = F.greatest(F.sqrt(w * w + x * x + y * y + z * z), F.lit(1e-12))
    w, x, y, z = w / n, x / n, y / n, z / n
    two, one = F.lit(2.0), F.lit(1.0)
    return {
        "00": one - two * (y * y + z * z),
        "01": two * (x * y - w * z),
        "02": two * (x * z + w * y),
        "10": two * (x * y + w * z),
        "11": one - two * (x * x + z * z),
        "12": two * (y * z - w * x),
        "20": two * (x * z - w * y),
        "21": two * (y * z + w * x),
        "22": one - two * (x * x + y * y),
    }


def thin_axis(s: Vec) -> Column:
    """Index of the smallest scale; the first of equal ones."""
    return F.when((s[0] <= s[1]) & (s[0] <= s[2]), 0).when(s[1] <= s[2], 1).otherwise(2)


def normal(r: Mat, s: Vec) -> Vec:
    k = thin_axis(s)
    return tuple(F.when(k == 0, r[f"{i}0"]).when(k == 1, r[f"{i}1"]).otherwise(r[f"{i}2"]) for i in range(3))  # type: ignore[return-value]


def anisotropy(s: Vec) -> Column:
    return F.greatest(*s) / F.greatest(F.least(*s), F.lit(1e-9))


def sh_to_color(dc: Column) -> Column:
    return clip(dc * SH0 + 0.5, 0.0, 1.0)


def color_to_sh(c: Column) -> Column:
    return (c - 0.5) / SH0


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def logit(c: Column) -> Column:
    return F.log(c / (F.lit(1.0) - c))


def initial_opacity(conf: Column) -> Column:
    return clip(F.lit(0.5) * (F.lit(0.3) + F.lit(0.7) * conf), 1e-4, 1 - 1e-4)


# --- scores and labels --------------------------------------------------------------------


def pose_confidence_std(std: Column) -> Column:
    return clip(F.lit(1.0) - std / 4.0, 0.0, 1.0)


def pose_confidence_residual(res: Column) -> Column:
    return clip(F.lit(1.0) - res / 3.0, 0.0, 1.0)


def pose_confidence_relative(res: Column, median: Column) -> Column:
    return clip(F.lit(1.0) - res / (F.lit(3.0) * F.greatest(median, F.lit(0.5))), 0.05, 1.0)


def quality_overall(blur: Column, exposure: Column, compression: Column, coverage: Column) -> Column:
    return clip(F.lit(0.40) * blur + F.lit(0.20) * exposure + F.lit(0.20) * compression + F.lit(0.20) * coverage, 0.0, 1.0)


def compass(dx: Column, dy: Column) -> Column:
    """The side of the centre a place lies on; a side counts from atan(.4) off the other axis, and within a micrometre there is none."""
    from_axis = F.atan2(F.abs(dy), F.abs(dx))
    least = math.atan(0.4)
    upright = F.when(from_axis >= least, F.when(dy > 0, "north").otherwise("south")).otherwise("")
    sideways = F.when(from_axis <= math.pi / 2 - least, F.when(dx > 0, "east").otherwise("west")).otherwise("")
    return F.when(F.greatest(F.abs(dx), F.abs(dy)) < 1e-6, "central").otherwise(F.concat(upright, sideways))


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
