"""Five-signal confidence of a fused point, its band and its gate, as Column expressions.

Fixed values: weights .30/.20/.25/.15/.10, observation scale 1.5, angle target 6 degrees,
single-view cap .55, bands at .60 and .35, gate at .12 and .60.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = (0.30, 0.20, 0.25, 0.15, 0.10)
EPS = 1e-6
HIGH, MODERATE, LOW = "High", "Moderate", "Low / insufficient observation"


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def signals(n_obs: Column, spread: Column, consistency: Column, quality: Column, pose: Column, clamp_obs: bool = False) -> list[Column]:
    """The five scores in [0, 1]: observations, view angle, consistency, frame quality, pose."""
    extra = n_obs.cast("double") - 1.0
    if clamp_obs:
        extra = F.greatest(extra, F.lit(0.0))
    return [F.lit(1.0) - F.exp(-extra / 1.5), clip01(spread / math.radians(6.0)), clip01(consistency), clip01(quality), clip01(pose)]


def geometric(scores: list[Column]) -> Column:
    total = F.lit(0.0)
    for w, s in zip(WEIGHTS, scores, strict=True):
        total = total + F.lit(w) * F.log(s + EPS)
    return F.exp(total)


def confidence(n_obs: Column, spread: Column, consistency: Column, quality: Column, pose: Column, clamp_obs: bool = False) -> Column:
    c = geometric(signals(n_obs, spread, consistency, quality, pose, clamp_obs))
    return F.when(n_obs <= 1, F.least(c, F.lit(0.55))).otherwise(c)


def band(conf: Column) -> Column:
    return F.when(conf >= 0.60, HIGH).when(conf >= 0.35, MODERATE).otherwise(LOW)


def keep(conf: Column) -> Column:
    return conf >= 0.12


def densify(conf: Column) -> Column:
    return conf >= 0.60
