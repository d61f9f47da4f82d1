"""Similarity alignment of paired points, pose chains and keyframe chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def pair_sums(df: DataFrame, src: tuple[str, str, str], dst: tuple[str, str, str]) -> DataFrame:
    """One row with everything a similarity fit needs: count, means, variance of the source, cross-covariance."""
    means = [F.avg(a).alias(f"m_{a}") for a in (*src, *dst)]
    var = sum((F.avg(c(a) * c(a)) - F.avg(a) * F.avg(a) for a in src[1:]), F.avg(c(src[0]) * c(src[0])) - F.avg(src[0]) * F.avg(src[0]))
    cross = [(F.avg(c(b) * c(a)) - F.avg(b) * F.avg(a)).alias(f"k_{j}{i}") for j, b in enumerate(dst) for i, a in enumerate(src)]
    return df.dropna(subset=[*src, *dst]).agg(F.count(F.lit(1)).alias("n"), *means, var.alias("var"), *cross)


def similarity(df: DataFrame, src: tuple[str, str, str], dst: tuple[str, str, str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(scale, rotation, translation) that maps the source points best onto their partners; at least three pairs.

    The pairs are reduced to one row in the cluster; only that row's 3x3 decomposition is done here.
    """
    r = pair_sums(df, src, dst).first()
    if r["n"] < 3:
        raise ValueError("a similarity needs at least three pairs")
    k = np.array([[r[f"k_{j}{i}"] for i in range(3)] for j in range(3)])
    u, s, vt = np.linalg.svd(k)
    sign = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    rot = u @ sign @ vt
    scale = float(np.trace(np.diag(s) @ sign) / r["var"])
    ms, md = (np.array([r[f"m_{a}"] for a in names]) for names in (src, dst))
    return scale, rot, md - scale * rot @ ms


def planar_chain(key: str, order: str, turn: Column, step: Column) -> dict[str, Column]:
    """Heading and position of a chain of relative poses (turn, then step ahead), as running sums."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    heading = F.sum(turn).over(w)
    return {"heading": heading, "_dx": step * F.cos(heading), "_dy": step * F.sin(heading)}


def keyframe_chain(df: DataFrame, key: str, order: str, quality: str, max_gap: int = 3, least: float = 0.5) -> DataFrame:
    """(key, order) of the greedy chain: from each keyframe the nearest next row within `max_gap` that is good enough.

    The chain of a key ends where none is. Rows stream by in order inside hash partitions; only the
    last keyframe is remembered.
    """
    rows = df.select(key, order, quality).dropna().repartition(key).sortWithinPartitions(key, order)
    t = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, gap = None, 0
        for pdf in batches:
            out = []
            for k, o, q in pdf.itertuples(index=False):
                if k != current:
                    current, gap = k, 0
                    out.append((k, o))
                    continue
                gap += 1
                if gap <= max_gap and q >= least:
                    gap = 0
                    out.append((k, o))
            yield pd.DataFrame(out, columns=[key, order])

    return rows.mapInPandas(run, f"{key} {t[key]}, {order} {t[order]}")
