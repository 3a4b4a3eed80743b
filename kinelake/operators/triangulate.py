"""Triangulation of 2D observations to 3D, with a search over excluded cameras.

Observations are rows (keys..., cam_id, x, y, score).  Each point's cameras are
gathered into arrays (one short array for each camera of a rig, so a group is
bounded by the rig), and a vectorised function evaluates all camera subsets of a
level at once: a removed camera has weight zero, which leaves the null vector of
the system unchanged.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.linalg import reprojection_error, triangulate

#: Points handled at a time, so that the systems of all subsets stay small.
CHUNK = 2048


def camera_subsets(n: int, removed: int) -> np.ndarray:
    """All ways to remove ``removed`` of ``n`` cameras, in lexicographic order: rows of booleans, true for removed."""
    out = np.zeros((0, n), dtype=bool)
    rows = []
    for c in itertools.combinations(range(n), removed):
        row = np.zeros(n, dtype=bool)
        row[list(c)] = True
        rows.append(row)
    return np.array(rows) if rows else out


def robust(p: np.ndarray, x: np.ndarray, y: np.ndarray, score: np.ndarray, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, errors and excluded cameras (B, C) by the level-ordered search.

    Level k removes k cameras more.  A level runs while the last error exceeds the
    threshold and enough cameras are left; it ends the search unevaluated if in
    one of its subsets more cameras are unusable than may be missing.  The first
    subset of least error represents its level.  A final error over the threshold
    clears point and error, but the last level's exclusions remain.
    """
    b, n = x.shape
    missing = ~(np.isfinite(x) & np.isfinite(y) & np.isfinite(score) & (score > 0))
    point, error, excluded = np.full((b, 3), np.nan), np.full(b, np.inf), np.ones((b, n), dtype=bool)
    open_ = np.ones(b, dtype=bool)
    for level in range(max(0, n - least) + 1):
        subsets = camera_subsets(n, level)
        off = missing[:, None, :] | subsets[None]
        open_ &= (error > threshold) & (off.sum(axis=2).max(axis=1) <= n - least)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        weight = np.where(off[at], 0.0, np.nan_to_num(score[at])[:, None, :])
        xs, ys = (np.broadcast_to(v[at][:, None, :], weight.shape) for v in (x, y))
        q = triangulate(p, xs, ys, weight)
        e = reprojection_error(p, q, np.nan_to_num(xs), np.nan_to_num(ys), ~off[at])
        e = np.where(np.isfinite(e), e, np.inf)
        best = e.argmin(axis=1)
        take = np.arange(len(at))
        point[at], error[at], excluded[at] = q[take, best], e[take, best], off[at][take, best]
    failed = ~(error <= threshold)
    point[failed], error[failed] = np.nan, np.nan
    return point, error, excluded


def robust_triangulation(
    observations: DataFrame,
    cameras: list[tuple[int, np.ndarray]],
    keys: list[str],
    *,
    threshold: float = 15.0,
    least: int = 2,
    min_score: float = 0.3,
) -> DataFrame:
    """keys, x, y, z, error, n_excluded, excluded_cams for every point in ``observations``.

    ``cameras`` lists (cam_id, projection matrix) of the rig; observations of
    other cameras are ignored, missing ones and those below ``min_score`` count
    as unusable.  Points that no camera set explains have NULL coordinates.
    """
    ids = [c for c, _ in cameras]
    p = np.stack([np.asarray(m, dtype=float) for _, m in cameras])
    at = F.array_position(F.array(*[F.lit(c) for c in ids]), F.col("cam_id")).cast("int")
    seen = observations.filter(F.col("cam_id").isin(ids)).select(*keys, F.struct(at.alias("c"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("score").cast("double").alias("s")).alias("o"))
    gathered = seen.groupBy(*keys).agg(F.collect_list("o").alias("seen"))

    @F.pandas_udf("struct<x:double,y:double,z:double,error:double,excluded_cams:array<int>>")
    def solve(column):
        import pandas as pd

        n, c = len(column), len(ids)
        x, y, s = (np.full((n, c), np.nan) for _ in range(3))
        for i, obs in enumerate(column):
            for o in obs:
                if o["s"] is not None and o["s"] >= min_score and o["x"] is not None and o["y"] is not None:
                    j = o["c"] - 1
                    x[i, j], y[i, j], s[i, j] = o["x"], o["y"], o["s"]
        parts = [robust(p, x[i : i + CHUNK], y[i : i + CHUNK], s[i : i + CHUNK], threshold, least) for i in range(0, n, CHUNK)]
        q, e, off = (np.concatenate([part[k] for part in parts]) for k in range(3))
        gone = [[ids[j] for j in np.flatnonzero(row)] for row in off]
        return pd.DataFrame({"x": q[:, 0], "y": q[:, 1], "z": q[:, 2], "error": e, "excluded_cams": gone})

    solved = gathered.withColumn("s", solve("seen"))
    number = lambda c: F.when(~F.isnan(F.col(f"s.{c}")), F.col(f"s.{c}")).alias(c)
    return solved.select(*keys, *(number(c) for c in ("x", "y", "z", "error")), F.size("s.excluded_cams").alias("n_excluded"), F.col("s.excluded_cams").alias("excluded_cams"))


def observe(points: DataFrame, cameras: list[tuple[int, np.ndarray]], keys: list[str], xyz: list[str] | None = None) -> DataFrame:
    """Each point as every camera sees it: keys, cam_id, x, y, score 1."""
    xyz = xyz or ["x", "y", "z"]
    cells = []
    for cam, m in cameras:
        row = lambda r: F.col(xyz[0]) * float(r[0]) + F.col(xyz[1]) * float(r[1]) + F.col(xyz[2]) * float(r[2]) + float(r[3])
        depth = row(m[2])
        cells.append(F.struct(F.lit(cam).alias("cam_id"), F.try_divide(row(m[0]), depth).alias("x"), F.try_divide(row(m[1]), depth).alias("y"), F.lit(1.0).alias("score")))
    return points.select(*keys, F.explode(F.array(*cells)).alias("o")).select(*keys, "o.*")


def error_recap(points: DataFrame, by: list[str], error: str = "error") -> DataFrame:
    """Mean error for each group and overall (rollup)."""
    return points.rollup(*by).agg(F.avg(error).alias("mean_error"), F.count(error).alias("n"))


def in_metres(pixels: Column, camera_distance: float, focal: float) -> Column:
    """A pixel error as a length at the subject, by the first camera's distance and focal length."""
    return pixels * camera_distance / focal


def camera_exclusion_rate(points: DataFrame, cameras: list[int]) -> DataFrame:
    """For each camera, in how many of the points it was left out, most often first."""
    total = points.agg(F.count("*").alias("total"))
    rows = points.select(F.explode("excluded_cams").alias("cam_id")).groupBy("cam_id").agg(F.count("*").alias("n_excluded"))
    every = points.sparkSession.createDataFrame([(c,) for c in cameras], "cam_id int")
    joined = every.join(rows, "cam_id", "left").join(F.broadcast(total))  # one row
    return joined.select("cam_id", F.coalesce("n_excluded", F.lit(0)).alias("n_excluded"), F.try_divide(F.coalesce("n_excluded", F.lit(0)), F.col("total")).alias("rate")).orderBy(F.desc("rate"), "cam_id")


def subset_table(spark: SparkSession, n: int, most_removed: int) -> DataFrame:
    """Camera subsets as bit masks: mask (removed cameras), removed."""
    masks = spark.range(1 << n).select(F.col("id").cast("int").alias("mask")).withColumn("removed", F.bit_count("mask").cast("int"))
    return masks.filter(F.col("removed") <= most_removed)
