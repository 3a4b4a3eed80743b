"""The stages from 2D keypoints to smooth 3D trajectories as one lazy plan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.operators import filters, series, tracking, triangulate


def trajectories(
    keypoints: DataFrame,
    cameras: list[tuple[int, np.ndarray]],
    trial_keys: list[str],
    rate: float,
    *,
    threshold: float = 15.0,
    least: int = 2,
    min_score: float = 0.3,
    longest_gap: int = 20,
    track: bool = False,
    outliers: bool = True,
    filter_name: str | None = "butterworth",
    filter_options: dict | None = None,
) -> DataFrame:
    """trial_keys, person_id, kpt_id, frame, x, y, z, error, n_excluded.

    Keypoints (trial_keys, cam_id, frame, person_id, kpt_id, x, y, score) are
    triangulated robustly; people may be tracked; gaps are interpolated up to
    ``longest_gap``, what is left keeps the last value; outliers are replaced and
    the trajectories filtered.  Interpolation, outliers and filter share the
    partitioning by series.
    """
    keys = [*trial_keys, "frame", "person_id", "kpt_id"]
    points = triangulate.robust_triangulation(keypoints, cameras, keys, threshold=threshold, least=least, min_score=min_score)
    if track:
        points = tracking.reidentify(points.drop("excluded_cams"), trial_keys).drop("person_id").withColumnRenamed("track_id", "person_id")
    rows = points
    own = [*trial_keys, "person_id", "kpt_id"]
    for axis in "xyz":
        rows = series.interpolate(rows, own, ["frame"], axis, "_filled", most=longest_gap, zero_missing=True)
        rows = series.fill_ends(rows, own, ["frame"], "_filled", axis).drop("_filled")
        if outliers:
            rows = series.hampel(rows, own, ["frame"], axis, "_filtered").withColumn(axis, F.col("_filtered")).drop("_filtered")
    if filter_name:
        rows = filters.smooth(rows, own, ["frame"], ["x", "y", "z"], filter_name, rate, **(filter_options or {}))
    return rows.select(*own, "frame", "x", "y", "z", "error", "n_excluded")
