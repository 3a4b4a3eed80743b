"""Projections and filters over keypoint and marker tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions.linalg import optimal_matrix, undistort

# Markers that the augmenter reads and writes, for legs and arms.
LOWER_FEATURES = ["Neck", "RShoulder", "LShoulder", "RHip", "LHip", "RKnee", "LKnee", "RAnkle", "LAnkle", "RHeel", "LHeel", "RSmallToe", "LSmallToe", "RBigToe", "LBigToe"]
LOWER_RESPONSES = [
    "r.ASIS_study", "L.ASIS_study", "r.PSIS_study", "L.PSIS_study", "r_knee_study", "r_mknee_study", "r_ankle_study", "r_mankle_study", "r_toe_study", "r_5meta_study", "r_calc_study", "L_knee_study", "L_mknee_study",
    "L_ankle_study", "L_mankle_study", "L_toe_study", "L_calc_study", "L_5meta_study", "r_shoulder_study", "L_shoulder_study", "C7_study", "r_thigh1_study", "r_thigh2_study", "r_thigh3_study", "L_thigh1_study",
    "L_thigh2_study", "L_thigh3_study", "r_sh1_study", "r_sh2_study", "r_sh3_study", "L_sh1_study", "L_sh2_study", "L_sh3_study", "RHJC_study", "LHJC_study",
]
UPPER_FEATURES = ["Neck", "RShoulder", "LShoulder", "RElbow", "LElbow", "RWrist", "LWrist"]
UPPER_RESPONSES = ["r_lelbow_study", "r_melbow_study", "r_lwrist_study", "r_mwrist_study", "L_lelbow_study", "L_melbow_study", "L_lwrist_study", "L_mwrist_study"]


def swapped_sides(keypoints: DataFrame, skeleton: DataFrame, keys: list[str]) -> DataFrame:
    """Each keypoint beside its partner's coordinates: x, y, score and swap_x, swap_y, swap_score."""
    partner = keypoints.select(*keys, F.col("kpt_id").alias("swap_kpt_id"), *(F.col(c).alias(f"swap_{c}") for c in ("x", "y", "score")))
    return keypoints.join(F.broadcast(skeleton.select("kpt_id", "swap_kpt_id")), "kpt_id", "left").join(partner, [*keys, "swap_kpt_id"], "left")


def subset(keypoints: DataFrame, skeleton: DataFrame, which: str | list[str]) -> DataFrame:
    """Keypoints named ``all``, ``right``, ``left`` or by a list of names."""
    if which == "all":
        return keypoints
    name = F.col("name")
    rule = {"right": name.startswith("R") | name.contains("right"), "left": name.startswith("L") | name.contains("left")}
    chosen = skeleton.filter(rule[which] if isinstance(which, str) else name.isin(which)).select("kpt_id")
    return keypoints.join(F.broadcast(chosen), "kpt_id", "left_semi")  # a skeleton's size


def inside_image(points: DataFrame, width: float, height: float, x: str = "x", y: str = "y") -> DataFrame:
    """Coordinates outside of the frame as NULL, both together."""
    ok = (F.col(x) >= 0) & (F.col(x) < width) & (F.col(y) >= 0) & (F.col(y) < height)
    return points.withColumns({x: F.when(ok, F.col(x)), y: F.when(ok, F.col(y))})


def require_markers(markers: DataFrame, names: list[str]) -> DataFrame:
    """``markers``, after an error if one of ``names`` does not occur."""
    have = {r.marker for r in markers.filter(F.col("marker").isin(names)).select("marker").distinct().collect()}  # at most len(names) rows
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"missing markers: {', '.join(missing)}")
    return markers


def undistorted(keypoints: DataFrame, cameras: dict[int, tuple], size_of: dict[int, tuple[float, float]]) -> DataFrame:
    """x and y without lens distortion; ``cameras`` maps cam_id to (K, distortion)."""
    new = {c: optimal_matrix(k, d, size_of[c]) for c, (k, d) in cameras.items()}

    @F.pandas_udf("struct<x:double,y:double>")
    def fix(cam: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = np.full((len(cam), 2), np.nan)
        for c in cam.unique():
            if c in cameras:
                own = (cam == c).to_numpy()
                k, d = cameras[c]
                out[own] = undistort(np.stack([x[own], y[own]], axis=-1).astype(float), np.asarray(k), np.asarray(d), new[c])
        return pd.DataFrame(out, columns=["x", "y"])

    rows = keypoints.withColumn("_u", fix("cam_id", F.col("x").cast("double"), F.col("y").cast("double")))
    return rows.withColumns({c: F.nanvl(F.col(f"_u.{c}"), F.lit(None).cast("double")) for c in ("x", "y")}).drop("_u")
