"""Synchronising cameras by the vertical speed of one person's keypoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.operators import series


def vertical_activity(keypoints: DataFrame, camera_keys: list[str], frame: str, kpts: list[int] | None = None) -> DataFrame:
    """camera_keys, frame, activity: sum over keypoints of the absolute vertical speed."""
    rows = keypoints if kpts is None else keypoints.filter(F.col("kpt_id").isin(kpts))
    moved = series.speed(rows, [*camera_keys, "kpt_id"], [frame], "y", "speed", missing_factor=2.0)
    return moved.groupBy(*camera_keys, frame).agg(F.sum(F.abs("speed")).alias("activity"))


def search_window(activity: DataFrame, cameras: DataFrame, frame: str, half_width: int) -> DataFrame:
    """Activity within ``half_width`` frames of each camera's ``centre``, clamped to its frames."""
    last = activity.groupBy("cam_id").agg(F.max(frame).alias("_last"))
    bounds = cameras.join(last, "cam_id").select("cam_id", F.greatest(F.col("centre") - half_width, F.lit(0)).alias("_a"), F.least(F.col("centre") + half_width, F.col("_last")).alias("_b"))
    return activity.join(bounds, "cam_id").filter(F.col(frame).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def offsets(activity: DataFrame, trial_keys: list[str], frame: str, reference: int, lags: int) -> DataFrame:
    """trial_keys, cam_id, offset, r: by how many frames each camera runs late, where its activity fits the reference camera's best.

    The reference camera meets the others by trial and frame, in shuffled joins.
    """
    ref = activity.filter(F.col("cam_id") == reference).select(*trial_keys, frame, F.col("activity").alias("ref"))
    others = activity.filter(F.col("cam_id") != reference).select(*trial_keys, "cam_id", frame, F.col("activity").alias("other"))
    # Every camera meets the reference's frames, with NULL where it has none.
    cams = others.select(*trial_keys, "cam_id").distinct()
    left = cams.join(ref, trial_keys) if trial_keys else cams.join(ref, F.lit(True))  # a row for each camera of the rig
    keys = [*trial_keys, "cam_id"]
    x = left.select(*keys, F.col(frame).alias("_f"), "ref", F.explode(F.sequence(F.lit(-lags), F.lit(lags - 1))).alias("lag"))
    joined = x.withColumn(frame, F.col("_f") - F.col("lag")).join(others, [*keys, frame])
    spread = (F.stddev_pop("ref") > 0) & (F.stddev_pop("other") > 0)
    table = joined.filter("ref is not null and other is not null").groupBy(*keys, "lag").agg(F.when(spread, F.corr("ref", "other")).alias("r"))
    return series.best_lag(table, keys).select(*keys, (-F.col("lag")).alias("offset"), "r")


def shifted(keypoints: DataFrame, offset_table: DataFrame, trial_keys: list[str], frame: str) -> DataFrame:
    """Keypoints in the reference camera's frames; frames that end up at 0 or below are dropped."""
    moved = keypoints.join(offset_table.select(*trial_keys, "cam_id", "offset"), [*trial_keys, "cam_id"], "left")
    return moved.withColumn(frame, (F.col(frame) - F.coalesce("offset", F.lit(0))).cast(keypoints.schema[frame].dataType)).filter(F.col(frame) > 0).select(*keypoints.columns)
