"""Reprojected or detected keypoints in the formats of labelling tools, and text reports.

All functions return rows of (file_name, text); writing them is left to the
caller, since one small file for each frame is rarely what a cluster wants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(keypoints: DataFrame, keys: list[str]) -> Column:
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return F.sort_array(F.collect_list(F.struct("kpt_id", number("x").alias("x"), number("y").alias("y"), F.col("x").isNotNull().alias("seen"))))


def coco_json(keypoints: DataFrame, trial_keys: list[str], width: int, height: int) -> DataFrame:
    """One COCO keypoint file for each trial: images by frame, an annotation for each person."""
    people = keypoints.groupBy(*trial_keys, "frame", "person_id").agg(_ordered(keypoints, trial_keys).alias("k"))
    flat = F.flatten(F.transform("k", lambda k: F.array(k["x"], k["y"], F.when(k["seen"], 2.0).otherwise(0.0))))
    seen = F.filter("k", lambda k: k["seen"])
    xs, ys = F.transform(seen, lambda k: k["x"]), F.transform(seen, lambda k: k["y"])
    low = [F.coalesce(F.array_min(c), F.lit(0.0)) for c in (xs, ys)]
    size = [F.coalesce(F.array_max(c) - F.array_min(c), F.lit(0.0)) for c in (xs, ys)]
    note = F.struct(
        (F.col("frame") * 1000 + F.col("person_id")).alias("id"),
        F.col("frame").alias("image_id"),
        F.lit(1).alias("category_id"),
        flat.alias("keypoints"),
        F.size(seen).alias("num_keypoints"),
        F.array(*low, *size).alias("bbox"),
        (size[0] * size[1]).alias("area"),
        F.lit(0).alias("iscrowd"),
    )
    image = F.struct(F.col("frame").alias("id"), F.format_string("frame_%06d", "frame").alias("file_name"), F.lit(width).alias("width"), F.lit(height).alias("height"))
    whole = people.groupBy(*trial_keys).agg(F.sort_array(F.collect_set(image)).alias("images"), F.sort_array(F.collect_list(note)).alias("annotations"))
    name = F.concat_ws("_", *(F.col(k).cast("string") for k in trial_keys), F.lit("coco.json"))
    return whole.select(name.alias("file_name"), F.to_json(F.struct("images", "annotations", F.array(F.struct(F.lit(1).alias("id"), F.lit("person").alias("name"))).alias("categories"))).alias("text"))


def deeplabcut_csv(keypoints: DataFrame, trial_keys: list[str], names: list[str], scorer: str = "scorer") -> DataFrame:
    """One CSV for each trial and person: a row for each frame, x, y and likelihood for each of ``names`` in keypoint order."""
    cell = lambda c: F.coalesce(F.format_string("%.6f", F.col(c)), F.lit(""))
    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kpt_id", F.when(F.col("x").isNotNull(), cell("x")).otherwise("").alias("a"), F.when(F.col("y").isNotNull(), cell("y")).otherwise("").alias("b"), F.when(F.col("score").isNotNull(), cell("score")).otherwise("").alias("c")))), lambda k: F.concat_ws(",", k["a"], k["b"], k["c"])), ",")
    rows = keypoints.groupBy(*trial_keys, "person_id", "frame").agg(row.alias("cells"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame", "cells"))), lambda r: F.concat_ws(",", r["frame"].cast("string"), r["cells"])), "\n")
    head = "\n".join([",".join(["scorer"] + [scorer] * 3 * len(names)), ",".join(["bodyparts"] + [n for n in names for _ in range(3)]), ",".join(["coords"] + ["x", "y", "likelihood"] * len(names))])
    name = F.concat_ws("_", *(F.col(k).cast("string") for k in trial_keys), F.concat(F.lit("P"), F.col("person_id").cast("string")), F.lit("dlc.csv"))
    return rows.groupBy(*trial_keys, "person_id").agg(body.alias("body")).select(name.alias("file_name"), F.concat(F.lit(head + "\n"), F.col("body"), F.lit("\n")).alias("text"))


def gait_report(events: DataFrame, trial_keys: list[str], rate: float) -> DataFrame:
    """A readable block for each trial: times of the events of each side and kind."""
    at = F.array_join(F.transform(F.sort_array(F.collect_list("frame")), lambda f: F.format_string("%.3f", f / rate)), ", ")
    lines = events.groupBy(*trial_keys, "side", "kind").agg(F.concat(F.col("side"), F.lit(" "), F.col("kind"), F.lit(": "), at).alias("line"))
    name = F.concat_ws("_", *(F.col(k).cast("string") for k in trial_keys), F.lit("gait.txt"))
    return lines.groupBy(*trial_keys).agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text")).select(name.alias("file_name"), "text")
