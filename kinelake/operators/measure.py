"""Body measures from 3D markers: frames worth measuring, segment lengths, height, angles, scale ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import geometry as g
from kinelake.operators.series import trimmed_mean

XYZ = ["x", "y", "z"]

# Markers, offset and multiplier of the joint angles.
JOINT_ANGLES: dict[str, tuple[list[str], float, float]] = {
    "right ankle": (["RKnee", "RAnkle", "RBigToe", "RHeel"], 90, 1),
    "left ankle": (["LKnee", "LAnkle", "LBigToe", "LHeel"], 90, 1),
    "right knee": (["RAnkle", "RKnee", "RHip"], -180, 1),
    "left knee": (["LAnkle", "LKnee", "LHip"], -180, 1),
    "right hip": (["RKnee", "RHip", "Hip", "Neck"], 0, -1),
    "left hip": (["LKnee", "LHip", "Hip", "Neck"], 0, -1),
    "right shoulder": (["RElbow", "RShoulder", "Hip", "Neck"], 0, -1),
    "left shoulder": (["LElbow", "LShoulder", "Hip", "Neck"], 0, -1),
    "right elbow": (["RWrist", "RElbow", "RShoulder"], 180, -1),
    "left elbow": (["LWrist", "LElbow", "LShoulder"], 180, -1),
    "right wrist": (["RElbow", "RWrist", "RIndex"], -180, 1),
    "left wrist": (["LElbow", "LIndex", "LWrist"], -180, 1),
}

# The two markers of each segment whose slope in the image is its angle; all are mirrored.
SEGMENT_ANGLES: dict[str, tuple[str, str]] = {
    "right foot": ("RBigToe", "RHeel"),
    "left foot": ("LBigToe", "LHeel"),
    "right shank": ("RAnkle", "RKnee"),
    "left shank": ("LAnkle", "LKnee"),
    "right thigh": ("RKnee", "RHip"),
    "left thigh": ("LKnee", "LHip"),
    "pelvis": ("LHip", "RHip"),
    "trunk": ("Neck", "Hip"),
    "shoulders": ("LShoulder", "RShoulder"),
    "head": ("Head", "Neck"),
    "right arm": ("RElbow", "RShoulder"),
    "left arm": ("LElbow", "LShoulder"),
    "right forearm": ("RWrist", "RElbow"),
    "left forearm": ("LWrist", "LElbow"),
    "right hand": ("RIndex", "RWrist"),
    "left hand": ("LIndex", "LWrist"),
}


def with_midpoints(markers: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``markers`` (keys, marker, x, y, z) with a marker halfway between each pair that is present."""
    out = markers.select(*keys, "marker", *XYZ)
    for name, (a, b) in pairs.items():
        left = markers.filter(F.col("marker") == a).select(*keys, *(F.col(c).alias(f"_{c}") for c in XYZ))
        right = markers.filter(F.col("marker") == b).select(*keys, *XYZ)
        mid = left.join(right, keys).select(*keys, F.lit(name).alias("marker"), *(((F.col(f"_{c}") + F.col(c)) / 2).alias(c) for c in XYZ))
        out = out.unionByName(mid)
    return out


def _positions(markers: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row for each key with a struct column for each marker name."""
    at = {n: F.max(F.when(F.col("marker") == n, F.struct(*XYZ))).alias(f"m{i}") for i, n in enumerate(names)}
    return markers.filter(F.col("marker").isin(names)).groupBy(*keys).agg(*at.values())


def joint_angles(markers: DataFrame, keys: list[str], angles: dict[str, tuple[list[str], float, float]] | None = None) -> DataFrame:
    """keys, angle, degrees of each joint whose markers are present."""
    angles = angles or JOINT_ANGLES
    names = sorted({m for points, _, _ in angles.values() for m in points})
    wide = _positions(markers, keys, names)
    point = lambda n: [F.col(f"m{names.index(n)}.{c}") for c in XYZ]
    cells = [F.struct(F.lit(a).alias("angle"), g.wrapped(g.angle_3d([point(p) for p in points]), offset, factor).alias("degrees")) for a, (points, offset, factor) in angles.items()]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.angle", "c.degrees").filter("degrees is not null")


def segment_angles(markers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, angle, degrees of each segment's slope in the x-y plane; pelvis and shoulders are undirected."""
    names = sorted({m for pair in SEGMENT_ANGLES.values() for m in pair})
    wide = _positions(markers, keys, names)
    point = lambda n: [F.col(f"m{names.index(n)}.{c}") for c in "xy"]
    cells = [F.struct(F.lit(s).alias("angle"), g.wrapped(g.angle_2d([point(a), point(b)]), 0, -1, s in ("pelvis", "shoulders")).alias("degrees")) for s, (a, b) in SEGMENT_ANGLES.items()]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.angle", "c.degrees").filter("degrees is not null")


def mean_flexion(markers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, flexion: mean absolute knee and hip angle; NULL if one of the four is missing."""
    wanted = {a: JOINT_ANGLES[a] for a in ("right knee", "left knee", "right hip", "left hip")}
    found = joint_angles(markers, keys, wanted).groupBy(*keys).agg(F.avg(F.abs("degrees")).alias("flexion"), F.count("*").alias("_n"))
    return found.select(*keys, F.when(F.col("_n") == 4, F.col("flexion")).alias("flexion"))


def reasonable_frames(frames: DataFrame, keys: list[str], frame: str, speed: str, flexion: str, *, fastest: float = 0.1, slowest: float = 0.2, large: float = 45.0, at_least: int = 50) -> DataFrame:
    """Frames neither among the slowest and fastest nor with much flexion; if none is left, the ``at_least`` straightest."""
    w = Window.partitionBy(*keys).orderBy(speed, frame)
    rows = frames.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    inside = (F.col("_i") >= F.floor(F.col("_n") * slowest)) & (F.col("_i") < F.floor(F.col("_n") * (1 - fastest)))
    rows = rows.withColumn("_in", inside)
    good = F.col("_in") & (F.col(flexion) < large)
    rows = rows.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_any", F.max(F.col("_good").cast("int")).over(Window.partitionBy(*keys)))
    rank = F.row_number().over(Window.partitionBy(*keys, "_in").orderBy(F.asc_nulls_last(flexion), frame))
    rows = rows.withColumn("_r", rank)
    return rows.filter(F.col("_good") | ((F.col("_any") == 0) & F.col("_in") & (F.col("_r") <= at_least))).select(*frames.columns)


def segment_lengths(markers: DataFrame, keys: list[str], segments: dict[str, tuple[str, str]]) -> DataFrame:
    """keys, segment, length of each pair of markers."""
    names = sorted({m for pair in segments.values() for m in pair})
    wide = _positions(markers, keys, names)
    point = lambda n: [F.col(f"m{names.index(n)}.{c}") for c in XYZ]
    cells = [F.struct(F.lit(s).alias("segment"), g.norm(g.difference(point(a), point(b))).alias("length")) for s, (a, b) in segments.items()]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.segment", "c.length").filter("length is not null")


def body_height(markers: DataFrame, person_keys: list[str], frame: str, *, trimmed: float = 0.5, heel: float = 0.10) -> DataFrame:
    """person_keys, height: trimmed mean over frames of heel + shank + thigh + trunk + head, limbs averaged over both sides.

    The head reaches 1.008 times from neck to head, or 1.5 times from neck to
    nose where there is no head marker.
    """
    keys = [*person_keys, frame]
    pairs = {"rshank": ("RKnee", "RAnkle"), "lshank": ("LKnee", "LAnkle"), "rthigh": ("RHip", "RKnee"), "lthigh": ("LHip", "LKnee"), "rtrunk": ("RShoulder", "RHip"), "ltrunk": ("LShoulder", "LHip"), "rfoot": ("RAnkle", "RHeel"), "lfoot": ("LAnkle", "LHeel"), "head": ("Head", "Neck"), "nose": ("Nose", "Neck")}
    wide = segment_lengths(markers, keys, pairs).groupBy(*keys).pivot("segment", list(pairs)).agg(F.first("length"))
    both = lambda s: (F.col(f"r{s}") + F.col(f"l{s}")) / 2
    foot = F.coalesce(both("foot"), F.lit(float(heel)))
    head = F.coalesce(F.col("head") * 1.008, F.col("nose") * 1.5)
    rows = wide.select(*keys, (foot + both("shank") + both("thigh") + both("trunk") + head).alias("height"))
    return trimmed_mean(rows, person_keys, "height", trimmed, "height")


def segment_scales(lengths: DataFrame, model: DataFrame, keys: list[str], *, trimmed: float = 0.2) -> DataFrame:
    """keys, body, axis, ratio: measured over model length, averaged over the pairs of a body axis.

    ``model``: segment, body, axis, model_length.
    """
    measured = trimmed_mean(lengths, [*keys, "segment"], "length", trimmed, "measured")
    return measured.join(model, "segment").groupBy(*keys, "body", "axis").agg(F.avg(F.try_divide(F.col("measured"), F.col("model_length"))).alias("ratio"))


def frame_validity(df: DataFrame, keys: list[str], frame: str, value: str, *, complete: bool = False) -> DataFrame:
    """keys, frame, mean of the value over markers; NULL for a frame with gaps if ``complete``."""
    mean: Column = F.avg(value)
    return df.groupBy(*keys, frame).agg((F.when(F.count("*") == F.count(value), mean) if complete else mean).alias("mean"))


def augment_features(markers: DataFrame, keys: list[str], names: list[str], height: Column, mass: Column) -> DataFrame:
    """keys, features: coordinates from the mid hip in heights, marker after marker, then height and mass."""
    wide = _positions(markers, keys, sorted({*names, "Hip"}))
    order = sorted({*names, "Hip"})
    point = lambda n: [F.col(f"m{order.index(n)}.{c}") for c in XYZ]
    parts = [c for n in names for c in g.relative_to(point(n), point("Hip"), height)]
    return wide.select(*keys, F.array(*parts, height, mass).alias("features"), F.struct(*(c.alias(a) for c, a in zip(point("Hip"), XYZ, strict=True))).alias("hip"))


def apply_augmenter(features: DataFrame, keys: list[str], model, responses: list[str], mean: list[float], deviation: list[float], height: float) -> DataFrame:
    """keys, marker, x, y, z from ``model``: a function from a (frames, features) array to (frames, 3 * responses).

    Whole sequences are needed, so one group is one person; afterwards the feet
    are put on the floor.
    """
    import numpy as np
    import pandas as pd

    persons = keys[:-1]
    kinds = ", ".join(f"{k} {features.schema[k].dataType.simpleString()}" for k in keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(keys[-1])
        x = (np.stack(rows["features"]) - np.array(mean)) / np.array(deviation)
        hip = np.array([[h["x"], h["y"], h["z"]] for h in rows["hip"]])
        q = np.asarray(model(x)).reshape(len(x), len(responses), 3) * height + hip[:, None, :]
        q[..., 1] -= q[..., 1].min() - 0.01
        out = rows[keys].loc[rows.index.repeat(len(responses))].reset_index(drop=True)
        return out.assign(marker=responses * len(x), x=q[..., 0].ravel(), y=q[..., 1].ravel(), z=q[..., 2].ravel())

    return features.groupBy(*persons).applyInPandas(run, f"{kinds}, marker string, x double, y double, z double")
