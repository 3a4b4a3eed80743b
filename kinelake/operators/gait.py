"""Gait events from marker trajectories: heel strikes ("on") and toe offs ("off")."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions import kernels
from kinelake.functions.geometry import UNITS
from kinelake.operators import series


def _wide(markers: DataFrame, keys: list[str], frame: str, names: list[str], axis: str) -> DataFrame:
    return markers.filter(F.col("marker").isin(names)).groupBy(*keys, frame).agg(*(F.max(F.when(F.col("marker") == n, F.col(axis))).alias(n) for n in names))


def by_forward_coordinates(markers: DataFrame, keys: list[str], frame: str, *, axis: str = "x", direction: int = 1, prominence: float = 1.0, unit: str = "m", sides: tuple[str, ...] = ("R", "L")) -> DataFrame:
    """keys, side, kind, frame: on at peaks of heel ahead of hip, off at peaks of hip ahead of toe."""
    names = ["Hip", *(f"{s}{m}" for s in sides for m in ("Heel", "BigToe"))]
    wide = _wide(markers, keys, frame, names, axis)
    kinds = ", ".join(f"{k} {markers.schema[k].dataType.simpleString()}" for k in keys)
    rise = prominence * 0.01 / UNITS[unit]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(frame)
        f, key, out = rows[frame].to_numpy(), [rows[k].iloc[0] for k in keys], []
        for s in sides:
            for kind, values in (("on", rows[f"{s}Heel"] - rows["Hip"]), ("off", rows["Hip"] - rows[f"{s}BigToe"])):
                out += [(*key, s, kind, int(f[i])) for i in kernels.peaks(direction * values.to_numpy(dtype=float), rise)]
        return pd.DataFrame(out, columns=[*keys, "side", "kind", "frame"])

    return wide.groupBy(*keys).applyInPandas(run, f"{kinds}, side string, kind string, frame long")


def contact_runs(df: DataFrame, keys: list[str], frame: str, contact: Column) -> DataFrame:
    """keys, on, off: first and last frame of each run of contact."""
    rows = df.withColumn("_c", F.coalesce(contact, F.lit(False)))
    runs = series.true_runs(rows, keys, [frame], F.col("_c"))
    from pyspark.sql import Window

    number = rows.select(*keys, F.col(frame), (F.row_number().over(Window.partitionBy(*keys).orderBy(frame)) - 1).cast("long").alias("_i"))
    on = number.select(*keys, F.col("_i").alias("start"), F.col(frame).alias("on"))
    off = number.select(*keys, F.col("_i").alias("end"), F.col(frame).alias("off"))
    return runs.join(on, [*keys, "start"]).join(off, [*keys, "end"]).select(*keys, "on", "off")


def by_height(markers: DataFrame, keys: list[str], frame: str, rate: float, *, axis: str = "y", threshold_cm: float = 6.0, unit: str = "m", cutoff: float = 10.0, sides: tuple[str, ...] = ("R", "L")) -> DataFrame:
    """keys, side, on, off: runs of frames in which the low-passed toe height stays under the threshold."""
    from kinelake.operators.filters import smooth

    toes = markers.filter(F.col("marker").isin([f"{s}BigToe" for s in sides])).select(*keys, F.substring("marker", 1, 1).alias("side"), F.col(frame), (F.col(axis) * UNITS[unit] * 100).alias("height"))
    low = smooth(toes, [*keys, "side"], [frame], ["height"], "butterworth", rate, cutoff=cutoff, order=4, zero_missing=False)
    return contact_runs(low, [*keys, "side"], frame, F.col("height") < threshold_cm)


def by_forward_velocity(markers: DataFrame, keys: list[str], frame: str, rate: float, *, axis: str = "x", threshold: float = 1.0, unit: str = "m", sigma: float = 5.0, sides: tuple[str, ...] = ("R", "L")) -> DataFrame:
    """keys, side, on, off: runs in which the smoothed forward speed of the heel stays under the threshold (m/s)."""
    from kinelake.operators.filters import smooth

    heels = markers.filter(F.col("marker").isin([f"{s}Heel" for s in sides])).select(*keys, F.substring("marker", 1, 1).alias("side"), F.col(frame), (F.col(axis) * UNITS[unit]).alias("_v"))
    moved = series.speed(heels, [*keys, "side"], [frame], "_v", "speed", missing_factor=1.0).withColumn("speed", F.abs(F.col("speed")) * rate).drop("_v")
    return contact_runs(smooth(moved, [*keys, "side"], [frame], ["speed"], "gaussian", rate, sigma=sigma), [*keys, "side"], frame, F.col("speed") < threshold)


def alternating(events: DataFrame, keys: list[str], *, keep: str = "last") -> DataFrame:
    """Events (keys, side, kind, frame) that take turns between on and off on each side, starting with on and ending with off."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        on, off = kernels.alternate(rows.loc[rows.kind == "on", "frame"].tolist(), rows.loc[rows.kind == "off", "frame"].tolist(), keep)
        if on:
            off = [f for f in off if f >= on[0]]
        if off:
            on = [f for f in on if f <= off[-1]]
        head = rows.iloc[0]
        out = [(*(head[k] for k in keys), head["side"], kind, f) for kind, fs in (("on", on), ("off", off)) for f in fs]
        return pd.DataFrame(out, columns=[*keys, "side", "kind", "frame"])

    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    return events.groupBy(*keys, "side").applyInPandas(run, f"{kinds}, side string, kind string, frame long")
