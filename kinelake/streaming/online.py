"""Frame-sequential operators over streams: late frames, and one-pass filters with state.

The state of a series is three numbers, whatever its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def one_euro_stream(frames: DataFrame, keys: list[str], rate: float, *, cutoff: float = 4.0, beta: float = 1.5, d_cutoff: float = 1.0) -> DataFrame:
    """``frames`` (keys, frame, value) with ``filtered``: the forward pass of the One-Euro filter, frame after frame.

    Frames of a batch are sorted; a frame that is not after the last one of its
    series is dropped.
    """

    def alpha(c: float) -> float:
        r = 2 * math.pi * c / rate
        return r / (r + 1)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, value, speed = state.get if state.exists else (-1, float("nan"), 0.0)
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for f, v in zip(rows["frame"], rows["value"], strict=True):
            if f <= last:
                continue
            if v == v:
                if value == value:
                    a = alpha(d_cutoff)
                    speed = a * (v - value) * rate + (1 - a) * speed
                    a = alpha(cutoff + beta * abs(speed))
                    value = a * v + (1 - a) * value
                else:
                    value, speed = float(v), 0.0
            else:
                value = float("nan")
            last = int(f)
            out.append((*key, last, None if v != v else float(v), None if value != value else value))
        state.update((last, value, speed))
        yield pd.DataFrame(out, columns=[*keys, "frame", "value", "filtered"])

    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    return frames.select(*keys, F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("value")).groupBy(*keys).applyInPandasWithState(
        run, f"{kinds}, frame long, value double, filtered double", "last long, value double, speed double", "append", GroupStateTimeout.NoTimeout
    )


def activity_stream(frames: DataFrame, time: str, keys: list[str], value: str, *, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """keys, start, n, total of each time window; frames later than ``late`` are left out."""
    return frames.withWatermark(time, late).groupBy(*keys, F.window(time, width)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, F.col("window.start").alias("start"), "n", "total")
