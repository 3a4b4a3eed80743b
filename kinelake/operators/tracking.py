"""Identities over time: people of a frame matched to those of the frame before.

Matching is sequential, so one group is one trial; its columns are few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinelake.functions.linalg import assignment

FAR = 1e10


class Tracker:
    """State of the matching: the last known coordinates of every identity."""

    def __init__(self, most: float, dims: int) -> None:
        self.most, self.dims, self.last = most, dims, []

    def step(self, people: list[np.ndarray]) -> list[int]:
        """Identities of a frame's people, each an array (keypoints, dims) with NaN for missing."""
        known, now = len(self.last), len(people)
        cost = np.full((known, now), FAR)
        for i, a in enumerate(self.last):
            for j, b in enumerate(people):
                d = np.sqrt(np.nansum((a - b) ** 2, axis=-1))
                both = (np.isfinite(a) & np.isfinite(b)).any(axis=-1)
                if both.any():
                    cost[i, j] = d[both].mean()
        ids = [-1] * now
        for i, j in assignment(cost):
            if cost[i, j] <= self.most:
                ids[j] = i
        for j in range(now):
            if ids[j] < 0:
                self.last.append(np.full_like(people[j], np.nan))
                ids[j] = len(self.last) - 1
            before = self.last[ids[j]]
            self.last[ids[j]] = np.where(np.isfinite(people[j]), people[j], before)
        return ids


def reidentify(points: DataFrame, trial_keys: list[str], *, most: float = 1.0, dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``points`` (trial_keys, frame, person_id, kpt_id, dims) with ``track_id``.

    People are matched by least total mean distance of common keypoints; pairs
    farther than ``most`` are not matched, new people get new identities, and a
    missing keypoint keeps its last known place.  2D tracking is the same with
    dims x, y and pixels.
    """
    schema = T.StructType([*points.schema.fields, T.StructField("track_id", T.IntegerType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kpts = {k: i for i, k in enumerate(sorted(rows["kpt_id"].unique()))}
        tracker = Tracker(most, len(dims))
        out = {}
        for frame, part in rows.groupby("frame", sort=True):
            persons, people = [], []
            for person, own in part.groupby("person_id", sort=True):
                a = np.full((len(kpts), len(dims)), np.nan)
                a[[kpts[k] for k in own["kpt_id"]]] = own[list(dims)].to_numpy(dtype=float)
                persons.append(person)
                people.append(a)
            out.update({(frame, p): t for p, t in zip(persons, tracker.step(people), strict=True)})
        return rows.assign(track_id=[out[k] for k in zip(rows["frame"], rows["person_id"], strict=True)])

    return points.groupBy(*trial_keys).applyInPandas(run, schema)
