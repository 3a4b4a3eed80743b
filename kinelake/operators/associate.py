"""Association of detected people across cameras.

Several people: rays of keypoints from camera pairs, weighted ray distances,
affinities, a low-rank completion of the affinity matrix for each frame, and
proposals.  One person: every combination of detections, with cameras removed
level by level, until one is good enough.

A frame's people are few; grouped functions see one frame at a time.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions import geometry as g
from kinelake.functions.linalg import reprojection_error, triangulate
from kinelake.operators.triangulate import camera_subsets


def person_combinations(detections: DataFrame, keys: list[str], cameras: list[int]) -> DataFrame:
    """All choices of one detected person for each camera of a frame; NULL for a camera without any.

    keys, combination (0.., the last camera varies fastest), persons (array in camera order).
    """
    chosen = detections.select(*keys, "cam_id", "person_id").distinct()
    lists = chosen.groupBy(*keys).agg(*(F.sort_array(F.collect_list(F.when(F.col("cam_id") == c, F.col("person_id")))).alias(f"_p{i}") for i, c in enumerate(cameras)))
    size = lambda i: F.greatest(F.size(f"_p{i}"), F.lit(1)).cast("long")
    total = size(0)
    for i in range(1, len(cameras)):
        total = total * size(i)
    rows = lists.withColumn("combination", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)))
    picks, stride = [], F.lit(1).cast("long")
    for i in reversed(range(len(cameras))):
        picks.insert(0, F.get(f"_p{i}", F.pmod(F.floor(F.col("combination") / stride), size(i)).cast("int")))
        stride = stride * size(i)
    return rows.select(*keys, "combination", F.array(*picks).alias("persons"))


def ray_pairs(rays: DataFrame, frame_keys: list[str], threshold: float) -> DataFrame:
    """Affinity of people in different cameras of a frame.

    ``rays``: frame_keys, cam_id, person_id, kpt_id, lx, ly, lz, mx, my, mz, score.
    The distance of two people is the mean over common keypoints of their rays'
    distances weighted by the root of both scores; affinity is 1 - min(d, t) / t.
    """
    a = rays.select(*frame_keys, "kpt_id", *(F.col(c).alias(f"a_{c}") for c in ("cam_id", "person_id", "lx", "ly", "lz", "mx", "my", "mz", "score")))
    b = rays.select(*frame_keys, "kpt_id", *(F.col(c).alias(f"b_{c}") for c in ("cam_id", "person_id", "lx", "ly", "lz", "mx", "my", "mz", "score")))
    pairs = a.join(b, [*frame_keys, "kpt_id"]).filter("a_cam_id < b_cam_id")
    part = lambda s, v: [F.col(f"{s}_{v}{c}") for c in "xyz"]
    d = g.line_distance(part("a", "l"), part("a", "m"), part("b", "l"), part("b", "m"))
    w = F.sqrt(F.col("a_score") * F.col("b_score"))
    mean = F.sum(d * w) / (F.lit(1e-5) + F.sum(w))
    rows = pairs.groupBy(*frame_keys, F.col("a_cam_id").alias("cam_a"), F.col("a_person_id").alias("person_a"), F.col("b_cam_id").alias("cam_b"), F.col("b_person_id").alias("person_b")).agg(mean.alias("distance"))
    return rows.withColumn("affinity", 1 - F.least("distance", F.lit(float(threshold))) / threshold)


def match_by_low_rank(affinity: np.ndarray, groups: list[int], rounds: int = 20, tolerance: float = 1e-4, w_rank: float = 50.0, w_sparse: float = 0.1) -> np.ndarray:
    """Completed affinity matrix: alternating singular-value thresholding and projection.

    ``groups`` holds the number of people in each view.  Same-view entries are
    zero, the diagonal one, values stay in [0, 1] and the matrix symmetric.
    """
    n = len(affinity)
    if not n:
        return affinity.copy()
    view = np.repeat(np.arange(len(groups)), groups)
    allowed = view[:, None] != view[None, :]
    s = np.where(allowed, affinity, 0.0)
    s = (s + s.T) / 2
    x, dual, mu = s.copy(), np.zeros_like(s), 64.0
    weight = w_sparse - s
    for _ in range(rounds):
        before = x
        u, sigma, v = np.linalg.svd(dual / mu + x, full_matrices=False)
        low = (u * np.maximum(sigma - w_rank / mu, 0)) @ v
        x = low - (weight + dual) / mu
        x = np.where(allowed, x, 0.0)
        np.fill_diagonal(x, 1.0)
        x = np.clip(x, 0.0, 1.0)
        x = (x + x.T) / 2
        dual = dual + mu * (x - low)
        primal, change = np.linalg.norm(x - low) / n, mu * np.linalg.norm(x - before) / n
        if primal < tolerance and change < tolerance:
            break
        if primal > 10 * change:
            mu *= 2
        elif change > 10 * primal:
            mu /= 2
    return np.where(allowed, x, 0.0)


def proposals(matrix: np.ndarray, groups: list[int], min_affinity: float = 0.2, min_cameras: int = 2) -> np.ndarray:
    """People as rows of one person number (or -1) for each view, from a completed affinity matrix.

    Each person proposes their best partner in every view; equal proposals are
    counted, and taken by falling count unless they share someone with one
    already taken.
    """
    start = np.concatenate([[0], np.cumsum(groups)]).astype(int)
    m = np.where(matrix < min_affinity, 0.0, matrix)
    rows = []
    for v, k in enumerate(groups):
        for i in range(k):
            row = np.full(len(groups), -1)
            row[v] = i
            for other, size in enumerate(groups):
                part = m[start[v] + i, start[other] : start[other] + size]
                if other != v and size and part.max() > 0:
                    row[other] = int(part.argmax())
            rows.append(tuple(row))
    if not rows:
        return np.empty((0, len(groups)), dtype=int)
    counts = pd.Series(rows).value_counts()
    ordered = sorted(counts.items(), key=lambda c: (-c[1], tuple(-x for x in c[0])))
    used: set[tuple[int, int]] = set()
    out = []
    for row, _ in ordered:
        own = {(v, p) for v, p in enumerate(row) if p >= 0}
        if not own & used:
            if len(own) >= min_cameras:
                out.append(row)
        used |= own
    return np.array(out, dtype=int).reshape(-1, len(groups))


def associate_people(affinities: DataFrame, detections: DataFrame, frame_keys: list[str], cameras: list[int], *, min_affinity: float = 0.2, min_cameras: int = 2) -> DataFrame:
    """frame_keys, proposal, cam_id, person_id: which detections are one person."""
    people = detections.select(*(F.col(k).alias(k) for k in frame_keys), F.col("cam_id").alias("cam_id"), F.col("person_id").alias("person_id")).distinct()
    kinds = ", ".join(f"{k} {detections.schema[k].dataType.simpleString()}" for k in frame_keys)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        views = [sorted(left.loc[left.cam_id == c, "person_id"]) for c in cameras]
        groups = [len(v) for v in views]
        place = {(c, p): i for i, (c, p) in enumerate((c, p) for c, v in zip(cameras, views, strict=True) for p in v)}
        a = np.zeros((len(place), len(place)))
        for r in right.itertuples():
            i, j = place.get((r.cam_a, r.person_a)), place.get((r.cam_b, r.person_b))
            if i is not None and j is not None:
                a[i, j] = a[j, i] = r.affinity
        found = proposals(match_by_low_rank(a, groups), groups, min_affinity, min_cameras)
        rows = [(*key, n, cameras[v], views[v][p]) for n, row in enumerate(found) for v, p in enumerate(row) if p >= 0]
        return pd.DataFrame(rows, columns=[*frame_keys, "proposal", "cam_id", "person_id"])

    # New names for all columns: both sides may come from one table.
    edges = affinities.toDF(*(f"e_{c}" for c in affinities.columns)).select(*(F.col(f"e_{c}").alias(c) for c in (*frame_keys, "cam_a", "person_a", "cam_b", "person_b", "affinity")))
    return people.groupBy(*frame_keys).cogroup(edges.groupBy(*frame_keys)).applyInPandas(run, f"{kinds}, proposal int, cam_id int, person_id int")


def best_combination(p: np.ndarray, x: list[np.ndarray], y: list[np.ndarray], score: list[np.ndarray], threshold: float = 20.0, least: int = 2, min_score: float = 0.3) -> tuple[float, list[int | None]]:
    """Least error and the person of each camera (None where a camera is off).

    Levels remove more and more cameras; within a level the first combination
    below the threshold ends the level, and the search.
    """
    n = len(x)
    choices = [range(len(v)) if len(v) else (None,) for v in x]
    combos = list(itertools.product(*choices))
    best, answer, last = np.inf, [None] * n, np.inf
    for off in range(n - least + 1):
        if last < threshold:
            break
        for combo in combos:
            xs, ys, ss = (np.array([np.nan if c is None else v[i][c] for i, c in enumerate(combo)]) for v in (x, y, score))
            on = np.isfinite(xs) & np.isfinite(ys) & (np.nan_to_num(ss) >= min_score)
            if on.sum() - off < least:
                continue
            active = np.flatnonzero(on)
            subsets = camera_subsets(len(active), off)
            use = np.zeros((len(subsets), n), dtype=bool)
            use[:, active] = ~subsets
            w = np.where(use, np.nan_to_num(ss), 0.0)
            q = triangulate(p, np.broadcast_to(xs, w.shape), np.broadcast_to(ys, w.shape), w)
            e = reprojection_error(p, q, np.nan_to_num(np.broadcast_to(xs, w.shape)), np.nan_to_num(np.broadcast_to(ys, w.shape)), use)
            e = np.where(np.isfinite(e), e, np.inf)
            k = int(e.argmin())
            last = float(e[k])
            if last < best:
                best, answer = last, [c if use[k, i] else None for i, c in enumerate(combo)]
            if last < threshold:
                break
    return best, answer


def associate_one(keypoint: DataFrame, cameras: list[tuple[int, np.ndarray]], frame_keys: list[str], *, threshold: float = 20.0, least: int = 2, min_score: float = 0.3) -> DataFrame:
    """frame_keys, error, persons (in camera order) of the best combination of one tracked keypoint's detections."""
    p = np.stack([np.asarray(m, dtype=float) for _, m in cameras])
    ids = [c for c, _ in cameras]
    kinds = ", ".join(f"{k} {keypoint.schema[k].dataType.simpleString()}" for k in frame_keys)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        views = [rows[rows.cam_id == c].sort_values("person_id") for c in ids]
        error, chosen = best_combination(p, *([v[c].to_numpy(dtype=float) for v in views] for c in ("x", "y", "score")), threshold, least, min_score)
        persons = [None if c is None else int(v["person_id"].iloc[c]) for c, v in zip(chosen, views, strict=True)]
        return pd.DataFrame([(*key, error if np.isfinite(error) else None, persons)], columns=[*frame_keys, "error", "persons"])

    return keypoint.groupBy(*frame_keys).applyInPandas(run, f"{kinds}, error double, persons array<int>")


def suppress_boxes(boxes: np.ndarray, scores: np.ndarray, threshold: float = 0.45) -> list[int]:
    """Greedy non-maximum suppression: places of the boxes kept, by falling score, ties by coordinates."""
    order, kept = list(np.lexsort((*boxes.T[::-1], -scores))), []
    while order:
        i = order.pop(0)
        kept.append(int(i))
        rest = np.array(order, dtype=int)
        if not len(rest):
            break
        w = np.maximum(0, np.minimum(boxes[i, 2], boxes[rest, 2]) - np.maximum(boxes[i, 0], boxes[rest, 0]))
        h = np.maximum(0, np.minimum(boxes[i, 3], boxes[rest, 3]) - np.maximum(boxes[i, 1], boxes[rest, 1]))
        area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
        overlap = w * h / np.maximum(area(boxes[i]) + area(boxes[rest]) - w * h, 1e-12)
        order = rest[overlap <= threshold].tolist()
    return kept


def non_max_suppression(boxes: DataFrame, frame_keys: list[str], *, threshold: float = 0.45) -> DataFrame:
    """The rows (xmin, ymin, xmax, ymax, score, ...) of each frame that suppression keeps."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[suppress_boxes(rows[["xmin", "ymin", "xmax", "ymax"]].to_numpy(dtype=float), rows["score"].to_numpy(dtype=float), threshold)]

    return boxes.groupBy(*frame_keys).applyInPandas(run, boxes.schema)


def detection_gate(keypoints: DataFrame, person_keys: list[str], *, visible: float = 0.2, mean: float = 0.5) -> DataFrame:
    """The people whose mean score passes: over ``mean`` once keypoints up to ``visible`` are left out."""
    shown = F.avg(F.when(F.col("score") > visible, F.col("score")))
    passing = keypoints.groupBy(*person_keys).agg(shown.alias("_m")).filter(F.coalesce("_m", F.lit(0.0)) > mean).drop("_m")
    return keypoints.join(passing, person_keys, "left_semi")


def largest_person(keypoints: DataFrame, frame_keys: list[str], *, min_score: float = 0.4) -> DataFrame:
    """Keypoints of the person with the largest bounding box in each frame (smallest id on ties); low scores are NULL."""
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    boxes = keypoints.groupBy(*frame_keys, "person_id").agg(area.alias("area"))
    best = boxes.groupBy(*frame_keys).agg(F.max(F.struct("area", (-F.col("person_id")).alias("m"))).alias("b")).select(*frame_keys, (-F.col("b.m")).alias("person_id"))
    kept = lambda c: F.when(F.col("score") > min_score, F.col(c)).alias(c)
    rows = keypoints.join(best, [*frame_keys, "person_id"])
    return rows.select(*(kept(c) if c in ("x", "y") else F.col(c) for c in keypoints.columns))


def person_count(keypoints: DataFrame, frame_keys: list[str]) -> DataFrame:
    """The most people seen in one frame and camera."""
    return keypoints.groupBy(*frame_keys, "cam_id").agg(F.count_distinct("person_id").alias("n")).agg(F.max("n").alias("n_persons"))
