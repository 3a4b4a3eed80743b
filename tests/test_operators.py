import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import associate, filters, gait, measure, series, sync, tracking, triangulate
from kinelake.plans.queries import ring


def test_robust_search_excludes_the_wrong_cameras():
    rng = np.random.default_rng(1)
    cams = ring(5)
    p = np.stack([m for _, m in cams])
    q = rng.uniform(-1, 1, (40, 3))
    h = np.einsum("cij,bj->bci", p, np.c_[q, np.ones(40)])
    x, y = h[..., 0] / h[..., 2], h[..., 1] / h[..., 2]
    score = np.ones_like(x)
    x[10:20, 2] += 400
    x[20:30, 0] += 400
    y[20:30, 4] -= 300
    score[30:35, :4] = np.nan  # one camera left
    got, error, off = triangulate.robust(p, x, y, score, 15.0, 2)
    assert np.allclose(got[:30], q[:30], atol=1e-6) and (error[:30] < 1e-6).all()
    assert off[:10].sum() == 0 and (off[10:20].sum(axis=1) == 1).all() and off[10:20, 2].all() and off[20:30, [0, 4]].all()
    assert np.isnan(got[30:35]).all() and off[30:35].all() and np.allclose(got[35:], q[35:], atol=1e-6)


def test_low_scores_and_missing_observations(spark):
    cams = ring(4)
    points = spark.createDataFrame([(i, 0.1 * i, -0.1 * i, 0.2) for i in range(6)], "id long, x double, y double, z double")
    seen = triangulate.observe(points, cams, ["id"])
    seen = seen.withColumn("score", F.when((F.col("id") == 1) & (F.col("cam_id") <= 2), 0.1).when((F.col("id") == 2) & (F.col("cam_id") <= 3), 0.1).otherwise(1.0))
    seen = seen.withColumn("x", F.when((F.col("id") == 3) & (F.col("cam_id") == 1), F.lit(None)).otherwise(F.col("x")))
    got = {r.id: r for r in triangulate.robust_triangulation(seen, cams, ["id"]).collect()}
    assert got[0].excluded_cams == [] and got[1].excluded_cams == [1, 2] and got[3].excluded_cams == [1]
    assert got[2].x is None and got[2].error is None and got[2].n_excluded == 4
    assert got[1].x == pytest.approx(0.1) and got[3].z == pytest.approx(0.2)


def test_two_people_are_matched_over_views():
    groups, n = [2, 2, 2], 6
    truth = np.zeros((n, n))
    people = [0, 1, 1, 0, 0, 1]  # view 2 lists them in the other order
    for i in range(n):
        for j in range(n):
            truth[i, j] = float(people[i] == people[j] and i // 2 != j // 2)
    noisy = np.clip(truth * 0.9 + 0.05, 0, 1) * (np.arange(n)[:, None] // 2 != np.arange(n)[None] // 2)
    found = associate.proposals(associate.match_by_low_rank(noisy, groups), groups)
    assert sorted(map(tuple, found.tolist())) == [(0, 1, 0), (1, 0, 1)]
    assert associate.proposals(np.zeros((0, 0)), [0, 0]).shape == (0, 2)


def test_completion_fills_unseen_pairs():
    """Four views of one person; two pairs of views know nothing of each other."""
    a = np.full((4, 4), 0.9) - 0.9 * np.eye(4)
    for i, j in ((0, 2), (1, 3)):
        a[i, j] = a[j, i] = 0.0
    found = associate.match_by_low_rank(a, [1, 1, 1, 1])
    assert found[0, 2] > 0.5 and found[1, 3] > 0.5
    assert associate.proposals(found, [1, 1, 1, 1]).tolist() == [[0, 0, 0, 0]]


def test_best_combination_picks_the_same_person():
    cams = ring(4)
    p = np.stack([m for _, m in cams])
    q = np.array([[0.2, 0.1, 0.3], [-0.5, 0.4, 0.1]])
    h = np.einsum("cij,bj->cbi", p, np.c_[q, np.ones(2)])
    x, y = (list(h[..., k] / h[..., 2]) for k in (0, 1))
    x[1], y[1] = x[1][::-1], y[1][::-1]
    error, chosen = associate.best_combination(p, x, y, [np.ones(2)] * 4)
    assert error < 1e-6 and chosen in ([0, 1, 0, 0], [1, 0, 1, 1])
    assert associate.best_combination(p, [np.zeros(0)] * 4, [np.zeros(0)] * 4, [np.zeros(0)] * 4)[1] == [None] * 4


def test_identities_survive_shuffling(spark):
    rng = np.random.default_rng(2)
    rows = []
    for f in range(20):
        for person, slot in enumerate(rng.permutation(3)):
            for kpt in range(4):
                rows.append((1, f, int(slot), kpt, person * 3.0 + 0.01 * f + kpt, 0.5 * person, float(kpt), person))
    df = spark.createDataFrame(rows, "trial int, frame int, person_id int, kpt_id int, x double, y double, z double, truth int")
    got = tracking.reidentify(df, ["trial"]).groupBy("truth").agg(F.collect_set("track_id").alias("t")).collect()
    assert all(len(r.t) == 1 for r in got) and len({r.t[0] for r in got}) == 3


def test_boxes_are_suppressed_by_score():
    boxes = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [20, 20, 30, 30.0]])
    assert associate.suppress_boxes(boxes, np.array([0.5, 0.9, 0.1])) == [1, 2]


def test_every_filter_runs_on_gappy_series(spark):
    rows = [(s, i, None if i in (7, 8) else 5 + np.sin(i / 5).item(), "kept") for s in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "s int, i int, v double, other string")
    for name in filters.FILTERS:
        out = filters.smooth(df, ["s"], ["i"], ["v"], name, 60.0).collect()
        assert len(out) == len(rows) and {r.other for r in out} == {"kept"}
    with pytest.raises(ValueError):
        filters.smooth(df, ["s"], ["i"], ["v"], "nothing", 60.0)


def test_cameras_are_synchronised(spark):
    rng = np.random.default_rng(3)
    base = np.cumsum(rng.normal(size=80))
    rows = [(1, cam, f, 0, float(base[f - shift])) for cam, shift in ((0, 0), (1, 4), (2, -3)) for f in range(max(0, shift), 70 + min(0, shift))]
    df = spark.createDataFrame(rows, "trial int, cam_id int, frame int, kpt_id int, y double")
    activity = sync.vertical_activity(df, ["trial", "cam_id"], "frame")
    found = sync.offsets(activity, ["trial"], "frame", 0, 8)
    got = {r.cam_id: r.offset for r in found.collect()}
    assert got == {1: 4, 2: -3}
    moved = sync.shifted(df, found, ["trial"], "frame")
    assert moved.filter("frame <= 0").count() == 0
    assert all(r.y == float(base[r.frame]) for r in moved.collect()) and moved.count() > 190


def test_gait_events_take_turns(spark):
    rows = []
    for f in range(200):
        phase = 2 * np.pi * f / 50
        for side, lag in (("R", 0.0), ("L", np.pi)):
            rows += [(1, f, f"{side}Heel", float(0.3 * np.sin(phase + lag)), 0.1), (1, f, f"{side}BigToe", float(0.3 * np.sin(phase + lag) + 0.2), float(0.05 + 0.1 * max(0, np.sin(phase + lag))))]
        rows.append((1, f, "Hip", 0.0, 1.0))
    df = spark.createDataFrame(rows, "trial int, frame int, marker string, x double, y double")
    events = gait.alternating(gait.by_forward_coordinates(df, ["trial"], "frame"), ["trial"]).collect()
    right = sorted((r.frame, r.kind) for r in events if r.side == "R")
    assert [k for _, k in right] == ["on", "off"] * (len(right) // 2) and len(right) >= 4
    assert gait.by_height(df, ["trial"], "frame", 60.0).count() >= 6
    assert gait.by_forward_velocity(df, ["trial"], "frame", 60.0).count() >= 4


def test_flexion_of_a_straight_body_is_none(spark):
    names = {"RHip": (0.1, 1.0, 0), "LHip": (-0.1, 1.0, 0), "RKnee": (0.1, 0.5, 0), "LKnee": (-0.1, 0.5, 0), "RAnkle": (0.1, 0.0, 0), "LAnkle": (-0.1, 0.0, 0), "Hip": (0.0, 1.0, 0), "Neck": (0.0, 1.5, 0)}
    df = spark.createDataFrame([(0, m, *map(float, p)) for m, p in names.items()] + [(1, "RHip", 0.0, 0.0, 0.0)], "frame int, marker string, x double, y double, z double")
    got = {r.frame: r.flexion for r in measure.mean_flexion(df, ["frame"]).collect()}
    assert got[0] is not None
    angles = {r.angle: r.degrees for r in measure.joint_angles(df.filter("frame = 0"), ["frame"]).collect()}
    assert angles["right knee"] == pytest.approx(0, abs=1e-6) and abs(angles["right hip"]) in (pytest.approx(180), pytest.approx(0))


def test_augmenter_puts_feet_on_the_floor(spark):
    rows = [(1, f, m, float(i), 1.0 + i + f, 0.0) for f in range(4) for i, m in enumerate(("A", "B", "Hip"))]
    df = spark.createDataFrame(rows, "person int, frame int, marker string, x double, y double, z double")
    feats = measure.augment_features(df, ["person", "frame"], ["A", "B"], F.lit(2.0), F.lit(70.0))
    assert len(feats.first().features) == 8
    out = measure.apply_augmenter(feats, ["person", "frame"], lambda x: np.zeros((len(x), 6)), ["r1", "r2"], [0.0] * 8, [1.0] * 8, 2.0)
    assert out.count() == 8 and out.agg(F.min("y")).first()[0] == pytest.approx(0.01)


def test_series_edges(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, 3.0, 0.0, 5.0, 6.0, 7.0, None])], "s int, i int, v double")
    got = [r.filled for r in series.interpolate(df, ["s"], ["i"], "v", most=3).orderBy("i").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, None]
    assert [r.filled for r in series.fill_ends(df, ["s"], ["i"], "v").orderBy("i").collect()] == [1.0, 1.0, 1.0, 3.0, 0.0, 5.0, 6.0, 7.0, 7.0]
    assert series.valid_runs(df, ["s"], ["i"], F.col("v") > 100).count() == 0
    for f in (lambda d: series.hampel(d, ["s"], ["i"], "v"), lambda d: series.interpolate(d, ["s"], ["i"], "v"), lambda d: series.speed(d, ["s"], ["i"], "v"), lambda d: series.trimmed_mean(d, ["s"], "v", 0.5)):
        assert f(df.limit(0)).count() == 0


def test_a_jump_just_over_half_a_turn_down_is_unwrapped(spark):
    """The rest of such a jump is so little below zero that adding a period gives the period."""
    values = [180.0, 0.0, float(np.nextafter(180, 360)), 0.0, -180.0, 0.0, 540.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "s int, i int, v double")
    got = [r.unwrapped for r in series.unwrap(df, ["s"], ["i"], "v").orderBy("i").collect()]
    assert np.allclose(got, np.unwrap(values, period=360.0), atol=1e-9)
