import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake import config
from kinelake.operators import calibrate, keypoints, measure, triangulate
from kinelake.plans import motion
from kinelake.plans.queries import associate_people, ring
from kinelake.skeletons import skeleton_table
from kinelake.streaming import online


def test_configurations_merge(tmp_path):
    (tmp_path / "Config.toml").write_text('[project]\nframe_rate = 60\nexclude_from_batch = ["T3"]\n[filtering.butterworth]\norder = 4\ncut_off_frequency = 6\n')
    for t, text in (("T1", "[filtering.butterworth]\ncut_off_frequency = 10\n"), ("T2", "[project]\nframe_range = [3, 9]\n"), ("T3", "")):
        (tmp_path / t).mkdir()
        (tmp_path / t / "Config.toml").write_text(text)
    a, b = config.trial_configs(str(tmp_path))
    assert a["filtering"]["butterworth"] == {"order": 4, "cut_off_frequency": 10} and config.frame_bounds(b) == (3, 9) and config.frame_rate(a) == 60
    assert config.trial_configs(str(tmp_path / "T2"))[0]["project"]["frame_rate"] == 60
    assert config.merge({"k": {"a": 1, "b": 2}}, {"k": {"a": 3}}) == {"k": {"a": 3, "b": 2}}
    assert config.option(a, "x.y", "project.frame_rate") == 60 and config.frame_rate({}) == 30
    assert config.participant({}, measured=1.8) == (1.8, 70.0) and config.participant({"project": {"participant_height": [1.6, 1.9]}}, 1)[0] == 1.9
    with pytest.raises(FileNotFoundError):
        config.trial_configs(str(tmp_path / "none"))


def test_points_come_back_through_all_stages(spark):
    cams, rows = ring(4), []
    for f in range(60):
        for k in range(2):
            rows.append((1, f, 0, k, 0.5 * np.cos(f / 20).item() + k, 0.01 * f + 0.2, 0.3 + 0.1 * k))
    df = spark.createDataFrame(rows, "trial int, frame int, person_id int, kpt_id int, x double, y double, z double")
    seen = triangulate.observe(df, cams, ["trial", "frame", "person_id", "kpt_id"])
    seen = seen.withColumn("score", F.when((F.col("frame") == 30) & (F.col("cam_id") > 1), 0.0).otherwise(1.0))
    seen = seen.withColumn("x", F.col("x") + F.when((F.col("frame") % 7 == 0) & (F.col("cam_id") == 2), 300.0).otherwise(0.0))
    got = motion.trajectories(seen, cams, ["trial"], 60.0, filter_name=None).join(df.withColumnsRenamed({"x": "tx", "y": "ty", "z": "tz"}), ["trial", "frame", "person_id", "kpt_id"])
    worst = got.agg(F.max(F.abs(F.col("x") - F.col("tx"))), F.max(F.abs(F.col("y") - F.col("ty"))), F.max(F.abs(F.col("z") - F.col("tz"))), F.count("*")).first()
    assert worst[3] == 120 and max(worst[:3]) < 0.02
    assert motion.trajectories(seen.filter("frame <> 30"), cams, ["trial"], 60.0, track=True).count() == 118


def test_keypoint_tools(spark):
    sk = skeleton_table(spark).filter("model = 'COCO_17'")
    rows = spark.createDataFrame([(1, 12, 5.0, 6.0, 0.9), (1, 11, 7.0, -8.0, 0.8), (1, 0, 1.0, 1.0, 0.7)], "frame int, kpt_id int, x double, y double, score double")
    got = {r.kpt_id: (r.swap_kpt_id, r.swap_x) for r in keypoints.swapped_sides(rows, sk, ["frame"]).collect()}
    assert got == {12: (11, 7.0), 11: (12, 5.0), 0: (0, 1.0)}
    assert {r.kpt_id for r in keypoints.subset(rows, sk, "right").collect()} == {12} and keypoints.subset(rows, sk, ["Nose"]).count() == 1 and keypoints.subset(rows, sk, "all").count() == 3
    assert keypoints.inside_image(rows, 100, 100).filter("x is null").count() == 1
    markers = spark.createDataFrame([("A",)], "marker string")
    assert keypoints.require_markers(markers, ["A"]).count() == 1
    with pytest.raises(ValueError):
        keypoints.require_markers(markers, ["A", "B"])
    k = [[1700.0, 0, 540], [0, 1700.0, 960], [0, 0, 1]]
    flat = keypoints.undistorted(rows.withColumn("cam_id", F.lit(1)), {1: (k, [0.0, 0.0, 0.0, 0.0])}, {1: (1080.0, 1920.0)})
    assert flat.filter("kpt_id = 12").first().x == pytest.approx(5.0, abs=1e-6)
    names = spark.createDataFrame([(0, "RAnkle", 0.0, 0.0, 0.0), (0, "RKnee", 0.0, 1.0, 0.0)], "frame int, marker string, x double, y double, z double")
    assert [(r.angle, r.degrees) for r in measure.segment_angles(names, ["frame"]).collect()] == [("right shank", 90.0)]


def test_calibration_recovers_cameras():
    rng = np.random.default_rng(1)
    k, d = np.array([[1500.0, 0, 980], [0, 1520, 530], [0, 0, 1]]), np.array([-0.1, 0.05, 0.001, -0.0005])
    r, t = np.array([0.2, -0.4, 0.1]), np.array([0.1, -0.2, 4.0])
    world = rng.uniform(-1, 1, (12, 3))
    image = calibrate.project(k, d, r, t, world)
    gr, gt, mean, total = calibrate.extrinsics(image, world, k, d)
    assert np.allclose(gr, r, atol=1e-5) and np.allclose(gt, t, atol=1e-5) and mean < 1e-4 and total >= mean
    board = np.array([(x * 0.1, y * 0.1, 0) for x in range(7) for y in range(5)])
    poses = [(rng.uniform(-0.5, 0.5, 3), np.array([rng.uniform(-0.6, 0.0), rng.uniform(-0.4, 0.0), rng.uniform(1.2, 2.0)])) for _ in range(8)]
    gk, gd, rms = calibrate.intrinsics([calibrate.project(k, d, a, b, board) for a, b in poses], [board] * 8, (1920, 1080))
    assert np.allclose(gk, k, rtol=2e-3) and np.allclose(gd[:2], d[:2], atol=0.02) and rms < 0.05


def test_streams(spark, tmp_path):
    schema = "s int, frame long, value double, at timestamp"
    spark.range(40).selectExpr("cast(id % 2 as int) s", "id div 2 as frame", "5.0D as value", "timestamp_seconds(id * 60) as at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = online.one_euro_stream(stream, ["s"], 60.0).writeStream.outputMode("append").format("memory").queryName("euro").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.sql("select * from euro").count() == 40 and spark.sql("select min(filtered), max(filtered) from euro").first()[:] == (5.0, 5.0)
    q = online.activity_stream(stream, "at", ["s"], "value").writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.sql("select sum(n), sum(total) from activity").first()[:] == (40, 200.0)


@pytest.mark.parametrize("last", [1, 2, 3, 5, 7])
def test_people_of_an_unfinished_frame_are_kept(spark, tmp_path, last):
    """Frames end after any number of rows: with the first camera alone there is nobody to match."""
    spark.range(24 + last).withColumnRenamed("id", "vec_id").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = [(i // 8, i % 8 // 2, i % 2, (i % 2 + i % 8 // 2 * (i // 8)) % 2) for i in range(24 + last)]
    assert sorted(tuple(r) for r in associate_people(spark, str(tmp_path)).collect()) == want
