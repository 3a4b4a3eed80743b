import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake import skeletons
from kinelake.functions import linalg
from kinelake.sources import calibration as cal
from kinelake.sources import detections, motion


def cameras():
    rng = np.random.default_rng(1)
    return [cal.Camera(f"cam{i:02d}", (1080.0, 1920.0), np.array([[1700.0 + i, 0, 540.5], [0, 1690.0, 960.25], [0, 0, 1]]), [-0.04, 0.1, 0.001, 0.0005], rng.uniform(-1, 1, 3), rng.uniform(-3, 3, 3), 0.4) for i in range(1, 4)]


def same(a, b, size=True):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x.name == y.name and np.allclose(x.k, y.k) and np.allclose(x.dist, y.dist) and np.allclose(linalg.rodrigues(x.rvec), linalg.rodrigues(y.rvec)) and np.allclose(x.tvec, y.tvec)
        assert not size or np.allclose(x.size, y.size)


def test_calibration_files_round_trip(spark, tmp_path):
    c = cameras()

    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    same(cal.read_toml(spark, put("c.toml", cal.write_toml(c))), c)
    same(cal.read_qca(spark, put("c.qca.txt", cal.write_qca(c))), c)
    a, b = cal.write_easymocap(c)
    same(cal.read_easymocap(spark, put("intri.yml", a), put("extri.yml", b)), c, size=False)
    got = cal.read_opencap(spark, [put("c0.json", cal.write_opencap(c[0]))])[0]
    assert np.allclose(linalg.rodrigues(got.rvec), linalg.rodrigues(c[0].rvec)) and np.allclose(got.tvec, c[0].tvec) and got.size == (1080.0, 1920.0)
    with pytest.raises(NotImplementedError):
        cal.read_optitrack()
    assert cal.table(spark, c).count() == 3 and cal.recap(spark, c).filter("residual_px > 0").count() == 3


def test_moving_cameras_have_a_row_for_each_frame(spark, tmp_path):
    (tmp_path / "m.toml").write_text('[a]\nname = "a"\nsize = [10, 20]\nmatrix = [[1.0,0.0,0.0],[0.0,1.0,0.0],[0.0,0.0,1.0]]\ndistortions = [0.0,0.0,0.0,0.0]\nrotation = [[0.0,0.0,0.0],[0.1,0.0,0.0]]\ntranslation = [[0.0,0.0,1.0],[0.0,0.0,2.0]]\n[metadata]\nadjusted = false\n')
    got = cal.read_toml(spark, str(tmp_path / "m.toml"))
    assert [c.frame for c in got] == [0, 1] and got[1].tvec[2] == 2.0 and got[0].projection().shape == (3, 4)


def test_other_vendor_files(spark, tmp_path):
    (tmp_path / "v.xcp").write_text('<Cameras><Camera DEVICEID="9" SENSOR_SIZE="1920 1080" PIXEL_ASPECT_RATIO="1" TYPE="VideoCam"><KeyFrames><KeyFrame FOCAL_LENGTH="1500" PRINCIPAL_POINT="960 540" ORIENTATION="0 0 0 1" POSITION="1000 2000 3000" WORLD_ERROR="0.5" VICON_RADIAL2="a b c 0.1 0.2"/></KeyFrames></Camera><Camera DEVICEID="2" TYPE="Vantage"/></Cameras>')
    (v,) = cal.read_xcp(spark, str(tmp_path / "v.xcp"))
    assert v.name == "9" and v.dist == [0.1, 0.2, 0.0, 0.0] and np.allclose(v.tvec, [-1, -2, -3])
    (tmp_path / "b.calib").write_text("1920\n1080\n1000 0 960\n0 1000 540\n0 0 1\n\n1 0 0 100\n0 1 0 200\n0 0 1 300\n0 0 0 1\n\n0.1 0.2 0.3 0.4 0.5\n")
    (b,) = cal.read_biocv(spark, [str(tmp_path / "b.calib")])
    assert b.size == (1920, 1080) and np.allclose(b.tvec, [0.1, 0.2, 0.3]) and b.dist == [0.1, 0.2, 0.3, 0.4]


def trajectories():
    rows = []
    for f in range(3):
        for i, m in enumerate(("RHip", "LHip")):
            rows.append((f + 5, (f + 5) / 60, i, m, 0.5 * f, None if f == 1 else float(i), -1.25))
    return pd.DataFrame(rows, columns=["frame", "time", "marker_idx", "marker", "x", "y", "z"])


def test_trc_round_trip(spark, tmp_path):
    (tmp_path / "t.trc").write_text(motion.format_trc(trajectories(), "t.trc", 60))
    got = motion.read_trc(spark, str(tmp_path / "t.trc")).drop("path").orderBy("frame", "marker_idx").toPandas()
    pd.testing.assert_frame_equal(got.astype({"marker_idx": "int64"}), trajectories(), check_dtype=False)
    assert motion.read_trc_header(spark, str(tmp_path / "t.trc")).first().header["NumMarkers"] == "2"
    df = spark.createDataFrame(trajectories().assign(trial="walk", person=1))
    assert motion.trc_files(df, ["trial", "person"], 60).first().file_name == "walk_1_5-7.trc"


def test_mot_round_trip(spark, tmp_path):
    rows = pd.DataFrame([(t / 10, c, None if t == 1 and c == "b" else t + 0.5) for t in range(3) for c in ("a", "b")], columns=["time", "coord", "value"])
    (tmp_path / "m.mot").write_text(motion.format_mot(rows, "m"))
    got = motion.read_mot(spark, str(tmp_path / "m.mot")).drop("path").orderBy("time", "coord").toPandas()
    pd.testing.assert_frame_equal(got, rows, check_dtype=False)


def test_c3d_round_trip(spark, tmp_path):
    points = np.random.default_rng(1).uniform(-2, 2, (7, 3, 3))
    points[2, 1] = np.nan
    (tmp_path / "p.c3d").write_bytes(motion.format_c3d(["RHip", "LAnkleForce", "Head"], points, 120))
    labels, got, rate = motion.parse_c3d((tmp_path / "p.c3d").read_bytes())
    assert labels == ["RHip", "Head"] and rate == 120 and np.allclose(got, points[:, [0, 2]], atol=1e-5)
    rows = motion.read_c3d(spark, str(tmp_path / "p.c3d"))
    assert rows.count() == 14 and rows.filter("x is null").count() == 0


def test_detections_with_every_defect(spark, tmp_path):
    folder = tmp_path / "pose" / "cam01_json"
    folder.mkdir(parents=True)
    (folder / "v_000001.json").write_text('{"version":1.3,"people":[{"person_id":[-1],"pose_keypoints_2d":[1.0,2.0,0.9,NaN,4.0,0.1]},{},{"pose_keypoints_2d":[1.0]}]}')
    (folder / "v_000002.json").write_text('{"version":1.3,"people":[]}')
    (folder / "v_000003.json").write_text("not json")
    rows = detections.read_openpose(spark, str(folder)).orderBy("frame", "kpt_id").collect()
    assert [(r.cam, r.frame, r.person_id, r.kpt_id, r.x, r.y, r.score) for r in rows] == [("cam01_json", 1, 0, 0, 1.0, 2.0, 0.9), ("cam01_json", 1, 0, 1, None, 4.0, 0.1)]


def test_detections_are_written_as_they_were_read(spark, tmp_path):
    rows = spark.createDataFrame([("c", 4, 0, 0, 1.0, 2.0, 0.5), ("c", 4, 0, 1, 3.0, None, 0.5), ("c", 4, 2, 0, 5.0, 6.0, 0.7)], "cam string, frame long, person_id int, kpt_id int, x double, y double, score double")
    out = detections.openpose_files(rows, ["cam"], 4).collect()
    folder = tmp_path / "c"
    folder.mkdir()
    for r in out:
        (folder / f"v_{r.frame:06d}.json").write_text(r.text)
    assert out[0].text.count("{}") == 2
    got = detections.read_openpose(spark, str(folder)).select("cam", "frame", "person_id", "kpt_id", "x", "y", "score")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))


def test_other_detectors(spark, tmp_path):
    for name, text in {"a": '[{"image_id":"3.jpg","keypoints":[1,2,0.5]},{"image_id":"3.jpg","keypoints":[4,5,0.6]}]', "m": '{"instance_info":[{"frame_id":7,"instances":[{"keypoints":[[1,2],[3,4]],"keypoint_scores":[0.5,0.6]}]}]}', "e": '[{"id":2,"keypoints3d":[[1,2,3,0.9]]}]'}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "000008.json").write_text(text)
    assert [(r.frame, r.person_id, r.x) for r in detections.read_alphapose(spark, str(tmp_path / "a")).orderBy("person_id").collect()] == [(3, 0, 1.0), (3, 1, 4.0)]
    assert [(r.frame, r.kpt_id, r.y, r.score) for r in detections.read_mmpose(spark, str(tmp_path / "m")).orderBy("kpt_id").collect()] == [(7, 0, 2.0, 0.5), (7, 1, 4.0, 0.6)]
    assert [(r.frame, r.person_id, r.z) for r in detections.read_easymocap_3d(spark, str(tmp_path / "e")).collect()] == [(8, 2, 3.0)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.csv").write_text("scorer,a,a,a\nbodyparts,n,n,n\ncoords,x,y,likelihood\n0,1.5,2.5,0.9\n1,,,\n")
    assert [(r.frame, r.x) for r in detections.read_deeplabcut(spark, str(tmp_path / "d")).orderBy("frame").collect()] == [(0, 1.5), (1, 0.0)]
    cams = detections.numbered_cameras(spark.createDataFrame([("cam10",), ("cam2",), ("front",)], "cam string"))
    assert {r.cam: r.cam_id for r in cams.collect()} == {"front": 1, "cam2": 2, "cam10": 3}


def test_skeletons(spark):
    table = skeletons.skeleton_table(spark, {"OWN": skeletons.from_tree({"name": "Hip", "id": None, "children": [{"name": "RHip", "id": 0}, {"name": "LHip", "id": 1}]})})
    counts = {r.model: (r.n, r.m) for r in table.groupBy("model").agg(F.count("*").alias("n"), F.max("kpt_id").alias("m")).collect()}
    assert counts["HALPE_26"] == (22, 25) and counts["COCO_133_WRIST"] == (27, 129) and counts["BODY_135"] == (27, 63) and counts["HAND_21"] == (21, 20) and counts["MPII"] == (15, 14) and counts["BLAZEPOSE"] == (25, 32)
    own = {r.name: r.swap_kpt_id for r in table.filter("model = 'OWN'").collect()}
    assert own == {"RHip": 1, "LHip": 0}
    assert table.filter("model = 'HAND_21' and kpt_id <> swap_kpt_id").count() == 0
    assert skeletons.nodes_of("BODY_WITH_FEET") == skeletons.nodes_of("HALPE_26")
