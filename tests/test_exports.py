import json

import numpy as np
import pytest

from kinelake.functions import sql
from kinelake.plans.queries import ring
from kinelake.sources import detections, exports


def rows(spark):
    data = [("t", 3, 0, 0, 1.0, 2.0, 0.9), ("t", 3, 0, 1, None, None, None), ("t", 4, 0, 0, 5.0, 7.0, 0.8), ("t", 4, 0, 1, 9.0, 8.0, 0.7)]
    return spark.createDataFrame(data, "trial string, frame int, person_id int, kpt_id int, x double, y double, score double")


def test_coco_file(spark):
    (r,) = exports.coco_json(rows(spark), ["trial"], 100, 200).collect()
    d = json.loads(r.text)
    assert r.file_name == "t_coco.json" and [i["id"] for i in d["images"]] == [3, 4]
    assert d["annotations"][0]["keypoints"] == [1.0, 2.0, 2.0, 0.0, 0.0, 0.0] and d["annotations"][1]["bbox"] == [5.0, 7.0, 4.0, 1.0]


def test_csv_is_read_back(spark, tmp_path):
    (r,) = exports.deeplabcut_csv(rows(spark), ["trial"], ["a", "b"]).collect()
    (tmp_path / "x.csv").write_text(r.text)
    got = detections.read_deeplabcut(spark, str(tmp_path / "x.csv")).orderBy("frame", "kpt_id").collect()
    assert r.file_name == "t_P0_dlc.csv" and [(g.frame, g.kpt_id, g.x) for g in got] == [(3, 0, 1.0), (3, 1, 0.0), (4, 0, 5.0), (4, 1, 9.0)]


def test_gait_report(spark):
    events = spark.createDataFrame([("t", "R", "on", 30), ("t", "R", "on", 90), ("t", "L", "off", 60)], "trial string, side string, kind string, frame long")
    (r,) = exports.gait_report(events, ["trial"], 60.0).collect()
    assert r.text == "L off: 1.000\nR on: 0.500, 1.500"


def test_sql_functions(spark):
    assert "triangulate_dlt" in sql.register(spark)
    cams = ring(3)
    q = np.array([0.2, -0.1, 0.4, 1])
    h = [m @ q for _, m in cams]
    p = [float(v) for _, m in cams for v in m.ravel()]
    df = spark.createDataFrame([(p, [float(v[0] / v[2]) for v in h], [float(v[1] / v[2]) for v in h], [1.0] * 3), (p, [1.0, None, None], [1.0, None, None], [1.0] * 3)], "p array<double>, x array<double>, y array<double>, s array<double>")
    df.createOrReplaceTempView("seen")
    a, b = [r.q for r in spark.sql("select triangulate_dlt(p, x, y, s) as q from seen").collect()]
    assert a == pytest.approx([0.2, -0.1, 0.4]) and b is None
    got = spark.sql("select butterworth(array_repeat(2.0D, 40), 60.0D) as v, hampel(array(1.0D, null), 60.0D) as h").first()
    assert got.v == pytest.approx([2.0] * 40) and got.h == [1.0, None]
