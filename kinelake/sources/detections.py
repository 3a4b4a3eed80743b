"""2D detections of pose estimators as one long table.

trial columns aside, every reader gives: path, cam, frame, person_id, kpt_id, x,
y, score.  NaN becomes NULL on the way in.  Raw files are one for each camera and
frame; ingest them once and keep the table as Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PEOPLE = "version double, people array<struct<person_id:array<int>,pose_keypoints_2d:array<double>>>"


def frame_of(path: Column) -> Column:
    """The last number of a file's name."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d+)(?!.*\d)", 1).cast("long")


def camera_of(path: Column) -> Column:
    """The folder that holds a file."""
    return F.element_at(F.split(path, "/"), -2)


def _missing(c: str) -> Column:
    return F.when(~F.isnan(F.col(c)), F.col(c))


def _points(people: DataFrame, flat: str, keys: list[str]) -> DataFrame:
    """A row for each keypoint of arrays x0, y0, s0, x1, ..."""
    n = F.floor(F.size(flat) / 3).cast("int")
    rows = people.filter(F.size(flat) >= 3).select(*keys, flat, F.explode(F.sequence(F.lit(0), n - 1)).alias("kpt_id"))
    rows = rows.select(*keys, "kpt_id", *(F.get(flat, F.col("kpt_id") * 3 + i).alias(c) for i, c in enumerate(("x", "y", "score"))))
    return rows.select(*keys, "kpt_id", *(_missing(c).alias(c) for c in ("x", "y", "score")))


def read_openpose(spark: SparkSession, path: str, kpts: list[int] | None = None) -> DataFrame:
    """One JSON file for each camera and frame; broken files and absent people give no rows."""
    files = spark.read.schema(PEOPLE).option("multiLine", "true").option("mode", "PERMISSIVE").option("allowNonNumericNumbers", "true").json(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode("people").alias("person_id", "p"))
    rows = rows.select("path", camera_of(F.col("path")).alias("cam"), frame_of(F.col("path")).alias("frame"), "person_id", F.col("p.pose_keypoints_2d").alias("_flat"))
    out = _points(rows.filter("_flat is not null"), "_flat", ["path", "cam", "frame", "person_id"])
    return out if kpts is None else out.filter(F.col("kpt_id").isin(kpts))


def openpose_files(keypoints: DataFrame, keys: list[str], persons: int | None = None) -> DataFrame:
    """keys, frame, text: the JSON of each camera and frame; a person number without detection is ``{}``.

    ``keys`` name the camera (and trial); people are listed by person_id.
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(float("nan")))
    empty = F.array().cast("array<double>")
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("kpt_id", number("x").alias("x"), number("y").alias("y"), number("score").alias("s")))), lambda k: F.array(k["x"], k["y"], k["s"])))
    people = keypoints.groupBy(*keys, "frame", "person_id").agg(flat.alias("flat"))
    fields = ["face_keypoints_2d", "hand_left_keypoints_2d", "hand_right_keypoints_2d", "pose_keypoints_3d", "face_keypoints_3d", "hand_left_keypoints_3d", "hand_right_keypoints_3d"]
    person = F.to_json(F.struct(F.array(F.lit(-1)).alias("person_id"), F.col("flat").alias("pose_keypoints_2d"), *(empty.alias(f) for f in fields)))
    rows = people.groupBy(*keys, "frame").agg(F.map_from_entries(F.collect_list(F.struct(F.col("person_id").cast("int"), person))).alias("m"))
    last = F.lit(persons - 1) if persons else F.array_max(F.map_keys("m"))
    listed = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("{}")))
    return rows.select(*keys, "frame", F.concat(F.lit('{"version":1.3,"people":['), F.array_join(listed, ","), F.lit("]}")).alias("text"))


def read_alphapose(spark: SparkSession, path: str) -> DataFrame:
    """A list of {image_id, keypoints}: people of an image in order."""
    rows = spark.read.schema("image_id string, keypoints array<double>").option("multiLine", "true").json(path).withColumn("path", F.col("_metadata.file_path")).withColumn("_i", F.monotonically_increasing_id())
    from pyspark.sql import Window

    person = F.row_number().over(Window.partitionBy("path", "image_id").orderBy("_i")) - 1
    rows = rows.select("path", camera_of(F.col("path")).alias("cam"), frame_of(F.concat(F.lit("/"), "image_id")).alias("frame"), person.alias("person_id"), F.col("keypoints").alias("_flat"))
    return _points(rows, "_flat", ["path", "cam", "frame", "person_id"])


def read_mmpose(spark: SparkSession, path: str) -> DataFrame:
    """{instance_info: [{frame_id, instances: [{keypoints, keypoint_scores}]}]}."""
    kind = "instance_info array<struct<frame_id:long,instances:array<struct<keypoints:array<array<double>>,keypoint_scores:array<double>>>>>"
    rows = spark.read.schema(kind).option("multiLine", "true").json(path).select(F.col("_metadata.file_path").alias("path"), F.explode("instance_info").alias("f"))
    rows = rows.select("path", camera_of(F.col("path")).alias("cam"), F.col("f.frame_id").alias("frame"), F.posexplode("f.instances").alias("person_id", "p"))
    flat = F.flatten(F.zip_with("p.keypoints", "p.keypoint_scores", lambda k, s: F.array(k[0], k[1], s)))
    return _points(rows.withColumn("_flat", flat), "_flat", ["path", "cam", "frame", "person_id"])


def read_deeplabcut(spark: SparkSession, path: str) -> DataFrame:
    """The CSV form: three header lines (scorer, bodyparts, coords), a row for each frame, one person."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split("value", ",").alias("_c"))
    first = F.get("_c", F.lit(0)).try_cast("long")
    rows = rows.withColumn("frame", first).filter("frame is not null")
    flat = F.transform(F.slice("_c", F.lit(2), F.size("_c")), lambda v: F.coalesce(v.try_cast("double"), F.lit(0.0)))
    return _points(rows.select("path", camera_of(F.col("path")).alias("cam"), "frame", F.lit(0).alias("person_id"), flat.alias("_flat")), "_flat", ["path", "cam", "frame", "person_id"])


def read_easymocap_3d(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, person_id, kpt_id, x, y, z from lists of {id, keypoints3d}, one file for each frame."""
    rows = spark.read.schema("id int, keypoints3d array<array<double>>").option("multiLine", "true").json(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("id").alias("person_id"), F.posexplode("keypoints3d").alias("kpt_id", "k"))
    return rows.select("path", frame_of(F.col("path")).alias("frame"), "person_id", "kpt_id", *(F.get("k", F.lit(i)).alias(c) for i, c in enumerate("xyz")))


def dense_grid(keypoints: DataFrame, frames: DataFrame, cameras: list[str], persons: int, kpts: list[int]) -> DataFrame:
    """A row for every frame, camera, person and keypoint, NULL where nothing was seen.

    ``frames`` holds the frame numbers; the other sides are a rig's size.
    """
    grid = frames.select("frame", F.explode(F.array(*[F.lit(c) for c in cameras])).alias("cam"))
    grid = grid.withColumn("person_id", F.explode(F.sequence(F.lit(0), F.lit(persons - 1)))).withColumn("kpt_id", F.explode(F.array(*[F.lit(k) for k in kpts])))
    return grid.join(keypoints.select("frame", "cam", "person_id", "kpt_id", "x", "y", "score"), ["frame", "cam", "person_id", "kpt_id"], "left")


def numbered_cameras(keypoints: DataFrame) -> DataFrame:
    """cam, cam_id: camera folders numbered from 1, those without a number first, then by their last number."""
    from pyspark.sql import Window

    from kinelake.functions.geometry import natural_key

    cams = keypoints.select("cam").distinct()
    return cams.select("cam", F.row_number().over(Window.orderBy(*natural_key(F.col("cam")))).alias("cam_id"))
