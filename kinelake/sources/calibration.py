"""Camera calibration files: readers to one table, writers from it.

Calibrations are a few rows for each rig, read on the driver.  Rotations are
Rodrigues vectors, translations metres, both from world to camera axes.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from kinelake.functions import linalg

SCHEMA = "cam_id int, name string, width double, height double, k array<array<double>>, dist array<double>, rvec array<double>, tvec array<double>, residual double, frame int"
#: Tables of a calibration file that are no cameras.
NOT_CAMERAS = ("metadata", "capture_volume", "charuco", "checkerboard")


@dataclass
class Camera:
    name: str
    size: tuple[float, float]
    k: np.ndarray
    dist: list[float]
    rvec: np.ndarray
    tvec: np.ndarray
    residual: float | None = None
    frame: int | None = None
    extra: dict = field(default_factory=dict)

    def projection(self) -> np.ndarray:
        return linalg.projection(self.k, self.rvec, self.tvec)

    def optimal_projection(self) -> np.ndarray:
        """For points without distortion."""
        return linalg.projection(linalg.optimal_matrix(self.k, self.dist, self.size), self.rvec, self.tvec)


def natural(name: str) -> list:
    return [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", name)]


def last_number(name: str) -> tuple:
    found = re.findall(r"\d+", name)
    return (bool(found), int(found[-1]) if found else 0, name)


def table(spark: SparkSession, cameras: list[Camera]) -> DataFrame:
    """A row for each camera (and frame, for moving ones), numbered from 1 in order."""
    names = list(dict.fromkeys(c.name for c in cameras))
    data = [(names.index(c.name) + 1, c.name, *map(float, c.size), [[float(v) for v in r] for r in c.k], [float(v) for v in c.dist], [float(v) for v in np.ravel(c.rvec)], [float(v) for v in np.ravel(c.tvec)], c.residual, c.frame) for c in cameras]
    return spark.createDataFrame(data, SCHEMA)


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _matrix(fu: float, fv: float, cu: float, cv: float) -> np.ndarray:
    return np.array([[fu, 0, cu], [0, fv, cv], [0, 0, 1.0]])


def read_toml(spark: SparkSession, path: str) -> list[Camera]:
    """A table for each camera; matrix, rotation and translation may have an entry for each frame."""
    out = []
    for key, c in tomllib.loads(_text(spark, path)).items():
        if key in NOT_CAMERAS or not isinstance(c, dict) or "matrix" not in c:
            continue
        k, r, t = (np.array(c[n], dtype=float) for n in ("matrix", "rotation", "translation"))
        frames = max([len(a) for a, d in ((k, 3), (r, 2), (t, 2)) if a.ndim == d], default=0)
        at = lambda a, d, f: a[min(f, len(a) - 1)] if a.ndim == d else a
        for f in range(max(1, frames)):
            out.append(Camera(c.get("name", key), tuple(c["size"]), at(k, 3, f), list(c["distortions"])[:4], at(r, 2, f), at(t, 2, f), None, f if frames else None))
    return out


def write_toml(cameras: list[Camera]) -> str:
    """The text that ``read_toml`` reads."""
    row = lambda v: "[ " + ", ".join(repr(float(x)) for x in v) + "]"
    parts = []
    for c in cameras:
        k = np.asarray(c.k, dtype=float)
        parts += [
            f"[{c.name}]",
            f'name = "{c.name}"',
            f"size = {row(c.size)}",
            f"matrix = [ {row((k[0, 0], 0, k[0, 2]))}, {row((0, k[1, 1], k[1, 2]))}, {row((0, 0, 1))}]",
            f"distortions = {row(list(c.dist)[:4])}",
            f"rotation = {row(np.ravel(c.rvec))}",
            f"translation = {row(np.ravel(c.tvec))}",
            "fisheye = false",
            "",
        ]
    return "\n".join([*parts, "[metadata]", "adjusted = false", "error = 0.0", ""])


def read_qca(spark: SparkSession, path: str, binning: float = 1.0) -> list[Camera]:
    """Vendor XML with 1/64 pixel units and millimetres; marker cameras are skipped, names in natural order."""
    out = []
    for cam in ET.fromstring(_text(spark, path)).iter("camera"):
        if not any(m in cam.get("model", "").lower() for m in ("video", "none")):
            continue
        fov, i, t = (cam.find(n).attrib for n in ("fov_video", "intrinsic", "transform"))
        unit = lambda n: float(i[n]) / 64 / binning  # noqa: B023, E731
        edge = lambda n: float(fov[n])  # noqa: B023, E731
        k = _matrix(unit("focalLengthU"), unit("focalLengthV"), unit("centerPointU") - edge("left"), unit("centerPointV") - edge("top"))
        r = np.array([[float(t[f"r{a}{b}"]) for a in (1, 2, 3)] for b in (1, 2, 3)])
        position = np.array([float(t[a]) / 1000 for a in "xyz"])
        r, tv = linalg.world_to_camera(r, position)
        r, tv = linalg.rotate_camera(r, tv, np.pi)
        dist = [unit(n) for n in ("radialDistortion1", "radialDistortion2", "tangentalDistortion1", "tangentalDistortion2")]
        size = ((edge("right") - edge("left") + 1) / binning, (edge("bottom") - edge("top") + 1) / binning)
        out.append(Camera(cam.get("serial"), size, k, dist, linalg.rotation_vector(r), tv, float(cam.get("avg-residual", "nan"))))
    return sorted(out, key=lambda c: natural(c.name))


def write_qca(cameras: list[Camera], pixel_size: float = 5.54e-3) -> str:
    """The inverse of ``read_qca`` without binning; ``pixel_size`` in millimetres gives the focal length."""
    root = ET.Element("calibration", {"type": "regular", "source": "calibration"})
    group = ET.SubElement(root, "cameras")
    for c in cameras:
        k, (w, h) = np.asarray(c.k), c.size
        r, t = linalg.rotate_camera(linalg.rodrigues(c.rvec), c.tvec, -np.pi)
        r, t = linalg.world_to_camera(r, t)
        cam = ET.SubElement(group, "camera", {"active": "1", "avg-residual": str(c.residual or 0.0), "model": "none", "serial": c.name, "viewrotation": "0"})
        ET.SubElement(cam, "fov_video", {"left": "0", "top": "0", "right": str(int(w) - 1), "bottom": str(int(h) - 1)})
        ET.SubElement(cam, "transform", {**{a: repr(float(v) * 1000) for a, v in zip("xyz", t, strict=True)}, **{f"r{a + 1}{b + 1}": repr(float(r[b, a])) for a in range(3) for b in range(3)}})
        names = dict(zip(("radialDistortion1", "radialDistortion2", "tangentalDistortion1", "tangentalDistortion2"), c.dist, strict=False))
        numbers = {"focalLengthU": k[0, 0], "focalLengthV": k[1, 1], "centerPointU": k[0, 2], "centerPointV": k[1, 2], **names}
        ET.SubElement(cam, "intrinsic", {n: repr(float(v) * 64) for n, v in numbers.items()} | {"focallength": repr(float(k[0, 0]) * pixel_size)})
    return ET.tostring(root, encoding="unicode")


def read_xcp(spark: SparkSession, path: str) -> list[Camera]:
    """Vicon cameras: unit quaternions with the scalar last, millimetres, radial distortion only."""
    out = []
    for cam in ET.fromstring(_text(spark, path)).iter("Camera"):
        if "video" not in cam.get("TYPE", "").lower():
            continue
        key = cam.find("KeyFrames/KeyFrame").attrib
        numbers = lambda n: [float(v) for v in key[n].split()]  # noqa: B023, E731
        radial = key["VICON_RADIAL2"].split()[3:5] if "VICON_RADIAL2" in key else key["VICON_RADIAL"].split()
        fu = float(key["FOCAL_LENGTH"])
        k = _matrix(fu, fu / float(cam.get("PIXEL_ASPECT_RATIO")), *numbers("PRINCIPAL_POINT"))
        r, t = linalg.world_to_camera(linalg.quaternion_matrix(numbers("ORIENTATION"), 3), np.array(numbers("POSITION")) / 1000)
        size = tuple(float(v) for v in cam.get("SENSOR_SIZE").split())
        out.append(Camera(cam.get("DEVICEID"), size, k, [*map(float, radial), 0.0, 0.0], linalg.rotation_vector(r), t, float(key["WORLD_ERROR"])))
    return sorted(out, key=lambda c: natural(c.name))


def _yaml(text: str) -> dict[str, list]:
    """Lists and matrices of a storage file: ``names`` and ``key: !!opencv-matrix`` blocks."""
    out: dict[str, list] = {}
    names = re.search(r"names:\s*((?:\n\s*-\s*\S+)+)", text)
    out["names"] = [n.strip('"') for n in re.findall(r"-\s*(\S+)", names[1])] if names else []
    for key, rows, cols, data in re.findall(r"(\w+):\s*!!opencv-matrix\s*rows:\s*(\d+)\s*cols:\s*(\d+)\s*dt:\s*\w+\s*data:\s*\[([^\]]*)\]", text):
        out[key] = np.array([float(v) for v in data.replace("\n", " ").split(",")]).reshape(int(rows), int(cols))
    return out


def read_easymocap(spark: SparkSession, intrinsic: str, extrinsic: str) -> list[Camera]:
    """Two storage files; the image is taken to be twice its principal point."""
    a, b = _yaml(_text(spark, intrinsic)), _yaml(_text(spark, extrinsic))
    return [Camera(n, (a[f"K_{n}"][0, 2] * 2, a[f"K_{n}"][1, 2] * 2), a[f"K_{n}"], a[f"dist_{n}"].ravel()[:4].tolist(), b[f"R_{n}"].ravel(), b[f"T_{n}"].ravel()) for n in a["names"]]


def write_easymocap(cameras: list[Camera]) -> tuple[str, str]:
    """The two texts that ``read_easymocap`` reads."""

    def matrix(key: str, m: np.ndarray) -> str:
        m = np.atleast_2d(np.asarray(m, dtype=float))
        return f"{key}: !!opencv-matrix\n  rows: {m.shape[0]}\n  cols: {m.shape[1]}\n  dt: d\n  data: [{', '.join(repr(float(v)) for v in m.ravel())}]\n"

    head = "%YAML:1.0\n---\nnames:\n" + "".join(f'  - "{c.name}"\n' for c in cameras)
    intrinsic = head + "".join(matrix(f"K_{c.name}", c.k) + matrix(f"dist_{c.name}", [*list(c.dist)[:4], 0.0]) for c in cameras)
    column = lambda v: np.reshape(v, (3, 1))
    extrinsic = head + "".join(matrix(f"R_{c.name}", column(c.rvec)) + matrix(f"Rot_{c.name}", linalg.rodrigues(c.rvec)) + matrix(f"T_{c.name}", column(c.tvec)) for c in cameras)
    return intrinsic, extrinsic


def read_biocv(spark: SparkSession, paths: list[str]) -> list[Camera]:
    """Plain text for each camera: width, height, 3 rows of K, blank, rows of [R | T] in millimetres, distortion at the end."""
    out = []
    for i, path in enumerate(paths):
        lines = _text(spark, path).split("\n")
        grid = lambda a, b: np.array([[float(v) for v in r.split()] for r in lines[a:b]])  # noqa: B023, E731
        rt = grid(6, 9)
        dist = [float(v) for v in [x for x in lines if x.strip()][-1].split()[:4]]
        out.append(Camera(f"cam_{i:02d}", (float(lines[0]), float(lines[1])), grid(2, 5), dist, linalg.rotation_vector(rt[:, :3]), rt[:, 3] / 1000))
    return out


def read_opencap(spark: SparkSession, paths: list[str]) -> list[Camera]:
    """JSON form of the cameras (imageSize, distortion, intrinsicMat, rotation, translation); pickles are not loaded.

    The vertical board's world is turned into one with z up.
    """
    out = []
    for i, path in enumerate(paths):
        d = {k: np.array(v, dtype=float) for k, v in json.loads(_text(spark, path)).items()}
        tv = d["translation"].reshape(3)
        r, t = linalg.world_to_camera(d["rotation"], tv)
        r, t = linalg.rotate_camera(r, t, -np.pi / 2, 0, np.pi)
        r, _ = linalg.world_to_camera(r, t)
        out.append(Camera(f"cam_{i:02d}", tuple(d["imageSize"].reshape(-1)[::-1]), d["intrinsicMat"], d["distortion"].reshape(-1)[:4].tolist(), linalg.rotation_vector(r), tv / 1000))
    return out


def write_opencap(camera: Camera) -> str:
    """The inverse of ``read_opencap`` for one camera."""
    r, t = linalg.world_to_camera(linalg.rodrigues(camera.rvec), camera.tvec)
    turn = linalg.rotate_camera(np.eye(3), np.zeros(3), -np.pi / 2, 0, np.pi)[0]
    r, _ = linalg.world_to_camera(turn.T @ r, turn.T @ t)
    return json.dumps({"imageSize": [[camera.size[1]], [camera.size[0]]], "distortion": [[*list(camera.dist)[:4], 0.0]], "intrinsicMat": np.asarray(camera.k).tolist(), "rotation": r.tolist(), "translation": (np.ravel(camera.tvec) * 1000).tolist()})


def read_optitrack(*_) -> list[Camera]:
    raise NotImplementedError("this system exports no calibration; enter the cameras into a TOML file by hand")


def recap(spark: SparkSession, cameras: list[Camera]) -> DataFrame:
    """cam, residual in millimetres and in pixels (through distance and focal length)."""
    data = [(c.name, c.residual, None if c.residual is None else c.residual / 1000 * float(np.asarray(c.k)[0, 0]) / float(np.linalg.norm(c.tvec))) for c in cameras]
    return spark.createDataFrame(data, "cam string, residual_mm double, residual_px double")


READERS = {"toml": read_toml, "qca": read_qca, "xcp": read_xcp, "easymocap": read_easymocap, "biocv": read_biocv, "opencap": read_opencap, "optitrack": read_optitrack}
