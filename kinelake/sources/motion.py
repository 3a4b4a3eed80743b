"""Trajectory and angle files: TRC, MOT and C3D, as long tables."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, lines (array) of every file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\r?\n").alias("lines"))


def read_trc(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, time, marker_idx, marker, x, y, z; blank cells are NULL."""
    rows = _lines(spark, path).withColumn("_names", F.filter(F.split(F.get("lines", F.lit(3)), "\t"), lambda c: F.trim(c) != ""))
    rows = rows.select("path", F.slice("_names", F.lit(3), F.size("_names")).alias("_markers"), F.explode(F.slice("lines", F.lit(6), F.size("lines"))).alias("_line")).filter("trim(_line) <> ''")
    rows = rows.withColumn("_cells", F.split("_line", "\t"))
    cell = lambda i: F.get("_cells", i).try_cast("double")
    rows = rows.select("path", cell(F.lit(0)).cast("long").alias("frame"), cell(F.lit(1)).alias("time"), "_cells", F.posexplode("_markers").alias("marker_idx", "marker"))
    at = F.lit(2) + F.col("marker_idx") * 3
    return rows.select("path", "frame", "time", "marker_idx", F.trim("marker").alias("marker"), *(cell(at + i).alias(c) for i, c in enumerate("xyz")))


def read_trc_header(spark: SparkSession, path: str) -> DataFrame:
    """path and the header's values by name."""
    rows = _lines(spark, path)
    names, values = F.split(F.get("lines", F.lit(1)), "\t"), F.split(F.get("lines", F.lit(2)), "\t")
    return rows.select("path", F.map_from_arrays(names, F.slice(values, F.lit(1), F.size(names))).alias("header"))


def format_trc(rows: pd.DataFrame, name: str, rate: float, unit: str = "m") -> str:
    """The text of a TRC file from (frame, time, marker_idx, marker, x, y, z) rows."""
    markers = rows.drop_duplicates("marker_idx").sort_values("marker_idx")["marker"].tolist()
    wide = rows.pivot(index=["frame", "time"], columns="marker_idx", values=["x", "y", "z"]).sort_index()
    wide = wide.reorder_levels([1, 0], axis=1).sort_index(axis=1)
    first = int(rows["frame"].min()) if len(rows) else 0
    rate_text = f"{rate:g}"
    head = [
        f"PathFileType\t4\t(X/Y/Z)\t{name}",
        "DataRate\tCameraRate\tNumFrames\tNumMarkers\tUnits\tOrigDataRate\tOrigDataStartFrame\tOrigNumFrames",
        f"{rate_text}\t{rate_text}\t{len(wide)}\t{len(markers)}\t{unit}\t{rate_text}\t{first}\t{len(wide)}",
        "Frame#\tTime\t" + "\t\t\t".join(markers) + "\t\t\t",
        "\t\t" + "\t".join(f"X{i}\tY{i}\tZ{i}" for i in range(1, len(markers) + 1)) + "\t",
    ]
    text = lambda v: "" if pd.isna(v) else repr(float(v))
    body = ["\t".join([str(int(f)), repr(float(t)), *map(text, r)]) for (f, t), r in zip(wide.index, wide.to_numpy(), strict=True)]
    return "\n".join([*head, *body, ""])


def trc_files(markers: DataFrame, keys: list[str], rate: float, unit: str = "m") -> DataFrame:
    """file_name, text of one TRC file for each group of ``keys``: {keys}_{first}-{last}.trc."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        stem = "_".join(str(rows[k].iloc[0]) for k in keys)
        name = f"{stem}_{int(rows['frame'].min())}-{int(rows['frame'].max())}.trc"
        return pd.DataFrame({"file_name": [name], "text": [format_trc(rows, name, rate, unit)]})

    return markers.groupBy(*keys).applyInPandas(run, "file_name string, text string")


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """path, time, coord, value; the header reaches to its end mark."""
    rows = _lines(spark, path)
    end = F.array_position(F.transform("lines", lambda x: F.lower(F.trim(x))), "endheader")
    rows = rows.withColumn("_end", end.cast("int")).withColumn("_names", F.split(F.get("lines", F.col("_end")), "\t"))
    rows = rows.select("path", "_names", F.explode(F.slice("lines", F.col("_end") + 2, F.size("lines"))).alias("_line")).filter("trim(_line) <> ''")
    rows = rows.withColumn("_cells", F.split("_line", "\t"))
    rows = rows.select("path", F.get("_cells", F.lit(0)).try_cast("double").alias("time"), "_cells", F.posexplode("_names").alias("_i", "coord")).filter("_i > 0")
    return rows.select("path", "time", F.trim("coord").alias("coord"), F.get("_cells", F.col("_i")).try_cast("double").alias("value"))


def format_mot(rows: pd.DataFrame, name: str, degrees: bool = True) -> str:
    """The text of a MOT file from (time, coord, value) rows, coordinates in order of appearance."""
    coords = list(dict.fromkeys(rows["coord"]))
    wide = rows.pivot(index="time", columns="coord", values="value")[coords].sort_index()
    head = [name, "version=1", f"nRows={len(wide)}", f"nColumns={len(coords) + 1}", f"inDegrees={'yes' if degrees else 'no'}", "endheader", "\t".join(["time", *coords])]
    body = ["\t".join([repr(float(t)), *("" if pd.isna(v) else repr(float(v)) for v in r)]) for t, r in zip(wide.index, wide.to_numpy(), strict=True)]
    return "\n".join([*head, *body, ""])


def format_c3d(labels: list[str], points: np.ndarray, rate: float) -> bytes:
    """A C3D file of points (frames, markers, 3) in metres: floats in millimetres, screen axes +Z and +Y."""
    n, m = points.shape[:2]

    def parameter(group: int, name: str, kind: int, dims: list[int], data: bytes, last: bool = False) -> bytes:
        body = struct.pack("<bB", kind, len(dims)) + bytes(dims) + data + b"\0"
        return struct.pack("<bb", len(name), group) + name.encode() + struct.pack("<h", 0 if last else len(body) + 2) + body

    def group(number: int, name: str) -> bytes:
        return struct.pack("<bb", len(name), -number) + name.encode() + struct.pack("<h", 3) + b"\0"

    width = max([len(x) for x in labels], default=1)
    text = b"".join(x.encode().ljust(width) for x in labels)
    used = min(n, 65535)
    parts = [
        group(1, "POINT"),
        parameter(1, "USED", 2, [], struct.pack("<H", m)),
        parameter(1, "SCALE", 4, [], struct.pack("<f", -1.0)),
        parameter(1, "RATE", 4, [], struct.pack("<f", rate)),
        parameter(1, "FRAMES", 2, [], struct.pack("<H", used)),
        parameter(1, "UNITS", -1, [2], b"mm"),
        parameter(1, "X_SCREEN", -1, [2], b"+Z"),
        parameter(1, "Y_SCREEN", -1, [2], b"+Y"),
        parameter(1, "LABELS", -1, [width, m], text, True),
    ]
    body = b"".join(parts)
    blocks = -(-(len(body) + 4) // 512)
    params = (bytes([1, 80, blocks, 84]) + body).ljust(512 * blocks, b"\0")
    header = struct.pack("<BBHHHHHfHHf", 2, 80, m, 0, 1, used, 10, -1.0, 2 + blocks, 0, rate).ljust(512, b"\0")
    values = np.zeros((n, m, 4), dtype="<f4")
    values[..., :3] = np.nan_to_num(points * 1000)
    values[..., 3] = np.where(np.isfinite(points).all(axis=-1), 0.0, -1.0)
    data = values.tobytes()
    return header + params + data.ljust(-(-len(data) // 512) * 512, b"\0")


#: Labels of a C3D file that are no markers.
NOT_MARKERS = ("Angle", "Power", "Force", "Moment", "GRF")


def parse_c3d(data: bytes) -> tuple[list[str], np.ndarray, float]:
    """Labels, points (frames, markers, 3) in metres and rate of a C3D file; invalid points are NaN."""
    at = (data[0] - 1) * 512 + 4
    groups, params = {}, {}
    while at < len(data):
        n, number = struct.unpack_from("<bb", data, at)
        if not n:
            break
        name = data[at + 2 : at + 2 + abs(n)].decode("latin-1").upper()
        jump_at = at + 2 + abs(n)
        (jump,) = struct.unpack_from("<h", data, jump_at)
        if number < 0:
            groups[-number] = name
        else:
            kind, nd = struct.unpack_from("<bB", data, jump_at + 2)
            dims = list(data[jump_at + 4 : jump_at + 4 + nd])
            start = jump_at + 4 + nd
            params[(number, name)] = (kind, dims, data[start : start + abs(kind) * int(np.prod(dims, dtype=int))])
        if not jump:
            break
        at = jump_at + jump
    point = next(k for k, v in groups.items() if v == "POINT")
    get = lambda name: params.get((point, name))
    scale = struct.unpack("<f", get("SCALE")[2])[0]
    rate = struct.unpack("<f", get("RATE")[2])[0]
    unit = get("UNITS")[2].decode().strip() if get("UNITS") else "mm"
    _, dims, raw = get("LABELS")
    labels = [raw[i * dims[0] : (i + 1) * dims[0]].decode("latin-1").strip() for i in range(dims[1])]
    m = struct.unpack_from("<H", data, 2)[0]
    first, last = struct.unpack_from("<HH", data, 6)
    start = struct.unpack_from("<H", data, 16)[0]
    analog = struct.unpack_from("<H", data, 4)[0]
    kind = "<f4" if scale < 0 else "<i2"
    n = last - first + 1
    values = np.frombuffer(data, dtype=kind, count=n * (4 * m + analog), offset=(start - 1) * 512).reshape(n, -1)[:, : 4 * m].reshape(n, m, 4).astype(float)
    points = values[..., :3] * (1.0 if scale < 0 else scale) * {"m": 1.0, "cm": 0.01, "mm": 0.001}.get(unit, 0.001)
    points[values[..., 3] < 0] = np.nan
    keep = [i for i, x in enumerate(labels[:m]) if not any(w in x for w in NOT_MARKERS)]
    return [labels[i] for i in keep], points[:, keep], rate


def read_c3d(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, time, marker_idx, marker, x, y, z of the points of C3D files."""

    def run(frames):
        for pdf in frames:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                labels, points, rate = parse_c3d(content)
                n, m = points.shape[:2]
                frame = np.repeat(np.arange(n), m)
                xyz = points.reshape(-1, 3)
                yield pd.DataFrame({"path": p, "frame": frame, "time": frame / rate, "marker_idx": np.tile(np.arange(m), n), "marker": labels * n, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(run, "path string, frame long, time double, marker_idx int, marker string, x double, y double, z double")
    return rows.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in "xyz"})
