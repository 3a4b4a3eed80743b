"""Operators bound to tables, each with the SQL that gives the same rows where SQL can.

The tables hold no motion, so columns stand in for it: users are series, the
components of embeddings are coordinates, order lines are cameras or people.
Averages and other inexact results are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake import skeletons
from kinelake.functions import geometry as g
from kinelake.functions.linalg import projection
from kinelake.operators import associate, filters, gait, measure, series, sync, tracking, triangulate
from kinelake.sources import detections

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c + 1e-9, digits)


# Series: one for each user, in order of time.

ORDER = ["ts", "event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("gappy", F.when(F.col("value") <= 60, F.col("value")))


_GAPPY = "(SELECT user_id, ts, event_id, CASE WHEN value <= 60 THEN value END AS gappy FROM events)"
_SERIES = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"""
WITH w AS (SELECT event_id, value, list(value) OVER ({_SERIES} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS win FROM events),
m AS (SELECT *, list_sort(win)[4] AS med FROM w),
s AS (SELECT *, list_sort(list_transform(win, lambda v: abs(v - med)))[4] AS mad FROM m)
SELECT event_id, CASE WHEN len(win) = 7 AND mad > 0 AND abs((0.6745 * (value - med)) / mad) > 2 THEN med ELSE value END AS filtered FROM s
""")
def hampel(spark, sf_dir):
    return series.hampel(events(spark, sf_dir), ["user_id"], ORDER, "value").select("event_id", "filtered")


@query(f"""
WITH n AS (SELECT user_id, row_number() OVER ({_SERIES}) - 1 AS i, value < 20 AS ok FROM events),
k AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM n WHERE ok)
SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS length FROM k GROUP BY user_id, island
""")
def valid_runs(spark, sf_dir):
    return series.valid_runs(events(spark, sf_dir), ["user_id"], ORDER, F.col("value") < 20)


@query(f"""
WITH n AS (SELECT user_id, row_number() OVER ({_SERIES}) - 1 AS i, value < 40 AS ok FROM events),
k AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM n WHERE ok),
r AS (SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS length FROM k GROUP BY user_id, island HAVING count(*) >= 3)
SELECT user_id, first, last, length FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, first) = 1
""")
def largest_run(spark, sf_dir):
    return series.valid_runs(events(spark, sf_dir), ["user_id"], ORDER, F.col("value") < 40, shortest=3, choose="largest")


@query(f"""
WITH n AS (SELECT event_id, user_id, row_number() OVER ({_SERIES}) - 1 AS i, value < 40 AS ok FROM events),
k AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM n WHERE ok),
r AS (SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS length FROM k GROUP BY user_id, island),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, first) = 1)
SELECT n.event_id FROM n JOIN b ON n.user_id = b.user_id AND n.i BETWEEN b.first AND b.last
""")
def trim_to_run(spark, sf_dir):
    return series.trim_to_run(events(spark, sf_dir), ["user_id"], ORDER, F.col("value") < 40).select("event_id")


@query(f"""
WITH e AS {_GAPPY},
n AS (SELECT *, row_number() OVER ({_SERIES}) AS i, nullif(gappy, 0) AS good FROM e),
p AS (SELECT *, count(good) OVER (PARTITION BY user_id) AS n_good,
  last_value(CASE WHEN good IS NOT NULL THEN i END IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ia,
  last_value(good IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS va,
  first_value(CASE WHEN good IS NOT NULL THEN i END IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib,
  first_value(good IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM n)
SELECT event_id, round(CASE WHEN n_good <= 4 THEN gappy WHEN good IS NOT NULL THEN good
  WHEN ib - ia - 1 <= 3 THEN va + (vb - va) * (i - ia) / (ib - ia) END + 1e-9, 6) AS filled FROM p
""")
def interpolate_linear(spark, sf_dir):
    return series.interpolate(gappy(spark, sf_dir), ["user_id"], ORDER, "gappy", most=3).select("event_id", rounded(F.col("filled")).alias("filled"))


@query(f"""
SELECT event_id, coalesce(last_value(gappy IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(gappy IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS filled FROM {_GAPPY}
""")
def fill_gaps_last_value(spark, sf_dir):
    return series.fill_ends(gappy(spark, sf_dir), ["user_id"], ORDER, "gappy").select("event_id", "filled")


@query(f"SELECT event_id, coalesce(gappy, 0.0) AS filled FROM {_GAPPY}")
def fill_gaps_zeros(spark, sf_dir):
    return series.fill_ends(gappy(spark, sf_dir), ["user_id"], ORDER, "gappy", using="zeros").select("event_id", "filled")


@query(f"""
WITH n AS (SELECT user_id, row_number() OVER ({_SERIES}) AS i, gappy FROM {_GAPPY}),
k AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM n WHERE gappy IS NULL),
r AS (SELECT user_id, min(i) AS a, max(i) AS b FROM k GROUP BY user_id, island)
SELECT user_id, coalesce(string_agg(CASE WHEN b - a + 1 <= 1 THEN a || ':' || b END, ', ' ORDER BY a), '') AS interpolated,
  coalesce(string_agg(CASE WHEN b - a + 1 > 1 THEN a || ':' || b END, ', ' ORDER BY a), '') AS left_missing FROM r GROUP BY user_id
""")
def missing_ranges(spark, sf_dir):
    from pyspark.sql import Window

    rows = gappy(spark, sf_dir).withColumn("frame", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)))
    return series.missing_ranges(rows, ["user_id"], "frame", F.col("gappy").isNull(), longest=1)


@query(f"""
WITH d AS (SELECT event_id, user_id, value - lag(value) OVER ({_SERIES}) AS d, row_number() OVER ({_SERIES}) AS i FROM events)
SELECT event_id, round(coalesce(d, 2.0 * max(CASE WHEN i = 2 THEN d END) OVER (PARTITION BY user_id)) + 1e-9, 6) AS speed FROM d
""")
def vertical_speed(spark, sf_dir):
    return series.speed(events(spark, sf_dir), ["user_id"], ORDER, "value").select("event_id", rounded(F.col("speed")).alias("speed"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(coalesce(avg(CASE WHEN i >= floor(n * 0.25) AND i < floor(n * 0.75) THEN value END), avg(value)) + 1e-9, 6) AS trimmed_mean FROM r GROUP BY user_id
""")
def trimmed_mean(spark, sf_dir):
    return series.trimmed_mean(events(spark, sf_dir), ["user_id"], "value", 0.5).select("user_id", rounded(F.col("trimmed_mean")).alias("trimmed_mean"))


@query(f"""
SELECT event_id, round(0.0 + coalesce(lag(value) OVER ({_SERIES}), value) * 0.25 + value * 0.5 + coalesce(lead(value) OVER ({_SERIES}), value) * 0.25 + 1e-9, 6) AS smoothed FROM events
""")
def smooth_kernel(spark, sf_dir):
    return series.weighted_window(events(spark, sf_dir), ["user_id"], ORDER, "value", [0.25, 0.5, 0.25]).select("event_id", rounded(F.col("smoothed")).alias("smoothed"))


@query(f"""
SELECT event_id, list_sort([coalesce(lag(value) OVER ({_SERIES}), 0.0), value, coalesce(lead(value) OVER ({_SERIES}), 0.0)])[2] AS filtered FROM events
""")
def median_filter(spark, sf_dir):
    return series.running_median(events(spark, sf_dir), ["user_id"], ORDER, "value", 3).select("event_id", "filtered")


@query("""
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT user_id, i // 3 AS event_id FROM n WHERE i % 3 = 0
""")
def desample(spark, sf_dir):
    return series.desample(events(spark, sf_dir).select("user_id", "event_id"), ["user_id"], "event_id", 3)


@query("SELECT event_id, CASE WHEN value >= 30 THEN value END AS kept, CASE WHEN value > 30 THEN value END AS kept_strict FROM events")
def likelihood_filter(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", series.likely("value", 30, "value").alias("kept"), series.likely("value", 30, "value", strict=True).alias("kept_strict"))


@query("SELECT event_id FROM events WHERE event_id BETWEEN 100 AND 499")
def frame_range(spark, sf_dir):
    return series.in_range(events(spark, sf_dir), "event_id", 100, 499).select("event_id")


@query("WITH e AS (SELECT min(m) AS last FROM (SELECT max(vec_id) AS m FROM embeddings GROUP BY label)) SELECT vec_id FROM embeddings, e WHERE vec_id <= last")
def common_range(spark, sf_dir):
    return series.common_range(table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["label"], "vec_id").select("vec_id")


_HOURLY = "(SELECT epoch_us(ts) // 3600000000 AS hour, sum(CASE WHEN event_type = 'click' THEN value END) AS x, sum(CASE WHEN event_type = 'view' THEN value END) AS y FROM events GROUP BY 1)"


def hourly(spark, sf_dir):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000)
    pick = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value")))
    return events(spark, sf_dir).groupBy(hour.alias("hour")).agg(pick("click").alias("x"), pick("view").alias("y")).withColumn("trial", F.lit(1))


_LAGGED = f"""
WITH h AS {_HOURLY}, l AS (SELECT unnest(range(-5, 5)) AS lag),
j AS (SELECT l.lag, a.x, b.y FROM h a CROSS JOIN l JOIN h b ON b.hour = a.hour - l.lag WHERE a.x IS NOT NULL AND b.y IS NOT NULL)
"""


@query(_LAGGED + "SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, round(corr(x, y), 6) AS r FROM j GROUP BY lag")
def lagged_correlation(spark, sf_dir):
    found = series.lagged_correlation(hourly(spark, sf_dir), ["trial"], "hour", "x", "y", 5)
    return found.select("lag", "n", F.round("r", 6).alias("r"))


@query(_LAGGED + ", c AS (SELECT lag, corr(x, y) AS r FROM j GROUP BY lag) SELECT CAST(lag AS INTEGER) AS lag, round(r, 6) AS r FROM c ORDER BY c.r DESC, lag LIMIT 1")
def best_lag(spark, sf_dir):
    found = series.lagged_correlation(hourly(spark, sf_dir), ["trial"], "hour", "x", "y", 5)
    return series.best_lag(found, ["trial"]).select("lag", F.round("r", 6).alias("r"))


@query("""
WITH a AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'view')
SELECT a.user_id, a.position, a.x, b.y FROM a JOIN b ON a.user_id = b.user_id AND a.position = b.position
""")
def combine_by_position(spark, sf_dir):
    e = events(spark, sf_dir)
    a, b = e.filter("event_type = 'click'"), e.filter("event_type = 'view'")
    left = a.select("user_id", "ts", "event_id", F.col("value").alias("x"))
    right = b.select("user_id", F.col("ts").alias("ts2"), F.col("event_id").alias("id2"), F.col("value").alias("y"))
    return series.combine_by_position(left, right, ORDER, ["ts2", "id2"], ["user_id"]).select("user_id", "position", "x", "y")


@query("SELECT user_id, event_type, round(avg(value) + 1e-9, 6) AS mean_error, count(value) AS n FROM events GROUP BY ROLLUP (user_id, event_type)")
def error_recap(spark, sf_dir):
    return triangulate.error_recap(events(spark, sf_dir), ["user_id", "event_type"], "value").select("user_id", "event_type", rounded(F.col("mean_error")).alias("mean_error"), "n")


@query(f"""
WITH a AS (SELECT event_id, user_id, ts, value * 8 AS v FROM events),
j AS (SELECT *, coalesce(v - lag(v) OVER ({_SERIES}), 0.0) AS jump FROM a),
m AS (SELECT *, (jump + 180) - 360 * floor((jump + 180) / 360) - 180 AS raw FROM j),
s AS (SELECT *, CASE WHEN abs(jump) < 180 THEN 0.0 ELSE (CASE WHEN raw = -180 AND jump > 0 THEN 180.0 ELSE raw END) - jump END AS step FROM m)
SELECT event_id, round(v + sum(step) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-9, 4) AS unwrapped FROM s
""")
def unwrap_angles(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("v", F.col("value") * 8)
    return series.unwrap(rows, ["user_id"], ORDER, "v").select("event_id", rounded(F.col("unwrapped"), 4).alias("unwrapped"))


@query(f"""
WITH t AS (SELECT event_id, user_id, ts, value, epoch_us(ts) / 3600000000.0 AS h FROM events),
d AS (SELECT event_id, h - lag(h) OVER w AS h0, lead(h) OVER w - h AS h1, value - lag(value) OVER w AS d0, lead(value) OVER w - value AS d1 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY h))
SELECT event_id, round(coalesce((h0 * h0 * d1 + h1 * h1 * d0) / (h0 * h1 * (h0 + h1)), d1 / h1, d0 / h0), 4) AS rate FROM d
""".replace("{_SERIES}", _SERIES))
def gradient(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("h", F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0)
    return series.gradient(rows, ["user_id"], "h", "value").select("event_id", F.round("rate", 4).alias("rate"))


@query(f"""
WITH n AS (SELECT user_id, event_id, row_number() OVER ({_SERIES}) - 1 AS i, value < 50 AS ok FROM events),
k AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM n WHERE ok),
r AS (SELECT user_id, min(i) AS a, max(i) AS b FROM k GROUP BY user_id, island)
SELECT r.user_id, x.event_id AS "on", y.event_id AS "off" FROM r JOIN n x ON x.user_id = r.user_id AND x.i = r.a JOIN n y ON y.user_id = r.user_id AND y.i = r.b
""".replace(_SERIES, "PARTITION BY user_id ORDER BY event_id"))
def gait_contact_runs(spark, sf_dir):
    return gait.contact_runs(events(spark, sf_dir), ["user_id"], "event_id", F.col("value") < 50)


@query("""
WITH r AS (SELECT user_id, event_id, value, event_id % 90 AS flexion, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT *, i >= floor(n * 0.2) AND i < floor(n * 0.9) AS inside FROM r),
d AS (SELECT *, inside AND flexion < 3 AS good FROM c),
f AS (SELECT *, max(CAST(good AS INTEGER)) OVER (PARTITION BY user_id) AS anyone, row_number() OVER (PARTITION BY user_id, inside ORDER BY flexion, event_id) AS k FROM d)
SELECT user_id, event_id FROM f WHERE good OR (anyone = 0 AND inside AND k <= 5)
""")
def reasonable_frames(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", F.col("value").alias("speed"), (F.col("event_id") % 90).cast("double").alias("flexion"))
    return measure.reasonable_frames(rows, ["user_id"], "event_id", "speed", "flexion", large=3.0, at_least=5).select("user_id", "event_id")


@query("""
SELECT user_id, CAST(event_id // 10 AS BIGINT) AS block, CASE WHEN count(*) = count(gappy) THEN round(avg(gappy) + 1e-9, 6) END AS mean
FROM (SELECT user_id, event_id, CASE WHEN value <= 60 THEN value END AS gappy FROM events) GROUP BY 1, 2
""")
def frame_validity(spark, sf_dir):
    rows = gappy(spark, sf_dir).withColumn("block", F.floor(F.col("event_id") / 10))
    return measure.frame_validity(rows, ["user_id"], "block", "gappy", complete=True).select("user_id", "block", rounded(F.col("mean")).alias("mean"))


# Points: components of the embeddings.


def points(spark: SparkSession, sf_dir: str, n: int = 9) -> DataFrame:
    """vec_id, label and the first components as c0, c1, ..."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.get("embedding", F.lit(i)).cast("double").alias(f"c{i}") for i in range(n)))


def _points_sql(n: int) -> str:
    return "(SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS c{i}" for i in range(n)) + " FROM embeddings)"


def at(*names: int) -> list[Column]:
    return [F.col(f"c{i}") for i in names]


def ring(n: int, radius: float = 4.0, height: float = 1.5, focal: float = 1700.0) -> list[tuple[int, np.ndarray]]:
    """Cameras (numbered from 1) on a circle, looking at the origin."""
    out = []
    k = np.array([[focal, 0, 540], [0, focal, 960], [0, 0, 1]])
    for i in range(n):
        a = 2 * np.pi * i / n
        centre = np.array([radius * np.cos(a), radius * np.sin(a), height])
        forward = -centre / np.linalg.norm(centre)
        right = np.cross(forward, [0, 0, 1.0])
        right /= np.linalg.norm(right)
        r = np.stack([right, np.cross(forward, right), forward])
        out.append((i + 1, projection(k, r, -r @ centre)))
    return out


_P = [[1700.0, 0.0, 540.0, 10.0], [0.0, 1700.0, 960.0, 20.0], [0.0, 0.0, 1.0, 4.0]]


@query(f"""
SELECT vec_id, round((c0 * 1700.0 + c1 * 0.0 + c2 * 540.0 + 10.0) / (c0 * 0.0 + c1 * 0.0 + c2 * 1.0 + 4.0) + 1e-9, 6) AS u,
  round((c0 * 0.0 + c1 * 1700.0 + c2 * 960.0 + 20.0) / (c0 * 0.0 + c1 * 0.0 + c2 * 1.0 + 4.0) + 1e-9, 6) AS v FROM {_points_sql(3)}
""")
def reproject(spark, sf_dir):
    u, v = g.reproject(_P, at(0, 1, 2))
    return points(spark, sf_dir, 3).select("vec_id", rounded(u).alias("u"), rounded(v).alias("v"))


@query(f"""
WITH n AS (SELECT vec_id, c0 / (c2 + 4.0) AS x, c1 / (c2 + 4.0) AS y FROM {_points_sql(3)}), r AS (SELECT *, x * x + y * y AS r2 FROM n), f AS (SELECT *, 1.0 + r2 * -0.05 + r2 * r2 * 0.14 AS k FROM r)
SELECT vec_id, round((x * k + x * y * 0.002 + (r2 + x * x * 2) * 0.0007) * 1700.0 + 540.0 + 1e-9, 5) AS u, round((y * k + (r2 + y * y * 2) * 0.001 + x * y * 0.0014) * 1700.0 + 960.0 + 1e-9, 5) AS v FROM f
""")
def reproject_distorted(spark, sf_dir):
    k = [[1700.0, 0.0, 540.0], [0.0, 1700.0, 960.0], [0.0, 0.0, 1.0]]
    u, v = g.reproject_distorted(k, [-0.05, 0.14, 0.001, 0.0007], [F.col("c0"), F.col("c1"), F.col("c2") + 4.0])
    return points(spark, sf_dir, 3).select("vec_id", rounded(u, 5).alias("u"), rounded(v, 5).alias("v"))


_ANGLES = f"""
WITH d AS (SELECT vec_id, c0 - c3 AS ux, c1 - c4 AS uy, c2 - c5 AS uz, c6 - c3 AS vx, c7 - c4 AS vy, c8 - c5 AS vz, c0 - c3 AS sx, c1 - c4 AS sy FROM {_points_sql(9)}),
a AS (SELECT vec_id, degrees(atan2(sqrt((uy*vz-uz*vy)*(uy*vz-uz*vy) + (uz*vx-ux*vz)*(uz*vx-ux*vz) + (ux*vy-uy*vx)*(ux*vy-uy*vx)), ux*vx + uy*vy + uz*vz)) AS three,
  degrees(-atan2(ux*vy - uy*vx, ux*vx + uy*vy)) AS flat, degrees(atan2(sy, sx)) AS slope FROM d)
"""


@query(_ANGLES + "SELECT vec_id, round(three + 1e-9, 5) AS three, round(flat + 1e-9, 5) AS flat, round(slope + 1e-9, 5) AS slope FROM a")
def angles(spark, sf_dir):
    three = g.angle_3d([at(0, 1, 2), at(3, 4, 5), at(6, 7, 8)])
    flat, slope = g.angle_2d([at(0, 1), at(3, 4), at(6, 7)]), g.angle_2d([at(0, 1), at(3, 4)])
    return points(spark, sf_dir).select("vec_id", rounded(three, 5).alias("three"), rounded(flat, 5).alias("flat"), rounded(slope, 5).alias("slope"))


@query(_ANGLES + "SELECT vec_id, round(((three - 180) * 1 + 180) - 360 * floor(((three - 180) * 1 + 180) / 360) - 180 + 1e-9, 5) AS knee, round(((slope + 0) * -1 + 90) - 180 * floor(((slope + 0) * -1 + 90) / 180) - 90 + 1e-9, 5) AS pelvis FROM a")
def joint_angle(spark, sf_dir):
    knee = g.wrapped(g.angle_3d([at(0, 1, 2), at(3, 4, 5), at(6, 7, 8)]), -180, 1)
    pelvis = g.wrapped(g.angle_2d([at(0, 1), at(3, 4)]), 0, -1, half_turn=True)
    return points(spark, sf_dir).select("vec_id", rounded(knee, 5).alias("knee"), rounded(pelvis, 5).alias("pelvis"))


@query(f"SELECT vec_id, c0 AS x, -c2 AS y, c1 AS z, -c1 AS zx, c0 AS zy FROM {_points_sql(3)}")
def rotate90(spark, sf_dir):
    x, z = g.rotate90(*at(0, 1, 2), "x"), g.rotate90(*at(0, 1, 2), "z")
    return points(spark, sf_dir, 3).select("vec_id", *(c.alias(n) for c, n in zip([*x, *z[:2]], ("x", "y", "z", "zx", "zy"), strict=True)))


@query(f"SELECT vec_id, c1 AS x, c2 AS y, c0 AS z, c2 AS back_x, c0 AS back_y, c1 AS back_z FROM {_points_sql(3)}")
def zup_yup(spark, sf_dir):
    up, back = g.z_up_to_y_up(*at(0, 1, 2)), g.y_up_to_z_up(*at(0, 1, 2))
    return points(spark, sf_dir, 3).select("vec_id", *(c.alias(n) for c, n in zip([*up, *back], ("x", "y", "z", "back_x", "back_y", "back_z"), strict=True)))


@query(f"SELECT vec_id, c0 * 1000.0 AS x, c1 * 1000.0 AS y, c2 * 1000.0 AS z FROM {_points_sql(3)}")
def scale(spark, sf_dir):
    return points(spark, sf_dir, 3).select("vec_id", *(c.alias(n) for c, n in zip(g.scaled(at(0, 1, 2), 1000.0), "xyz", strict=True)))


@query("""
WITH b AS (SELECT vec_id, list_transform(embedding[1:16], lambda v: CAST(v AS DOUBLE)) AS xs, list_transform(embedding[17:32], lambda v: CAST(v AS DOUBLE)) AS ys FROM embeddings)
SELECT vec_id, greatest(list_min(xs), 0.0) - 2.0 AS xmin, greatest(list_min(ys), 0.0) - 2.0 AS ymin, least(list_max(xs), 0.25) + 2.0 AS xmax, least(list_max(ys), 0.25) + 2.0 AS ymax FROM b
""")
def bbox(spark, sf_dir):
    doubles = lambda a, n: F.transform(F.slice("embedding", a, n), lambda v: v.cast("double"))
    box = g.box_xyxy(doubles(1, 16), doubles(17, 16), 2.0, 0.25, 0.25)
    return table(spark, sf_dir, "embeddings").select("vec_id", *(c.alias(n) for c, n in zip(box, ("xmin", "ymin", "xmax", "ymax"), strict=True)))


@query(f"SELECT vec_id, round(CASE WHEN c0 > 0.2 AND c1 > 0.2 THEN 'Infinity'::DOUBLE ELSE sqrt(coalesce(CASE WHEN c0 <= 0.2 THEN (c0 - c2) * (c0 - c2) END, 0) + coalesce(CASE WHEN c1 <= 0.2 THEN (c1 - c3) * (c1 - c3) END, 0)) END, 9) AS d FROM {_points_sql(4)}")
def nan_distance(spark, sf_dir):
    a = [F.when(c <= 0.2, c) for c in at(0, 1)]
    return points(spark, sf_dir, 4).select("vec_id", F.round(g.distance(a, at(2, 3)), 9).alias("d"))


def _markers(spark, sf_dir, per_frame: int = 10) -> DataFrame:
    rows = points(spark, sf_dir, 3)
    return rows.select(F.floor(F.col("vec_id") / per_frame).alias("frame"), (F.col("vec_id") % per_frame).cast("int").alias("marker"), F.col("c0").alias("x"), F.col("c1").alias("y"), F.col("c2").alias("z")).withColumn("trial", F.lit(1))


@query(f"""
WITH m AS (SELECT vec_id // 10 AS frame, vec_id % 10 AS marker, c0, c1, c2 FROM {_points_sql(3)}),
d AS (SELECT frame, sqrt(pow(c0 - lag(c0) OVER w, 2) + pow(c1 - lag(c1) OVER w, 2) + pow(c2 - lag(c2) OVER w, 2)) AS move FROM m WINDOW w AS (PARTITION BY marker ORDER BY frame))
SELECT frame, round(coalesce(sum(move), 0.0) + 1e-9, 6) AS speed FROM d GROUP BY frame
""")
def total_speed(spark, sf_dir):
    return series.total_speed(_markers(spark, sf_dir), ["trial"], "frame", "marker", ["x", "y", "z"]).select("frame", rounded(F.col("speed")).alias("speed"))


@query(f"""
WITH o AS (SELECT vec_id, c0, c1, c2 FROM {_points_sql(3)})
SELECT vec_id, round(c0, 6) AS x, round(c1, 6) AS y, round(c2, 6) AS z, CAST(CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_excluded FROM o
""")
def robust_triangulation(spark, sf_dir):
    found = _triangulated(spark, sf_dir)
    return found.select("vec_id", *(F.round(c, 6).alias(c) for c in "xyz"), "n_excluded")


def _triangulated(spark, sf_dir) -> DataFrame:
    """Points seen by four cameras, one of which is far off for every third point."""
    cameras = ring(4)
    seen = triangulate.observe(points(spark, sf_dir, 3), cameras, ["vec_id"], ["c0", "c1", "c2"])
    wrong = (F.col("vec_id") % 3 == 0) & (F.col("vec_id") % 4 + 1 == F.col("cam_id"))
    return triangulate.robust_triangulation(seen.withColumn("x", F.col("x") + F.when(wrong, 500.0).otherwise(0.0)), cameras, ["vec_id"])


@query("""
WITH n AS (SELECT count(*) AS total FROM embeddings), c AS (SELECT unnest([1, 2, 3, 4]) AS cam_id)
SELECT CAST(cam_id AS INTEGER) AS cam_id, (SELECT count(*) FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 4 + 1 = cam_id) AS n_excluded,
  round((SELECT count(*) FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 4 + 1 = cam_id) / total + 1e-9, 6) AS rate FROM c, n
""")
def camera_exclusion_rate(spark, sf_dir):
    return triangulate.camera_exclusion_rate(_triangulated(spark, sf_dir), [1, 2, 3, 4]).select("cam_id", "n_excluded", rounded(F.col("rate")).alias("rate"))


def _people(spark, sf_dir) -> DataFrame:
    """40 embeddings a frame: four cameras of two people with five keypoints."""
    i = F.col("vec_id") % 40
    rows = points(spark, sf_dir, 8)
    return rows.select(F.floor(F.col("vec_id") / 40).alias("frame"), F.floor(i / 10).cast("int").alias("cam_id"), F.floor((i % 10) / 5).cast("int").alias("person_id"), (i % 5).cast("int").alias("kpt_id"), *at(0, 1, 2, 3, 4, 5), F.abs("c6").alias("score"))


_PEOPLE = f"(SELECT vec_id // 40 AS frame, CAST((vec_id % 40) // 10 AS INTEGER) AS cam_id, CAST((vec_id % 10) // 5 AS INTEGER) AS person_id, CAST(vec_id % 5 AS INTEGER) AS kpt_id, c0, c1, c2, c3, c4, c5, abs(c6) AS score FROM {_points_sql(8)})"


@query(f"""
WITH p AS {_PEOPLE},
j AS (SELECT a.frame, a.cam_id AS cam_a, a.person_id AS person_a, b.cam_id AS cam_b, b.person_id AS person_b,
  abs(a.c0*b.c3 + a.c1*b.c4 + a.c2*b.c5 + (b.c0*a.c3 + b.c1*a.c4 + b.c2*a.c5)) AS d, sqrt(a.score * b.score) AS w
  FROM p a JOIN p b ON a.frame = b.frame AND a.kpt_id = b.kpt_id AND a.cam_id < b.cam_id),
m AS (SELECT frame, cam_a, person_a, cam_b, person_b, sum(d * w) / (1e-5 + sum(w)) AS distance FROM j GROUP BY ALL)
SELECT frame, cam_a, person_a, cam_b, person_b, round(distance + 1e-9, 6) AS distance, round(1 - least(distance, 0.1) / 0.1 + 1e-9, 5) AS affinity FROM m
""")
def affinity_pairs(spark, sf_dir):
    rows = _people(spark, sf_dir)
    names = dict(zip(("c0", "c1", "c2", "c3", "c4", "c5"), ("lx", "ly", "lz", "mx", "my", "mz"), strict=True))
    found = associate.ray_pairs(rows.withColumnsRenamed(names), ["frame"], 0.1)
    return found.select("frame", "cam_a", "person_a", "cam_b", "person_b", rounded(F.col("distance")).alias("distance"), rounded(F.col("affinity"), 5).alias("affinity"))


@query(f"""
WITH p AS {_PEOPLE},
a AS (SELECT frame, cam_id, person_id, (max(c0) - min(c0)) * (max(c1) - min(c1)) AS area FROM p GROUP BY ALL),
b AS (SELECT frame, cam_id, person_id FROM a QUALIFY row_number() OVER (PARTITION BY frame, cam_id ORDER BY area DESC, person_id) = 1)
SELECT p.frame, p.cam_id, p.person_id, p.kpt_id, CASE WHEN p.score > 0.1 THEN c0 END AS x, CASE WHEN p.score > 0.1 THEN c1 END AS y, p.score FROM p JOIN b USING (frame, cam_id, person_id)
""")
def largest_person(spark, sf_dir):
    rows = _people(spark, sf_dir).select("frame", "cam_id", "person_id", "kpt_id", F.col("c0").alias("x"), F.col("c1").alias("y"), "score")
    return associate.largest_person(rows, ["frame", "cam_id"], min_score=0.1)


@query(f"SELECT max(n) AS n_persons FROM (SELECT count(DISTINCT person_id) AS n FROM {_PEOPLE} GROUP BY frame, cam_id)")
def person_count(spark, sf_dir):
    return associate.person_count(_people(spark, sf_dir), ["frame"])


@query(f"SELECT p.frame, p.cam_id, p.person_id, p.kpt_id FROM {_PEOPLE} p JOIN (SELECT frame, cam_id, person_id FROM {_PEOPLE} GROUP BY ALL HAVING coalesce(avg(CASE WHEN score > 0.05 THEN score END), 0) > 0.12) USING (frame, cam_id, person_id)")
def detection_gate(spark, sf_dir):
    return associate.detection_gate(_people(spark, sf_dir), ["frame", "cam_id", "person_id"], visible=0.05, mean=0.12).select("frame", "cam_id", "person_id", "kpt_id")


@query(f"""
WITH p AS (SELECT * FROM {_PEOPLE} WHERE score > 0.1), f AS (SELECT DISTINCT frame FROM {_PEOPLE}), c AS (SELECT unnest(range(4)) AS cam_id), s AS (SELECT unnest(range(2)) AS person_id), k AS (SELECT unnest(range(5)) AS kpt_id)
SELECT f.frame, CAST(c.cam_id AS VARCHAR) AS cam, CAST(s.person_id AS INTEGER) AS person_id, CAST(k.kpt_id AS INTEGER) AS kpt_id, p.c0 AS x
FROM f CROSS JOIN c CROSS JOIN s CROSS JOIN k LEFT JOIN p ON p.frame = f.frame AND p.cam_id = c.cam_id AND p.person_id = s.person_id AND p.kpt_id = k.kpt_id
""")
def dense_grid(spark, sf_dir):
    rows = _people(spark, sf_dir)
    seen = rows.filter("score > 0.1").select("frame", F.col("cam_id").cast("string").alias("cam"), "person_id", "kpt_id", F.col("c0").alias("x"), F.col("c1").alias("y"), "score")
    return detections.dense_grid(seen, rows.select("frame").distinct(), ["0", "1", "2", "3"], 2, [0, 1, 2, 3, 4]).select("frame", "cam", "person_id", "kpt_id", "x")


@query("""
WITH l AS (SELECT l_orderkey AS frame, l_linenumber % 3 AS cam_id, l_linenumber // 3 AS person_id FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY ALL),
f AS (SELECT DISTINCT frame FROM l),
p AS (SELECT f.frame, a.person_id AS p0, b.person_id AS p1, c.person_id AS p2 FROM f LEFT JOIN l a ON a.frame = f.frame AND a.cam_id = 0 LEFT JOIN l b ON b.frame = f.frame AND b.cam_id = 1 LEFT JOIN l c ON c.frame = f.frame AND c.cam_id = 2)
SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY p0, p1, p2) - 1 AS combination, CAST(p0 AS INTEGER) AS p0, CAST(p1 AS INTEGER) AS p1, CAST(p2 AS INTEGER) AS p2 FROM p
""".replace("WHERE l_orderkey % 10 = 0 ", ""))
def person_combinations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), (F.col("l_linenumber") % 3).alias("cam_id"), F.floor(F.col("l_linenumber") / 3).cast("int").alias("person_id"))
    return associate.person_combinations(rows, ["frame"], [0, 1, 2]).select("frame", "combination", *(F.get("persons", F.lit(i)).alias(f"p{i}") for i in range(3)))


@query("""
WITH o AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <= 5), m AS (SELECT CAST(unnest(range(32)) AS INTEGER) AS mask)
SELECT l_orderkey, mask, CAST(bit_count(mask) AS INTEGER) AS removed FROM o JOIN m ON mask < (1 << n) AND bit_count(mask) <= 2
""")
def camera_subsets(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n <= 5")
    masks = F.broadcast(triangulate.subset_table(spark, 5, 2))  # at most 2**5 rows
    return orders.join(masks, F.col("mask") < F.pow(F.lit(2), F.col("n"))).select("l_orderkey", "mask", "removed")


MARKERS = ["RHip", "RKnee", "RAnkle", "LHip", "LKnee", "LAnkle", "RShoulder", "LShoulder", "Neck", "Head", "Hip", "RHeel", "LHeel", "Nose"]


def _body(spark, sf_dir) -> DataFrame:
    """14 embeddings a frame, named after a body's markers."""
    names = F.array(*[F.lit(m) for m in MARKERS])
    rows = points(spark, sf_dir, 3)
    return rows.select(F.lit(1).alias("person"), F.floor(F.col("vec_id") / 14).alias("frame"), F.get(names, (F.col("vec_id") % 14).cast("int")).alias("marker"), F.col("c0").alias("x"), F.col("c1").alias("y"), F.col("c2").alias("z"))


_BODY = f"(SELECT vec_id // 14 AS frame, {MARKERS!r}[CAST(vec_id % 14 AS INTEGER) + 1] AS marker, c0 AS x, c1 AS y, c2 AS z FROM {_points_sql(3)})"


def _length(a: str, b: str) -> str:
    return f"(SELECT a.frame, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM {_BODY} a JOIN {_BODY} b ON a.frame = b.frame AND a.marker = '{a}' AND b.marker = '{b}')"


@query(f"SELECT frame, 'shank' AS segment, round(d + 1e-9, 6) AS length FROM {_length('RKnee', 'RAnkle')} UNION ALL SELECT frame, 'thigh', round(d + 1e-9, 6) FROM {_length('RHip', 'RKnee')}")
def segment_lengths(spark, sf_dir):
    found = measure.segment_lengths(_body(spark, sf_dir), ["frame"], {"shank": ("RKnee", "RAnkle"), "thigh": ("RHip", "RKnee")})
    return found.select("frame", "segment", rounded(F.col("length")).alias("length"))


@query(f"""
WITH h AS (SELECT rs.frame, coalesce((rf.d + lf.d) / 2, 0.10) + (rs.d + ls.d) / 2 + (rt.d + lt.d) / 2 + (rb.d + lb.d) / 2 + hd.d * 1.008 AS height
  FROM {_length('RKnee', 'RAnkle')} rs JOIN {_length('LKnee', 'LAnkle')} ls USING (frame)
  JOIN {_length('RHip', 'RKnee')} rt USING (frame) JOIN {_length('LHip', 'LKnee')} lt USING (frame) JOIN {_length('RShoulder', 'RHip')} rb USING (frame) JOIN {_length('LShoulder', 'LHip')} lb USING (frame) JOIN {_length('Head', 'Neck')} hd USING (frame)
  LEFT JOIN {_length('RAnkle', 'RHeel')} rf USING (frame) LEFT JOIN {_length('LAnkle', 'LHeel')} lf USING (frame)),
r AS (SELECT height, row_number() OVER (ORDER BY height) - 1 AS i, count(*) OVER () AS n FROM h)
SELECT CAST(1 AS INTEGER) AS person, round(avg(height) + 1e-9, 6) AS height FROM r WHERE i >= floor(n * 0.25) AND i < floor(n * 0.75)
""")
def body_height(spark, sf_dir):
    return measure.body_height(_body(spark, sf_dir), ["person"], "frame").select("person", rounded(F.col("height")).alias("height"))


@query(f"SELECT a.frame, round((a.x + b.x) / 2 + 1e-9, 6) AS x, round((a.y + b.y) / 2 + 1e-9, 6) AS y, round((a.z + b.z) / 2 + 1e-9, 6) AS z FROM {_BODY} a JOIN {_BODY} b ON a.frame = b.frame AND a.marker = 'RHip' AND b.marker = 'LHip'")
def midpoint_markers(spark, sf_dir):
    found = measure.with_midpoints(_body(spark, sf_dir), ["frame"], {"MidHip": ("RHip", "LHip")}).filter("marker = 'MidHip'")
    return found.select("frame", *(rounded(F.col(c)).alias(c) for c in "xyz"))


@query(f"""
WITH l AS (SELECT frame, 'shank' AS segment, d FROM {_length('RKnee', 'RAnkle')} UNION ALL SELECT frame, 'thigh', d FROM {_length('RHip', 'RKnee')}),
r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY segment) AS n FROM l),
t AS (SELECT segment, avg(d) AS m FROM r WHERE i >= floor(n * 0.1) AND i < floor(n * 0.9) GROUP BY segment)
SELECT 'leg' AS body, 'y' AS axis, round(avg(m / CASE segment WHEN 'shank' THEN 0.4 ELSE 0.5 END) + 1e-9, 6) AS ratio FROM t
""")
def segment_scales(spark, sf_dir):
    lengths = measure.segment_lengths(_body(spark, sf_dir), ["person", "frame"], {"shank": ("RKnee", "RAnkle"), "thigh": ("RHip", "RKnee")})
    model = spark.createDataFrame([("shank", "leg", "y", 0.4), ("thigh", "leg", "y", 0.5)], "segment string, body string, axis string, model_length double")
    return measure.segment_scales(lengths, model, ["person"]).select("body", "axis", rounded(F.col("ratio")).alias("ratio"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^R') THEN 'L' || p_name[2:] WHEN regexp_matches(p_name, '^L') THEN 'R' || p_name[2:] WHEN contains(p_name, 'right') THEN replace(p_name, 'right', 'left') WHEN contains(p_name, 'left') THEN replace(p_name, 'left', 'right') ELSE p_name END AS partner FROM part")
def mirrored_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", g.mirrored(F.col("p_name")).alias("partner"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY regexp_extract(c_name, '[0-9]+') <> '', CAST(nullif(regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1), '') AS HUGEINT), c_name) AS place FROM customer")
def natural_order(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(*g.natural_key(F.col("c_name")))).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", place.alias("place"))


# Filters: the SQL is written from the filters' definitions.

_NUMBERED = "(SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def _runs_sql(table: str) -> str:
    """Runs of values that are not zero in a table (user_id, i, v): user_id, i, v, run, k (place in the run), m (its length)."""
    return f"""(SELECT user_id, i, v, run, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id, run) AS m
      FROM (SELECT user_id, i, v, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM {table} WHERE v <> 0) WINDOW w AS (PARTITION BY user_id, run ORDER BY i))"""


def _butterworth_sql(table: str, cutoff: float, rate: float = 60.0) -> str:
    """CTEs up to ``z`` (user_id, i, v): second order forward and backward on runs of ten or more, odd extension by nine."""
    c = float(1 / np.tan(np.pi * cutoff / rate))
    g = float(1 / (1 + np.sqrt(2) * c + c * c))
    a1, a2 = 2 * g * (1 - c * c), float(g * (1 - np.sqrt(2) * c + c * c))

    def sweep(name: str, of: str) -> str:
        # Before its start the filter has seen the first value for ever.
        return f"""{name} AS (SELECT user_id, run, j, x AS x1, x AS x2, x AS y1, x AS y2 FROM {of} WHERE j = 0
          UNION ALL SELECT e.user_id, e.run, e.j, e.x, f.x1, {g!r} * (e.x + 2 * f.x1 + f.x2) - {a1!r} * f.y1 - {a2!r} * f.y2, f.y1 FROM {name} f JOIN {of} e ON e.user_id = f.user_id AND e.run = f.run AND e.j = f.j + 1)"""

    return f"""r AS {_runs_sql(table)}, s AS (SELECT * FROM r WHERE m > 9), j AS (SELECT unnest(range(1, 10)) AS p),
    e AS (SELECT user_id, run, k + 9 AS j, v AS x FROM s
      UNION ALL SELECT b.user_id, b.run, 9 - p, 2 * a.v - b.v FROM j JOIN s b ON b.k = p JOIN s a ON a.user_id = b.user_id AND a.run = b.run AND a.k = 0
      UNION ALL SELECT b.user_id, b.run, b.m + 8 + p, 2 * a.v - b.v FROM j JOIN s b ON b.k = b.m - 1 - p JOIN s a ON a.user_id = b.user_id AND a.run = b.run AND a.k = a.m - 1),
    {sweep("f", "e")},
    h AS (SELECT user_id, run, max(j) OVER (PARTITION BY user_id, run) - j AS j, y1 AS x FROM f),
    {sweep("q", "h")},
    z AS (SELECT r.user_id, r.i, coalesce(q.y1, r.v) AS v FROM r LEFT JOIN q ON q.user_id = r.user_id AND q.run = r.run AND q.j = r.m + 8 - r.k)"""


_BUTTERWORTH = f"""WITH RECURSIVE n AS {_NUMBERED}, {_butterworth_sql("n", 6.0)}
SELECT n.user_id, n.event_id, round(coalesce(z.v, n.v) + 1e-9, 6) AS value FROM n LEFT JOIN z ON z.user_id = n.user_id AND z.i = n.i"""

_ON_SPEED = f"""WITH RECURSIVE n AS {_NUMBERED},
d0 AS (SELECT user_id, i, v - lag(v) OVER (PARTITION BY user_id ORDER BY i) AS v FROM n),
d AS (SELECT user_id, i, coalesce(v, max(CASE WHEN i = 1 THEN v END) OVER (PARTITION BY user_id) / 2) AS v FROM d0), {_butterworth_sql("d", 10.0)},
t AS (SELECT n.user_id, n.event_id, first_value(n.v) OVER w + sum(coalesce(z.v, d.v)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
  FROM n JOIN d ON d.user_id = n.user_id AND d.i = n.i LEFT JOIN z ON z.user_id = n.user_id AND z.i = n.i WINDOW w AS (PARTITION BY n.user_id ORDER BY n.i))
SELECT user_id, event_id, round(v + 1e-9, 6) AS value FROM t"""

_GAUSSIAN = f"""WITH n AS {_NUMBERED}, o AS (SELECT unnest(range(-4, 5)) AS o),
j AS (SELECT user_id, event_id, exp(-0.5 * o * o) AS w, CASE WHEN i + o < 0 THEN -(i + o) - 1 WHEN i + o >= n THEN 2 * n - 1 - (i + o) ELSE i + o END AS k FROM n CROSS JOIN o)
SELECT j.user_id, j.event_id, round(sum(w * n.v) / sum(w) + 1e-9, 6) AS value FROM j JOIN n ON n.user_id = j.user_id AND n.i = j.k GROUP BY ALL"""

_LOESS = f"""WITH n AS {_NUMBERED}, l AS (SELECT *, greatest(0, least(i - 2, n - 5)) AS l FROM n),
p AS (SELECT l.user_id, l.event_id, l.i, b.i AS t, b.v, abs(b.i - l.i) / greatest(l.i - l, l + 4 - l.i)::DOUBLE AS u FROM l JOIN n b ON b.user_id = l.user_id AND b.i BETWEEN l.l AND l.l + 4),
w AS (SELECT *, CASE WHEN u >= 0.999 THEN 0.0 WHEN u <= 0.001 THEN 1.0 ELSE pow(1 - u * u * u, 3) END AS w FROM p),
m AS (SELECT *, sum(w * t) OVER g / sum(w) OVER g AS mean, w / sum(w) OVER g AS share FROM w WINDOW g AS (PARTITION BY event_id)),
s AS (SELECT user_id, event_id, i, any_value(mean) AS mean, sum(share * v) AS level, sum(share * (t - mean) * v) / sum(share * (t - mean) * (t - mean)) AS slope FROM m GROUP BY user_id, event_id, i)
SELECT s.user_id, s.event_id, round(CASE WHEN n.n > 5 THEN level + slope * (s.i - mean) ELSE n.v END + 1e-9, 6) AS value FROM s JOIN n ON n.event_id = s.event_id"""

_MEDIAN5 = f"""SELECT user_id, event_id, round(list_sort([coalesce(lag(v, 2) OVER w, 0.0), coalesce(lag(v) OVER w, 0.0), v, coalesce(lead(v) OVER w, 0.0), coalesce(lead(v, 2) OVER w, 0.0)])[3] + 1e-9, 6) AS value
FROM {_NUMBERED} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""

_HAMPEL = f"""WITH w AS (SELECT user_id, event_id, v, list(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS win FROM {_NUMBERED}),
m AS (SELECT *, list_sort(win)[4] AS med FROM w), s AS (SELECT *, list_sort(list_transform(win, lambda x: abs(x - med)))[4] AS mad FROM m)
SELECT user_id, event_id, round(CASE WHEN len(win) = 7 AND mad > 0 AND abs((0.6745 * (v - med)) / mad) > 2 THEN med ELSE v END + 1e-9, 6) AS value FROM s"""

_EURO_STEP = """SELECT user_id, i, r / (r + 1) * v + (1 - r / (r + 1)) * o, s FROM (SELECT *, 2 * pi() * (4.0 + 1.5 * abs(s)) / 60 AS r FROM (
  SELECT n.user_id, n.i, n.v, f.o, a * (n.v - f.o) * 60 + (1 - a) * f.s AS s FROM {name} f JOIN {of} n ON n.user_id = f.user_id AND n.i = f.i + 1, (SELECT (2 * pi() / 60) / (2 * pi() / 60 + 1) AS a)))"""

_ONE_EURO = f"""WITH RECURSIVE n AS {_NUMBERED},
f AS (SELECT user_id, i, v AS o, 0.0::DOUBLE AS s FROM n WHERE i = 0 UNION ALL {_EURO_STEP.format(name="f", of="n")}),
m AS (SELECT n.user_id, n.n - 1 - n.i AS i, f.o AS v FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i),
b AS (SELECT user_id, i, v AS o, 0.0::DOUBLE AS s FROM m WHERE i = 0 UNION ALL {_EURO_STEP.format(name="b", of="m")})
SELECT n.user_id, n.event_id, round(b.o + 1e-9, 6) AS value FROM n JOIN b ON b.user_id = n.user_id AND b.i = n.n - 1 - n.i"""


def _kalman_sql(rate: float = 60.0, trust: float = 500.0, measurement: float = 20.0) -> str:
    """Constant acceleration, process noise (measurement * trust) squared; the covariances depend on the place in a run alone."""
    dt = 1 / rate
    h, q, r = dt * dt / 2, (measurement * trust) ** 2, measurement**2
    # f_ij: F P; a..f: P predicted; then the update.
    rows = f"a + {dt!r} * b + {h!r} * c AS f00, b + {dt!r} * d + {h!r} * e AS f01, c + {dt!r} * e + {h!r} * f AS f02, b + {dt!r} * c AS f10, d + {dt!r} * e AS f11, e + {dt!r} * f AS f12, c AS f20, e AS f21, f AS f22"
    ahead = f"f00 + {dt!r} * f01 + {h!r} * f02 + {h * h * q!r} AS pa, f01 + {dt!r} * f02 + {h * dt * q!r} AS pb, f02 + {h * q!r} AS pc, f11 + {dt!r} * f12 + {dt * dt * q!r} AS pd, f12 + {dt * q!r} AS pe, f22 + {q!r} AS pf"
    step = f"SELECT k, pa - pa * pa / (pa + {r!r}) AS a, pb - pa * pb / (pa + {r!r}) AS b, pc - pa * pc / (pa + {r!r}) AS c, pd - pb * pb / (pa + {r!r}) AS d, pe - pb * pc / (pa + {r!r}) AS e, pf - pc * pc / (pa + {r!r}) AS f, pa / (pa + {r!r}) AS g0, pb / (pa + {r!r}) AS g1, pc / (pa + {r!r}) AS g2"
    p0 = f"{measurement!r}::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, {measurement!r}::DOUBLE AS d, 0.0::DOUBLE AS e, {measurement!r}::DOUBLE AS f"
    inverse = "pd * pf - pe * pe AS i00, pc * pe - pb * pf AS i01, pb * pe - pc * pd AS i02, pa * pf - pc * pc AS i11, pb * pc - pa * pe AS i12, pa * pd - pb * pb AS i22, pa * (pd * pf - pe * pe) - pb * (pb * pf - pc * pe) + pc * (pb * pe - pc * pd) AS det"
    gain = ", ".join(f"(f0{i} * i0{j} + f1{i} * {'i11' if j == 1 else 'i01' if j == 0 else 'i12'} + f2{i} * i{j}2) / det AS c{i}{j}" if j != 2 else f"(f0{i} * i02 + f1{i} * i12 + f2{i} * i22) / det AS c{i}{j}" for i in range(3) for j in range(3))
    gain = gain.replace("f2{i} * i{j}2", "")
    moved = f"s0 + {dt!r} * s1 + {h!r} * s2"
    return f"""WITH RECURSIVE n AS {_NUMBERED}, r AS {_runs_sql("n")}, u AS (SELECT * FROM r WHERE m > 2),
    p AS ({step} FROM (SELECT 0 AS k, {ahead} FROM (SELECT {rows} FROM (SELECT {p0})))
      UNION ALL {step} FROM (SELECT k + 1 AS k, {ahead} FROM (SELECT k, {rows} FROM p WHERE k < (SELECT max(m) FROM u)))),
    c AS (SELECT k, {gain} FROM (SELECT *, {inverse} FROM (SELECT *, {ahead} FROM (SELECT k, {rows} FROM p)))),
    v0 AS (SELECT user_id, run, max(CASE WHEN k = 0 THEN v END) AS a, max(CASE WHEN k = 1 THEN v END) AS b, max(CASE WHEN k = 2 THEN v END) AS c FROM u GROUP BY ALL),
    s AS (SELECT user_id, run, -1::BIGINT AS k, a AS s0, (b - a) / {dt!r} AS s1, (c - 2 * b + a) / {dt * dt!r} AS s2 FROM v0
      UNION ALL SELECT user_id, run, k, t0 + g0 * (v - t0), t1 + g1 * (v - t0), t2 + g2 * (v - t0) FROM (
        SELECT u.user_id, u.run, u.k, u.v, g0, g1, g2, {moved} AS t0, s1 + {dt!r} * s2 AS t1, s2 AS t2 FROM s JOIN u ON u.user_id = s.user_id AND u.run = s.run AND u.k = s.k + 1 JOIN p ON p.k = u.k)),
    b AS (SELECT s.user_id, s.run, s.k, s0, s1, s2 FROM s JOIN (SELECT DISTINCT user_id, run, m FROM u) l ON l.user_id = s.user_id AND l.run = s.run AND s.k = l.m - 1
      UNION ALL SELECT user_id, run, k, s0 + c00 * d0 + c01 * d1 + c02 * d2, s1 + c10 * d0 + c11 * d1 + c12 * d2, s2 + c20 * d0 + c21 * d1 + c22 * d2 FROM (
        SELECT s.user_id, s.run, s.k, s.s0, s.s1, s.s2, c.*, b.s0 - (s.s0 + {dt!r} * s.s1 + {h!r} * s.s2) AS d0, b.s1 - (s.s1 + {dt!r} * s.s2) AS d1, b.s2 - s.s2 AS d2
        FROM b JOIN s ON s.user_id = b.user_id AND s.run = b.run AND s.k = b.k - 1 AND s.k >= 0 JOIN (SELECT k AS ck, * EXCLUDE (k) FROM c) c ON c.ck = s.k))
    SELECT n.user_id, n.event_id, round(coalesce(b.s0, n.v) + 1e-9, 4) AS value FROM n LEFT JOIN r ON r.user_id = n.user_id AND r.i = n.i LEFT JOIN b ON b.user_id = r.user_id AND b.run = r.run AND b.k = r.k"""


def _filtered(name: str, options: dict, sql: str | None = None, digits: int = 6) -> None:
    def run(spark, sf_dir):
        found = filters.smooth(events(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], ["value"], name, 60.0, **options)
        return found.withColumn("value", rounded(F.col("value"), digits))

    run.__name__ = f"filter_{name}"
    query(sql)(run)


_filtered("butterworth", {"cutoff": 6.0}, _BUTTERWORTH)
_filtered("butterworth_on_speed", {"cutoff": 10.0}, _ON_SPEED)
_filtered("gaussian", {"sigma": 1.0}, _GAUSSIAN)
_filtered("loess", {"size": 5}, _LOESS)
_filtered("median", {"size": 5}, _MEDIAN5)
_filtered("kalman", {}, _kalman_sql(), 4)
_filtered("one_euro", {}, _ONE_EURO)
_filtered("gcv_spline", {})
_filtered("hampel", {"skip_missing": True}, _HAMPEL)
_filtered("interpolate", {"most": 20, "kind": "cubic"})


# Matchings: the truth is planted in the input, and the SQL states it.


def _planted(spark, sf_dir) -> DataFrame:
    """Eight embeddings a frame: four cameras of two people, whose numbers change places by camera and frame."""
    i = F.col("vec_id") % 8
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("frame"), F.floor(i / 2).cast("int").alias("cam_id"), (i % 2).cast("int").alias("person_id"))
    return rows.withColumn("truth", ((F.col("person_id") + F.col("cam_id") * F.col("frame")) % 2).cast("int"))


_PLANTED = "(SELECT *, CAST((person_id + cam_id * frame) % 2 AS INTEGER) AS truth FROM (SELECT vec_id // 8 AS frame, CAST((vec_id % 8) // 2 AS INTEGER) AS cam_id, CAST(vec_id % 2 AS INTEGER) AS person_id FROM embeddings))"


@query(f"SELECT frame, cam_id, person_id, truth AS of_camera_0 FROM {_PLANTED}")
def associate_people(spark, sf_dir):
    """Affinities of the planted people; in every third frame the first and last camera know nothing of each other."""
    rows = _planted(spark, sf_dir)
    a = rows.select("frame", F.col("cam_id").alias("cam_a"), F.col("person_id").alias("person_a"), F.col("truth").alias("ta"))
    b = rows.select("frame", F.col("cam_id").alias("cam_b"), F.col("person_id").alias("person_b"), F.col("truth").alias("tb"))
    gap = (F.col("frame") % 3 == 0) & (F.col("cam_a") == 0) & (F.col("cam_b") == 3)
    pairs = a.join(b, "frame").filter("cam_a < cam_b").withColumn("affinity", F.when(gap, 0.0).when(F.col("ta") == F.col("tb"), 0.9).otherwise(0.05))
    found = associate.associate_people(pairs, rows, ["frame"], [0, 1, 2, 3])
    first = F.max(F.when(F.col("cam_id") == 0, F.col("person_id"))).over(Window.partitionBy("frame", "proposal"))
    found = found.withColumn("first", first).drop("proposal")
    # A proposal takes two cameras; whom the first camera alone sees (the last frame may end there) stays its person.
    alone = F.when(F.col("cam_id") == 0, F.col("person_id"))
    return rows.join(found, ["frame", "cam_id", "person_id"], "left").select("frame", "cam_id", "person_id", F.coalesce("first", alone).alias("of_camera_0"))


@query("""
WITH f AS (SELECT DISTINCT vec_id // 2 AS frame FROM embeddings)
SELECT frame, 0.0::DOUBLE AS error, CAST(0 AS INTEGER) AS p1, CAST((2 * frame - frame) % 2 AS INTEGER) AS p2, CAST((3 * frame - frame) % 2 AS INTEGER) AS p3, CAST((4 * frame - frame) % 2 AS INTEGER) AS p4 FROM f
""")
def associate_one(spark, sf_dir):
    """Two people well apart in all directions, whose numbers change places by camera and frame."""
    cameras = ring(4)
    rows = points(spark, sf_dir, 3).withColumns({c: F.col(c) + by * (F.col("vec_id") % 2) for c, by in (("c0", 1.0), ("c1", 0.9), ("c2", 0.8))})
    seen = triangulate.observe(rows, cameras, ["vec_id"], ["c0", "c1", "c2"]).withColumn("frame", F.floor(F.col("vec_id") / 2))
    person = ((F.col("vec_id") + F.col("cam_id") * F.col("frame")) % 2).cast("int")
    found = associate.associate_one(seen.select("frame", "cam_id", person.alias("person_id"), "x", "y", "score"), cameras, ["frame"])
    return found.select("frame", F.round("error", 3).alias("error"), *(F.get("persons", F.lit(i)).alias(f"p{i + 1}") for i in range(4)))


@query("SELECT vec_id // 10 AS frame, CAST((vec_id % 10) // 5 AS INTEGER) AS person_id, CAST(vec_id % 5 AS INTEGER) AS kpt_id, CAST(((vec_id % 10) // 5 + vec_id // 10) % 2 AS INTEGER) AS track_id FROM embeddings")
def reidentify(spark, sf_dir):
    """Two people five metres apart who change numbers in every frame."""
    person = F.floor((F.col("vec_id") % 10) / 5).cast("int")
    frame = F.floor(F.col("vec_id") / 10)
    rows = points(spark, sf_dir, 3).select(F.lit(1).alias("trial"), frame.alias("frame"), person.alias("person_id"), (F.col("vec_id") % 5).cast("int").alias("kpt_id"), (F.col("c0") + 5.0 * ((person + frame) % 2)).alias("x"), F.col("c1").alias("y"), F.col("c2").alias("z"))
    return tracking.reidentify(rows, ["trial"]).select("frame", "person_id", "kpt_id", "track_id")


@query("""
WITH RECURSIVE b AS (SELECT vec_id, vec_id // 20 AS frame, list_min(xs) AS x0, list_min(ys) AS y0, list_max(xs) AS x1, list_max(ys) AS y1, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY (vec_id * 7) % 20 DESC) AS k
  FROM (SELECT vec_id, list_transform(embedding[1:16], lambda v: CAST(v AS DOUBLE)) AS xs, list_transform(embedding[17:32], lambda v: CAST(v AS DOUBLE)) AS ys FROM embeddings)),
r AS (SELECT DISTINCT frame, 0::BIGINT AS k, [] ::STRUCT(vec_id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS kept FROM b
  UNION ALL SELECT b.frame, b.k, CASE WHEN len(list_filter(kept, lambda o: greatest(0, least(o.x1, b.x1) - greatest(o.x0, b.x0)) * greatest(0, least(o.y1, b.y1) - greatest(o.y0, b.y0))
    > 0.45 * ((o.x1 - o.x0) * (o.y1 - o.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(o.x1, b.x1) - greatest(o.x0, b.x0)) * greatest(0, least(o.y1, b.y1) - greatest(o.y0, b.y0))))) = 0
    THEN list_append(kept, {'vec_id': b.vec_id, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}) ELSE kept END FROM r JOIN b ON b.frame = r.frame AND b.k = r.k + 1)
SELECT unnest(list_transform(arg_max(kept, k), lambda o: o.vec_id)) AS vec_id FROM r GROUP BY frame
""")
def non_max_suppression(spark, sf_dir):
    doubles = lambda a: F.transform(F.slice("embedding", a, 16), lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 20).alias("frame"), *(f(doubles(a)).alias(n) for f, a, n in ((F.array_min, 1, "xmin"), (F.array_min, 17, "ymin"), (F.array_max, 1, "xmax"), (F.array_max, 17, "ymax"))), ((F.col("vec_id") * 7) % 20).cast("double").alias("score"))
    return associate.non_max_suppression(rows, ["frame"]).select("vec_id")


@query()
def gait_forward_events(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in ("Hip", "RHeel", "LHeel", "RBigToe", "LBigToe")])
    rows = points(spark, sf_dir, 3).select(F.lit(1).alias("trial"), F.floor(F.col("vec_id") / 5).alias("frame"), F.get(names, (F.col("vec_id") % 5).cast("int")).alias("marker"), F.col("c0").alias("x"), F.col("c1").alias("y"))
    return gait.alternating(gait.by_forward_coordinates(rows, ["trial"], "frame"), ["trial"])


#: By how many frames each camera runs late.
_LATE = {1: 3, 2: -2, 3: 5}


def _late(spark, sf_dir) -> DataFrame:
    """Five keypoints of four cameras that see the same, some later or earlier; frames from 10."""
    late = F.coalesce(F.create_map(*[F.lit(x) for kv in _LATE.items() for x in kv])[F.col("cam_id")], F.lit(0))
    rows = points(spark, sf_dir, 3).withColumn("cam_id", F.explode(F.array(*[F.lit(c) for c in (0, *_LATE)])))
    return rows.select(F.lit(1).alias("trial"), "cam_id", (F.floor(F.col("vec_id") / 5) + 10 + late).alias("frame"), (F.col("vec_id") % 5).cast("int").alias("kpt_id"), F.col("c1").alias("y"))


@query("SELECT cam_id, \"offset\", 1.0::DOUBLE AS r FROM (VALUES (1, 3), (2, -2), (3, 5)) t(cam_id, \"offset\")")
def synchronise(spark, sf_dir):
    found = sync.offsets(sync.vertical_activity(_late(spark, sf_dir), ["trial", "cam_id"], "frame"), ["trial"], "frame", 0, 8)
    return found.select("cam_id", "offset", F.round("r", 6).alias("r"))


@query(f"SELECT CAST(c AS INTEGER) AS cam_id, vec_id // 5 + 10 AS frame, CAST(vec_id % 5 AS INTEGER) AS kpt_id, c1 AS y FROM {_points_sql(3)}, (SELECT unnest([0, 1, 2, 3]) AS c)")
def synchronised_keypoints(spark, sf_dir):
    rows = _late(spark, sf_dir)
    found = sync.offsets(sync.vertical_activity(rows, ["trial", "cam_id"], "frame"), ["trial"], "frame", 0, 8)
    return sync.shifted(rows, found, ["trial"], "frame").drop("trial")


@query()
def skeleton_models(spark, sf_dir):
    return skeletons.skeleton_table(spark)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of four cameras to 3D points with errors and excluded cameras."""
    return _triangulated(spark, sf_dir)
