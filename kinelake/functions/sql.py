"""Operators as SQL functions: ``register(spark)`` makes them usable in ``spark.sql``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.functions import kernels, linalg

DOUBLES = T.ArrayType(T.DoubleType())


@F.pandas_udf(DOUBLES)
def triangulate_dlt(p: pd.Series, x: pd.Series, y: pd.Series, score: pd.Series) -> pd.Series:
    """Point of arrays: projection matrices (12 numbers for each camera, row-major), x, y and score of each camera."""
    out = []
    for pi, xi, yi, si in zip(p, x, y, score, strict=True):
        if any(v is None for v in (pi, xi, yi, si)):
            out.append(None)
            continue
        xi, yi, si = (np.array(v, dtype=float) for v in (xi, yi, si))
        q = linalg.triangulate(np.array(pi, dtype=float).reshape(-1, 3, 4), xi, yi, np.nan_to_num(si))
        out.append(q.tolist() if np.isfinite(q).all() else None)
    return pd.Series(out)


def _series(kernel):
    """A filter over a whole series, given as an array in order of time."""

    @F.pandas_udf(DOUBLES)
    def run(values: pd.Series, rate: pd.Series) -> pd.Series:
        out = []
        for v, r in zip(values, rate, strict=True):
            y = None if v is None else kernel(np.array([np.nan if x is None else x for x in v], dtype=float), float(r))
            out.append(None if y is None else [None if not np.isfinite(x) else float(x) for x in y])
        return pd.Series(out)

    return run


FUNCTIONS = {
    "triangulate_dlt": triangulate_dlt,
    "butterworth": _series(lambda x, r: kernels.butterworth(x, r)),
    "kalman": _series(lambda x, r: kernels.kalman(x, r)),
    "one_euro": _series(lambda x, r: kernels.one_euro(x, r)),
    "gcv_spline": _series(lambda x, r: kernels.gcv_spline(x, r)),
    "gaussian_filter": _series(lambda x, r: kernels.gaussian(x)),
    "loess": _series(lambda x, r: kernels.lowess(x)),
    "median_filter": _series(lambda x, r: kernels.median(x)),
    "hampel": _series(lambda x, r: kernels.hampel(x)),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions; returns their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return sorted(FUNCTIONS)
