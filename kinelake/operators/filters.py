"""Trajectory filters by name, applied to every series in one grouped Arrow function.

Hampel and running median also exist as window expressions in ``series``; the
recursive and least-squares filters need a series as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinelake.functions import kernels as k

FILTERS: dict[str, Callable[..., np.ndarray]] = {
    "butterworth": k.butterworth,
    "butterworth_on_speed": k.butterworth_on_speed,
    "gaussian": lambda x, rate, **o: k.gaussian(x, **o),
    "loess": lambda x, rate, **o: k.lowess(x, **o),
    "median": lambda x, rate, **o: k.median(x, **o),
    "kalman": k.kalman,
    "one_euro": k.one_euro,
    "gcv_spline": k.gcv_spline,
    "hampel": lambda x, rate, **o: k.hampel(x, **o),
    "interpolate": lambda x, rate, **o: k.interpolate(x, **o),
}


def register(name: str, kernel: Callable[..., np.ndarray]) -> None:
    """Add a filter: a function of (values, rate, **options)."""
    FILTERS[name] = kernel


def smooth(df: DataFrame, keys: list[str], sort: list[str], values: list[str], name: str, rate: float, **options) -> DataFrame:
    """``df`` with the columns ``values`` filtered along each series; NULL is missing."""
    if name not in FILTERS:
        raise ValueError(f"no filter {name}; there are {', '.join(sorted(FILTERS))}")
    kernel = FILTERS[name]
    df = df.withColumns({v: df[v].cast("double") for v in values})

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in sort])
        for v in values:
            x = table.column(v).cast(pa.float64()).to_numpy()
            y = kernel(np.where(np.isfinite(x), x, np.nan), rate, **options)
            at = table.column_names.index(v)
            table = table.set_column(at, v, pa.array(y, pa.float64(), mask=~np.isfinite(y)))
        return table

    return df.groupBy(*keys).applyInArrow(run, df.schema)
