"""Fewer points for charts: of each stretch the one that spans the largest triangle. Sequential in a series, so one group for each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chosen(x: np.ndarray, y: np.ndarray, n: int) -> list[int]:
    """Places of the n points kept: both ends, and for each stretch between them the one farthest from the line of what
    was kept before to the next stretch's mean."""
    if n >= len(x) or n < 3:
        return list(range(len(x)))
    edges = np.floor(np.arange(n - 1) * (len(x) - 2) / (n - 2)).astype(int) + 1
    keep = [0]
    for k in range(n - 2):
        here = slice(edges[k], edges[k + 1])
        after = slice(edges[k + 1], edges[k + 2] if k + 2 < len(edges) else len(x))
        ax, ay, cx, cy = x[keep[-1]], y[keep[-1]], x[after].mean(), y[after].mean()
        area = np.abs((ax - cx) * (y[here] - ay) - (ax - x[here]) * (cy - ay))
        keep.append(int(edges[k] + np.argmax(area)))
    return [*keep, len(x) - 1]


def lttb(df: DataFrame, key: str, day: str, value: str, n: int) -> DataFrame:
    """At most n rows of each series; all rows where there are no more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day).reset_index(drop=True)
        x = pd.to_datetime(pdf[day]).to_numpy().astype("datetime64[D]").astype(float)
        return pdf.iloc[chosen(x, pdf[value].to_numpy(float), n)]

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(value).isNotNull()).select(key, day, value).groupBy(key).applyInPandas(run, f"{key} {kind}, {day} date, {value} double")


def lttb_with_extremes(df: DataFrame, key: str, day: str, value: str, n: int) -> DataFrame:
    """lttb, and the first lowest and highest point of each series."""
    low = df.groupBy(key).agg(F.min_by(F.struct(day, value), F.struct(value, day)).alias("p"))
    high = df.groupBy(key).agg(F.max_by(F.struct(day, value), F.struct(F.col(value), -F.unix_date(day))).alias("p"))
    return lttb(df, key, day, value, n).union(low.union(high).select(key, f"p.{day}", f"p.{value}")).distinct()
