"""Hooks for user code: measures over batches of files, robust aggregates for small groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826


def custom_measure(files: DataFrame, measure: Callable[[list[str]], dict[str, dict[str, float]]], schema: str, batch: int = 8) -> DataFrame:
    """Call ``measure`` with batches of paths and give its figures by path.

    ``schema`` names the figures (``fwhm double, ...``). A path the measure does not answer gets nulls; an answer for a
    path that was not asked for is an error.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            paths = part["path"].tolist()
            for i in range(0, len(paths), batch):
                asked = paths[i:i + batch]
                got = measure(asked)
                if set(got) - set(asked):
                    raise ValueError("the measure answered for paths it was not asked for")
                yield pd.DataFrame({"path": asked, **{n: [got.get(p, {}).get(n) for p in asked] for n in names}})
    return files.select("path").mapInPandas(run, f"path string, {schema}")


def _upper(v: np.ndarray) -> float:
    return float(np.sort(v)[len(v) // 2])


def _spread(v: np.ndarray) -> float:
    s = MAD_TO_SIGMA * _upper(np.abs(v - _upper(v)))
    return s if s != 0 else 1.0


def upper_median_udaf() -> Callable[[Column | str], Column]:
    """Upper median of a small group as an aggregate function."""
    @F.pandas_udf("double")
    def upper_median(v: pd.Series) -> float:
        x = v.dropna().to_numpy(dtype=float)
        return _upper(x) if len(x) else None
    return upper_median


def mad_udaf() -> Callable[[Column | str], Column]:
    """1.4826 times the median absolute deviation of a small group, 1 when there is none."""
    @F.pandas_udf("double")
    def mad(v: pd.Series) -> float:
        x = v.dropna().to_numpy(dtype=float)
        return _spread(x) if len(x) else None
    return mad


def clipped_median_udaf() -> Callable[[Column | str], Column]:
    """Upper median of a small group after up to five cuts of everything 3 sigma above it."""
    @F.pandas_udf("double")
    def clipped_median(v: pd.Series) -> float:
        x = v.dropna().to_numpy(dtype=float)
        if not len(x):
            return None
        for _ in range(5):
            kept = x[x <= _upper(x) + 3 * _spread(x) / MAD_TO_SIGMA]
            if len(kept) == len(x) or len(kept) < 10:
                break
            x = kept
        return _upper(x)
    return clipped_median
