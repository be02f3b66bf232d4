"""Missing values, clipping, logs and row sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL is the only missing value inside the library: aggregates skip NULL but not NaN."""
    types = dict(df.dtypes)
    cols = [c for c in (columns or df.columns) if types[c] in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def null_sentinels(c: Column, sentinels: Sequence[float] = (-9999.0, 0.0)) -> Column:
    return F.when(~c.isin(list(sentinels)) & ~F.isnan(c), c)


def grid_clean(value: Column, row: Column, col: Column, corner: tuple[int, int] | None = (140, 15)) -> Column:
    """Grid reading rule: -9999 and exact zero are land; a fixed corner of the grid is not used."""
    keep = ~value.isin(-9999.0, 0.0)
    if corner is not None:
        keep = keep & ~((row >= corner[0]) & (col < corner[1]))
    return F.when(keep, value)


def to_number(c: Column) -> Column:
    """Number from text; text that is not a number gives NULL."""
    return c.try_cast("double")


def surface_depth(depth: Column) -> Column:
    """Depth 0 stands for the first sample just below the surface."""
    return F.when(depth == 0, F.lit(0.1)).otherwise(depth)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    out = c
    if low is not None:
        out = F.when(c < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(c > high, F.lit(float(high))).otherwise(out)
    return out


def log_offset(c: Column, base: str = "log10", offset: float = 1e-6, strict: bool = False) -> Column:
    """log(c + offset); values that stay non-positive are NULL, or an error when ``strict``."""
    z = c + F.lit(offset)
    fn = F.log10 if base == "log10" else F.log
    if strict:
        bad = F.raise_error(F.lit("non-positive value after the log offset"))
        return F.when(z <= 0, bad.cast("double")).otherwise(fn(z))
    return F.when(z > 0, fn(z))


def power(c: Column, exponent: float) -> Column:
    return F.pow(c, F.lit(float(exponent)))


def row_sum(columns: Sequence[Column | str], min_count: int = 0) -> Column:
    """Sum over columns that skips NULL; NULL when fewer than ``min_count`` are present."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    if min_count <= 0:
        return total
    present = F.lit(0)
    for c in cols:
        present = present + F.when(c.isNotNull(), 1).otherwise(0)
    return F.when(present >= min_count, total)


def named_series(df: DataFrame, definition: dict[str, Sequence[str]]) -> DataFrame:
    """Add one summed column per series; members that the table lacks are left out."""
    return df.withColumns(
        {name: row_sum([m for m in members if m in df.columns], min_count=1)
         for name, members in definition.items()
         if any(m in df.columns for m in members)}
    )


def try_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)
