"""Gridded aggregation: bins, means, weighted histograms, hexagons, periodic blur, contour levels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import in_runs

PI = math.pi


def edge(lo: float | Column, hi: float | Column, n: int, i: Column) -> Column:
    """The i-th of n + 1 edges, by the formula that evenly spaced edges are made with; the last one is hi itself."""
    return F.when(i == n, F.lit(hi) if not isinstance(hi, Column) else hi).otherwise(i * ((hi - lo) / n) + lo)


def bin_of(x: Column, lo: float | Column, hi: float | Column, n: int) -> Column:
    """Index of the last edge <= x (may be -1 or n): computed, then corrected against the edges by one either way."""
    i = F.floor((x - lo) / ((hi - lo) / n))
    i = F.when(x < edge(lo, hi, n, i), i - 1).when(x >= edge(lo, hi, n, i + 1), i + 1).otherwise(i)
    return i.cast("int")


def clipped_bin(x: Column, lo: float, hi: float, n: int) -> Column:
    """Values beyond the edges fall into the outermost bins."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), bin_of(x, lo, hi, n)))


def closed_bin(x: Column, lo: float | Column, hi: float | Column, n: int) -> Column:
    """The last bin includes its upper edge; values beyond the edges have null."""
    return F.when((x >= lo) & (x <= hi), F.least(F.lit(n - 1), bin_of(x, lo, hi, n)))


def histogram(df: DataFrame, scope: Sequence[str], lat: Column, lon: Column, weight: Column | None = None, rows: int = 180, cols: int = 360) -> DataFrame:
    """scope, iy, ix, value: weights (or counts) by cell of the globe; empty cells have no row."""
    iy, ix = closed_bin(lat, -PI / 2, PI / 2, rows), closed_bin(lon, -PI, PI, cols)
    value = F.sum(F.lit(1.0) if weight is None else weight)
    return df.withColumns({"iy": iy, "ix": ix}).where("iy IS NOT NULL AND ix IS NOT NULL").groupBy(*scope, "iy", "ix").agg(value.alias("value"))


def mean_grid(df: DataFrame, scope: Sequence[str], lat: Column, lon: Column, scalar: Column, rows: int = 180, cols: int = 360) -> DataFrame:
    """scope, iy, ix, value: the mean scalar of the cell's points, outliers clipped into the border cells."""
    iy, ix = clipped_bin(lat, -PI / 2, PI / 2, rows), clipped_bin(lon, -PI, PI, cols)
    return df.groupBy(*scope, iy.alias("iy"), ix.alias("ix")).agg(F.avg(scalar).alias("value"))


def tripled(df: DataFrame, lon: str = "lon") -> DataFrame:
    """Each row three times, with its longitude as it is, a turn less and a turn more."""
    return df.withColumn(lon, F.explode(F.array(F.col(lon), F.col(lon) - 2 * PI, F.col(lon) + 2 * PI)))


def scaled(grid: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Values stretched to 0..1 over the scope's filled cells; all 0 where they are equal."""
    span = grid.groupBy(*scope).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    both = grid.join(span, list(scope)) if scope else grid.crossJoin(F.broadcast(span))  # one row without a scope
    return both.withColumn("value", F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))).drop("lo", "hi")


def hexagons(df: DataFrame, scope: Sequence[str], x: str, y: str, gridsize: int = 70) -> DataFrame:
    """scope, lattice, i, j, n: points by the nearest centre of two shifted lattices over the scope's extent.

    The lattices have gridsize x int(gridsize / sqrt 3) centres; distances weigh y three times.
    """
    ny = int(gridsize / math.sqrt(3))
    span = df.groupBy(*scope).agg(*(f(c).alias(f"{n}_{c}") for c in (x, y) for f, n in ((F.min, "lo"), (F.max, "hi"))))
    d = df.join(span, list(scope))

    def place(c: str, n: int) -> Column:
        # An extent without width is widened first, and both ends by a billionth of it.
        flat = F.col(f"hi_{c}") == F.col(f"lo_{c}")
        half = F.when(flat, F.greatest(F.lit(0.1), F.abs(f"lo_{c}") * 0.1)).otherwise(F.lit(0.0))
        lo, hi = F.col(f"lo_{c}") - half, F.col(f"hi_{c}") + half
        pad = 1e-9 * (hi - lo) if c == x else F.lit(0.0)
        return (F.col(c) - (lo - pad)) / ((hi + pad - (lo - pad)) / n)

    d = d.withColumns({"hx": place(x, gridsize), "hy": place(y, ny)})
    d = d.withColumns({"i1": F.rint("hx"), "j1": F.rint("hy"), "i2": F.floor("hx"), "j2": F.floor("hy")})
    d1 = (F.col("hx") - F.col("i1")) ** 2 + 3.0 * (F.col("hy") - F.col("j1")) ** 2
    d2 = (F.col("hx") - F.col("i2") - 0.5) ** 2 + 3.0 * (F.col("hy") - F.col("j2") - 0.5) ** 2
    first = d1 < d2
    pick = d.select(*scope, F.when(first, 1).otherwise(2).alias("lattice"), F.when(first, F.col("i1")).otherwise(F.col("i2")).cast("int").alias("i"), F.when(first, F.col("j1")).otherwise(F.col("j2")).cast("int").alias("j"))
    return pick.groupBy(*scope, "lattice", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def blur_kernel(n: int, sigma: float) -> list[float]:
    """Gains by circular distance of a periodic blur whose spectrum is exp(-k^2 / 2 sigma^2), k in turns per image."""
    ks = range(-(n // 2), n - n // 2)
    return [sum(math.exp(-k * k / (2 * sigma * sigma)) * math.cos(2 * PI * k * d / n) for k in ks) / n for d in range(n)]


def _turning(n: int, sigma: float) -> np.ndarray:
    """The blur as a matrix: its product with a column of n cells is the blurred column."""
    return np.array(blur_kernel(n, sigma))[(np.arange(n)[:, None] - np.arange(n)[None, :]) % n]


def _dense(cells: pa.Table, down: np.ndarray, along: np.ndarray) -> np.ndarray:
    """A grid's cells as a matrix, blurred both ways."""
    h = np.zeros((len(down), len(along)))
    np.add.at(h, (cells["iy"].to_numpy(), cells["ix"].to_numpy()), cells["value"].to_numpy())
    return down @ h @ along.T


def blur(grid: DataFrame, scope: Sequence[str], sigma: float, rows: int = 180, cols: int = 360) -> DataFrame:
    """Periodic Gaussian blur of sparse grids, along the rows and columns, as matrix products.

    A scope is one grid of rows x cols cells at most. sigma <= 0 leaves the grids as they are. Every cell of a
    scope with a filled cell has a row.
    """
    if sigma <= 0:
        return grid
    down, along, types = _turning(rows, sigma), _turning(cols, sigma), dict(grid.dtypes)
    iy, ix = (pa.array(i.ravel().astype(np.int32)) for i in np.indices((rows, cols)))

    def one(cells: pa.Table) -> pa.Table:
        keys = {c: pa.repeat(cells[c][0], rows * cols) for c in scope}
        return pa.table({**keys, "iy": iy, "ix": ix, "value": pa.array(_dense(cells, down, along).ravel())})

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in scope), "iy int, ix int, value double"])
    keys = list(scope) or ["_all"]  # without a scope there's one grid
    return in_runs(grid if scope else grid.withColumn("_all", F.lit(0)), keys, one, schema)


def blur_dense(grid: DataFrame, scope: Sequence[str], sigma: float, n: int) -> DataFrame:
    """``blur`` of square grids of n x n cells."""
    return blur(grid, scope, sigma, n, n)


def blurred_levels(grid: DataFrame, scope: Sequence[str], sigma: float, n: int) -> DataFrame:
    """``contour_levels(blur(...))`` of n x n grids, with one row a group leaving the task, not n x n."""
    turn, types = _turning(n, sigma), dict(grid.dtypes)

    def one(cells: pa.Table) -> pa.Table:
        return pa.table({**{c: cells[c][:1] for c in scope}, "peak": pa.array([float(_dense(cells, turn, turn).max())])})

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in scope), "peak double"])
    return in_runs(grid, scope, one, schema).where("peak > 0").withColumn("level", F.greatest(0.25 * F.col("peak"), F.lit(1e-9)))


def padded(c: str) -> tuple[Column, Column]:
    """The ends of an extent (columns lo_ and hi_ of ``c``), padded by 0.30 of it and 0.05 at least."""
    pad = F.greatest(0.30 * F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-6)), F.lit(0.05))
    return F.col(f"lo_{c}") - pad, F.col(f"hi_{c}") + pad


def padded_histogram(df: DataFrame, scope: Sequence[str], x: str, y: str, n: int = 90) -> DataFrame:
    """scope, iy, ix, value: counts on an n x n grid over each group's extent, padded by 0.30 of it and 0.05 at least."""
    span = df.groupBy(*scope).agg(*(f(c).alias(f"{m}_{c}") for c in (x, y) for f, m in ((F.min, "lo"), (F.max, "hi"))))
    d = df.join(span, list(scope))
    bins = {}
    for c, name in ((x, "ix"), (y, "iy")):
        bins[name] = closed_bin(F.col(c), *padded(c), n)
    return d.withColumns(bins).groupBy(*scope, "iy", "ix").agg(F.count(F.lit(1)).cast("double").alias("value"))


def contour_levels(blurred: DataFrame, scope: Sequence[str]) -> DataFrame:
    """scope, peak, level: the contour is drawn at a quarter of the peak; groups without a positive peak have none."""
    return blurred.groupBy(*scope).agg(F.max("value").alias("peak")).where("peak > 0").withColumn("level", F.greatest(0.25 * F.col("peak"), F.lit(1e-9)))
