"""Neighbourhood operators on pixel relations keyed by (site, ..., row, col).

What a pixel's value depends on lies within a known number of pixels of it (the halo). Pixels are dealt to tiles,
those near a border to each tile that needs them, and each tile is one array: one shuffle for a whole chain of
operators, no task ever holds more than a tile and its halo, and a site of any size is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vernal.operators.components import label_pixels

#: Rows and columns of a tile.
TILE = 512


class Window:
    """A tile with its halo, cut at the raster's border. own: rows of the table that lie in the tile."""

    def __init__(self, table: pa.Table, halo: int, tile: int) -> None:
        column = lambda c: table.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        self.table, self.row, self.col = table, column("row"), column("col")
        self.n_rows, self.n_cols, tr, tc = (int(table.column(c)[0].as_py()) for c in ("n_rows", "n_cols", "__tr", "__tc"))
        self.r0, self.r1 = tr * tile, min((tr + 1) * tile, self.n_rows)
        self.c0, self.c1 = tc * tile, min((tc + 1) * tile, self.n_cols)
        self.top, self.left = max(self.r0 - halo, 0), max(self.c0 - halo, 0)
        self.shape = (min(self.r1 + halo, self.n_rows) - self.top, min(self.c1 + halo, self.n_cols) - self.left)
        self.own = (self.row >= self.r0) & (self.row < self.r1) & (self.col >= self.c0) & (self.col < self.c1)

    def array(self, values: np.ndarray) -> np.ndarray:
        """Values of the table's rows in place, 0 elsewhere."""
        out = np.zeros(self.shape, values.dtype)
        out[self.row - self.top, self.col - self.left] = values
        return out

    def mask(self) -> np.ndarray:
        return self.array(np.ones(len(self.row), bool))

    def pixels(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the set pixels in the tile itself."""
        r, c = np.nonzero(mask[self.r0 - self.top : self.r1 - self.top, self.c0 - self.left : self.c1 - self.left])
        return r + self.r0, c + self.c0


def by_tile(px: DataFrame, keys: list[str], halo: int, fn: Callable[[tuple, Window], pa.Table], schema: T.StructType, tile: int = TILE) -> DataFrame:
    """fn over the windows of px (keys, row, col, n_rows, n_cols, ...), which also holds what lies outside the grid never."""
    tiles = lambda c, n: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0)).cast("int"), F.least(F.floor((F.col(c) + halo) / tile), F.floor((F.col(n) - 1) / tile)).cast("int")))
    dealt = px.where("row >= 0 AND col >= 0 AND row < n_rows AND col < n_cols").withColumn("__tr", tiles("row", "n_rows")).withColumn("__tc", tiles("col", "n_cols"))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        return fn(key, Window(table, halo, tile))

    return dealt.groupBy(*keys, "__tr", "__tc").applyInArrow(one, schema)


def densify(df: DataFrame, grid: DataFrame, keys: list[str], spine: DataFrame) -> DataFrame:
    """All pixels of grid (site, n_rows, n_cols) for each row of spine (keys); absent ones are NULL."""
    full = spine.join(grid.select("site", "n_rows", "n_cols"), "site")
    full = full.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    return full.join(df, [*keys, "row", "col"], "left")


def box_sums(df: DataFrame, value: str, r: int, keys: list[str], tile: int = TILE) -> DataFrame:
    """df (keys, row, col, n_rows, n_cols, integers in value) with box_n and box_sum over the (2r+1)-square of each of its
    pixels: border pixels repeated outside, missing ones skipped. Integers stay exact."""
    columns = df.columns
    out = T.StructType([*df.schema.fields, T.StructField("box_sum", T.LongType()), T.StructField("box_n", T.LongType())])

    def one(_: tuple, w: Window) -> pa.Table:
        held = w.table.column(value)
        there = held.is_valid().to_numpy(zero_copy_only=False)
        v = held.fill_null(0).to_numpy().astype(np.int64)
        # places of a window around the tile, those outside the raster at its border
        rows = np.clip(np.arange(w.r0 - r, w.r1 + r), 0, w.n_rows - 1) - w.top
        cols = np.clip(np.arange(w.c0 - r, w.c1 + r), 0, w.n_cols - 1) - w.left
        sums = []
        for x in (np.where(there, v, 0), there.astype(np.int64)):
            s = np.zeros((len(rows) + 1, len(cols) + 1), np.int64)
            s[1:, 1:] = w.array(x)[rows][:, cols].cumsum(axis=0).cumsum(axis=1)
            k = 2 * r + 1
            sums.append((s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k])[w.row[w.own] - w.r0, w.col[w.own] - w.c0])
        t = w.table.select(columns).filter(pa.array(w.own))
        return t.append_column("box_sum", pa.array(sums[0])).append_column("box_n", pa.array(sums[1]))

    return by_tile(df, keys, r, one, out, tile)


def _boxed(mask: np.ndarray, r: int, least: int) -> np.ndarray:
    """Where at least so many pixels of the (2r+1)-square are set; outside nothing is."""
    k = 2 * r + 1
    s = np.zeros((mask.shape[0] + k, mask.shape[1] + k), np.int32)
    s[1:, 1:] = np.pad(mask, r).cumsum(axis=0, dtype=np.int32).cumsum(axis=1)
    return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k] >= least


def grown(mask: np.ndarray, r: int = 1) -> np.ndarray:
    return _boxed(mask, r, 1)


def shrunk(mask: np.ndarray) -> np.ndarray:
    return _boxed(mask, 1, 9)


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    """mask without its 8-connected parts of fewer than ``least`` pixels."""
    row, col = np.nonzero(mask)
    label, n = np.unique(label_pixels(row, col), return_inverse=True, return_counts=True)[1:]
    out, keep = np.zeros_like(mask), n[label] >= least
    out[row[keep], col[keep]] = True
    return out


def on_masks(px: DataFrame, keys: list[str], grid: DataFrame, halo: int, fn: Callable[[np.ndarray], np.ndarray], tile: int = TILE) -> DataFrame:
    """Set pixels (keys, row, col) after fn, a function of arrays whose result at a pixel depends on its halo only."""
    own = px.select(*keys, "row", "col").join(grid.select("site", "n_rows", "n_cols"), "site").select(*keys, "row", "col", "n_rows", "n_cols")
    schema = T.StructType([own.schema[c] for c in (*keys, "row", "col")])

    def one(_: tuple, w: Window) -> pa.Table:
        row, col = w.pixels(fn(w.mask()))
        first = w.table.select([*keys, "row", "col"])
        return pa.table([*[pa.repeat(first.column(c)[0], len(row)) for c in keys], *[pa.array(x, first.schema.field(c).type) for c, x in (("row", row), ("col", col))]], names=first.schema.names)

    return by_tile(own, keys, halo, one, schema, tile)


def dilate(px: DataFrame, keys: list[str], r: int, grid: DataFrame, tile: int = TILE) -> DataFrame:
    """Set pixels grown by a square of radius r, clipped to the grid."""
    return on_masks(px, keys, grid, r, lambda m: grown(m, r), tile)


def opened(px: DataFrame, keys: list[str], grid: DataFrame, tile: int = TILE) -> DataFrame:
    """Opening by a 3x3 square; what lies outside the grid is not set."""
    return on_masks(px, keys, grid, 2, lambda m: grown(shrunk(m)), tile)


def closed(px: DataFrame, keys: list[str], grid: DataFrame, tile: int = TILE) -> DataFrame:
    """Closing by a 3x3 square. The outermost ring of pixels is always cleared, as the outside counts as not set."""
    return on_masks(px, keys, grid, 2, lambda m: shrunk(grown(m)), tile)
