"""Outlines of pixel objects as rings, and boxes of sites in degrees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernal.functions.projection import from_utm

#: Sides of a pixel, each with the pixel on its right: corners (row, col) from and to, relative to the pixel.
_SIDES = ((0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0))
POINTS = "array<struct<x:double,y:double>>"


def border(px: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r1, c1, r2, c2): directed sides of objects (keys, row, col) that no second pixel of the object shares."""
    side = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("a", "b", "c", "d"), s, strict=True)]) for s in _SIDES]))
    s = px.select(*keys, "row", "col", side.alias("s"))
    s = s.select(*keys, (F.col("row") + F.col("s.a")).alias("r1"), (F.col("col") + F.col("s.b")).alias("c1"), (F.col("row") + F.col("s.c")).alias("r2"), (F.col("col") + F.col("s.d")).alias("c2"))
    ends = [F.struct(F.col(r).alias("r"), F.col(c).alias("c")) for r, c in (("r1", "c1"), ("r2", "c2"))]
    low, high = F.least(*ends), F.greatest(*ends)
    once = s.groupBy(*keys, low.alias("p"), high.alias("q")).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("r1", "c1", "r2", "c2")]).where("n = 1")
    return once.select(*keys, "r1", "c1", "r2", "c2")


def traced(start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Closed rings (row, col corners, the first repeated) of directed sides. Where two pixels touch at a corner the ring
    goes on to the other one, so that an 8-connected object has one outer ring."""
    leaving: dict[tuple, list[int]] = {}
    for i, p in enumerate(map(tuple, start.tolist())):
        leaving.setdefault(p, []).append(i)
    used, rings = np.zeros(len(start), bool), []
    for first in np.lexsort((start[:, 1], start[:, 0])):
        if used[first]:
            continue
        ring, i = [], int(first)
        while not used[i]:
            used[i] = True
            d = end[i] - start[i]
            if not ring or (d != ring[-1][1]).any():  # corners only
                ring.append((tuple(start[i].tolist()), d))
            out = [j for j in leaving[tuple(end[i].tolist())] if not used[j]]
            if not out:
                break
            # to the left first: clockwise rings keep their object on the right, a left turn leads to the diagonal pixel
            left = np.array([-d[1], d[0]])
            i = next((j for j in out if ((end[j] - start[j]) == left).all()), out[0])
        points = [p for p, _ in ring]
        if len(ring) > 1 and (ring[0][1] == ring[-1][1]).all():  # the start lies within a straight side
            points = points[1:]
        rings.append(np.array([*points, points[0]]))
    return rings


def outlines(px: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rings: outer ring first, then holes, as corners (x: col, y: row)) of objects. A task holds the border of an object."""
    b = border(px, keys)
    schema = ", ".join(f"`{c}` {px.schema[c].dataType.simpleString()}" for c in keys) + f", rings array<{POINTS}>"
    point = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def one(table: pa.Table) -> pa.Table:
        at = lambda c: table.column(c).to_numpy().astype(np.int64)
        rings = traced(np.stack([at("r1"), at("c1")], axis=1), np.stack([at("r2"), at("c2")], axis=1))
        area = [float((r[:-1, 1] * r[1:, 0] - r[1:, 1] * r[:-1, 0]).sum()) for r in rings]
        order = sorted(range(len(rings)), key=lambda i: -abs(area[i]))  # the outer ring has the greatest
        value = [[{"x": float(c), "y": float(r)} for r, c in rings[i]] for i in order]
        return pa.table([*[table.column(c).slice(0, 1).combine_chunks() for c in keys], pa.array([value], point)], names=[*keys, "rings"])

    return b.groupBy(*keys).applyInArrow(one, schema)


def in_degrees(rings: Column, x0: Column, y0: Column, epsg: Column, pixel: float) -> Column:
    """Rings of pixel corners to longitude and latitude, six places."""

    def point(p: Column) -> Column:
        lon, lat = from_utm(x0 + p["x"] * pixel, y0 - p["y"] * pixel, epsg)
        return F.struct(F.round(lon, 6).alias("x"), F.round(lat, 6).alias("y"))

    return F.transform(rings, lambda ring: F.transform(ring, point))


def bounds(sites: DataFrame, buffer_m: float = 0.0, steps: int = 16) -> DataFrame:
    """sites (site, epsg, x_min, x_max, y_min, y_max) to (site, west, south, east, north): the box with a buffer, in
    degrees. Its sides are curves there, so they are followed in steps."""
    d = float(buffer_m)
    part = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: k / float(steps))
    x0, x1, y0, y1 = F.col("x_min") - d, F.col("x_max") + d, F.col("y_min") - d, F.col("y_max") + d
    across = lambda y: F.transform(part, lambda t: F.struct((x0 + (x1 - x0) * t).alias("x"), y.alias("y")))
    along = lambda x: F.transform(part, lambda t: F.struct(x.alias("x"), (y0 + (y1 - y0) * t).alias("y")))
    sides = F.concat(across(y0), across(y1), along(x0), along(x1))

    def degrees(p: Column) -> Column:
        lon, lat = from_utm(p["x"], p["y"], F.col("epsg"))
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    at = sites.withColumn("__p", F.transform(sides, degrees))
    of = lambda c: F.transform("__p", lambda p: p[c])
    return at.select("site", F.array_min(of("lon")).alias("west"), F.array_min(of("lat")).alias("south"), F.array_max(of("lon")).alias("east"), F.array_max(of("lat")).alias("north"))
