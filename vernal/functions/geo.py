"""Names, tiles, projections and polygons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns of names.
IMPACT = r"(?i)\s*impact zones\s*$"
SITE_NUMBER = r"(?i)\(site\s*(\d+)\)"
OTHER_SIGNS = "[^A-Za-z0-9]+"
RING_NAME = r"(?i)^\s*\d+\s*(m|km)\b"


def coordinates(text: Column) -> Column:
    """KML coordinate text to array of (x, y): altitudes are dropped, as are tokens with fewer than two numbers."""
    token = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda t: F.split(t, ",")), lambda p: F.size(p) >= 2)
    return F.transform(token, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, "^_+|_+$", "")


def name_slug(name: Column) -> Column:
    return _trimmed(F.regexp_replace(name, OTHER_SIGNS, "_"))


def site_slug(folder: Column) -> Column:
    """Without "impact zones" at the end, "(Site n)" as Siten, other signs as underscores."""
    c = F.regexp_replace(folder, IMPACT, "")
    return _trimmed(F.regexp_replace(F.regexp_replace(c, SITE_NUMBER, "Site$1"), OTHER_SIGNS, "_"))


def unique_slugs(df: DataFrame, slug: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """x, x_2, x_3 ... in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys, slug).orderBy(order))
    return df.withColumn("__n", n).withColumn(slug, F.when(F.col("__n") > 1, F.concat_ws("_", slug, F.col("__n").cast("string"))).otherwise(F.col(slug))).drop("__n")


def is_ring(name: Column) -> Column:
    return F.coalesce(name.rlike(RING_NAME), F.lit(False))


def quadkey(x: Column, y: Column, z: Column) -> Column:
    one = lambda i: (F.call_function("shiftright", x, i - 1).bitwiseAND(F.lit(1)) + 2 * F.call_function("shiftright", y, i - 1).bitwiseAND(F.lit(1))).cast("string")
    return F.array_join(F.transform(F.sequence(z, F.lit(1), F.lit(-1)), one), "")


def zoom_for(lat: Column, metres: Column, pixels: int = 256) -> Column:
    """The least zoom of 10 to 20 whose ground resolution is fine enough, else 20."""
    fine = F.filter(F.sequence(F.lit(10), F.lit(20)), lambda z: F.lit(156543.03) * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), z) * (256.0 / pixels) <= metres)
    return F.coalesce(F.array_min(fine), F.lit(20))


def utm_epsg(lon: Column, lat: Column) -> Column:
    return (F.when(lat < 0, 32700).otherwise(32600) + F.floor((lon + 180) / 6) + 1).cast("int")


def tile_x(lon: Column, z: Column) -> Column:
    return F.floor((lon + 180) / 360 * F.pow(F.lit(2.0), z)).cast("int")


def tile_y(lat: Column, z: Column) -> Column:
    return F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.lit(3.141592653589793)) / 2 * F.pow(F.lit(2.0), z)).cast("int")


def tile_centre_lat(y: Column, z: Column) -> Column:
    """Latitude of the Mercator middle of a tile row."""
    return F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * (y + 0.5) / F.pow(F.lit(2.0), z)))))


def tile_cover(df: DataFrame, z: str = "z") -> DataFrame:
    """A row for each tile over the box west, south, east, north."""
    zc = F.col(z)
    df = df.withColumn("x", F.explode(F.sequence(tile_x(F.col("west"), zc), tile_x(F.col("east"), zc))))
    return df.withColumn("y", F.explode(F.sequence(tile_y(F.col("north"), zc), tile_y(F.col("south"), zc))))


def within_limit(tiles: DataFrame, most: int = 400, site: str = "site") -> DataFrame:
    """tiles, where no site has more than ``most`` of them; an error otherwise."""
    many = tiles.groupBy(site).count().where(F.col("count") > most).orderBy(F.col("count").desc()).first()
    if many is not None:
        raise ValueError(f"{many[site]} needs {many['count']} tiles, {most} at most: choose a smaller zoom")
    return tiles


def natural_region(lat: Column) -> Column:
    return F.when(lat < 52.3, "grassland").when(lat < 54.3, "parkland").otherwise("boreal")


def degrees_apart(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Kilometres, equirectangular."""
    return F.hypot((lon2 - lon1) * F.cos(F.radians(lat1)), lat2 - lat1) * 111.0


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule over edges (x1, y1, x2, y2) of all rings, holes included."""
    crosses = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]))
    return F.pmod(F.size(crosses), F.lit(2)) == 1


def edge_distance(x: Column, y: Column, edges: Column) -> Column:
    """To the nearest edge."""

    def one(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
        return F.hypot(x - e["x1"] - t * dx, y - e["y1"] - t * dy)

    return F.array_min(F.transform(edges, one))


def ring_edges(points: list[tuple[float, float]]) -> Column:
    """Edges of one closed ring as a literal."""
    pairs = zip(points, [*points[1:], points[0]], strict=True)
    return F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (*p, *q), strict=True)]) for p, q in pairs])


def ring_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y)."""
    n = F.size(points)
    term = lambda p, i: p["x"] * F.element_at(points, F.pmod(i + 1, n) + 1)["y"] - F.element_at(points, F.pmod(i + 1, n) + 1)["x"] * p["y"]
    return F.abs(F.aggregate(F.transform(points, term), F.lit(0.0), lambda a, b: a + b)) / 2
