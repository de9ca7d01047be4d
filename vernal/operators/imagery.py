"""Scenes to yearly composites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernal.config import Season, Thresholds
from vernal.functions import raster as R

PIXEL = ("site", "year", "row", "col")


def harmonise(scenes: DataFrame, family: str) -> DataFrame:
    """Raw bands of one sensor family to blue, green, red, nir, swir1 in 0-1; masked pixels have NULL bands."""
    b = {k: F.col(v).cast("double") if v else F.lit(None).cast("double") for k, v in R.BANDS[family].items()}
    scale = R.mss if family.startswith("MSS") else R.sentinel if family == "S2" else R.landsat
    v = {k: scale(c) for k, c in b.items()}
    ok = R.mss_ok(F.col("qa"), v["green"], v["red"]) if family.startswith("MSS") else R.sentinel_ok(F.col("qa")) if family == "S2" else R.landsat_ok(F.col("qa"), v["blue"], v["nir"])
    return scenes.select(*[c for c in scenes.columns if c not in set(R.BANDS[family].values())], *[F.when(ok, c).alias(k) for k, c in v.items()])


def in_window(day: Column, window: tuple[str, str]) -> Column:
    """Month-day window, end exclusive."""
    md = F.date_format(day, "MM-dd")
    return (md >= window[0]) & (md < window[1])


def scenes(collections: list[DataFrame], season: Season = Season(), thr: Thresholds = Thresholds()) -> DataFrame:
    """Sensor collections in one table, with clouded scenes left out and the window named."""
    one = [c.where(F.col("cloud_pct") < thr.max_cloud_pct) for c in collections]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one)
    day = F.col("day")
    out = out.withColumn("win", F.when(in_window(day, season.spring), "spring").when(in_window(day, season.late), "late"))
    return out.where("win IS NOT NULL").withColumn("year", F.year("day"))


def add_indices(px: DataFrame, thr: Thresholds = Thresholds()) -> DataFrame:
    """wi, ndmi (the water index of the era without short-wave infrared) and ndvi, in stored steps."""
    nd = R.normalised_difference
    ndwi, mndwi = nd(F.col("green"), F.col("nir")), nd(F.col("green"), F.col("swir1"))
    old = F.col("year") <= thr.mss_last_year
    return px.withColumns({"wi": R.quantise(R.water_index(F.col("year"), ndwi, mndwi, thr)), "ndmi": R.quantise(F.when(old, ndwi).otherwise(nd(F.col("nir"), F.col("swir1")))), "ndvi": R.quantise(nd(F.col("nir"), F.col("red")))})


def composite(obs: DataFrame) -> DataFrame:
    """(site, year, row, col, win, wi, ndmi, ndvi) to one row a pixel and year: 75th percentile of the spring
    water index, medians of late ones, and counts. Percentiles are exact. A pixel has few observations a year, so the
    rows themselves are shuffled, once: states of percentiles from each task would be more, not less."""
    s, w = F.col("win") == "spring", F.col("win") == "late"
    mid = lambda c: F.percentile(F.when(w, F.col(c)), 0.5)
    return obs.repartition(*PIXEL).groupBy(*PIXEL).agg(
        F.percentile(F.when(s, F.col("wi")), 0.75).alias("wi_spr"),
        mid("wi").alias("wi_late"),
        mid("ndmi").alias("ndmi"),
        mid("ndvi").alias("ndvi"),
        F.count(F.when(s, F.col("wi"))).alias("n_spr"),
        F.count(F.when(w, F.col("wi"))).alias("n_late"),
    )


def scene_inventory(found: DataFrame, first: int, last: int) -> DataFrame:
    """Scenes by year and window, zero where there are none."""
    spine = found.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    n = found.groupBy("year").agg(F.count(F.when(F.col("win") == "spring", 1)).alias("n_spring"), F.count(F.when(F.col("win") == "late", 1)).alias("n_late"))
    return spine.join(n, "year", "left").na.fill(0, ["n_spring", "n_late"])


def slope(dem: DataFrame, pixel: float) -> DataFrame:
    """Horn's slope in degrees from (site, row, col, z): nine shifted copies summed by pixel, one shuffle.
    Edge pixels, which lack neighbours, have NULL."""
    # weights of z at (row + dr, col + dc) in the differences along x and y
    weights = [(dr, dc, (2 if dr == 0 else 1) * dc, (2 if dc == 0 else 1) * dr) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    shift = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(wx).alias("wx"), F.lit(wy).alias("wy")) for dr, dc, wx, wy in weights]))
    s = dem.select("site", "row", "col", "z", shift.alias("k"))
    s = s.select("site", (F.col("row") - F.col("k.dr")).alias("row"), (F.col("col") - F.col("k.dc")).alias("col"), (F.col("z") * F.col("k.wx")).alias("x"), (F.col("z") * F.col("k.wy")).alias("y"), ((F.col("k.dr") == 0) & (F.col("k.dc") == 0)).alias("own"))
    g = s.groupBy("site", "row", "col").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n"), F.max("own").alias("own")).where("own")
    return g.select("site", "row", "col", F.when(F.col("n") == 9, F.degrees(F.atan(F.hypot("x", "y") / (8.0 * pixel)))).alias("slope_deg"))


def static_layers(pixels: DataFrame, cover: DataFrame, jrc: DataFrame, slopes: DataFrame, tree: DataFrame) -> DataFrame:
    """Layers on one pixel table; no water occurrence recorded means 0."""
    key = ["site", "row", "col"]
    out = pixels
    for layer in (cover, jrc, slopes, tree):
        out = out.join(layer, key, "left")
    return out.withColumn("jrc_occurrence", F.coalesce("jrc_occurrence", F.lit(0.0)))
