"""Frequencies, greatest extent, wetland objects and their statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernal.config import COVER, Thresholds
from vernal.functions.geo import edge_distance, inside
from vernal.operators.focal import TILE, grown, on_masks, shrunk, without_small

PX = ["site", "row", "col"]
CLASSES = {"wet": ("wet", "very_wet"), "dry": ("dry", "very_dry"), "normal": ("normal",)}


def _share(n: Column, d: Column) -> Column:
    return F.count_if(n) / F.nullif(F.count_if(d), F.lit(0))


def with_class(masks: DataFrame, year_class: DataFrame) -> DataFrame:
    """masks with cls: no_data where a year has none. year_class: (site, year, cls), a row for each year."""
    return masks.join(year_class, ["site", "year"], "left").withColumn("cls", F.coalesce("cls", F.lit("no_data")))


def frequencies(masks: DataFrame) -> DataFrame:
    """One pass over pixels and years: counts, frequencies, and those of wet, dry and normal years."""
    aggs = [F.count_if("obs").alias("n_obs_years"), F.count_if("wet").alias("n_wet_years"), _share(F.col("wet"), F.col("obs")).alias("f_wet"), _share(F.col("w_spr"), F.col("obs_spr")).alias("f_spring"), _share(F.col("w_late"), F.col("obs_late")).alias("f_late"), _share(F.col("veg"), F.col("obs_late")).alias("f_wetveg")]
    for name, members in CLASSES.items():
        own = F.col("cls").isin(*members)
        for f, n, d in (("f_late", "w_late", "obs_late"), ("f_spring", "w_spr", "obs_spr"), ("f_wet", "wet", "obs")):
            aggs.append(_share(own & F.col(n), own & F.col(d)).alias(f"{f}_{name}_yrs"))
    return masks.groupBy(*PX).agg(*aggs)


def raw_extents(masks: DataFrame, thr: Thresholds = Thresholds()) -> DataFrame:
    """(site, subset, row, col) of pixels wet in enough years: all, wet and dry years in one pass."""
    n = thr.min_years_for_extent
    g = masks.where("wet").groupBy(*PX).agg(F.count("*").alias("a"), *[F.count_if(F.col("cls").isin(*CLASSES[c])).alias(c[0]) for c in ("wet", "dry")])
    subsets = F.array_compact(F.array(F.when(F.col("a") >= n, "all"), F.when(F.col("w") >= n, "wet"), F.when(F.col("d") >= n, "dry")))
    return g.select("site", F.explode(subsets).alias("subset"), "row", "col")


def clean(mask: DataFrame, grid: DataFrame, pixel: float, thr: Thresholds = Thresholds(), tile: int = TILE) -> DataFrame:
    """Small holes filled, one opening and closing, slivers removed - for all subsets at once, in one shuffle.

    A part of fewer than k pixels lies within k pixels of each of its pixels, and a part that reaches further has k
    or more of them in the window: so small holes and slivers are known from a halo of their largest size."""
    hole, least = thr.area_px(thr.fill_hole_area_m2, pixel), thr.area_px(thr.min_wetland_area_m2, pixel)

    def one(m: np.ndarray) -> np.ndarray:
        if hole > 1:
            back = ~m
            m = m | (back & ~without_small(back, hole))
        m = shrunk(grown(grown(shrunk(m))))
        return without_small(m, least) if least > 1 else m

    return on_masks(mask, ["site", "subset"], grid, hole + 4 + least, one, tile)


def extent_by_year(masks: DataFrame, extent: DataFrame, pixel: float, water_years: DataFrame | None = None) -> DataFrame:
    """Areas inside the extent for each year; years without a wet or observed pixel there have zeros."""
    ha = pixel * pixel / 1e4
    size = extent.groupBy("site").agg(F.count("*").alias("n_extent"))
    spine = masks.select("site", "year", "is_mss").distinct()
    g = masks.join(extent.select(*PX), PX, "left_semi").groupBy("site", "year").agg(*[F.count_if(c).alias(c) for c in ("obs", "w_spr", "w_late", "veg", "wet")])
    y = spine.join(g, ["site", "year"], "left").join(size, "site", "left").na.fill(0)
    r = lambda n: F.bround(F.col(n) * F.lit(ha), 2)
    y = y.select("site", "year", F.when(F.col("is_mss"), "MSS").otherwise("Landsat/S2").alias("sensor"), r("obs").alias("observed_ha"), r("w_spr").alias("spring_water_ha"), r("w_late").alias("late_water_ha"), r("veg").alias("wet_veg_ha"), r("wet").alias("wet_total_ha"), F.bround(100.0 * F.col("obs") / F.greatest(F.col("n_extent"), F.lit(1)), 2).alias("coverage_pct"))
    return y if water_years is None else y.join(water_years, ["site", "year"], "left")


def locate(px: DataFrame, sites: DataFrame, pixel: float) -> DataFrame:
    """Objects (site, label, row, col) to one row each: area, centroid, distance to and share in the project
    area, location and number. sites: site, prefix, x0, y0 (north-west corner), project (edges), rings (array of
    name, edges, from the smallest outwards). An equi-join on site; geometry is an expression."""
    p = px.join(sites, "site")
    x, y = F.col("x0") + (F.col("col") + 0.5) * pixel, F.col("y0") - (F.col("row") + 0.5) * pixel
    p = p.withColumns({"x": x, "y": y})
    p = p.withColumn("in_project", inside(F.col("x"), F.col("y"), F.col("project")))
    p = p.withColumn("away", F.when(F.col("in_project"), 0.0).otherwise(edge_distance(F.col("x"), F.col("y"), F.col("project"))))
    # place of the first ring that holds the pixel, one more than there are where none does
    hit = F.transform("rings", lambda r, i: F.when(inside(F.col("x"), F.col("y"), r["edges"]), i + 1).otherwise(F.size("rings") + 1))
    p = p.withColumn("rank", F.when(F.col("in_project"), 0).otherwise(F.coalesce(F.array_min(hit), F.lit(1))))
    names = F.first(F.transform("rings", lambda r: r["name"]))
    w = p.groupBy("site", "label").agg(F.count("*").alias("n_px"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("away").alias("dist"), F.avg(F.col("in_project").cast("int")).alias("share"), F.min("rank").alias("rank"), names.alias("names"), F.first("prefix").alias("prefix"))
    number = F.row_number().over(Window.partitionBy("site").orderBy("rank", F.col("cy").desc(), "cx"))
    location = F.when(F.col("rank") == 0, "project_area").when(F.col("rank") <= F.size("names"), F.concat(F.lit("within_"), F.split(F.trim(F.get("names", F.col("rank") - 1)), r"\s+")[0])).otherwise("study_area")
    return w.select("site", "label", F.format_string("%s-W%02d", "prefix", number).alias("wetland_id"), location.alias("location"), (F.col("n_px") * F.lit(pixel * pixel / 1e4)).alias("area_ha"), F.round("dist", 1).alias("dist_to_project_m"), F.round(F.col("share") * 100, 1).alias("pct_in_project"), "cx", "cy", "n_px")


def smoothed_area(px: DataFrame, pixel: float, smooth: float = 5.0) -> DataFrame:
    """(site, label, smooth_ha): area after a disc closing, which fills (1 - pi/4) s^2 at each reflex corner: one
    for a 2x2 block with three set pixels, two for one with a diagonal pair."""
    corner = (1 - 3.141592653589793 / 4) * smooth * smooth
    b = px.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    b = b.groupBy("site", "label", (F.col("row") - F.col("i")).alias("r"), (F.col("col") - F.col("j")).alias("c")).agg(F.count("*").alias("n"), F.sum(F.bitwise_xor(F.col("i"), F.col("j")) if hasattr(F, "bitwise_xor") else F.col("i").bitwiseXOR(F.col("j"))).alias("odd"))
    reflex = F.when(F.col("n") == 3, 1).when((F.col("n") == 2) & F.col("odd").isin(0, 2), 2).otherwise(0)
    k = b.groupBy("site", "label").agg(F.sum(reflex).alias("k"))
    n = px.groupBy("site", "label").agg(F.count("*").alias("n"))
    return n.join(k, ["site", "label"]).select("site", "label", ((F.col("n") * pixel * pixel + F.col("k") * corner) / 1e4).alias("smooth_ha"))


def zonal(px: DataFrame, freq: DataFrame, static: DataFrame | None, subsets: DataFrame, thr: Thresholds = Thresholds()) -> DataFrame:
    """All statistics of objects (site, label, row, col) in one aggregation: means of pixel ratios, 90th
    percentiles, shares of permanent and seasonal water, cover fractions, shares in the wet- and dry-year extents."""
    j = px.join(freq, PX, "left")
    if static is not None:
        j = j.join(static, PX, "left")
    flags = subsets.groupBy(*PX).agg(F.max(F.col("subset") == "wet").alias("in_wet"), F.max(F.col("subset") == "dry").alias("in_dry"))
    j = j.join(flags, PX, "left")
    layers = [c for c in freq.columns if c.startswith("f_")] + ["n_obs_years"] + [c for c in ("jrc_occurrence", "slope_deg", "treecover_pct") if static is not None and c in static.columns]
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    aggs = [F.avg(c).alias(c) for c in layers]
    aggs += [F.percentile(c, 0.9).alias(f"{c}_p90") for c in ("f_late", "f_spring")]
    aggs += [share(F.col("f_late") >= thr.permanent_late_freq).alias("frac_permanent_water"), share(F.col("f_spring") >= thr.seasonal_spring_freq).alias("frac_seasonal_water")]
    if static is not None and "worldcover" in static.columns:
        aggs += [share(F.col("worldcover").isin(*codes)).alias(f"frac_{name}") for name, codes in COVER.items()]
    aggs += [share(F.col("in_wet")).alias("in_wet_year_extent"), share(F.col("in_dry")).alias("in_dry_year_extent")]
    return j.groupBy("site", "label").agg(*aggs)


def totals(extents: DataFrame, pixel: float) -> DataFrame:
    """Hectares of each subset's extent."""
    return extents.groupBy("site", "subset").agg((F.count("*") * F.lit(pixel * pixel / 1e4)).alias("extent_ha"))
