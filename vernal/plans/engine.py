"""The whole screening: from composites, static layers, sites and precipitation to wetlands and tables, for all sites
at once. Flags, masks, extents and objects, which several results read, are written to the shared folder while the
results are built; the results themselves are lazy. A site without wetlands has no rows; none stops the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernal.config import PEAT_REGIONS, Config
from vernal.functions.classify import classify, summary
from vernal.functions.geo import natural_region
from vernal.functions.projection import from_utm
from vernal.operators import extent, masks, precip
from vernal.operators.components import components
from vernal.sources.scratch import written


def run(composite: DataFrame, grid: DataFrame, static: DataFrame | None, sites: DataFrame, monthly: DataFrame, cfg: Config = Config(), region: str | None = None, include_mss_veg: bool = False) -> dict[str, DataFrame]:
    """composite (site, year, row, col, bands), grid (site, n_rows, n_cols), sites (site, prefix, x0, y0, epsg, lat0,
    project, rings), monthly (series = site, year, month, p). include_mss_veg is accepted and changes nothing, as the
    first sensors never give wet vegetation. region holds for all sites; without it, each site's comes from its
    latitude. The peat rule holds at sites whose region has peatland."""
    thr, px = cfg.thresholds, cfg.scale_m
    of = sites.select("site", (F.lit(region) if region else natural_region(F.col("lat0"))).alias("natural_region"))
    flags = masks.vegetation_flags(masks.water_flags(composite, thr), grid, static, px, thr)
    flags = written(flags.join(of.select("site", F.lower("natural_region").isin(*PEAT_REGIONS).alias("__peat")), "site", "left"), "flags")
    peat = F.coalesce("__peat", F.lit(False))
    found = masks.final_masks(flags, masks.support(flags, static, grid, px, peat, thr), peat).drop("__peat")
    years = precip.classify_years(monthly, cfg.precip)
    found = written(extent.with_class(found, years.select(F.col("series").alias("site"), F.col("water_year").alias("year"), precip.effective_class(years).alias("cls"))), "masks")
    extents = written(extent.clean(extent.raw_extents(found, thr), grid, px, thr), "extents")
    every = extents.where("subset = 'all'")
    objects = written(components(every.drop("subset"), ["site"]), "objects")
    w = extent.locate(objects, sites.select("site", "prefix", "x0", "y0", "project", "rings"), px)
    lon, lat = from_utm(F.col("cx"), F.col("cy"), F.col("epsg"))
    freq = extent.frequencies(found)
    w = w.join(sites.select("site", "epsg", "lat0"), "site").withColumns({"centroid_lon": F.round(lon, 6), "centroid_lat": F.round(lat, 6)})
    w = w.join(of, "site")
    w = w.join(extent.zonal(objects, freq, static, extents, thr), ["site", "label"])
    w = w.withColumns({"wet_year_extent_ha": F.bround(F.col("in_wet_year_extent") * F.col("area_ha"), 2), "dry_year_extent_ha": F.bround(F.col("in_dry_year_extent") * F.col("area_ha"), 2)})
    w = classify(w, thr).withColumn("area_ha", F.round("area_ha", 3)).drop("epsg", "lat0")
    wy = years.select(F.col("series").alias("site"), F.col("water_year").alias("year"), "precip", "pct_of_normal", "percentile", "wet_dry", "wet_dry_24mo")
    wy = wy.join(precip.spi_years(monthly, cfg.precip).select(F.col("series").alias("site"), F.col("water_year").alias("year"), "spi12", "spi24"), ["site", "year"], "left")
    return {
        "wetlands": w,
        "wetland_pixels": objects,
        "summary_by_class": summary(w),
        "extent_by_year": extent.extent_by_year(found, every, px, wy),
        "totals": extent.totals(extents, px),
        "extents": extents,
        "frequencies": freq,
        "precip_years": years.join(precip.spi_years(monthly, cfg.precip), ["series", "water_year"], "left"),
    }
