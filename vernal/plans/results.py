"""A run over the sites of an AOI file, and its result folder: tables partitioned by site, so that many sites are one job."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vernal.config import Config
from vernal.operators import outline
from vernal.operators.sites import split_sites
from vernal.plans import engine, report
from vernal.sources import stack
from vernal.sources.kml import load_aoi

#: Metres that the raster of a site goes beyond its study area.
MARGIN_M = 100.0


def chosen(sites: DataFrame, slugs: list[str] | None) -> DataFrame:
    """sites, or those of the given slugs; none is an error."""
    if not slugs:
        return sites
    out = sites.where(F.col("site").isin(*slugs))
    if out.isEmpty():
        raise ValueError(f"no site matched {slugs}")
    return out


def site_grid(sites: DataFrame, pixel: float, margin: float = MARGIN_M) -> DataFrame:
    """sites with x0, y0 (north-west corner), n_rows and n_cols of the raster over their study area."""
    size = lambda a, b: F.ceil((F.col(b) - F.col(a) + 2 * margin) / pixel).cast("int")
    return sites.withColumns({"x0": F.col("x_min") - margin, "y0": F.col("y_max") + margin, "n_rows": size("y_min", "y_max"), "n_cols": size("x_min", "x_max")})


def cached(spark: SparkSession, folder: str, key: dict, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """What make() gives, kept under folder by all that it depends on: another source or other years are another entry."""
    name = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    if overwrite or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_sites(spark: SparkSession, aoi: str, composites: str, monthly: DataFrame, out: str, static: DataFrame | None = None, slugs: list[str] | None = None, cfg: Config = Config(), region: str | None = None, end_year: int | None = None) -> DataFrame:
    """Screens all sites of an AOI file, or those of slugs, and writes the result folder. Returns and writes the run
    summary (site, n_wetlands, greatest_extent_ha); a site without composites is in it with an error."""
    sites = site_grid(chosen(split_sites(load_aoi(spark, aoi), cfg.study_buffer_m), slugs), cfg.scale_m)
    names = [r["site"] for r in sites.select("site").collect()]  # the sites of a file
    comp = stack.read_stack(spark, composites, names, cfg.start_year, end_year)
    grid = sites.select("site", "n_rows", "n_cols")
    got = engine.run(comp, grid, static, sites, monthly, cfg, region)
    rings = outline.outlines(got["wetland_pixels"], ["site", "label"])
    at = sites.select("site", "x0", "y0", "epsg")
    rings = rings.join(at, "site").select("site", "label", outline.in_degrees(F.col("rings"), F.col("x0"), F.col("y0"), F.col("epsg"), cfg.scale_m).alias("rings"))
    w = got["wetlands"].join(rings, ["site", "label"], "left")
    to = out.rstrip("/")
    table = lambda df, name: df.write.mode("overwrite").partitionBy("site").parquet(f"{to}/{name}")
    table(w, "wetlands")
    w = spark.read.schema(w.schema).parquet(f"{to}/wetlands")
    table(stack.rasters(got["frequencies"], got["extents"], grid), "rasters")
    for name, df in stack.layers(sites, w).items():
        if name != "wetlands":
            table(df, name)
    stack.write_kml(w, f"{to}/wetlands_kml")
    stack.write_geojson(w, f"{to}/wetlands_geojson")
    stack.write_csv(w.drop("rings"), f"{to}/wetlands_csv")
    stack.write_csv(got["extent_by_year"], f"{to}/extent_by_year")
    stack.write_csv(got["summary_by_class"], f"{to}/summary_by_class")
    stack.write_csv(got["precip_years"], f"{to}/precip_years")
    stack.write_json(comp.select("site", "year").distinct(), f"{to}/years")
    stack.write_json(stack.incomplete(comp, grid), f"{to}/years_failed")
    stack.write_json(report.tiles(got, sites), f"{to}/report_tiles")
    found = w.groupBy("site").agg(F.count("*").alias("n_wetlands"))
    total = got["totals"].where("subset = 'all'").select("site", F.bround("extent_ha", 2).alias("greatest_extent_ha"))
    seen = comp.select("site").distinct().withColumn("__seen", F.lit(True))
    summary = sites.select("site").join(found, "site", "left").join(total, "site", "left").join(seen, "site", "left").na.fill(0, ["n_wetlands"]).na.fill(0.0, ["greatest_extent_ha"])
    summary = summary.select("site", "n_wetlands", "greatest_extent_ha", F.when(F.col("__seen").isNull(), "no composites").alias("error"))
    stack.write_json(summary, f"{to}/run_summary")
    return summary
