"""Command line: sites, run, precip, basemap, version. A run over many sites is one Spark job."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vernal import __version__
from vernal.config import Config


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vernal")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sites", help="list the project sites of an AOI file")
    s.add_argument("aoi")
    s.add_argument("--study-buffer-m", type=float, default=2000.0)
    r = sub.add_parser("run", help="screen the sites of an AOI file and write the result folder")
    r.add_argument("aoi")
    r.add_argument("--composites", required=True, help="stack of yearly composites (see sources.stack)")
    r.add_argument("--monthly", required=True, help="Parquet (series: site, year, month, p)")
    r.add_argument("--static", help="Parquet (site, row, col, worldcover, jrc_occurrence, slope_deg, treecover_pct)")
    r.add_argument("--out", default="vernal_out")
    r.add_argument("--site", action="append", help="only these site slugs")
    r.add_argument("--study-buffer-m", type=float, default=2000.0)
    r.add_argument("--start-year", type=int, default=1972)
    r.add_argument("--end-year", type=int)
    r.add_argument("--scale-m", type=float, default=20.0)
    r.add_argument("--natural-region")
    r.add_argument("--min-years", type=int, default=2)
    r.add_argument("--min-area-ha", type=float, default=0.05)
    c = sub.add_parser("precip", help="classify the water years of a point")
    c.add_argument("lon", type=float)
    c.add_argument("lat", type=float)
    c.add_argument("--start-year", type=int, default=1972)
    c.add_argument("--end-year", type=int, required=True)
    c.add_argument("--source", default="era5", help="era5 (gridded points) or eccc (gauges)")
    c.add_argument("--points", help="Parquet (lon, lat, month, p_m)")
    c.add_argument("--stations", help="Parquet (station_id, lon, lat)")
    c.add_argument("--daily", help="Parquet (station, day, p)")
    c.add_argument("--station")
    c.add_argument("--out")
    b = sub.add_parser("basemap", help="list the map tiles over each site")
    b.add_argument("aoi")
    b.add_argument("--zoom", type=int)
    b.add_argument("--study-buffer-m", type=float, default=2000.0)
    b.add_argument("--out")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    from vernal.functions import geo
    from vernal.operators import outline, precip
    from vernal.operators.sites import split_sites
    from vernal.plans import results
    from vernal.sources.kml import load_aoi

    spark = SparkSession.builder.appName("vernal").getOrCreate()
    read = lambda path: spark.read.parquet(path) if path else None
    if a.command == "sites":
        split_sites(load_aoi(spark, a.aoi), a.study_buffer_m).select("name", "site", "epsg", "project_area_ha").orderBy("name").show(1000, truncate=False)
    elif a.command == "run":
        cfg = Config(study_buffer_m=a.study_buffer_m, scale_m=a.scale_m, start_year=a.start_year)
        cfg = replace(cfg, thresholds=replace(cfg.thresholds, min_years_for_extent=a.min_years, min_wetland_area_m2=a.min_area_ha * 1e4))
        results.run_sites(spark, a.aoi, a.composites, read(a.monthly), a.out, read(a.static), a.site, cfg, a.natural_region, a.end_year).show(1000, truncate=False)
    elif a.command == "precip":
        site = spark.createDataFrame([("point", a.lon, a.lat)], "site string, lon double, lat double")
        key = {k: v for k, v in vars(a).items() if k not in ("command", "out")}
        make = lambda: precip.history(a.source, site, a.start_year, a.end_year, read(a.points), read(a.stations), read(a.daily), a.station)[1]
        years = results.cached(spark, f"{a.out}/cache", key, make) if a.out else make()
        if a.out:
            years.write.mode("overwrite").csv(f"{a.out}/precip_years", header=True)
        years.orderBy("water_year").show(200, truncate=False)
    else:
        box = outline.bounds(split_sites(load_aoi(spark, a.aoi), a.study_buffer_m), 100.0)
        zoom = F.lit(a.zoom) if a.zoom else geo.zoom_for((F.col("south") + F.col("north")) / 2, F.lit(1.0)).cast("int")
        tiles = geo.within_limit(geo.tile_cover(box.withColumn("z", zoom))).select("site", "z", "x", "y", geo.quadkey(F.col("x"), F.col("y"), F.col("z")).alias("quadkey"))
        tiles.write.mode("overwrite").partitionBy("site").parquet(a.out) if a.out else tiles.show(400, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
