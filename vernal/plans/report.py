"""Data sets of the report's charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precip_chart(spine: DataFrame, years: DataFrame, normal: tuple[int, int] = (1991, 2020)) -> DataFrame:
    """(series, year) with total, 12-month class and the mean of the normal period's years that are there."""
    y = spine.join(years.select("series", F.col("water_year").alias("year"), "precip", "wet_dry"), ["series", "year"], "left")
    mean = F.avg(F.when(F.col("year").between(*normal), F.col("precip"))).over(Window.partitionBy("series"))
    return y.select("series", "year", "precip", F.coalesce("wet_dry", F.lit("no_data")).alias("wet_dry"), mean.alias("normal_mean"))


def tiles(results: dict[str, DataFrame], sites: DataFrame) -> DataFrame:
    """A row a site with the figures at the head of its report, from engine.run's results."""
    ha = results["totals"].groupBy("site").agg(*[F.bround(F.max(F.when(F.col("subset") == s, F.col("extent_ha"))), 2).alias(c) for s, c in (("all", "greatest_extent_ha"), ("wet", "wet_year_extent_ha"), ("dry", "dry_year_extent_ha"))])
    w = results["wetlands"].groupBy("site").agg(F.count("*").alias("n_wetlands"), F.count_if(F.col("location") == "project_area").alias("n_project"), F.first("natural_region").alias("natural_region"))
    y = results["precip_years"].groupBy(F.col("series").alias("site")).agg(F.count("*").alias("n_years"))
    out = sites.select("site", "project_area_ha").join(w, "site", "left").join(ha, "site", "left").join(y, "site", "left")
    return out.na.fill(0, ["n_wetlands", "n_project", "n_years"]).na.fill(0.0, ["greatest_extent_ha", "wet_year_extent_ha", "dry_year_extent_ha"])


def years_table(by_year: DataFrame) -> DataFrame:
    """The report's table of years, in order."""
    return by_year.select("site", "year", "sensor", "coverage_pct", "spring_water_ha", "late_water_ha", "wet_veg_ha", "wet_total_ha", "precip", "pct_of_normal", "wet_dry", "wet_dry_24mo", "spi12").orderBy("site", "year")


def extent_chart(by_year: DataFrame, least_coverage: float = 50.0) -> DataFrame:
    """Years with enough coverage, and whether they are of the first sensors."""
    return by_year.where(F.col("coverage_pct") >= least_coverage).select("site", "year", "spring_water_ha", "late_water_ha", "wet_veg_ha", "wet_total_ha", (F.col("sensor") == "MSS").alias("is_mss"))
