"""Precipitation history: monthly records, water years and their wet or dry class."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernal.config import Precip
from vernal.functions import gamma
from vernal.functions.geo import degrees_apart

MIN_DAYS = 25


def gridded_monthly(points: DataFrame, sites: DataFrame, radius_km: float = 5.0) -> DataFrame:
    """points (lon, lat, month, p_m: metres) and sites (site, lon, lat) to (site, month, precip_mm): mean within a radius.

    One-degree cells make the range join an equi-join; a site is in all cells that its radius can reach, which are more
    of longitude the further from the equator, and cells go on across the 180th meridian."""
    reach = F.lit(float(radius_km)) / 111.0
    wide = F.least(F.lit(180.0), reach / F.greatest(F.cos(F.radians("__lat")), F.lit(1e-6)))
    cells = lambda c, r: F.sequence(F.floor(F.col(c) - r).cast("int"), F.floor(F.col(c) + r).cast("int"))
    around = lambda c: F.pmod(c, F.lit(360))
    s = sites.select("site", F.col("lon").alias("__lon"), F.col("lat").alias("__lat"))
    near = s.withColumn("__cy", F.explode(cells("__lat", reach))).withColumn("__cx", F.explode(F.array_distinct(F.transform(cells("__lon", wide), around))))
    p = points.where("p_m IS NOT NULL").withColumn("__cx", around(F.floor("lon").cast("int"))).withColumn("__cy", F.floor("lat").cast("int"))
    j = p.join(near, ["__cx", "__cy"])
    east = F.col("__lon") + F.pmod(F.col("lon") - F.col("__lon") + 180, F.lit(360.0)) - 180  # the point's longitude on the site's side
    j = j.where(degrees_apart(F.col("__lon"), F.col("__lat"), F.when(F.abs(F.col("lon") - F.col("__lon")) > 180, east).otherwise(F.col("lon")), F.col("lat")) <= radius_km)
    return j.groupBy("site", "month").agg((F.avg("p_m") * 1000).alias("precip_mm"))


def nearest_stations(sites: DataFrame, stations: DataFrame, radius_km: float = 75.0, n: int = 5) -> DataFrame:
    """Up to n stations for each site within the box of the radius, by distance (1 dp), then id."""
    reach = radius_km / 111.0
    k = int(reach) + 1  # whole-degree cells on either side
    around = F.sequence(F.lit(-k), F.lit(k))
    s = sites.select("site", F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    s = s.withColumn("cx", F.explode(F.transform(around, lambda d: F.floor("slon") + d))).withColumn("cy", F.explode(F.transform(around, lambda d: F.floor("slat") + d)))
    t = stations.withColumn("cx", F.floor("lon")).withColumn("cy", F.floor("lat"))
    j = s.join(t, ["cx", "cy"]).where((F.abs(F.col("lon") - F.col("slon")) <= reach) & (F.abs(F.col("lat") - F.col("slat")) <= reach))
    j = j.withColumn("dist_km", F.round(degrees_apart(F.col("slon"), F.col("slat"), F.col("lon"), F.col("lat")), 1))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("dist_km", "station_id"))
    return j.withColumn("place", rank).where(F.col("place") <= n).select("site", "station_id", "dist_km", "place")


def station_monthly(daily: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """(station, day, p) to months with enough days. A day that is there more than once counts once towards them: it is
    days that make a month complete, not readings; the sum has all readings."""
    g = daily.where("p IS NOT NULL").groupBy("station", F.trunc("day", "MM").alias("month")).agg(F.sum("p").alias("p"), F.countDistinct("day").alias("n_days"))
    return g.where(F.col("n_days") >= min_days)


def combine_stations(monthly: DataFrame, priority: Column) -> DataFrame:
    """One record: each month from the first station, by priority, that has it."""
    first = F.min_by(F.struct("station", "p"), F.struct(priority, F.col("station")))
    return monthly.where("p IS NOT NULL").groupBy("month").agg(first.alias("r")).select("month", "r.station", "r.p")


def station_history(sites: DataFrame, stations: DataFrame, daily: DataFrame, station_id=None, radius_km: float = 75.0, n: int = 5) -> DataFrame:
    """(site, month, p): each site's months from the nearest station that has them, or from the one that is asked for.
    sites (site, lon, lat), stations (station_id, lon, lat), daily (station, day, p)."""
    near = nearest_stations(sites, stations, radius_km, n) if station_id is None else sites.select("site", F.lit(station_id).alias("station_id"), F.lit(1).alias("place"))
    m = station_monthly(daily).join(near, F.col("station") == F.col("station_id"))
    return m.groupBy("site", "month").agg(F.min_by("p", "place").alias("p"))


def history(source: str, sites: DataFrame, start_year: int, end_year: int, points: DataFrame | None = None, stations: DataFrame | None = None, daily: DataFrame | None = None, station_id=None, cfg: Precip = Precip()) -> tuple[DataFrame, DataFrame]:
    """Monthly record (series = site, year, month, p) from two years before start_year on, and the classes of the water
    years start_year to end_year, from gridded points ("era5": lon, lat, month, p_m) or gauges ("eccc")."""
    if source == "era5" and points is not None:
        m = gridded_monthly(points, sites).withColumnRenamed("precip_mm", "p")
    elif source == "eccc" and stations is not None and daily is not None:
        m = station_history(sites, stations, daily, station_id)
    else:
        raise ValueError("source must be 'era5' (with points) or 'eccc' (with stations and daily)")
    m = m.select(F.col("site").alias("series"), F.year("month").alias("year"), F.month("month").alias("month"), "p").where(F.col("year").between(start_year - 2, end_year))
    years = classify_years(m, cfg).join(spi_years(m, cfg), ["series", "water_year"], "left")
    return m, years.where(F.col("water_year").between(start_year, end_year))


def rolling_total(monthly: DataFrame, k: int, series: str = "series", order: str = "month", value: str = "p") -> DataFrame:
    """Sum of the last k rows, missing until there are k."""
    w = Window.partitionBy(series).orderBy(order).rowsBetween(-(k - 1), 0)
    return monthly.withColumn(f"total_{k}", F.when(F.count(value).over(w) == k, F.sum(value).over(w)))


def spi(monthly: DataFrame, k: int, series: str = "series", order: str = "month", value: str = "p") -> DataFrame:
    """Standardised precipitation index of k-row totals: (series, month, spi). A series is a few hundred rows."""
    r = rolling_total(monthly.where(F.col(value).isNotNull()), k, series, order, value).select(F.col(series).cast("string").alias("series"), F.col(order).alias("month"), F.col(f"total_{k}").cast("double").alias("total"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        z = gamma.spi(pdf["total"].to_numpy(dtype=float))
        return pd.DataFrame({"series": pdf["series"], "month": pdf["month"], "spi": pd.array(np.where(np.isnan(z), None, z), dtype="Float64")})

    return r.groupBy("series").applyInPandas(one, f"series string, month {r.schema['month'].dataType.simpleString()}, spi double")


def spi_years(monthly: DataFrame, cfg: Precip = Precip(), series: str = "series") -> DataFrame:
    """(series, year, month, p) to (series, water_year, spi12, spi24): the index of 12- and 24-month totals in the last
    month of each water year, to two places; no row where that month has no record."""
    m = monthly.where("p IS NOT NULL").select(F.col(series).cast("string").alias("series"), F.make_date("year", "month", F.lit(1)).alias("month"), F.col("p").cast("double").alias("p"))
    out = None
    for k in (12, 24):
        z = spi(m, k).where(F.month("month") == (cfg.water_year_start_month + 10) % 12 + 1)
        z = z.select("series", water_year(F.year("month"), F.month("month"), cfg.water_year_start_month).alias("water_year"), F.bround("spi", 2).alias(f"spi{k}"))
        out = z if out is None else out.join(z, ["series", "water_year"])
    return out


def water_year(year: Column, month: Column, start: int = 10) -> Column:
    return F.when(month >= start, year + 1).otherwise(year)


def wet_dry_class(pct: Column, cfg: Precip = Precip()) -> Column:
    return F.when(pct.isNull(), "no_data").when(pct <= cfg.very_dry_pct, "very_dry").when(pct <= cfg.dry_pct, "dry").when(pct >= cfg.very_wet_pct, "very_wet").when(pct >= cfg.wet_pct, "wet").otherwise("normal")


def classify_years(monthly: DataFrame, cfg: Precip = Precip(), series: str = "series") -> DataFrame:
    """(series, year, month, p) to a row for each water year: totals, share of normal, percentiles and classes.

    The normal is the complete years of the normal period, all complete ones if that has fewer than 10. The
    24-month total adds the row before; its normal adds the complete row before. Percentiles of a score count
    half of the ties; they come from the normal's sorted array of a series (tens of values), not from a join of all pairs."""
    s = F.col(series)
    m = monthly.where("p IS NOT NULL").withColumn("water_year", water_year(F.col("year"), F.col("month"), cfg.water_year_start_month))
    spring = (F.col("month") >= cfg.water_year_start_month) | (F.col("month") <= 6)
    y = m.groupBy(s, "water_year").agg(F.sum("p").alias("precip"), F.sum(F.when(spring, F.col("p"))).alias("spring"), F.count("p").alias("n_months"))
    by = Window.partitionBy(series).orderBy("water_year")
    y = y.withColumn("precip_24mo", F.col("precip") + F.lag("precip").over(by))
    full = F.col("n_months") >= 12
    # the complete year before, among complete years
    before = F.last(F.when(full, F.col("precip")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    y = y.withColumn("__full24", F.when(full, F.col("precip") + before))
    own = full & F.col("water_year").between(cfg.normal_start, cfg.normal_end)
    y = y.withColumn("__own", F.count(F.when(own, 1)).over(Window.partitionBy(series)))
    normal = F.when(F.col("__own") >= 10, own).otherwise(full)
    n = y.withColumn("__normal", normal).where("__normal").groupBy(series).agg(F.collect_list("precip").alias("__n12"), F.collect_list("__full24").alias("__n24"))
    y = y.join(n, series, "left")
    score = lambda v, a: F.when(F.size(a) > 0, 100.0 * (F.size(F.filter(a, lambda x: x < v)) + F.size(F.filter(a, lambda x: x <= v))) / (2.0 * F.size(a)))
    mean = F.aggregate("__n12", F.lit(0).cast("double"), lambda a, x: a + x) / F.nullif(F.size("__n12"), F.lit(0))
    y = y.withColumn("pct_of_normal", F.when(F.size("__n12") > 0, F.col("precip") / mean * 100.0))
    y = y.withColumn("percentile", F.when(full, score(F.col("precip"), F.col("__n12")))).withColumn("percentile_24mo", F.when(F.col("precip_24mo").isNotNull(), score(F.col("precip_24mo"), F.col("__n24"))))
    y = y.withColumn("wet_dry", wet_dry_class(F.col("percentile"), cfg)).withColumn("wet_dry_24mo", wet_dry_class(F.col("percentile_24mo"), cfg))
    r = lambda c: F.bround(c, 2).alias(c)
    return y.select(series, "water_year", "precip", "spring", "n_months", "precip_24mo", r("pct_of_normal"), r("percentile"), "wet_dry", r("percentile_24mo"), "wet_dry_24mo")


def effective_class(years: DataFrame) -> Column:
    """The 24-month class unless it is missing."""
    return F.when(F.col("wet_dry_24mo") != "no_data", F.col("wet_dry_24mo")).otherwise(F.col("wet_dry"))
