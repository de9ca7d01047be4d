"""Water and wet-vegetation masks of pixels and years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernal.config import Thresholds
from vernal.functions.raster import flag, steps
from vernal.operators.focal import box_sums, dilate

KEY = ["site", "year", "row", "col"]


def water_flags(comp: DataFrame, thr: Thresholds = Thresholds()) -> DataFrame:
    """Composite (stored steps, NULL for missing) with is_mss, obs_spr, obs_late, w_spr, w_late."""
    old = F.col("year") <= thr.mss_last_year
    least = F.when(old, steps(thr.ndwi_water_mss)).otherwise(steps(thr.mndwi_water))
    spr, late = flag((F.col("n_spr") > 0) & F.col("wi_spr").isNotNull()), flag((F.col("n_late") > 0) & F.col("wi_late").isNotNull())
    return comp.withColumns({"is_mss": old, "obs_spr": spr, "obs_late": late, "w_spr": spr & flag(F.col("wi_spr") > least), "w_late": late & flag(F.col("wi_late") > least)})


def vegetation_flags(flags: DataFrame, grid: DataFrame, static: DataFrame | None, pixel: float, thr: Thresholds = Thresholds()) -> DataFrame:
    """flags with veg (wetter than its surroundings) and moist (the absolute test), before the landscape test.

    Years without short-wave infrared have neither and are left out of the windows. NDMI is taken in whole
    steps so that the comparison with the local mean is exact. flags is read twice: it should be a table, or
    cheap to compute from one."""
    r = thr.radius_px(thr.wetveg_window_m, pixel)
    late = flags.where(~F.col("is_mss")).withColumn("__step", F.round("ndmi").cast("long"))
    late = late.join(grid.select("site", "n_rows", "n_cols"), "site").select(*flags.columns, "__step", "n_rows", "n_cols")
    box = box_sums(late, "__step", r, ["site", "year"]).drop("__step", "n_rows", "n_cols")
    f = flags.where("is_mss").unionByName(box, allowMissingColumns=True)
    dry = F.col("obs_late") & ~F.col("w_late") & ~F.col("is_mss") & flag(F.col("ndvi") > steps(thr.ndvi_veg_min))
    n = F.round(F.col("ndmi")).cast("long")
    anomaly = flag(n * F.col("box_n") - F.col("box_sum") > F.lit(steps(thr.ndmi_anomaly)) * F.col("box_n"))
    if static is not None:
        excluded = F.lit(False)
        if "worldcover" in static.columns:
            excluded = excluded | flag(F.col("worldcover").isin(40, 50))
        if "slope_deg" in static.columns:
            excluded = excluded | flag(F.col("slope_deg") > thr.max_slope_deg)
        bad = static.where(excluded).select("site", "row", "col", F.lit(True).alias("__bad"))
        f = f.join(bad, ["site", "row", "col"], "left")
        dry = dry & F.col("__bad").isNull()
    f = f.withColumns({"veg": dry & anomaly & flag(F.col("ndmi") > steps(thr.ndmi_wet)), "moist": dry & flag(F.col("ndmi") > steps(thr.ndmi_peat))})
    return f.drop("__bad", "box_sum", "box_n")


def support(flags: DataFrame, static: DataFrame | None, grid: DataFrame, pixel: float, peat: bool | Column = False, thr: Thresholds = Thresholds()) -> DataFrame:
    """(site, row, col) where wet vegetation may stand: persistent over all observed late years and near water
    (ever seen, mapped as water or herbaceous wetland, or with recorded occurrence), or persistent moisture
    under peat cover where the region is of that kind (peat: of all sites, or a column of flags)."""
    key = ["site", "row", "col"]
    of_peat = F.lit(peat) if isinstance(peat, bool) else peat
    p = flags.groupBy(*key).agg(F.count_if("obs_late").alias("n"), F.count_if("veg").alias("v"), F.count_if("moist").alias("m"), F.max(F.col("w_spr") | F.col("w_late")).alias("water"), F.max(of_peat).alias("peat"))
    s = static.select(*key, *[c for c in ("worldcover", "jrc_occurrence") if c in static.columns]) if static is not None else None
    wet = p.where("water").select(*key)
    if s is not None:
        mapped = F.lit(False)
        if "worldcover" in s.columns:
            mapped = mapped | flag(F.col("worldcover").isin(80, 90))
        if "jrc_occurrence" in s.columns:
            mapped = mapped | flag(F.col("jrc_occurrence") > 0)
        wet = wet.unionByName(s.where(mapped).select(*key)).distinct()
    near = dilate(wet, ["site"], thr.radius_px(thr.water_proximity_m, pixel), grid).withColumn("near", F.lit(True))
    p = p.join(near, key, "left")
    least = thr.wetveg_min_persistence
    keep = flag(F.col("v") >= least * F.col("n")) & (F.col("n") > 0) & F.col("near").isNotNull()
    if peat is not False and s is not None and "worldcover" in s.columns:
        p = p.join(s.select(*key, "worldcover"), key, "left")
        keep = keep | (flag(F.col("peat")) & flag(F.col("m") >= least * F.col("n")) & (F.col("n") > 0) & flag(F.col("worldcover").isin(10, 20, 90)))
    return p.where(keep).select(*key)


def final_masks(flags: DataFrame, supported: DataFrame, peat: bool | Column = False) -> DataFrame:
    """flags with veg after the landscape test, obs and wet."""
    f = flags.join(supported.withColumn("__keep", F.lit(True)), ["site", "row", "col"], "left")
    of_peat = F.lit(peat) if isinstance(peat, bool) else flag(peat)
    veg = (F.col("veg") | (F.col("moist") & of_peat)) & F.col("__keep").isNotNull()
    f = f.withColumn("veg", veg).drop("__keep")
    # without short-wave infrared veg is never set, so a switch for those years would change nothing
    return f.withColumns({"obs": F.col("obs_spr") | F.col("obs_late"), "wet": F.col("w_spr") | F.col("w_late") | F.col("veg")})
