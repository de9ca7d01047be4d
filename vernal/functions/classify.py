"""Permanence and wetland class as one column expression each (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernal.config import PEAT_REGIONS, Thresholds

# Fixed values of the rules: cuts, class names and the texts of the rationale.
TEMPORARY_SPRING, MIXED_OPEN, FRINGE_OPEN, SURE_JRC, FEW_YEARS, STEEP = 0.15, 0.1, 0.75, 50.0, 8.0, 6.0
PERMANENCE = ("ephemeral", "temporary", "seasonal", "semi-permanent", "permanent")
SHALLOW = "Shallow Open Water"
MARSH = "Marsh"
FEN = "Fen (bog possible)"
SWAMP = "Swamp"
OPEN_BASIN = "permanent open water over %s of the basin"
FRINGE = "; marsh fringe likely"
OPEN_ZONE = "permanent open-water zone (%s) inside a larger emergent marsh"
TREED = "wooded, saturated all years, no seasonal flooding -> treed peatland"
WOODY = "woody cover with seasonal surface water"
SATURATED = "herbaceous, persistently saturated, little open water, low wet/dry swing -> peatland"
EMERGENT = "emergent vegetation with seasonal to semi-permanent water"
CROPPED = "mostly cropped in WorldCover: cultivated temporary wetland"
EPHEMERAL = "ephemeral/temporary depression (S&K I-II); may be a cultivated wetland"
HEAD = "S&K %s (core: spring water %s of yrs, late water %s; polygon mean spring %s, late %s)"
SWINGS = "late water wet-yrs %s vs dry-yrs %s"
FEW_NOTE = "only %s observed years"
STEEP_NOTE = "steep terrain: check for shadow/false positive"


def permanence_class(spring: Column, late: Column, thr: Thresholds) -> Column:
    zero = F.lit(0.0)
    s, w = F.coalesce(spring, zero), F.coalesce(late, zero)
    return F.when(w >= thr.permanent_late_freq, 5).when(w >= thr.semiperm_late_freq, 4).when(s >= thr.seasonal_spring_freq, 3).when(s >= TEMPORARY_SPRING, 2).otherwise(1)


def percent(x: Column) -> Column:
    """Whole percent, half to even."""
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def classify(df: DataFrame, thr: Thresholds = Thresholds()) -> DataFrame:
    """df with awcs_class, awcs_form, sk_class, permanence, confidence, rationale. Absent inputs count as missing."""
    got = set(df.columns)
    val = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), d if isinstance(d, Column) else F.lit(d)) if c in got else (d if isinstance(d, Column) else F.lit(d))
    opt = lambda c: F.col(c).cast("double") if c in got else F.lit(None).cast("double")
    region = F.lower(F.coalesce(F.col("natural_region"), F.lit("parkland"))) if "natural_region" in got else F.lit("parkland")
    spring, late, veg = val("f_spring"), val("f_late"), val("f_wetveg")
    tree, crop = val("frac_tree"), val("frac_crop")
    woody = tree + val("frac_shrub")
    spring_core, late_core = val("f_spring_p90", spring), val("f_late_p90", late)
    swing = opt("f_late_wet_yrs") - opt("f_late_dry_yrs")
    steady = swing.isNull() | (F.abs(swing) < 0.25)
    open_share = F.greatest(val("frac_permanent_water"), val("frac_water"))
    sk = permanence_class(spring_core, late_core, thr)
    damp = region.isin(*PEAT_REGIONS) & (late < 0.2) & (spring_core < 0.3) & steady
    wooded = F.when(tree > 0.4, "wooded").otherwise("shrubby")
    marsh = (sk >= 3) | (val("frac_herb_wet") >= 0.3) | (veg >= 0.3)
    is_woody = woody >= thr.woody_frac_swamp
    # first match decides: (condition, class, form, confidence, notes)
    rules = [
        ((sk == 5) & (open_share >= thr.open_water_frac_sow), SHALLOW, F.lit("open water"), F.when(val("jrc_occurrence") >= SURE_JRC, "high").otherwise("medium"),
         [F.concat(F.format_string(OPEN_BASIN, percent(open_share)), F.when(open_share < FRINGE_OPEN, FRINGE).otherwise(""))]),
        ((sk == 5) & (open_share > MIXED_OPEN) & ~is_woody, MARSH, F.lit("graminoid"), F.lit("medium"),
         [F.format_string(OPEN_ZONE, percent(open_share))]),
        (is_woody & damp & (veg >= 0.5), FEN, wooded, F.lit("low"), [F.lit(TREED)]),
        (is_woody, SWAMP, wooded, F.lit("medium"), [F.lit(WOODY)]),
        (damp & (veg >= 0.6) & (crop < 0.2), FEN, F.lit("graminoid"), F.lit("low"), [F.lit(SATURATED)]),
        (marsh, MARSH, F.lit("graminoid"), F.when(crop >= 0.5, "low").otherwise("medium"),
         [F.lit(EMERGENT), F.when(crop >= 0.5, CROPPED)]),
        (F.lit(True), MARSH, F.lit("graminoid"), F.lit("low"), [F.lit(EPHEMERAL)]),
    ]

    def chosen(part) -> Column:
        out = None
        for cond, *rest in rules:
            out = F.when(cond, part(rest)) if out is None else out.when(cond, part(rest))
        return out

    few, steep = val("n_obs_years") < FEW_YEARS, val("slope_deg") > STEEP
    head = F.format_string(HEAD, sk.cast("string"), *map(percent, (spring_core, late_core, spring, late)))
    swings = F.when(swing.isNotNull(), F.format_string(SWINGS, percent(opt("f_late_wet_yrs")), percent(opt("f_late_dry_yrs"))))
    notes = F.concat_ws("; ", head, swings, chosen(lambda r: F.concat_ws("; ", *r[3])), F.when(few, F.format_string(FEW_NOTE, F.bround(val("n_obs_years"), 0).cast("int").cast("string"))), F.when(steep, STEEP_NOTE))
    return df.withColumns({
        "awcs_class": chosen(lambda r: F.lit(r[0])),
        "awcs_form": chosen(lambda r: r[1]),
        "sk_class": sk,
        "permanence": F.element_at(F.array(*map(F.lit, PERMANENCE)), sk),
        "confidence": F.when(few | steep, "low").otherwise(chosen(lambda r: r[2])),
        "rationale": notes,
    })


def summary(wetlands: DataFrame) -> DataFrame:
    """Number and area by location and class."""
    return wetlands.groupBy("location", "awcs_class").agg(F.count("*").alias("n"), F.bround(F.sum("area_ha"), 2).alias("area_ha"))
