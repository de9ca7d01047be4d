"""Registered queries and the SQL that DuckDB is to agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vernal.functions import classify, geo, raster
from vernal.operators import extent, focal, imagery, masks, outline, precip
from vernal.operators.components import components
from vernal.plans import bindings as B
from vernal.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = B.text(sql, "duck")
        return f

    return add


def px(df: DataFrame, *columns) -> DataFrame:
    return df.withColumnsRenamed({"row": "px_row", "col": "px_col"}).select("px_row", "px_col", *columns)


def i(*names: str) -> list:
    return [F.col(n).cast("int").alias(n) for n in names]


# --- chains of CTEs for DuckDB ------------------------------------------------------------------------------
OBS = f"obs AS ({B.OBS})"
COMP = OBS + """, comp AS (SELECT y, r, c, quantile_cont(wi, 0.75) FILTER (spring) AS wi_spr, quantile_cont(wi, 0.5) FILTER (NOT spring) AS wi_late,
 quantile_cont(ndmi, 0.5) FILTER (NOT spring) AS ndmi, quantile_cont(ndvi, 0.5) FILTER (NOT spring) AS ndvi,
 count(*) FILTER (spring) AS n_spr, count(*) FILTER (NOT spring) AS n_late FROM obs GROUP BY y, r, c)"""
FLAGS = COMP + """, flags AS (SELECT *, y <= 1983 AS is_mss, n_spr > 0 AS obs_spr, n_late > 0 AS obs_late,
 coalesce(wi_spr > CASE WHEN y <= 1983 THEN 1000 ELSE 0 END, false) AS w_spr, coalesce(wi_late > CASE WHEN y <= 1983 THEN 1000 ELSE 0 END, false) AS w_late FROM comp)"""
BOX = FLAGS + """, late AS (SELECT y, r, c, CAST(round(ndmi) AS BIGINT) AS v FROM flags WHERE NOT is_mss AND ndmi IS NOT NULL),
 off AS (SELECT a.range AS dr, b.range AS dc FROM range(-5, 6) a, range(-5, 6) b),
 pix AS (SELECT a.range AS r, b.range AS c FROM range(0, 20) a, range(0, 20) b),
 near AS (SELECT p.r, p.c, greatest(0, least(19, p.r + dr)) AS r2, greatest(0, least(19, p.c + dc)) AS c2 FROM pix p, off),
 box AS (SELECT l.y, n.r, n.c, CAST(sum(l.v) AS BIGINT) AS box_sum, count(*) AS box_n FROM near n JOIN late l ON l.r = n.r2 AND l.c = n.c2 GROUP BY ALL)"""
VEG = BOX + f""", static AS ({B.STATIC}),
 veg0 AS (SELECT f.*, coalesce(f.obs_late AND NOT f.w_late AND NOT f.is_mss AND f.ndvi > 3000 AND NOT coalesce(s.worldcover IN (40, 50) OR s.slope_deg > 5, false), false) AS dry,
  CAST(round(f.ndmi) AS BIGINT) AS q, b.box_sum, b.box_n FROM flags f LEFT JOIN box b USING (y, r, c) LEFT JOIN static s USING (r, c)),
 veg1 AS (SELECT *, coalesce(dry AND ndmi > 3000 AND q * box_n - box_sum > 1200 * box_n, false) AS veg, coalesce(dry AND ndmi > 3500, false) AS moist FROM veg0)"""
FINAL = VEG + """, per AS (SELECT r, c, count(*) FILTER (obs_late) AS n, count(*) FILTER (veg) AS v, bool_or(w_spr OR w_late) AS water FROM veg1 GROUP BY r, c),
 seed AS (SELECT r, c FROM per WHERE water UNION SELECT r, c FROM static WHERE worldcover IN (80, 90) OR jrc_occurrence > 0),
 keep AS (SELECT p.r, p.c FROM per p WHERE n > 0 AND v >= 0.5 * n AND EXISTS (SELECT 1 FROM seed s WHERE abs(s.r - p.r) <= 2 AND abs(s.c - p.c) <= 2)),
 m0 AS (SELECT v.* EXCLUDE (veg), v.veg AND k.r IS NOT NULL AS veg, obs_spr OR obs_late AS obs FROM veg1 v LEFT JOIN keep k USING (r, c)),
 masks AS (SELECT *, w_spr OR w_late OR veg AS wet FROM m0)"""
YEARS = f"""m AS (SELECT *, CASE WHEN month >= 10 THEN year + 1 ELSE year END AS wy FROM mon),
 y0 AS (SELECT series, wy, sum(p) AS precip, sum(p) FILTER (month >= 10 OR month <= 6) AS spring, count(*) AS n_months FROM m GROUP BY series, wy),
 y1 AS (SELECT *, precip + lag(precip) OVER (PARTITION BY series ORDER BY wy) AS precip_24mo FROM y0),
 cmp AS (SELECT series, wy, precip, precip + lag(precip) OVER (PARTITION BY series ORDER BY wy) AS full24 FROM y0 WHERE n_months >= 12),
 nrm AS (SELECT * FROM cmp c WHERE CASE WHEN (SELECT count(*) FROM cmp d WHERE d.series = c.series AND d.wy BETWEEN 1991 AND 2020) >= 10 THEN wy BETWEEN 1991 AND 2020 ELSE true END),
 sc AS (SELECT y.series, y.wy, avg(n.precip) AS mean, count(n.precip) AS k, count(*) FILTER (n.precip < y.precip) + count(*) FILTER (n.precip <= y.precip) AS s12,
  count(n.full24) AS k24, count(*) FILTER (n.full24 < y.precip_24mo) + count(*) FILTER (n.full24 <= y.precip_24mo) AS s24 FROM y1 y LEFT JOIN nrm n USING (series) GROUP BY y.series, y.wy),
 wy AS (SELECT y.*, CASE WHEN k > 0 THEN precip / mean * 100 END AS pct, CASE WHEN n_months >= 12 AND k > 0 THEN 100.0 * s12 / (2.0 * k) END AS p12, CASE WHEN precip_24mo IS NOT NULL AND k24 > 0 THEN 100.0 * s24 / (2.0 * k24) END AS p24 FROM y1 y JOIN sc USING (series, wy)),
 cls AS (SELECT *, {{0}} AS wet_dry, {{1}} AS wet_dry_24mo FROM wy)""".replace("{0}", "CASE WHEN p12 IS NULL THEN 'no_data' WHEN p12 <= 10 THEN 'very_dry' WHEN p12 <= 20 THEN 'dry' WHEN p12 >= 90 THEN 'very_wet' WHEN p12 >= 80 THEN 'wet' ELSE 'normal' END").replace("{1}", "CASE WHEN p24 IS NULL THEN 'no_data' WHEN p24 <= 10 THEN 'very_dry' WHEN p24 <= 20 THEN 'dry' WHEN p24 >= 90 THEN 'very_wet' WHEN p24 >= 80 THEN 'wet' ELSE 'normal' END")
MON = f"mon AS (SELECT 'demo' AS series, * FROM ({B.MONTHLY}) t), "
CLASSED = FINAL + ", " + MON + YEARS + """, mc AS (SELECT x.*, coalesce(CASE WHEN wet_dry_24mo <> 'no_data' THEN wet_dry_24mo ELSE wet_dry END, 'no_data') AS cls FROM masks x LEFT JOIN cls ON x.y = cls.wy)"""
RAW = CLASSED + """, raw AS (SELECT 'all' AS subset, r, c FROM mc WHERE wet GROUP BY r, c HAVING count(*) >= 2
 UNION ALL SELECT 'wet', r, c FROM mc WHERE wet AND cls IN ('wet', 'very_wet') GROUP BY r, c HAVING count(*) >= 2
 UNION ALL SELECT 'dry', r, c FROM mc WHERE wet AND cls IN ('dry', 'very_dry') GROUP BY r, c HAVING count(*) >= 2)"""
CLEAN = RAW + """, sub AS (SELECT DISTINCT subset FROM raw), bg AS (SELECT s.subset, p.r, p.c FROM sub s, pix p EXCEPT SELECT subset, r, c FROM raw),
 walk AS (SELECT subset, r AS r0, c AS c0, r, c FROM bg UNION SELECT w.subset, w.r0, w.c0, b.r, b.c FROM walk w JOIN bg b ON b.subset = w.subset AND abs(b.r - w.r) <= 1 AND abs(b.c - w.c) <= 1),
 filled AS (SELECT subset, r, c FROM raw UNION SELECT subset, r0, c0 FROM walk GROUP BY subset, r0, c0 HAVING count(*) < 5),
 e1 AS (SELECT a.subset, a.r, a.c FROM filled a JOIN filled b ON a.subset = b.subset AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 9),
 d1 AS (SELECT DISTINCT e.subset, p.r, p.c FROM e1 e JOIN pix p ON abs(e.r - p.r) <= 1 AND abs(e.c - p.c) <= 1),
 d2 AS (SELECT DISTINCT e.subset, p.r, p.c FROM d1 e JOIN pix p ON abs(e.r - p.r) <= 1 AND abs(e.c - p.c) <= 1),
 ext AS (SELECT a.subset, a.r, a.c FROM d2 a JOIN d2 b ON a.subset = b.subset AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 9)"""
LABEL = CLEAN + """, walk2 AS (SELECT subset, r AS r0, c AS c0, r, c FROM ext UNION SELECT w.subset, w.r0, w.c0, b.r, b.c FROM walk2 w JOIN ext b ON b.subset = w.subset AND abs(b.r - w.r) <= 1 AND abs(b.c - w.c) <= 1),
 lab AS (SELECT subset, r0 AS r, c0 AS c, min(r * 1000 + c) AS label FROM walk2 GROUP BY ALL)"""
FREQ = """, f AS (SELECT r, c, count(*) FILTER (obs) AS n_obs_years, count(*) FILTER (wet) AS n_wet_years, count(*) FILTER (wet) / nullif(count(*) FILTER (obs), 0) AS f_wet,
 count(*) FILTER (w_spr) / nullif(count(*) FILTER (obs_spr), 0) AS f_spring, count(*) FILTER (w_late) / nullif(count(*) FILTER (obs_late), 0) AS f_late, count(*) FILTER (veg) / nullif(count(*) FILTER (obs_late), 0) AS f_wetveg""" + "".join(
    f", count(*) FILTER ({n} AND {own}) / nullif(count(*) FILTER ({d} AND {own}), 0) AS {name}_{k}_yrs" for k, own in (("wet", "cls IN ('wet', 'very_wet')"), ("dry", "cls IN ('dry', 'very_dry')"), ("normal", "cls = 'normal'")) for name, n, d in (("f_late", "w_late", "obs_late"), ("f_spring", "w_spr", "obs_spr"), ("f_wet", "wet", "obs"))
) + " FROM mc GROUP BY r, c)"
FREQ_COLUMNS = ["f_wet", "f_spring", "f_late", "f_wetveg", *[f"{n}_{k}_yrs" for k in ("wet", "dry", "normal") for n in ("f_late", "f_spring", "f_wet")]]


# --- the same stages as operators -----------------------------------------------------------------------------
def _flags(s, d):
    return masks.water_flags(imagery.composite(B.observations(s, d)), B.THR)


def _veg(s, d):
    """The composite and the flags are read by several stages: each is computed once."""
    comp = written(imagery.composite(B.observations(s, d)), "composite")
    return written(masks.vegetation_flags(masks.water_flags(comp, B.THR), B.grid(s), B.static(s, d), B.PIXEL, B.THR), "flags")


def _monthly(s, d):
    return B.view(s, d, B.MONTHLY, "orders").withColumn("series", F.lit("demo"))


def _years(s, d):
    return precip.classify_years(_monthly(s, d))


def _masks(s, d, peat: bool = False):
    f = _veg(s, d)
    out = masks.final_masks(f, masks.support(f, B.static(s, d), B.grid(s), B.PIXEL, peat, B.THR), peat)
    y = _years(s, d)
    return written(extent.with_class(out, y.select(F.col("series").alias("site"), F.col("water_year").alias("year"), precip.effective_class(y).alias("cls"))), "masks")


def _extents(s, d):
    return _cleaned(s, _masks(s, d))


def _cleaned(s, m):
    return written(extent.clean(extent.raw_extents(m, B.THR), B.grid(s), B.PIXEL, B.THR), "extents")


#: Project area and rings of the demo site, in metres east and south of the grid's corner (rectangles).
PROJECT = (60.0, -200.0, 160.0, -60.0)
RINGS = (("400m Consultation", (20.0, -260.0, 240.0, -20.0)), ("800 m Notification", (0.0, -300.0, 320.0, 0.0)))


def _rectangle(w, s, e, n):
    return geo.ring_edges([(w, s), (e, s), (e, n), (w, n)])


def _site(s):
    rings = F.array(*[F.struct(F.lit(k).alias("name"), _rectangle(*v).alias("edges")) for k, v in RINGS])
    return s.range(1).select(F.lit("demo").alias("site"), F.lit("DEM").alias("prefix"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), _rectangle(*PROJECT).alias("project"), rings.alias("rings"))


def _wetlands(s, d):
    m = _masks(s, d)
    e = _cleaned(s, m)
    objects = components(e.where("subset = 'all'").drop("subset"), ["site"])
    w = extent.locate(objects, _site(s), B.PIXEL)
    z = extent.zonal(objects, extent.frequencies(m), B.static(s, d), e, B.THR)
    w = w.join(z, ["site", "label"]).withColumn("natural_region", F.lit("parkland"))
    return classify.classify(w, B.THR), e


# --- queries ------------------------------------------------------------------------------------------------
@query(f"WITH {COMP} SELECT y AS year, r AS px_row, c AS px_col, wi_spr, wi_late, ndmi, ndvi, n_spr, n_late FROM comp")
def composite_yearly(s, d):
    return px(imagery.composite(B.observations(s, d)), "year", "wi_spr", "wi_late", "ndmi", "ndvi", "n_spr", "n_late")


@query(f"WITH {FLAGS} SELECT y AS year, r AS px_row, c AS px_col, CAST(obs_spr AS INT) AS obs_spr, CAST(obs_late AS INT) AS obs_late, CAST(w_spr AS INT) AS w_spr, CAST(w_late AS INT) AS w_late, CAST(is_mss AS INT) AS is_mss FROM flags")
def water_masks(s, d):
    return px(_flags(s, d), "year", *i("obs_spr", "obs_late", "w_spr", "w_late", "is_mss"))


@query(f"WITH {BOX} SELECT b.y AS year, CAST(b.r AS INT) AS px_row, CAST(b.c AS INT) AS px_col, box_sum, box_n FROM box b")
def box_mean(s, d):
    late = _flags(s, d).where("NOT is_mss").select("site", "year", "row", "col", F.round("ndmi").cast("long").alias("ndmi"))
    dense = focal.densify(late, B.grid(s), ["site", "year"], late.where("ndmi IS NOT NULL").select("site", "year").distinct())
    return px(focal.box_sums(dense, "ndmi", B.THR.radius_px(B.THR.wetveg_window_m, B.PIXEL), ["site", "year"]).where("box_n > 0"), "year", "box_sum", "box_n")


@query(f"WITH {VEG} SELECT y AS year, r AS px_row, c AS px_col, CAST(veg AS INT) AS veg, CAST(moist AS INT) AS moist FROM veg1")
def wet_vegetation(s, d):
    return px(_veg(s, d), "year", *i("veg", "moist"))


@query(f"WITH {FINAL} SELECT CAST(r AS INT) AS px_row, CAST(c AS INT) AS px_col FROM keep")
def support_mask(s, d):
    return px(masks.support(_veg(s, d), B.static(s, d), B.grid(s), B.PIXEL, False, B.THR))


@query(f"""WITH {FINAL}, pk AS (SELECT v.r, v.c FROM veg1 v JOIN static USING (r, c) WHERE worldcover IN (10, 20, 90) GROUP BY v.r, v.c HAVING count(*) FILTER (obs_late) > 0 AND count(*) FILTER (moist) >= 0.5 * count(*) FILTER (obs_late)),
 k2 AS (SELECT r, c FROM keep UNION SELECT r, c FROM pk) SELECT y AS year, count(*) FILTER ((veg OR moist) AND k2.r IS NOT NULL) AS n_veg, count(*) FILTER (w_spr OR w_late OR ((veg OR moist) AND k2.r IS NOT NULL)) AS n_wet FROM veg1 LEFT JOIN k2 USING (r, c) GROUP BY y""")
def peat_exception(s, d):
    f = _veg(s, d)
    m = masks.final_masks(f, masks.support(f, B.static(s, d), B.grid(s), B.PIXEL, True, B.THR), True)
    return m.groupBy("year").agg(F.count_if("veg").alias("n_veg"), F.count_if("wet").alias("n_wet"))


@query(f"WITH {CLASSED}{FREQ} SELECT r AS px_row, c AS px_col, n_obs_years, n_wet_years, " + ", ".join(f"round(CAST({c} AS DOUBLE), 9) AS {c}" for c in FREQ_COLUMNS) + " FROM f")
def frequency_layers(s, d):
    return px(extent.frequencies(_masks(s, d)), "n_obs_years", "n_wet_years", *[F.round(c, 9).alias(c) for c in FREQ_COLUMNS])


@query(f"WITH RECURSIVE {CLEAN} SELECT subset, CAST(r AS INT) AS px_row, CAST(c AS INT) AS px_col FROM ext")
def greatest_extent(s, d):
    return px(_extents(s, d), "subset")


@query(f"WITH RECURSIVE {LABEL} SELECT subset, n_px, count(*) AS n_objects FROM (SELECT subset, label, count(*) AS n_px FROM lab GROUP BY ALL) t GROUP BY ALL")
def component_sizes(s, d):
    n = components(_extents(s, d), ["site", "subset"]).groupBy("subset", "label").agg(F.count("*").alias("n_px"))
    return n.groupBy("subset", "n_px").agg(F.count("*").alias("n_objects"))


@query(f"WITH RECURSIVE {CLEAN} SELECT subset, count(*) * 0.04 AS extent_ha FROM ext GROUP BY subset".replace("count(*) * 0.04", "round(count(*) * CAST(0.04 AS DOUBLE), 6)"))
def extent_totals(s, d):
    return extent.totals(_extents(s, d), B.PIXEL).select("subset", F.round("extent_ha", 6).alias("extent_ha"))


_HA = "CAST(round_even({} * CAST(0.04 AS DOUBLE), 2) AS DOUBLE)"


@query(f"""WITH RECURSIVE {CLEAN}, g AS (SELECT y, count(*) FILTER (obs) AS a, count(*) FILTER (w_spr) AS b, count(*) FILTER (w_late) AS cc, count(*) FILTER (veg) AS v, count(*) FILTER (wet) AS w FROM mc JOIN ext e ON e.subset = 'all' AND e.r = mc.r AND e.c = mc.c GROUP BY y),
 sp AS (SELECT DISTINCT y, is_mss FROM mc), k AS (SELECT count(*) AS n FROM ext WHERE subset = 'all') SELECT sp.y AS year, CASE WHEN is_mss THEN 'MSS' ELSE 'Landsat/S2' END AS sensor, {_HA.format('coalesce(a, 0)')} AS observed_ha, {_HA.format('coalesce(b, 0)')} AS spring_water_ha,
 {_HA.format('coalesce(cc, 0)')} AS late_water_ha, {_HA.format('coalesce(v, 0)')} AS wet_veg_ha, {_HA.format('coalesce(w, 0)')} AS wet_total_ha, round_even(100.0 * coalesce(a, 0) / greatest(n, 1), 2) AS coverage_pct, wet_dry FROM sp LEFT JOIN g USING (y) CROSS JOIN k LEFT JOIN cls ON cls.wy = sp.y""")
def extent_by_year(s, d):
    m = _masks(s, d)
    e = _cleaned(s, m).where("subset = 'all'")
    return extent.extent_by_year(m, e, B.PIXEL, _years(s, d).select(F.col("series").alias("site"), F.col("water_year").alias("year"), "wet_dry")).drop("site")


_YEAR_COLUMNS = "CAST(wy AS INT) AS water_year, CAST(precip AS BIGINT) AS precip, CAST(spring AS BIGINT) AS spring, n_months, CAST(precip_24mo AS BIGINT) AS precip_24mo, round_even(pct, 2) AS pct_of_normal, round_even(p12, 2) AS percentile, wet_dry, round_even(p24, 2) AS percentile_24mo, wet_dry_24mo FROM cls"


@query(f"WITH {MON}{YEARS} SELECT {_YEAR_COLUMNS}")
def water_years(s, d):
    return _years(s, d).drop("series")


@query(f"WITH mon AS ({B.MONTHLY_NATION}), {YEARS} SELECT series, {_YEAR_COLUMNS}")
def water_years_by_nation(s, d):
    return precip.classify_years(B.view(s, d, B.MONTHLY_NATION, "orders", "customer", "nation"))


@query(f"WITH {MON}{YEARS} SELECT CAST(wy AS INT) AS water_year, CASE WHEN wet_dry_24mo <> 'no_data' THEN wet_dry_24mo ELSE wet_dry END AS cls FROM cls WHERE wy BETWEEN 1980 AND 2010")
def effective_class(s, d):
    y = _years(s, d)
    return y.select("water_year", precip.effective_class(y).alias("cls")).where("water_year BETWEEN 1980 AND 2010")


@query(f"WITH mon AS ({B.MONTHLY}) SELECT year, month, CASE WHEN count(p) OVER w12 = 12 THEN CAST(sum(p) OVER w12 AS BIGINT) END AS total_12, CASE WHEN count(p) OVER w24 = 24 THEN CAST(sum(p) OVER w24 AS BIGINT) END AS total_24 FROM mon WINDOW w12 AS (ORDER BY year, month ROWS 11 PRECEDING), w24 AS (ORDER BY year, month ROWS 23 PRECEDING)")
def rolling_totals(s, d):
    m = _monthly(s, d).withColumn("at", F.make_date("year", "month", F.lit(1)))
    return precip.rolling_total(precip.rolling_total(m, 12, order="at"), 24, order="at").select("year", "month", "total_12", "total_24")


@query()
def spi_12(s, d):
    m = _monthly(s, d).withColumn("at", F.make_date("year", "month", F.lit(1)))
    return precip.spi(m, 12, order="at").select("month", F.round("spi", 6).alias("spi"))


@query(f"WITH daily AS ({B.DAILY}) SELECT station, CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(p) AS BIGINT) AS p, count(DISTINCT day) AS n_days FROM daily GROUP BY 1, 2 HAVING count(DISTINCT day) >= 25")
def station_monthly(s, d):
    return precip.station_monthly(B.view(s, d, B.DAILY, "orders", "customer", "nation", "region"))


@query(f"WITH daily AS ({B.DAILY}), mo AS (SELECT station, CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(p) AS BIGINT) AS p FROM daily GROUP BY 1, 2 HAVING count(DISTINCT day) >= 25) SELECT month, station, p FROM mo QUALIFY row_number() OVER (PARTITION BY month ORDER BY station) = 1")
def station_gap_fill(s, d):
    m = precip.station_monthly(B.view(s, d, B.DAILY, "orders", "customer", "nation", "region"))
    return precip.combine_stations(m, F.col("station"))


_KM = "111.0 * sqrt(power(({0}.lon - {1}.lon) * cos(radians({1}.lat)), 2) + power({0}.lat - {1}.lat, 2))"


@query(f"WITH t AS ({B.STATIONS}), s AS ({B.SITES}), j AS (SELECT s.site, t.station_id, round({_KM.format('t', 's')}, 1) AS dist_km FROM s, t WHERE abs(t.lon - s.lon) <= 75 / 111.0 AND abs(t.lat - s.lat) <= 75 / 111.0), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY dist_km, station_id) AS place FROM j) SELECT site, station_id, dist_km, place FROM k WHERE place <= 5")
def nearest_stations(s, d):
    return precip.nearest_stations(B.view(s, d, B.SITES, "nation"), B.view(s, d, B.STATIONS, "supplier"))


@query(f"WITH t AS ({B.STATIONS}), s AS ({B.SITES}), p AS (SELECT *, CAST(1 + station_id % 12 AS INT) AS month, CAST(station_id % 97 AS DOUBLE) / 1024 AS p_m FROM t) SELECT s.site, p.month, round(avg(p.p_m) * 1000, 6) AS precip_mm FROM s, p WHERE {_KM.format('p', 's')} <= 60 GROUP BY 1, 2")
def gridded_precip(s, d):
    p = B.view(s, d, B.STATIONS, "supplier").withColumns({"month": (1 + F.col("station_id") % 12).cast("int"), "p_m": (F.col("station_id") % 97).cast("double") / 1024})
    return precip.gridded_monthly(p, B.view(s, d, B.SITES, "nation"), 60.0).withColumn("precip_mm", F.round("precip_mm", 6))


_SITE_SLUG = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\s*impact zones\s*$', '', 'i'), '\(site\s*(\d+)\)', 'Site\1', 'ig'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"WITH n AS ({B.NAMES}), k AS (SELECT id, {_SITE_SLUG} AS site_slug, regexp_replace(regexp_replace(raw, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS base, CAST(regexp_matches(raw, '^\\s*\\d+\\s*(m|km)\\b', 'i') AS INT) AS is_ring FROM n), u AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM k) SELECT id, site_slug, CASE WHEN n > 1 THEN base || '_' || n ELSE base END AS slug, is_ring FROM u")
def slugs(s, d):
    n = B.view(s, d, B.NAMES, "part")
    n = n.select("id", geo.site_slug(F.col("raw")).alias("site_slug"), geo.name_slug(F.col("raw")).alias("slug"), geo.is_ring(F.col("raw")).cast("int").alias("is_ring"))
    return geo.unique_slugs(n, "slug", "id")


@query(f"WITH t AS ({B.TILES}) SELECT id, array_to_string(list_transform(range(z, 0, -1), lambda k: CAST(((x >> CAST(k - 1 AS INT)) & 1) + 2 * ((y >> CAST(k - 1 AS INT)) & 1) AS VARCHAR)), '') AS quadkey, CAST(CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + floor((lon + 180) / 6) + 1 AS INT) AS epsg, CASE WHEN lat < 52.3 THEN 'grassland' WHEN lat < 54.3 THEN 'parkland' ELSE 'boreal' END AS region, CAST(coalesce((SELECT min(zz.range) FROM range(10, 21) zz WHERE 156543.03 * cos(radians(lat)) / power(2, zz.range) <= 2.0), 20) AS INT) AS zoom, round(degrees(atan(sinh(pi() * (1 - 2 * (x % 1024 + 0.5) / 1024)))), 7) AS centre_lat FROM t")
def tile_expressions(s, d):
    t = B.view(s, d, B.TILES, "customer")
    c = F.col
    return t.select("id", geo.quadkey(c("x"), c("y"), c("z")).alias("quadkey"), geo.utm_epsg(c("lon"), c("lat")).alias("epsg"), geo.natural_region(c("lat")).alias("region"), geo.zoom_for(c("lat"), F.lit(2.0)).cast("int").alias("zoom"), F.round(geo.tile_centre_lat(c("x") % 1024, F.lit(10)), 7).alias("centre_lat"))


_TX, _TY = "CAST(floor(({0} + 180) / 360 * 1024) AS INT)", "CAST(floor((1 - asinh(tan(radians({0}))) / pi()) / 2 * 1024) AS INT)"


@query(f"WITH s AS ({B.SITES}), b AS (SELECT site, {_TX.format('(lon - 0.3)')} AS x0, {_TX.format('(lon + 0.3)')} AS x1, {_TY.format('(lat + 0.2)')} AS y0, {_TY.format('(lat - 0.2)')} AS y1 FROM s) SELECT site, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT site, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM b) t, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) u")
def tile_cover(s, d):
    b = B.view(s, d, B.SITES, "nation")
    b = b.select("site", F.lit(10).alias("z"), (F.col("lon") - 0.3).alias("west"), (F.col("lon") + 0.3).alias("east"), (F.col("lat") - 0.2).alias("south"), (F.col("lat") + 0.2).alias("north"))
    return geo.tile_cover(b).select("site", "x", "y")


@query(f"WITH n AS ({B.TILES}) SELECT id, count(*) AS n_points, round(sum(CAST(p[1] AS DOUBLE)), 6) AS sum_x FROM (SELECT id, unnest([[lon, lat], [lon + 1, lat]]) AS p FROM n) t GROUP BY id")
def kml_coordinates(s, d):
    text = F.concat_ws(" ", F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"), F.lit("12.5")), F.lit("7"), F.concat(F.lit("\n"), F.concat_ws(",", (F.col("lon") + 1).cast("string"), F.col("lat").cast("string"))))
    t = B.view(s, d, B.TILES, "customer").select("id", F.explode(geo.coordinates(text)).alias("p"))
    return t.groupBy("id").agg(F.count("*").alias("n_points"), F.round(F.sum("p.x"), 6).alias("sum_x"))


_CHAIN = {"f": "CASE WHEN f_late >= 0.9 THEN 5 WHEN f_late >= 0.5 THEN 4 WHEN f_spring >= 0.5 THEN 3 WHEN f_spring >= 0.15 THEN 2 ELSE 1 END"}
_PC = "CAST(CAST(round_even(100 * {}, 0) AS INT) AS VARCHAR) || '%'"


def _said(template: str, *values: str) -> str:
    """A text of the rationale with SQL values in its places."""
    first, *rest = template.split("%s")
    return f"'{first}'" + "".join(f" || {v} || '{t}'" for v, t in zip(values, rest, strict=True))


CLASS_SQL = f"""ci AS ({B.CLASS_INPUTS}), c0 AS (SELECT *, {_CHAIN['f']} AS sk, frac_tree + frac_shrub AS woody, f_late_wet_yrs - f_late_dry_yrs AS swing, greatest(0, frac_water) AS op, lower(coalesce(natural_region, 'parkland')) IN ('boreal', 'foothills', 'canadian_shield', 'rocky_mountain') AS peat FROM ci),
 c1 AS (SELECT *, peat AND f_late < 0.2 AND f_spring < 0.3 AND coalesce(abs(swing) < 0.25, true) AS damp FROM c0),
 c2 AS (SELECT *, CASE WHEN sk = 5 AND op >= 0.5 THEN 1 WHEN sk = 5 AND op > 0.1 AND woody < 0.4 THEN 2 WHEN woody >= 0.4 AND damp AND f_wetveg >= 0.5 THEN 3 WHEN woody >= 0.4 THEN 4 WHEN damp AND f_wetveg >= 0.6 AND frac_crop < 0.2 THEN 5 WHEN sk >= 3 OR frac_herb_wet >= 0.3 OR f_wetveg >= 0.3 THEN 6 ELSE 7 END AS rule FROM c1),
 c3 AS (SELECT *, CASE rule WHEN 1 THEN 'Shallow Open Water' WHEN 3 THEN 'Fen (bog possible)' WHEN 4 THEN 'Swamp' WHEN 5 THEN 'Fen (bog possible)' ELSE 'Marsh' END AS awcs_class FROM c2)"""


@query(f"""WITH {CLASS_SQL} SELECT id, awcs_class, CASE WHEN rule = 1 THEN 'open water' WHEN rule IN (3, 4) THEN CASE WHEN frac_tree > 0.4 THEN 'wooded' ELSE 'shrubby' END ELSE 'graminoid' END AS awcs_form, sk AS sk_class,
 CASE sk WHEN 1 THEN 'ephemeral' WHEN 2 THEN 'temporary' WHEN 3 THEN 'seasonal' WHEN 4 THEN 'semi-permanent' ELSE 'permanent' END AS permanence,
 CASE WHEN n_obs_years < 8 OR slope_deg > 6 THEN 'low' WHEN rule = 1 THEN CASE WHEN jrc_occurrence >= 50 THEN 'high' ELSE 'medium' END WHEN rule IN (3, 5, 7) OR (rule = 6 AND frac_crop >= 0.5) THEN 'low' ELSE 'medium' END AS confidence,
 concat_ws('; ', {_said(classify.HEAD, 'sk', *[_PC.format(c) for c in ('f_spring', 'f_late', 'f_spring', 'f_late')])},
  CASE WHEN swing IS NOT NULL THEN {_said(classify.SWINGS, _PC.format('f_late_wet_yrs'), _PC.format('f_late_dry_yrs'))} END,
  CASE rule WHEN 1 THEN {_said(classify.OPEN_BASIN, _PC.format('op'))} || CASE WHEN op < 0.75 THEN '{classify.FRINGE}' ELSE '' END WHEN 2 THEN {_said(classify.OPEN_ZONE, _PC.format('op'))}
   WHEN 3 THEN '{classify.TREED}' WHEN 4 THEN '{classify.WOODY}' WHEN 5 THEN '{classify.SATURATED}' WHEN 6 THEN '{classify.EMERGENT}' || CASE WHEN frac_crop >= 0.5 THEN '; {classify.CROPPED}' ELSE '' END ELSE '{classify.EPHEMERAL}' END,
  CASE WHEN n_obs_years < 8 THEN {_said(classify.FEW_NOTE, 'CAST(n_obs_years AS INT)')} END, CASE WHEN slope_deg > 6 THEN '{classify.STEEP_NOTE}' END) AS rationale FROM c3""")
def classify_rules(s, d):
    return classify.classify(B.view(s, d, B.CLASS_INPUTS, "part")).select("id", "awcs_class", "awcs_form", "sk_class", "permanence", "confidence", "rationale")


@query(f"WITH {CLASS_SQL} SELECT location, awcs_class, count(*) AS n, round_even(sum(area_ha), 2) AS area_ha FROM c3 GROUP BY 1, 2")
def class_summary(s, d):
    return classify.summary(classify.classify(B.view(s, d, B.CLASS_INPUTS, "part")))


_INSIDE = "x > {0} AND x < {2} AND y0 > {1} AND y0 < {3}"
_STATS = [*FREQ_COLUMNS, "n_obs_years", "jrc_occurrence", "slope_deg", "treecover_pct"]
WET_SQL = LABEL + FREQ + f""", ob AS (SELECT l.label, l.r, l.c, (l.c + 0.5) * CAST(20 AS DOUBLE) AS x, -(l.r + 0.5) * CAST(20 AS DOUBLE) AS y0, f.* EXCLUDE (r, c), s.* EXCLUDE (r, c),
  EXISTS (SELECT 1 FROM ext e WHERE e.subset = 'wet' AND e.r = l.r AND e.c = l.c) AS in_wet, EXISTS (SELECT 1 FROM ext e WHERE e.subset = 'dry' AND e.r = l.r AND e.c = l.c) AS in_dry
  FROM lab l LEFT JOIN f USING (r, c) LEFT JOIN static s USING (r, c) WHERE l.subset = 'all'),
 ob2 AS (SELECT *, {_INSIDE.format(*PROJECT)} AS inp, sqrt(power(greatest({PROJECT[0]} - x, 0, x - {PROJECT[2]}), 2) + power(greatest({PROJECT[1]} - y0, 0, y0 - {PROJECT[3]}), 2)) AS away,
  CASE WHEN {_INSIDE.format(*PROJECT)} THEN 0 WHEN {_INSIDE.format(*RINGS[0][1])} THEN 1 WHEN {_INSIDE.format(*RINGS[1][1])} THEN 2 ELSE 3 END AS rnk FROM ob),
 w AS (SELECT label, count(*) AS n_px, avg(x) AS cx, avg(y0) AS cy, min(away) AS dist, avg(CAST(inp AS INT)) AS share, min(rnk) AS rnk, avg(CAST(in_wet AS INT)) AS in_wet_year_extent, avg(CAST(in_dry AS INT)) AS in_dry_year_extent,
  quantile_cont(f_late, 0.9) AS f_late_p90, quantile_cont(f_spring, 0.9) AS f_spring_p90, avg(CAST(coalesce(f_late >= 0.9, false) AS INT)) AS frac_permanent_water, avg(CAST(coalesce(f_spring >= 0.5, false) AS INT)) AS frac_seasonal_water,
  avg(CAST(coalesce(worldcover = 10, false) AS INT)) AS frac_tree, avg(CAST(coalesce(worldcover = 80, false) AS INT)) AS frac_water, avg(CAST(coalesce(worldcover = 90, false) AS INT)) AS frac_herb_wet, {', '.join(f'avg({c}) AS {c}' for c in _STATS)} FROM ob2 GROUP BY label)"""
_ZONAL = [*_STATS, "f_late_p90", "f_spring_p90", "frac_permanent_water", "frac_seasonal_water", "frac_tree", "frac_water", "frac_herb_wet", "in_wet_year_extent", "in_dry_year_extent"]


@query(f"""WITH RECURSIVE {WET_SQL} SELECT 'DEM-W' || lpad(CAST(row_number() OVER (ORDER BY rnk, cy DESC, cx) AS VARCHAR), 2, '0') AS wetland_id, CASE rnk WHEN 0 THEN 'project_area' WHEN 1 THEN 'within_400m' WHEN 2 THEN 'within_800' ELSE 'study_area' END AS location,
 round(n_px * CAST(0.04 AS DOUBLE), 6) AS area_ha, round(CAST(CASE WHEN share > 0 THEN 0 ELSE dist END AS DOUBLE), 1) AS dist_to_project_m, round(share * 100, 1) AS pct_in_project, n_px, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _ZONAL)} FROM w""")
def wetland_table(s, d):
    w, _ = _wetlands(s, d)
    return w.select("wetland_id", "location", F.round("area_ha", 6).alias("area_ha"), "dist_to_project_m", "pct_in_project", "n_px", *[F.round(c, 6).alias(c) for c in _ZONAL])


@query(f"""WITH RECURSIVE {WET_SQL} SELECT 'DEM-W' || lpad(CAST(row_number() OVER (ORDER BY rnk, cy DESC, cx) AS VARCHAR), 2, '0') AS wetland_id, CASE WHEN f_late_p90 >= 0.9 THEN 5 WHEN f_late_p90 >= 0.5 THEN 4 WHEN f_spring_p90 >= 0.5 THEN 3 WHEN f_spring_p90 >= 0.15 THEN 2 ELSE 1 END AS sk_class,
 round_even(in_wet_year_extent * n_px * CAST(0.04 AS DOUBLE), 2) AS wet_year_extent_ha, round_even(in_dry_year_extent * n_px * CAST(0.04 AS DOUBLE), 2) AS dry_year_extent_ha FROM w""")
def wetland_classes(s, d):
    w, _ = _wetlands(s, d)
    return w.select("wetland_id", "sk_class", F.bround(F.col("in_wet_year_extent") * F.col("area_ha"), 2).alias("wet_year_extent_ha"), F.bround(F.col("in_dry_year_extent") * F.col("area_ha"), 2).alias("dry_year_extent_ha"))


_BANDS = {"MSS4-5": ["B1", "B2", "B4"], "TM": ["SR_B1", "SR_B2", "SR_B3", "SR_B4", "SR_B5"], "OLI": ["SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B6"], "S2": ["B2", "B3", "B4", "B8", "B11"]}


def _collections(s, d):
    raw = B.view(s, d, B.SCENES, "lineitem")
    out = []
    for family, names in _BANDS.items():
        own = raw.where(F.col("sensor") == family)
        own = own.withColumns({n: F.col(f"d{k + 1}") % 256 if family.startswith("MSS") else F.col(f"d{k + 1}") for k, n in enumerate(names)}).withColumn("qa", F.col("qa") % 12 if family == "S2" else F.col("qa"))
        out.append(imagery.harmonise(own.select("scene_id", "n", "sensor", "day", "cloud_pct", "qa", *names), family))
    return out


_DN = "CASE sensor WHEN 'S2' THEN {0} * CAST(0.0001 AS DOUBLE) WHEN 'MSS4-5' THEN {1} ELSE {0} * CAST(0.0000275 AS DOUBLE) - 0.2 END"
SCENE_SQL = f"""sc AS ({B.SCENES}), v0 AS (SELECT *, {_DN.format('d1', 'NULL')} AS blue, {_DN.format('d2', '(d1 % 256) / CAST(255 AS DOUBLE)')} AS green, {_DN.format('d3', '(d2 % 256) / CAST(255 AS DOUBLE)')} AS red, {_DN.format('d4', '(d3 % 256) / CAST(255 AS DOUBLE)')} AS nir, {_DN.format('d5', 'NULL')} AS swir1 FROM sc),
 v1 AS (SELECT *, CASE sensor WHEN 'MSS4-5' THEN (qa & 24) = 0 AND green + red <= 1.2 WHEN 'S2' THEN qa % 12 NOT IN (1, 3, 8, 9, 10, 11) ELSE (qa & 58) = 0 AND blue > 0 AND nir < 1 END AS ok FROM v0)"""
_RD = lambda c: f"CASE WHEN ok THEN round({c}, 9) END AS {c}"


@query(f"WITH {SCENE_SQL} SELECT scene_id, CAST(n AS INT) AS n, sensor, {', '.join(map(_RD, ('blue', 'green', 'red', 'nir', 'swir1')))} FROM v1")
def harmonised_scenes(s, d):
    out = reduce(lambda a, b: a.unionByName(b), _collections(s, d))
    return out.select("scene_id", F.col("n").cast("int").alias("n"), "sensor", *[F.round(c, 9).alias(c) for c in ("blue", "green", "red", "nir", "swir1")])


_WIN = "CASE WHEN strftime(day, '%m-%d') >= '04-20' AND strftime(day, '%m-%d') < '06-20' THEN 'spring' WHEN strftime(day, '%m-%d') >= '07-15' AND strftime(day, '%m-%d') < '09-20' THEN 'late' END"
_ND = "CASE WHEN ok AND {0} >= 0 AND {1} >= 0 THEN ({0} - {1}) / nullif({0} + {1}, 0) END"


@query(f"WITH {SCENE_SQL}, k AS (SELECT *, {_WIN} AS win FROM v1 WHERE cloud_pct < 60) SELECT scene_id, CAST(n AS INT) AS n, win, CAST(round({_ND.format('green', 'swir1')} * 10000) AS INT) AS wi, CAST(round({_ND.format('nir', 'swir1')} * 10000) AS INT) AS ndmi, CAST(round({_ND.format('nir', 'red')} * 10000) AS INT) AS ndvi FROM k WHERE win IS NOT NULL AND sensor = 'TM'")
def scene_indices(s, d):
    out = imagery.add_indices(imagery.scenes([c.where("sensor = 'TM'") for c in _collections(s, d)[1:2]]))
    return out.select("scene_id", F.col("n").cast("int").alias("n"), "win", *i("wi", "ndmi", "ndvi"))


@query(f"WITH {SCENE_SQL}, k AS (SELECT *, {_WIN} AS win, year(day) AS y FROM v1 WHERE cloud_pct < 60) SELECT CAST(s.range AS INT) AS year, count(*) FILTER (win = 'spring') AS n_spring, count(*) FILTER (win = 'late') AS n_late FROM range(1994, 2004) s LEFT JOIN k ON k.y = s.range GROUP BY 1")
def scene_inventory(s, d):
    return imagery.scene_inventory(imagery.scenes(_collections(s, d)), 1994, 2003)


@query(f"""WITH st AS ({B.STATIC}), z AS (SELECT r, c, CAST((r * 13 + c * c * 3) % 41 AS DOUBLE) AS z FROM st), g AS (SELECT a.r, a.c, count(*) AS n, sum(b.z * (b.c - a.c) * CASE WHEN a.r = b.r THEN 2 ELSE 1 END) AS gx, sum(b.z * (b.r - a.r) * CASE WHEN a.c = b.c THEN 2 ELSE 1 END) AS gy FROM z a JOIN z b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY 1, 2)
 SELECT r AS px_row, c AS px_col, CASE WHEN n = 9 THEN round(degrees(atan(sqrt(gx * gx + gy * gy) / 160.0)), 6) END AS slope_deg FROM g""")
def terrain_slope(s, d):
    dem = B.static(s, d).select("site", "row", "col", ((F.col("row") * 13 + F.col("col") * F.col("col") * 3) % 41).cast("double").alias("z"))
    return px(imagery.slope(dem, B.PIXEL), F.round("slope_deg", 6).alias("slope_deg"))


@query(f"WITH {MON}{YEARS}, k AS (SELECT CAST(range AS INT) AS year FROM range(1985, 2026)) SELECT year, CAST(precip AS BIGINT) AS precip, coalesce(wet_dry, 'no_data') AS wet_dry, round(avg(precip) FILTER (year BETWEEN 1991 AND 2020) OVER (), 4) AS normal_mean FROM k LEFT JOIN cls ON wy = year")
def precip_chart(s, d):
    spine = s.range(1985, 2026).select(F.col("id").cast("int").alias("year"), F.lit("demo").alias("series"))
    from vernal.plans.report import precip_chart as chart

    return chart(spine, _years(s, d)).drop("series").withColumn("normal_mean", F.round("normal_mean", 4))


# --- parts that the demo grid leaves out: 10 m pixels, early sensors, edges of the inputs -------------------------
_CLEAN10 = LABEL.replace("HAVING count(*) < 5)", "HAVING count(*) < 20)")


@query(f"WITH RECURSIVE {_CLEAN10}, big AS (SELECT subset, label FROM lab GROUP BY ALL HAVING count(*) >= 5) SELECT l.subset, CAST(l.r AS INT) AS px_row, CAST(l.c AS INT) AS px_col FROM lab l JOIN big USING (subset, label)")
def greatest_extent_fine(s, d):
    """As if the pixels were of 10 m: larger holes are filled, slivers of fewer than 5 pixels go."""
    return px(extent.clean(extent.raw_extents(_masks(s, d), B.THR), B.grid(s), 10.0, B.THR), "subset")


_ERA = "SELECT p_partkey AS id, CAST(1972 + p_partkey % 30 AS INT) AS year, CAST(p_partkey * 7 % 97 - 3 AS DOUBLE) / 97 AS green, CAST(p_partkey * 11 % 89 AS DOUBLE) / 89 AS red, CAST(p_partkey * 13 % 83 - 2 AS DOUBLE) / 83 AS nir, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_partkey * 17 % 79 AS DOUBLE) / 79 END AS swir1 FROM part"
_DIFF = "CASE WHEN {0} >= 0 AND {1} >= 0 THEN ({0} - {1}) / nullif({0} + {1}, 0) END"
_STEPS = "CAST(round({} * 10000) AS INT)"


@query(f"WITH e AS ({_ERA}), n AS (SELECT *, {_DIFF.format('green', 'nir')} AS ndwi, {_DIFF.format('green', 'swir1')} AS mndwi, {_DIFF.format('nir', 'swir1')} AS late, {_DIFF.format('nir', 'red')} AS v FROM e) SELECT id, year, {_STEPS.format('CASE WHEN year <= 1983 THEN ndwi ELSE mndwi END')} AS wi, {_STEPS.format('CASE WHEN year <= 1983 THEN ndwi ELSE late END')} AS ndmi, {_STEPS.format('v')} AS ndvi FROM n")
def index_eras(s, d):
    return imagery.add_indices(B.view(s, d, _ERA, "part")).select("id", "year", *i("wi", "ndmi", "ndvi"))


_EARLY = "SELECT p_partkey AS scene_id, CAST(p_partkey % 32 AS INT) AS qa, CAST(p_partkey * 31 % 256 AS INT) AS b4, CAST(p_partkey * 37 % 256 AS INT) AS b5, CAST(p_partkey * 41 % 256 AS INT) AS b7 FROM part"


@query(f"WITH e AS ({_EARLY}), v AS (SELECT *, (qa & 24) = 0 AND b4 / CAST(255 AS DOUBLE) + b5 / CAST(255 AS DOUBLE) <= 1.2 AS ok FROM e) SELECT scene_id, CASE WHEN ok THEN round(b4 / CAST(255 AS DOUBLE), 9) END AS green, CASE WHEN ok THEN round(b5 / CAST(255 AS DOUBLE), 9) END AS red, CASE WHEN ok THEN round(b7 / CAST(255 AS DOUBLE), 9) END AS nir, CAST(NULL AS DOUBLE) AS swir1 FROM v")
def early_scenes(s, d):
    raw = B.view(s, d, _EARLY, "part").withColumnsRenamed({"b4": "B4", "b5": "B5", "b7": "B7"})
    return imagery.harmonise(raw, "MSS1-3").select("scene_id", *[F.round(c, 9).alias(c) for c in ("green", "red", "nir", "swir1")])


@query(f"WITH st AS ({B.STATIC}) SELECT r AS px_row, c AS px_col, worldcover, CASE WHEN jrc_occurrence > 0 THEN jrc_occurrence ELSE 0 END AS jrc_occurrence, CASE WHEN r % 3 > 0 THEN slope_deg END AS slope_deg, CASE WHEN c % 4 > 0 THEN treecover_pct END AS treecover_pct FROM st")
def static_stack(s, d):
    st = B.static(s, d)
    layer = lambda c, keep: st.where(keep).select("site", "row", "col", c)
    out = imagery.static_layers(st.select("site", "row", "col"), layer("worldcover", F.lit(True)), layer("jrc_occurrence", F.col("jrc_occurrence") > 0), layer("slope_deg", F.col("row") % 3 > 0), layer("treecover_pct", F.col("col") % 4 > 0))
    return px(out, "worldcover", "jrc_occurrence", "slope_deg", "treecover_pct")


@query(f"""WITH RECURSIVE {LABEL}, q AS (SELECT label, r - i.range AS br, c - j.range AS bc, count(*) AS n, sum(xor(CAST(i.range AS INT), CAST(j.range AS INT))) AS odd FROM lab, range(2) i, range(2) j WHERE subset = 'all' GROUP BY ALL),
 k AS (SELECT label, sum(CASE WHEN n = 3 THEN 1 WHEN n = 2 AND odd IN (0, 2) THEN 2 ELSE 0 END) AS k FROM q GROUP BY label), sz AS (SELECT label, count(*) AS n_px FROM lab WHERE subset = 'all' GROUP BY label)
 SELECT n_px, round((n_px * 400.0 + k * (1 - CAST(3.141592653589793 AS DOUBLE) / 4) * 25) / 10000, 9) AS smooth_ha FROM sz JOIN k USING (label)""")
def smoothed_areas(s, d):
    c = written(components(_extents(s, d).where("subset = 'all'").drop("subset"), ["site"]), "objects")
    n = c.groupBy("site", "label").agg(F.count("*").alias("n_px"))
    return extent.smoothed_area(c, B.PIXEL).join(n, ["site", "label"]).select("n_px", F.round("smooth_ha", 9).alias("smooth_ha"))


@query(f"WITH by_year AS ({ORACLE_SQL['extent_by_year']}) SELECT year, spring_water_ha, late_water_ha, wet_veg_ha, wet_total_ha, CAST(sensor = 'MSS' AS INT) AS is_mss FROM by_year WHERE coverage_pct >= 50")
def extent_chart(s, d):
    from vernal.plans.report import extent_chart as chart

    by_year = extent_by_year(s, d).withColumn("site", F.lit("demo"))
    return chart(by_year).drop("site").withColumn("is_mss", F.col("is_mss").cast("int"))


@query(f"WITH mon AS ({B.MONTHLY}), t AS (SELECT sum(p) OVER w AS total FROM mon WINDOW w AS (ORDER BY year, month ROWS 11 PRECEDING) QUALIFY count(p) OVER w = 12) SELECT count(*) AS n, round(avg(CAST(total <= 0 AS INT)), 9) AS zero_share, round(avg(total) FILTER (total > 0), 4) AS mean, round(avg(ln(total)) FILTER (total > 0), 9) AS mean_log FROM t")
def spi_inputs(s, d):
    """What the gamma fit of the 12-month index depends on."""
    m = _monthly(s, d).withColumn("at", F.make_date("year", "month", F.lit(1)))
    t = precip.rolling_total(m, 12, order="at").where("total_12 IS NOT NULL").select(F.col("total_12").alias("t"))
    wet = F.when(F.col("t") > 0, F.col("t"))
    return t.agg(F.count("*").alias("n"), F.round(F.avg((F.col("t") <= 0).cast("int")), 9).alias("zero_share"), F.round(F.avg(wet), 4).alias("mean"), F.round(F.avg(F.log(wet)), 9).alias("mean_log"))


@query(f"WITH RECURSIVE {LABEL}, s AS (SELECT label, count(*) AS n_px, 4 * count(*) AS sides FROM lab WHERE subset = 'all' GROUP BY label), t AS (SELECT a.label, count(*) AS touching FROM lab a JOIN lab b ON a.subset = 'all' AND b.subset = 'all' AND a.label = b.label AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY a.label) SELECT n_px, CAST(sides - coalesce(touching, 0) AS INT) AS border_length, CAST(n_px AS DOUBLE) AS ring_area FROM s LEFT JOIN t USING (label)")
def outline_lengths(s, d):
    """Length of the objects' rings, and the area within them less holes."""
    c = written(components(_extents(s, d).where("subset = 'all'").drop("subset"), ["site"]), "objects")
    side = lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: F.struct((F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])).alias("n"), (a["x"] * b["y"] - b["x"] * a["y"]).alias("z")))
    add = lambda r, k: F.aggregate(side(r), F.lit(0.0), lambda t, e: t + e[k])
    rings = outline.outlines(c, ["site", "label"])
    total = lambda of: F.aggregate(F.transform("rings", of), F.lit(0.0), lambda t, x: t + x)
    out = rings.select("site", "label", total(lambda r: add(r, "n")).cast("int").alias("border_length"), F.abs(total(lambda r: add(r, "z")) / 2).alias("ring_area"))
    return out.join(c.groupBy("site", "label").agg(F.count("*").alias("n_px")), ["site", "label"]).select("n_px", "border_length", "ring_area")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Numbered, located and classified wetlands of the demo site."""
    w, _ = _wetlands(s, d)
    return w.select("wetland_id", "location", "area_ha", "awcs_class", "awcs_form", "sk_class", "permanence", "confidence", "rationale")


FLAGSHIP = flagship
