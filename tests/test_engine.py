"""Registered queries against their SQL, expressions and operators against brute force, and the synthetic scene."""

import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vernal.config import Thresholds
from vernal.functions import gamma, geo, projection
from vernal.functions.classify import classify
from vernal.operators import focal, precip, sites
from vernal.operators.components import components, label_pixels
from vernal.plans import catalog, engine
from vernal.sources import kml, stack

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[str]:
    cell = lambda v: "-" if pd.isna(v) else repr(float(v)) if isinstance(v, int | float | np.number) else str(v)[:10] if hasattr(v, "year") else str(v)
    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalog.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def brute_labels(mask):
    out, n = np.zeros(mask.shape, int), 0
    for r, c in np.argwhere(mask):
        if out[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                out[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


def partition(keys, labels):
    d = {}
    for k, v in zip(keys, labels, strict=True):
        d.setdefault(v, set()).add(k)
    return {frozenset(v) for v in d.values()}


@pytest.mark.parametrize("tile", [5, 1024])
def test_components(spark, tile):
    mask = np.random.default_rng(4).random((23, 31)) < 0.4
    at = [(int(r), int(c)) for r, c in np.argwhere(mask)]
    want = partition(at, brute_labels(mask)[mask])
    assert partition(at, label_pixels(np.array([r for r, _ in at]), np.array([c for _, c in at]))) == want
    df = spark.createDataFrame([("s", r, c) for r, c in at], "site string, row int, col int")
    got = components(df, ["site"], tile).collect()
    assert partition([(r["row"], r["col"]) for r in got], [r["label"] for r in got]) == want
    assert components(df.limit(0), ["site"]).count() == 0


def test_morphology_and_box(spark):
    rng = np.random.default_rng(2)
    mask = rng.random((15, 17)) < 0.75
    grid = spark.createDataFrame([("s", 15, 17)], "site string, n_rows int, n_cols int")
    df = spark.createDataFrame([("s", int(r), int(c)) for r, c in np.argwhere(mask)], "site string, row int, col int")

    def near(m, all_of):
        p = np.pad(m, 1)
        s = np.stack([p[1 + i : 1 + i + 15, 1 + j : 1 + j + 17] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        return s.all(0) if all_of else s.any(0)

    got = {(r["row"], r["col"]) for r in focal.closed(focal.opened(df, ["site"], grid), ["site"], grid).collect()}
    want = near(near(near(near(mask, True), False), False), True)
    assert got == {(int(r), int(c)) for r, c in np.argwhere(want)}
    v = rng.integers(-5, 9, (15, 17))
    miss = rng.random((15, 17)) < 0.2
    dense = spark.createDataFrame([("s", 1, r, c, None if miss[r, c] else int(v[r, c]), 15, 17) for r in range(15) for c in range(17)], "site string, year int, row int, col int, v int, n_rows int, n_cols int")
    s, n = (np.pad(x, 4, mode="edge") for x in (np.where(miss, 0, v), (~miss).astype(int)))
    for r in focal.box_sums(dense, "v", 4, ["site", "year"]).collect():
        a, b = slice(r["row"], r["row"] + 9), slice(r["col"], r["col"] + 9)
        assert (r["box_sum"], r["box_n"]) == (s[a, b].sum(), n[a, b].sum())


def test_gamma_and_spi(spark):
    for x in (0.1, 1.0, 3.5, 20.0):
        assert gamma.lower(1.0, x) == pytest.approx(1 - np.exp(-x), abs=1e-13)
    assert gamma.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    x = np.random.default_rng(1).gamma(3.0, 2.0, 20000)
    k, scale = gamma.fit(x)
    assert k == pytest.approx(3, rel=0.05) and scale == pytest.approx(2, rel=0.05)
    m = pd.DataFrame({"series": "a", "month": range(300), "p": np.random.default_rng(2).gamma(2, 30, 300)})
    df = spark.createDataFrame(m)
    z = precip.spi(df, 12).toPandas().sort_values("month")["spi"].astype(float)
    total = m["p"].rolling(12).sum()
    assert z.isna().sum() == 11 and np.corrcoef(z.dropna(), total.dropna())[0, 1] > 0.95 and z.abs().max() < 4
    assert precip.spi(df.where("month < 15"), 12).where("spi IS NOT NULL").count() == 0


def test_classifier_table(spark):
    base = dict(f_spring=0.9, f_late=0.95, f_wetveg=0.0, f_wet=0.9, frac_water=0.8, jrc_occurrence=90.0, frac_tree=0.0, frac_shrub=0.0, frac_herb_wet=0.0, frac_crop=0.0, n_obs_years=40.0, slope_deg=1.0, natural_region="parkland", f_late_wet_yrs=None, f_late_dry_yrs=None)
    cases = [{}, dict(f_late=0.2, f_spring=0.8, frac_water=0.0, jrc_occurrence=5.0, f_wetveg=0.6), dict(f_late=0.05, f_spring=0.1, f_wetveg=0.9, frac_tree=0.7, frac_water=0.0, jrc_occurrence=0.0, natural_region="boreal", f_late_wet_yrs=0.05, f_late_dry_yrs=0.02), dict(f_late=0.3, f_spring=0.7, f_wetveg=0.5, frac_tree=0.6, frac_water=0.0, jrc_occurrence=0.0)]
    schema = "k int, " + ", ".join(f"{c} {'string' if c == 'natural_region' else 'double'}" for c in base)
    got = classify(spark.createDataFrame([(k, *(base | c).values()) for k, c in enumerate(cases)], schema)).orderBy("k").collect()
    assert [(r["awcs_class"], r["sk_class"]) for r in got] == [("Shallow Open Water", 5), ("Marsh", 3), ("Fen (bog possible)", 1), ("Swamp", 3)]


KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>Lake (Site 1)</name>
<Placemark><name>NE 1</name><MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>-113,52,0 -112.99,52,0 -112.99,52.01,0 -113,52.01,0 -113,52,0</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark>
<Folder><Placemark><name>800m Notification</name><Polygon><outerBoundaryIs><LinearRing><coordinates>-113.02,51.98 -112.97,51.98 x -112.97,52.03 -113.02,52.03 -113.02,51.98</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Folder>
<Placemark><name>line</name><LineString><coordinates>0,0 1,1</coordinates></LineString></Placemark></Folder></Document></kml>"""


def test_aoi_and_sites(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as z:
        z.writestr("doc.kml", KML)
    got = kml.load_aoi(spark, f"{tmp_path}/a.kml").orderBy("ord").collect()
    assert [(r["name"], r["folder"], r["slug"]) for r in got] == [("NE 1", "Lake (Site 1)", "NE_1"), ("800m Notification", "Lake (Site 1)", "800m_Notification")]
    assert [len(r["geometry"][0][0]) for r in got] == [5, 5]
    site = sites.split_sites(kml.load_aoi(spark, f"{tmp_path}/b.kmz")).first()
    assert (site["site"], site["prefix"], site["epsg"], len(site["rings"])) == ("Lake_Site1", "LAK", 32612, 1)
    assert site["project_area_ha"] == pytest.approx(687 * 1113 / 1e4, rel=0.01)


def test_projection_round_trip(spark):
    pts = [(-113.5, 53.5), (2.3, 48.8), (-111.0, -30.0), (9.0, 0.0)]
    df = spark.createDataFrame(pts, "lon double, lat double").withColumn("epsg", geo.utm_epsg(F.col("lon"), F.col("lat")))
    x, y = projection.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    df = df.withColumns({"x": x, "y": y})
    lon, lat = projection.from_utm(F.col("x"), F.col("y"), F.col("epsg"))
    for r in df.withColumns({"lon2": lon, "lat2": lat}).collect():
        assert (r["lon2"], r["lat2"]) == (pytest.approx(r["lon"], abs=1e-8), pytest.approx(r["lat"], abs=1e-8))
    centre = next(r for r in df.collect() if r["lat"] == 0.0)
    assert (centre["x"], centre["y"]) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))


def scene(spark, years=range(1980, 2000), n=60):
    """A pond, a cropped patch and a dry plain, with noise; one year without observations."""
    rng = np.random.default_rng(1)
    r, c = np.mgrid[:n, :n]
    pond, crop = (r - 20) ** 2 + (c - 20) ** 2 <= 100, (r > 40) & (c > 40)
    out = []
    for y in years:
        wi = np.where(pond, 4000, -3000) + rng.normal(0, 200, (n, n))
        ndmi = np.where(crop, 4500, 500) + rng.normal(0, 100, (n, n))
        seen = 0 if y == 1988 else 3
        out.append(pd.DataFrame({"site": "s", "year": y, "row": r.ravel(), "col": c.ravel(), "wi_spr": wi.ravel(), "wi_late": (wi - 100).ravel(), "ndmi": ndmi.ravel(), "ndvi": 5000.0, "n_spr": seen, "n_late": seen}))
    static = pd.DataFrame({"site": "s", "row": r.ravel(), "col": c.ravel(), "worldcover": np.where(pond, 80, np.where(crop, 40, 30)).ravel(), "jrc_occurrence": np.where(pond, 95.0, 0.0).ravel(), "slope_deg": 0.5})
    return spark.createDataFrame(pd.concat(out)), spark.createDataFrame(static), pond, crop


def test_synthetic_scene(spark, tmp_path):
    comp, static, pond, crop = scene(spark)
    stack.write_stack(comp, f"{tmp_path}/stack")
    comp = stack.read_stack(spark, f"{tmp_path}/stack", ["s"], 1980, 1999)
    grid = spark.createDataFrame([("s", 60, 60)], "site string, n_rows int, n_cols int")
    assert stack.incomplete(comp, grid).count() == 0
    box = geo.ring_edges([(400100.0, 5699000.0), (401000.0, 5699000.0), (401000.0, 5700000.0), (400100.0, 5700000.0)])
    ring = F.array(F.struct(F.lit("800m").alias("name"), geo.ring_edges([(399000.0, 5698000.0), (402000.0, 5698000.0), (402000.0, 5701000.0), (399000.0, 5701000.0)]).alias("edges")))
    site = spark.range(1).select(F.lit("s").alias("site"), F.lit("SYN").alias("prefix"), F.lit(400000.0).alias("x0"), F.lit(5700000.0).alias("y0"), F.lit(32612).alias("epsg"), F.lit(51.4).alias("lat0"), box.alias("project"), ring.alias("rings"))
    m = pd.DataFrame([("s", y, k, float(20 + (y * 7 + k * 3) % 31)) for y in range(1975, 2001) for k in range(1, 13)], columns=["series", "year", "month", "p"])
    out = engine.run(comp, grid, static, site, spark.createDataFrame(m))
    got = np.zeros((60, 60), bool)
    for p in out["extents"].where("subset = 'all'").collect():
        got[p["row"], p["col"]] = True
    assert (got & pond).sum() / pond.sum() > 0.9 and (got & crop).sum() == 0
    w = out["wetlands"].collect()
    assert len(w) == 1 and w[0]["wetland_id"] == "SYN-W01" and w[0]["location"] == "project_area" and w[0]["awcs_class"] == "Shallow Open Water" and w[0]["sk_class"] == 5
    years = {r["year"]: r for r in out["extent_by_year"].collect()}
    assert len(years) == 20 and years[1988]["coverage_pct"] == 0 and years[1982]["sensor"] == "MSS"
    for subset in ("wet", "dry"):  # subsets lie within the extent
        assert out["extents"].where(F.col("subset") == subset).select("row", "col").subtract(out["extents"].where("subset = 'all'").select("row", "col")).count() == 0
    assert stack.kml(out["wetlands"]).first()["value"].startswith("<Placemark><name>SYN-W01") and '"Feature"' in stack.geojson(out["wetlands"]).first()["value"]


def test_thresholds():
    t = Thresholds()
    assert (t.radius_px(500, 20), t.radius_px(100, 20), t.area_px(500, 20), t.area_px(2000, 20)) == (25, 5, 1, 5)


def test_gauge_stream(spark, tmp_path):
    from vernal.streaming import gauges

    days = pd.date_range("2020-01-01", "2020-04-30")
    spark.createDataFrame(pd.DataFrame({"station": "a", "day": days, "p": np.arange(len(days))})).write.parquet(f"{tmp_path}/in")
    q = gauges.monthly(gauges.read(spark, f"{tmp_path}/in")).writeStream.outputMode("append").format("memory").queryName("gauges").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM gauges").first()[0] >= 1
