"""Runs over whole sites: the made-up scene, outlines, sources, sinks and the command line."""

import json
import sqlite3
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vernal import cli, config
from vernal.functions import gamma, geo, projection
from vernal.operators import extent, outline, precip, sites
from vernal.operators.components import label_pixels
from vernal.plans import engine, results, scene
from vernal.sources import kml, scratch, stack


def squares(spark, names, lat0):
    box = geo.ring_edges([(400900.0, 5697900.0), (402100.0, 5697900.0), (402100.0, 5699100.0), (400900.0, 5699100.0)])
    rows = spark.createDataFrame([(n, n[:3].upper(), lat) for n, lat in zip(names, lat0, strict=True)], "site string, prefix string, lat0 double")
    return rows.select("*", F.lit(400000.0).alias("x0"), F.lit(5700000.0).alias("y0"), F.lit(32612).alias("epsg"), box.alias("project"), F.array(F.struct(F.lit("800m").alias("name"), box.alias("edges"))).alias("rings"))


def test_scene_with_peat_by_site(spark):
    names = ["plain", "north"]
    comp = scratch.written(scene.composite(spark, names, 1984, 1999), "scene")
    grid = spark.createDataFrame([(n, scene.N, scene.N) for n in names], "site string, n_rows int, n_cols int")
    cfg = config.Config(scale_m=10.0)
    got = engine.run(comp, grid, scene.static(spark, names), squares(spark, names, [51.4, 56.0]), scene.monthly(spark, names), cfg)
    every = got["extents"].where("subset = 'all'")
    inside = scene.pixels(spark, names).select("site", "row", "col", *[c.cast("int").alias(k) for k, c in scene.regions().items()])
    share = inside.join(every, ["site", "row", "col"], "left").groupBy("site").agg(*[(F.count_if((F.col(k) == 1) & F.col("subset").isNotNull()) / F.sum(k)).alias(k) for k in scene.regions()]).collect()
    share = {r["site"]: r.asDict() for r in share}
    for n in names:
        assert all(share[n][k] > 0.9 for k in ("pond", "marsh", "ephem")), share
        assert all(share[n][k] < 0.02 for k in ("field", "pasture")), share
    assert share["plain"]["peat"] < 0.1 and share["north"]["peat"] > 0.9
    years = got["precip_years"].where("series = 'plain' AND water_year = 1990").first()
    assert years["spi12"] is not None and years["spi24"] is not None
    assert {r["natural_region"] for r in got["wetlands"].select("site", "natural_region").distinct().collect()} == {"grassland", "boreal"}


@pytest.mark.parametrize("tile", [16, 512])
def test_cleaning_of_tiles(spark, tile):
    """Holes, opening, closing and slivers at 10 m, over tile borders, against whole arrays."""
    rng = np.random.default_rng(5)
    mask = rng.random((70, 64)) < 0.45
    mask[5:30, 8:50] = rng.random((25, 42)) < 0.97
    mask[33:60, 20:60] |= rng.random((27, 40)) < 0.9

    def sized(m):
        r, c = np.nonzero(m)
        label = np.zeros(m.shape, np.int64)
        label[r, c] = 1 + np.unique(label_pixels(r, c), return_inverse=True)[1]
        return np.where(m, np.bincount(label.ravel())[label], 0)

    def near(m, all_of):
        p = np.pad(m, 1)
        s = np.stack([p[1 + i : 1 + i + m.shape[0], 1 + j : 1 + j + m.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        return s.all(0) if all_of else s.any(0)

    thr = config.Thresholds()
    hole, least = thr.area_px(thr.fill_hole_area_m2, 10.0), thr.area_px(thr.min_wetland_area_m2, 10.0)
    assert (hole, least) == (20, 5)
    want = mask | (~mask & (sized(~mask) < hole))
    want = near(near(near(near(want, True), False), False), True)
    want &= sized(want) >= least
    df = spark.createDataFrame([("s", "all", int(r), int(c)) for r, c in np.argwhere(mask)], "site string, subset string, row int, col int")
    grid = spark.createDataFrame([("s", 70, 64)], "site string, n_rows int, n_cols int")
    got = {(r["row"], r["col"]) for r in extent.clean(df, grid, 10.0, thr, tile).collect()}
    assert got == {(int(r), int(c)) for r, c in np.argwhere(want)} and got


def test_outlines(spark):
    shapes = {"one": ["#"], "corner": ["#.", ".#"], "ring": ["###", "#.#", "###"], "ell": ["##", "#."], "cross": [".#.", "#.#", ".#."]}
    rows = [("s", k, r, c) for k, lines in shapes.items() for r, line in enumerate(lines) for c, x in enumerate(line) if x == "#"]
    px = spark.createDataFrame(rows, "site string, label string, row int, col int")
    got = {r["label"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in outline.outlines(px, ["site", "label"]).collect()}
    assert set(got) == set(shapes)
    area = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))) / 2
    for k, rings in got.items():
        assert all(r[0] == r[-1] for r in rings)
        assert area(rings[0]) - sum(map(area, rings[1:])) == sum(1 for x in rows if x[1] == k), k
    assert {k: len(v) for k, v in got.items()} == {"one": 1, "corner": 1, "ring": 2, "ell": 1, "cross": 2}
    assert len(got["one"][0]) == 5 and len(got["ell"][0]) == 7


def test_gridded_precip_reaches_its_radius(spark):
    site = spark.createDataFrame([("a", 10.5, 59.5), ("b", 179.99, 10.0)], "site string, lon double, lat double")
    east = lambda km: float(10.5 + km / 111 / np.cos(np.radians(59.5)))
    p = [(10.5, 59.5, 1, 0.1), (east(57.5), 59.5, 1, 0.3), (east(61), 59.5, 1, 0.9), (-179.99, 10.0, 1, 0.2)]
    got = precip.gridded_monthly(spark.createDataFrame(p, "lon double, lat double, month int, p_m double"), site, 60.0).collect()
    assert {r["site"]: round(r["precip_mm"], 6) for r in got} == {"a": 200.0, "b": 200.0}


def test_precip_sources(spark):
    site = spark.createDataFrame([("a", -113.0, 52.0)], "site string, lon double, lat double")
    stations = spark.createDataFrame([("near", -113.01, 52.0), ("far", -113.3, 52.0)], "station_id string, lon double, lat double")
    days = pd.date_range("2000-01-01", "2003-12-31")
    daily = pd.concat([pd.DataFrame({"station": "near", "day": days[days.month != 6], "p": 1.0}), pd.DataFrame({"station": "far", "day": days, "p": 2.0})])
    daily = spark.createDataFrame(daily).withColumn("day", F.to_date("day"))
    m, years = precip.history("eccc", site, 2001, 2003, stations=stations, daily=daily)
    got = {(r["year"], r["month"]): r["p"] for r in m.collect()}
    assert got[2001, 5] == 31.0 and got[2001, 6] == 60.0 and len(got) == 48
    assert [r["water_year"] for r in years.orderBy("water_year").collect()] == [2001, 2002, 2003]
    m, _ = precip.history("eccc", site, 2001, 2003, stations=stations, daily=daily, station_id="far")
    assert {r["p"] for r in m.where("month = 5").collect()} == {62.0}
    with pytest.raises(ValueError):
        precip.history("other", site, 2001, 2003)


def test_spi_of_water_years(spark):
    m = pd.DataFrame([("a", y, k) for y in range(1980, 2011) for k in range(1, 13)], columns=["series", "year", "month"])
    m["p"] = np.random.default_rng(3).gamma(2, 30, len(m))
    got = {r["water_year"]: r for r in precip.spi_years(spark.createDataFrame(m)).collect()}
    for k in (12, 24):
        z = gamma.spi(m["p"].rolling(k).sum().to_numpy())
        for y in range(1983, 2011):
            at = m.index[(m["year"] == y) & (m["month"] == 9)][0]
            assert got[y][f"spi{k}"] == pytest.approx(z[at], abs=0.0051)


def geopackage(path, epsg, rings):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('parcels', 'geom', ?)", (epsg,))
    db.execute("CREATE TABLE parcels (fid INTEGER PRIMARY KEY, geom BLOB, Name TEXT)")
    wkb = struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *[v for p in r for v in p]) for r in rings)
    db.execute("INSERT INTO parcels (geom, Name) VALUES (?, 'NE 7')", (b"GP\x00\x01" + struct.pack("<i", epsg) + wkb,))
    db.commit()
    db.close()


def test_aoi_formats(spark, tmp_path):
    square = [(400000.0, 5700000.0), (401000.0, 5700000.0), (401000.0, 5701000.0), (400000.0, 5701000.0), (400000.0, 5700000.0)]
    geopackage(tmp_path / "a.gpkg", 32612, [square])
    r = kml.load_aoi(spark, f"{tmp_path}/a.gpkg").first()
    assert r["name"] == "NE 7" and len(r["geometry"][0][0]) == 5
    p = r["geometry"][0][0][0]
    x, y = projection.to_utm(F.lit(p["x"]), F.lit(p["y"]), F.lit(32612))
    back = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (back["x"], back["y"]) == (pytest.approx(400000.0, abs=1e-3), pytest.approx(5700000.0, abs=1e-3))
    one = sites.split_sites(kml.load_aoi(spark, f"{tmp_path}/a.gpkg")).first()
    assert one["project_area_ha"] == pytest.approx(100.0, rel=1e-6)
    doc = {"type": "FeatureCollection", "features": [{"properties": {"name": n}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}} for n in ("a", "b")]}
    (tmp_path / "b.geojson").write_text(json.dumps(doc))
    whole = kml.load_aoi(spark, f"{tmp_path}/b.geojson", dissolve=True).collect()
    assert len(whole) == 1 and whole[0]["slug"] == "AOI" and len(whole[0]["geometry"]) == 2
    (tmp_path / "c.geojson").write_text(json.dumps(doc | {"crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}}))
    (tmp_path / "d.geojson").write_text(json.dumps(doc | {"features": []}))
    for name in ("c", "d"):
        with pytest.raises(Exception, match="neither degrees nor UTM|no polygon"):
            kml.load_aoi(spark, f"{tmp_path}/{name}.geojson").collect()


def test_bounds_and_tile_limit(spark):
    s = spark.createDataFrame([("s", 32612, 400000.0, 402000.0, 5698000.0, 5700000.0)], "site string, epsg int, x_min double, x_max double, y_min double, y_max double")
    b = outline.bounds(s, 100.0).first()
    lon, lat = projection.from_utm(F.lit(401000.0), F.lit(5700100.0), F.lit(32612))
    top = spark.range(1).select(lat.alias("lat")).first()["lat"]
    assert b["west"] < b["east"] and b["south"] < b["north"] and b["north"] >= top
    tiles = geo.tile_cover(outline.bounds(s, 100.0).withColumn("z", F.lit(14)))
    assert geo.within_limit(tiles).count() == tiles.count() > 0
    with pytest.raises(ValueError, match="tiles"):
        geo.within_limit(tiles, 1)


def test_run_command(spark, tmp_path, monkeypatch):
    ring = lambda w, s, e, n: " ".join(f"{x},{y}" for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s)))
    place = lambda name, box: f"<Placemark><name>{name}</name><Polygon><outerBoundaryIs><LinearRing><coordinates>{ring(*box)}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    parts = place("NE 1", (-113.005, 52.0, -112.995, 52.005)) + place("800m Notification", (-113.02, 51.99, -112.98, 52.015))
    (tmp_path / "a.kml").write_text(f"<kml xmlns='http://www.opengis.net/kml/2.2'><Document><Folder><name>Lake (Site 1)</name>{parts}</Folder><Folder><name>Dry (Site 2)</name>{parts}</Folder></Document></kml>")
    site = results.site_grid(sites.split_sites(kml.load_aoi(spark, f"{tmp_path}/a.kml"), 100.0), 20.0).where("site = 'Lake_Site1'").first()
    n, k = site["n_rows"], site["n_cols"]
    r, c = np.mgrid[:n, :k]
    pond = (r - n // 2) ** 2 + (c - k // 2) ** 2 <= 81
    comp = pd.concat([pd.DataFrame({"site": "Lake_Site1", "year": y, "row": r.ravel(), "col": c.ravel(), "wi_spr": np.where(pond, 4000, -3000).ravel(), "wi_late": np.where(pond, 4000, -3000).ravel(), "ndmi": 500, "ndvi": 3000, "n_spr": 2, "n_late": 2}) for y in range(1990, 1995)])
    stack.write_stack(spark.createDataFrame(comp), f"{tmp_path}/stack")
    m = pd.DataFrame([(s, y, q, 30.0 + q) for s in ("Lake_Site1", "Dry_Site2") for y in range(1980, 2001) for q in range(1, 13)], columns=["series", "year", "month", "p"])
    spark.createDataFrame(m).write.parquet(f"{tmp_path}/monthly")
    args = ["run", f"{tmp_path}/a.kml", "--composites", f"{tmp_path}/stack", "--monthly", f"{tmp_path}/monthly", "--out", f"{tmp_path}/out", "--study-buffer-m", "100"]
    assert cli.main(args) == 0
    done = {x["site"]: x for x in spark.read.json(f"{tmp_path}/out/run_summary").collect()}
    assert done["Lake_Site1"]["n_wetlands"] == 1 and done["Lake_Site1"]["error"] is None and done["Dry_Site2"]["error"] == "no composites"
    doc = json.loads("".join(x["value"] for x in spark.read.text(f"{tmp_path}/out/wetlands_geojson/site=Lake_Site1").collect()))
    assert doc["features"][0]["geometry"]["type"] == "Polygon" and doc["features"][0]["properties"]["wetland_id"] == "LAK-W01"
    text = "".join(x["value"] for x in spark.read.text(f"{tmp_path}/out/wetlands_kml/site=Lake_Site1").collect())
    assert text.startswith("<?xml") and text.endswith("</Document></kml>") and "<Polygon><outerBoundaryIs>" in text
    for name in ("rasters", "project_area", "study_area", "reference_rings"):
        assert spark.read.parquet(f"{tmp_path}/out/{name}").where("site = 'Lake_Site1'").count() > 0
    assert spark.read.json(f"{tmp_path}/out/report_tiles").where("site = 'Lake_Site1'").first()["n_project"] == 1
    with pytest.raises(ValueError, match="no site matched"):
        cli.main([*args, "--site", "nowhere"])
    assert cli.main(["sites", f"{tmp_path}/a.kml"]) == 0 and cli.main(["version"]) == 0
    assert cli.main(["basemap", f"{tmp_path}/a.kml", "--zoom", "13", "--out", f"{tmp_path}/tiles"]) == 0
    assert spark.read.parquet(f"{tmp_path}/tiles").count() > 0


def test_cache_key(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    for key, n in (({"a": 1}, 3), ({"a": 1}, 4), ({"a": 2}, 5)):
        results.cached(spark, str(tmp_path), key, lambda n=n: make(n))
    assert made == [3, 5]
    assert results.cached(spark, str(tmp_path), {"a": 1}, lambda: make(6), overwrite=True).count() == 6


def test_env_file(tmp_path, monkeypatch):
    monkeypatch.setenv("VERNAL_B", "kept")
    monkeypatch.delenv("VERNAL_A", raising=False)
    (tmp_path / ".env").write_text("# comment\n\nVERNAL_A='x y'\nVERNAL_B=new\nnoise\n")
    assert config.load_env(str(tmp_path / ".env")) == {"VERNAL_A": "x y", "VERNAL_B": "kept"}


def test_shared_folder(spark, monkeypatch):
    assert scratch.folder(spark)
    kept = scratch.written(spark.range(3), "t")
    assert kept.count() == 3
    scratch.drop(spark, kept.path)
