"""Areas of interest: KML, KMZ, GeoJSON and GeoPackage files.

Files are read with Spark's binaryFile reader (any store that Spark can open) and parsed where they are; one
row for each polygon placemark, in document order, polygons > rings > vertices, in degrees. GeoJSON and GeoPackage
files may be in UTM, which is projected back; any other reference system, or none, is an error."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vernal.functions.geo import name_slug, unique_slugs
from vernal.functions.projection import from_utm

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
SCHEMA = f"path string, ord int, name string, folder string, description string, epsg int, geometry {GEOMETRY}"
#: Attributes that may hold a name, in order.
NAME_FIELDS = ("Name", "NAME", "name", "site", "Site", "id", "ID")


def vertices(text: str) -> list[dict]:
    out = []
    for token in (text or "").split():
        part = token.split(",")
        if len(part) >= 2:
            out.append({"x": float(part[0]), "y": float(part[1])})
    return out


def _local(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _child_text(e, name: str) -> str | None:
    found = next((c for c in e if _local(c) == name), None)
    return (found.text or "").strip() or None if found is not None else None


def from_kml(data: bytes) -> Iterator[tuple]:
    """(name, folder, description, 4326, polygons). A nested folder names its placemarks, an unnamed one passes its parent's name on."""
    todo = [(ElementTree.fromstring(data), None)]
    while todo:
        e, folder = todo.pop()
        if _local(e) == "Placemark":
            polygons = []
            for p in (x for x in e.iter() if _local(x) == "Polygon"):
                rings = {"outerBoundaryIs": [], "innerBoundaryIs": []}
                for b in p:
                    if _local(b) in rings:
                        rings[_local(b)] += [vertices(c.text) for c in b.iter() if _local(c) == "coordinates"]
                outer = [r for r in rings["outerBoundaryIs"] if len(r) >= 4]
                if outer:
                    polygons.append([outer[0], *[r for r in rings["innerBoundaryIs"] if len(r) >= 4]])
            if polygons:
                yield _child_text(e, "name"), folder, _child_text(e, "description"), 4326, polygons
            continue
        inner = _child_text(e, "name") or folder if _local(e) == "Folder" else folder
        todo += [(c, inner) for c in reversed(list(e))]


def _degrees_or_utm(epsg: int) -> int:
    """4326, or a UTM code; anything else is an error."""
    if epsg != 4326 and not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError(f"reference system EPSG:{epsg} is neither degrees nor UTM")
    return epsg


def geojson_epsg(doc: dict) -> int:
    """Degrees unless an old-style crs member says otherwise."""
    name = ((doc.get("crs") or {}).get("properties") or {}).get("name") or "CRS84"
    code = re.search(r"(?:EPSG:+|epsg/\d+/)(\d+)$", name)
    return 4326 if name.endswith("CRS84") else _degrees_or_utm(int(code[1]) if code else 0)


def _wkb(data: bytes, at: int) -> tuple[list, int]:
    """Polygons of a (multi)polygon at a place, and the place after it; other kinds have none."""
    order = "<" if data[at] else ">"
    kind, at = struct.unpack_from(f"{order}I", data, at + 1)[0], at + 5
    size = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
    n, at = struct.unpack_from(f"{order}I", data, at)[0] if kind % 1000 in (3, 6) else 0, at + 4
    out = []
    if kind % 1000 == 6:
        for _ in range(n):
            parts, at = _wkb(data, at)
            out += parts
    elif kind % 1000 == 3:
        rings = []
        for _ in range(n):
            k = struct.unpack_from(f"{order}I", data, at)[0]
            v = struct.unpack_from(f"{order}{k * size}d", data, at + 4)
            rings.append([{"x": v[i], "y": v[i + 1]} for i in range(0, len(v), size)])
            at += 4 + 8 * k * size
        out.append(rings)
    return out, at


def from_geopackage(data: bytes) -> Iterator[tuple]:
    """All feature layers, in the order of the file's own list."""
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    db.row_factory = sqlite3.Row
    for layer in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY rowid").fetchall():
        epsg = _degrees_or_utm(layer["srs_id"])
        for r in db.execute(f'SELECT * FROM "{layer["table_name"]}" ORDER BY rowid'):
            blob = r[layer["column_name"]]
            if blob is None:
                continue
            envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
            polygons = _wkb(blob, 8 + envelope)[0]
            if polygons:
                name = next((str(r[k]) for k in NAME_FIELDS if k in r.keys() and r[k] is not None), None)  # noqa: SIM118
                yield name, r["folder"] if "folder" in r.keys() else None, r["description"] if "description" in r.keys() else None, epsg, polygons  # noqa: SIM118


def from_geojson(data: bytes) -> Iterator[tuple]:
    doc = json.loads(data)
    epsg = geojson_epsg(doc)
    for f in doc.get("features", []):
        g, p = f.get("geometry") or {}, f.get("properties") or {}
        rings = {"Polygon": [g.get("coordinates")], "MultiPolygon": g.get("coordinates")}.get(g.get("type"))
        if rings:
            name = next((str(p[k]) for k in NAME_FIELDS if p.get(k) is not None), None)
            yield name, p.get("folder"), p.get("description"), epsg, [[[{"x": float(v[0]), "y": float(v[1])} for v in r] for r in poly] for poly in rings]


def parse(path: str, data: bytes) -> list[tuple]:
    kind = path.lower().rpartition(".")[2]
    if kind == "kmz":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            data = z.read(next(n for n in z.namelist() if n.lower().endswith(".kml")))
    read = {"geojson": from_geojson, "json": from_geojson, "gpkg": from_geopackage}.get(kind, from_kml)
    rows = read(data)
    return [(path, i, *r) for i, r in enumerate(rows)]


def load_aoi(spark: SparkSession, path: str, dissolve: bool = False) -> DataFrame:
    """All polygon placemarks under path, in degrees, with name defaults (AOI_n) and unique slugs; no polygon at all is an
    error. dissolve: one row called AOI with all polygons as its parts (parts may overlap; tests ask for any part)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"], strict=True) for r in parse(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "ord", "name", "folder", "description", "epsg", "geometry"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
    if raw.isEmpty():
        raise ValueError(f"no polygon placemarks found in {path}")

    def degrees(p):
        lon, lat = from_utm(p["x"], p["y"], F.col("epsg"))
        return F.struct(F.when(F.col("epsg") == 4326, p["x"]).otherwise(lon).alias("x"), F.when(F.col("epsg") == 4326, p["y"]).otherwise(lat).alias("y"))

    raw = raw.withColumn("geometry", F.transform("geometry", lambda g: F.transform(g, lambda r: F.transform(r, degrees)))).drop("epsg")
    if dissolve:
        parts = raw.groupBy().agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", "ord", "geometry"))), lambda x: x["geometry"])).alias("geometry"), F.min("path").alias("path"))
        return parts.select("path", F.lit(0).alias("ord"), F.lit("AOI").alias("name"), F.lit(None).cast("string").alias("folder"), F.lit(None).cast("string").alias("description"), "geometry", F.lit("AOI").alias("slug"))
    named = raw.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("AOI_"), (F.col("ord") + 1).cast("string"))))
    return unique_slugs(named.withColumn("slug", name_slug(F.col("name"))), "slug", "ord", ("path",))
