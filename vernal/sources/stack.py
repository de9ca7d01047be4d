"""Composite stacks as Parquet partitioned by site and year, and the sinks of a run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BANDS = ("wi_spr", "wi_late", "ndmi", "ndvi", "n_spr", "n_late")
SCHEMA = "row int, col int, " + ", ".join(f"{b} smallint" for b in BANDS) + ", site string, year int"
NODATA = -32768
BAND_ROWS = 1024
#: Line colours of the classes in KML (alpha, blue, green, red).
KML_COLOURS = {"Shallow Open Water": "ffd67a2a", "Marsh": "ff7aaf1b", "Swamp": "ff3468eb", "Fen (bog possible)": "ffa43a4a", "Bog/Fen (peatland)": "ffa43a4a"}


def write_stack(composite: DataFrame, path: str) -> None:
    """One partition a site and year, a file for each band of rows; only the years at hand are replaced. NULL stays NULL."""
    out = composite.select("site", F.col("year").cast("int").alias("year"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.round(b).cast("smallint").alias(b) for b in BANDS])
    # a band of rows of a site and year is a task: a large raster is many
    (out.repartition("site", "year", F.floor(F.col("row") / BAND_ROWS)).sortWithinPartitions("row", "col").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site", "year").parquet(path))


def read_stack(spark: SparkSession, path: str, sites: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Only the partitions asked for are read; a stored no-data value becomes NULL. Sites without any are an error."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if sites is not None:
        df = df.where(F.col("site").isin(*sites))
        if df.isEmpty():
            raise ValueError(f"no site matched {sites}")
    if first is not None:
        df = df.where(F.col("year") >= first)
    if last is not None:
        df = df.where(F.col("year") <= last)
    return df.withColumns({b: F.nullif(F.col(b), F.lit(NODATA).cast("smallint")) for b in BANDS})


def incomplete(stack: DataFrame, grid: DataFrame) -> DataFrame:
    """(site, year, n, message) of years whose pixels don't fill the grid: a manifest, others go on."""
    n = stack.groupBy("site", "year").agg(F.count("*").alias("n")).join(grid, "site")
    want = F.col("n_rows") * F.col("n_cols")
    return n.where(F.col("n") != want).select("site", "year", "n", F.concat(F.lit("expected "), want.cast("string"), F.lit(" pixels")).alias("message"))


def kml(wetlands: DataFrame) -> DataFrame:
    """Placemark texts (site, value), in the order of their numbers; to be written as text. With a column rings (see
    outline.in_degrees) they are polygons with holes, otherwise the objects' centres."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    value = F.concat(F.lit("<Placemark><name>"), esc(F.col("wetland_id")), F.lit("</name><styleUrl>#"), _style(F.col("awcs_class")), F.lit("</styleUrl><description><![CDATA["), F.col("rationale"), F.lit("]]></description>"), _kml_geometry(wetlands), F.lit("</Placemark>"))
    return wetlands.orderBy("site", "wetland_id").select("site", value.alias("value"))


def _style(awcs_class: Column) -> Column:
    return F.regexp_replace(awcs_class, "[^A-Za-z]+", "")


def _kml_geometry(wetlands: DataFrame) -> Column:
    centre = F.concat(F.lit("<Point><coordinates>"), F.format_string("%.6f,%.6f", "centroid_lon", "centroid_lat"), F.lit("</coordinates></Point>"))
    if "rings" not in wetlands.columns:
        return centre
    ring = lambda r: F.concat(F.lit("<LinearRing><coordinates>"), F.array_join(F.transform(r, lambda p: F.format_string("%.6f,%.6f,0", p["x"], p["y"])), " "), F.lit("</coordinates></LinearRing>"))
    holes = F.array_join(F.transform(F.slice("rings", F.lit(2), F.greatest(F.size("rings") - 1, F.lit(0))), lambda r: F.concat(F.lit("<innerBoundaryIs>"), ring(r), F.lit("</innerBoundaryIs>"))), "")
    return F.when(F.size("rings") > 0, F.concat(F.lit("<Polygon><outerBoundaryIs>"), ring(F.col("rings")[0]), F.lit("</outerBoundaryIs>"), holes, F.lit("</Polygon>"))).otherwise(centre)


def geojson(wetlands: DataFrame) -> DataFrame:
    """Feature texts (site, value): polygons where there is a column rings, otherwise the objects' centres."""
    properties = F.struct(*[c for c in wetlands.columns if c not in ("centroid_lon", "centroid_lat", "rings")])
    if "rings" in wetlands.columns:
        geometry = F.struct(F.lit("Polygon").alias("type"), F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    else:
        geometry = F.struct(F.lit("Point").alias("type"), F.array("centroid_lon", "centroid_lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))
    return wetlands.select("site", F.to_json(feature).alias("value"))


def write_documents(rows: DataFrame, path: str, head: str, foot: str, between: str = "") -> None:
    """(site, value) as one text file a site, partitioned by site: head, the values in order, foot. A site's objects are
    thousands at most, its file is written by one task."""
    place = F.row_number().over(Window.partitionBy("site").orderBy("value"))
    last = F.count("*").over(Window.partitionBy("site"))
    body = rows.withColumns({"at": place, "n": last}).select("site", "at", F.concat("value", F.when(F.col("at") < F.col("n"), F.lit(between)).otherwise(F.lit(""))).alias("value"))
    ends = rows.select("site").distinct().select("site", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit(head).alias("value")), F.struct(F.lit((1 << 31) - 1).alias("at"), F.lit(foot).alias("value")))).alias("e")).select("site", "e.at", "e.value")
    body.unionByName(ends).repartition("site").sortWithinPartitions("site", "at").select("site", "value").write.mode("overwrite").partitionBy("site").text(path)


def write_kml(wetlands: DataFrame, path: str) -> None:
    """A KML document a site, with a style for each class."""
    styles = "".join(f'<Style id="{re.sub("[^A-Za-z]+", "", name)}"><LineStyle><color>{c}</color><width>2</width></LineStyle><PolyStyle><color>66{c[2:]}</color></PolyStyle></Style>' for name, c in KML_COLOURS.items())
    write_documents(kml(wetlands), path, f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>{styles}', "</Document></kml>")


def write_geojson(wetlands: DataFrame, path: str) -> None:
    write_documents(geojson(wetlands), path, '{"type":"FeatureCollection","features":[', "]}", ",")


def rasters(frequencies: DataFrame, extents: DataFrame, grid: DataFrame) -> DataFrame:
    """(site, row, col, greatest_extent: 0 or 1, inundation_frequency: -1 where nothing was observed) of every pixel."""
    key = ["site", "row", "col"]
    full = grid.select("site", "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row")).select("site", "row", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    every = extents.where("subset = 'all'").select(*key, F.lit(1).alias("in"))
    out = full.join(frequencies.select(*key, "f_wet"), key, "left").join(every, key, "left")
    return out.select(*key, F.coalesce("in", F.lit(0)).cast("tinyint").alias("greatest_extent"), F.coalesce("f_wet", F.lit(-1.0)).cast("float").alias("inundation_frequency"))


def layers(sites: DataFrame, wetlands: DataFrame) -> dict[str, DataFrame]:
    """The four layers of a run: wetlands, project_area, study_area (its box) and reference_rings."""
    box = [F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x_min", "y_min"), ("x_min", "y_max"), ("x_max", "y_max"), ("x_max", "y_min"), ("x_min", "y_min"))]
    ring = sites.select("site", "epsg", F.explode("rings").alias("r")).select("site", "epsg", "r.name", "r.edges")
    return {"wetlands": wetlands, "project_area": sites.select("site", "name", "epsg", F.col("project").alias("edges"), "project_area_ha"), "study_area": sites.select("site", "name", "epsg", F.array(*box).alias("ring")), "reference_rings": ring}


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
