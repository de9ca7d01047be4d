"""Project sites from areas of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernal.functions.geo import is_ring, ring_area, site_slug, utm_epsg
from vernal.functions.projection import to_utm


def _projected(geometry: Column, epsg: Column) -> Column:
    def point(p: Column) -> Column:
        x, y = to_utm(p["x"], p["y"], epsg)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(geometry, lambda poly: F.transform(poly, lambda ring: F.transform(ring, point)))


def edges(geometry: Column) -> Column:
    """Edges of all rings of all polygons; the even-odd rule then handles holes and parts."""
    rings = F.flatten(geometry)
    one = lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return F.flatten(F.transform(rings, one))


def area(geometry: Column) -> Column:
    """Outer rings less holes."""
    part = lambda poly: 2 * ring_area(poly[0]) - F.aggregate(F.transform(poly, ring_area), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(F.transform(geometry, part), F.lit(0.0), lambda a, b: a + b)


def split_sites(aoi: DataFrame, study_buffer_m: float = 2000.0) -> DataFrame:
    """One row a folder, in order of appearance: project area (edges, metres), rings from the smallest outwards,
    area, slug, prefix, EPSG code, and the box of the study area. Names that begin with a distance are rings; where
    there are only rings, the smallest is the project. Files without folders are one site."""
    a = aoi.withColumn("folder", F.coalesce(F.nullif(F.col("folder"), F.lit("")), F.lit("Project")))
    first = F.col("geometry")[0][0]
    a = a.withColumns({"lon": F.aggregate(first, F.lit(0.0), lambda s, p: s + p["x"]) / F.size(first), "lat": F.aggregate(first, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(first)})
    code = a.groupBy("folder").agg(utm_epsg(F.avg("lon"), F.avg("lat")).alias("epsg"), F.avg("lat").alias("lat0"), F.min("ord").alias("first"))
    a = a.join(code, "folder").withColumn("xy", _projected(F.col("geometry"), F.col("epsg")))
    a = a.withColumns({"ring": is_ring(F.col("name")), "m2": area(F.col("xy"))})
    own = a.groupBy("folder").agg(F.count_if(~F.col("ring")).alias("n_parcels"), F.min("m2").alias("least"))
    a = a.join(own, "folder").withColumn("parcel", F.when(F.col("n_parcels") > 0, ~F.col("ring")).otherwise(F.col("m2") == F.col("least")))
    item = F.struct("m2", "name", edges(F.col("xy")).alias("edges"))
    g = a.groupBy("folder", "epsg", "lat0", "first").agg(F.flatten(F.collect_list(F.when(F.col("parcel"), F.col("xy")))).alias("parts"), F.array_sort(F.collect_list(F.when(~F.col("parcel"), item))).alias("rings"))
    xs = lambda c: F.transform(F.flatten(F.flatten("parts")), lambda p: p[c])
    d = float(study_buffer_m)
    return g.select(F.col("folder").alias("name"), site_slug(F.col("folder")).alias("site"), F.upper(F.substring(site_slug(F.col("folder")), 1, 3)).alias("prefix"), "epsg", "lat0", "first", edges(F.col("parts")).alias("project"), F.transform("rings", lambda r: F.struct(r["name"].alias("name"), r["edges"].alias("edges"))).alias("rings"), (area(F.col("parts")) / 1e4).alias("project_area_ha"), (F.array_min(xs("x")) - d).alias("x_min"), (F.array_max(xs("x")) + d).alias("x_max"), (F.array_min(xs("y")) - d).alias("y_min"), (F.array_max(xs("y")) + d).alias("y_max"))
