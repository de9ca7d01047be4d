"""A made-up scene for tests and the benchmark: a permanent pond, a marsh that floods in spring, saturated woods without
open water, a shallow that fills in very wet springs, cropland that is lush in wet years, and a moist pasture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and columns; years without a clear scene; wetness of a year by its place in a cycle of six.
N, CLOUDED = 300, (1975, 1979, 1988)
WETNESS = (0.65, 0.35, 1.0, 0.0, 0.9, 0.65)


def _disk(row: int, col: int, r: int) -> Column:
    return F.pow(F.col("row") - row, 2) + F.pow(F.col("col") - col, 2) <= r * r


def regions() -> dict[str, Column]:
    """Where the parts of the scene are."""
    block = lambda r0, r1, c0, c1: F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1)
    return {"pond": _disk(80, 80, 21), "marsh": _disk(200, 90, 22), "ephem": _disk(240, 230, 9), "field": block(150, 290, 150, 290), "pasture": block(0, 40, 0, 300), "peat": block(40, 110, 180, 270)}


def pixels(spark: SparkSession, sites: list[str]) -> DataFrame:
    p = spark.range(N * N).select(F.floor(F.col("id") / N).cast("int").alias("row"), (F.col("id") % N).cast("int").alias("col"))
    return p.withColumn("site", F.explode(F.array(*map(F.lit, sites))))


def _wetness(year: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WETNESS)), F.pmod(year, F.lit(len(WETNESS))).cast("int") + 1)


def composite(spark: SparkSession, sites: list[str], first: int = 1972, last: int = 2025) -> DataFrame:
    """Stored composites (index steps, NULL without a clear scene) with even noise that depends on the pixel and year alone."""
    d = pixels(spark, sites).withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("f", _wetness(F.col("year")))
    at, core = regions(), _disk(200, 90, 10)
    noise = lambda k, size: (F.pmod(F.xxhash64("site", "year", "row", "col", F.lit(k)), F.lit(2001)) / 1000.0 - 1.0) * size
    f = F.col("f")
    spring = at["pond"] | ((f >= 0.9) & (_disk(80, 80, 26) | at["ephem"])) | ((f >= 0.6) & at["marsh"]) | ((f > 0.2) & core)
    late = at["pond"] | ((f >= 0.9) & core)
    ndmi = F.when(at["peat"], 0.45).when(at["marsh"] & ~late, 0.42).when(at["pasture"], 0.32).when(at["field"], 0.10 + 0.35 * f).otherwise(0.05)
    ndvi = F.when(at["peat"] | at["pasture"], 0.55).when(at["marsh"] & ~late, 0.60).when(at["field"], 0.30 + 0.45 * f).otherwise(0.35)
    value = {"wi_spr": F.when(spring, 0.35).otherwise(-0.45) + noise(1, 0.05), "wi_late": F.when(late, 0.30).otherwise(-0.50) + noise(2, 0.05), "ndmi": ndmi + noise(3, 0.03), "ndvi": ndvi + noise(4, 0.03)}
    seen = ~F.col("year").isin(*CLOUDED)
    old = F.col("year") <= 1983
    steps = [F.when(seen, F.round(v * 10000)).cast("smallint").alias(k) for k, v in value.items()]
    return d.select("site", "year", "row", "col", *steps, F.when(~seen, 0).when(old, 1).otherwise(3).cast("smallint").alias("n_spr"), F.when(~seen, 0).when(old, 1).otherwise(4).cast("smallint").alias("n_late"))


def static(spark: SparkSession, sites: list[str]) -> DataFrame:
    at, core = regions(), _disk(200, 90, 10)
    cover = F.when(at["marsh"] & ~core, 90).when(at["pond"], 80).when(at["peat"], 10).when(at["field"], 40).otherwise(30)
    return pixels(spark, sites).select("site", "row", "col", cover.alias("worldcover"), F.when(at["pond"], 95.0).when(core, 30.0).otherwise(0.0).alias("jrc_occurrence"), F.lit(0.5).alias("slope_deg"), F.when(at["peat"], 70.0).otherwise(2.0).alias("treecover_pct"))


def monthly(spark: SparkSession, sites: list[str], first: int = 1970, last: int = 2025) -> DataFrame:
    """A record whose water years are as wet as the scene's."""
    m = spark.range((last - first + 1) * 12).select((first + F.floor(F.col("id") / 12)).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))
    wet = _wetness(F.when(F.col("month") >= 10, F.col("year") + 1).otherwise(F.col("year")))
    m = m.withColumn("p", 20.0 + 30.0 * wet + F.pmod(F.col("year") * 7 + F.col("month") * 3, F.lit(11)))
    return m.withColumn("series", F.explode(F.array(*map(F.lit, sites))))
