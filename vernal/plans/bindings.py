"""Deterministic views that bind the operators to the driver's tables. SQL in both dialects ({div} is integer
division), so that Spark and DuckDB compute the same inputs from the same integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vernal.config import Thresholds

#: The 20 x 20 grid of 20 m pixels, with windows to match.
PIXEL, N = 20.0, 20
THR = Thresholds(wetveg_window_m=100.0, water_proximity_m=40.0)

OBS = """SELECT CAST(1972 + (l_orderkey {div} 20) % 54 AS INT) AS y, CAST(l_partkey % 20 AS INT) AS r, CAST(l_orderkey % 20 AS INT) AS c,
 month(l_shipdate) <= 6 AS spring,
 CAST((CASE WHEN (l_partkey % 20 - 5) * (l_partkey % 20 - 5) + (l_orderkey % 20 - 5) * (l_orderkey % 20 - 5) <= 16 THEN 500
  WHEN (l_partkey % 20 - 14) * (l_partkey % 20 - 14) + (l_orderkey % 20 - 13) * (l_orderkey % 20 - 13) <= 12 THEN -200 ELSE -2500 END)
  + 100 * ROUND(l_discount * 100) - 100 * ROUND(l_tax * 100) AS INT) AS wi,
 CAST((CASE WHEN (l_partkey % 20 - 5) * (l_partkey % 20 - 5) + (l_orderkey % 20 - 13) * (l_orderkey % 20 - 13) <= 9 THEN 4200
  WHEN l_partkey % 20 >= 17 THEN 3600 ELSE 1500 END) + 20 * l_quantity - 300 AS INT) AS ndmi,
 CAST(3200 + 10 * (CAST(l_quantity AS INT) % 30) AS INT) AS ndvi FROM lineitem"""

STATIC = """SELECT CAST(k {div} 20 AS INT) AS r, CAST(k % 20 AS INT) AS c,
 CASE WHEN (k {div} 20 {div} 3 + k % 20 {div} 4) % 7 = 0 THEN 10 WHEN (k {div} 20 {div} 3 + k % 20 {div} 4) % 7 = 1 THEN 20 WHEN (k {div} 20 {div} 3 + k % 20 {div} 4) % 7 = 2 THEN 30
 WHEN (k {div} 20 {div} 3 + k % 20 {div} 4) % 7 = 3 THEN 90 WHEN (k {div} 20 {div} 3 + k % 20 {div} 4) % 7 = 4 THEN 30 WHEN (k {div} 20 {div} 3 + k % 20 {div} 4) % 7 = 5 THEN 80 ELSE 40 END AS worldcover,
 CAST(CASE WHEN (k {div} 20 - 5) * (k {div} 20 - 5) + (k % 20 - 5) * (k % 20 - 5) <= 9 THEN 60 ELSE 0 END AS DOUBLE) AS jrc_occurrence,
 CAST((k {div} 20) * (k % 20) % 8 AS DOUBLE) AS slope_deg, CAST(((k {div} 20) * 7 + (k % 20) * 3) % 100 AS DOUBLE) AS treecover_pct
 FROM (SELECT DISTINCT p_partkey % 400 AS k FROM part) t"""

MONTHLY = """SELECT CAST(1970 + (o_orderkey % 660) {div} 12 AS INT) AS year, CAST(1 + o_orderkey % 12 AS INT) AS month, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS p FROM orders GROUP BY 1, 2"""

MONTHLY_NATION = """SELECT n_name AS series, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS p
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3"""

DAILY = """SELECT r_name AS station, CAST(o_orderdate AS DATE) AS day, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS p
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""

STATIONS = """SELECT s_suppkey AS station_id, CAST(-118 + (s_suppkey * 37 % 1000) / 100.0 AS DOUBLE) AS lon, CAST(49 + (s_suppkey * 53 % 1100) / 100.0 AS DOUBLE) AS lat FROM supplier"""
SITES = """SELECT n_name AS site, CAST(-118 + (n_nationkey * 41 % 100) / 10.0 AS DOUBLE) AS lon, CAST(49 + (n_nationkey * 29 % 110) / 10.0 AS DOUBLE) AS lat FROM nation"""

NAMES = """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '  ' || p_name || ' (Site ' || CAST(p_partkey % 7 AS VARCHAR(9)) || ') Impact Zones' WHEN p_partkey % 4 = 1 THEN CAST(p_size AS VARCHAR(9)) || 'm Notification ' || p_brand
 WHEN p_partkey % 4 = 2 THEN p_type ELSE CAST(p_size AS VARCHAR(9)) || '.5 km ' || p_brand END AS raw FROM part"""

TILES = """SELECT c_custkey AS id, CAST(1 + c_custkey % 18 AS INT) AS z, CAST(c_custkey * 7919 % 1000003 AS INT) AS x, CAST(c_custkey * 104729 % 1000003 AS INT) AS y,
 CAST(-120 + (c_custkey * 31 % 2000) / 100.0 AS DOUBLE) AS lon, CAST(-60 + (c_custkey * 17 % 12000) / 100.0 AS DOUBLE) AS lat FROM customer"""

CLASS_INPUTS = """SELECT p_partkey AS id, CAST(p_partkey % 21 AS DOUBLE) / 20 AS f_spring, CAST(p_partkey * 7 % 23 % 21 AS DOUBLE) / 20 AS f_late, CAST(p_partkey * 5 % 19 AS DOUBLE) / 20 AS f_wetveg,
 CAST(p_partkey * 3 % 21 AS DOUBLE) / 20 AS frac_water, CAST(p_partkey * 11 % 101 AS DOUBLE) AS jrc_occurrence, CAST(p_partkey * 13 % 17 AS DOUBLE) / 20 AS frac_tree, CAST(p_partkey * 17 % 5 AS DOUBLE) / 20 AS frac_shrub,
 CAST(p_partkey * 19 % 9 AS DOUBLE) / 20 AS frac_herb_wet, CAST(p_partkey * 23 % 21 AS DOUBLE) / 20 AS frac_crop, CAST(p_partkey % 40 AS DOUBLE) AS n_obs_years, CAST(p_partkey * 29 % 9 AS DOUBLE) AS slope_deg,
 CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey * 31 % 21 AS DOUBLE) / 20 END AS f_late_wet_yrs, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey * 37 % 21 AS DOUBLE) / 20 END AS f_late_dry_yrs,
 CASE p_partkey % 4 WHEN 0 THEN 'Boreal' WHEN 1 THEN 'parkland' WHEN 2 THEN 'foothills' END AS natural_region,
 CASE p_partkey * 3 % 4 WHEN 0 THEN 'project_area' WHEN 1 THEN 'within_400m' ELSE 'study_area' END AS location, CAST(p_size AS DOUBLE) / 8 AS area_ha FROM part"""

SCENES = """SELECT l_orderkey AS scene_id, l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN 'MSS4-5' WHEN 1 THEN 'TM' WHEN 2 THEN 'OLI' ELSE 'S2' END AS sensor, CAST(l_shipdate AS DATE) AS day,
 CAST(l_partkey % 100 AS DOUBLE) AS cloud_pct, CAST(l_suppkey * 13 % 64 AS INT) AS qa, CAST(7000 + l_partkey * 31 % 30000 AS INT) AS d1, CAST(7000 + l_partkey * 37 % 30000 AS INT) AS d2, CAST(7000 + l_partkey * 41 % 30000 AS INT) AS d3,
 CAST(7000 + l_suppkey * 43 % 35000 AS INT) AS d4, CAST(7000 + l_suppkey * 47 % 35000 AS INT) AS d5 FROM lineitem"""


def text(sql: str, dialect: str) -> str:
    return sql.replace("{div}", "DIV" if dialect == "spark" else "//")


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The view over Parquet tables of sf_dir, without touching the catalog of the session."""
    out = text(sql, "spark").replace("VARCHAR(9)", "STRING")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        out = out.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(out, **frames)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, OBS, "lineitem")
    return v.select(F.lit("demo").alias("site"), F.col("y").alias("year"), F.col("r").alias("row"), F.col("c").alias("col"), F.when(F.col("spring"), "spring").otherwise("late").alias("win"), "wi", "ndmi", "ndvi")


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, STATIC, "part").withColumnsRenamed({"r": "row", "c": "col"}).withColumn("site", F.lit("demo"))


def grid(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("demo").alias("site"), F.lit(N).alias("n_rows"), F.lit(N).alias("n_cols"))
