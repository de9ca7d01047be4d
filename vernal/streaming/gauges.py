"""Daily gauge readings as a stream: monthly totals with the day gate, late readings within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "station string, day timestamp, p long"


def read(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def monthly(readings: DataFrame, late: str = "45 days", min_days: int = 25) -> DataFrame:
    """State is one row for each station and month within the watermark; a repeated reading of a day counts once."""
    r = readings.where("p IS NOT NULL").withWatermark("day", late).dropDuplicatesWithinWatermark(["station", "day"])
    m = r.groupBy("station", F.date_trunc("month", "day").alias("month"), F.window("day", "31 days")).agg(F.sum("p").alias("p"), F.count("p").alias("n_days"))
    return m.select("station", "month", "window", "p", "n_days", (F.col("n_days") >= min_days).alias("full"))
