"""Per-pixel expressions. Missing is NULL, never NaN; masks are never NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vernal.config import Thresholds

#: Bands of each sensor family under their common names.
BANDS = {
    "MSS1-3": {"blue": None, "green": "B4", "red": "B5", "nir": "B7", "swir1": None},
    "MSS4-5": {"blue": None, "green": "B1", "red": "B2", "nir": "B4", "swir1": None},
    "TM": {"blue": "SR_B1", "green": "SR_B2", "red": "SR_B3", "nir": "SR_B4", "swir1": "SR_B5"},
    "OLI": {"blue": "SR_B2", "green": "SR_B3", "red": "SR_B4", "nir": "SR_B5", "swir1": "SR_B6"},
    "S2": {"blue": "B2", "green": "B3", "red": "B4", "nir": "B8", "swir1": "B11"},
}


# Scales of stored numbers, and quality flags that mask a pixel.
LANDSAT_SCALE, LANDSAT_OFFSET, MSS_SCALE, SENTINEL_SCALE = 0.0000275, -0.2, 255.0, 1e-4
LANDSAT_QA, MSS_QA, MSS_BRIGHT = 0b111010, 0b11000, 1.2
SENTINEL_MASKED = (1, 3, 8, 9, 10, 11)


def flag(c: Column) -> Column:
    """A predicate that is false where it is unknown."""
    return F.coalesce(c, F.lit(False))


def landsat_ok(qa: Column, blue: Column, nir: Column) -> Column:
    """Clear of dilated cloud, cloud, shadow and snow, with plausible reflectances."""
    return flag((qa.bitwiseAND(F.lit(LANDSAT_QA)) == 0) & (blue > 0) & (nir < 1))


def landsat(dn: Column) -> Column:
    return dn * LANDSAT_SCALE + LANDSAT_OFFSET


def mss_ok(qa: Column, green: Column, red: Column) -> Column:
    return flag((qa.bitwiseAND(F.lit(MSS_QA)) == 0) & (green + red <= MSS_BRIGHT))


def mss(dn: Column) -> Column:
    return dn / MSS_SCALE


def sentinel_ok(scl: Column) -> Column:
    return flag(~scl.isin(*SENTINEL_MASKED))


def sentinel(dn: Column) -> Column:
    return dn * SENTINEL_SCALE


def normalised_difference(a: Column, b: Column) -> Column:
    """Missing where an input is negative or both are zero; so the index stays within -1 to 1."""
    return F.when((a >= 0) & (b >= 0), (a - b) / F.nullif(a + b, F.lit(0.0)))


def water_index(year: Column, ndwi: Column, mndwi: Column, thr: Thresholds) -> Column:
    """NDWI in the era without a short-wave infrared band, MNDWI after it."""
    return F.when(year <= thr.mss_last_year, ndwi).otherwise(mndwi)


def quantise(index: Column) -> Column:
    """Index to 16-bit steps of 1/10000; a missing one stays NULL."""
    return F.round(index * 10000).cast("smallint")


def dequantise(stored: Column, nodata: int = -32768) -> Column:
    return F.nullif(stored, F.lit(nodata).cast("smallint")) / 10000.0


def ratio(n: Column, d: Column) -> Column:
    return n / F.nullif(d, F.lit(0))


def steps(x: float) -> int:
    """A threshold in the stored unit."""
    return round(x * 10000)
