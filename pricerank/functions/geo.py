"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean earth radius in kilometres.
EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres; differences are taken in the columns' own (decimal) type. Null if any coordinate is."""
    dlat, dlon = F.radians((lat2 - lat1).cast("double")), F.radians((lon2 - lon1).cast("double"))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1.cast("double"))) * F.cos(F.radians(lat2.cast("double"))) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def metres(km: Column) -> Column:
    return km * 1000


def valid_point(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)
