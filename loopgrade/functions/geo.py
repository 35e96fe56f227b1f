"""Distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, DECAY_KM = 6371.0, 25.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the argument of asin is clamped to 1."""
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return EARTH_KM * 2 * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def distance_score(km: Column) -> Column:
    """exp(-km / 25)."""
    return F.exp(-km / DECAY_KM)
