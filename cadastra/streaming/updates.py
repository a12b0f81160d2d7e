"""Streams of building updates: enrichment against a static layer and windowed totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions.rules import building_population


def enrich(updates: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """Stream-static join of updates with their area."""
    return updates.join(areas, key, "left")


def population_by_window(updates: DataFrame, key: str, time: str = "ts", value: str = "value", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Households and updates per area and window; updates later than ``late`` are
    left out, as the watermark says."""
    return (
        updates.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), F.col(key))
        .agg(F.sum(building_population(F.col(value))).alias("households"), F.count("*").alias("updates"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "households", "updates")
    )
