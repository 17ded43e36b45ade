"""The same functions over streams: conversion and detection keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.functions.conversion import Converter
from glyphflow.functions.detection import detect


def converted(stream: DataFrame, config: str, column: str = "text", into: str = "converted", **more) -> DataFrame:
    """A stream with a converted column; append mode, no watermark needed."""
    return Converter(config, **more).transform(stream, column, into)


def detected(stream: DataFrame, column: str = "text") -> DataFrame:
    return stream.withColumn("detection", detect(column)).select("*", "detection.region", "detection.confidence").drop("detection")


def variant_counts(stream: DataFrame, time: str, column: str = "text", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Texts by time window and detected region; rows later than the watermark are dropped by it."""
    found = stream.withWatermark(time, late).select(time, detect(column)["region"].alias("region"))
    return found.groupBy(F.window(time, window), "region").count()
