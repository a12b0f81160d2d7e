"""Readers and writers of layers."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_layer(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """By extension: Parquet, ORC, CSV with a header, JSON lines or GeoPackage."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "gpkg":
        return read_gpkg(spark, path, options["layer"], options["schema"])
    if kind == "csv":
        return spark.read.options(header=True, **options).csv(path)
    reader = spark.read.options(**options)
    return {"orc": reader.orc, "json": reader.json, "geojson": reader.json}.get(kind, reader.parquet)(path)


def gpkg_layers(spark: SparkSession, path: str) -> DataFrame:
    """``(path, layer, file_date)`` of all layers but styles in a folder of GeoPackages;
    the date stands in the second and third part of a file's name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                with _opened(content) as db:
                    rows += [(p, r[0]) for r in db.execute("SELECT table_name FROM gpkg_contents WHERE table_name <> 'layer_styles' ORDER BY 1")]
            yield pd.DataFrame(rows, columns=["path", "layer"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(run, "path string, layer string")
    return found.withColumn("file_date", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("file_date", F.regexp_extract("file_date", r"^[^_]*_([^_]*_[^_.]*)", 1))


def read_gpkg(spark: SparkSession, path: str, layer: str, schema: str) -> DataFrame:
    """Rows of one layer of one or more GeoPackages.  Files are read by Spark, so any
    store works; each is opened from memory.  Geometry headers are removed."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with _opened(content) as db:
                    rows = db.execute(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM \"{layer}\"").fetchall()
                yield pd.DataFrame([[_bare(v) for v in r] for r in rows], columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_packages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, layer`` and the columns of ``schema`` of all layers but styles in a folder
    of GeoPackages that have these columns in common."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                with _opened(content) as db:
                    for (layer,) in db.execute("SELECT table_name FROM gpkg_contents WHERE table_name <> 'layer_styles' ORDER BY 1").fetchall():
                        found = db.execute(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM \"{layer}\"")
                        while rows := found.fetchmany(10_000):
                            yield pd.DataFrame([[file, layer, *map(_bare, r)] for r in rows], columns=["file", "layer", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"file string, layer string, {schema}")


class _opened:
    def __init__(self, content: bytes):
        self.db = sqlite3.connect(":memory:")
        self.db.deserialize(bytes(content))

    def __enter__(self) -> sqlite3.Connection:
        return self.db

    def __exit__(self, *_) -> None:
        self.db.close()


def _bare(value):
    """WKB of a GeoPackage geometry; other values as they are."""
    if isinstance(value, bytes) and value[:2] == b"GP":
        return value[8 + (0, 32, 48, 48, 64)[value[3] >> 1 & 7] :]
    return value


def write_layer(df: DataFrame, path: str, append: bool = False) -> None:
    """By extension: CSV with a header, ORC, JSON lines or Parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = df.write.mode("append" if append else "overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        {"orc": writer.orc, "json": writer.json}.get(kind, writer.parquet)(path)


def write_packages(df: DataFrame, path: str, geocode: str = "geocode") -> None:
    """One folder per area code, written in one job."""
    df.write.mode("overwrite").partitionBy(geocode).parquet(path)


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise at once when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
