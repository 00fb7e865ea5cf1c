"""Forest-road overlays: GeoJSON features, two layers with different columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .clean import strip_blank

FEATURE_SCHEMA = "properties map<string,string>, geometry struct<type:string, coordinates:string>"


def parts_of(geometry: Column) -> Column:
    """Line or multi-line coordinates as parts of points; null for anything else."""
    line = F.from_json(geometry["coordinates"], "array<array<double>>")
    lines = F.from_json(geometry["coordinates"], "array<array<array<double>>>")
    pts = lambda l: F.transform(l, lambda c: F.struct(c[0].alias("lng"), c[1].alias("lat")))
    return F.when(geometry["type"] == "LineString", F.array(pts(line))).when(
        geometry["type"] == "MultiLineString", F.transform(lines, pts)
    )


def read_mvum(spark: SparkSession, path: str, whole_documents: bool = False) -> DataFrame:
    """One row per feature with blank attributes dropped and geometry as parts; no geometry, no row.

    Newline-delimited features split over tasks.  ``whole_documents`` reads FeatureCollections, one task per file.
    """
    if whole_documents:
        doc = spark.read.schema(f"features array<struct<{_nested(FEATURE_SCHEMA)}>>").option("multiLine", True).json(path)
        rows = doc.select(F.inline("features"))
    else:
        rows = spark.read.schema(FEATURE_SCHEMA).json(path)
    d = rows.where(F.col("geometry").isNotNull()).select(F.col("properties").alias("props"), parts_of(F.col("geometry")).alias("parts"))
    d = d.where(F.exists("parts", lambda p: F.size(p) > 0))
    return strip_blank(d, "props")


def _nested(ddl: str) -> str:
    """Column list of a DDL string in the notation of a nested struct."""
    return ddl.replace("properties map", "properties:map").replace("geometry struct", "geometry:struct")


def union_mvum(roads: DataFrame, trails: DataFrame) -> DataFrame:
    """Both layers as one table, each row tagged with its layer; columns of one layer are null in the other."""
    return roads.withColumn("layer_kind", F.lit("road")).unionByName(
        trails.withColumn("layer_kind", F.lit("trail")), allowMissingColumns=True
    )
