"""Village boundary and coordinate sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.functions.geo import vertex_centroid

FEATURE_SCHEMA = ("features array<struct<type:string, properties:struct<DESA:string, `DESKEL u_7`:string>, "
                  "geometry:struct<type:string, coordinates:string>>>")


def read_geojson_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature; properties flattened; coordinates kept as JSON text
    (Polygon and MultiPolygon nest differently) with the vertex-average centroid (P22)."""
    fc = spark.read.option("multiLine", True).schema(FEATURE_SCHEMA).json(path)
    feats = fc.select(F.explode("features").alias("f"))
    out = feats.select(F.col("f.properties.DESA").alias("desa_geo"),
                       F.col("f.properties.`DESKEL u_7`").alias("alt_geo"),
                       F.col("f.geometry.type").alias("geom_type"),
                       F.col("f.geometry.coordinates").alias("coordinates"))
    c = vertex_centroid("geom_type", "coordinates")
    return out.withColumns({"lat": c["lat"], "lon": c["lon"]})


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """{name: {latitude, longitude}} -> (desa, latitude, longitude) rows."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string, struct<latitude:double, longitude:double>>")
    return (raw.select(F.explode(m).alias("desa", "c"))
               .select("desa", F.col("c.latitude").alias("latitude"), F.col("c.longitude").alias("longitude")))
