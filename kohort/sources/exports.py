"""Result exports (S13-S21) as partitioned CSV/Parquet writes and their datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort import config as C


def village_parts(df: DataFrame, village: str = "desa", width: int = 31) -> DataFrame:
    """S13/S14 per-village parts: rows with a village, part name cut to ``width`` chars."""
    return df.where(F.col(village).isNotNull()).withColumn("part", F.substring(F.col(village), 1, width))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", per_village: bool = True,
                village: str = "desa") -> None:
    """The combined table plus one folder per village (partitioned write).

    The plan of ``df`` runs once: the village folders are written from the combined
    table. Rows are rebalanced by part, so a small village is one file and AQE splits a
    large one over several tasks."""
    df.write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/all")
    if per_village:
        (village_parts(read_table(df.sparkSession, path, df.schema, fmt), village).hint("rebalance", "part")
         .write.mode("overwrite").format(fmt).option("header", True).partitionBy("part").save(f"{path}/per_village"))


def write_clusters(df: DataFrame, centroids: DataFrame, path: str, fmt: str = "parquet", per_village: bool = True, village: str = "desa") -> None:
    """The clustered rows as ``write_table`` writes them, and the centroid table (K14, a row a cluster)."""
    write_table(df, path, fmt, per_village, village)
    centroids.coalesce(1).write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/centroids")


def read_centroids(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """The centroid table of ``write_clusters``."""
    return spark.read.format(fmt).option("header", True).schema(schema).load(f"{path}/centroids")


def read_table(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_village: bool = False) -> DataFrame:
    """What ``write_table`` wrote: the combined table, or the village parts with their ``part``."""
    reader = spark.read.format(fmt).option("header", True)
    if not per_village:
        return reader.schema(schema).load(f"{path}/all")
    return reader.schema(T.StructType([*schema.fields, T.StructField("part", T.StringType())])).load(f"{path}/per_village")


def gis_projection(df: DataFrame) -> DataFrame:
    """The GIS columns in order, silently skipping absent ones."""
    return df.select(*[c for c in C.GIS_EXPORT_COLUMNS if c in df.columns])


def report_dataset(df: DataFrame) -> DataFrame:
    """Report columns first, then the rest; sex decoded (1 Laki-laki, 0 Perempuan, else NULL)."""
    first = [c for c in C.REPORT_FIRST_COLUMNS if c in df.columns]
    rest = [c for c in df.columns if c not in first]
    sex = F.col("jenis_kelamin")
    dec = F.when(sex == 1, F.lit(C.SEX_LABELS[1])).when(sex == 0, F.lit(C.SEX_LABELS[0]))
    cols = [dec.alias(c) if c == "jenis_kelamin" else F.col(c) for c in first + rest]
    return df.select(*cols)


def evaluation_parameters(metrics_row: DataFrame, k_col: str = "k") -> DataFrame:
    """Five (parameter, value) rows from a one-row metrics table."""
    return metrics_row.select(F.expr(
        "stack(5, 'Jumlah Cluster (K)', CAST(k AS DOUBLE), 'Silhouette Score', silhouette_score, "
        "'Davies-Bouldin Index', davies_bouldin_index, 'Calinski-Harabasz Score', calinski_harabasz_score, "
        "'Inertia (SSE)', inertia) AS (parameter, value)"))


def validation_summary(counters: DataFrame) -> DataFrame:
    """The A05 counters as (name, value) rows."""
    cols = ["sheets_diproses", "total_baris_mentah", "total_valid", "baris_dihapus",
            "umur_invalid", "imt_invalid", "td_invalid"]
    return counters.select(*[F.col(c).cast("bigint").alias(c) for c in cols]).unpivot(
        [], cols, "name", "value")


def scaled_export(result: DataFrame, scaled_cols: list[str], label: str = "cluster") -> DataFrame:
    """Scaled features with their cluster (carried on the same rows, no re-attach)."""
    return result.select(*scaled_cols, label)
