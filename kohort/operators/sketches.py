"""Mergeable column statistics (F07/F09/A02/A06 for very large stores).

A batch leaves one row per measure: count, mean, sum of squared deviations, least, most and a
KLL quantile sketch; and one for its villages, with a HyperLogLog sketch. Rows of any batches
merge to those of their union without reading a record. Counts, means, deviations and ends
are exact; a quantile's rank is off by at most ``RANK_ERROR`` of the count in 99 of 100
sketches, a distinct count by about ``DISTINCT_ERROR`` of itself (one standard error).
Both are native aggregates that combine map-side; a row holds a few kilobytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KLL_K = 800
HLL_LG_K = 12
RANK_ERROR = 2.296 / KLL_K ** 0.9021      # normalised rank error of a KLL sketch at 99 %
DISTINCT_ERROR = 1.04 / 2 ** (HLL_LG_K / 2)

SCHEMA = T.StructType([T.StructField("column", T.StringType()), T.StructField("n", T.LongType())]
                      + [T.StructField(c, T.DoubleType()) for c in ("mean", "m2", "least", "most")]
                      + [T.StructField(c, T.BinaryType()) for c in ("kll", "hll")])


def column_sketches(df: DataFrame, cols: list[str], distinct: list[str] = (), by: tuple = ()) -> DataFrame:
    """Rows (by, column, n, mean, m2, least, most, kll, hll), one for each column, in one pass.
    Nulls are not counted; a column without values has n 0 and null statistics."""
    rows = []
    for c in cols:
        x = F.col(c).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"),
                             F.min(x).alias("least"), F.max(x).alias("most"), F.kll_sketch_agg_double(x, F.lit(KLL_K)).alias("kll"), F.lit(None).cast("binary").alias("hll")))
    for c in distinct:
        nothing = F.lit(None).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), nothing.alias("mean"), nothing.alias("m2"), nothing.alias("least"), nothing.alias("most"),
                             F.lit(None).cast("binary").alias("kll"), F.hll_sketch_agg(F.col(c), F.lit(HLL_LG_K)).alias("hll")))
    return df.groupBy(*by).agg(F.array(*rows).alias("_s")).select(*by, F.explode("_s").alias("_s")).select(*by, "_s.*")


def merged(sketches: DataFrame, by: tuple = ()) -> DataFrame:
    """The rows of the union, per ``by`` and column; columns without any value are left out."""
    n, mean = F.col("n"), F.col("mean")
    out = sketches.where("n > 0").groupBy(*by, "column").agg(
        F.sum(n).alias("n"), (F.sum(mean * n) / F.sum(n)).alias("mean"), F.sum(F.col("m2") + mean * mean * n).alias("_squares"),
        F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_double("kll", F.lit(KLL_K)).alias("kll"), F.hll_union_agg("hll").alias("hll"))
    m2 = F.greatest(F.col("_squares") - mean * mean * n, F.lit(0.0))
    return out.select(*by, "column", "n", "mean", F.when(mean.isNotNull(), m2).alias("m2"), "least", "most",
                      F.when(mean.isNotNull(), F.col("kll")).alias("kll"), F.when(mean.isNull(), F.col("hll")).alias("hll"))


def quantiles(rows: DataFrame, qs: list[float]) -> DataFrame:
    """(column, n, q, value, rank_error) of merged rows: value has a rank within rank_error of q."""
    at = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("kll", F.lit(float(q))).alias("value")) for q in qs])
    return (rows.where("kll IS NOT NULL AND n > 0").select("column", "n", F.explode(at).alias("_q"))
            .select("column", "n", "_q.q", "_q.value", F.lit(RANK_ERROR).alias("rank_error")))


def describe(rows: DataFrame, digits: int = 2) -> DataFrame:
    """A02's table from merged rows; the median is the sketch's, with its rank_error."""
    std = F.sqrt(F.try_divide("m2", F.col("n") - 1))
    median = F.kll_sketch_get_quantile_double("kll", F.lit(0.5))
    rounded = {"mean": F.col("mean"), "std": std, "min": F.col("least"), "max": F.col("most"), "median": median}
    return rows.where("kll IS NOT NULL AND n > 0").select("column", F.col("n").alias("count"), *[F.round(x, digits).alias(c) for c, x in rounded.items()], F.lit(RANK_ERROR).alias("rank_error"))


def distinct_counts(rows: DataFrame) -> DataFrame:
    """(column, n, distinct, relative_error) of merged rows of counted columns."""
    return rows.where("hll IS NOT NULL").select("column", "n", F.hll_sketch_estimate("hll").alias("distinct"), F.lit(DISTINCT_ERROR).alias("relative_error"))
