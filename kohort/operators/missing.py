"""Missing-data operators: null ratios (F03), sparse column / row removal (F04, F05),
missing-count report (F06), median fill (F07), absent feature fill (F08),
IQR outlier flag (F09) and village-then-global median fill (F12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.operators.quantiles import exact_medians, exact_quantiles, group_medians


def null_ratio_exprs(cols: list[str]):
    return [F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias(c) for c in cols]


def null_ratios(df: DataFrame, cols: list[str]) -> DataFrame:
    """one row, one column per feature: share of NULLs (0 for an empty table)."""
    return df.agg(*null_ratio_exprs(cols))


def sparse_columns(df: DataFrame, cols: list[str], threshold: float) -> list[str]:
    """features whose NULL share is strictly above ``threshold`` (one small agg)."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return []
    row = null_ratios(df, present).collect()[0]
    return [c for c in present if row[c] > threshold]


def drop_sparse_rows(df: DataFrame, cols: list[str], threshold: float) -> DataFrame:
    """drop rows whose NULL share over ``cols`` is strictly above ``threshold``."""
    if not cols:
        return df
    nulls = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.where(nulls / F.lit(float(len(cols))) <= F.lit(threshold))


def missing_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_missing) for numeric columns with at least one NULL."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stacked = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in cols])).alias("r"))
    return stacked.select("r.column", "r.n_missing").where(F.col("n_missing") > 0)


def add_absent(df: DataFrame, features: list[str]) -> DataFrame:
    """a feature missing from the table is added as constant 0.0 (and stays)."""
    absent = [f for f in features if f not in df.columns]
    return df.withColumns({f: F.lit(0.0) for f in absent}) if absent else df


def median_fill(df: DataFrame, cols: list[str], medians: dict | None = None) -> DataFrame:
    """NULL -> exact column median; an all-NULL column -> 0."""
    medians = exact_medians(df, cols) if medians is None else medians
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"),
                                         F.lit(float(medians[c]) if medians[c] is not None else 0.0))
                           for c in cols})


def iqr_outlier_flags(df: DataFrame, cols: list[str], k: float = 1.5, quartiles: dict | None = None) -> DataFrame:
    """per column, flag values strictly outside [Q1 - k*IQR, Q3 + k*IQR]; NULL -> false.
    ``quartiles`` {column: (Q1, Q3)} replaces the exact ones, for instance by those of sketches."""
    qs = exact_quantiles(df, cols, [0.25, 0.75]) if quartiles is None else quartiles
    flags = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            flags[f"{c}_outlier"] = F.lit(False)
            continue
        iqr = q3 - q1
        lo, hi = q1 - k * iqr, q3 + k * iqr
        x = F.col(c)
        flags[f"{c}_outlier"] = F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))
    return df.withColumns(flags)


def group_median_fill(df: DataFrame, cols: list[str], group: str = "desa") -> DataFrame:
    """NULL -> median of its group, else the global median (a NULL group uses
    the global median).

    Group medians are exact and skew-safe (``quantiles.group_medians``: intervals around the
    middle ranks are narrowed by counts); one join brings every column's group median back.
    """
    glob = exact_medians(df, cols)
    med = group_medians(df, group, cols).withColumnRenamed("median", "m")
    wide = med.groupBy(group).pivot("i", list(range(len(cols)))).agg(F.first("m"))
    wide = wide.select(group, *[F.col(str(i)).alias(f"_med_{i}") for i in range(len(cols))])
    out = df.join(wide, group, "left")   # one row per group; AQE broadcasts it when small
    fills = {}
    for i, c in enumerate(cols):
        g = F.lit(float(glob[c]) if glob[c] is not None else None).cast("double")
        fills[c] = F.coalesce(F.col(c).cast("double"), F.col(f"_med_{i}"), g)
    return out.withColumns(fills).drop(*[f"_med_{i}" for i in range(len(cols))])
