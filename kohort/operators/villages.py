"""Village risk aggregation and boundary joins.

Village tables are aggregates (one row per village), so the joins below are
plain equi-joins: AQE measures the aggregated side at run time and turns the
join into a broadcast only when that measured size is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.functions import risk, text

COUNTS = ["sehat", "sedang", "tinggi", "total"]


def risk_counts(people: DataFrame, key: str, level: str = "risk_level") -> DataFrame:
    """Per key, people per level and ``total`` = people with a level."""
    lv = F.col(level)
    return people.groupBy(key).agg(
        F.count_if(lv == "Sehat").alias("sehat"),
        F.count_if(lv == "Sedang").alias("sedang"),
        F.count_if(lv == "Tinggi").alias("tinggi"),
        F.count(lv).alias("total"))


def village_totals(people: DataFrame, village: str = "desa", key: str = "desa_norm") -> DataFrame:
    """People per normalised village name; everyone has a level once ranked, so this is the ``total``
    of A11 without its clustering. A missing village is 'NAN', as in the risk map."""
    return people.groupBy(text.normalise_village(village, null_as="NAN").alias(key)).agg(F.count(F.lit(1)).alias("total"))


def percentages(df: DataFrame) -> DataFrame:
    """Shares of total in percent, 1 place; 0 / 0 -> 0."""
    def pct(num):
        return F.coalesce(F.round(F.try_divide(num, F.col("total")) * F.lit(100.0), 1), F.lit(0.0))
    return df.withColumns({
        "pct_sehat": pct(F.col("sehat")),
        "pct_sedang": pct(F.col("sedang")),
        "pct_tinggi": pct(F.col("tinggi")),
        "pct_risiko": pct(F.col("sedang") + F.col("tinggi")),
    })


def named(boundary: DataFrame, name_col: str = "desa_geo", alt_col: str = "alt_geo") -> DataFrame:
    """Boundaries with their normalised names (P20): primary ``name_norm``, alternate ``alt_norm``."""
    return boundary.withColumns({"name_norm": text.normalise_village(name_col),
                                 "alt_norm": text.normalise_village(alt_col)})


def join_boundaries(boundary: DataFrame, counts: DataFrame, name_col: str = "desa_geo",
                    alt_col: str = "alt_geo", key: str = "desa_norm") -> DataFrame:
    """J01 primary-name left join, J02 alternate-name fallback for rows the primary
    missed, J03 missing counts -> 0 and percentages.

    Written as one join: every boundary row offers two candidate keys (primary name
    first, alternate second); after a single left join with the village counts, the
    best-priority match per boundary row wins. The counts (and everything beneath
    them) are computed once instead of once per name column. ``matched_by`` says which
    name found the counts: 'primary', 'alternate' or null.
    """
    b = named(boundary, name_col, alt_col)
    # A boundary row's counts depend only on its (primary, alternate) name pair.
    pairs = b.select("name_norm", "alt_norm").distinct()
    cand = pairs.select("name_norm", "alt_norm", F.explode(F.array(
        F.struct(F.lit(1).alias("pri"), F.col("name_norm").alias("k")),
        F.struct(F.lit(2).alias("pri"), F.col("alt_norm").alias("k")))).alias("c"))
    hits = (cand.join(counts.withColumnRenamed(key, "k"), F.col("c.k") == F.col("k"), "inner")
                .groupBy("name_norm", "alt_norm")
                .agg(F.min_by(F.struct("c.pri", *[F.col(c) for c in COUNTS]), F.col("c.pri")).alias("m")))
    out = b.join(hits, ["name_norm", "alt_norm"], "left")
    out = out.withColumns({c: F.coalesce(F.col("m." + c), F.lit(0)).cast("bigint") for c in COUNTS})
    out = out.withColumn("matched_by", F.when(F.col("m.pri") == 1, "primary").when(F.col("m.pri") == 2, "alternate"))
    return percentages(out.drop("m"))


def boundaries_without_data(mapped: DataFrame) -> DataFrame:
    """J04."""
    return mapped.where(F.col("total") == 0)


def villages_without_boundary(counts: DataFrame, mapped: DataFrame, key: str = "desa_norm") -> DataFrame:
    """Data villages whose name is in neither boundary name column (U01 + U02)."""
    names = (mapped.select(F.col("name_norm").alias(key))
             .union(mapped.select(F.col("alt_norm").alias(key))).distinct())
    return counts.join(names, key, "left_anti")


def colour(mapped: DataFrame, risk_filter: str = "all") -> DataFrame:
    """P21 + F10: fill colour from the filter's percentage column."""
    pct = risk.pct_column_for(risk_filter)
    return mapped.withColumn("fill_color", risk.village_colour(pct, "total", risk_filter))
