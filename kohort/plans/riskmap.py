"""The village risk map table.

cluster means (A08, K rows) -> composite score (K15) -> rank (W02) -> cluster
risk level joined to people (J06, K-row broadcast) -> village name
normalisation (P20) -> per-village counts (A11) -> boundary joins (J01-J03) ->
colour class (P21). One lazy plan; the only shuffles are the per-cluster and
per-village aggregates (both partial-aggregated) and two village-sized joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort import config as C
from kohort.functions import text
from kohort.operators import ranking, villages


@dataclass
class RiskMap:
    people: DataFrame       # result rows + risk_level + desa_norm
    ranked: DataFrame       # K rows: cluster, risk_score, risk_label, risk_level
    counts: DataFrame       # per normalised village
    mapped: DataFrame       # boundaries with counts, percentages, colour, display name


def village_risk_map(result: DataFrame, boundary: DataFrame, risk_filter: str = "all",
                     round_means: int | None = None, label: str = "cluster",
                     name_col: str = "desa_geo", alt_col: str = "alt_geo",
                     dropped: tuple = (), ignore_filled: bool = False) -> RiskMap:
    """``ignore_filled``: the features that cleaning ``dropped`` and scaling refilled with 0 score
    nothing in K15. The default scores their zeros as any value."""
    key = [f for f in C.RISK_KEY_FEATURES if f in result.columns]
    ranked = ranking.rank_clusters(ranking.cluster_means(result, key, label, digits=round_means), label, tuple(dropped) if ignore_filled else ())
    people = ranking.attach_risk_level(result, ranked, label)
    # A missing village is NaN in the application's table; its text is 'nan' -> 'NAN'.
    people = people.withColumn("desa_norm", text.normalise_village("desa", null_as="NAN"))
    counts = villages.risk_counts(people, "desa_norm")
    mapped = villages.colour(villages.join_boundaries(boundary, counts, name_col, alt_col), risk_filter)
    mapped = mapped.withColumn("display_name", text.display_name(alt_col, name_col))
    return RiskMap(people, ranked, counts, mapped)


def village_table(people: DataFrame) -> DataFrame:
    """A11 (dashboard form): per village as written, counts and % at risk, sorted by name."""
    counts = villages.risk_counts(people.where(F.col("desa").isNotNull()), "desa")
    counts = counts.withColumn("total", F.col("total"))
    return (counts.withColumn("pct_risiko", F.coalesce(F.round(F.try_divide(
        F.col("sedang") + F.col("tinggi"), F.col("total")) * F.lit(100.0), 1), F.lit(0.0)))
        .orderBy("desa"))


def risk_kpis(people: DataFrame) -> DataFrame:
    """A11 overall KPIs: people and people per level."""
    lv = F.col("risk_level")
    return people.agg(F.count(F.lit(1)).alias("total"), F.count_if(lv == "Sehat").alias("sehat"),
                      F.count_if(lv == "Sedang").alias("sedang"), F.count_if(lv == "Tinggi").alias("tinggi"))
