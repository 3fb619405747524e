"""Cluster profiles and risk ranking (A08, K15, W02, J06/K16), best-K picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort import config as C
from kohort.functions.risk import cluster_risk_score


def cluster_means(df: DataFrame, feats: list[str], label: str = "cluster", digits: int | None = None) -> DataFrame:
    """Per-cluster means over non-NULL values (K rows)."""
    aggs = [F.avg(f).alias(f) for f in feats]
    if digits is not None:
        aggs = [F.round(F.avg(f), digits).alias(f) for f in feats]
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *aggs)


def rank_clusters(means: DataFrame, label: str = "cluster", filled: tuple = ()) -> DataFrame:
    """K15 + W02: score each row of means; ascending score (ties by id) ranks the
    clusters; the last is RISIKO TINGGI (checked first, so one cluster is TINGGI),
    the first RELATIF SEHAT, the rest RISIKO SEDANG. Runs over K rows only.
    ``filled`` features (refilled with 0 after cleaning dropped them) score nothing."""
    present = [f for f in C.RISK_SCORE_RULES if f in means.columns and f not in filled]
    scored = means.withColumn("risk_score", cluster_risk_score(present))
    w = Window.orderBy(F.col("risk_score").asc(), F.col(label).asc())
    ranked = (scored.withColumn("_rank", F.row_number().over(w))
                    .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))))
    sehat, sedang, tinggi = C.RANK_LABELS
    lab = (F.when(F.col("_rank") == F.col("_n"), F.lit(tinggi))
            .when(F.col("_rank") == 1, F.lit(sehat)).otherwise(F.lit(sedang)))
    lvl = F.create_map(*[x for k, v in C.RANK_TO_LEVEL.items() for x in (F.lit(k), F.lit(v))])
    return (ranked.withColumn("risk_label", lab)
                  .withColumn("risk_level", F.coalesce(lvl[F.col("risk_label")], F.lit(C.DEFAULT_LEVEL)))
                  .drop("_rank", "_n"))


def attach_risk_level(df: DataFrame, ranked: DataFrame, label: str = "cluster") -> DataFrame:
    """Cluster -> risk level (K rows, broadcast: bounded by the cluster count);
    a cluster without a label gets the default level."""
    lut = F.broadcast(ranked.select(label, "risk_level"))
    return (df.join(lut, label, "left")
              .withColumn("risk_level", F.coalesce(F.col("risk_level"), F.lit(C.DEFAULT_LEVEL))))


def best_k(evals: DataFrame) -> DataFrame:
    """K with max silhouette, min DBI, max CH; ties -> smallest k."""
    return evals.agg(
        F.max_by("k", F.struct(F.col("silhouette_score"), -F.col("k"))).alias("best_k_silhouette"),
        F.max_by("k", F.struct(-F.col("davies_bouldin_index"), -F.col("k"))).alias("best_k_davies_bouldin"),
        F.max_by("k", F.struct(F.col("calinski_harabasz_score"), -F.col("k"))).alias("best_k_calinski_harabasz"))
