"""Descriptive aggregates (A01-A04, A10, A12-A17) and chart datasets.

Each statistic family is a single ``agg`` over all columns (never a job per
column). Exact medians use the bracketed selection in ``quantiles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.session import materialize

from kohort.operators.quantiles import exact_quantiles_with


def people_per_village(df: DataFrame, village: str = "desa") -> DataFrame:
    """NULL village dropped; count descending (ties by name)."""
    return (df.where(F.col(village).isNotNull()).groupBy(village).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col(village)))


def describe(df: DataFrame, cols: list[str], skip_empty: bool = True, digits: int = 2) -> DataFrame:
    """Count, mean, sample std, min, max, median over non-NULL values (2 places).
    ``skip_empty`` drops all-NULL columns (stored-batch form); otherwise they report 0s.

    The columns are materialised once; the moments ride along in the median's sketch pass over
    them, and only six numbers per column reach the driver."""
    df = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    med, row = exact_quantiles_with(df, cols, [0.5], extra_aggs=aggs)
    data = [(c, int(row[f"{c}__count"]), row[f"{c}__mean"], row[f"{c}__std"], row[f"{c}__min"],
             row[f"{c}__max"], med[c][0]) for c in cols]
    out = df.sparkSession.createDataFrame(
        data, "column string, count long, mean double, std double, min double, max double, median double")
    out = out.select("column", "count", *[F.round(k, digits).alias(k) for k in ("mean", "std", "min", "max", "median")])
    if skip_empty:
        return out.where(F.col("count") > 0)
    return out.na.fill(0.0, ["mean", "std", "min", "max", "median"])


def sex_counts(df: DataFrame, col: str = "jenis_kelamin") -> DataFrame:
    """A03."""
    return df.agg(F.count_if(F.col(col) == 1).alias("laki_laki"), F.count_if(F.col(col) == 0).alias("perempuan"))


def distinct_villages(df: DataFrame, col: str = "desa", approx: bool = False) -> DataFrame:
    """NULLs not counted; ``approx`` switches to HyperLogLog++ for very large tables."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(f(F.col(col)).alias("total_desa"))


def crosstab_with_totals(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """A10: row x column counts (missing combination 0), a row total, and a grand
    total row last, in one ROLLUP aggregate."""
    aggs = [F.count_if(F.col(col) == v).alias(f"{col}_{v}") for v in values]
    out = (df.where(F.col(row).isNotNull()).rollup(row)
             .agg(*aggs, F.count(F.lit(1)).alias("total"), F.grouping(row).alias("_g")))
    return (out.withColumn(row, F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col(row)))
               .orderBy("_g", row).drop("_g"))


def correlation_matrix(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    """Pearson correlation per pair over rows where both are present; a pair
    with zero variance (diagonal included) is NULL. One aggregate for all pairs;
    built from population moments with ``try_divide`` so it never raises."""
    aggs = []
    for a in cols:
        for b in cols:
            xa = F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
            xb = F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
            r = F.try_divide(F.covar_pop(xa, xb), F.sqrt(F.var_pop(xa) * F.var_pop(xb)))
            aggs.append(F.struct(F.lit(a).alias("feature_i"), F.lit(b).alias("feature_j"),
                                 F.round(r, digits).alias("correlation")))
    return df.agg(F.array(*aggs).alias("m")).select(F.explode("m").alias("r")).select("r.*")


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins from each group's own min-max (min = max widens the range
    by 0.5 each side); the last edge is inclusive. Output (group, bin, lo, hi, count)."""
    keys = [by] if by else []
    x = F.col(col).cast("double")
    base = df.where(x.isNotNull()).select(*keys, x.alias("_x"))
    rng = base.groupBy(*keys).agg(F.min("_x").alias("_mn0"), F.max("_x").alias("_mx0"))
    rng = (rng.withColumn("_mn", F.when(F.col("_mn0") == F.col("_mx0"), F.col("_mn0") - 0.5).otherwise(F.col("_mn0")))
              .withColumn("_mx", F.when(F.col("_mn0") == F.col("_mx0"), F.col("_mx0") + 0.5).otherwise(F.col("_mx0"))))
    if keys:
        j = base.join(rng, keys, "inner")                   # one row per group, broadcast by AQE if few
    else:
        r = rng.collect()[0]                                # two numbers
        j = base.withColumns({"_mn": F.lit(r["_mn"]), "_mx": F.lit(r["_mx"])})
    width = F.col("_mx") - F.col("_mn")
    idx = F.least(F.floor((F.col("_x") - F.col("_mn")) / width * F.lit(bins)).cast("int"), F.lit(bins - 1))
    counted = j.groupBy(*keys, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = (rng.where(F.col("_mn").isNotNull()).select(*keys, "_mn", "_mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
             .join(counted, [*keys, "bin"], "left"))        # bins without rows count 0
    lo = F.col("_mn") + F.col("bin") * (F.col("_mx") - F.col("_mn")) / F.lit(bins)
    hi = F.col("_mn") + (F.col("bin") + 1) * (F.col("_mx") - F.col("_mn")) / F.lit(bins)
    return every.select(*keys, "bin", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), F.coalesce("count", F.lit(0)).alias("count"))


def radar_profile(df: DataFrame, feats: list[str], label: str = "cluster", eps: float = 1e-9) -> DataFrame:
    """Cluster means scaled across clusters: (m - min) / (max - min + eps). K rows."""
    means = df.groupBy(label).agg(*[F.avg(f).alias(f) for f in feats])
    w = Window.partitionBy(F.lit(1))
    return means.select(label, *[F.round((F.col(f) - F.min(f).over(w)) /
                                         (F.max(f).over(w) - F.min(f).over(w) + F.lit(eps)), 6).alias(f)
                                 for f in feats])


def village_chunks(df: DataFrame, district: str = "kecamatan", village: str = "desa", most: int = 1000) -> DataFrame:
    """The distinct villages of each district in order, in numbered chunks of at most ``most``:
    (district, chunk, n_villages, villages). NULL counts as a village and comes last; no list grows
    with the data."""
    pairs = materialize(df.select(district, village).distinct().withColumn("_none", F.col(village).isNull()))
    ranked = global_rank(pairs, [district, "_none", village], "_at")
    first = ranked.groupBy(F.col(district).alias("_d")).agg(F.min("_at").alias("_first"))
    numbered = ranked.join(first, F.col(district).eqNullSafe(F.col("_d"))).select(district, village, (F.col("_at") - F.col("_first")).alias("_at"))
    return (numbered.withColumn("chunk", F.expr(f"_at div {most}")).groupBy(district, "chunk")
            .agg(F.count(F.lit(1)).alias("n_villages"), F.sort_array(F.collect_list(F.struct("_at", F.col(village).alias("v")))).alias("l"))
            .select(district, "chunk", "n_villages", F.array_compact(F.col("l.v")).alias("villages")))


def villages_per_district(df: DataFrame, district: str = "kecamatan", village: str = "desa") -> DataFrame:
    """The chunks of each district joined to its count and one text."""
    return (village_chunks(df, district, village).groupBy(district)
            .agg(F.sum("n_villages").alias("n_villages"), F.sort_array(F.collect_list(F.struct("chunk", "villages"))).alias("l"))
            .select(district, "n_villages", F.array_join(F.flatten(F.col("l.villages")), ", ").alias("villages")))


def global_rank(df: DataFrame, order: list[str], name: str = "_pos") -> DataFrame:
    """0-based position of each row in ``order``, computed without a single-partition window.

    A range-partitioned sort splits even a hot key across partitions; each partition's
    row count (one row per partition) gives its offset, and the position inside a
    partition comes from ``monotonically_increasing_id`` (partition id in the upper
    bits, row index in the lower 33). Ties keep an arbitrary but consistent order.
    """
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    # both uses below must see one and the same run of the sort, so its result is materialised
    ranked = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    counts = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_pid", "_off")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    # offsets: one row per partition (bounded by the partition count)
    return (ranked.join(offsets, "_pid")
                  .withColumn(name, F.col("_off") + local).drop("_pid", "_mid", "_off"))


def silhouette_profile(points: DataFrame, label: str = "cluster", score: str = "silhouette",
                       gap: int = 10) -> DataFrame:
    """Silhouette plot layout. Clusters in id order, values ascending inside a
    cluster, first bar at y = gap, ``gap`` rows between clusters: y = global position
    over (cluster, value) + gap x (cluster ordinal)."""
    ranked = global_rank(points.select(label, score), [label, score])
    order = ranked.select(label).distinct().withColumn(
        "_ord", F.row_number().over(Window.orderBy(label)))      # a row per label
    return (ranked.join(order, label)
                  .select(label, F.round(score, 6).alias(score),
                          (F.col("_pos") + F.col("_ord") * F.lit(gap)).alias("y")))
