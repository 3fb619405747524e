"""Registered descriptive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohort.checks import sqlfrag as Q
from kohort.operators import metrics, stats
from kohort.plans.queries_clean import clean
from kohort.plans.queries_cluster import _emb, _eval_sql, clustered
from kohort.registry import register
from kohort.sources.tables import raw_screening

DESC_COLS = ["umur", "imt", "sistolik", "diastolik", "kolesterol", "gds_1"]


@register("a01_people_per_village", Q.with_clean(
    "SELECT desa, count(*) AS n FROM clean WHERE desa IS NOT NULL GROUP BY desa"))
def a01(spark, sf):
    return stats.people_per_village(clean(spark, sf, sort=False).table)


@register("a02_descriptive_stats", Q.with_clean("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {Q.rnd(f'avg({c})', 2)} AS mean, "
    f"{Q.rnd(f'stddev_samp({c})', 2)} AS std, {Q.rnd(f'min({c})', 2)} AS min, {Q.rnd(f'max({c})', 2)} AS max, "
    f"{Q.rnd(f'quantile_cont({c}, 0.5)', 2)} AS median FROM clean" for c in DESC_COLS) + ") WHERE count > 0"))
def a02(spark, sf):
    return stats.describe(clean(spark, sf, sort=False).table, DESC_COLS)


@register("a03_sex_counts", Q.with_clean(
    "SELECT count(*) FILTER (WHERE jenis_kelamin = 1) AS laki_laki, "
    "count(*) FILTER (WHERE jenis_kelamin = 0) AS perempuan FROM clean"))
def a03(spark, sf):
    return stats.sex_counts(clean(spark, sf, sort=False).table)


@register("a04_distinct_villages", Q.with_clean("SELECT count(DISTINCT desa) AS total_desa FROM clean"))
def a04(spark, sf):
    return stats.distinct_villages(clean(spark, sf, sort=False).table)


CORR_COLS = ["umur", "imt", "kolesterol", "sistolik", "diastolik"]


def _corr_sql():
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            xa = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
            xb = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            den = f"sqrt(var_pop({xa}) * var_pop({xb}))"
            r = f"CASE WHEN {den} = 0 THEN NULL ELSE covar_pop({xa}, {xb}) / {den} END"
            parts.append(f"SELECT '{a}' AS feature_i, '{b}' AS feature_j, {Q.rnd(r, 4)} AS correlation FROM clean")
    return Q.with_clean(" UNION ALL ".join(parts))


@register("a12_correlation_matrix", _corr_sql())
def a12(spark, sf):
    return stats.correlation_matrix(clean(spark, sf, sort=False).table, CORR_COLS)


def _hist_sql(src: str, col: str, bins: int, by: str | None):
    keys = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    join = f"JOIN rng USING ({by})" if by else ", rng"
    lo = f"(mn + bin * (mx - mn) / {bins}.0)"
    hi = f"(mn + (bin + 1) * (mx - mn) / {bins}.0)"
    return (f"rng AS (SELECT {keys}CASE WHEN min({col}) = max({col}) THEN min({col}) - 0.5 ELSE min({col}) END AS mn, "
            f"CASE WHEN min({col}) = max({col}) THEN max({col}) + 0.5 ELSE max({col}) END AS mx FROM {src} "
            f"WHERE {col} IS NOT NULL {grp}),\n"
            f"hb AS (SELECT {keys}least(CAST(floor(({col} - mn) / (mx - mn) * {bins}) AS INTEGER), {bins - 1}) AS bin, mn, mx "
            f"FROM {src} {join} WHERE {col} IS NOT NULL)"), \
        (f"SELECT {keys}bin, {Q.rnd(lo, 6)} AS lo, {Q.rnd(hi, 6)} AS hi, coalesce(n, 0) AS count FROM "
         f"(SELECT * FROM rng, (SELECT unnest(range({bins}))::INTEGER AS bin) WHERE mn IS NOT NULL) LEFT JOIN "
         f"(SELECT {keys}bin, count(*) AS n FROM hb GROUP BY {keys}bin) USING ({keys}bin)")


_H1 = _hist_sql("result", "umur", 20, "cluster")
_H2 = _hist_sql("clean", "imt", 25, None)


@register("a13_age_histogram_per_cluster", Q.with_lloyd(_H1[1], _H1[0]))
def a13_age(spark, sf):
    return stats.histogram(clustered(spark, sf).labelled, "umur", 20, by="cluster")


@register("a13_bmi_histogram", Q.with_clean(_H2[1], _H2[0]))
def a13_bmi(spark, sf):
    return stats.histogram(clean(spark, sf, sort=False).table, "imt", 25)


for _col in ("sistolik", "diastolik"):
    _h = _hist_sql("clean", _col, 25, None)
    register(f"a13_{_col}_histogram", Q.with_clean(_h[1], _h[0]))(
        lambda spark, sf, col=_col: stats.histogram(clean(spark, sf, sort=False).table, col, 25))


RADAR = ["umur", "imt", "sistolik", "kolesterol"]


@register("a14_radar_profile", Q.with_lloyd(
    "SELECT cluster, " + ", ".join(
        f"{Q.rnd(f'({f} - min({f}) OVER ()) / (max({f}) OVER () - min({f}) OVER () + 1e-9)', 6)} AS {f}"
        for f in RADAR) + " FROM (SELECT cluster, " + ", ".join(f"avg({f}) AS {f}" for f in RADAR)
    + " FROM result GROUP BY cluster)"))
def a14(spark, sf):
    return stats.radar_profile(clustered(spark, sf).labelled, RADAR)


@register("a15_records_per_district", "WITH " + Q.raw_cte() +
          "\nSELECT kecamatan, count(*) AS n FROM raw WHERE kecamatan IS NOT NULL GROUP BY kecamatan")
def a15(spark, sf):
    return stats.people_per_village(raw_screening(spark, sf), "kecamatan").withColumnRenamed("n", "n")


@register("a16_villages_per_district", "WITH " + Q.raw_cte() +
          "\nSELECT kecamatan, count(DISTINCT desa) + max(CASE WHEN desa IS NULL THEN 1 ELSE 0 END) AS n_villages, "
          "array_to_string(list_sort(list_distinct(list(desa))), ', ') AS villages FROM raw GROUP BY kecamatan")
def a16(spark, sf):
    return stats.villages_per_district(raw_screening(spark, sf))


@register("a16_village_chunks", "WITH " + Q.raw_cte() + """
SELECT kecamatan, chunk, count(*) AS n_villages, array_to_string(list(desa ORDER BY pos) FILTER (WHERE desa IS NOT NULL), '|') AS villages
FROM (SELECT kecamatan, desa, pos, pos // 3 AS chunk FROM (SELECT kecamatan, desa, row_number() OVER (PARTITION BY kecamatan ORDER BY desa IS NULL, desa) - 1 AS pos
  FROM (SELECT DISTINCT kecamatan, desa FROM raw))) GROUP BY kecamatan, chunk""")
def a16_chunks(spark, sf):
    """A16 in chunks of three villages."""
    return stats.village_chunks(raw_screening(spark, sf), most=3).withColumn("villages", F.array_join("villages", "|"))


@register("w05_silhouette_profile", _eval_sql() +
          ",\nord AS (SELECT own, row_number() OVER (ORDER BY own) AS o FROM (SELECT DISTINCT own FROM pt))"
          f"\nSELECT own AS label, {Q.rnd('s', 6)} AS silhouette, "
          "(row_number() OVER (ORDER BY own, s) - 1) + o * 10 AS y FROM pt JOIN ord USING (own)")
def w05(spark, sf):
    df = _emb(spark, sf)
    pts = metrics.silhouette_points(df, metrics.as_vector(array_col="embedding"), "vec_id", "label")
    return stats.silhouette_profile(pts, "label").withColumn("label", F.col("label").cast("int"))


@register("w06_first_rows", "WITH " + Q.raw_cte() + "\nSELECT * FROM raw ORDER BY row_id LIMIT 5")
def w06(spark, sf):
    return raw_screening(spark, sf).orderBy("row_id").limit(5)


@register("s04_raw_preview", "WITH " + Q.raw_cte() + "\nSELECT * FROM raw ORDER BY row_id LIMIT 10")
def s04(spark, sf):
    return raw_screening(spark, sf).orderBy("row_id").limit(10)


@register("w07_average_silhouette", _eval_sql() + f"\nSELECT {Q.rnd('avg(s)', 6)} AS silhouette_avg FROM pt")
def w07(spark, sf):
    df = _emb(spark, sf)
    pts = metrics.silhouette_points(df, metrics.as_vector(array_col="embedding"), "vec_id", "label")
    return pts.agg(F.round(F.avg("silhouette"), 6).alias("silhouette_avg"))


_SERVICE_COLS = ["umur", "imt", "sistolik", "diastolik", "kolesterol", "gds_2"]


@register("a02_descriptive_stats_service", Q.with_clean("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, coalesce({Q.rnd(f'avg({c})', 2)}, 0.0) AS mean, "
    f"coalesce({Q.rnd(f'stddev_samp({c})', 2)}, 0.0) AS std, coalesce({Q.rnd(f'min({c})', 2)}, 0.0) AS min, "
    f"coalesce({Q.rnd(f'max({c})', 2)}, 0.0) AS max, coalesce({Q.rnd(f'quantile_cont({c}, 0.5)', 2)}, 0.0) AS median "
    f"FROM (SELECT *, CAST(NULL AS DOUBLE) AS gds_2 FROM clean)" for c in _SERVICE_COLS) + ")"))
def a02_service(spark, sf):
    """A02, service form: every listed column reported; an all-NULL one (here gds_2,
    dropped by F04 and absent from the table) reports zeros instead of being skipped."""
    t = clean(spark, sf, sort=False).table
    t = t.withColumns({c: F.lit(None).cast("double") for c in _SERVICE_COLS if c not in t.columns})
    return stats.describe(t, _SERVICE_COLS, skip_empty=False)
