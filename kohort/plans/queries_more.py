"""Registered queries of operators that the other modules run only as parts of a plan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kohort import config as C
from kohort.checks import sqlfrag as Q
from kohort.functions import geo as geometry
from kohort.functions.text import nan_to_null, normalise_village
from kohort.operators import kmeans, metrics, missing, ranking, stats, villages
from kohort.plans import clustering
from kohort.plans import preprocessing as P
from kohort.plans.queries_clean import PARAMS, clean
from kohort.plans.queries_cluster import S_COLS, _emb, _eval_sql, clustered
from kohort.registry import register
from kohort.session import checkpoint_dir
from kohort.sources import geo, screening
from kohort.sources.batches import BatchStore
from kohort.sources.tables import raw_screening, table, village_boundary


@register("s03_normalised_headers", "WITH " + Q.raw_cte() +
          "\nSELECT row_id, kecamatan AS kecamatan_domisili, desa AS desa_kelurahan_domisili, gd2pp AS gula_darah_2_jam_pp_gd2pp_mg_atau_dl, "
          "depresi AS skilas_intepretasi_gejala_depresi FROM raw")
def s03(spark, sf):
    sheet = raw_screening(spark, sf).withColumnsRenamed({c: h for h, c in C.HEADER_MAP.items()})
    return screening.normalise_headers(sheet).select("row_id", "kecamatan_domisili", "desa_kelurahan_domisili",
                                                     "gula_darah_2_jam_pp_gd2pp_mg_atau_dl", "skilas_intepretasi_gejala_depresi")


@register("s07_nan_to_null", "SELECT vec_id, CASE WHEN vec_id % 7 IN (1, 2, 3) THEN NULL ELSE embedding[1]::DOUBLE END AS x FROM embeddings")
def s07(spark, sf):
    e = table(spark, sf, "embeddings")
    k = F.col("vec_id") % 7
    x = F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).when(k == 3, F.lit(float("-inf"))).otherwise(F.col("embedding")[0].cast("double"))
    return e.select("vec_id", nan_to_null(x).alias("x"))


# A triangle's outline for even customers, two lines' outline for odd ones, around a point of their key.
_K = "(c_custkey % 80)::DOUBLE"
_CENTROIDS = (f"SELECT c_custkey AS gid, round(CASE WHEN c_custkey % 2 = 0 THEN (4 * {_K} + 2) / 4 ELSE (4 * {_K} + 4) / 4 END, 6) AS lat, "
              f"round(CASE WHEN c_custkey % 2 = 0 THEN (4 * {_K} + 4) / 4 ELSE (4 * {_K} + 3) / 4 END, 6) AS lon FROM customer")
#: shapes of one boundary or coordinate file, on average
PER_FILE = 1000


def _shapes(spark, sf):
    """(gid, name, geom_type, coordinates): nested arrays derived from the customer table."""
    k = (F.col("c_custkey") % 80).cast("double")
    point = lambda x, y: F.array(k + x, k + y)
    ring = F.array(point(0, 0), point(2, 0), point(2, 2), point(0, 0))
    poly = F.to_json(F.array(ring))
    multi = F.to_json(F.array(F.array(F.array(point(0, 1), point(3, 1))), F.array(F.array(point(0, 2), point(0, 0)))))
    even = F.col("c_custkey") % 2 == 0
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("gid"), F.col("c_name").alias("name"),
                                               F.when(even, "Polygon").otherwise("MultiPolygon").alias("geom_type"),
                                               F.when(even, poly).otherwise(multi).alias("coordinates"))


@register("p22_vertex_centroid", _CENTROIDS)
def p22(spark, sf):
    c = geometry.vertex_centroid("geom_type", "coordinates")
    return _shapes(spark, sf).select("gid", F.round(c["lat"], 6).alias("lat"), F.round(c["lon"], 6).alias("lon"))


def _through_files(spark, rows, key, doc, name, read):
    """``read`` of a shared folder with a document ``doc`` (an aggregate) per hash bucket of about
    PER_FILE rows, a file each, so that writing and reading spread over tasks; the folder is then removed."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    n = -(-rows.count() // PER_FILE)
    bucket = F.pmod(F.xxhash64(key), F.lit(max(1, n)))
    rows.groupBy(bucket.alias("bucket")).agg(doc.alias("value")).write.partitionBy("bucket").text(path)
    out = read(path).checkpoint(eager=True)
    BatchStore(spark, path)._remove(path)
    return out


@register("s22_geojson_boundaries", _CENTROIDS.replace("SELECT c_custkey AS gid,", "SELECT c_name AS desa_geo, 'u' || c_name AS alt_geo, "
                                                        "CASE WHEN c_custkey % 2 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS geom_type,"))
def s22(spark, sf):
    """GeoJSON files of some thousand features each (the format keeps a file's features in one document)."""
    feature = F.concat(F.lit('{"type": "Feature", "properties": {"DESA": "'), "name", F.lit('", "DESKEL u_7": "u'), "name",
                       F.lit('"}, "geometry": {"type": "'), "geom_type", F.lit('", "coordinates": '), "coordinates", F.lit("}}"))
    doc = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list(feature), ", "), F.lit("]}"))
    return _through_files(spark, _shapes(spark, sf), "gid", doc, "geojson", lambda p: geo.read_geojson_boundaries(spark, p)
                          .select("desa_geo", "alt_geo", "geom_type", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")))


@register("s23_coordinates", "SELECT c_name AS desa, c_custkey / 4.0::DOUBLE AS latitude, c_custkey * 2.5::DOUBLE AS longitude FROM customer")
def s23(spark, sf):
    pair = F.struct((F.col("c_custkey") / 4.0).alias("latitude"), (F.col("c_custkey") * F.lit(2.5).cast("double")).alias("longitude"))
    doc = F.to_json(F.map_from_entries(F.collect_list(F.struct("c_name", pair))))
    return _through_files(spark, table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", doc, "coordinates", lambda p: geo.read_coordinates(spark, p))


_ENC = "WITH " + ",\n".join([Q.raw_cte(), Q.values_cte(), Q.encoded_cte()])


@register("p18_numeric_types", _ENC + "\nSELECT row_id, CAST(berat_badan AS DOUBLE) AS berat_badan, CAST(tinggi_badan AS DOUBLE) AS tinggi_badan FROM enc")
def p18(spark, sf):
    return P.validate(P.before_missing(raw_screening(spark, sf), PARAMS)).select("row_id", "berat_badan", "tinggi_badan")


@register("p23_cluster_label", Q.with_lloyd("SELECT row_id, 'Cluster ' || cluster AS cluster_label FROM labels"))
def p23(spark, sf):
    return clustered(spark, sf).labelled.select("row_id", F.concat(F.lit("Cluster "), F.col("cluster")).alias("cluster_label"))


@register("p27_without_helper", Q.with_clean("SELECT clean.* FROM clean"))
def p27(spark, sf):
    """Every output column of cleaning: the birth date, a helper, is not among them."""
    return clean(spark, sf, sort=False).table


@register("f08_absent_features", Q.with_clean("SELECT row_id, umur, 0.0::DOUBLE AS gds_2 FROM clean"))
def f08(spark, sf):
    return missing.add_absent(clean(spark, sf, sort=False).table.select("row_id", "umur"), ["umur", "gds_2"])


@register("j08_identity_with_scaled", Q.with_lloyd("SELECT row_id, nik, desa, " + ", ".join(f"{Q.rnd(c, 6)} AS {c}" for c in S_COLS) +
                                                  ", labels.cluster FROM labels JOIN scaled USING (row_id)"))
def j08(spark, sf):
    return clustered(spark, sf).labelled.select("row_id", "nik", "desa", *[F.round(c, 6).alias(c) for c in S_COLS], "cluster")


@register("j09_nearest_final_centre", Q.with_lloyd(
    "SELECT p.row_id, first(c.cluster ORDER BY " + Q.rnd("sqrt(0.0::DOUBLE + " + " + ".join(f"(p.{c} - c.{c}) * (p.{c} - c.{c})" for c in S_COLS) + ")", 4) +
    ", c.cluster) AS cluster FROM scaled p, centres c GROUP BY p.row_id"))
def j09(spark, sf):
    res = clustered(spark, sf)
    return res.labelled.select("row_id", kmeans.nearest_expr(S_COLS, res.centres, 4).alias("cluster"))


@register("j10_silhouette_by_cluster", _eval_sql() + f"\nSELECT own AS label, count(*) AS n, {Q.rnd('avg(s)', 6)} AS silhouette FROM pt GROUP BY own")
def j10(spark, sf):
    pts = metrics.silhouette_points(_emb(spark, sf), metrics.as_vector(array_col="embedding"), "vec_id", "label")
    return pts.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


@register("w01_sorted_output", Q.with_clean("SELECT row_id, row_number() OVER (ORDER BY desa ASC NULLS LAST, kecamatan ASC NULLS LAST, row_id) - 1 AS place FROM clean"))
def w01(spark, sf):
    """The output order with each row's place, so that the order itself is compared."""
    t = clean(spark, sf, sort=False).table
    keys = t.select("row_id", "desa", "kecamatan", F.col("desa").isNull().alias("_d"), F.col("kecamatan").isNull().alias("_k"))
    return stats.global_rank(P.materialize(keys), ["_d", "desa", "_k", "kecamatan", "row_id"], "place").select("row_id", "place")


@register("u02_unmatched_names", "WITH " + Q.raw_cte() + ", " + Q.boundary_cte() +
          f"\nSELECT DISTINCT upper({Q.strip('desa')}) AS name FROM raw WHERE upper({Q.strip('desa')}) NOT IN (SELECT upper({Q.strip('alt_geo')}) FROM village_boundary "
          f"UNION SELECT upper({Q.strip('desa_geo')}) FROM village_boundary)")
def u02(spark, sf):
    """The set difference of J05, over the raw sheets' names."""
    names = raw_screening(spark, sf).select(normalise_village("desa").alias("name")).distinct()
    return villages.villages_without_boundary(names, villages.named(village_boundary(spark, sf)), "name")


@register("k14_centroid_table", Q.with_lloyd("SELECT cluster, 'Cluster ' || cluster AS cluster_label, " +
                                             ", ".join(f"{Q.rnd('s_' + f, 4)} AS {f}" for f in C.FEATURES) + " FROM centres"))
def k14(spark, sf):
    out = kmeans.centres_frame(spark, clustered(spark, sf).centres, C.FEATURES)
    return out.withColumn("cluster", F.col("cluster").cast("int"))


# --- the evaluation of several k on labels that do not depend on a library's seeds ---------
_KS = (2, 3, 4, 5)


def _sweep_sql():
    return " UNION ALL ".join(f"SELECT {k} AS k, * FROM ({_eval_sql(f'(label % {k})::INTEGER')}\nSELECT inertia, silhouette_score, davies_bouldin_index, "
                              f"calinski_harabasz_score FROM ev)" for k in _KS)


def labelling_sweep(spark, sf):
    df = _emb(spark, sf).withColumns({f"k{k}": (F.col("label") % k).cast("int") for k in _KS})
    cols = metrics.as_vector(array_col="embedding")
    rows = clustering.evaluate_labellings(df, cols, "vec_id", {k: f"k{k}" for k in _KS})
    return spark.createDataFrame([(r[0], kmeans.round_half_up(r[1], 2), *r[2:]) for r in rows], clustering.K_SCHEMA)


@register("k05_labelling_sweep", _sweep_sql())
def k05_labels(spark, sf):
    """K05's evaluation: inertia and the three metrics of four labellings, from one silhouette pass."""
    return labelling_sweep(spark, sf)


@register("w04_best_k", f"WITH s AS ({_sweep_sql()})\nSELECT (SELECT k FROM s ORDER BY silhouette_score DESC, k LIMIT 1) AS best_k_silhouette, "
          "(SELECT k FROM s ORDER BY davies_bouldin_index, k LIMIT 1) AS best_k_davies_bouldin, "
          "(SELECT k FROM s ORDER BY calinski_harabasz_score DESC, k LIMIT 1) AS best_k_calinski_harabasz")
def w04(spark, sf):
    return ranking.best_k(labelling_sweep(spark, sf))


@register("k08_pair_ratios", _eval_sql() + f"\nSELECT li AS cluster_i, lj AS cluster_j, {Q.rnd('dij', 6)} AS distance, "
          f"{Q.rnd('(si.s + sj.s) / dij', 4)} AS ratio FROM cd JOIN disp si ON si.label = li JOIN disp sj ON sj.label = lj")
def k08_pairs(spark, sf):
    st = metrics.cluster_stats(_emb(spark, sf), metrics.as_vector(array_col="embedding"), "label")
    return metrics.pair_ratios(st.frame(spark), 4).select("cluster_i", "cluster_j", F.round("distance", 6).alias("distance"), "ratio")
