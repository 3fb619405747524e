"""Registered batch-store, export and streaming queries."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from kohort import config as C
from kohort.checks import sqlfrag as Q
from kohort.functions import text
from kohort.operators import kmeans, sketches
from kohort.plans import preprocessing as P
from kohort.plans.queries_clean import PARAMS, clean
from kohort.plans.queries_cluster import clustered
from kohort.registry import register
from kohort.session import checkpoint_dir
from kohort.sources import exports
from kohort.sources.batches import SUMMARY_COLUMNS, BatchStore
from kohort.streaming.ingest import ingest, landing_frame, reprocess
from kohort.sources.tables import raw_screening, upload_batch


def batch_records(spark, sf):
    """Records of each upload batch: the cleaned values of its district's rows."""
    raw = P.select_raw(raw_screening(spark, sf))
    df = P.encode_categories(P.derive_measures(P.clean_values(raw), PARAMS.as_of_year))
    b = upload_batch(spark, sf).select("batch_id", F.col("kecamatan").alias("_district"))
    # Batch metadata is one row per upload; AQE broadcasts it after measuring it.
    return df.join(b, F.upper(text.strip("kecamatan")) == F.col("_district")).drop("_district")


def batches(spark, sf):
    return upload_batch(spark, sf).withColumn("bulan", text.month_of("filename"))


REC = ",\n".join([Q.raw_cte(), Q.values_cte(), Q.batch_cte(),
                  f"rec AS (SELECT v.*, {Q.enc_sex('v.jenis_kelamin')} AS sex, {Q.age('v.tanggal_lahir')} AS umur, "
                  f"{Q.bmi('v.berat_badan', 'v.tinggi_badan')} AS imt, b.batch_id FROM vals v JOIN upload_batch b "
                  f"ON upper({Q.strip('v.kecamatan')}) = b.kecamatan)"])


def _month_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{m}') THEN '{m.capitalize()}'" for m in C.MONTHS) + " END"


@register("s06_batch_month", "WITH " + Q.batch_cte() +
          f"\nSELECT batch_id, filename, {_month_sql('filename')} AS bulan FROM upload_batch")
def s06(spark, sf):
    return batches(spark, sf).select("batch_id", "filename", "bulan")


def stored(spark, sf, read, with_sketches: bool = False):
    """``read`` of a batch store that was filled from the tables; its result is materialised and
    the store's folder removed."""
    store = BatchStore(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    rec = batch_records(spark, sf)
    version = store.save_records(rec)
    if with_sketches:
        store.save_sketches(version)
    counts = {r["batch_id"]: r for r in rec.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("desa").alias("d")).collect()}
    uploads = upload_batch(spark, sf).collect()     # a row per upload
    store.commit([(u.batch_id, u.filename, datetime.datetime.combine(u.uploaded_on, datetime.time()),
                   counts[u.batch_id].n if u.batch_id in counts else 0, counts[u.batch_id].d if u.batch_id in counts else 0, {}, None) for u in uploads], version)
    out = read(store).checkpoint(eager=True)
    store._remove(store.root)
    return out


def _day():
    return F.to_date("uploaded_at").alias("uploaded_on")


@register("s05_batch_metadata", "WITH " + REC +
          f"\nSELECT b.batch_id, b.filename, {_month_sql('b.filename')} AS bulan, count(r.batch_id) AS total_rows, "
          "count(DISTINCT r.desa) AS total_desa, 'success' AS status FROM upload_batch b LEFT JOIN rec r USING (batch_id) "
          "GROUP BY b.batch_id, b.filename")
def s05(spark, sf):
    return stored(spark, sf, lambda s: s.batches().select("batch_id", "filename", "bulan", "total_rows", "total_desa", "status"))


@register("s08_latest_batch", "WITH " + Q.batch_cte() +
          "\nSELECT batch_id, filename, uploaded_on FROM upload_batch ORDER BY uploaded_on DESC, batch_id DESC LIMIT 1")
def s08(spark, sf):
    return stored(spark, sf, lambda s: s.latest_batch().select("batch_id", "filename", _day()))


@register("s09_list_batches", "WITH " + Q.batch_cte() +
          "\nSELECT batch_id, filename, uploaded_on, row_number() OVER (ORDER BY uploaded_on DESC) AS place FROM upload_batch")
def s09(spark, sf):
    """The list with each row's place, so that the order is compared (one row per upload)."""
    return stored(spark, sf, lambda s: s.all_batches().select("batch_id", "filename", _day(), F.monotonically_increasing_id().alias("_m"))
                  .withColumn("place", F.row_number().over(Window.orderBy("_m"))).drop("_m"))


@register("s10_batch_records", "WITH " + REC + "\nSELECT row_id, desa, nik, batch_id FROM rec WHERE batch_id = 3")
def s10(spark, sf):
    return stored(spark, sf, lambda s: s.batch(3).select("row_id", "desa", "nik", "batch_id"))


@register("s11_village_records", "WITH " + REC +
          "\nSELECT row_id, desa, batch_id FROM rec WHERE desa = 'NATION_2' AND batch_id = 3")
def s11(spark, sf):
    return stored(spark, sf, lambda s: s.village("NATION_2", 3).select("row_id", "desa", "batch_id"))


@register("s12_delete_batch_survivors", "WITH " + REC +
          "\nSELECT batch_id, count(*) AS n FROM rec WHERE batch_id IN (SELECT batch_id FROM upload_batch "
          "WHERE batch_id <> 2) GROUP BY batch_id")
def s12(spark, sf):
    def read(store):
        store.delete_batch(2)
        return store.records().groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    return stored(spark, sf, read)


@register("a06_batch_summary", "WITH " + REC +
          ",\nlatest AS (SELECT batch_id FROM upload_batch ORDER BY uploaded_on DESC, batch_id DESC LIMIT 1)"
          "\nSELECT batch_id, count(*) AS total_lansia, count(DISTINCT desa) AS total_desa, "
          "count(*) FILTER (WHERE sex = 1) AS laki_laki, count(*) FILTER (WHERE sex = 0) AS perempuan "
          "FROM rec WHERE batch_id IN (SELECT batch_id FROM latest) GROUP BY batch_id")
def a06(spark, sf):
    return stored(spark, sf, lambda s: s.summary())


@register("a17_upload_history", "WITH " + Q.batch_cte() +
          "\nSELECT filename, first(batch_id ORDER BY uploaded_on, batch_id) AS batch_id FROM upload_batch GROUP BY filename")
def a17(spark, sf):
    return upload_batch(spark, sf).groupBy("filename").agg(
        F.min_by("batch_id", F.struct("uploaded_on", "batch_id")).alias("batch_id"))


def _exported(spark, df):
    """The village parts as the export wrote them; the folder is removed once they are materialised."""
    path = f"{checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    exports.write_table(df, path)
    out = exports.read_table(spark, path, df.schema, per_village=True).checkpoint(eager=True)
    BatchStore(spark, path)._remove(path)
    return out


@register("s13_village_export_parts", Q.with_clean(
    "SELECT row_id, desa, substring(desa, 1, 31) AS part FROM clean WHERE desa IS NOT NULL"))
def s13(spark, sf):
    return _exported(spark, clean(spark, sf, sort=False).table).select("row_id", "desa", "part")


def _gis_cols():
    cols = [c for c in C.GIS_EXPORT_COLUMNS if c in Q.CLEAN_COLUMNS + C.FEATURES + ["cluster", "cluster_label"]]
    return ", ".join("'Cluster ' || cluster AS cluster_label" if c == "cluster_label" else c for c in cols)


@register("s17_gis_export", Q.with_lloyd(f"SELECT row_id, {_gis_cols()} FROM result"))
def s17(spark, sf):
    res = clustered(spark, sf).labelled.withColumn("cluster_label", F.concat(F.lit("Cluster "), F.col("cluster")))
    return res.select("row_id", *exports.gis_projection(res).columns)


@register("s18_report_dataset", Q.with_lloyd(
    "SELECT row_id, nama, nik, desa, umur, CASE jenis_kelamin WHEN 1 THEN 'Laki-laki' WHEN 0 THEN 'Perempuan' END "
    "AS jenis_kelamin, imt, sistolik, diastolik, cluster, 'Cluster ' || cluster AS cluster_label, kecamatan, "
    "kolesterol FROM result"))
def s18(spark, sf):
    res = clustered(spark, sf).labelled.withColumn("cluster_label", F.concat(F.lit("Cluster "), F.col("cluster")))
    rep = exports.report_dataset(res.select("row_id", *C.REPORT_FIRST_COLUMNS, "kecamatan", "kolesterol"))
    return rep


@register("s21_validation_summary", Q.with_clean(
    "SELECT name, value FROM (SELECT 1::BIGINT AS sheets_diproses, (SELECT count(*) FROM raw) AS total_baris_mentah, "
    "count(*) AS total_valid, (SELECT count(*) FROM raw) - count(*) AS baris_dihapus, "
    "count(*) FILTER (WHERE umur IS NULL) AS umur_invalid, count(*) FILTER (WHERE imt IS NULL) AS imt_invalid, "
    "count(*) FILTER (WHERE sistolik IS NULL) AS td_invalid FROM clean) "
    "UNPIVOT (value FOR name IN (sheets_diproses, total_baris_mentah, total_valid, baris_dihapus, umur_invalid, "
    "imt_invalid, td_invalid))"))
def s21(spark, sf):
    return exports.validation_summary(clean(spark, sf, sort=False).stats())


_PER_FILE = Q.with_clean("SELECT " + ", ".join(Q.CLEAN_COLUMNS) + " FROM clean").replace(
    "FROM vals QUALIFY", f"FROM vals WHERE upper({Q.strip('kecamatan')}) = '{Q.DISTRICT}' QUALIFY")


PART_ROWS = 200_000     # rows of a landed part file


def _landed(spark, sf, read):
    """Each district's rows land as one uploaded sheet of part files with the original headers; ``read`` of (stream's
    store, folder) is materialised and the folder removed."""
    base = f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    sheet = landing_frame(raw_screening(spark, sf))
    district = F.upper(text.strip("`Kecamatan Domisili`")).alias("sheet")
    # an upload is a folder of part files, so a large district is written and read by several tasks
    (sheet.select("*", district).hint("rebalance", "sheet").write.partitionBy("sheet").option("header", True)
     .option("maxRecordsPerFile", PART_ROWS).csv(f"{base}/landing"))
    store = ingest(spark, f"{base}/landing/*", f"{base}/store", f"{base}/ckpt", PARAMS, folders=True)
    out = read(store, base).checkpoint(eager=True)
    store._remove(base)
    return out


@register("t01_stream_ingest", _PER_FILE)
def t01(spark, sf):
    """Every sheet is cleaned on its own; only the wanted district's has rows left."""
    return _landed(spark, sf, lambda store, base: store.records().select(*Q.CLEAN_COLUMNS))


@register("t02_reprocess", Q.with_clean("SELECT " + ", ".join(Q.CLEAN_COLUMNS) + " FROM clean"))
def t02(spark, sf):
    """The stored district's batch cleaned again, from the whole sheet, in place."""
    def read(store, base):
        bid = store.batches().where("total_rows > 0").first().batch_id
        assert reprocess(spark, store, raw_screening(spark, sf), "again.csv", PARAMS, replace=bid) == bid
        return store.batch(bid).select(*Q.CLEAN_COLUMNS)
    return _landed(spark, sf, read)


@register("s14_cluster_export_parts", Q.with_lloyd(
    "SELECT row_id, desa, substring(desa, 1, 31) AS part, cluster, 'Cluster ' || cluster AS cluster_label "
    "FROM result WHERE desa IS NOT NULL"))
def s14(spark, sf):
    res = clustered(spark, sf).labelled.withColumn("cluster_label", F.concat(F.lit("Cluster "), F.col("cluster")))
    return _exported(spark, res).select("row_id", "desa", "part", "cluster", "cluster_label")


@register("s14_cluster_export_centroids", Q.with_lloyd("SELECT cluster, 'Cluster ' || cluster AS cluster_label, " +
                                                       ", ".join(f"{Q.rnd('s_' + f, 4)} AS {f}" for f in C.FEATURES) + " FROM centres"))
def s14_centroids(spark, sf):
    """The centroid table as the clustered export wrote it beside the rows."""
    res = clustered(spark, sf)
    centroids = kmeans.centres_frame(spark, res.centres, C.FEATURES).withColumn("cluster", F.col("cluster").cast("int"))
    path = f"{checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    exports.write_clusters(res.labelled, centroids, path, per_village=False)
    out = exports.read_centroids(spark, path, centroids.schema).checkpoint(eager=True)
    BatchStore(spark, path)._remove(path)
    return out


def _console_sql(x: str, table, higher: bool) -> str:
    whens = " ".join(f"WHEN {x} {'>=' if higher else '<='} {cut} THEN '{t}'" for cut, t in table if cut is not None)
    return f"CASE {whens} ELSE '{table[-1][1]}' END"


def _s20_sql():
    from kohort.plans.queries_cluster import _eval_sql
    return (_eval_sql() + "\nSELECT d.label, d.n, silhouette_score, davies_bouldin_index, calinski_harabasz_score, "
            f"inertia, {_console_sql('silhouette_score', C.CONSOLE_SILHOUETTE, True)} AS silhouette_quality, "
            f"{_console_sql('davies_bouldin_index', C.CONSOLE_DBI, False)} AS dbi_quality FROM ev, disp d")


@register("s20_evaluation_report", _s20_sql())
def s20(spark, sf):
    """Metrics, console quality bands and people per cluster (embeddings with their labels)."""
    from kohort.functions.risk import console_band
    from kohort.plans.queries_cluster import _emb, k06
    ev = k06(spark, sf)
    sizes = _emb(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    row = ev.select("*", console_band("silhouette_score", "silhouette").alias("silhouette_quality"),
                    console_band("davies_bouldin_index", "dbi").alias("dbi_quality")).first()   # one row
    return sizes.withColumns({k: F.lit(v) for k, v in row.asDict().items()})


_LATEST = ",\nlatest AS (SELECT batch_id FROM upload_batch ORDER BY uploaded_on DESC, batch_id DESC LIMIT 1)"


@register("a06_batch_village_counts", "WITH " + REC + _LATEST +
          "\nSELECT desa, count(*) AS n FROM rec WHERE batch_id IN (SELECT batch_id FROM latest) "
          "AND desa IS NOT NULL GROUP BY desa")
def a06_villages(spark, sf):
    return stored(spark, sf, lambda s: s.village_counts())


@register("a06_batch_describe", "WITH " + REC + _LATEST +
          ",\nlr AS (SELECT * FROM rec WHERE batch_id IN (SELECT batch_id FROM latest))\nSELECT * FROM (" +
          " UNION ALL ".join(
              f"SELECT '{c}' AS \"column\", count({c}) AS count, {Q.rnd(f'avg({c})', 2)} AS mean, "
              f"{Q.rnd(f'stddev_samp({c})', 2)} AS std, {Q.rnd(f'min({c})', 2)} AS min, "
              f"{Q.rnd(f'max({c})', 2)} AS max, {Q.rnd(f'quantile_cont({c}, 0.5)', 2)} AS median FROM lr"
              for c in SUMMARY_COLUMNS) + ") WHERE count > 0")
def a06_describe(spark, sf):
    return stored(spark, sf, lambda s: s.describe())


@register("j07_latest_batch_records", "WITH " + REC + _LATEST + "\nSELECT row_id, desa FROM rec WHERE batch_id IN (SELECT batch_id FROM latest)")
def j07(spark, sf):
    return stored(spark, sf, lambda s: s.people().select("row_id", "desa"))


# --- statistics of all batches from their sketches ---------------------------------------
_QS = (0.25, 0.5, 0.75)


@register("a06_sketch_describe", "WITH " + REC + "\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {Q.rnd(f'avg({c})', 2)} AS mean, {Q.rnd(f'stddev_samp({c})', 2)} AS std, "
    f"{Q.rnd(f'min({c})', 2)} AS min, {Q.rnd(f'max({c})', 2)} AS max FROM rec" for c in SUMMARY_COLUMNS) + ") WHERE count > 0")
def a06_sketch_describe(spark, sf):
    """The exact part of all batches' merged statistics."""
    return stored(spark, sf, lambda s: sketches.describe(s.merged_sketches()).drop("median", "rank_error"), with_sketches=True)


@register("a06_sketch_quantiles", "WITH " + REC + "\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS q, count({c}) AS n, true AS within FROM rec" for c in SUMMARY_COLUMNS for q in _QS) +
    ") WHERE n > 0 UNION ALL SELECT 'desa', NULL, count(desa), true FROM rec")
def a06_sketch_quantiles(spark, sf):
    """Quartiles of all batches from merged sketches: whether each one's true rank among the records
    is off by at most twice the stated error; and the distinct villages, by three times theirs."""
    def read(store):
        rows = store.merged_sketches()
        records = store.records()
        out = []
        for r in sketches.quantiles(rows, list(_QS)).collect():     # three rows a measure
            x = F.col(r["column"])
            out.append((r["column"], r.q, r.n, r.value, F.count_if(x < r.value), F.count_if(x <= r.value), r.rank_error))
        villages = sketches.distinct_counts(rows).first()
        seen = records.agg(F.count_distinct("desa"), *[a for o in out for a in o[4:6]]).first()
        data = [(c, q, n, bool(seen[1 + 2 * i] / n - 2 * e <= q <= seen[2 + 2 * i] / n + 2 * e)) for i, (c, q, n, _, _, _, e) in enumerate(out)]
        data.append(("desa", None, villages.n, abs(villages.distinct - seen[0]) <= max(1, 3 * villages.relative_error * seen[0])))
        return spark.createDataFrame(data, "column string, q double, n long, within boolean")
    return stored(spark, sf, read, with_sketches=True)
