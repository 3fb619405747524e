"""Batch store (S05-S12), exports and the streaming ingest."""

import json
import tempfile

from pyspark.sql import functions as F

from kohort import config as C
from kohort.plans.preprocessing import clean_screening
from kohort.sources import exports, geo
from kohort.sources.batches import BatchStore
from kohort.sources.tables import raw_screening
from kohort.checks.compare import rows_key
from kohort.streaming.ingest import ingest, landing_frame, reprocess
from tests.conftest import SF001

PARAMS = C.CleanParams(district="ASIA", as_of_year=2025)


def test_store_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="kohort-store-")
    store = BatchStore(spark, root)
    res = clean_screening(raw_screening(spark, SF001), PARAMS, sort=False)
    stats = res.stats().first().asDict()
    b1 = store.save_result(res.table, stats, "laporan_maret_2026.csv")
    b2 = store.save_result(res.table, stats, "laporan_april.csv")
    assert (b1, b2) == (1, 2)
    meta = {r.batch_id: r for r in store.all_batches().collect()}
    assert meta[1].bulan == "Maret" and meta[2].bulan == "April" and meta[1].status == "success"
    assert meta[1].total_rows == res.table.count() and meta[1].stats["total_valid"] == stats["total_valid"]
    assert store.latest_batch().first().batch_id == 2
    assert store.batch(1).count() == res.table.count()
    assert store.delete_batch(1) is True and store.delete_batch(99) is False
    assert [r.batch_id for r in store.all_batches().collect()] == [2]
    assert store.records().select("batch_id").distinct().collect()[0][0] == 2
    # retrying a batch replaces its partition instead of duplicating it
    store.save_result(res.table, stats, "laporan_april.csv", batch_id=2)
    assert store.batch(2).count() == res.table.count()
    assert reprocess(spark, store, raw_screening(spark, SF001), "again.csv", PARAMS) == 3


def test_stream_ingest_equals_per_file_cleaning(spark):
    base = tempfile.mkdtemp(prefix="kohort-stream-")
    raw = landing_frame(raw_screening(spark, SF001))
    raw.coalesce(1).write.option("header", True).csv(f"{base}/landing")
    store = ingest(spark, f"{base}/landing", f"{base}/store", f"{base}/ckpt", PARAMS)
    table = clean_screening(raw_screening(spark, SF001), PARAMS, sort=False).table
    expected = table.count()
    got = store.records().select(*table.columns)
    assert rows_key([tuple(r) for r in got.collect()], got.columns) == \
        rows_key([tuple(r) for r in table.collect()], table.columns)
    # a second run finds nothing new (checkpointed) and leaves the store unchanged
    ingest(spark, f"{base}/landing", f"{base}/store", f"{base}/ckpt", PARAMS)
    assert store.records().count() == expected


def test_exports(spark):
    df = spark.createDataFrame([(1, "A" * 40, 1), (2, None, 0)], "row_id long, desa string, jenis_kelamin int")
    parts = exports.village_parts(df).collect()
    assert len(parts) == 1 and len(parts[0].part) == 31
    rep = exports.report_dataset(df.withColumn("nama", F.lit("x")))
    assert rep.columns[:3] == ["nama", "desa", "jenis_kelamin"]
    assert [r.jenis_kelamin for r in rep.orderBy("row_id").collect()] == ["Laki-laki", "Perempuan"]


def test_export_sink(spark):
    path = tempfile.mkdtemp(prefix="kohort-export-")
    df = spark.createDataFrame([(1, "7", "x"), (2, None, "y"), (3, "B C", "z"), (4, "7", "w")], "row_id long, desa string, nama string")
    for fmt in ("parquet", "csv"):
        exports.write_table(df, f"{path}/{fmt}", fmt)
        assert exports.read_table(spark, f"{path}/{fmt}", df.schema, fmt).count() == 4
        parts = exports.read_table(spark, f"{path}/{fmt}", df.schema, fmt, per_village=True).collect()
        assert sorted((r.row_id, r.part) for r in parts) == [(1, "7"), (3, "B C"), (4, "7")]


def test_geojson_and_coordinates(spark):
    d = tempfile.mkdtemp(prefix="kohort-geo-")
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"DESA": "Suger Lor", "DESKEL u_7": "SUGERLOR"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}},
        {"type": "Feature", "properties": {"DESA": "Maesan", "DESKEL u_7": None},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[1, 1], [3, 1], [1, 1]]]]}}]}
    with open(f"{d}/b.geojson", "w") as fh:
        json.dump(fc, fh)
    rows = geo.read_geojson_boundaries(spark, f"{d}/b.geojson").orderBy("desa_geo").collect()
    assert [(r.desa_geo, r.lat, r.lon) for r in rows] == [("Maesan", 1.0, 5 / 3), ("Suger Lor", 0.5, 1.0)]
    with open(f"{d}/c.json", "w") as fh:
        json.dump({"MAESAN": {"latitude": -8.02, "longitude": 113.76}}, fh)
    c = geo.read_coordinates(spark, f"{d}/c.json").collect()
    assert [(r.desa, r.latitude) for r in c] == [("MAESAN", -8.02)]


def _sheet(spark, raw, path, headers="original"):
    """Writes raw as one CSV file below ``path`` and returns its rows."""
    df = landing_frame(raw) if headers == "original" else raw.select(*reversed(raw.columns))
    df.coalesce(1).write.option("header", True).csv(path)
    return raw


def test_stream_keeps_stored_batches_and_reads_any_headers(spark):
    base = tempfile.mkdtemp(prefix="kohort-stream-many-")
    raw = raw_screening(spark, SF001)
    store = BatchStore(spark, f"{base}/store")
    first = clean_screening(raw.where("row_id % 2 = 0"), PARAMS, sort=False)
    assert store.save_result(first.table, first.stats().first().asDict(), "a.csv") == 1
    halves = {"x": raw.where("row_id % 2 = 1"), "y": raw.where("row_id % 3 = 1")}
    _sheet(spark, halves["x"], f"{base}/landing/x")
    _sheet(spark, halves["y"], f"{base}/landing/y", "snake")
    ingest(spark, f"{base}/landing/*", f"{base}/store", f"{base}/ckpt", PARAMS)
    meta = {r.batch_id: r for r in store.batches().collect()}
    assert sorted(meta) == [1, 2, 3] and meta[1].filename == "a.csv" and meta[1].origin is None
    assert store.batch(1).count() == first.table.count()
    want = {clean_screening(h, PARAMS, sort=False).table.count() for h in halves.values()}
    assert {store.batch(2).count(), store.batch(3).count()} == want == {meta[2].total_rows, meta[3].total_rows}
    # a fresh checkpoint of the same stream replaces its own batches, a stream of another name adds
    ingest(spark, f"{base}/landing/*", f"{base}/store", f"{base}/ckpt2", PARAMS, stream=f"{base}/ckpt")
    assert sorted(r.batch_id for r in store.batches().collect()) == [1, 2, 3] and {store.batch(2).count(), store.batch(3).count()} == want
    ingest(spark, f"{base}/landing/*", f"{base}/store", f"{base}/ckpt3", PARAMS, max_files_per_trigger=1)
    assert store.batches().count() == 5 and store.batch(1).count() == first.table.count()


def test_batches_with_different_columns_keep_all(spark):
    store = BatchStore(spark, tempfile.mkdtemp(prefix="kohort-store-cols-"))
    store.save_result(spark.createDataFrame([(1, "A", float("nan"))], "row_id long, desa string, gdp double"), {}, "a.csv")
    store.save_result(spark.createDataFrame([(2, "B", 9.0, "x")], "row_id long, desa string, gds_2 double, other string"), {}, "b.csv")
    assert sorted((r.batch_id, r.gdp, r.gds_2) for r in store.records().collect()) == [(1, None, None), (2, None, 9.0)]
    assert store.next_id() == 3 and store.claim() == 3 and store.claim() == 4


def test_uncommitted_records_are_invisible(spark):
    store = BatchStore(spark, tempfile.mkdtemp(prefix="kohort-store-open-"))
    version = store.save_records(spark.createDataFrame([(1, "A", 7)], "row_id long, desa string, batch_id int"))
    assert store.records().count() == 0
    store.commit([(7, "a.csv", None, 1, 1, {}, None)], version)
    assert store.records().count() == 1 and store.delete_batch(7) and store.records().count() == 0 and not store.delete_batch(7)


def test_replaced_batch_is_never_empty(spark):
    store = BatchStore(spark, tempfile.mkdtemp(prefix="kohort-store-crash-"))
    schema = "row_id long, desa string, batch_id int"
    bid = store.save_result(spark.createDataFrame([(1, "A"), (2, "B")], "row_id long, desa string"), {}, "a.csv")
    # a crash between the two writes: the new records are there, nothing names them
    version = store.save_records(spark.createDataFrame([(3, "C", bid)], schema))
    assert sorted(r.row_id for r in store.records().collect()) == [1, 2]
    assert store.vacuum() == 1 and store.vacuum() == 0 and store.records().count() == 2 and store.merged_sketches().count() == 1
    # a crash before the old version goes: the newest row decides
    version = store.save_records(spark.createDataFrame([(4, "D", bid)], schema))
    store.commit([(bid, "a.csv", None, 1, 1, {}, None)], version)
    assert [r.row_id for r in store.records().collect()] == [4] and store.batches().count() == 1
    # the next write clears all older versions; a batch may become empty
    assert store.save_result(spark.createDataFrame([], "row_id long, desa string"), {}, "a.csv", batch_id=bid) == bid
    assert store.records().count() == 0 and store.batches().first().total_rows == 0 and store._rows().count() == 1 and store.vacuum() == 0


def test_large_batches_are_written_by_several_tasks(spark):
    store = BatchStore(spark, tempfile.mkdtemp(prefix="kohort-store-deal-"))
    df = spark.range(0, 200_000, 1, 16).selectExpr("id AS row_id", "concat('V', id % 50) AS desa", "md5(cast(id AS string)) AS nik", "IF(id < 10, 2, 1) AS batch_id")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
        version = store.save_records(df)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    store.commit([(b, "a.csv", None, 0, 0, {}, None) for b in (1, 2)], version)
    files = {r.batch_id: r.n for r in spark.read.parquet(store.records_path).select("batch_id", F.input_file_name().alias("f")).groupBy("batch_id").agg(F.count_distinct("f").alias("n")).collect()}
    assert files[2] == 1 and 2 <= files[1] <= 16
    assert store.batch(1).count() == 199_990 and store.batch(2).count() == 10


def test_ids_are_claimed_at_once(spark):
    store = BatchStore(spark, tempfile.mkdtemp(prefix="kohort-store-claims-"))
    assert store.claim_many(0) == [] and store.claim_many(3) == [1, 2, 3] and store.claim() == 4 and store.claim_many(2) == [5, 6]


def test_summary_of_the_latest_batch(spark):
    store = BatchStore(spark, tempfile.mkdtemp(prefix="kohort-store-sum-"))
    assert store.summary().collect() == [] and store.village_counts().collect() == [] and store.people().collect() == []
    schema = "row_id long, desa string, jenis_kelamin int, umur double"
    store.save_result(spark.createDataFrame([(1, "A", 1, 60.0)], schema), {}, "a.csv")
    store.save_result(spark.createDataFrame([(1, "A", 1, 60.0), (2, "B", 0, 70.0), (3, None, None, None)], schema), {}, "b.csv")
    assert [tuple(r) for r in store.summary().collect()] == [(2, 3, 2, 1, 1)] and [tuple(r) for r in store.summary(1).collect()] == [(1, 1, 1, 1, 0)]
    assert sorted((r.desa, r.n) for r in store.village_counts().collect()) == [("A", 1), ("B", 1)]
    assert [(r["column"], r["count"], r["median"]) for r in store.describe().collect()] == [("umur", 2, 65.0)]
    assert store.summary(99).collect() == []


def test_sketches_merge_to_those_of_the_union(spark):
    from kohort.operators import missing, sketches
    store = BatchStore(spark, tempfile.mkdtemp(prefix="kohort-store-sk-"))
    assert store.merged_sketches().collect() == []
    n, edges = 60_000, (0, 20_000, 20_007, 60_000)      # batches of very different sizes
    people = spark.range(n).selectExpr("id AS row_id", "IF(id % 10 = 0, NULL, concat('V', id % 300)) AS desa",
                                       "IF(id % 7 = 0, NULL, pow(id % 1000, 2)) AS umur", "CAST(NULL AS double) AS imt", "5.0D AS gds_1")
    for a, b in zip(edges, edges[1:]):
        store.save_result(people.where(f"row_id >= {a} AND row_id < {b}"), {}, "a.csv")
    rows = store.merged_sketches()
    by = {r["column"]: r for r in sketches.describe(rows).collect()}
    want = people.agg(F.count("umur"), F.round(F.avg("umur"), 2), F.round(F.stddev_samp("umur"), 2), F.min("umur"), F.max("umur")).first()
    assert set(by) == {"umur", "gds_1"} and tuple(by["umur"])[1:6] == tuple(want) and tuple(by["gds_1"])[1:7] == (n, 5.0, 0.0, 5.0, 5.0, 5.0)
    for r in sketches.quantiles(rows, [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]).where("column = 'umur'").collect():
        below, upto = people.agg(F.count_if(F.col("umur") < r.value), F.count_if(F.col("umur") <= r.value)).first()
        assert below / r.n - 2 * r.rank_error <= r.q <= upto / r.n + 2 * r.rank_error
    d = sketches.distinct_counts(rows).first()
    assert d["column"] == "desa" and d.n == n * 9 // 10 and abs(d.distinct - 270) <= 3 * d.relative_error * 270
    q = {r.q: r.value for r in sketches.quantiles(rows, [0.25, 0.75]).where("column = 'gds_1'").collect()}
    # some of the batches; a replaced or deleted batch takes its statistics along
    assert {r["column"]: r.n for r in store.merged_sketches([2]).collect()} == {"umur": 6, "gds_1": 7, "desa": 6}
    store.save_result(people.where("row_id < 3"), {}, "a.csv", batch_id=1)
    store.delete_batch(3)
    assert {r["column"]: r.n for r in store.merged_sketches().collect()}["gds_1"] == 10
    assert missing.iqr_outlier_flags(people.limit(5).withColumn("gds_1", F.lit(6.0)), ["gds_1"], quartiles={"gds_1": (q[0.25], q[0.75])}).where("gds_1_outlier").count() == 5


def test_folders_of_part_files_are_uploads(spark):
    base = tempfile.mkdtemp(prefix="kohort-stream-parts-")
    raw = raw_screening(spark, SF001)
    halves = {"x": raw.where("row_id % 2 = 1"), "y": raw.where("row_id % 3 = 1")}
    for name, half in halves.items():
        landing_frame(half).repartition(5).write.option("header", True).csv(f"{base}/landing/{name}.csv")
    # three files a micro-batch: a folder's parts meet in several, its batch is whole at the end
    store = ingest(spark, f"{base}/landing/*", f"{base}/store", f"{base}/ckpt", PARAMS, folders=True, max_files_per_trigger=3)
    meta = {r.filename: r for r in store.batches().collect()}
    assert sorted(meta) == ["x.csv", "y.csv"] and sorted(r.batch_id for r in meta.values()) == [1, 2]
    for name, half in halves.items():
        want = clean_screening(half, PARAMS, sort=False).table
        cols = [c for c in want.columns]
        got = store.batch(meta[f"{name}.csv"].batch_id).select(*cols)
        assert rows_key([tuple(r) for r in got.collect()], cols) == rows_key([tuple(r) for r in want.collect()], cols)
    assert store.vacuum() == 0


def test_centroids_are_exported(spark):
    path = tempfile.mkdtemp(prefix="kohort-export-c-")
    df = spark.createDataFrame([(1, "7", 0), (2, "8", 1)], "row_id long, desa string, cluster int")
    centroids = spark.createDataFrame([(0, "Cluster 0", 0.5), (1, "Cluster 1", 0.25)], "cluster int, cluster_label string, umur double")
    for fmt in ("parquet", "csv"):
        exports.write_clusters(df, centroids, f"{path}/{fmt}", fmt)
        assert sorted(map(tuple, exports.read_centroids(spark, f"{path}/{fmt}", centroids.schema, fmt).collect())) == sorted(map(tuple, centroids.collect()))
        assert exports.read_table(spark, f"{path}/{fmt}", df.schema, fmt, per_village=True).count() == 2


def test_risk_score_ignores_refilled_features(spark):
    from kohort.operators import ranking
    means = spark.createDataFrame([(0, 80.0, 0.0), (1, 50.0, 0.0)], "cluster int, umur double, imt double")
    assert {r.cluster: r.risk_score for r in ranking.rank_clusters(means).collect()} == {0: 4.0, 1: 2.0}
    assert {r.cluster: r.risk_score for r in ranking.rank_clusters(means, filled=("imt",)).collect()} == {0: 2.0, 1: 0.0}


def test_uploads_in_one_plan_equal_single_uploads(spark):
    raw = raw_screening(spark, SF001)
    parts = {1: raw, 2: raw.where("gds_2 IS NOT NULL"), 3: raw.where("row_id % 7 = 0"), 4: raw.where("kecamatan = 'AFRICA'")}
    both = None
    for k, p in parts.items():
        p = p.withColumn("batch_id", F.lit(k))
        both = p if both is None else both.unionByName(p)
    from kohort.plans.preprocessing import clean_uploads
    # row_id must be unique over the sheets
    table, counters = clean_uploads(both.withColumn("row_id", F.col("row_id") * 10 + F.col("batch_id")), PARAMS, "batch_id")
    stats = {r.batch_id: r.asDict() for r in counters.collect()}
    for k, p in parts.items():
        res = clean_screening(p, PARAMS, sort=False)
        cols = [c for c in res.table.columns if c != "row_id"]
        one = rows_key([tuple(r) for r in res.table.select(*cols).collect()], cols)
        assert rows_key([tuple(r) for r in table.where(F.col("batch_id") == k).select(*cols).collect()], cols) == one
        want = res.stats().first().asDict()
        assert {n: stats[k][n] for n in want} == want
        gone = [c for c in res.dropped_columns]
        assert not gone or max(table.where(F.col("batch_id") == k).agg(*[F.count(c) for c in gone]).first()) == 0


def test_row_order_follows_path_and_place(spark):
    from kohort.sources.screening import read_screening
    base = tempfile.mkdtemp(prefix="kohort-order-")
    raw = landing_frame(raw_screening(spark, SF001).orderBy("row_id")).drop("row_id")
    for name, n in (("part1", 10), ("part2", 390)):
        raw.limit(n).coalesce(1).write.option("header", True).csv(f"{base}/{name}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        seen = []
        for size in (old, "4096b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = read_screening(spark, [f"{base}/part1", f"{base}/part2"])
            rows = sorted((r.row_id, r.nik) for r in df.collect())
            assert [i for i, _ in rows] == list(range(400))
            seen.append(rows)
        assert seen[0] == seen[1] and [n for _, n in seen[0][:10]] == [n for _, n in seen[0][10:20]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_birth_date_formats(spark):
    from kohort.functions.measures import parse_date
    df = spark.createDataFrame([("1950-06-15",), ("15/06/1950",), ("15-06-1950",), ("31/02/1950",), ("x",), (None,)], "d string")
    got = [str(r.p) for r in df.select(parse_date("d").alias("p")).collect()]
    assert got == ["1950-06-15"] * 3 + ["None"] * 3
    assert df.select(parse_date("d", ("iso",)).alias("p")).where("p IS NOT NULL").count() == 1
