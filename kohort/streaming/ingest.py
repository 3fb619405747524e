"""Incremental upload ingest with Structured Streaming.

Each new upload in the landing folder becomes one batch, cleaned as for a single upload
(dedup and missing-data decisions look at one upload only), but all uploads of a micro-batch go
through one plan and one write. An upload is a file, or (``folders``) a folder of part files,
which several tasks write and read; a folder whose parts arrive in several micro-batches keeps
its batch id and is read whole each time, so its last part completes it. The stream itself carries file names; the sheets are read by
their headers, original or snake_case, in any order of columns. ``availableNow`` processes
whatever has landed and stops; the checkpoint makes a restarted query skip committed files.
Batch ids are claimed from the store, once per micro-batch, and a batch remembers the stream
and upload it came from: a re-run epoch finds its ids and replaces its own batches, which show
their former records until the new ones are committed; other batches stay.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort import config as C
from kohort.plans.preprocessing import clean_screening, clean_uploads
from kohort.sources.batches import BatchStore, now
from kohort.sources.screening import read_sheets

COUNTERS = ("total_baris_mentah", "total_valid", "baris_dihapus", "sheets_diproses", "umur_invalid", "imt_invalid", "td_invalid")


def landing_frame(raw: DataFrame) -> DataFrame:
    """A raw sheet as users have it: the original headers, in sheet order, and its row numbers."""
    return raw.select("row_id", *[F.col(c).alias(h) for h, c in C.HEADER_MAP.items()])


def _parts(store: BatchStore, folder: str) -> list[str]:
    """The visible files of an upload's folder, in order of path, as URIs like the folder's."""
    jvm = store.spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
    fs = at.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().toUri().getRawPath().rsplit("/", 1)[-1] for f in fs.listStatus(at) if f.isFile())
    return [f"{folder}/{n}" for n in names if n[0] not in "_."]


def save_uploads(store: BatchStore, uploads: list[str], stream: str, params: C.CleanParams, fmt: str = "csv", folders: bool = False) -> None:
    """Clean and store the uploads (files, or folders of part files), one batch each: one plan, one
    write of a fresh version, then the commit. A crash before the commit changes no visible batch."""
    spark = store.spark
    origin = {u: f"{stream}:{u}" for u in uploads}
    known = store.ids_of(list(origin.values()))
    fresh = iter(store.claim_many(sum(o not in known for o in origin.values())))
    ids = {u: known.get(o) or next(fresh) for u, o in origin.items()}
    upload = F.regexp_replace("_file", "/[^/]*$", "") if folders else F.col("_file")
    number = F.element_at(F.create_map(*[x for u in uploads for x in (F.lit(u), F.lit(ids[u]))]), upload)
    raw = read_sheets(spark, [_parts(store, u) if folders else [u] for u in uploads], fmt).withColumn("batch_id", number).drop("_file")
    table, counters = clean_uploads(raw, params, "batch_id")
    version = store.save_records(table)
    store.save_sketches(version)
    got = {r["batch_id"]: r.asDict() for r in counters.collect()}   # a row per upload of the micro-batch
    empty = dict.fromkeys((*COUNTERS, "total_desa"), 0) | {"sheets_diproses": 1}
    rows = []
    for u in uploads:
        c = got.get(ids[u], empty)
        rows.append((ids[u], unquote(u.rsplit("/", 1)[-1]), now(), int(c["total_valid"]), int(c["total_desa"]), {k: int(c[k]) for k in COUNTERS}, origin[u]))
    store.commit(rows, version, replaced=bool(known))


def ingest(spark: SparkSession, landing: str, store_root: str, checkpoint: str,
           params: C.CleanParams = C.CleanParams(), fmt: str = "csv", stream: str | None = None,
           max_files_per_trigger: int = 100, folders: bool = False):
    """Run the ingest stream until the landing folder is drained; returns the store.
    ``max_files_per_trigger`` bounds each micro-batch (and the file list it handles);
    ``stream`` names the stream in the batches' origin (default: its checkpoint); with
    ``folders`` the files of one folder are one upload."""
    store = BatchStore(spark, store_root)
    # only the paths are read here: the unused content column is pruned from the scan
    files = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile")
             .option("maxFilesPerTrigger", max_files_per_trigger).load(landing).select(F.col("_metadata.file_path").alias("path")))

    def per_epoch(batch: DataFrame, epoch_id: int):
        upload = F.regexp_replace("path", "/[^/]*$", "") if folders else F.col("path")
        uploads = sorted(r[0] for r in batch.select(upload).distinct().collect())   # names only
        if uploads:
            save_uploads(store, uploads, stream or checkpoint, params, fmt, folders)

    q = (files.writeStream.foreachBatch(per_epoch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return store


def reprocess(spark: SparkSession, store: BatchStore, raw: DataFrame, filename: str,
              params: C.CleanParams = C.CleanParams(), replace: int | None = None) -> int:
    """Clean a stored raw file again; a new batch id, or ``replace`` an existing one."""
    res = clean_screening(raw, params, sort=False)
    stats = res.stats().collect()[0].asDict()
    bid = store.save_result(res.table, stats, filename, batch_id=replace)
    res.release()
    return bid
