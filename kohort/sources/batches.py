"""Upload-batch store (S05-S12): person records and one metadata row per batch, both as
Parquet partitioned by ``batch_id`` in a shared folder.

* Records have one declared schema; columns that a batch lacks are NULL.
* A batch id is claimed by creating its marker file, which only one writer can do.
* Every write makes a fresh version of its batches, and the metadata row that names the
  version is the commit: reads keep only records of the version that a batch's newest row
  names. A batch that is replaced shows its old records until then, its new ones from then
  on, and is never empty in between; the old version's files go afterwards. Deleting
  removes the metadata first. A crash leaves files that no read shows (``vacuum`` removes them).
* A write touches its own batches only. No table is ever collected or rewritten as a whole.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.functions.text import month_of, nan_to_null
from kohort.operators import sketches
from kohort.operators.stats import describe, people_per_village

_TEXT = ("kecamatan", "desa", "nik", "nama")
_FLAG = ("jenis_kelamin", "riwayat_hipertensi", "gangguan_kognitif", "malnutrisi", "depresi")
_NUMBER = ("berat_badan", "tinggi_badan", "sistolik", "diastolik", "gds_1", "gds_2", "gdp", "gd2pp", "kolesterol", "umur", "imt")
RECORD_SCHEMA = T.StructType(
    [T.StructField("row_id", T.LongType())] + [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.IntegerType()) for c in _FLAG] + [T.StructField(c, T.DoubleType()) for c in _NUMBER]
    + [T.StructField("batch_id", T.IntegerType())])

META_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("bulan", T.StringType()),
    T.StructField("uploaded_at", T.TimestampType()),
    T.StructField("total_rows", T.LongType()),
    T.StructField("total_desa", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("stats", T.MapType(T.StringType(), T.LongType())),
    T.StructField("origin", T.StringType()),      # stream and file that a batch was ingested from
    T.StructField("batch_id", T.IntegerType()),
    T.StructField("version", T.StringType()),     # the records that the row stands for
])
_STORED = T.StructType([*RECORD_SCHEMA.fields, T.StructField("version", T.StringType())])
_SKETCHES = T.StructType([*sketches.SCHEMA.fields, T.StructField("batch_id", T.IntegerType()), T.StructField("version", T.StringType())])
SUMMARY_COLUMNS = ("umur", "imt", "sistolik", "diastolik", "kolesterol", "gds_1")


class BatchStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.records_path = f"{self.root}/records"
        self.meta_path = f"{self.root}/batches"
        self.sketches_path = f"{self.root}/sketches"
        self.claims_path = f"{self.root}/claims"

    # -- helpers ---------------------------------------------------------------
    def _fs_path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs_path(path)
        return fs.exists(p)

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).select(*schema.fieldNames())

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("append").partitionBy("batch_id", "version").parquet(path)

    def _rows(self) -> DataFrame:
        """All metadata rows, those of replaced versions that are still there included."""
        return self._read(self.meta_path, META_SCHEMA)

    def batches(self) -> DataFrame:
        """S09 source: each batch's newest metadata row (empty when nothing was saved)."""
        names = META_SCHEMA.fieldNames()
        newest = self._rows().groupBy("batch_id").agg(F.max_by(F.struct(*[n for n in names if n != "batch_id"]), "version").alias("_m"))
        return newest.select("batch_id", "_m.*").select(*names)

    def records(self) -> DataFrame:
        """Records of the committed batches' versions, in the declared schema."""
        shown = self.batches().select("batch_id", "version")
        return self._read(self.records_path, _STORED).join(shown, ["batch_id", "version"], "left_semi").select(*RECORD_SCHEMA.fieldNames())

    def next_id(self) -> int:
        row = self._rows().agg(F.max("batch_id")).collect()[0][0]
        return 1 if row is None else int(row) + 1

    def claim_many(self, n: int) -> list[int]:
        """``n`` new batch ids: the first from next_id on whose marker files this call creates."""
        bid, ids = self.next_id() if n else 0, []
        while len(ids) < n:
            fs, p = self._fs_path(f"{self.claims_path}/{bid}")
            if fs.createNewFile(p):
                ids.append(bid)
            bid += 1
        return ids

    def claim(self) -> int:
        return self.claim_many(1)[0]

    def new_version(self) -> str:
        """A name of its own for a write, later in order than every committed version."""
        last = self._rows().agg(F.max("version")).collect()[0][0]
        return f"{int(last.split('-')[0]) + 1 if last else 1:012d}-{uuid.uuid4().hex[:12]}"

    def ids_of(self, origins: list[str]) -> dict[str, int]:
        """Batch ids that these origins (at most one micro-batch of files) already have."""
        rows = self.batches().where(F.col("origin").isin(list(origins))).groupBy("origin").agg(F.min("batch_id").alias("b")).collect()
        return {r["origin"]: r["b"] for r in rows}

    # -- S05 / S07 ------------------------------------------------------------------
    def save_records(self, df: DataFrame) -> str:
        """Records with their batch_id in one write: known columns, floats NaN/inf -> NULL, absent columns
        NULL. Returns the new version, which no read shows before ``commit`` names it. Rows are
        rebalanced by batch: a small batch is one file, AQE splits a large one over several tasks."""
        def value(f):
            if f.name not in df.columns:
                return F.lit(None).cast(f.dataType).alias(f.name)
            c = F.col(f.name)
            return (nan_to_null(c.cast("double")) if isinstance(f.dataType, T.DoubleType) else c).cast(f.dataType).alias(f.name)
        version = self.new_version()
        rows = df.select(*[value(f) for f in RECORD_SCHEMA.fields]).hint("rebalance", "batch_id")
        self._write(rows.withColumn("version", F.lit(version)), self.records_path)
        return version

    def save_sketches(self, version: str) -> None:
        """Mergeable statistics of the written version's batches (``sketches``), a row per batch and measure."""
        written = self._read(self.records_path, _STORED).where(F.col("version") == version)
        rows = sketches.column_sketches(written, list(SUMMARY_COLUMNS), ["desa"], ("batch_id", "version"))
        self._write(rows.hint("rebalance", "batch_id"), self.sketches_path)

    def commit(self, rows: list[tuple], version: str, replaced: bool = False) -> None:
        """Metadata rows (batch_id, filename, uploaded_at, total_rows, total_desa, stats, origin) of the
        batches that ``version`` holds; ``replaced`` says that some were there before."""
        meta = self.spark.createDataFrame(rows, "batch_id int, filename string, uploaded_at timestamp, total_rows long, total_desa long, "
                                                "stats map<string,bigint>, origin string")
        meta = meta.withColumns({"bulan": month_of("filename"), "status": F.lit("success"), "version": F.lit(version)}).select(*META_SCHEMA.fieldNames())
        self._write(meta.coalesce(1), self.meta_path)
        if replaced:
            self._prune([r[0] for r in rows], version)

    def _prune(self, ids: list[int], version: str) -> None:
        """Removes the versions of these batches that are older than the committed one: records, then rows."""
        old = self._rows().where(F.col("batch_id").isin(list(ids)) & (F.col("version") < version)).select("batch_id", "version").distinct().collect()
        for r in old:       # at most a few versions of the batches of one write
            for path in (self.records_path, self.sketches_path, self.meta_path):
                self._remove(f"{path}/batch_id={r.batch_id}/version={r.version}")

    def vacuum(self) -> int:
        """Removes record and sketch folders that no metadata row names, left by crashed writes; to be
        called while nobody writes. Returns their number."""
        shown = {(f"batch_id={r.batch_id}", f"version={r.version}") for r in self.batches().select("batch_id", "version").collect()}
        removed = 0
        for path in (self.records_path, self.sketches_path):
            fs, glob = self._fs_path(f"{path}/batch_id=*/version=*")
            found = [s.getPath() for s in (fs.globStatus(glob) or ())]
            removed += sum(bool(fs.delete(p, True)) for p in found if (p.getParent().getName(), p.getName()) not in shown)
        return removed

    def save_result(self, df: DataFrame, stats: dict, filename: str, batch_id: int | None = None,
                    uploaded_at: _dt.datetime | None = None, origin: str | None = None) -> int:
        """Append one batch, or replace ``batch_id``: records and a metadata row with total
        rows, distinct villages, status ``success`` and the counters map."""
        bid = self.claim() if batch_id is None else int(batch_id)
        version = self.save_records(df.withColumn("batch_id", F.lit(bid)))
        self.save_sketches(version)
        counts = (self._read(self.records_path, _STORED).where((F.col("batch_id") == bid) & (F.col("version") == version))
                  .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("desa").alias("d")).collect()[0])
        self.commit([(bid, filename, uploaded_at or now(), int(counts["n"]), int(counts["d"]), {k: int(v) for k, v in stats.items()}, origin)],
                    version, replaced=batch_id is not None)
        return bid

    # -- S08-S12 --------------------------------------------------------------------
    def latest_batch(self) -> DataFrame:
        """Newest ``uploaded_at`` (top-1 plan)."""
        return self.batches().orderBy(F.col("uploaded_at").desc(), F.col("batch_id").desc()).limit(1)

    def all_batches(self) -> DataFrame:
        """S09."""
        return self.batches().orderBy(F.col("uploaded_at").desc())

    def batch(self, batch_id: int) -> DataFrame:
        """Partition-pruned read of one batch."""
        return self.records().where(F.col("batch_id") == int(batch_id))

    def village(self, desa: str, batch_id: int | None = None) -> DataFrame:
        """S11."""
        df = self.records().where(F.col("desa") == desa)
        return df.where(F.col("batch_id") == int(batch_id)) if batch_id else df

    # -- J07 / A06 ------------------------------------------------------------------
    def latest_id(self) -> int | None:
        """The latest batch's id (None in an empty store)."""
        row = self.latest_batch().select("batch_id").first()
        return row and int(row[0])

    def people(self, batch_id: int | None = None) -> DataFrame:
        """The records of a batch, of the latest one if none is given. The id is a literal, so
        only that batch's folder is read."""
        bid = self.latest_id() if batch_id is None else int(batch_id)
        return self.records().where(F.col("batch_id") == F.lit(bid).cast("int"))

    def summary(self, batch_id: int | None = None) -> DataFrame:
        """People, villages and people by sex of a batch or the latest one; no row without people."""
        return self.people(batch_id).groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("total_lansia"), F.count_distinct("desa").alias("total_desa"),
            F.count_if(F.col("jenis_kelamin") == 1).alias("laki_laki"),
            F.count_if(F.col("jenis_kelamin") == 0).alias("perempuan"))

    def village_counts(self, batch_id: int | None = None) -> DataFrame:
        """People per village, villages without a name left out."""
        return people_per_village(self.people(batch_id))

    def describe(self, batch_id: int | None = None) -> DataFrame:
        """Count, mean, std, min, max and median of the measures that have values."""
        return describe(self.people(batch_id), list(SUMMARY_COLUMNS), skip_empty=True)

    def merged_sketches(self, batch_ids: list[int] | None = None) -> DataFrame:
        """The merged statistics of these batches, of all if none are named; no record is read."""
        shown = self.batches().select("batch_id", "version")
        rows = self._read(self.sketches_path, _SKETCHES)
        if batch_ids is not None:
            rows = rows.where(F.col("batch_id").isin([int(b) for b in batch_ids]))
        return sketches.merged(rows.join(shown, ["batch_id", "version"], "left_semi"))

    def _remove(self, path: str) -> bool:
        fs, p = self._fs_path(path)
        return fs.exists(p) and fs.delete(p, True)

    def delete_batch(self, batch_id: int) -> bool:
        """False for an unknown id; otherwise the batch row goes (from then on no read shows
        the batch), then its records."""
        if not self._remove(f"{self.meta_path}/batch_id={int(batch_id)}"):
            return False
        self._remove(f"{self.records_path}/batch_id={int(batch_id)}")
        self._remove(f"{self.sketches_path}/batch_id={int(batch_id)}")
        return True


def now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def infer_month(df: DataFrame, col: str = "filename") -> DataFrame:
    """S06 as a projection."""
    return df.withColumn("bulan", month_of(col))
