"""Input tables and the screening views derived from them.

The screening sheet, village boundaries and upload batches are derived from
the star-schema tables (orders = one screening form, nation = village,
region = district). The SQL below is accepted unchanged by Spark and DuckDB,
so the oracle reads exactly the rows Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Fixed fixture definitions (stated once, used by Spark and by the SQL oracle).
RAW_SCREENING_SQL = """
SELECT o.o_orderkey AS row_id,
 CASE WHEN o.o_orderkey % 37 = 0 THEN '  ' || lower(r.r_name) || ' ' ELSE r.r_name END AS kecamatan,
 CASE WHEN o.o_orderkey % 29 = 0 THEN ' ' || n.n_name ELSE n.n_name END AS desa,
 CASE WHEN o.o_orderkey % 211 = 0 THEN 'nan' WHEN o.o_orderkey % 10 = 9 THEN CAST(o.o_orderkey - 1 AS STRING) ELSE CAST(o.o_orderkey AS STRING) END AS nik,
 c.c_name AS nama,
 CASE o.o_orderkey % 9 WHEN 0 THEN ' Laki-laki ' WHEN 1 THEN 'laki-laki' WHEN 2 THEN 'Laki-laki' WHEN 3 THEN 'Laki-laki' WHEN 4 THEN 'Laki-laki' ELSE 'Perempuan' END AS jenis_kelamin,
 CASE WHEN o.o_orderkey % 53 = 0 THEN NULL WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE CAST(35 + (o.o_orderkey * 7919) % 60 AS STRING) || CASE WHEN o.o_orderkey % 5 = 0 THEN ' kg' ELSE '' END END AS berat_badan,
 CASE WHEN o.o_orderkey % 31 = 0 THEN '0' ELSE CAST(135 + (o.o_orderkey * 104729) % 45 AS STRING) END AS tinggi_badan,
 CASE WHEN o.o_orderkey % 4 = 0 THEN 'Ya' WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE 'Tidak ' END AS riwayat_hipertensi,
 CASE WHEN o.o_orderkey % 53 = 0 THEN NULL WHEN o.o_orderkey % 41 = 0 THEN '120/80' ELSE CAST(90 + (o.o_orderkey * 6151) % 110 AS STRING) END AS sistolik,
 CASE WHEN o.o_orderkey % 53 = 0 THEN NULL ELSE CAST(55 + (o.o_orderkey * 3571) % 60 AS STRING) || ' mmHg' END AS diastolik,
 CASE WHEN o.o_orderkey % 53 = 0 THEN NULL WHEN o.o_orderkey % 6 = 0 THEN '0' ELSE CAST(70 + (o.o_orderkey * 2741) % 230 AS STRING) END AS gds_1,
 CASE WHEN o.o_orderkey % 10 < 8 THEN NULL ELSE CAST(80 + (o.o_orderkey * 1237) % 200 AS STRING) END AS gds_2,
 CASE WHEN o.o_orderkey % 53 = 0 THEN NULL WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE CAST(70 + (o.o_orderkey * 1543) % 160 AS STRING) END AS gdp,
 CASE WHEN o.o_orderkey % 53 = 0 THEN NULL WHEN o.o_orderkey % 2 = 0 THEN '' ELSE CAST(90 + (o.o_orderkey * 2221) % 210 AS STRING) END AS gd2pp,
 CASE WHEN o.o_orderkey % 53 = 0 THEN NULL WHEN o.o_orderkey % 17 = 0 THEN '-' ELSE CAST(120 + (o.o_orderkey * 4421) % 180 AS STRING) || '.5' END AS kolesterol,
 CASE o.o_orderkey % 5 WHEN 0 THEN 'Kemungkinan ada gangguan kognitif' WHEN 1 THEN NULL ELSE 'Tidak ada gangguan' END AS gangguan_kognitif,
 CASE o.o_orderkey % 7 WHEN 0 THEN 'Berisiko Malnutrisi' WHEN 1 THEN 'Malnutrisi' WHEN 2 THEN NULL ELSE 'Status Gizi Normal' END AS malnutrisi,
 CASE o.o_orderkey % 11 WHEN 0 THEN 'Ada gejala depresi' WHEN 1 THEN '' WHEN 2 THEN 'ragu' ELSE 'Tidak ada gejala' END AS depresi,
 CASE WHEN o.o_orderkey % 43 = 0 THEN 'tidak diketahui' ELSE CAST(1935 + o.o_orderkey % 60 AS STRING) || '-06-15' END AS tanggal_lahir
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

VILLAGE_BOUNDARY_SQL = """
SELECT n_nationkey AS gid,
 CASE WHEN n_nationkey % 6 = 5 THEN 'NEW ' || n_name WHEN n_nationkey % 4 = 0 THEN 'OLD ' || n_name ELSE ' ' || lower(n_name) || '  ' END AS desa_geo,
 CASE WHEN n_nationkey % 6 = 5 THEN 'FORMER ' || n_name ELSE n_name END AS alt_geo
FROM {nation}
"""

UPLOAD_BATCH_SQL = """
SELECT CAST(r_regionkey + 1 AS INT) AS batch_id,
 'laporan_' || CASE r_regionkey WHEN 0 THEN 'Januari' WHEN 1 THEN 'maret' WHEN 2 THEN 'AGUSTUS' WHEN 3 THEN 'desember' ELSE 'lain' END || '_2026.csv' AS filename,
 r_name AS kecamatan,
 make_date(2026, CAST(1 + r_regionkey * 2 AS INT), 15) AS uploaded_on
FROM {region}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _render(spark: SparkSession, sf_dir: str, sql: str, names: list[str]) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def raw_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw screening sheet: 19 text columns plus ``row_id`` (file order)."""
    return _render(spark, sf_dir, RAW_SCREENING_SQL, ["orders", "customer", "nation", "region"])


def village_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Village boundary attributes (gid, primary name, alternate name)."""
    return _render(spark, sf_dir, VILLAGE_BOUNDARY_SQL, ["nation"])


def upload_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload batch metadata: one batch per district."""
    return _render(spark, sf_dir, UPLOAD_BATCH_SQL, ["region"])


def oracle_view(sql: str) -> str:
    """The same fixture SQL with the pre-registered DuckDB view names."""
    return sql.format(orders="orders", customer="customer", nation="nation", region="region")
