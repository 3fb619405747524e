"""Registered cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohort import config as C
from kohort.checks import sqlfrag as Q
from kohort.functions import encode, measures, text
from kohort.operators import missing
from kohort.plans import preprocessing as P
from kohort.registry import register
from kohort.sources.tables import raw_screening

DISTRICT = "ASIA"
AS_OF = 2025
PARAMS = C.CleanParams(district=DISTRICT, as_of_year=AS_OF)


def clean(spark, sf, sort=True):
    return P.clean_screening(raw_screening(spark, sf), PARAMS, sort=sort)


def _raw(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([Q.raw_cte(), *ctes]) + "\n" + select


# --- S01 -------------------------------------------------------------------
@register("s01_screening_scan",
          _raw(f"SELECT row_id, {', '.join(C.RAW_COLUMNS)} FROM raw"))
def s01(spark, sf):
    return P.select_raw(raw_screening(spark, sf))


# --- P01-P04 ----------------------------------------------------------------
@register("p01_text_clean",
          _raw("SELECT row_id, " + ", ".join(f"{Q.clean_text(c)} AS {c}" for c in C.STRING_COLUMNS) + " FROM raw"))
def p01(spark, sf):
    return raw_screening(spark, sf).select("row_id", *[text.clean_text(c).alias(c) for c in C.STRING_COLUMNS])


@register("p02_numeric_extract",
          _raw("SELECT row_id, " + ", ".join(f"{Q.numeric(c)} AS {c}" for c in C.NUMERIC_TEXT_COLUMNS) + " FROM raw"))
def p02(spark, sf):
    return raw_screening(spark, sf).select("row_id", *[text.numeric_text(c).alias(c) for c in C.NUMERIC_TEXT_COLUMNS])


@register("p03_glucose_zero_null",
          _raw("SELECT row_id, " + ", ".join(f"nullif({Q.numeric(c)}, 0) AS {c}" for c in C.GLUCOSE_COLUMNS) + " FROM raw"))
def p03(spark, sf):
    return raw_screening(spark, sf).select(
        "row_id", *[measures.zero_as_null(text.numeric_text(c)).alias(c) for c in C.GLUCOSE_COLUMNS])


@register("p04_birth_date", _raw("SELECT row_id, TRY_CAST(tanggal_lahir AS DATE) AS tanggal_lahir FROM raw"))
def p04(spark, sf):
    return raw_screening(spark, sf).select("row_id", measures.parse_date("tanggal_lahir").alias("tanggal_lahir"))


# --- P05-P11 ---------------------------------------------------------------
@register("p05_age", _raw(f"SELECT row_id, {Q.age('TRY_CAST(tanggal_lahir AS DATE)')} AS umur FROM raw"))
def p05(spark, sf):
    return raw_screening(spark, sf).select(
        "row_id", measures.age(measures.parse_date("tanggal_lahir"), AS_OF).alias("umur"))


@register("p06_bmi", _raw(f"SELECT row_id, {Q.bmi(Q.numeric('berat_badan'), Q.numeric('tinggi_badan'))} AS imt FROM raw"))
def p06(spark, sf):
    return raw_screening(spark, sf).select(
        "row_id", measures.bmi(text.numeric_text("berat_badan"), text.numeric_text("tinggi_badan")).alias("imt"))


_ENC = {
    "p07_encode_sex": ("jenis_kelamin", encode.sex, Q.enc_sex),
    "p08_encode_hypertension": ("riwayat_hipertensi", encode.hypertension, Q.enc_ht),
    "p09_encode_cognitive": ("gangguan_kognitif", encode.cognitive, Q.enc_cog),
    "p10_encode_malnutrition": ("malnutrisi", encode.malnutrition, Q.enc_mal),
    "p11_encode_depression": ("depresi", encode.depression, Q.enc_dep),
}


def _make_enc(name, col, fn, sqlfn):
    @register(name, _raw(f"SELECT row_id, {col} AS raw_{col}, {sqlfn(col)} AS {col} FROM raw"))
    def q(spark, sf):
        return raw_screening(spark, sf).select("row_id", F.col(col).alias(f"raw_{col}"), fn(col).alias(col))
    return q


for _n, (_c, _f, _s) in _ENC.items():
    _make_enc(_n, _c, _f, _s)


# --- P12-P15 (helper normalisers, applied to the raw sheet) ----------------
def _sql_in(xs):
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


_SEXU = f"upper({Q.strip('jenis_kelamin')})"


@register("p12_sex_code", _raw(
    f"SELECT row_id, CASE WHEN {_SEXU} IN {_sql_in(C.SEX_CODE_MALE)} THEN 1.0::DOUBLE "
    f"WHEN {_SEXU} IN {_sql_in(C.SEX_CODE_FEMALE)} THEN 0.0::DOUBLE END AS sex_code FROM raw"))
def p12(spark, sf):
    return raw_screening(spark, sf).select("row_id", encode.sex_code("jenis_kelamin").alias("sex_code"))


def _yes_no_sql(x, visit):
    s = f"upper({Q.strip(x)})"
    head = f"CASE WHEN {x} IS NULL THEN 0.0::DOUBLE WHEN {s} IN {_sql_in(C.BOOL_VISIT)} THEN 1.0::DOUBLE "
    if visit:
        return head + "ELSE 0.0::DOUBLE END"
    num = Q.py_float(s)
    return (head + f"WHEN {s} IN {_sql_in(C.BOOL_TRUE)} THEN 1.0::DOUBLE "
            f"WHEN {s} IN {_sql_in(C.BOOL_FALSE)} THEN 0.0::DOUBLE "
            f"WHEN {num} IS NOT NULL THEN CASE WHEN {num} <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
            f"ELSE 0.0::DOUBLE END")


@register("p13_yes_no", _raw(
    f"SELECT row_id, {_yes_no_sql('riwayat_hipertensi', False)} AS yes_no, "
    f"{_yes_no_sql('riwayat_hipertensi', True)} AS yes_no_visit FROM raw"))
def p13(spark, sf):
    return raw_screening(spark, sf).select(
        "row_id", encode.yes_no("riwayat_hipertensi").alias("yes_no"),
        encode.yes_no("riwayat_hipertensi", visit=True).alias("yes_no_visit"))


def _bmi_text_sql():
    rw = "replace(berat_badan, ',', '.')"
    rh = "replace(tinggi_badan, ',', '.')"
    w = Q.py_float(rw)
    h = Q.py_float(rh)
    hm = f"(CASE WHEN {h} > 3 THEN {h} / 100.0::DOUBLE ELSE {h} END)"
    calc = f"(CASE WHEN {hm} * {hm} = 0 THEN NULL ELSE {w} / ({hm} * {hm}) END)"
    first = f"regexp_extract({Q.strip('berat_badan')}, '([0-9]+(?:[.,][0-9]+)?)', 1)"
    num = f"TRY_CAST(replace({first}, ',', '.') AS DOUBLE)"
    return (f"coalesce(CASE WHEN {calc} BETWEEN 10 AND 60 THEN {Q.rnd(calc, 2)} END, "
            f"CASE WHEN {num} BETWEEN 10 AND 60 THEN {Q.rnd(num, 2)} END)")


@register("p14_bmi_from_text", _raw(f"SELECT row_id, {_bmi_text_sql()} AS imt FROM raw"))
def p14(spark, sf):
    return raw_screening(spark, sf).select(
        "row_id", measures.bmi_from_text("berat_badan", "berat_badan", "tinggi_badan").alias("imt"))


def _bp_sql():
    src = "(sistolik || '/' || diastolik)"
    s = f"translate({Q.strip(src)}, ',- ', '///')"
    parts = f"list_filter(string_split({s}, '/'), lambda p: {Q.strip('p')} <> '')"
    p0 = f"{parts}[1]"
    p1 = f"{parts}[2]"
    sv = Q.py_float(p0)
    dv = Q.py_float(p1)
    ok = f"({sv} IS NOT NULL AND ({p1} IS NULL OR {dv} IS NOT NULL))"
    return (f"CASE WHEN {ok} AND {sv} BETWEEN 50 AND 300 THEN {sv} END AS sistolik, "
            f"CASE WHEN {ok} AND {dv} BETWEEN 30 AND 200 THEN {dv} END AS diastolik")


@register("p15_blood_pressure_split", _raw(f"SELECT row_id, {_bp_sql()} FROM raw"))
def p15(spark, sf):
    raw = raw_screening(spark, sf)
    bp = measures.split_blood_pressure(
        F.when(F.col("sistolik").isNull() | F.col("diastolik").isNull(), F.lit(None))
         .otherwise(F.concat(F.col("sistolik"), F.lit("/"), F.col("diastolik"))))
    return raw.select("row_id", bp.alias("bp")).select("row_id", "bp.sistolik", "bp.diastolik")


# --- P16/P17 counters (before validation, after F05) -----------------------
def _viol_sql():
    parts = [f"CAST(count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS BIGINT) AS {c}_out_of_range"
             for c, (lo, hi) in C.RANGE_RULES.items() if c != "gds_2"]
    parts += [f"CAST(count(*) FILTER (WHERE {c} NOT IN (0, 1)) AS BIGINT) AS {c}_not_binary"
              for c in C.BINARY_COLUMNS]
    return ("WITH " + ",\n".join([Q.raw_cte(), Q.values_cte(), Q.encoded_cte(), Q.missing_cte()])
            + f"\nSELECT {', '.join(parts)} FROM rowf")


@register("p16_range_violations", _viol_sql())
def p16(spark, sf):
    raw = raw_screening(spark, sf)
    df = P.encoded(raw, PARAMS)
    feats = [f for f in PARAMS.features if f in df.columns]
    dropped = missing.sparse_columns(df, feats, PARAMS.col_missing_threshold)
    df = missing.drop_sparse_rows(df.drop(*dropped), [f for f in feats if f not in dropped],
                                  PARAMS.row_missing_threshold)
    return P.range_violation_counts(df)


# --- F01-F06 ---------------------------------------------------------------
@register("f02_dedup_first_per_nik", "WITH " + ",\n".join([Q.raw_cte(), Q.values_cte()]) +
          "\nSELECT row_id, nik FROM vals QUALIFY row_number() OVER (PARTITION BY nik ORDER BY row_id) = 1")
def f02(spark, sf):
    from kohort.operators.dedup import first_per_key
    df = P.clean_values(P.select_raw(raw_screening(spark, sf)))
    return first_per_key(df, "nik", "row_id").select("row_id", "nik")


@register("f01_district_filter", "WITH " + ",\n".join([Q.raw_cte(), Q.values_cte(), Q.encoded_cte()]) +
          "\nSELECT row_id, kecamatan, desa, nik FROM filt")
def f01(spark, sf):
    from kohort.operators.dedup import first_per_key
    df = P.clean_values(P.select_raw(raw_screening(spark, sf)))
    return P.district_filter(first_per_key(df, "nik", "row_id"), DISTRICT).select("row_id", "kecamatan", "desa", "nik")


@register("f03_null_ratios", "WITH " + ",\n".join([Q.raw_cte(), Q.values_cte(), Q.encoded_cte(), Q.missing_cte()]) +
          "\nSELECT " + ", ".join(f"{Q.rnd(f, 6)} AS {f}" for f in C.FEATURES) + " FROM ratios")
def f03(spark, sf):
    df = P.before_missing(raw_screening(spark, sf), PARAMS)
    r = missing.null_ratios(df, C.FEATURES)
    return r.select(*[F.round(F.col(f), 6).alias(f) for f in C.FEATURES])


@register("f05_sparse_rows_kept", "WITH " + ",\n".join([Q.raw_cte(), Q.values_cte(), Q.encoded_cte(), Q.missing_cte()]) +
          "\nSELECT row_id FROM rowf")
def f05(spark, sf):
    df = P.encoded(raw_screening(spark, sf), PARAMS)
    feats = [f for f in PARAMS.features if f in df.columns]
    dropped = missing.sparse_columns(df, feats, PARAMS.col_missing_threshold)
    return missing.drop_sparse_rows(df, [f for f in feats if f not in dropped],
                                    PARAMS.row_missing_threshold).select("row_id")


_NUMERIC_CLEAN = ["berat_badan", "tinggi_badan", "sistolik", "diastolik", "gds_1", "gdp", "gd2pp",
                  "kolesterol", "umur", "imt"]


@register("f06_missing_report", Q.with_clean(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing FROM clean"
        for c in _NUMERIC_CLEAN) + ") WHERE n_missing > 0"))
def f06(spark, sf):
    return missing.missing_report(clean(spark, sf, sort=False).table, _NUMERIC_CLEAN)


_IQR_COLS = ["sistolik", "diastolik", "kolesterol", "imt", "gds_1"]


def _iqr_sql():
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in _IQR_COLS)
    flags = ", ".join(
        f"coalesce({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}), false) AS {c}_outlier"
        for c in _IQR_COLS)
    return Q.with_clean(f"SELECT row_id, {flags} FROM clean, q", f"q AS (SELECT {qs} FROM clean)")


@register("f09_iqr_outliers", _iqr_sql())
def f09(spark, sf):
    t = clean(spark, sf, sort=False).table.select("row_id", *_IQR_COLS)
    return missing.iqr_outlier_flags(t, _IQR_COLS).select("row_id", *[f"{c}_outlier" for c in _IQR_COLS])


# --- K24 / A05 ---------------------------------------------------------------
@register("k24_clean_table", Q.with_clean("SELECT * FROM clean"))
def k24(spark, sf):
    return clean(spark, sf).table


@register("a05_pipeline_counters", Q.with_clean(
    "SELECT (SELECT count(*) FROM raw) AS total_baris_mentah, count(*) AS total_valid, "
    "(SELECT count(*) FROM raw) - count(*) AS baris_dihapus, 1 AS sheets_diproses, "
    "count(*) FILTER (WHERE umur IS NULL) AS umur_invalid, count(*) FILTER (WHERE imt IS NULL) AS imt_invalid, "
    "count(*) FILTER (WHERE sistolik IS NULL) AS td_invalid FROM clean"))
def a05(spark, sf):
    return clean(spark, sf, sort=False).stats()


# --- P24 / P25 display -------------------------------------------------------
@register("p24_round_display", Q.with_clean(
    "SELECT row_id, " + ", ".join(f"{Q.rnd(c, 2)} AS {c}" for c in _NUMERIC_CLEAN) + " FROM clean"))
def p24(spark, sf):
    t = clean(spark, sf, sort=False).table
    return t.select("row_id", *[F.round(c, 2).alias(c) for c in _NUMERIC_CLEAN])


@register("p25_format_value", Q.with_clean(
    "SELECT row_id, coalesce(printf('%.2f', imt), '-') AS imt_text, coalesce(printf('%.2f', kolesterol), '-') AS kolesterol_text, "
    "coalesce(CAST(riwayat_hipertensi AS VARCHAR), '-') AS riwayat_hipertensi_text FROM clean"))
def p25(spark, sf):
    t = clean(spark, sf, sort=False).table
    return t.select("row_id", text.format_value("imt", "double").alias("imt_text"),
                    text.format_value("kolesterol", "double").alias("kolesterol_text"),
                    text.format_value("riwayat_hipertensi", "int").alias("riwayat_hipertensi_text"))


# --- F11 search page, F12 group-median fill, S02 header-named read ----------------
_SEARCH_COLS = ["row_id", "kecamatan", "desa", "nik", "nama", "jenis_kelamin", "umur", "imt", "sistolik"]


@register("f11_search_page", Q.with_clean(
    "SELECT " + ", ".join(_SEARCH_COLS) + " FROM clean WHERE contains(lower(concat_ws(' ', " +
    ", ".join(f"CAST({c} AS VARCHAR)" for c in _SEARCH_COLS) + ")), 'nation_2') ORDER BY row_id LIMIT 10 OFFSET 10"))
def f11(spark, sf):
    from kohort.sources.screening import search_page
    t = clean(spark, sf, sort=False).table.select(*_SEARCH_COLS)
    return search_page(t, "NATION_2", "row_id", True, page=2, size=10)


_PAGE_COLS = ["row_id", "kecamatan", "desa", "nik", "nama"]


@register("f11_late_page", _raw(f"SELECT {', '.join(_PAGE_COLS)} FROM raw ORDER BY nama DESC NULLS LAST, row_id LIMIT 10 OFFSET 9990"))
def f11_late(spark, sf):
    """Page 1,000 of all rows by name, cut out by global places."""
    from kohort.sources.screening import search_page
    return search_page(raw_screening(spark, sf).select(*_PAGE_COLS), "", "nama", False, page=1000, size=10)


@register("f11_next_page", _raw(f"SELECT {', '.join(_PAGE_COLS)} FROM raw ORDER BY nama, row_id LIMIT 25 OFFSET 25"))
def f11_next(spark, sf):
    """The second page of 25, from the last row of the first."""
    from kohort.sources.screening import next_page, search_page
    t = raw_screening(spark, sf).select(*_PAGE_COLS)
    last = search_page(t, "", "nama", True, page=1, size=25).collect()[-1]      # a page
    return next_page(t, (last["nama"], last["row_id"]), "", "nama", True, size=25)


_F12 = ["kolesterol", "gdp", "gd2pp"]


@register("f12_group_median_fill", Q.with_clean(
    "SELECT row_id, " + ", ".join(
        f"{Q.rnd(f'CASE WHEN desa IS NULL THEN coalesce({c}, g_{c}) ELSE coalesce({c}, m_{c}, g_{c}) END', 6)} AS {c}"
        for c in _F12) + " FROM (SELECT row_id, desa, " + ", ".join(
        f"{c}, quantile_cont({c}, 0.5) OVER (PARTITION BY desa) AS m_{c}" for c in _F12) + " FROM clean), "
    "(SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS g_{c}" for c in _F12) + " FROM clean)"))
def f12(spark, sf):
    t = clean(spark, sf, sort=False).table.select("row_id", "desa", *_F12)
    out = missing.group_median_fill(t, _F12, "desa")
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in _F12])


@register("s02_header_named_read", _raw(f"SELECT row_id, {', '.join(C.RAW_COLUMNS)} FROM raw"))
def s02(spark, sf):
    """The sheet written with its original headers (plus an extra column) and read back."""
    import uuid

    from kohort.session import checkpoint_dir
    from kohort.sources.batches import BatchStore
    from kohort.sources.screening import read_screening
    path = f"{checkpoint_dir(spark)}/sheet-{uuid.uuid4().hex}"
    inv = {v: k for k, v in C.HEADER_MAP.items()}
    raw = raw_screening(spark, sf)
    sheet = raw.select("row_id", *[F.col(c).alias(inv[c]) for c in C.RAW_COLUMNS], F.lit("x").alias("Catatan"))
    sheet.write.parquet(path)
    out = read_screening(spark, path, fmt="parquet").checkpoint(eager=True)
    BatchStore(spark, path)._remove(path)
    return out


@register("f04_sparse_columns", "WITH " + ",\n".join([Q.raw_cte(), Q.values_cte(), Q.encoded_cte(), Q.missing_cte()]) +
          "\nSELECT * FROM (" + " UNION ALL ".join(
              f"SELECT '{f}' AS feature, {Q.rnd(f, 6)} AS null_ratio, {f} > {C.COL_MISSING_THRESHOLD} AS dropped FROM ratios"
              for f in C.FEATURES) + ")")
def f04(spark, sf):
    df = P.before_missing(raw_screening(spark, sf), PARAMS)
    r = missing.null_ratios(df, C.FEATURES)
    long = r.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("null_ratio"))
                                        for f in C.FEATURES])).alias("x")).select("x.*")
    return long.select("feature", F.round("null_ratio", 6).alias("null_ratio"),
                       (F.col("null_ratio") > F.lit(PARAMS.col_missing_threshold)).alias("dropped"))


@register("p17_binary_domain", "WITH " + ",\n".join([Q.raw_cte(), Q.values_cte(), Q.encoded_cte(), Q.missing_cte()]) +
          "\nSELECT row_id, " + ", ".join(f"CASE WHEN {c} IN (0, 1) THEN {c} END AS {c}" for c in C.BINARY_COLUMNS)
          + " FROM rowf")
def p17(spark, sf):
    raw = raw_screening(spark, sf)
    df = P.encoded(raw, PARAMS)
    feats = [f for f in PARAMS.features if f in df.columns]
    dropped = missing.sparse_columns(df, feats, PARAMS.col_missing_threshold)
    df = missing.drop_sparse_rows(df.drop(*dropped), [f for f in feats if f not in dropped],
                                  PARAMS.row_missing_threshold)
    return df.select("row_id", *[measures.binary_only(c).alias(c) for c in C.BINARY_COLUMNS])
