"""The screening cleaning plan, stage by stage in the application's order.

S01 projection -> P01-P04 cleaning -> F02 dedup -> F01 district filter ->
P05/P06 derived measures -> P07-P11 encoding -> F03-F05 missing data ->
P18/P16/P17 validation -> W01 sort, P27 drop helper -> A05 counters.

Everything is one lazy plan except F04, which must decide the column list from
14 NULL ratios (one small aggregate; a plan-time schema decision, not a row
collect). The table feeding that aggregate is persisted so the dedup shuffle
runs once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort import config as C
from kohort.functions import encode, measures, text
from kohort.operators.dedup import first_per_key
from kohort.operators.missing import drop_sparse_rows, sparse_columns
from kohort.session import materialize  # noqa: F401


def select_raw(raw: DataFrame, more: tuple = ()) -> DataFrame:
    """Keep the 19 sheet columns (plus row_id and ``more``); a missing one is an error."""
    missing = [c for c in C.RAW_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"screening table lacks columns: {missing}")
    keep = (["row_id"] if "row_id" in raw.columns else []) + C.RAW_COLUMNS + list(more)
    return raw.select(*keep)


def clean_values(df: DataFrame, skip: tuple = (), date_formats: tuple = C.DATE_FORMATS) -> DataFrame:
    """P01 text strip + null tokens, P02 numeric extraction, P03 glucose 0 -> NULL, P04 dates."""
    cols = {c: text.clean_text(c) for c in C.STRING_COLUMNS if c in df.columns and c not in skip}
    for c in C.NUMERIC_TEXT_COLUMNS:
        if c in df.columns:
            v = text.numeric_text(c)
            cols[c] = measures.zero_as_null(v) if c in C.GLUCOSE_COLUMNS else v
    if "tanggal_lahir" in df.columns:
        cols["tanggal_lahir"] = measures.parse_date("tanggal_lahir", date_formats)
    return df.withColumns(cols)


def in_district(district: str):
    """F01 as a condition (strip + upper); NULL never matches."""
    return F.upper(text.strip("kecamatan")) == F.lit(district)


def district_filter(df: DataFrame, district: str) -> DataFrame:
    """keep one district."""
    return df.where(in_district(district))


def derive_measures(df: DataFrame, as_of_year: int) -> DataFrame:
    """P05 age (as-of year is a parameter), P06 BMI."""
    cols = {}
    cols["umur"] = (measures.age("tanggal_lahir", as_of_year) if "tanggal_lahir" in df.columns
                    else F.lit(None).cast("double"))
    cols["imt"] = (measures.bmi("berat_badan", "tinggi_badan")
                   if {"berat_badan", "tinggi_badan"} <= set(df.columns) else F.lit(None).cast("double"))
    return df.withColumns(cols)


def encode_categories(df: DataFrame) -> DataFrame:
    """P07-P11."""
    enc = {"jenis_kelamin": encode.sex, "riwayat_hipertensi": encode.hypertension,
           "gangguan_kognitif": encode.cognitive, "malnutrisi": encode.malnutrition,
           "depresi": encode.depression}
    return df.withColumns({c: f(c) for c, f in enc.items() if c in df.columns})


def validate(df: DataFrame) -> DataFrame:
    """P18 numeric types, P16 ranges, P17 binary domain."""
    cols = {}
    for c in C.VALIDATE_NUMERIC:
        if c in df.columns:
            cols[c] = F.col(c).cast("double")
    df = df.withColumns(cols)
    rng = {c: measures.in_range(c, lo, hi) for c, (lo, hi) in C.RANGE_RULES.items() if c in df.columns}
    df = df.withColumns(rng)
    return df.withColumns({c: measures.binary_only(c) for c in C.BINARY_COLUMNS if c in df.columns})


def range_violation_counts(df: DataFrame) -> DataFrame:
    """P16/P17 counters: values outside each range, flags outside {0,1}."""
    aggs = [F.count_if(measures.out_of_range(c, lo, hi)).alias(f"{c}_out_of_range")
            for c, (lo, hi) in C.RANGE_RULES.items() if c in df.columns]
    aggs += [F.count_if(~F.col(c).isin(0, 1)).alias(f"{c}_not_binary")
             for c in C.BINARY_COLUMNS if c in df.columns]
    return df.agg(*aggs)


def sort_output(df: DataFrame) -> DataFrame:
    """Village, district ascending, NULLs last, stable by file order."""
    keys = [F.col(c).asc_nulls_last() for c in ("desa", "kecamatan") if c in df.columns]
    if "row_id" in df.columns:
        keys.append(F.col("row_id").asc())
    return df.orderBy(*keys)


@dataclass
class CleanResult:
    table: DataFrame
    raw: DataFrame
    dropped_columns: list
    features: list
    cached: DataFrame | None = None

    def release(self) -> None:
        """Drop the cached pre-F04 stage once the table has been consumed."""
        if self.cached is not None:
            self.cached.unpersist()

    def stats(self) -> DataFrame:
        """Raw rows, valid rows, removed, sheets, NULL age / BMI / systolic after cleaning."""
        raw_n = self.raw.agg(F.count(F.lit(1))).scalar()      # scalar subquery, no join
        t = self.table
        def nulls(c):
            return F.count_if(F.col(c).isNull()) if c in t.columns else F.lit(0)
        return t.agg(
            raw_n.alias("total_baris_mentah"),
            F.count(F.lit(1)).alias("total_valid"),
            (raw_n - F.count(F.lit(1))).alias("baris_dihapus"),
            F.lit(1).alias("sheets_diproses"),
            nulls("umur").cast("bigint").alias("umur_invalid"),
            nulls("imt").cast("bigint").alias("imt_invalid"),
            nulls("sistolik").cast("bigint").alias("td_invalid"))


KEY_COLUMNS = ("nik", "kecamatan")


def before_missing(raw: DataFrame, params: C.CleanParams, by: tuple = ()) -> DataFrame:
    """Stages up to encoding (everything before the data-dependent F04).

    Only the dedup key and the district column need P01 before F02/F01. The rest
    of P01-P04 is row-local and reads neither, so it commutes with the dedup and
    the filter. A survivor of F02 must be in the district itself, so the wide rows
    of other districts go before the shuffle; only (key, row_id) of all rows move.
    ``by`` names columns that keep several sheets apart (dedup within each).
    """
    df = select_raw(raw, by)
    df = df.withColumns({c: text.clean_text(c) for c in KEY_COLUMNS})
    if "row_id" in df.columns:
        df = first_per_key(df, [*by, "nik"], "row_id", where=in_district(params.district))
    else:
        df = district_filter(df.dropDuplicates([*by, "nik"]), params.district)
    df = clean_values(df, skip=KEY_COLUMNS, date_formats=params.date_formats)
    df = derive_measures(df, params.as_of_year)
    return encode_categories(df)


def encoded(raw: DataFrame, params: C.CleanParams) -> DataFrame:
    """The stage that F04 and F05 read: cached, so that it is computed once and their conditions
    test its columns instead of being pushed down to the text expressions."""
    return before_missing(raw, params).persist(StorageLevel.MEMORY_AND_DISK)


def clean_uploads(raw: DataFrame, params: C.CleanParams, by: str) -> tuple[DataFrame, DataFrame]:
    """Cleans several sheets, told apart by the column ``by``, in one plan: (table, counters).

    Each sheet is cleaned as if alone. F04 differs by sheet, so a feature that is too
    sparse in a sheet becomes NULL in its rows and does not count in F05 (one row of
    ratios per sheet is joined back). Counters are one row per sheet (A05).
    """
    df = before_missing(raw, params, (by,))
    feats = [f for f in params.features if f in df.columns]
    ratios = df.groupBy(by).agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f"_r_{f}") for f in feats])
    sparse = {f: F.col(f"_r_{f}") > F.lit(params.col_missing_threshold) for f in feats}
    df = df.join(ratios, by)
    kept = sum((F.when(s, 0).otherwise(1) for s in sparse.values()), F.lit(0))
    nulls = sum((F.when(~s & F.col(f).isNull(), 1).otherwise(0) for f, s in sparse.items()), F.lit(0))
    df = df.where((kept == 0) | (nulls / kept.cast("double") <= F.lit(params.row_missing_threshold)))
    df = df.withColumns({f: F.when(~s, F.col(f)) for f, s in sparse.items()})
    table = validate(df.drop(*[f"_r_{f}" for f in feats])).drop("tanggal_lahir")
    nulls_of = {n: F.count_if(F.col(c).isNull()) for n, c in (("umur_invalid", "umur"), ("imt_invalid", "imt"), ("td_invalid", "sistolik"))}
    valid = table.groupBy(by).agg(F.count(F.lit(1)).alias("total_valid"), F.count_distinct("desa").alias("total_desa"), *[x.alias(n) for n, x in nulls_of.items()])
    counts = raw.groupBy(by).agg(F.count(F.lit(1)).alias("total_baris_mentah")).join(valid, by, "left").fillna(0)
    return table, counts.withColumns({"baris_dihapus": F.col("total_baris_mentah") - F.col("total_valid"), "sheets_diproses": F.lit(1)})


def clean_screening(raw: DataFrame, params: C.CleanParams = C.CleanParams(),
                    sort: bool = True, persist: bool = True) -> CleanResult:
    df = cached = encoded(raw, params) if persist else None
    if df is None:
        df = before_missing(raw, params)
    feats = [f for f in params.features if f in df.columns]
    dropped = sparse_columns(df, feats, params.col_missing_threshold)
    if dropped:
        df = df.drop(*dropped)
    kept = [f for f in feats if f not in dropped]
    df = drop_sparse_rows(df, kept, params.row_missing_threshold)
    df = validate(df)
    if sort:
        df = sort_output(df)
    df = df.drop("tanggal_lahir")
    return CleanResult(table=df, raw=raw, dropped_columns=dropped, features=kept, cached=cached)
