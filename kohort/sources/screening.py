"""Screening sheet sources: S01 column projection, S02 rename by map, S03 header
normalisation, S04 preview, F11 search page."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kohort.session import materialize

from kohort import config as C
from kohort.functions.text import clean_header


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``row_id``, the position of each row by (file path, place in the file).

    Rows of a split are read in order; the splits' row counts, one row per split, give
    the offsets. The ids do not depend on how files are split or packed into tasks.
    ``df`` must come straight from a file reader; ``_file`` keeps the path.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_m"))
    splits = at.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)      # a row per split
    offsets = splits.select("_file", "_block", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return at.join(offsets, ["_file", "_block"]).withColumn("row_id", F.col("_off") + F.col("_m") - F.col("_m0")).drop("_block", "_m", "_m0", "_off")


def read_screening(spark: SparkSession, path: str | list[str], fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Read a screening sheet with its original headers.

    S01: only the 19 required headers are read (all as text; typing happens in
    cleaning); a missing one is an error. S02: renamed by the fixed map. Extra
    columns are ignored. ``row_id`` (file order) is taken from the data when it
    has one, else numbered by file path and place in the file. CSV is read in
    splits; ``multi_line`` allows line breaks inside quoted cells, at the price
    of one task per file.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False).option("multiLine", multi_line)
    df = reader.load(path)
    if "row_id" not in df.columns:
        df = numbered(df)
    return _renamed(df)


def _renamed(df: DataFrame, more: tuple = ()) -> DataFrame:
    """The sheet columns by original header or snake_case name, as text."""
    by_name = {c.strip(): c for c in df.columns}
    source = {c: by_name.get(h, by_name.get(c)) for h, c in C.HEADER_MAP.items()}
    missing = [h for h, c in C.HEADER_MAP.items() if source[c] is None]
    if missing:
        raise ValueError(f"screening sheet lacks headers: {missing}")
    return df.select(F.col("row_id").cast("long").alias("row_id"), *[F.col(f"`{source[c]}`").cast("string").alias(c) for c in C.RAW_COLUMNS], *more)


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The cells of a CSV file's first record (read on the driver, one line)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        text = lines.readLine()
        while text is not None and text.count('"') % 2 and (more := lines.readLine()) is not None:
            text += "\n" + more
    finally:
        stream.close()
    return tuple(next(csv.reader([text.lstrip("\ufeff")]), ())) if text else ()


def _loadable(spark: SparkSession, uri: str) -> str:
    """The path that a file URI stands for, as the readers take it."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString()


def read_sheets(spark: SparkSession, sheets: list[list[str]], fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Several sheets as one table with ``_file``; each is read by its own headers, and its rows
    keep their order. A sheet is a list of files, one or the parts that share the headers of the
    first part with any; files are URIs as ``_metadata.file_path`` names them. An empty file has
    no rows."""
    if fmt != "csv":
        df = spark.read.format(fmt).load([_loadable(spark, p) for files in sheets for p in files])
        return _renamed(df.withColumn("_file", F.col("_metadata.file_path")) if "row_id" in df.columns else numbered(df), ("_file",))
    groups: dict[tuple, list[str]] = {}
    for files in sheets:
        cells = next(filter(None, (_header(spark, p) for p in files)), ())
        groups.setdefault(cells, []).extend(files)
    groups.pop((), None)
    parts = []
    for cells, own in groups.items():
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in cells)
        df = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).csv([_loadable(spark, p) for p in own])
        parts.append(_renamed(df.withColumn("_file", F.col("_metadata.file_path")) if "row_id" in df.columns else numbered(df), ("_file",)))
    if not parts:
        return spark.createDataFrame([], "row_id long, " + ", ".join(f"{c} string" for c in C.RAW_COLUMNS) + ", _file string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def normalise_headers(df: DataFrame) -> DataFrame:
    """Every column name to snake_case (schema-only change)."""
    return df.toDF(*[clean_header(c) for c in df.columns])


def preview(df: DataFrame, n: int = 10, order: str = "row_id") -> DataFrame:
    """First ``n`` rows in file order (top-k plan)."""
    return df.orderBy(F.col(order).asc()).limit(n)


PAGE_SIZES = (5, 10, 25, 50, 100)


def matching(df: DataFrame, term: str = "") -> DataFrame:
    """The rows that hold the term in any column, whatever its case."""
    if not term:
        return df
    return df.where(F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in df.columns])).contains(term.lower()))


def search_page(df: DataFrame, term: str = "", order_by: str = "row_id", ascending: bool = True,
                page: int = 1, size: int = 10, key: str = "row_id") -> DataFrame:
    """case-insensitive text search over all columns, ordered (ties by ``key``), one page.

    The page is cut out by global places (rows counted per sorted range), so no task or driver holds
    the rows of the pages before it. ``next_page`` goes on from a page's last row."""
    from kohort.operators.stats import global_rank
    if size not in PAGE_SIZES:
        raise ValueError("page size must be one of 5, 10, 25, 50, 100")
    found = matching(df, term)
    if page == 1:
        return found.orderBy(*_order(order_by, ascending, key)).limit(size)
    names = list(dict.fromkeys([order_by, key]))
    places = global_rank(materialize(found.select(*names)), _order(order_by, ascending, key), "_place")
    first = (page - 1) * size
    wanted = places.where(F.col("_place").between(first, first + size - 1)).select(F.col(key).alias("_key"))      # at most size rows
    return found.join(F.broadcast(wanted), F.col(key) == F.col("_key"), "left_semi").orderBy(*_order(order_by, ascending, key))


def next_page(df: DataFrame, after: tuple, term: str = "", order_by: str = "row_id", ascending: bool = True, size: int = 10, key: str = "row_id") -> DataFrame:
    """the page that follows the row ``after`` = (value of ``order_by``, key): a filter and a top-k,
    whatever the page's number."""
    if size not in PAGE_SIZES:
        raise ValueError("page size must be one of 5, 10, 25, 50, 100")
    value, last = after
    x, k = F.col(order_by), F.col(key)
    if value is None:       # nulls come first when ascending, last when descending
        later = x.isNull() & (k > F.lit(last))
        later = later | x.isNotNull() if ascending else later
    else:
        later = (x > F.lit(value)) | ((x == F.lit(value)) & (k > F.lit(last))) if ascending else (x < F.lit(value)) | ((x == F.lit(value)) & (k > F.lit(last))) | x.isNull()
    return matching(df, term).where(later).orderBy(*_order(order_by, ascending, key)).limit(size)


def _order(order_by: str, ascending: bool, key: str) -> list:
    return [F.col(order_by).asc() if ascending else F.col(order_by).desc(), F.col(key).asc()]
