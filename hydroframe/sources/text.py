"""Whitespace-separated text sources.

Spark's CSV reader has no regex separator, so files are read with the text source, split on
runs of blanks and cast with ``try_cast``; ``nan``/``NaN`` become null. One read covers all
stations' files of a layout (a glob); the station comes from the file name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.functions.scalar import nan_to_null
from hydroframe.operators.quantile import small
from hydroframe.session import cut_lineage

KEY = "station_id"
INT_COLUMNS = ("year", "month", "day", "gauge_id")


def _tokens(value_col: str = "value"):
    return F.split(F.trim(F.col(value_col)), r"\s+")


def parse_whitespace_lines(df: DataFrame, columns: list[str], value_col: str = "value",
                           string_columns: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """S1 core: one text line per row → typed columns by position. Header lines (first token equal
    to the first column name) and blank lines are dropped; numbers are ``try_cast`` (bad → null),
    ``nan``/``NaN`` → null; ``year/month/day`` are INT, ``string_columns`` stay text, others DOUBLE."""
    t = _tokens(value_col)
    d = df.filter((F.trim(F.col(value_col)) != "") & (t[0] != F.lit(columns[0])))
    out = [_typed(F.try_element_at(t, F.lit(i)), c, string_columns) for i, c in enumerate(columns, 1)]
    return d.select(*keep, *out)


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their file, and ``_place``, by which a file's lines stand in order: where the split begins, then the line's
    number in it."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), place.alias("_place"))


def file_headers(lines: DataFrame) -> DataFrame:
    """First line of each file, split into column names (``file_path``, ``file_name``, ``header``): a row a file."""
    first = lines.filter("_place.block = 0").groupBy("file_path", "file_name").agg(F.min_by("value", "_place").alias("h"))
    return first.select("file_path", "file_name", F.split(F.trim("h"), r"\s+").alias("header"))


def _typed(tok: Column, name: str, string_columns: tuple[str, ...]) -> Column:
    if name in string_columns:
        return tok.alias(name)
    if name in INT_COLUMNS:
        return tok.try_cast("int").alias(name)
    return nan_to_null(tok.try_cast("double")).alias(name)


def read_whitespace_table(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None,
                          string_columns: tuple[str, ...] = ()) -> DataFrame:
    """Read one layout of whitespace tables (glob or list), with ``file_name`` kept.

    Without ``columns`` each file's values go by its own header, so files may have their columns in any order or lack
    some (null there): one pass reads the first lines, and if they differ, the headers (a row a file, broadcast if they are counted and
    few) meet the lines by file. With ``columns``, values go by place and nothing is read beforehand.
    """
    lines = _lines(spark, paths)
    if columns is not None:
        return parse_whitespace_lines(lines, columns, string_columns=string_columns, keep=("file_name",))
    heads = cut_lineage(file_headers(lines))
    kinds = [r["header"] for r in heads.select("header").distinct().orderBy("header").limit(2).collect()]
    if not kinds:
        raise ValueError(f"no line in {paths}")
    if len(kinds) == 1:
        return parse_whitespace_lines(lines, kinds[0], string_columns=string_columns, keep=("file_name",))
    names = heads.select(F.posexplode("header").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name")
    heads = heads.select(F.col("file_path").alias("_f"), "header")
    d = lines.join(small(heads), F.col("file_path") == F.col("_f")).withColumn("_t", _tokens())
    d = d.filter((F.trim("value") != "") & (F.col("_t")[0] != F.col("header")[0]))
    token = lambda c: F.try_element_at("_t", F.nullif(F.array_position("header", F.lit(c)).cast("int"), F.lit(0)))
    return d.select("file_name", *(_typed(token(r["name"]), r["name"], string_columns) for r in names.collect()))


def read_daily_files(spark: SparkSession, directory: str, variable: str, columns: list[str] | None = None,
                     strict_dates: bool = False, keep_undated: bool = False) -> DataFrame:
    """S1 + S2 + P1: all stations' ``<station>_<variable>.txt`` files in one scan → station_id,
    date + the file's value columns. Rows whose date is impossible raise (``strict_dates``), stay with a null date
    (``keep_undated``, as coverage checks count them) or go."""
    from hydroframe.operators.prepare import build_date
    t = read_whitespace_table(spark, f"{directory}/*_{variable}.txt", columns)
    t = t.withColumn(KEY, F.regexp_extract("file_name", rf"^(.+)_{variable}\.txt$", 1)).drop("file_name")
    t = build_date(t, strict=strict_dates)
    return t if strict_dates or keep_undated else t.filter(F.col("date").isNotNull())


def file_listing(spark: SparkSession, directory: str) -> DataFrame:
    """S6 input: daily file names under a folder. Paths alone are listed, no file is read; files without a byte are not listed."""
    files = spark.read.format("binaryFile").load(f"{directory}/*.txt").select("path")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"))


def read_monthly_index(spark: SparkSession, path: str) -> DataFrame:
    """S3: monthly index file: first line skipped, no header, ``year`` + 12 monthly values.
    Returns the wide table (year, oni_01..oni_12); use ``monthly_index_long`` (U1) to melt."""
    cols = ["year", *[f"oni_{m:02d}" for m in range(1, 13)]]
    raw = _lines(spark, path)
    first = raw.filter("_place.block = 0").groupBy("file_path").agg(F.min("_place").alias("_first"))
    body = raw.join(first, "file_path", "inner").filter(F.col("_place") != F.col("_first"))
    t = _tokens("value")
    year = F.try_element_at(t, F.lit(1)).try_cast("double")
    vals = [nan_to_null(F.try_element_at(t, F.lit(i + 1)).try_cast("double")).alias(c) for i, c in enumerate(cols)
            if i > 0]
    return body.select(year.alias("year"), *vals).filter(F.col("year").between(1900, 2100)) \
               .withColumn("year", F.col("year").cast("int"))


def _attribute_rows(spark: SparkSession, directory: str, pattern: str) -> tuple[DataFrame, dict[str, list[str]], set[tuple[str, int]]]:
    """All attribute files in one scan: their rows (``name``, ``gauge_id``, values ``v``, ``_place``), each file's columns by name, in
    order of names, and which (name, place of the column) are numbers throughout. Files without ``gauge_id`` first are skipped."""
    lines = _lines(spark, f"{directory}/{pattern}")
    prefix = pattern.split("*")[0]
    name = F.regexp_extract("file_name", rf"^{re.escape(prefix)}(.*)\.[^.]*$", 1).alias("name")
    t = _tokens()
    rows = cut_lineage(lines.filter(F.trim("value") != "").select(name, "_place", t.alias("v")))
    heads = rows.filter("_place.block = 0").groupBy("name").agg(F.min_by("v", "_place").alias("h")).filter("h[0] = 'gauge_id'")
    columns = {r["name"]: r["h"] for r in heads.orderBy("name").collect()}  # a line a file
    rows = rows.filter(F.col("name").isin(list(columns)) & (F.col("v")[0] != "gauge_id"))
    number = nan_to_null(F.col("x").try_cast("double")).isNotNull() | F.lower("x").isin("nan", "na") | F.col("x").isNull()
    seen = rows.select("name", F.posexplode("v").alias("at", "x")).groupBy("name", "at").agg(F.bool_and(number).alias("ok"))
    numeric = {(r["name"], r["at"]) for r in seen.filter("ok").collect()}  # a row a column
    return rows.withColumn("gauge_id", F.col("v")[0]), columns, numeric


def _value(name: str, at: int, numeric: set[tuple[str, int]], v: Column) -> Column:
    tok = F.try_element_at(v, F.lit(at + 1))
    return nan_to_null(tok.try_cast("double")) if (name, at) in numeric else tok


def read_attribute_tables(spark: SparkSession, directory: str, pattern: str = "camels_br_*.txt",
                          keep: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Every attribute file (sorted by name) as its own DataFrame keyed by ``gauge_id`` (STRING,
    trimmed). All files are read in one scan; their headers and which columns are numeric (every value parses) come to the
    driver; files without ``gauge_id`` are skipped; ``keep`` selects columns per table name (the part after the prefix)."""
    rows, columns, numeric = _attribute_rows(spark, directory, pattern)
    out = {}
    for name, cols in columns.items():
        t = rows.filter(F.col("name") == name).select("gauge_id", *(_value(name, i, numeric, F.col("v")).alias(c) for i, c in enumerate(cols) if i))
        out[name] = t.select("gauge_id", *keep[name]) if keep and name in keep else t
    return out


def read_static_attributes(spark: SparkSession, directory: str, pattern: str = "camels_br_*.txt") -> DataFrame:
    """S4 + J5 as one step: per station (``station_id``) the first row of each attribute file, in the file's order, as columns
    ``static_<file>_<column>`` (null where a file lacks the station); numeric columns are DOUBLE, others text.

    One scan of all files and one shuffle on the gauge: a gauge's first rows are the least by place in the file, so
    the result is the same however the files are split.
    """
    rows, columns, numeric = _attribute_rows(spark, directory, pattern)
    firsts = rows.groupBy("gauge_id", "name").agg(F.min_by("v", "_place").alias("v"))
    firsts = firsts.groupBy(F.col("gauge_id").alias(KEY)).agg(*(F.max(F.when(F.col("name") == n, F.col("v"))).alias(f"_{i}") for i, n in enumerate(columns)))
    held = [_value(n, at, numeric, F.col(f"_{i}")).alias(f"static_{n}_{c}") for i, (n, cols) in enumerate(columns.items()) for at, c in enumerate(cols) if at]
    return firsts.select(KEY, *held)
