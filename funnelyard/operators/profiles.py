"""Mergeable profiles of staged files (B1, B2, B5, D3): summaries per file that add up to those of a dataset.

A staged row is a JSON object with the columns of its own file, so a file is measured by its own columns, whatever
else is loaded with it.  Four small tables hold what a dataset's reports need; each is partitioned like the rows,
by ``(dataset_id, file_key)``, and a dataset's report reads these tables only, never its rows:

* ``files``   — rows, cells, null cells, rows with issues and issues by type,
* ``columns`` — per column: cells, null cells, issues and a sketch of its values (HLL, mergeable),
* ``digests`` — how often each row digest occurs (exact duplicates, also between files),
* ``years``   — how often each year occurs in the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelyard.functions.core import from_h, pct_h, strip_ws
from funnelyard.operators.clean import EMAIL_PATTERN
from funnelyard.operators.ingest import cells_of
from funnelyard.operators.periods import HEADER_YEAR, detect_from_signals

FILE = ("dataset_id", "file_key")
ISSUES = ("missing_value", "whitespace_normalized", "invalid_email")
#: Characters at a value's end that the pattern of ``strip_ws`` looks at: white space, and line ends that it may stand before.
_LAST = (" ", "\t", "\n", "\v", "\f", "\r", "\x85", "\u2028", "\u2029")


def cell_issues(name: Column, value: Column, stripped: Column | None = None) -> dict[str, Column]:
    """The issues of one cell, by the rules of B4; ``stripped`` is its value without outer white space, if known."""
    stripped = strip_ws(value) if stripped is None else stripped
    missing = value.isNull() | (stripped == "")
    return {"missing_value": missing, "whitespace_normalized": ~missing & (stripped != value),
            "invalid_email": ~missing & F.lower(name).contains("email") & ~stripped.rlike(EMAIL_PATTERN)}


def _n(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("long")


def _is_bare(value: Column) -> Column:
    """True for values that neither are blank nor have white space at an end, told by their first and last bytes; where it
    isn't true, :func:`strip_ws` has to look."""
    bare = value >= F.lit("!")  # white space and the empty string are less
    for c in _LAST:
        bare = bare & ~F.endswith(value, F.lit(c))
    return F.coalesce(bare, F.lit(False))


def column_summaries(staged: DataFrame) -> DataFrame:
    """``columns``: one row per file and column of ``staged`` (dataset_id, file_key, raw_data or cells)."""
    e = staged.select(*FILE, F.explode(cells_of(staged)).alias("column", "value"))
    e = e.select("*", F.when(_is_bare(F.col("value")), F.col("value")).otherwise(strip_ws("value")).alias("stripped"))
    kinds = cell_issues(F.col("column"), F.col("value"), F.col("stripped"))
    return e.groupBy(*FILE, "column").agg(
        F.count(F.lit(1)).alias("cells"), F.sum(_n(F.col("value").isNull())).alias("nulls"), *[F.sum(_n(kinds[k])).alias(k) for k in ISSUES],
        F.hll_sketch_agg(F.coalesce("value", F.lit("")), 12).alias("sketch"))


def file_summaries(staged: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """``files``: one row per file of ``staged``.  ``columns`` are its :func:`column_summaries`, if they are stored: cells and
    issues add up from them, and only rows are counted here."""
    columns = column_summaries(staged) if columns is None else columns

    def off(value: Column) -> Column:  # missing, or with white space at an end
        return F.when(_is_bare(value), F.lit(False)).otherwise(value.isNull() | (value == "") | (strip_ws(value) != value))

    def mail(c: Column) -> Column:
        return F.coalesce(cell_issues(c["key"], c["value"])["invalid_email"], F.lit(False))

    rows = staged.select(*FILE, cells_of(staged).alias("cells"))
    may_mail = F.lower(F.array_join(F.map_keys("cells"), "\n")).contains("email")
    bad = F.exists(F.map_values("cells"), off) | F.when(may_mail, F.exists(F.map_entries("cells"), mail)).otherwise(F.lit(False))
    counted = rows.select(*FILE, bad.alias("bad")).groupBy(*FILE).agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("rows_with_issues"))
    sums = columns.groupBy(*FILE).agg(*[F.sum(c).alias(c) for c in ("cells", "nulls", *ISSUES)])
    return counted.join(sums, list(FILE), "left").select(*FILE, "rows", "cells", "nulls", "rows_with_issues", *ISSUES)


def digest_counts(staged: DataFrame) -> DataFrame:
    """``digests``: one row per file and distinct row; equal rows have equal cells by name."""
    cells = F.sort_array(F.map_entries(cells_of(staged)))
    digest = F.unhex(F.substring(F.sha2(F.to_json(cells, {"ignoreNullFields": "false"}), 256), 1, 32))
    return staged.groupBy(*FILE, digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def year_counts(staged: DataFrame) -> DataFrame:
    """``years``: one row per file and year that stands in its values."""
    # most rows have no year: their values are looked through at once, not one by one
    rows = staged.select(*FILE, cells_of(staged).alias("cells")).select("*", F.array_join(F.map_values("cells"), "\n").alias("all"))
    some = rows.where(F.contains("all", F.lit("20")) & F.col("all").rlike(HEADER_YEAR))
    e = some.select(*FILE, F.explode("cells").alias("column", "value"))
    found = e.select(*FILE, F.regexp_extract("value", HEADER_YEAR, 1).alias("y")).where("y <> ''")
    return found.groupBy(*FILE, F.col("y").cast("int").alias("yr")).agg(F.count(F.lit(1)).alias("n"))


def merge_quality(files: DataFrame, columns: DataFrame, digests: DataFrame) -> DataFrame:
    """B1 and B5 per dataset from the stored summaries: rows, columns, missing cells, duplicate rows, percentages, score,
    rows with issues and issues.  A file's cells are its rows times its own columns."""
    f = files.groupBy("dataset_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("rows", "cells", "nulls", "rows_with_issues", *ISSUES)])
    c = columns.groupBy("dataset_id").agg(F.count_distinct("column").cast("int").alias("columns"))
    d = (digests.groupBy("dataset_id", "digest").agg(F.sum("n").alias("n")).groupBy("dataset_id")
         .agg(F.sum(F.col("n") - 1).cast("long").alias("duplicate_rows")))
    j = f.join(c, "dataset_id", "left").join(d, "dataset_id", "left")
    zero = F.lit(0).cast("long")
    m_h, d_h = F.coalesce(pct_h("nulls", F.col("cells")), zero), F.coalesce(pct_h("duplicate_rows", "rows"), zero)
    return j.select(
        "dataset_id", "rows", F.coalesce("columns", F.lit(0)).alias("columns"), F.col("nulls").alias("missing_values"),
        F.coalesce("duplicate_rows", zero).alias("duplicate_rows"), from_h(m_h).alias("missing_percentage"), from_h(d_h).alias("duplicate_percentage"),
        from_h(F.greatest(zero, F.lit(10000) - m_h - d_h)).alias("quality_score"), "rows_with_issues",
        (F.col(ISSUES[0]) + F.col(ISSUES[1]) + F.col(ISSUES[2])).alias("issues_found"), *ISSUES)


def merge_columns(columns: DataFrame) -> DataFrame:
    """B2 per dataset and column from the stored summaries; ``unique_values`` is the sketch's estimate (2 % error),
    blanks and nulls counting as one value."""
    return columns.groupBy("dataset_id", "column").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("cells", "nulls", *ISSUES)], F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_values"))


def merge_periods(files: DataFrame, columns: DataFrame, years: DataFrame) -> DataFrame:
    """D3 per dataset from the stored summaries; ``files`` is (dataset_id, original_filename)."""
    return detect_from_signals(files, columns.select("dataset_id", F.col("column").alias("k")).distinct(),
                               years.groupBy("dataset_id", "yr").agg(F.sum("n").alias("count")))


def file_rows(files: DataFrame) -> DataFrame:
    """(file_key, n_rows) of the summarised files."""
    return files.select("file_key", F.col("rows").cast("long").alias("n_rows"))
