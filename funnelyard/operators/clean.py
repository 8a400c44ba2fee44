"""Profiling and cleaning.

Every profile is a single aggregate (or one unpivot + aggregate) over the
input, so it runs as one distributed job with map-side partial aggregation.
Issues are built with ``filter(array(when ...))`` — no Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelyard.functions.core import from_h, pct_h, strip_ws

# --- fixed values -----------------------------------------------------------
NULL_TOKENS = ("nan", "null", "none", "n/a")
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
ISSUE_TYPE = "struct<type:string,column:string,original_value:string,cleaned_value:string,severity:string>"
# ---------------------------------------------------------------------------


def _as_text(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("string")


def _row_digest(cols: Sequence[str]) -> Column:
    """SHA-256 of a row's values (nulls kept), equal for equal rows."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"}), 256).alias("_digest")


# ---------------------------------------------------------------------- B1
def profile_table(df: DataFrame, order_by: Sequence[str] | None = None, sample: int = 5) -> DataFrame:
    """B1 — one row: rows, columns, missing cells, fully duplicate rows,
    missing %, duplicate %, ``score = max(0, 100 - missing% - duplicate%)``
    and ``sample`` rows (JSON, first by ``order_by``).

    Duplicates are ``sum(n - 1)`` over the groups of equal row digests: one
    shuffle of digests and counts, never of the rows.
    """
    cols = df.columns
    ncols = len(cols)
    missing = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    grouped = df.groupBy(_row_digest(cols)).agg(F.count(F.lit(1)).alias("_n"), F.sum(missing).alias("_miss"))
    stats = grouped.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
                        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
                        F.coalesce(F.sum("_miss"), F.lit(0)).cast("long").alias("missing_values"))
    cells = F.col("rows") * ncols
    m_h = F.coalesce(pct_h("missing_values", cells), F.lit(0).cast("long"))
    d_h = F.coalesce(pct_h("duplicate_rows", "rows"), F.lit(0).cast("long"))
    out = stats.select(
        "rows", F.lit(ncols).alias("columns"), "missing_values", "duplicate_rows",
        from_h(m_h).alias("missing_percentage"), from_h(d_h).alias("duplicate_percentage"),
        from_h(F.greatest(F.lit(0).cast("long"), F.lit(10000) - m_h - d_h)).alias("quality_score"))
    if order_by:
        first = df.orderBy(*order_by).limit(sample)
        js = first.select(F.struct(*[F.col(c) for c in order_by]).alias("_k"),
                          F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("_j"))
        samp = js.agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_j"))),
                                  lambda s: s["_j"]).alias("sample_rows"))
        out = out.crossJoin(samp)
    return out


# ---------------------------------------------------------------------- B2
def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """B2 — per column: Spark type, missing count and distinct non-null
    values (exact, or HyperLogLog++ with ``approx``), from one unpivot."""
    cols = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), _as_text(df, c).alias("v"))
        for i, c in enumerate(cols)])).alias("u")).select("u.*")
    distinct = F.approx_count_distinct("v") if approx else F.count_distinct("v")
    agg = long.groupBy("position", "name").agg(F.count_if(F.col("v").isNull()).alias("missing"),
                                                distinct.alias("unique_values"))
    tmap = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return agg.select("position", "name", tmap[F.col("name")].alias("dtype"), "missing", "unique_values")


# ---------------------------------------------------------------------- B3
def count_null_tokens(df: DataFrame) -> DataFrame:
    """B3 — per column: cells that are null (short rows are padded with
    null by the CSV reader), blank, or a null token (nan/null/none/n/a)."""
    cols = df.columns
    one = df.agg(*[F.count_if(F.col(c).isNull() | (F.lower(F.trim(_as_text(df, c)))
                                                  .isin("", *NULL_TOKENS))).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"),
                                                   F.col(c).alias("missing"))
                                          for i, c in enumerate(cols)])).alias("x")).select("x.*")


# ---------------------------------------------------------------------- B4
def clean_records(df: DataFrame, keys: Sequence[str] = ("row_number",)) -> DataFrame:
    """B4 — per cell: blank -> null (``missing_value``, warning); surrounding
    whitespace stripped (``whitespace_normalized``, info); in a column whose
    name contains "email", a value that is not an address is
    ``invalid_email`` (error).  Outputs the cleaned columns, the issue list,
    its size and ``clean``/``issues_found``."""
    value_cols = [c for c in df.columns if c not in keys]
    cleaned, issues = [], []
    for c in value_cols:
        v = _as_text(df, c)
        is_str = isinstance(df.schema[c].dataType, T.StringType)
        stripped = strip_ws(v) if is_str else v
        missing = F.col(c).isNull() | ((stripped == "") if is_str else F.lit(False))
        norm = F.when(missing, F.lit(None).cast("string")).otherwise(stripped)
        cleaned.append((norm if is_str else F.when(~missing, F.col(c))).alias(c))
        issues.append(F.when(missing, F.struct(F.lit("missing_value").alias("type"), F.lit(c).alias("column"),
                                                v.alias("original_value"),
                                                F.lit(None).cast("string").alias("cleaned_value"),
                                                F.lit("warning").alias("severity"))))
        if is_str:
            issues.append(F.when(~missing & (stripped != v), F.struct(
                F.lit("whitespace_normalized").alias("type"), F.lit(c).alias("column"),
                v.alias("original_value"), stripped.alias("cleaned_value"), F.lit("info").alias("severity"))))
        if "email" in c.lower():
            bad = ~missing & (~stripped.rlike(EMAIL_PATTERN) if is_str else F.lit(True))
            issues.append(F.when(bad, F.struct(
                F.lit("invalid_email").alias("type"), F.lit(c).alias("column"), v.alias("original_value"),
                F.lit(None).cast("string").alias("cleaned_value"), F.lit("error").alias("severity"))))
    arr = F.filter(F.array(*issues), lambda x: x.isNotNull()) if issues else F.array().cast(
        f"array<{ISSUE_TYPE}>")
    out = df.select(*[F.col(k) for k in keys], *cleaned, arr.alias("issues"))
    return out.withColumn("issue_count", F.size("issues")).withColumn(
        "cleaning_status", F.when(F.col("issue_count") > 0, "issues_found").otherwise("clean"))


def explode_issues(cleaned: DataFrame, keys: Sequence[str] = ("row_number",)) -> DataFrame:
    """One row per issue (flat form of B4's issue list)."""
    return cleaned.select(*keys, F.explode("issues").alias("i")).select(*keys, "i.*")


# ---------------------------------------------------------------------- B5
def clean_summary(cleaned: DataFrame) -> DataFrame:
    """B5 — records processed, issues, rows per status and issues per type."""
    return cleaned.agg(
        F.count(F.lit(1)).alias("records_processed"),
        F.coalesce(F.sum("issue_count"), F.lit(0)).cast("long").alias("issues_found"),
        F.count_if(F.col("cleaning_status") == "clean").alias("clean_rows"),
        F.count_if(F.col("cleaning_status") == "issues_found").alias("rows_with_issues"),
        *[F.coalesce(F.sum(F.size(F.filter("issues", _is_type(t)))), F.lit(0)).cast("long").alias(t)
          for t in ("missing_value", "whitespace_normalized", "invalid_email")])


def _is_type(t: str):
    return lambda x: x["type"] == F.lit(t)


# ---------------------------------------------------------------------- B7/B8
def drop_placeholders(df: DataFrame, cols: Sequence[str], keep_missing: bool = False) -> DataFrame:
    """B8 — drop rows whose members are placeholders ('', none, null, n/a,
    na, unknown, -, none/unknown, total, grand total, grand_total) unless
    the caller asks for missing data."""
    from funnelyard.functions.core import not_placeholder
    return df if keep_missing else df.filter(not_placeholder(cols))


# ---------------------------------------------------------------------- B10
def reconcile_load(staged: DataFrame, metrics: DataFrame) -> DataFrame:
    """B10 — per dataset: staged rows, normalised rows, duplicate
    ``(dataset_id, row_number)`` keys in the metrics table, and whether the
    staging rows may be cleared (counts equal, no duplicates)."""
    s = staged.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("staged_rows"))
    m = metrics.groupBy("dataset_id", "row_number").agg(F.count(F.lit(1)).alias("_n")).groupBy(
        "dataset_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("normalised_rows"),
                          F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_keys"))
    j = s.join(m, "dataset_id", "full")
    return j.select("dataset_id", F.coalesce("staged_rows", F.lit(0)).cast("long").alias("staged_rows"),
                    F.coalesce("normalised_rows", F.lit(0)).cast("long").alias("normalised_rows"),
                    F.coalesce("duplicate_keys", F.lit(0)).cast("long").alias("duplicate_keys")).withColumn(
        "counts_match", F.col("staged_rows") == F.col("normalised_rows")).withColumn(
        "may_clear", F.col("counts_match") & (F.col("duplicate_keys") == 0))

