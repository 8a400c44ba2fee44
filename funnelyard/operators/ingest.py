"""Staging, normalisation, upsert and fingerprinting.

* Row numbers are dense per dataset and computed with the distributed
  numbering of :func:`funnelyard.functions.ordinal.ordinal_within` (no
  global window).
* Numbers like ``"1,234"`` are parsed with ``try_cast`` so a bad cell never
  aborts a load (ANSI mode stays on); the row is kept with 0 and reported.
* Upserts are a join on the key plus last-write-wins among updates by
  ``max_by`` (an aggregate, so a key repeated many times is combined map-side).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelyard.functions.ordinal import ordinal_within
from funnelyard.session import ensure_checkpoint_dir

# --- fixed values -----------------------------------------------------------
TEXT_FIELDS = ("owner", "cluster", "lead_type", "main_source", "source", "campus_name", "state",
               "program_name")
NUMBER_FIELDS = ("cy_leads", "cy_registration", "cy_admission", "py_leads", "py_registration",
                 "py_admission")
_WHOLE = "^[+-]?[0-9]{1,18}$"
# ---------------------------------------------------------------------------


# ---------------------------------------------------------------------- A2
def stage_records(df: DataFrame, dataset_id: str | Column, order_by: Sequence[str | Column] | None = None,
                  payload: Sequence[str] | None = None) -> DataFrame:
    """A2 — one JSON document per row (nulls kept as ``null``), a dense
    1-based ``row_number`` per dataset in ``order_by`` order, status
    ``pending``.  ``payload`` limits the JSON to some columns (default all).

    Without ``order_by`` the rows of one dataset (a literal id) are numbered in the
    input's own order, as they stand in its partitions: one count per
    partition, no sort, no shuffle and no checkpoint of the payload.  The input must then be
    read alike each time: a stored table or a plain scan."""
    ds = F.lit(dataset_id) if isinstance(dataset_id, str) else dataset_id
    cols = list(payload) if payload is not None else df.columns
    raw = F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})
    if order_by is None:
        if not isinstance(dataset_id, str):
            raise ValueError("rows of several datasets need order_by")
        return number_in_place(df.select(ds.alias("dataset_id"), raw.alias("raw_data"))).select(
            "dataset_id", "row_number", "raw_data", F.lit("pending").alias("cleaning_status"))
    keys = [F.col(o) if isinstance(o, str) else o for o in order_by]
    staged = df.select(ds.alias("dataset_id"), *[k.alias(f"_o{i}") for i, k in enumerate(keys)],
                       raw.alias("raw_data"))
    numbered = ordinal_within(staged, ["dataset_id"], [f"_o{i}" for i in range(len(keys))])
    return numbered.select("dataset_id", "row_number", "raw_data",
                           F.lit("pending").alias("cleaning_status"))


def number_in_place(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Adds dense 1-based numbers in the order of the partitions and the rows in them.

    Positions come from ``monotonically_increasing_id`` (partition in the upper 31 bits, place in the lower 33); the
    counts of the partitions, one row each, turn into offsets.  Rows never move."""
    at = F.monotonically_increasing_id()
    counts = df.select(F.shiftright(at, 33).alias("_p")).groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = df.select("*", F.shiftright(at, 33).alias("_p"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    return (placed.join(F.broadcast(starts), "_p")  # one row per partition
            .withColumn(name, (F.col("_start") + F.col("_i") + 1).cast("long")).drop("_p", "_i", "_start"))


# ---------------------------------------------------------------------- A3
def expand_staged(staged: DataFrame, mapping: Mapping[str, str],
                  keep: Sequence[str] = ("dataset_id", "row_number")) -> DataFrame:
    """A3 — JSON fields to columns: ``mapping`` is target -> JSON key (any
    characters; parsed once as a map)."""
    m = F.from_json("raw_data", "map<string,string>")
    return staged.select(*keep, *[m.getItem(k).alias(t) for t, k in mapping.items()])


def cells_of(staged: DataFrame) -> Column:
    """The cells of staged rows by their column's name, read from ``raw_data``; rows without it carry them as ``cells``."""
    return F.from_json("raw_data", "map<string,string>") if "raw_data" in staged.columns else F.col("cells")


# ---------------------------------------------------------------------- A4
def parse_number(c: Column) -> Column:
    """``"1,234"`` -> 1234, fractions rounded once, half away from zero; null
    when not a number or beyond a long (callers decide between 0 and a reject).

    Plain decimals are rounded by their first fraction digit, at any length;
    other notations (``1e3``) go through the widest decimal."""
    return _number(_bare(c))


def _bare(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit(""))


def _cell_number(s: Column) -> Column:
    """As :func:`_number`, for many columns of a row: whole numbers of up to 18 digits, which always fit a long, are read by the row's
    own code; the other rules are called where they are needed, since code that holds them for each column is too long for the JVM to compile."""
    return F.when(s.rlike(_WHOLE), s.try_cast("long")).when(s.isNotNull(), F.transform(F.array(s), _number)[0])


def _number(s: Column) -> Column:
    plain = s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    digits = F.regexp_extract(s, "^[+-]?([0-9]*)", 1)
    whole = F.when(digits == "", F.lit("0")).otherwise(digits).try_cast("decimal(38,0)")
    size = F.try_add(whole, (F.regexp_extract(s, r"\.([0-9])", 1) >= "5").cast("decimal(1,0)"))
    signed = F.when(s.startswith("-"), -size).otherwise(size)
    other = F.round(s.try_cast("decimal(38,18)"), 0)
    # whole numbers of up to 18 digits always fit a long
    return F.when(s.rlike(_WHOLE), s.try_cast("long")).when(plain, signed.try_cast("long")).otherwise(other.try_cast("long"))


def normalise_metrics(staged: DataFrame, mapping: Mapping[str, str | Column],
                      keep: Sequence[str] = ("dataset_id", "row_number")) -> DataFrame:
    """A4 — staged JSON rows -> the metrics schema.

    ``mapping`` is canonical field -> source key, or a column that holds each row's key.  Text: trimmed, blank ->
    null.  Numbers: thousands separators removed, missing -> 0; a value that
    is present but not a number becomes 0 and is listed in ``rejects`` (the
    row is kept and flagged ``rejected``)."""
    mapped = [f for f in (*TEXT_FIELDS, *NUMBER_FIELDS) if f in mapping]
    numbers = [n for n in NUMBER_FIELDS if n in mapping]
    key = {f: mapping[f] if isinstance(mapping[f], Column) else F.lit(mapping[f]) for f in mapped}
    # a select for each step: a record is parsed once, not once for each use of its cells
    parsed = staged.select(*keep, cells_of(staged).alias("__cells"), *[key[f].alias(f"__{f}") for f in mapped])
    trimmed = parsed.select(*keep, *[F.trim(F.col("__cells")[F.col(f"__{f}")]).alias(f"__{f}") for f in mapped])
    raw = trimmed.select(*keep, *[F.nullif(F.col(f"__{f}"), F.lit("")).alias(f"__{f}") for f in mapped])
    bare = raw.select("*", *[_bare(F.col(f"__{n}")).alias(f"__b_{n}") for n in numbers])
    read = bare.select("*", *[_cell_number(F.col(f"__b_{n}")).alias(f"__n_{n}") for n in numbers])
    texts = [(F.col(f"__{t}") if t in mapping else F.lit(None).cast("string")).alias(t) for t in TEXT_FIELDS]
    nums = [(F.coalesce(F.col(f"__n_{n}"), F.lit(0).cast("long")) if n in mapping else F.lit(0).cast("long")).alias(n) for n in NUMBER_FIELDS]
    bad = [F.when(F.col(f"__{n}").isNotNull() & F.col(f"__n_{n}").isNull(), F.lit(n)) for n in numbers]
    rejects = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array().cast("array<string>")
    return read.select(*keep, *texts, *nums, rejects.alias("rejects")).withColumn(
        "rejected", F.size("rejects") > 0)


# ---------------------------------------------------------------------- A6
def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], order_col: str | Column,
           keep_old_if_null: bool = False) -> DataFrame:
    """A6 — insert or overwrite rows by key.

    When ``updates`` repeats a key, the row with the largest ``order_col``
    wins; a null order is smaller than any other, and rows that tie are
    ordered by a digest of their values, so a rerun picks the same one.  With ``keep_old_if_null`` an update's null field keeps the
    existing value (COALESCE-style upsert).  Output has every base and
    update key once, plus ``_source`` = base / inserted / updated.

    Plan: base and updates are unioned and grouped once by key; ``max_by``
    picks the latest update and the base row (combined map-side, so a key
    repeated many times never meets in one task as raw rows).  One shuffle,
    no join between the two large inputs.
    """
    values = [c for c in base.columns if c not in keys]
    oc = F.col(order_col) if isinstance(order_col, str) else order_col
    payload = F.struct(*[F.col(c) for c in values])
    b = base.select(*keys, payload.alias("_v"), F.lit(None).cast(updates.select(oc.alias("o")).schema[0].dataType)
                    .alias("_ord"), F.lit(0).alias("_side"))
    u = updates.select(*keys, F.struct(*[F.col(c) for c in values]).alias("_v"), oc.alias("_ord"),
                       F.lit(1).alias("_side"))
    latest = F.struct(F.col("_ord").isNotNull(), F.col("_ord"), F.xxhash64("_v"))
    g = b.unionByName(u).groupBy(*keys).agg(
        F.max_by("_v", F.when(F.col("_side") == 1, latest)).alias("_new"),
        F.max_by("_v", F.when(F.col("_side") == 0, F.lit(1))).alias("_old"),
        F.max("_side").alias("_has_u"), F.min("_side").alias("_has_b0"))
    has_u = F.col("_has_u") == 1
    outs = []
    for c in values:
        new, old = F.col(f"_new.{c}"), F.col(f"_old.{c}")
        val = F.when(has_u, F.coalesce(new, old) if keep_old_if_null else new).otherwise(old)
        outs.append(val.alias(c))
    src = (F.when(F.col("_has_b0") == 1, F.lit("inserted"))
           .when(has_u, F.lit("updated")).otherwise(F.lit("base")))
    return g.select(*keys, *outs, src.alias("_source"))


def create_stored(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 256) -> None:
    """A6 — store ``df`` (each key once) for :func:`merge_stored`: Parquet in ``buckets`` partitions by the keys' hash."""
    df.withColumn("_bucket", _bucket(keys, buckets)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def merge_stored(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], order_col: str, buckets: int = 256,
                 keep_old_if_null: bool = False) -> list[int]:
    """A6 on a stored table — merge ``updates`` into the table of :func:`create_stored`, rewriting only the partitions
    that hold an updated key; returns their numbers.

    The updates' buckets (at most ``buckets``) prune the read of the table; the merged rows are stored in the shared
    checkpoint folder before the partitions are replaced, so a failed merge leaves the table readable, and running it
    again gives the same table: the last write wins.  One writer at a time."""
    placed = updates.withColumn("_bucket", _bucket(keys, buckets))
    touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())
    if not touched:
        return []
    base = spark.read.parquet(path).where(F.col("_bucket").isin(touched)).drop("_bucket")
    merged = upsert(base, updates, keys, order_col, keep_old_if_null).drop("_source").withColumn("_bucket", _bucket(keys, buckets))
    ensure_checkpoint_dir(spark)
    merged = merged.select(*base.columns, "_bucket").checkpoint(eager=True)
    (merged.hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path))
    return touched


# ---------------------------------------------------------------------- A7
def find_duplicates(df: DataFrame, id_col: str, content_col: str, order_col: str) -> DataFrame:
    """A7 — SHA-256 of the whole content per row and, for repeated content,
    the newest earlier row with the same digest.

    The predecessor is found without a per-digest window (one hot digest
    would land in one task): rows are globally numbered in (digest, order)
    order by :func:`ordinal_within`, and row *i* is compared with row
    *i - 1* through an equi-join on the position.
    """
    d = df.select(F.col(id_col).alias("id"), F.col(order_col).alias("_ord"),
                  F.sha2(F.col(content_col).cast("string"), 256).alias("digest"))
    n = ordinal_within(d, [], ["digest", "_ord", "id"], name="_pos")
    prev = n.select((F.col("_pos") + 1).alias("_pos"), F.col("digest").alias("_pd"), F.col("id").alias("_pid"))
    j = n.join(prev, "_pos", "left")
    dup = F.col("_pd").isNotNull() & (F.col("_pd") == F.col("digest"))
    return j.select(F.col("id").alias(id_col), "digest", dup.alias("is_duplicate"),
                    F.when(dup, F.col("_pid")).alias("duplicate_of"))
