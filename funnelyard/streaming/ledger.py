"""Load ledger of the incremental ingest: which files were loaded, as what, in which order.

One row per uploaded file, written once per micro-batch into the partition ``(run, batch_id)`` as the last step of
the batch.  A batch decides by the rows of the batches before it, so a batch that is run again decides alike and
overwrites its own partition; nothing is counted twice.  ``run`` is the streaming query's id: a query started on a
new checkpoint finds the same files in the ledger and leaves them alone.

* ``status``: ``loaded`` or ``duplicate_file`` (equal bytes were loaded before, under any name).  Files without a
  single byte hold nothing to load and aren't listed.
* ``created_seq`` numbers the files by arrival, so later files never renumber the rows of earlier ones.
* The first file of a dataset carries the dataset's period, version and ``upload_status``:
  ``period_unknown``, ``overlap_conflict`` (another session shares a year), ``conflict`` (the session exists),
  ``confirmed`` or ``pending_confirmation``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelyard.operators.periods import CONFIDENT, label_years

BATCH = ("run", "batch_id")
SCHEMA = ("source_file string, file_key string, dataset_id string, original_filename string, file_bytes long, fingerprint string, "
          "n_rows long, status string, duplicate_of string, created_seq long, commit_seq long, start_year int, end_year int, label string, "
          "confidence double, method string, upload_version int, upload_status string, run string, batch_id long")
POLICIES = ("new_version", "hold")


def read_ledger(spark: SparkSession, out_dir: str, but: tuple[str, int] | None = None) -> DataFrame:
    """The ledger's rows; with ``but`` (run, batch_id) those that were there when that batch was first decided."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/ledger")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(f"{out_dir}/ledger")
    if not but:
        return rows
    own = (F.col("run") == but[0]) & (F.col("batch_id") == but[1])
    before = rows.where(own).agg(F.min("commit_seq")).first()[0]  # set if the batch runs again
    return rows.where(~own if before is None else ~own & (F.col("commit_seq") < before))


def current_files(ledger: DataFrame) -> DataFrame:
    """The newest row of each file."""
    return (ledger.groupBy("source_file").agg(F.max_by(F.struct(*[c for c in ledger.columns if c != "source_file"]), "commit_seq").alias("x"))
            .select("source_file", "x.*"))


def decide_files(files: DataFrame, prior: DataFrame) -> DataFrame:
    """Adds ``status``, ``duplicate_of``, ``created_seq`` and ``commit_seq`` to a batch's files
    (source_file, file_key, dataset_id, original_filename, file_bytes, fingerprint).

    Files that the ledger holds with the same bytes are left out: they were loaded by an earlier run.  A file whose
    bytes changed is loaded again and keeps its place.  Of equal files in one batch the first by path is loaded.
    """
    now = current_files(prior)
    known = now.select("source_file", F.col("fingerprint").alias("old"), F.col("created_seq").alias("old_seq"))
    new = files.join(known, "source_file", "left").where(~F.col("old").eqNullSafe(F.col("fingerprint")) | F.col("old_seq").isNull())
    loaded = (now.where("status = 'loaded'").groupBy("fingerprint")
              .agg(F.min_by(F.struct("source_file", "dataset_id"), "created_seq").alias("earlier")))
    first = new.groupBy("fingerprint").agg(F.min(F.struct("source_file", "dataset_id")).alias("first"))
    j = new.join(loaded, "fingerprint", "left").join(first, "fingerprint", "left")
    twin = (F.when(F.col("earlier").isNotNull(), F.col("earlier"))
            .when(F.col("first.source_file") != F.col("source_file"), F.col("first")))
    top = prior.agg(F.coalesce(F.max("created_seq"), F.lit(0)).alias("top"), F.coalesce(F.max("commit_seq"), F.lit(0)).alias("commits"))
    nth = F.row_number().over(Window.orderBy("source_file"))  # a row per file of the batch
    return j.crossJoin(F.broadcast(top)).select(  # `top` is one row
        *files.columns, F.when(twin.isNotNull(), "duplicate_file").otherwise("loaded").alias("status"), twin.getField("dataset_id").alias("duplicate_of"),
        F.coalesce("old_seq", F.col("top") + nth).cast("long").alias("created_seq"), (F.col("commits") + 1).cast("long").alias("commit_seq"))


def _overlaps(a: tuple, b: tuple) -> bool:
    return a[0] <= b[1] and b[0] <= a[1]


def open_labels(registered: Iterable[tuple], arriving: Iterable[tuple]) -> dict[str, str | None]:
    """Which arriving sessions may be registered: label -> null, or the registered label that shares a year with it.

    Sessions are (label, start, end); the arriving ones in order of arrival, so that the first of two overlapping
    sessions is registered.  There are only as many as there are year ranges, whatever the number of uploads."""
    held = {label: (start, end) for label, start, end in registered}
    out: dict[str, str | None] = {}
    for label, start, end in arriving:
        clash = min((x for x, years in held.items() if x != label and _overlaps(years, (start, end))), default=None) if label not in held else None
        out[label] = clash
        if clash is None:
            held[label] = (start, end)
    return out


def assign_versions(new: DataFrame, prior: DataFrame, on_conflict: str = "new_version") -> DataFrame:
    """D5, D6, D16 for datasets that come in for the first time: (dataset_id, created_seq, start_year, end_year, label,
    confidence, method) plus ``upload_version`` and ``upload_status``.

    A session that overlaps another one is not registered.  For a session that exists ``new_version`` registers
    the dataset as its next version, which becomes the active one; ``hold`` leaves it unregistered."""
    if on_conflict not in POLICIES:
        raise ValueError(f"on_conflict must be one of {POLICIES}")
    spark = new.sparkSession
    registered = prior.where("upload_version is not null")
    labels = registered.groupBy("label").agg(F.max("upload_version").alias("top"), F.min("start_year").alias("s"), F.max("end_year").alias("e"))
    known = [tuple(r) for r in labels.select("label", "s", "e").collect()]  # sessions, not uploads
    coming = (new.where("label is not null").groupBy("label").agg(F.min("created_seq").alias("q"), F.min("start_year").alias("s"), F.max("end_year").alias("e"))
              .orderBy("q").select("label", "s", "e").collect())
    clash = open_labels(known, [tuple(r) for r in coming])
    table = spark.createDataFrame([(k, v) for k, v in clash.items()], "label string, overlaps string")
    j = new.join(table, "label", "left").join(labels.select("label", "top"), "label", "left")
    nth = F.row_number().over(Window.partitionBy("label").orderBy("created_seq"))  # a row per new dataset of the batch
    seen = F.col("top").isNotNull() | (F.col("nth") > 1)
    status = (F.when(F.col("label").isNull(), "period_unknown").when(F.col("overlaps").isNotNull(), "overlap_conflict").when(seen, "conflict")
              .when(F.col("confidence") >= CONFIDENT, "confirmed").otherwise("pending_confirmation"))
    j = j.withColumn("nth", nth).withColumn("upload_status", status)
    held = F.col("upload_status").isin("period_unknown", "overlap_conflict", *(["conflict"] if on_conflict == "hold" else []))
    return j.select(*new.columns, F.when(~held, F.coalesce("top", F.lit(0)) + F.col("nth")).cast("int").alias("upload_version"), "upload_status")


def read_registry(spark: SparkSession, out_dir: str) -> DataFrame:
    """The registry of datasets by the ledger: period, version, and the newest version of each session as the active one."""
    rows = read_ledger(spark, out_dir).where("upload_status is not null")
    one = (rows.groupBy("dataset_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "dataset_id"]), "commit_seq").alias("x"))
           .select("dataset_id", "x.*"))
    top = one.groupBy("label").agg(F.max("upload_version").alias("top"))
    return one.join(top, "label", "left").select(
        "dataset_id", "original_filename", "label", "start_year", "end_year", "created_seq", "upload_version", "upload_status",
        F.coalesce(F.col("upload_version") == F.col("top"), F.lit(False)).alias("is_period_active"))


def registry_violations(registry: DataFrame) -> DataFrame:
    """Sessions without exactly one active version among the registered ones, and labels that aren't year ranges."""
    def years(label: Column) -> Column:
        return label_years(label)
    return (registry.where("upload_version is not null").groupBy("label")
            .agg(F.count_if(F.col("is_period_active")).alias("active_versions"), F.count(F.lit(1)).alias("versions"),
                 F.count_distinct("upload_version").alias("numbers"))
            .where((F.col("active_versions") != 1) | (F.col("versions") != F.col("numbers")) | years(F.col("label")).isNull()))
