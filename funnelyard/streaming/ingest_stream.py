"""A10 — incremental ingestion of delimited files with Structured Streaming.

New files under ``in_dir`` are found by the file source, whose offsets live in
``checkpoint`` (a shared folder), so the query restarts where it stopped.
The stream carries file paths only.  Each micro-batch reads its files once, as
lines; records, headers and fingerprints all come from the stored lines
(:mod:`funnelyard.sources.records`), so large files are read by many tasks, and every file
is read by the header in its own first record.

Tables, all under ``out_dir``:

* ``staged`` — every row as a JSON document with its file's columns.
* ``metrics`` — the normalised rows.
* ``profiles/files``, ``columns``, ``digests``, ``years`` — summaries per file that add up
  (:mod:`funnelyard.operators.profiles`).
* ``reports/quality``, ``reports/columns``, ``reports/reconciliation``, ``reports/periods`` — per
  dataset, merged from its files' summaries; rows loaded before are not read again.
* ``ledger`` — one row per upload (:mod:`funnelyard.streaming.ledger`): equal bytes are loaded
  once, sessions get versions, the newest is active.
* ``progress`` — rows staged, loaded and rejected per batch.

The tables of rows and summaries are partitioned by ``(dataset_id, file_key)``.
A dataset is a ``ds=<id>`` folder, or a single file whose id is its name and a
digest of its path.  It is assembled from all its files, whichever batch they
arrive in: a batch overwrites exactly the partitions of its files and, as
its last step, its own partition of the ledger, so a replayed batch
leaves the same tables.  :func:`read_loaded` numbers a dataset's rows over its files in order of arrival:
late files never renumber earlier rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from funnelyard.operators import profiles as P
from funnelyard.operators.catalog import map_columns, resolve_canonical
from funnelyard.operators.ingest import NUMBER_FIELDS, TEXT_FIELDS, normalise_metrics
from funnelyard.session import ensure_checkpoint_dir
from funnelyard.sources import records as R
from funnelyard.sources.sinks import write_metrics
from funnelyard.streaming import ledger as L

PARTITIONS = ("dataset_id", "file_key")
#: Files of a micro-batch unless the caller says otherwise; what a batch decides about files is bounded by it.
MAX_FILES = 1000


def file_key(path: Column) -> Column:
    """Names a file among all others: a digest of its whole path."""
    return F.substring(F.sha2(path, 256), 1, 16)


def dataset_of(path: Column) -> Column:
    """``.../ds=<id>/part-*.csv`` -> ``<id>``; otherwise the file name and the file's key.

    The path is a URI (first decode) of a Hive-escaped directory name
    (second decode)."""
    by_dir = F.regexp_extract(path, r"ds=([^/]+)/[^/]*$", 1)
    name = _decoded(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))
    return F.when(by_dir != "", _decoded(_decoded(by_dir))).otherwise(F.concat(name, F.lit("-"), file_key(path)))


def _decoded(part: Column) -> Column:
    """Percent signs resolved; a plus stays one."""
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def _as_text(df: DataFrame) -> DataFrame:
    # partition values such as 2024 are read back as numbers
    return df.withColumns({c: F.col(c).cast("string") for c in PARTITIONS if c in df.columns})


def number_rows(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds ``row_number``, dense from 1 over a dataset's files in order of arrival."""
    files = L.current_files(ledger).where("status = 'loaded' and n_rows > 0")
    before = Window.partitionBy("dataset_id").orderBy("created_seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = files.select("dataset_id", "file_key", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("_start"))
    return (rows.join(starts, list(PARTITIONS)).withColumn("row_number", (F.col("_start") + F.col("file_row")).cast("long")).drop("_start"))


def read_staged(spark: SparkSession, out_dir: str) -> DataFrame:
    return number_rows(_as_text(spark.read.parquet(f"{out_dir}/staged")), L.read_ledger(spark, out_dir))


def read_loaded(spark: SparkSession, out_dir: str) -> DataFrame:
    """The metrics table with the dataset-wide ``row_number``."""
    return number_rows(_as_text(spark.read.parquet(f"{out_dir}/metrics")), L.read_ledger(spark, out_dir))


def header_fields(headers: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    """(source_file, fields): canonical field -> the file's column.

    ``mapping`` applies to the files that have its columns; without it each header is mapped by the header
    rules (C1, then the best-confidence column per field, C2).  One row per file and column."""
    if mapping is not None:
        wanted = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.expr("cast(map() as map<string,string>)")
        return headers.select("source_file", F.map_filter(wanted, lambda k, v: F.array_contains("header", v)).alias("fields"))
    columns = headers.select("source_file", F.explode("header").alias("column_name"))
    best = resolve_canonical(map_columns(columns, keys=("source_file",)), keys=("source_file",)).where("status = 'resolved'")
    found = best.groupBy("source_file").agg(F.map_from_entries(F.collect_list(F.struct("canonical_field", "original_column"))).alias("fields"))
    none = F.expr("cast(map() as map<string,string>)")
    return headers.select("source_file").join(found, "source_file", "left").select("source_file", F.coalesce("fields", none).alias("fields"))


def stage_rows(records: DataFrame, headers: DataFrame, width: int, sep: str = ",") -> DataFrame:
    """Rows ``(dataset_id, file_key, source_file, file_row, raw_data)``; ``file_row`` counts from 1 in file order."""
    return as_documents(cell_rows(records, headers, width, sep))


def as_documents(rows: DataFrame) -> DataFrame:
    """The rows of :func:`cell_rows` with their cells as a JSON document."""
    return rows.select("dataset_id", "file_key", "source_file", "file_row", F.to_json("cells", {"ignoreNullFields": "false"}).alias("raw_data"))


def cell_rows(records: DataFrame, headers: DataFrame, width: int, sep: str = ",") -> DataFrame:
    """Rows ``(dataset_id, file_key, source_file, file_row, cells)``: the cells by their column's name."""
    path = F.col("source_file")
    # what a path says is worked out once for each file, not for each of its rows
    files = headers.select("source_file", "header", dataset_of(path).alias("dataset_id"), file_key(path).alias("file_key"))
    rows = records.where("record_no > 0").join(F.broadcast(files), "source_file")  # a row per file
    values = F.slice(R.cells(F.col("record"), width, sep), 1, F.size("header"))
    return rows.select("dataset_id", "file_key", "source_file", F.col("record_no").alias("file_row"), F.map_from_arrays("header", values).alias("cells"))


class _Work:
    """Folder of one batch's intermediate tables, in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/funnelyard-batch-{uuid.uuid4().hex}"
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.deleteOnExit(self.path)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def close(self) -> None:
        self.files.delete(self.path, True)


def ingest_files(spark: SparkSession, paths: list[str], out_dir: str, mapping: Mapping[str, str] | None = None, run: str = "manual",
                 batch_id: int = 0, on_conflict: str = "new_version", skip_duplicates: bool = True, sep: str = ",") -> None:
    """Read -> decide by the ledger -> stage -> normalise -> summarise -> report -> commit, for the files of one micro-batch."""
    if not paths:
        return
    work = _Work(spark)
    try:
        _ingest(spark, work, paths, out_dir, mapping, run, batch_id, on_conflict, skip_duplicates, sep)
    finally:
        work.close()


def _ingest(spark, work, paths, out_dir, mapping, run, batch_id, on_conflict, skip_duplicates, sep) -> None:
    lines = work.store(R.read_lines(spark, paths), "lines")
    splits = work.store(R.split_table(lines), "splits")
    digests = R.file_digests(R.number_lines(lines, splits))
    path = F.col("source_file")
    files = digests.select(
        "source_file", file_key(path).alias("file_key"), dataset_of(path).alias("dataset_id"),
        _decoded(F.regexp_extract("source_file", r"([^/]+)$", 1)).alias("original_filename"), "file_bytes",
        "fingerprint" if skip_duplicates else F.concat("fingerprint", F.lit("@"), "source_file").alias("fingerprint"))
    prior = L.read_ledger(spark, out_dir, but=(run, batch_id))
    decided = work.store(L.decide_files(files, prior), "decided")
    listed = decided.select("source_file", "dataset_id", "file_key", "status").collect()  # files of the batch
    chosen = [r for r in listed if r.status == "loaded"]

    counts = {"files": len(listed), "files_loaded": len(chosen), "files_duplicate": len(listed) - len(chosen), "rows_staged": 0, "rows_loaded": 0, "rows_rejected": 0}
    datasets = sorted({r.dataset_id for r in chosen})
    if chosen:
        own = F.col("dataset_id").isin(datasets) & F.col("file_key").isin(*[r.file_key for r in chosen])
        taken = spark.createDataFrame([(r.source_file,) for r in chosen], "source_file string")
        records = R.join_records(lines.join(F.broadcast(taken), "source_file", "left_semi"), splits)
        headers, width = R.file_headers(work.store(R.header_records(records, sep), "headers"), sep)
        seen = Observation()
        cells = work.store(cell_rows(records, headers, width, sep), "cells")  # the only parse; all that follows reads these rows
        write_metrics(as_documents(cells).observe(seen, F.count(F.lit(1)).alias("rows_staged")), f"{out_dir}/staged", PARTITIONS)
        counts |= seen.get
    if counts["rows_staged"]:
        every = {f: F.col(f"key_{f}") for f in (*TEXT_FIELDS, *NUMBER_FIELDS) if mapping is None or f in mapping}
        fields = header_fields(headers, mapping).select(file_key(path).alias("file_key"), *[F.col("fields")[f].alias(f"key_{f}") for f in every])
        metrics = normalise_metrics(cells.join(F.broadcast(fields), "file_key"), every, keep=("dataset_id", "file_key", "source_file", "file_row"))  # a row per file
        seen = Observation()
        write_metrics(metrics.observe(seen, F.count(F.lit(1)).alias("rows_loaded"), F.count_if(F.col("rejected")).alias("rows_rejected")),
                      f"{out_dir}/metrics", PARTITIONS)
        counts |= seen.get
        loaded = _as_text(spark.read.parquet(f"{out_dir}/metrics").select("file_row", *PARTITIONS)).where(own)
        keys = (loaded.groupBy(*PARTITIONS, "file_row").agg(F.count(F.lit(1)).alias("n")).groupBy(*PARTITIONS)
                .agg(F.sum("n").alias("normalised_rows"), F.sum(F.col("n") - 1).alias("duplicate_keys")))
        staged = _as_text(spark.read.parquet(f"{out_dir}/staged").select(*PARTITIONS)).where(own).groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("rows"))
        columns = work.store(P.column_summaries(cells), "columns")
        files = P.file_summaries(cells, columns).drop("rows").join(staged, list(PARTITIONS))  # rows as they stand in the stored table
        write_metrics(files.join(keys, list(PARTITIONS), "left"), f"{out_dir}/profiles/files", PARTITIONS)
        write_metrics(columns, f"{out_dir}/profiles/columns", PARTITIONS)
        write_metrics(P.digest_counts(cells), f"{out_dir}/profiles/digests", PARTITIONS)
        if (years := work.store(P.year_counts(cells), "years")).head(1):
            write_metrics(years, f"{out_dir}/profiles/years", PARTITIONS)
        write_reports(spark, datasets, out_dir, decided, prior)
    if listed:
        commit(spark, decided, prior, datasets, out_dir, run, batch_id, on_conflict, bool(counts["rows_staged"]))
    told = spark.createDataFrame([(*counts.values(), run, batch_id)], ", ".join(f"{k} long" for k in counts) + ", run string, batch_id long")
    write_metrics(told, f"{out_dir}/progress", L.BATCH)


def _profile(spark: SparkSession, out_dir: str, name: str, datasets: list[str]) -> DataFrame:
    """A summary table of some datasets: their partitions only."""
    return _as_text(spark.read.parquet(f"{out_dir}/profiles/{name}")).where(F.col("dataset_id").isin(datasets))


def _has(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_reports(spark: SparkSession, datasets: list[str], out_dir: str, decided: DataFrame, prior: DataFrame) -> None:
    """Quality (B1, B5), columns (B2), reconciliation (B10) and period (D3) of the datasets, from their files' summaries."""
    files, columns = _profile(spark, out_dir, "files", datasets), _profile(spark, out_dir, "columns", datasets)
    write_metrics(P.merge_quality(files, columns, _profile(spark, out_dir, "digests", datasets)), f"{out_dir}/reports/quality")
    write_metrics(P.merge_columns(columns), f"{out_dir}/reports/columns")
    sums = files.groupBy("dataset_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (
        ("rows", "staged_rows"), ("normalised_rows", "normalised_rows"), ("duplicate_keys", "duplicate_keys"))])
    match = F.col("staged_rows") == F.col("normalised_rows")
    write_metrics(sums.select("*", match.alias("counts_match"), (match & (F.col("duplicate_keys") == 0)).alias("may_clear")), f"{out_dir}/reports/reconciliation")
    names = prior.where(F.col("dataset_id").isin(datasets)).select("dataset_id", "original_filename").union(decided.select("dataset_id", "original_filename"))
    years = (_profile(spark, out_dir, "years", datasets) if _has(spark, f"{out_dir}/profiles/years")
             else spark.createDataFrame([], "dataset_id string, file_key string, yr int, n long"))
    write_metrics(P.merge_periods(names.where(F.col("dataset_id").isin(datasets)).groupBy("dataset_id").agg(F.min("original_filename").alias("original_filename")),
                                  columns, years), f"{out_dir}/reports/periods")


def commit(spark: SparkSession, decided: DataFrame, prior: DataFrame, datasets: list[str], out_dir: str, run: str, batch_id: int,
           on_conflict: str, loaded: bool) -> None:
    """Write the batch's partition of the ledger; datasets that come in for the first time get their version."""
    period = ["start_year", "end_year", "label", "confidence", "method"]
    first = (decided.where("status = 'loaded'").groupBy("dataset_id").agg(F.min("created_seq").alias("created_seq"))
             .join(prior.where("upload_status is not null").select("dataset_id").distinct(), "dataset_id", "left_anti"))
    if loaded:
        found = _as_text(spark.read.parquet(f"{out_dir}/reports/periods")).where(F.col("dataset_id").isin(datasets)).select("dataset_id", *period)
        rows = P.file_rows(_profile(spark, out_dir, "files", datasets))
    else:
        found = spark.createDataFrame([], "dataset_id string, start_year int, end_year int, label string, confidence double, method string")
        rows = spark.createDataFrame([], "file_key string, n_rows long")
    new = first.join(found, "dataset_id", "left").select("dataset_id", "created_seq", *period)
    versions = L.assign_versions(new, prior, on_conflict).withColumnRenamed("created_seq", "first_seq")
    kept = decided.join(rows, "file_key", "left").join(versions, "dataset_id", "left")
    of_first = (F.col("status") == "loaded") & (F.col("created_seq") == F.col("first_seq"))
    out = kept.select(*decided.columns, F.when(F.col("status") == "loaded", F.coalesce("n_rows", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_rows"),
                      *[F.when(of_first, F.col(c)).alias(c) for c in (*period, "upload_version", "upload_status")],
                      F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch_id"))
    write_metrics(out.coalesce(1), f"{out_dir}/ledger", L.BATCH)


def load_progress(spark: SparkSession, out_dir: str) -> DataFrame:
    """A10 progress: files, duplicates, and rows staged, loaded and rejected, one row per batch."""
    return spark.read.parquet(f"{out_dir}/progress")


def ingest_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, mapping: Mapping[str, str] | None = None,
                  max_files_per_trigger: int | None = MAX_FILES, on_conflict: str = "new_version", skip_duplicates: bool = True):
    """Start the streaming ingest (availableNow) and return the query.

    ``mapping`` is canonical field -> header name and applies to the files
    that have those columns; without it each file's header is mapped by the
    header rules (C1/C2).  Files whose bytes were loaded before are left out (``skip_duplicates``); a
    dataset of a session that exists becomes its next version, or waits (``on_conflict``).
    """
    reader = (spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
              .schema("path string, modificationTime timestamp, length long, content binary")
              .option("maxFilesPerTrigger", str(max_files_per_trigger or MAX_FILES)))

    def sink(batch: DataFrame, batch_id: int) -> None:
        run = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        ingest_files(spark, [r["path"] for r in batch.select("path").collect()], out_dir, mapping, run, batch_id, on_conflict, skip_duplicates)

    # only the path is read: the files' contents are read as lines
    return (reader.load(in_dir).select("path").writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
