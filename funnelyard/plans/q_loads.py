"""Registered queries of the upload flow (A1, A6, A10): ledger, layouts, progress, quoted files, merges on stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelyard.operators import ingest as A
from funnelyard.plans.oracle_views import with_views
from funnelyard.plans.q_ingest import _DS, _MAP, _li, _num, _scratch, _upsert_sql
from funnelyard.plans.registry import register
from funnelyard.plans.sqlfrag import lsum
from funnelyard.session import setting
from funnelyard.sources import bindings as B
from funnelyard.sources.tables import read_table

_DONE: dict[tuple[str, str, str], str] = {}


def _once(spark, sf_dir, name, make):
    """Folder that `make` filled, once per application and data."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _DONE:
        root = _scratch(spark, name)
        make(root)
        _DONE[key] = root
    return _DONE[key]


def _write_parts(df, order, path):
    """One folder of CSV parts without header for each value of ``upload``, sorted by many tasks: the rows of a part, and the
    parts by their names, stand in the given order."""
    (df.orderBy("upload", *order).write.partitionBy("upload").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .option("escape", '"').csv(path))


def _place(spark, name, columns=(), parts=None, copy_of=None):
    """Make a file from a header and a folder's parts (or from a placed file); returns its path.  Bytes go from file to file."""
    jvm = spark.sparkContext._jvm
    path, conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    to = path(name)
    fs = to.getFileSystem(conf)
    found = [path(copy_of)] if copy_of else sorted((s.getPath() for s in fs.globStatus(path(f"{parts}/part-*")) or ()), key=lambda p: p.getName())
    out = fs.create(to)
    try:
        if columns:
            out.write(bytearray((",".join(columns) + "\n").encode()))
        for part in found:
            part = fs.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()
    return name


# ---------------------------------------------------------------- A10: files of two layouts in one batch
_LAYOUT_B = f"length({_DS}) % 2 = 0"


def _layouts(spark, sf_dir):
    """The dirty records as one CSV per segment, in two layouts (with and without the e-mail, columns in another
    order), loaded in one batch."""
    from funnelyard.streaming.ingest_stream import ingest_stream

    def make(root):
        c = B.dirty_records(spark, sf_dir).withColumn("ds", F.coalesce(F.nullif(F.trim("segment"), F.lit("")), F.lit("BLANK")))
        for layout, columns, rest in (("a", ["row_number", "name", "email", "segment", "amount"], F.length("ds") % 2 == 1),
                                      ("b", ["amount", "segment", "row_number", "name"], F.length("ds") % 2 == 0)):
            (c.where(rest).select(*columns, "ds").repartition("ds").sortWithinPartitions("ds", "row_number").write.partitionBy("ds").option("header", "true")
             .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{root}/in/{layout}"))
        ingest_stream(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", _MAP).awaitTermination()
    return _once(spark, sf_dir, "layouts", make) + "/out"


@register("ingest_layouts_quality", with_views(f"""
select dataset_id, n_rows as rows, n_cols as columns, blank as missing_values, 0::bigint as duplicate_rows, cast(m as double) / 100 as missing_percentage,
  0.0::double as duplicate_percentage, cast(10000 - m as double) / 100 as quality_score, rows_with_issues, blank + padded + mail as issues_found,
  blank as missing_value, padded as whitespace_normalized, mail as invalid_email
from (select *, (blank * 20000 + n_rows * n_cols) // (2 * n_rows * n_cols) as m
      from (select ds as dataset_id, count(*) as n_rows, max(case when b then 4 else 5 end)::int as n_cols,
              count(*) filter (where is_blank or is_padded or bad_mail) as rows_with_issues, count(*) filter (where is_blank) as blank,
              count(*) filter (where is_padded) as padded, count(*) filter (where bad_mail) as mail
            from (select {_DS} as ds, {_LAYOUT_B} as b, trim(segment) = '' as is_blank, trim(segment) <> '' and trim(segment) <> segment as is_padded,
                    not ({_LAYOUT_B}) and not regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') as bad_mail from C) x
            group by ds) y) z""", "C"))
def q_layouts_quality(spark, sf_dir):
    """Quality per dataset of one batch with files of two layouts: each by its own columns; blank cells are read as null."""
    return spark.read.parquet(f"{_layouts(spark, sf_dir)}/reports/quality").withColumn("dataset_id", F.col("dataset_id").cast("string"))


@register("ingest_layouts_metrics", with_views(f"""
select dataset_id, row_number, nullif(trim(name), '') as owner, nullif(trim(segment), '') as source,
  coalesce({_num("nullif(trim(amount), '')")}, 0) as cy_leads, rn0 as py_leads
from (select {_DS} as dataset_id, row_number() over (partition by {_DS} order by row_number) as row_number, row_number as rn0, name, segment, amount from C) s""", "C"))
def q_layouts_metrics(spark, sf_dir):
    """The rows of that batch: every file read by its own header."""
    from funnelyard.streaming.ingest_stream import read_loaded
    return read_loaded(spark, _layouts(spark, sf_dir)).select("dataset_id", "row_number", "owner", "source", "cy_leads", "py_leads")


# ---------------------------------------------------------------- A10: ledger
_SESSIONS = {"ds2020": "2019-20", "ds2022": "2021-22", "ds2024": "2023-24", "ds2026": "2025-26"}
_GRAIN = "source, state, campus_name, program_name, owner"


def _uploads(spark, sf_dir):
    """Uploads of the sessions, in two runs: each session; then copies of each under other names, a revised session and
    one that overlaps two others.  A third run starts on a new checkpoint and finds all files known."""
    from funnelyard.streaming.ingest_stream import ingest_stream

    def make(root):
        grain, sums = _GRAIN.split(", "), ["cy_leads", "cy_admission", "py_leads", "py_admission"]
        m = B.metrics(spark, sf_dir).where(F.col("dataset_id").isin(*_SESSIONS)).groupBy("dataset_id", *grain).agg(*[F.sum(c).alias(c) for c in sums])
        with setting(spark, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m"):  # dimension tables needn't be sorted
            m.write.parquet(f"{root}/made/rows")
        m = spark.read.parquet(f"{root}/made/rows")
        of = F.col("dataset_id")
        name = F.create_map(*[F.lit(x) for ds, label in _SESSIONS.items() for x in (ds, f"Admissions_{label}")])[of]
        again = [F.when((of == "ds2022") & (F.col(c) > 0), F.lit(x)) for c, x in (("cy_leads", "Revised_2021-22"), ("py_leads", "Moved_2020-21"))]
        _write_parts(m.select(*grain, *sums, F.explode(F.array_compact(F.array(name, *again))).alias("upload")), grain, f"{root}/made/parts")

        def upload(name):
            return _place(spark, f"{root}/in/{name}.csv", (*grain, *sums), f"{root}/made/parts/upload={name}")

        def run(checkpoint):
            ingest_stream(spark, f"{root}/in", f"{root}/out", f"{root}/{checkpoint}", {c: c for c in (*grain, *sums)}).awaitTermination()

        placed = [upload(f"Admissions_{label}") for label in _SESSIONS.values()]
        run("first")
        for path, label in zip(placed, _SESSIONS.values()):
            _place(spark, f"{root}/in/again/Copy_{label}.csv", copy_of=path)
        upload("Revised_2021-22")
        upload("Moved_2020-21")
        run("first")
        run("second")
    return _once(spark, sf_dir, "uploads", make) + "/out"


_PARTS = ("parts", f"select dataset_id, {_GRAIN}, {lsum('cy_leads')} as cy, {lsum('py_leads')} as py from M group by dataset_id, {_GRAIN}")
_COUNTS = ("counts", "select dataset_id, count(*) as n, count(*) filter (where cy > 0) as n_cy, count(*) filter (where py > 0) as n_py from parts group by dataset_id")
_SESSION_ROWS = ", ".join(f"('{ds}', '{label}')" for ds, label in _SESSIONS.items())


@register("load_ledger", with_views(f"""
select 'Admissions_' || label || '.csv' as original_filename, 'loaded' as status, null::varchar as duplicate_of_file, n as n_rows, label, 1 as upload_version,
  'confirmed' as upload_status, label <> '2021-22' as is_period_active
from sessions join counts using (dataset_id)
union all
select 'Copy_' || label || '.csv', 'duplicate_file', 'Admissions_' || label || '.csv', 0, null, null, null, false from sessions
union all
select 'Revised_2021-22.csv', 'loaded', null, n_cy, '2021-22', 2, 'conflict', true from counts where dataset_id = 'ds2022'
union all
select 'Moved_2020-21.csv', 'loaded', null, n_py, '2020-21', null, 'overlap_conflict', false from counts where dataset_id = 'ds2022'
""", "M", extra=[_PARTS, _COUNTS, ("sessions", f"select * from (values {_SESSION_ROWS}) as s(dataset_id, label)")], once=("parts",)))
def q_load_ledger(spark, sf_dir):
    """What became of each upload: equal bytes are loaded once, a known session gets its next version, which is
    active, an overlapping one is not registered; the replay changes nothing."""
    from funnelyard.streaming.ledger import read_ledger, read_registry
    out = _uploads(spark, sf_dir)
    files = read_ledger(spark, out)
    first = files.where("status = 'loaded'").select(F.col("dataset_id").alias("duplicate_of"), F.col("original_filename").alias("duplicate_of_file"))
    active = read_registry(spark, out).select("dataset_id", "is_period_active")
    return files.join(first, "duplicate_of", "left").join(active, "dataset_id", "left").select(
        "original_filename", "status", "duplicate_of_file", "n_rows", "label", "upload_version", "upload_status",
        F.coalesce("is_period_active", F.lit(False)).alias("is_period_active"))


@register("load_progress", with_views("""
select 4::bigint as files, 4::bigint as files_loaded, 0::bigint as files_duplicate, sum(n)::bigint as rows_staged, sum(n)::bigint as rows_loaded, 0::bigint as rows_rejected
from counts
union all
select 6, 2, 4, (n_cy + n_py)::bigint, (n_cy + n_py)::bigint, 0 from counts where dataset_id = 'ds2022'
union all
select 0, 0, 0, 0, 0, 0""", "M", extra=[_PARTS, _COUNTS], once=("parts",)))
def q_load_progress(spark, sf_dir):
    """Files and rows of each batch of those runs; the replay stages nothing."""
    from funnelyard.streaming.ingest_stream import load_progress
    return load_progress(spark, _uploads(spark, sf_dir)).select("files", "files_loaded", "files_duplicate", "rows_staged", "rows_loaded", "rows_rejected")


# ---------------------------------------------------------------- A1: quoted line breaks, read by many tasks
@register("read_quoted_records", "select cast(doc_id as varchar) as doc_id, sha256(text) as text_sha256, lang, source from documents")
def q_read_quoted(spark, sf_dir):
    """The documents written as CSV (their texts hold line breaks and quotes) and read back as records by splits."""
    from funnelyard.sources import records as R

    def make(root):
        docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
        docs.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(f"{root}/csv")
        R.read_lines(spark, [f"{root}/csv"]).write.parquet(f"{root}/lines")
    root = _once(spark, sf_dir, "quoted", make)
    lines = spark.read.parquet(f"{root}/lines")
    found = R.join_records(lines, R.split_table(lines)).where("record_no > 0").select(R.cells(F.col("record"), 4).alias("c"))
    return found.select(F.col("c")[0].alias("doc_id"), F.sha2(F.coalesce(F.col("c")[1], F.lit("")), 256).alias("text_sha256"), F.col("c")[2].alias("lang"), F.col("c")[3].alias("source"))


# ---------------------------------------------------------------- A6 on a stored table
@register("merge_stored_table", f"select l_orderkey, l_linenumber, l_quantity, l_tax from ({_upsert_sql(False)}) m")
def q_merge_stored(spark, sf_dir):
    """The open line items stored by the keys' hash, the finished ones merged into them in place, read back."""
    def make(root):
        li, keys = _li(spark, sf_dir), ["l_orderkey", "l_linenumber"]
        base = (li.where("l_linestatus = 'O'").groupBy(*keys)
                .agg(F.max_by(F.struct("l_quantity", "l_tax"), F.struct("l_shipdate", "l_partkey")).alias("b")).select(*keys, "b.l_quantity", "b.l_tax"))
        updates = li.where("l_linestatus = 'F'").select(*keys, "l_quantity", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), F.struct("l_shipdate", "l_partkey").alias("_ord"))
        A.create_stored(base, f"{root}/table", keys, buckets=32)
        A.merge_stored(spark, f"{root}/table", updates, keys, "_ord", buckets=32)
    return A.read_stored(spark, _once(spark, sf_dir, "merged", make) + "/table").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
