"""A1 for large files: the records of delimited files, read by many tasks although cells hold line breaks.

A quoted cell may hold line breaks, so a split of a file can't tell by itself whether its first line starts a
record.  The quotes decide it: a line starts a record if the quotes before it in the file pair up.

1. The files are read once as physical lines and stored; every later step reads the stored lines.
2. Each split counts its lines, blank lines and lines with an odd number of quotes; running sums over the splits of a
   file (one row per split) give its first line's number, record number and quote parity.
3. In files without a single odd line, splits without blank lines number their lines by position alone; the other
   splits by running sums inside the split.  Only lines of records that really span lines are grouped.

This holds for quoting as in RFC 4180: quotes stand in quoted cells only, and a quote in a cell is doubled.  Blank
lines between records are skipped.  Lines end with LF or CR LF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelyard.sources.delimited import BOM


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Physical lines of the files: (source_file, file_bytes, split, pos, line).  ``pos`` grows along a split.

    The only read of the files; store the result before it is used further, so that ``pos`` is fixed."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def _is_blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\r")) == ""  # looks no further than the first other character


def _is_odd(line: Column) -> Column:
    return F.pmod(F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit(""))), F.lit(2)) == 1


def split_table(lines: DataFrame) -> DataFrame:
    """One row per split: first position, lines and lines with text before it in the file, parity of the quotes before
    it, whether its file has odd lines (``broken``), and whether its lines need running sums (``looked_at``)."""
    odd = _is_odd(F.col("line"))
    per = lines.groupBy("source_file", "split").agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_lines"), F.count_if(_is_blank(F.col("line"))).alias("blank"),
        F.count_if(odd).alias("odd"))
    before = Window.partitionBy("source_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    whole = Window.partitionBy("source_file")
    return per.select(
        "source_file", "split", "first_pos", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum(F.col("n_lines") - F.col("blank")).over(before), F.lit(0)).alias("texts_before"),
        F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)).alias("parity"),
        (F.sum("odd").over(whole) > 0).alias("broken"), ((F.sum("odd").over(whole) > 0) | (F.col("blank") > 0)).alias("looked_at"))


def number_lines(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds ``line_no``, from 0 along the file."""
    slim = splits.select("source_file", "split", "first_pos", "lines_before")
    return lines.join(F.broadcast(slim), ["source_file", "split"]).withColumn(  # a row per split
        "line_no", (F.col("lines_before") + F.col("pos") - F.col("first_pos")).cast("long")).drop("first_pos", "lines_before")


def file_digests(numbered: DataFrame) -> DataFrame:
    """A7 — one row per file: (source_file, file_bytes, fingerprint), equal for files with equal bytes.

    Each line is digested with its number, and the digests are combined without an order (128 bits), so a file of any
    size is digested by many tasks and no bytes are moved.  The size tells a last line with a line break from one
    without.  Meant for finding equal uploads, not for hostile input.
    """
    at = F.col("line_no")
    return numbered.groupBy("source_file", "file_bytes").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(at, "line")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "line", at)).alias("y")
    ).select("source_file", "file_bytes", F.sha2(F.concat_ws(":", "file_bytes", "n", "x", "y"), 256).alias("fingerprint"))


def join_records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """(source_file, record_no, record): the records of each file, numbered from 0 (the header), line breaks kept."""
    def of(which: str) -> DataFrame:  # a row per split; if there is none, the lines aren't read
        some = splits.where(which).select("source_file", "split", "first_pos", "texts_before", "parity", "broken")
        return lines.join(F.broadcast(some), ["source_file", "split"])

    plain = of("not looked_at").select(
        "source_file", (F.col("texts_before") + F.col("pos") - F.col("first_pos")).cast("long").alias("record_no"), F.col("line").alias("record"))

    inside = Window.partitionBy("source_file", "split").orderBy("pos")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    odd = _is_odd(F.col("line")).cast("int")
    other = of("looked_at").select("source_file", "split", "pos", "line", "parity", "broken", "texts_before", odd.alias("odd"))
    other = other.withColumn("open", F.pmod(F.col("parity") + F.coalesce(F.sum("odd").over(so_far), F.lit(0)), F.lit(2)) == 1)
    other = other.where(F.col("open") | ~_is_blank(F.col("line"))).withColumn("starts", (~F.col("open")).cast("int"))
    other = other.withColumn("nth", F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    starts = other.groupBy("source_file", "split").agg(F.sum("starts").alias("n"))
    before = Window.partitionBy("source_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    starts = starts.select("source_file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("records_before"))
    numbered = other.join(F.broadcast(starts), ["source_file", "split"]).select(
        "source_file", "split", "pos", "line",
        (F.when(F.col("broken"), F.col("records_before")).otherwise(F.col("texts_before")) + F.col("nth") - 1).cast("long").alias("record_no"),
        (F.col("open") | (F.col("odd") == 1)).alias("part"))
    single = numbered.where("not part").select("source_file", "record_no", F.col("line").alias("record"))
    spanning = (numbered.where("part").groupBy("source_file", "record_no").agg(F.array_sort(F.collect_list(F.struct("split", "pos", "line"))).alias("x"))
                .select("source_file", "record_no", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("record")))
    records = plain.unionByName(single).unionByName(spanning)
    return records.withColumn("record", F.when(F.contains("record", F.lit("\r")), F.regexp_replace("record", "\r$", "")).otherwise(F.col("record")))


def cells(record: Column, width: int, sep: str = ",") -> Column:
    """The first ``width`` cells of a record as strings; missing and empty cells are null."""
    names = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{n} string" for n in names)
    parsed = F.from_csv(record, F.lit(schema), {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
                                                "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    # the parsed record is bound once: a field taken from the parser itself would parse the record again for each cell
    return F.transform(F.array(parsed), lambda row: F.array(*[row.getField(n) for n in names]))[0]


def cell_count(record: Column, sep: str = ",") -> Column:
    """Cells of a record: separators outside quotes, and one."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def clean_names(names: Column) -> Column:
    """Header rules of A1 on an array: mark of the encoding removed, names stripped, blank ones ``col_<i>``; a name
    that occurs twice gets its position, as the CSV reader does."""
    stripped = F.transform(names, lambda c, i: F.coalesce(F.nullif(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit(BOM), F.lit("")), r"^\s+|\s+$", ""),
                                                                    F.lit("")), F.concat(F.lit("col_"), i.cast("string"))))
    lowered = F.transform(stripped, F.lower)
    once = F.transform(stripped, lambda c, i: F.when(F.size(F.filter(lowered, lambda x: x == F.lower(c))) > 1, F.concat(c, i.cast("string"))).otherwise(c))
    return F.transform(once, lambda c, i: F.when(F.array_position(once, c) - 1 < i, F.concat(c, F.lit("_"), i.cast("string"))).otherwise(c))


def header_records(records: DataFrame, sep: str = ",") -> DataFrame:
    """(source_file, record, n): each file's first record and its cells, one row per file; store it, it is read twice."""
    first = records.where("record_no = 0").withColumn("record", F.replace("record", F.lit(BOM), F.lit("")))
    return first.select("source_file", "record", cell_count(F.col("record"), sep).alias("n"))


def file_headers(heads: DataFrame, sep: str = ",") -> tuple[DataFrame, int]:
    """(source_file, header array) of :func:`header_records`, and the cells of the widest one."""
    width = heads.agg(F.max("n")).first()[0] or 1
    return heads.select("source_file", clean_names(F.slice(cells(F.col("record"), width, sep), 1, F.col("n"))).alias("header")), width
