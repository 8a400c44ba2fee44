"""Corpus pipeline over `documents`: quality, boilerplate lines, near copies, benchmark leaks, packing.

Each stage works on all rows that its predecessor kept and is written as Parquet before the next reads
it. All but the last return the columns of `documents`. Rows with null, empty or repeated values go
through every stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelyard.llm import decontaminate, line_dedup, near_dedup, packing, quality
from funnelyard.llm.common import discard, key128, stage, without
from funnelyard.llm.queries import vocabulary_path
from funnelyard.llm.registry import ship_package
from funnelyard.sources.tables import read_table

#: Similarity of near copies, in percent.
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie far outside their language and source."""
    ship_package(spark)
    rejected = quality.assess(docs).where("not kept").select("k1", "k2")
    return without(docs, rejected, F.col("lang"), F.col("source"), F.col("text"))


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that stand in over a tenth of their source's documents; every document stays.

    Equal and near-equal documents count as one: their own lines aren't the source's, and one of them is to
    keep its text for the near-dedup.
    """
    ship_package(spark)
    found = near_dedup.near_duplicates(docs, percent=PERCENT, shingle=5)
    classes = stage(found.where("n_shingles > 0").groupBy("t1", "t2").agg(F.any_value(F.struct("class1", "class2")).alias("class")), "classes")
    discard(found)
    # the document stays in one struct, whatever its columns are called; a text is its lines
    t1, t2 = key128(F.col("text"))
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c.lower() != "text"]
    lines = docs.select(F.struct(*rest).alias("row"), t1.alias("t1"), t2.alias("t2"), F.col("doc_id"), F.col("source"), F.split("text", "\n").alias("lines"))
    clean = line_dedup.drop_boilerplate(lines, "source", "lines", ["doc_id"], max_ratio=0.1, min_pages=10, classes=classes)
    text = F.when(F.col("lines").isNotNull(), F.array_join("kept_lines", "\n"))
    made = {"text": text.alias("text"), "n_chars": F.when(F.col("lines").isNull(), F.col("row.n_chars"))
            .otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return clean.select(*[made[c.lower()].alias(c) if c.lower() in made else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component."""
    ship_package(spark)
    return near_dedup.one_of_each(docs, percent=PERCENT, shingle=5)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of 10 words of a benchmark item."""
    ship_package(spark)
    found = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), window=10)
    leaked = found.where("n_hit > 0").select(F.col("t1").alias("k1"), F.col("t2").alias("k2"))
    return without(docs, leaked, F.col("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's token pieces in sequences of 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, vocabulary_path(), capacity=2048, end_id=0)


STAGES = [("quality rules", quality_rules), ("line dedup", site_lines), ("MinHash near-dedup", near_copies),
          ("benchmark decontamination", benchmark_leaks), ("best-fit packing", pack_sequences)]

#: Components, robust estimates and tokenising have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written and read again."""
    docs, stored = read_table(spark, sf_dir, "documents"), None
    for _, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), "corpus")
        if stored is not None:
            discard(stored)  # the next corpus is written: nothing reads this one any more
        stored = docs
    return STAGES[-1][1](spark, docs, sf_dir)
