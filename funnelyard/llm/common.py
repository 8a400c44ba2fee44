"""Helpers shared by the training-data operators: scratch tables, row keys, ranks, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelyard.session import ensure_checkpoint_dir

#: Upper bound of (group, cell) pairs that `rank_within` splits its groups into.
RANK_CELLS = 1 << 16


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of `spark.checkpoint.dir`, removed when the session's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/funnelyard-{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Rows of a stored table that one task writes, where their number is known.
STAGE_ROWS = 200_000


def stage(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors.

    With an upper bound of its rows it is written by no more tasks than they need. An aggregate that is
    joined back to its own rows is best stored first: the join then reads two plain shuffles, of which a
    hot key's can be split at run time, while an aggregate right below the join keeps its keys together.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // STAGE_ROWS + 1)
    path = scratch_path(spark, label)
    # the shuffle files of this write are of no further use once it is done: the table is read instead
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete tables of `stage` that nothing will read any more."""
    for df in staged:
        spark = df.sparkSession
        if files := df.inputFiles():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_clashing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop input columns that an operator is about to produce; the operator's own column wins."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def key128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit digests of the values (a null differs from an empty string)."""
    marked = [c for col in cols for c in (col, F.isnull(col))]
    return F.xxhash64(*marked), F.xxhash64(F.lit(0x5EED), *marked)


def without(df: DataFrame, keys: DataFrame, *cols: Column) -> DataFrame:
    """The rows of `df` whose `key128(*cols)` is not among the rows (k1, k2) of `keys`; all columns stay."""
    k1, k2 = key128(*cols)
    gone = keys.select("k1", "k2").distinct()
    # the rows' own columns stay in one struct, whatever their names
    return df.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2")).join(gone, ["k1", "k2"], "left_anti").select("row.*")


def rank_within(df: DataFrame, groups: list[str], order: list[str], n_groups: int, out: str = "rank") -> DataFrame:
    """Gapless numbers from 0 inside each group, without one task ever holding a group.

    Rows of a group are dealt by a digest of the order columns into cells; a window numbers the rows of
    a cell, and the running count of the smaller cells is added. There are at most RANK_CELLS cells in
    all (`n_groups` bounds the groups), so the running counts are a small table at any input size. Rows
    that tie in every order column are numbered in any order. Group columns must not be null.
    """
    cells = max(1, RANK_CELLS // max(1, n_groups))
    celled = df.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    counts = celled.groupBy(*groups, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*groups, "__cell").orderBy(*order)
    numbered = celled.withColumn("__i", F.row_number().over(inside) - 1)
    return (numbered.join(starts, [*groups, "__cell"])
            .select(*[F.col(c) for c in df.columns], (F.col("__start") + F.col("__i")).cast("long").alias(out)))


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count of the distinct edges (a > b), and of the nodes that keep them from being stars around their least nodes: those
    with two lesser neighbours, or with lesser and greater ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("less"), F.lit(0).alias("more")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("less").alias("less"), F.max("more").alias("more"))
    counts = nodes.agg(F.sum("less").alias("edges"), F.count_if((F.col("less") > 1) | ((F.col("less") > 0) & (F.col("more") > 0))).alias("loose"))
    return tuple(counts.select(F.coalesce("edges", F.lit(0)), "loose").first())


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of undirected `edges` (a long, b long): rows (node, root), root the least node.

    Alternates the large-star and small-star steps until the edges are stars around their least nodes, which a further
    round would leave as they are; edges that are stars from the start need none. Every round is written to the shared
    folder, and the tables of the round before are removed; the least neighbours are stored before they are joined back,
    so that a node with very many edges can be split. Links never reach the driver, only two counts do. Nodes without an
    edge are not returned. The result is a stored table.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
              f"{label}-edges")
    edges_now, loose = _state(e)
    while loose:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        most = 2 * edges_now  # a step makes no more than two edges of one
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{label}-low", most)
        large = stage(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .where("a <> b").distinct(), f"{label}-large", most)
        low2 = stage(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-low", most)
        small = (large.join(low2, "a")
                 .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s"))
                 .select("s.a", "s.b").where("a <> b").distinct())
        new = stage(small, f"{label}-round", most)
        discard(e, low, large, low2)
        e = new
        edges_now, loose = _state(e)
    found = stage(e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), f"{label}-roots", 2 * edges_now)
    discard(e)
    return found
