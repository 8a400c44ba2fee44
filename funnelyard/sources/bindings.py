"""Binding views: the driver tables re-read as the funnel data model.

* ``fact``       — F: one row per line item with eight text dimensions and the
                   three funnel flags (lead / registration / admission).
* ``metrics``    — M: the wide metrics table, one dataset per two-year session
                   with current-year (``cy_*``) and previous-year (``py_*``)
                   measures.
* ``lead_events`` / ``registration_events`` / ``admission_events`` — E.
* ``registry``   — R: dataset versions under academic labels.
* ``turns``      — T: question/answer turns with their evaluation.
* ``dirty_records`` — C: a small "uploaded spreadsheet" with blanks, padding,
                   bad e-mails and formatted numbers.

Join strategy: ``nation``/``region`` are fixed-size (25/5 rows by the TPC-H
definition) and broadcast explicitly; every other join is left to Catalyst and
AQE, which broadcast a side only when its measured size is under the
threshold and otherwise sort-merge on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelyard.functions.ordinal import ordinal_within
from funnelyard.sources.tables import read_table

DIMENSIONS = ("owner", "cluster", "lead_type", "main_source", "source",
              "campus_name", "state", "program_name")
STAGES = ("leads", "registration", "admission")
MEASURES = tuple(f"{p}_{s}" for p in ("cy", "py") for s in STAGES)
# Year shift that moves the TPC-H ship dates (1995-2001) into 2020-2026.
YEAR_SHIFT = 25


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = F.col("l_linestatus") == "F"
    # the year and the flags go through the joins, not what they are made from
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", (F.year("l_shipdate") + YEAR_SHIFT).alias("yr"),
        finished.cast("int").alias("registration"), (finished & (F.col("l_returnflag") == "R")).cast("int").alias("admission"))
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    cust = cust.join(F.broadcast(_geo(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    # Orders meet customers at order grain first, so the customer-key shuffle
    # moves orders (~1/4 of the line items) instead of the line-item join.
    oc = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    j = (li.join(oc, li.l_orderkey == oc.o_orderkey)
         .join(part, F.col("l_partkey") == F.col("p_partkey"))
         .join(supp, F.col("l_suppkey") == F.col("s_suppkey")))
    return j.select(
        "yr",
        F.col("o_orderstatus").alias("lead_type"),
        F.col("o_orderpriority").alias("main_source"),
        F.col("c_mktsegment").alias("source"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("campus_name"),
        F.col("p_brand").alias("program_name"),
        F.col("p_type").alias("cluster"),
        F.col("s_name").alias("owner"),
        F.lit(1).alias("leads"), "registration", "admission",
    )


def session_of(year: Column) -> Column:
    """End year of the two-year session that holds a year: the even year itself, or the one after."""
    return year + F.pmod(year, F.lit(2))


def metrics(spark: SparkSession, sf_dir: str, blanks: bool = False, stored: str | None = None) -> DataFrame:
    """M: each fact row lands in the two-year session of its year, in the
    current-year columns if the session ends that year and in the
    previous-year columns otherwise.  The sessions are those of the data.

    ``stored`` names a metrics table written by :func:`materialize_metrics`
    (partitioned by ``dataset_id``); it is read instead, and dataset filters
    prune its partitions.
    """
    m = spark.read.parquet(stored).select("dataset_id", *DIMENSIONS, *MEASURES) if stored else derive_metrics(spark, sf_dir)
    if blanks:
        m = m.select("dataset_id", *[F.nullif(F.col(d), F.lit(BLANKED[d])).alias(d) if d in BLANKED
                                     else F.col(d) for d in DIMENSIONS], *MEASURES)
    return m


def derive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fact(spark, sf_dir).withColumn("cy", session_of(F.col("yr")))
    current = F.col("yr") == F.col("cy")
    measures = [F.when(current if prefix == "cy" else ~current, F.col(s)).otherwise(0).cast("long").alias(f"{prefix}_{s}")
                for prefix in ("cy", "py") for s in STAGES]
    return f.select(F.concat(F.lit("ds"), F.col("cy").cast("string")).alias("dataset_id"),
                    *[F.col(d) for d in DIMENSIONS], *measures)


def materialize_metrics(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Ingest step: derive M once and store it partitioned by dataset_id."""
    from funnelyard.sources.sinks import write_metrics
    write_metrics(derive_metrics(spark, sf_dir), path)


# Members turned into NULL in the "blank" variant of M (edge cases for blank handling).
BLANKED = {"source": "BUILDING", "state": "NATION_3"}


def lead_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey",
                                                        "o_orderpriority", "o_orderdate")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        F.col("o_orderkey").alias("lead_id"), F.col("o_orderpriority").alias("main_source"),
        F.col("c_mktsegment").alias("source"), F.to_date("o_orderdate").alias("event_date"))


def registration_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").alias("lead_id"), F.to_date("l_shipdate").alias("event_date"))


def admission_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.filter((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).select(
        F.col("l_orderkey").alias("lead_id"), F.to_date("l_shipdate").alias("event_date"))


def events(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"leads": lead_events(spark, sf_dir),
            "registration": registration_events(spark, sf_dir),
            "admission": admission_events(spark, sf_dir)}


def events_by_dimension(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The event tables with every dimension that F2 groups by.  A lead's
    program and cluster are those of its order's first part number; a
    registration's and an admission's are those of the line's part."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_returnflag", "l_shipdate")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("program_name"), F.col("p_type").alias("cluster"))
    place = cust.join(F.broadcast(_geo(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("c_mktsegment").alias("source"), F.col("n_name").alias("state"), F.col("r_name").alias("campus_name"))
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderpriority").alias("main_source"), F.col("o_orderstatus").alias("lead_type"),
        F.to_date("o_orderdate").alias("order_date")).join(place, F.col("o_custkey") == F.col("c_custkey"))
    first = li.groupBy("l_orderkey").agg(F.min("l_partkey").alias("first_part"))
    leads = (orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
             .join(part, F.col("first_part") == F.col("p_partkey"), "left")
             .select(F.col("o_orderkey").alias("lead_id"), "program_name", "campus_name", "cluster", "state", "source", "main_source",
                     "lead_type", F.col("order_date").alias("event_date")))
    lines = (li.filter("l_linestatus = 'F'").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(part, F.col("l_partkey") == F.col("p_partkey"))
             .select(F.col("l_orderkey").alias("lead_id"), "program_name", "campus_name", "cluster", "state",
                     F.col("lead_type").alias("admission_status"), F.to_date("l_shipdate").alias("event_date"), "l_returnflag"))
    return {"leads": leads, "registration": lines.drop("l_returnflag"),
            "admission": lines.filter("l_returnflag = 'R'").drop("l_returnflag")}


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: one row per dataset version.  ``upload_version`` is the dense rank
    of the dataset inside its label (distributed numbering, see
    :func:`ordinal_within`); the newest version of each label is active."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size",
                                                    "p_retailprice")
    start = F.lit(2015) + F.col("p_size") % 8
    label = F.concat(start.cast("string"), F.lit("-"), (F.lit(16) + F.col("p_size") % 8).cast("string"))
    base = part.select(
        F.col("p_partkey").alias("dataset_id"),
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("test_"), F.col("p_name")))
        .otherwise(F.col("p_name")).alias("dataset_name"),
        F.concat(F.col("p_name"), F.lit("_"), label, F.lit(".csv")).alias("original_filename"),
        label.alias("label"),
        start.alias("start_year"),
        (start + 1).alias("end_year"),
        F.col("p_partkey").alias("created_seq"),
        (F.col("p_retailprice") % 100).alias("quality_score"),
    )
    numbered = ordinal_within(base, ["label"], ["dataset_id"], name="upload_version")
    newest = base.groupBy(F.col("label").alias("_label")).agg(F.max("dataset_id").alias("_newest"))
    return (numbered.join(newest, numbered.label == newest._label)
            .withColumn("is_period_active", F.col("dataset_id") == F.col("_newest"))
            .drop("_label", "_newest"))


#: Turn numbers of a conversation that one window task holds.
TURN_BLOCK = 1000


def followed(conv: DataFrame) -> DataFrame:
    """Messages with ``next_role`` and ``next_text`` of the conversation's next message, whatever its number.

    The window runs inside blocks of TURN_BLOCK turn numbers, so a very long
    conversation is spread over many tasks; the last message of a block is
    followed by the first one of the conversation's next block.
    """
    block = F.floor(F.col("turn") / TURN_BLOCK).cast("long")
    own = conv.withColumn("_block", block)
    said = F.struct("role", "text")
    firsts = own.groupBy("conv_id", "_block").agg(F.min_by(said, "turn").alias("_first"))
    later = firsts.select("conv_id", "_block", F.lead("_first").over(
        Window.partitionBy("conv_id").orderBy("_block")).alias("_later"))  # one row per block
    inside = F.lead(said).over(Window.partitionBy("conv_id", "_block").orderBy("turn"))
    nxt = F.coalesce(F.col("_inside"), F.col("_later"))
    return (own.withColumn("_inside", inside).join(later, ["conv_id", "_block"], "left")
            .select(*conv.columns, nxt["role"].alias("next_role"), nxt["text"].alias("next_text")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: a user message followed by an assistant message is one turn, named
    by its conversation and turn number."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    m = followed(conv).where("role = 'user' and next_role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("question"), F.col("next_text").alias("answer"))
    m = m.join(labels, m.conv_id == labels.doc_id, "left")
    return m.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("message_id"),
        "conv_id", "turn", "question", "answer",
        F.when(F.col("quality") == 1, "correct").when(F.col("quality") == 0, "incorrect")
        .otherwise("unreviewed").alias("eval_status"),
        F.when(F.col("toxic") == 1, F.lit("other")).cast("string").alias("eval_error_category"),
    )


def dirty_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    return cust.select(
        k.alias("row_number"),
        F.col("c_name").alias("name"),
        F.when(k % 7 == 0, F.lit("bad mail"))
        .otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(k % 5 == 0, F.lit(""))
        .when(k % 5 == 1, F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")))
        .when(k % 11 == 0, F.lit("N/A"))
        .otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(k % 13 == 0, F.lit("n.a.")).when(k % 3 == 0, F.lit("1,234"))
        .otherwise(k.cast("string")).alias("amount"),
    )


def metrics_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of the M datasets: one active version per two-year session in
    the data; the newest session is the globally active dataset."""
    years = read_table(spark, sf_dir, "lineitem").select((F.year("l_shipdate") + YEAR_SHIFT).alias("yr")).distinct()
    cy = years.select(session_of(F.col("yr")).alias("cy")).distinct()  # one row per session
    label = F.concat((F.col("cy") - 1).cast("string"), F.lit("-"), F.lpad((F.col("cy") % 100).cast("string"), 2, "0"))
    ranked = cy.withColumn("_n", F.row_number().over(Window.orderBy("cy"))).withColumn("_newest", F.max("cy").over(Window.partitionBy(F.lit(1))))
    return ranked.select(
        F.concat(F.lit("ds"), F.col("cy").cast("string")).alias("dataset_id"),
        F.concat(F.lit("metrics_"), F.replace(label, F.lit("-"), F.lit("_"))).alias("dataset_name"),
        F.concat(F.lit("metrics_"), label, F.lit(".csv")).alias("original_filename"), label.alias("label"),
        (F.col("cy") - 1).cast("int").alias("start_year"), F.col("cy").cast("int").alias("end_year"),
        F.col("_n").cast("long").alias("created_seq"), F.lit(1).alias("upload_version"), F.lit(True).alias("is_period_active"),
        (F.col("cy") == F.col("_newest")).alias("is_active"))
