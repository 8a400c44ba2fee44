"""Dense, 1-based row numbers inside groups without a per-group window.

``row_number() over (partition by g order by o)`` sends every row of a group
to one task.  When one group holds a large share of the table that task does
all the work.  ``ordinal_within`` instead

1. range-partitions and sorts the rows by ``(g, o)`` (a distributed sort that
   splits a hot group across many partitions),
2. checkpoints that sorted layout to the reliable checkpoint directory so
   partition ids are stable on recomputation or executor loss,
3. reads each row's partition id and its position inside the partition from
   ``monotonically_increasing_id``, whose layout Spark documents (the partition
   in the upper 31 bits, the record number in the lower 33); a test holds it,
4. turns per-partition counts (one row per partition) into offsets, and the
   first global position of every group into the group start.

The tables built in step 4 have at most ``partitions + groups`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelyard.session import ensure_checkpoint_dir

_POS_MASK = (1 << 33) - 1


def ordinal_within(df: DataFrame, group_cols: Sequence[str],
                   order_cols: Sequence[str | Column], name: str = "row_number") -> DataFrame:
    """Add ``name`` = position of the row inside its group (1-based).

    ``order_cols`` should make the order total inside a group (include a key),
    otherwise ties are numbered in an arbitrary but stable order.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sort_keys = [F.col(g) for g in group_cols] + [
        F.col(o) if isinstance(o, str) else o for o in order_cols]
    laid_out = df.orderBy(*sort_keys).checkpoint(eager=True)

    mid = F.monotonically_increasing_id()
    t = laid_out.select("*", F.shiftright(mid, 33).alias("__oq_pid"),
                        mid.bitwiseAND(F.lit(_POS_MASK)).alias("__oq_pos"))

    per_part_group = t.groupBy("__oq_pid", *group_cols).agg(
        F.min("__oq_pos").alias("__oq_first"), F.count(F.lit(1)).alias("__oq_n"))
    # One row per partition: bounded by the partition count, safe to broadcast.
    offsets = (per_part_group.groupBy("__oq_pid").agg(F.sum("__oq_n").alias("__oq_n"))
               .select("__oq_pid", (F.sum("__oq_n").over(
                   Window.orderBy("__oq_pid").rowsBetween(Window.unboundedPreceding, -1)))
                   .alias("__oq_off")))
    offsets = offsets.select("__oq_pid", F.coalesce("__oq_off", F.lit(0)).cast("long").alias("__oq_off"))
    gkeys = [f"__oq_g{i}" for i in range(len(group_cols))]
    group_start = (per_part_group.join(F.broadcast(offsets), "__oq_pid")
                   .groupBy(*[F.col(g).alias(k) for g, k in zip(group_cols, gkeys)])
                   .agg(F.min(F.col("__oq_off") + F.col("__oq_first")).alias("__oq_start")))
    with_off = t.join(F.broadcast(offsets), "__oq_pid")
    if group_cols:
        cond = None
        for g, k in zip(group_cols, gkeys):
            c = with_off[g].eqNullSafe(group_start[k])
            cond = c if cond is None else cond & c
        joined = with_off.join(group_start, cond, "inner").drop(*gkeys)
    else:
        joined = with_off.withColumn("__oq_start", F.lit(0).cast("long"))
    return (joined.withColumn(name, (F.col("__oq_off") + F.col("__oq_pos") - F.col("__oq_start") + 1).cast("long"))
            .drop("__oq_pid", "__oq_pos", "__oq_off", "__oq_start"))
