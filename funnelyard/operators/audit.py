"""Transcript audit analytics (T1-T6, A8 projection, A9).

Turns are ``(message_id, conv_id, turn, question, answer, ...)`` and
evaluations ``(message_id, status, error_category, ...)``.  Every operator
is a join / filter / aggregate; the only window (T5) is a top-n per
conversation, which Spark runs as a WindowGroupLimit (cut to ``n`` rows per
partition before the shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelyard.operators.ingest import upsert

# --- fixed values -----------------------------------------------------------
VALID_EVAL_STATUSES = ("unreviewed", "correct", "incorrect", "partially_correct")
VALID_ERROR_CATEGORIES = (
    "intent_error", "entity_error", "period_error", "metric_error", "context_error",
    "tool_selection_error", "sql_error", "result_interpretation_error", "formatting_error",
    "unsupported_question_error", "hallucination_error", "other",
)
RESULT_SAMPLE_ROWS = 10
RECENT_TURNS = 6
# ---------------------------------------------------------------------------


def join_evaluations(msgs: DataFrame, evals: DataFrame, key: str = "message_id") -> DataFrame:
    """Messages left-joined with their evaluation; no evaluation means
    ``unreviewed``."""
    e = evals.select(F.col(key), F.col("status").alias("_st"),
                     F.col("error_category").alias("eval_error_category"))
    return (msgs.join(e, key, "left")
            .withColumn("eval_status", F.coalesce("_st", F.lit("unreviewed"))).drop("_st"))


# ---------------------------------------------------------------------- T1
def transcripts(turns: DataFrame, conversation_id=None, status: str | None = None,
                error_category: str | None = None, dataset_id: str | None = None,
                period: str | None = None, order_col: str = "message_id") -> DataFrame:
    """T1 — filters on conversation, evaluation status, either error
    category (system or evaluation), dataset and any period field (an error
    where the turns lack the filtered columns); newest first (page with :func:`funnelyard.operators.compare.page`)."""
    d = turns
    if conversation_id is not None:
        d = d.filter(F.col("conv_id") == conversation_id)
    if status:
        d = d.filter(F.coalesce("eval_status", F.lit("unreviewed")) == status)
    if error_category:
        cond = F.col("eval_error_category") == error_category
        if "system_error_category" in d.columns:
            cond = cond | (F.col("system_error_category") == error_category)
        d = d.filter(cond)
    if dataset_id:
        if "dataset_id" not in d.columns:
            raise ValueError("these turns carry no dataset_id to filter on")
        d = d.filter(F.col("dataset_id") == dataset_id)
    if period:
        cols = [c for c in ("academic_label", "period_a", "period_b") if c in d.columns]
        if not cols:
            raise ValueError("these turns carry no period field to filter on")
        cond = F.lit(False)
        for c in cols:
            cond = cond | (F.col(c) == period)
        d = d.filter(cond)
    return d.orderBy(F.col(order_col).desc())


# ---------------------------------------------------------------------- T2
def summarise_result(rows: DataFrame, order: Sequence[str | Column], n: int = RESULT_SAMPLE_ROWS) -> DataFrame:
    """T2 — data minimisation: the column list, the total row count and only
    the first ``n`` rows (as JSON), in one row."""
    cols = rows.columns
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    first = rows.orderBy(*order_cols).limit(n).withColumn(
        "_p", F.row_number().over(Window.orderBy(*order_cols)))  # at most n rows
    sample = first.agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "_p", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("j")))),
        lambda s: s["j"]).alias("sample_rows"))
    total = rows.agg(F.count(F.lit(1)).alias("total_row_count"))
    return total.crossJoin(sample).select(F.array(*[F.lit(c) for c in cols]).alias("columns"),
                                          "total_row_count", "sample_rows")


# ---------------------------------------------------------------------- T3
def record_evaluations(evals: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T3 — validate status and category, then upsert one evaluation per
    message (latest update wins).  Returns ``(evaluations, rejected)``; every
    update is in exactly one of the two, a missing status among the rejected."""
    ok = F.coalesce(F.col("status").isin(*VALID_EVAL_STATUSES)
                    & (F.col("error_category").isNull() | F.col("error_category").isin(*VALID_ERROR_CATEGORIES)),
                    F.lit(False))
    good = updates.filter(ok)
    rejected = updates.filter(~ok).withColumn(
        "reason", F.when(F.col("status").isNull(), F.lit("missing_status"))
        .when(~F.col("status").isin(*VALID_EVAL_STATUSES), F.lit("invalid_status"))
        .otherwise(F.lit("invalid_error_category")))
    merged = upsert(evals.select("message_id", "status", "error_category"),
                    good.select("message_id", "status", "error_category", "seq"),
                    ["message_id"], "seq")
    return merged, rejected


# ---------------------------------------------------------------------- T4
def promote_golden(cases: DataFrame, updates: DataFrame, order_col: str = "seq") -> DataFrame:
    """T4 — upsert regression cases by ``case_code``; listing ordered by code."""
    return upsert(cases, updates, ["case_code"], order_col).orderBy("case_code")


# ---------------------------------------------------------------------- T5
def recent_turns(msgs: DataFrame, n: int = RECENT_TURNS, key: str = "conv_id",
                 order_col: str = "turn") -> DataFrame:
    """T5 — the last ``n`` messages of every conversation, in time order."""
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc())
    return (msgs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
            .orderBy(key, order_col))


# ---------------------------------------------------------------------- T6
def isolate_context(ctx: DataFrame, registry: DataFrame) -> DataFrame:
    """T6 — keep only contexts whose dataset is the globally active one."""
    active = registry.filter(F.col("is_active")).select(F.col("dataset_id").alias("_a"))
    return ctx.join(active, ctx.dataset_id == active._a, "left_semi")


# ---------------------------------------------------------------------- A8 / A9
def export_projection(turns: DataFrame) -> DataFrame:
    """A8 — the exported shape: conversation, message, time, question, answer,
    what the turn resolved to (intent, metric, dimension, entities, filters,
    tool, success), session/years (from the period fields, else selected
    years), one error category (evaluation first), evaluation status.  Fields
    that the turns lack are null."""
    have = set(turns.columns)

    def opt(c: str, t: str = "string") -> Column:
        return F.col(c) if c in have else F.lit(None).cast(t)
    years = opt("selected_years", "array<string>")
    return turns.select(
        F.col("conv_id").alias("conversation_id"), "message_id", opt("created_at", "timestamp").alias("created_at"),
        F.lit("assistant").alias("role"), "question", F.col("answer").alias("assistant_answer"),
        *[opt(c).alias(c) for c in ("intent", "metric", "dimension")],
        *[opt(c).alias(c) for c in ("resolved_entities", "filters", "tool_used")],
        opt("success", "boolean").alias("success"), opt("dataset_id").alias("dataset_id"),
        opt("academic_label").alias("session_period"),
        F.coalesce(opt("period_a"), F.try_element_at(years, F.lit(1))).alias("year_a"),
        F.coalesce(opt("period_b"), F.try_element_at(years, F.lit(2))).alias("year_b"),
        F.coalesce(opt("eval_error_category"), opt("system_error_category")).alias("error_category"),
        F.coalesce(opt("eval_status"), F.lit("unreviewed")).alias("evaluation_status"),
        opt("correct_answer").alias("correct_answer"), opt("correction_notes").alias("correction_notes"))


def export_summary(turns: DataFrame) -> DataFrame:
    """A9 — distinct conversations, turns, evaluated turns (reviewed, or
    carrying a correct answer or notes) in one aggregate."""
    have = set(turns.columns)
    evaluated = F.coalesce(F.col("eval_status"), F.lit("unreviewed")) != "unreviewed"
    for c in ("correct_answer", "correction_notes"):
        if c in have:
            evaluated = evaluated | F.col(c).isNotNull()
    return turns.agg(F.count_distinct("conv_id").alias("conversations"),
                     F.count(F.lit(1)).alias("messages"), F.count_if(evaluated).alias("evaluated_turns"))
