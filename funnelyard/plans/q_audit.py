"""Registered transcript-audit queries (T1-T6, A8, A9) on the turns view T."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelyard.operators import audit as T
from funnelyard.plans.oracle_views import with_views
from funnelyard.plans.registry import register
from funnelyard.sources import bindings as B
from funnelyard.sources.tables import read_table


def _t(spark, sf_dir):
    return B.turns(spark, sf_dir)


# ---------------------------------------------------------------- T1
@register("transcripts_filtered", with_views(
    "select * from T where eval_status = 'correct' and eval_error_category = 'other'", "T"))
def q_transcripts(spark, sf_dir):
    return T.transcripts(_t(spark, sf_dir), status="correct", error_category="other")


@register("transcripts_unreviewed_page", with_views("""
select *, false as has_more, rn - 1 as row_index from (
  select *, row_number() over (order by message_id desc) as rn from T where eval_status = 'unreviewed') x
where rn <= 50""".replace("select *, false as has_more", "select * exclude (rn, n), n > 50 as has_more").replace(
    "row_number() over (order by message_id desc) as rn from T", "row_number() over (order by message_id desc) as rn, "
    "count(*) over () as n from T"), "T"))
def q_transcripts_page(spark, sf_dir):
    from funnelyard.operators.compare import page
    t = T.transcripts(_t(spark, sf_dir), status="unreviewed")
    return page(t, [F.col("message_id").desc()], limit=50)


# ---------------------------------------------------------------- T2
@register("summarise_result", with_views("""
select ['message_id', 'conv_id', 'turn', 'question', 'answer', 'eval_status', 'eval_error_category'] as columns,
  (select count(*) from T) as total_row_count,
  (select list(j order by message_id) from (select message_id, to_json(struct_pack(message_id := message_id,
     conv_id := conv_id, turn := turn, question := question, answer := answer, eval_status := eval_status,
     eval_error_category := eval_error_category))::varchar as j from T order by message_id limit 10) s) as sample_rows
""", "T"))
def q_summarise_result(spark, sf_dir):
    return T.summarise_result(_t(spark, sf_dir), ["message_id"])


# ---------------------------------------------------------------- T3
def _eval_updates(spark, sf_dir):
    """Reviewer updates derived from ``labels``: toxic conversations get an
    'incorrect' / hallucination verdict, low-quality ones a bad status, and
    every fifth turn lacks its status."""
    t = _t(spark, sf_dir)
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = t.join(lab, t.conv_id == lab.doc_id)
    status = (F.when(F.col("turn") % 5 == 4, F.lit(None).cast("string"))
              .when(F.col("toxic") == 1, F.lit("incorrect"))
              .when(F.col("quality") == 0, F.lit("needs_review")).otherwise(F.lit("partially_correct")))
    cat = F.when(F.col("toxic") == 1, F.lit("hallucination_error")).when(
        F.col("quality") == 1, F.lit(None).cast("string")).otherwise(F.lit("metric_error"))
    return j.select("message_id", status.alias("status"), cat.alias("error_category"), F.col("turn").alias("seq"))


_UPD_SQL = ("upd", "select t.message_id, case when t.turn % 5 = 4 then null when l.toxic = 1 then 'incorrect' when l.quality = 0 then 'needs_review' "
                   "else 'partially_correct' end as status, case when l.toxic = 1 then 'hallucination_error' "
                   "when l.quality = 1 then null else 'metric_error' end as error_category, t.turn as seq "
                   "from T t join labels l on t.conv_id = l.doc_id")
_VALID = ("('unreviewed', 'correct', 'incorrect', 'partially_correct')")
_CATS = "(" + ", ".join(f"'{c}'" for c in T.VALID_ERROR_CATEGORIES) + ")"


@register("record_evaluations", with_views(f"""
select coalesce(e.message_id, u.message_id) as message_id,
  case when u.message_id is not null then u.status else e.status end as status,
  case when u.message_id is not null then u.error_category else e.error_category end as error_category,
  case when e.message_id is null then 'inserted' when u.message_id is not null then 'updated' else 'base' end as _source
from (select message_id, eval_status as status, eval_error_category as error_category from T) e
full outer join (select * from upd where status in {_VALID} and (error_category is null or error_category in {_CATS})) u
  using (message_id)""", "T", extra=[_UPD_SQL]))
def q_record_evaluations(spark, sf_dir):
    t = _t(spark, sf_dir)
    evals = t.select("message_id", F.col("eval_status").alias("status"),
                     F.col("eval_error_category").alias("error_category"))
    merged, _ = T.record_evaluations(evals, _eval_updates(spark, sf_dir))
    return merged


@register("rejected_evaluations", with_views(f"""
select *, case when status is null then 'missing_status' when status not in {_VALID} then 'invalid_status'
  else 'invalid_error_category' end as reason
from upd where not coalesce(status in {_VALID} and (error_category is null or error_category in {_CATS}), false)""", "T",
    extra=[_UPD_SQL]))
def q_rejected_evaluations(spark, sf_dir):
    t = _t(spark, sf_dir)
    evals = t.select("message_id", F.col("eval_status").alias("status"),
                     F.col("eval_error_category").alias("error_category"))
    _, rejected = T.record_evaluations(evals, _eval_updates(spark, sf_dir))
    return rejected


# ---------------------------------------------------------------- T4
@register("promote_golden", with_views("""
select coalesce(b.case_code, u.case_code) as case_code,
  case when u.case_code is not null then u.question else b.question end as question,
  case when u.case_code is not null then u.expected_answer else b.expected_answer end as expected_answer,
  case when b.case_code is null then 'inserted' when u.case_code is not null then 'updated' else 'base' end as _source
from (select concat('GC-', cast(conv_id as varchar)) as case_code, arg_min(question, turn) as question,
        arg_min(answer, turn) as expected_answer from T where eval_status = 'correct' and eval_error_category is null
        group by 1) b
full outer join (select case_code, w.q as question, w.a as expected_answer from (
    select concat('GC-', cast(conv_id as varchar)) as case_code,
           arg_max(struct_pack(q := question, a := answer), turn) as w from T where eval_status = 'correct' group by 1) u0) u
  using (case_code)""", "T"))
def q_promote_golden(spark, sf_dir):
    t = _t(spark, sf_dir).filter(F.col("eval_status") == "correct")
    code = F.concat(F.lit("GC-"), F.col("conv_id").cast("string")).alias("case_code")
    # existing cases: clean correct conversations; updates: every correct turn
    base = (t.filter(F.col("eval_error_category").isNull()).groupBy(code)
            .agg(F.min_by(F.struct("question", "answer"), "turn").alias("w"))
            .select("case_code", F.col("w.question").alias("question"), F.col("w.answer").alias("expected_answer")))
    upd = t.select(code, "question", F.col("answer").alias("expected_answer"), F.col("turn").alias("seq"))
    return T.promote_golden(base, upd)


# ---------------------------------------------------------------- T5
@register("recent_turns", """
select conv_id, turn, role, text from (
  select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) x where r <= 6""")
def q_recent_turns(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return T.recent_turns(conv, 6)


# ---------------------------------------------------------------- T6
@register("isolate_context", with_views("""
select conv_id, dataset_id from (select distinct c.conv_id, (case when l.doc_id is null then (select min(dataset_id) from R)
    else (select d from newest) end)::BIGINT as dataset_id
  from conversations c left join labels l on l.doc_id = c.conv_id) c where dataset_id = (select d from newest)""", "R",
    extra=[("newest", "select max(dataset_id) as d from R where not regexp_matches(dataset_name, "
            "'^(Bench_|benchmark_|test_|synthetic_)', 'i')")]))
def q_isolate_context(spark, sf_dir):
    from funnelyard.operators.periods import is_benchmark
    conv = read_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    lab = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("_l"))
    # contexts: labelled conversations were saved against the newest real dataset, the others against the
    # oldest one of all; the two bounds are one row
    r = B.registry(spark, sf_dir)
    bounds = r.agg(F.max(F.when(~is_benchmark("dataset_name"), F.col("dataset_id"))).alias("_a"), F.min("dataset_id").alias("_o"))
    ctx = conv.join(lab, "conv_id", "left").crossJoin(F.broadcast(bounds)).select(
        "conv_id", F.when(F.col("_l").isNull(), F.col("_o")).otherwise(F.col("_a")).cast("long").alias("dataset_id"))
    reg = r.crossJoin(F.broadcast(bounds)).withColumn("is_active", F.col("dataset_id") == F.col("_a"))
    return T.isolate_context(ctx, reg)


# ---------------------------------------------------------------- A8 / A9
@register("export_projection", with_views("""
select conv_id as conversation_id, message_id, null::timestamp as created_at, 'assistant' as role, question, answer as assistant_answer,
  null::varchar as intent, null::varchar as metric, null::varchar as dimension, null::varchar as resolved_entities,
  null::varchar as filters, null::varchar as tool_used, null::boolean as success, null::varchar as dataset_id, null::varchar as session_period, null::varchar as year_a, null::varchar as year_b,
  eval_error_category as error_category, coalesce(eval_status, 'unreviewed') as evaluation_status,
  null::varchar as correct_answer, null::varchar as correction_notes from T""", "T"))
def q_export_projection(spark, sf_dir):
    return T.export_projection(_t(spark, sf_dir))


@register("export_summary", with_views("""
select count(distinct conv_id) as conversations, count(*) as messages,
  count(*) filter (where coalesce(eval_status, 'unreviewed') <> 'unreviewed') as evaluated_turns from T""", "T"))
def q_export_summary(spark, sf_dir):
    return T.export_summary(_t(spark, sf_dir))
