"""Business-concept inference for catalog columns (C3) and physical
mapping of concepts to tables and columns (C6).

The concept and profile lists below are small fixed rule tables; the
catalog (one row per column of every dataset) stays distributed.  C3 is
row-local (one expression per concept); C6 joins the catalog with the
broadcast profile rows on normalised names.  Token logic uses Spark array
functions (``split``, ``array_except``, ``array_intersect``), not Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelyard.operators.catalog import column_role, normalize_name

# --- fixed values -----------------------------------------------------------
# Business concepts: key, display name, category, synonyms (in this order).
CONCEPTS = (
    ("leads", "Leads", "metric", ("leads", "lead", "student leads", "enquiries", "inquiries")),
    ("cucet", "CUCET", "metric", ("cucet", "cucet registration", "cucet registrations")),
    ("admission", "Admission", "metric", ("admission", "admissions", "adm", "enrollment", "enrolment")),
    ("admission_year", "Admission Year", "time_dimension", ("admission year", "admissionyear", "admission_year")),
    ("year", "Year", "time_dimension", ("year", "calendar year", "academic year")),
    ("penetration", "Penetration", "metric", ("penetration", "penetration %", "penetration percentage")),
    ("lead_cucet_rate", "Lead to CUCET Rate", "metric",
     ("lead cucet", "lead cucet %", "lead to cucet", "lead to cucet %")),
    ("lead_admission_rate", "Lead Admission Rate", "metric",
     ("lead admission", "lead admission %", "lead admission percentage", "lead-admission")),
    ("cucet_admission_rate", "CUCET Admission Rate", "metric",
     ("cucet admission", "cucet admission %", "cucet admission percentage")),
    ("program", "Program", "academic", ("program", "programme", "course", "degree", "course name", "programname")),
    ("campus", "Campus", "organization", ("campus",)),
    ("cluster", "Cluster", "organization", ("cluster",)),
    ("source", "Source", "marketing", ("source", "main source", "mainsource", "main_source", "lead source",
                                       "leadsource")),
    ("source_cluster", "Source Cluster", "marketing", ("source cluster", "sourcecluster")),
    ("state", "State", "geography", ("state", "state group")),
    ("city", "City", "geography", ("city", "town")),
    ("district", "District", "geography", ("district",)),
    ("owner", "Owner", "organization", ("owner", "assigned owner")),
    ("name", "Person Name", "identity", ("name", "student name", "candidate name")),
    ("email", "Email", "identity", ("email", "emailid", "email id", "email address")),
    ("enquiry_id", "Enquiry ID", "identity", ("enquiryid", "enquiry id", "enquiry_id")),
    ("user_id", "User ID", "identity", ("userid", "user id", "user_id")),
    ("enquiry_date", "Enquiry Date", "date", ("enquiry date", "enquirydate", "enquiry_date")),
    ("admission_date", "Admission Date", "date", ("admission date", "admissiondate", "admission_date")),
    ("session", "Academic Session", "academic", ("session", "academic session")),
    ("calling_batch", "Calling Batch", "operations", ("calling batch", "callingbatch")),
    ("lead_type", "Lead Type", "marketing", ("lead type", "leadtype")),
)
# Category -> data role.
ROLE_OF_CATEGORY = {"metric": "metric", "funnel": "metric", "date": "date",
                    "time_dimension": "dimension", "geography": "dimension", "academic": "dimension",
                    "organization": "dimension", "marketing": "dimension", "identity": "dimension"}
MIN_SCORE = 0.70
TOP_CANDIDATES = 5
# Physical profiles: concept -> table aliases and per-role column names.
PHYSICAL_PROFILES = {
    "leads": {"table": ("enquiries", "enquiry", "leads", "lead", "prospects", "prospect"),
              "entity": ("enquiry_id", "lead_id", "prospect_id", "user_id"),
              "date": ("enquiry_date", "lead_date", "created_date", "created_at")},
    "cucet": {"table": ("cucet_registrations", "cucet_registration", "cucet", "registrations", "registration"),
              "entity": ("registration_id", "cucet_id"),
              "date": ("registration_date", "cucet_date", "created_at")},
    "admission": {"table": ("admissions", "admission", "enrollments", "enrolments", "students"),
                  "entity": ("admission_id", "enrollment_id", "enrolment_id"),
                  "date": ("admission_date", "enrollment_date", "enrolment_date", "joining_date", "created_at"),
                  "status": ("admission_status", "enrollment_status", "enrolment_status", "status")},
    "program": {"table": ("admissions", "admission", "enquiries", "enquiry", "cucet_registrations",
                          "cucet_registration"),
                "columns": ("program_name", "program", "program_code")},
    "campus": {"table": ("admissions", "admission", "enquiries", "enquiry", "cucet_registrations",
                         "cucet_registration"),
               "columns": ("campus_name", "campus")},
    "state": {"table": ("admissions", "admission", "enquiries", "enquiry", "cucet_registrations",
                        "cucet_registration"),
              "columns": ("state", "state_name")},
}
FUNNEL_CONCEPTS = ("leads", "cucet", "admission")
FUNNEL_ROLES = ("entity", "date", "status")
TOP_PHYSICAL = 10
# ---------------------------------------------------------------------------


def normalize_text(c: Column) -> Column:
    """Lower-case, ``_``/``-`` to spaces, keep ``[a-z0-9% ]``, squeeze spaces."""
    v = F.regexp_replace(F.lower(F.trim(c)), "[_-]", " ")
    v = F.regexp_replace(v, "[^a-z0-9% ]+", " ")
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def tokens(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, " "), lambda t: F.length(t) > 1))


def _business_rule(name: Column) -> Column:
    """Client rules on the raw lower-cased name: (concept, time context)."""
    cy, py = name.rlike(r"\bcy\b"), name.rlike(r"\bpy\b")
    has = name.contains
    adm = has("admission") | name.rlike(r"\badm\b")

    def rule(k, t):
        return F.struct(F.lit(k).alias("concept_key"), F.lit(t).alias("time_context"))
    return (F.when(cy & has("lead") & has("admission") & has("%"), rule("lead_admission_rate", "current_year"))
            .when(cy & has("lead") & has("cucet") & has("%"), rule("lead_cucet_rate", "current_year"))
            .when(cy & has("cucet") & has("admission") & has("%"), rule("cucet_admission_rate", "current_year"))
            .when(has("lead") & py, rule("leads", "previous_year"))
            .when(has("lead") & cy, rule("leads", "current_year"))
            .when(has("cucet") & py, rule("cucet", "previous_year"))
            .when(has("cucet") & cy, rule("cucet", "current_year"))
            .when(adm & py, rule("admission", "previous_year"))
            .when(adm & cy, rule("admission", "current_year")))


def _time_context(name: Column) -> Column:
    y = F.regexp_extract(name, r"\b(20\d{2})\b", 1)
    return (F.when(name.rlike(r"\bpy\b"), F.lit("previous_year"))
            .when(name.rlike(r"\bcy\b"), F.lit("current_year"))
            .when(y != "", y))


_SYN_TYPE = ("array<struct<concept_order:int,concept_key:string,display_name:string,category:string,"
             "data_role:string,synonym:string>>")


def _synonyms() -> Column:
    """The fixed synonym table as one constant array (a single JSON literal,
    folded by the optimizer)."""
    import json
    rows = [{"concept_order": i, "concept_key": k, "display_name": d, "category": c,
             "data_role": ROLE_OF_CATEGORY.get(c, "unknown"), "synonym": s}
            for i, (k, d, c, syns) in enumerate(CONCEPTS) for s in syns]
    return F.from_json(F.lit(json.dumps(rows)), _SYN_TYPE)


def _score(norm: Column, tok: Column, syn: Column) -> Column:
    sn = normalize_text(syn)
    st = tokens(sn)
    subset = (F.size(st) > 0) & (F.size(F.array_except(st, tok)) == 0)
    overlap = F.try_divide(F.size(F.array_intersect(tok, st)), F.size(st))
    return (F.when(norm == sn, F.lit(1.0))
            .when(subset, F.when(F.size(st) > 1, F.lit(0.95)).otherwise(F.lit(0.90)))
            .when((F.size(tok) > 0) & (F.size(st) > 0) & (overlap >= 0.5), overlap * 0.70)
            .otherwise(F.lit(0.0)))


def infer_semantics(catalog: DataFrame, keys=("table_name",), column_col: str = "column_name",
                    type_col: str = "data_type") -> DataFrame:
    """C3 — candidate business concepts per column.

    A client business rule wins alone (score 1.0).  Otherwise every concept
    scores its best synonym: equal normalised text 1.0; all synonym tokens
    in the column 0.95 (several tokens) / 0.90 (one); else token overlap
    >= 0.5 times 0.70.  Scores below 0.70 are dropped; an exact match wins
    alone; else the top 5 (ties: concept order).

    Row-local: each column row scores the constant synonym array with one
    lambda, keeps each concept's best synonym (first after sorting), and
    picks its candidates — no join and no shuffle.
    """
    raw = F.lower(F.trim(F.col(column_col)))
    base = catalog.select(*keys, F.col(column_col).alias("column_name"), F.col(type_col).alias("data_type"),
                          raw.alias("_raw"), normalize_text(F.col(column_col)).alias("_norm"))
    base = base.withColumn("_tok", tokens(F.col("_norm")))
    scored = F.transform(_synonyms(), lambda s: F.struct(
        _score(F.col("_norm"), F.col("_tok"), s["synonym"]).alias("score"), s["concept_order"].alias("concept_order"),
        s["concept_key"].alias("concept_key"), s["display_name"].alias("display_name"),
        s["category"].alias("category"), s["data_role"].alias("data_role")))
    ordered = F.array_sort(F.filter(scored, lambda c: c["score"] >= MIN_SCORE),
                           lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                           .otherwise(a["concept_order"] - b["concept_order"]))
    d = base.withColumn("_o", ordered)
    # keep each concept once: its first (best) entry in the sorted array
    best = F.filter("_o", lambda x, i: ~F.exists(F.slice("_o", 1, i), lambda y: y["concept_key"] == x["concept_key"]))
    d = d.withColumn("_b", best)
    exact = F.exists("_b", lambda c: c["score"] == 1.0)
    chosen = F.when(exact, F.slice("_b", 1, 1)).otherwise(F.slice("_b", 1, TOP_CANDIDATES))

    rule = _business_rule(F.col("_raw"))
    info_d = F.create_map(*[x for k, dsp, _, _ in CONCEPTS for x in (F.lit(k), F.lit(dsp))])
    info_c = F.create_map(*[x for k, _, c, _ in CONCEPTS for x in (F.lit(k), F.lit(c))])
    rule_c = F.array(F.struct(
        F.lit(1.0).alias("score"), F.lit(0).alias("concept_order"), rule["concept_key"].alias("concept_key"),
        info_d[rule["concept_key"]].alias("display_name"), info_c[rule["concept_key"]].alias("category"),
        F.lit("metric").alias("data_role")))
    picked = d.select(*keys, "column_name", "data_type",
                      F.when(rule.isNotNull(), rule_c).otherwise(chosen).alias("_c"),
                      F.when(rule.isNotNull(), rule["time_context"]).otherwise(_time_context(F.col("_raw")))
                      .alias("time_context"))
    out = picked.select(*keys, "column_name", "data_type", "time_context", F.posexplode("_c").alias("_p", "c"))
    return out.select(*keys, "column_name", "data_type", F.col("c.concept_key").alias("concept_key"),
                      F.col("c.display_name").alias("display_name"), F.col("c.category").alias("category"),
                      F.col("c.data_role").alias("data_role"), F.round(F.col("c.score"), 4).alias("score"),
                      "time_context", (F.col("_p") + 1).cast("long").alias("rank"))


def _profile_rows(spark: SparkSession) -> DataFrame:
    rows = [(c, kind, n) for c, prof in PHYSICAL_PROFILES.items() for kind, names in prof.items() for n in names]
    return spark.createDataFrame(rows, "concept_key string, kind string, name string").select(
        "concept_key", "kind", normalize_name(F.col("name")).alias("name")).distinct()


def map_physical(catalog: DataFrame, concepts=tuple(PHYSICAL_PROFILES)) -> DataFrame:
    """C6 — concept x table x column score: 0.5 when the table is one of
    the concept's aliases plus 0.5 when the column is in the concept's list
    for its role; keep >= 0.5, one row per (table, column, role), top 10
    per concept (confidence, then entity > date > status).  Funnel concepts
    consider only their own tables, in the entity, date and status roles;
    other concepts use the column's inferred role (C5)."""
    spark = catalog.sparkSession
    prof = F.broadcast(_profile_rows(spark).filter(F.col("concept_key").isin(*concepts)))
    cat = column_role(catalog).select("table_schema", "table_name", "column_name", "data_type", "position",
                                      normalize_name(F.col("table_name")).alias("_nt"),
                                      F.col("normalized_name").alias("_nc"), F.col("role").alias("_inferred"))
    tables = prof.filter(F.col("kind") == "table").select("concept_key", F.col("name").alias("_alias"))
    funnel = [c for c in concepts if c in FUNNEL_CONCEPTS]
    other = [c for c in concepts if c not in FUNNEL_CONCEPTS]
    roles = F.explode(F.array(*[F.lit(r) for r in FUNNEL_ROLES]))
    # funnel concepts: only matching tables, three roles each
    f = (cat.join(tables.filter(F.col("concept_key").isin(*funnel)), cat._nt == tables._alias)
         .select("concept_key", "table_schema", "table_name", "column_name", "data_type", "position", "_nc",
                 roles.alias("column_role"), F.lit(True).alias("_tmatch")))
    # other concepts: every column, role inferred from name and type
    o = (cat.withColumn("concept_key", F.explode(F.array(*[F.lit(c) for c in other]) if other
                                                 else F.array().cast("array<string>")))
         .join(tables.withColumnRenamed("concept_key", "_ck"),
               (F.col("concept_key") == F.col("_ck")) & (cat._nt == F.col("_alias")), "left")
         .select("concept_key", "table_schema", "table_name", "column_name", "data_type", "position", "_nc",
                 F.col("_inferred").alias("column_role"), F.col("_alias").isNotNull().alias("_tmatch")))
    cand = f.unionByName(o)
    # which column list applies: the role's own list for funnel roles, 'columns' otherwise
    kind = (F.when(F.col("column_role").isin("entity", "date", "status"), F.col("column_role"))
            .otherwise(F.lit("columns")))
    cols = prof.filter(F.col("kind") != "table").select(F.col("concept_key").alias("_c2"),
                                                        F.col("kind").alias("_k2"), F.col("name").alias("_n2"))
    cand = cand.withColumn("_kind", kind).join(
        cols, (F.col("concept_key") == F.col("_c2")) & (F.col("_kind") == F.col("_k2")) & (F.col("_nc") == F.col("_n2")),
        "left")
    score = F.least(F.lit(1.0), F.when(F.col("_tmatch"), 0.5).otherwise(0.0)
                    + F.when(F.col("_n2").isNotNull(), 0.5).otherwise(0.0))
    scored = cand.select("concept_key", "table_schema", "table_name", "column_name", "column_role", "data_type",
                         "position", F.round(score, 4).alias("confidence")).filter(F.col("confidence") >= 0.5) \
        .dropDuplicates(["concept_key", "table_schema", "table_name", "column_name", "column_role"])
    pref = (F.when(F.col("column_role") == "entity", 3).when(F.col("column_role") == "date", 2)
            .when(F.col("column_role") == "status", 1).otherwise(0))
    w = Window.partitionBy("concept_key").orderBy(F.col("confidence").desc(), pref.desc(), "table_name", "position",
                                                  "column_role")
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP_PHYSICAL)
            .withColumn("rank", F.col("rank").cast("long")).drop("position"))
