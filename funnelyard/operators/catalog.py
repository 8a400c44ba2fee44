"""Column, schema and relationship inference over a catalog DataFrame
(C1, C2, C4, C5, C7-C9).

A catalog has one row per ``(dataset, table, column)`` with the rows and
filled cells behind it, so the mapping of thousands of uploads is one job.
Rules are small constant arrays evaluated row by row where the catalog rows
live (no join); relationships are found by the values that key columns share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelyard.functions.core import derived_once

# --- fixed values -----------------------------------------------------------
# Header rules: exact header (lower-cased, trimmed) -> canonical field, confidence.
# Canonical names are the metrics-table columns.
EXACT_RULES = (
    ("cy leads", "cy_leads", 0.99), ("cy cucet", "cy_registration", 0.99),
    ("cy admission", "cy_admission", 0.99), ("py leads", "py_leads", 0.99),
    ("py cucet", "py_registration", 0.99), ("py admission", "py_admission", 0.99),
    ("mssourcebi", "source", 0.98), ("source cluster", "main_source", 0.98),
    ("program name (short)", "program_name", 0.98), ("program name", "program_name", 0.98),
    ("campus name", "campus_name", 0.98), ("state group", "state", 0.98),
    ("owner", "owner", 0.98), ("lead type", "lead_type", 0.98),
    ("enquiries", "cy_leads", 0.96), ("enrolled", "cy_admission", 0.96),
    ("course", "program_name", 0.95), ("marketing channel", "source", 0.94),
    ("location", "campus_name", 0.94),
)
PARTIAL_PENALTY = 0.05
# Keyword rules, most specific first (previous-year patterns before generic ones).
KEYWORD_RULES = (
    (("py lead", "prev lead", "last year lead", "previous lead"), "py_leads", 0.85),
    (("py cucet", "prev cucet", "last year cucet"), "py_registration", 0.85),
    (("py admiss", "prev admiss", "last year admiss", "previous admiss"), "py_admission", 0.85),
    (("lead", "enquir", "inquiry", "prospect"), "cy_leads", 0.85),
    (("cucet", "registr", "applicat"), "cy_registration", 0.85),
    (("admiss", "enroll", "enrolled", "joining"), "cy_admission", 0.85),
    (("source", "channel", "medium", "origin"), "source", 0.80),
    (("cluster", "main source", "source group", "source cat"), "main_source", 0.80),
    (("program", "course", "degree", "special", "branch of study"), "program_name", 0.80),
    (("campus", "location", "center", "branch", "college"), "campus_name", 0.80),
    (("state", "region", "province", "geography"), "state", 0.80),
    (("owner", "counsel", "agent", "bdm", "executive", "representative"), "owner", 0.80),
    (("lead type", "type", "category"), "lead_type", 0.75),
)
RELATIONSHIP_KEYS = ("user_id", "enquiry_id", "lead_id", "registration_id", "admission_id",
                     "program_code")
RELATIONSHIP_CONFIDENCE = 0.90
VERIFIED, POSSIBLE = 0.80, 0.50
DIMENSION_NAMES = ("program", "program name", "campus", "campus name", "cluster", "state",
                   "state name", "city", "district", "country", "source", "main source",
                   "lead type", "owner")
STATUS_NAMES = ("exam status", "admission status", "lead status")
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
CATALOG_SAMPLES = 20
# ---------------------------------------------------------------------------


# ---------------------------------------------------------------------- C7
def catalog_from_tables(spark: SparkSession, tables: Mapping[str, DataFrame],
                        schema: str = "main") -> DataFrame:
    """C7 — tables and columns with type, nullability, 1-based position, the
    table's rows and the column's filled (non-null) cells.  One aggregate per
    table, combined on the map side."""
    parts = []
    for t, df in tables.items():
        counts = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(F.col(f"`{f.name}`")).alias(f"_{i}") for i, f in enumerate(df.schema.fields)])
        cells = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                                   F.lit(bool(f.nullable)).alias("is_nullable"), F.lit(i + 1).alias("position"), F.col(f"_{i}").alias("filled_count"))
                          for i, f in enumerate(df.schema.fields)])
        parts.append(counts.select(F.lit(schema).alias("table_schema"), F.lit(t).alias("table_name"), "row_count", F.explode(cells).alias("c"))
                     .select("table_schema", "table_name", "c.column_name", "c.data_type", "c.is_nullable", "c.position", "row_count", "c.filled_count"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Rows of a table that are looked at before a column is searched for its first value.
PROBE_ROWS = 1000


def columns_with_values(spark: SparkSession, tables: Mapping[str, DataFrame], schema: str = "main") -> DataFrame:
    """C7 for mapping — the columns that hold any value, with type, nullability and position, without reading the tables.

    Names and types come from the schemas.  A column has a value if one of a table's first rows has one; only a
    column without any there is searched, and that search ends at its first value.  One small job per table when
    called; counts of rows and cells are left to :func:`catalog_from_tables` and B2."""
    found = []
    for t, df in tables.items():
        fields = df.schema.fields
        head = df.limit(PROBE_ROWS).agg(*[F.count(F.col(f"`{f.name}`")).alias(f"_{i}") for i, f in enumerate(fields)]).first()
        for i, f in enumerate(fields):
            if head[i] or df.select(F.col(f"`{f.name}`").alias("v")).where("v is not null").take(1):
                found.append((schema, t, f.name, f.dataType.simpleString(), bool(f.nullable), i + 1))
    return spark.createDataFrame(found, "table_schema string, table_name string, column_name string, data_type string, is_nullable boolean, position int")


def filled(catalog: DataFrame) -> DataFrame:
    """The columns that hold any value."""
    return catalog.where("filled_count > 0")


# ---------------------------------------------------------------------- C1
_RULE_TYPE = "array<struct<tier:int,rule_order:int,rule_key:string,canonical_field:string,confidence:double>>"


def _rules() -> Column:
    """Header rules as one constant array (a single JSON literal)."""
    import json
    rows = [(0, i, k, c, float(conf)) for i, (k, c, conf) in enumerate(EXACT_RULES)]
    rows += [(1, i, k, c, round(float(conf) - PARTIAL_PENALTY, 2)) for i, (k, c, conf) in enumerate(EXACT_RULES)]
    rows += [(2, i * 100 + j, kw, c, float(conf)) for i, (kws, c, conf) in enumerate(KEYWORD_RULES)
             for j, kw in enumerate(kws)]
    js = [dict(zip(("tier", "rule_order", "rule_key", "canonical_field", "confidence"), r)) for r in rows]
    return F.from_json(F.lit(json.dumps(js)), _RULE_TYPE)


def map_columns(catalog: DataFrame, column_col: str = "column_name",
                keys: Sequence[str] = ("table_name",)) -> DataFrame:
    """C1 — header -> canonical field with confidence: exact rule, else a
    rule key contained in the header or the header in a key (confidence -
    0.05), else a keyword (0.75-0.85), else unmapped and ambiguous.  The
    first rule in tier then rule order wins.  Row-local: each header scans
    the constant rule array; no join, no shuffle."""
    clean = F.lower(F.trim(F.col(column_col)))
    spaced = F.trim(F.regexp_replace(clean, "[-_]", " "))
    c = catalog.select(*keys, F.col(column_col).alias("original_column"), clean.alias("_clean"),
                       spaced.alias("_spaced"))
    hits = F.filter(_rules(), lambda r: ((r["tier"] == 0) & (F.col("_clean") == r["rule_key"]))
                    | ((r["tier"] == 1) & (F.col("_clean").contains(r["rule_key"])
                                           | r["rule_key"].contains(F.col("_clean"))))
                    | ((r["tier"] == 2) & F.col("_spaced").contains(r["rule_key"])))
    first = F.get(F.array_sort(hits, lambda a, b: F.when(a["tier"] != b["tier"], a["tier"] - b["tier"])
                               .otherwise(a["rule_order"] - b["rule_order"])), 0)
    w = c.withColumn("w", first)
    method = F.when(F.col("w.tier") == 0, "exact_rule").when(F.col("w.tier") == 1, "partial_rule") \
        .when(F.col("w.tier") == 2, "keyword").otherwise("unmapped")
    return w.select(*keys, "original_column", F.col("w.canonical_field").alias("canonical_field"),
                    F.coalesce(F.col("w.confidence"), F.lit(0.0)).alias("confidence"),
                    F.col("w.tier").isNull().alias("is_ambiguous"), method.alias("method"))


# ---------------------------------------------------------------------- C2
def resolve_canonical(mappings: DataFrame, keys: Sequence[str] = ("table_name",)) -> DataFrame:
    """C2 — per dataset and canonical field: the best-confidence column
    (ties: column name), how many columns competed, and a status."""
    m = mappings.filter(F.col("canonical_field").isNotNull())
    g = m.groupBy(*keys, "canonical_field").agg(
        F.min_by(F.struct("original_column", "confidence", "is_ambiguous"),
                 F.struct((-F.col("confidence")).alias("c"), F.col("original_column"))).alias("w"),
        F.count(F.lit(1)).alias("candidates"))
    status = F.when(F.col("w.is_ambiguous"), "ambiguous").otherwise("resolved")
    return g.select(*keys, "canonical_field", F.col("w.original_column").alias("original_column"),
                    F.col("w.confidence").alias("confidence"), "candidates", status.alias("status"))


# ---------------------------------------------------------------------- C5
def normalize_name(c: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(c)), "[_-]", " ")
    v = F.regexp_replace(v, "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(v, " +", " "))


def column_role(catalog: DataFrame, column_col: str = "column_name", type_col: str = "data_type") -> DataFrame:
    """C5 — date / status / technical_identifier / identifier / dimension /
    numeric / attribute from the column name and type."""
    n = normalize_name(F.col(column_col))
    t = F.lower(F.col(type_col))
    numeric = F.lit(False)
    for x in NUMERIC_TYPES:
        numeric = numeric | t.startswith(x)
    role = (F.when(n.contains("date") | n.contains("time"), "date")
            .when(n.contains("status") | n.isin(*STATUS_NAMES), "status")
            .when(n == "id", "technical_identifier")
            .when(n.endswith(" id") | n.endswith(" code"), "identifier")
            .when(n.isin(*DIMENSION_NAMES), "dimension")
            .when(numeric, "numeric").otherwise("attribute"))
    return catalog.select("*", n.alias("normalized_name"), role.alias("role"))


# ---------------------------------------------------------------------- C4
def build_catalog(staged: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """C4 — per column of a staged or cleaned JSON table: the kind of all its
    values (``int``, ``float`` when some have a fraction, ``bool``, else ``str``;
    ``unknown`` without any), the first 20 values in row order and the first 5
    for display.  Kinds are counted over every row; only the display samples
    are bounded, cut to 20 per column before the shuffle."""
    s = staged if dataset_id is None else staged.filter(F.col("dataset_id") == dataset_id)
    kv = s.select("dataset_id", "row_number",
                  F.explode(F.from_json("raw_data", "map<string,string>")).alias("column_name", "value"))
    v = F.col("value")
    whole, fraction = v.rlike(r"^-?\d+$"), v.rlike(r"^-?\d+\.\d+$")
    g = kv.groupBy("dataset_id", "column_name").agg(
        F.count("value").alias("_n"), F.count_if(whole).alias("_i"), F.count_if(whole | fraction).alias("_f"),
        F.count_if(v.isin("true", "false")).alias("_b"))
    kind = (F.when(F.col("_n") == 0, "unknown").when(F.col("_i") == F.col("_n"), "int")
            .when(F.col("_f") == F.col("_n"), "float").when(F.col("_b") == F.col("_n"), "bool").otherwise("str"))
    order = Window.partitionBy("dataset_id", "column_name").orderBy("row_number")
    shown = (kv.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= CATALOG_SAMPLES)
             .groupBy("dataset_id", "column_name").agg(F.array_sort(F.collect_list(F.struct("_r", "value"))).alias("_all")))  # 20 at most
    values = F.transform("_all", lambda x: x["value"])
    return (g.select("dataset_id", "column_name", kind.alias("data_type")).join(shown, ["dataset_id", "column_name"])
            .select("dataset_id", "column_name", "data_type", values.alias("samples"), F.slice(values, 1, 5).alias("sample_values")))


# ---------------------------------------------------------------------- C8
def key_values(tables: Mapping[str, DataFrame], keys: Sequence[str] = RELATIONSHIP_KEYS) -> DataFrame:
    """``(relationship_key, table_name, column_name, value, n)``: the values
    of every key-like column (by its trimmed lower-case name), with their
    rows; combined on the map side, so a hot value is one row per task."""
    parts = [df.select(F.lit(f.name.strip().lower()).alias("relationship_key"), F.lit(t).alias("table_name"), F.lit(f.name).alias("column_name"),
                       F.col(f"`{f.name}`").cast("string").alias("value"))
             for t, df in tables.items() for f in df.schema.fields if f.name.strip().lower() in keys]
    if not parts:
        raise ValueError(f"no table has a column named like one of {', '.join(keys)}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return (out.where("value is not null").groupBy("relationship_key", "table_name", "column_name", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def discover_relationships(tables: Mapping[str, DataFrame], keys: Sequence[str] = RELATIONSHIP_KEYS) -> DataFrame:
    """C8 + C9 — tables that share a key-like column, found and validated by
    its values in one plan.

    A key's tables are linked with its reference table, the one with the most
    distinct values (ties: the first name), so n tables give n - 1 links
    instead of all pairs.  Per link: distinct values of both sides, matches,
    unmatched counts, score and status as in :func:`validate_relationships`.
    """
    values = derived_once(key_values(tables, keys))
    side = ["relationship_key", "table_name", "column_name"]
    sizes = values.groupBy(*side).agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").cast("long").alias("row_count"))
    ref = sizes.groupBy("relationship_key").agg(F.min_by(  # one row per key name
        F.struct("table_name", "column_name", "distinct_values", "row_count"),
        F.struct((-F.col("distinct_values")).alias("d"), "table_name", "column_name")).alias("ref"))
    in_ref = (values.join(F.broadcast(ref), "relationship_key")
              .where((F.col("table_name") == F.col("ref.table_name")) & (F.col("column_name") == F.col("ref.column_name")))
              .select("relationship_key", "value"))
    matches = (values.select(*side, "value").join(in_ref, ["relationship_key", "value"], "left_semi")
               .groupBy(*side).agg(F.count(F.lit(1)).alias("matching_values")))
    links = (sizes.join(ref, "relationship_key")
             .where((F.col("table_name") != F.col("ref.table_name")) | (F.col("column_name") != F.col("ref.column_name")))
             .join(matches, side, "left").withColumn("matching_values", F.coalesce("matching_values", F.lit(0)).cast("long")))
    s4 = _score(F.col("matching_values"), F.least("distinct_values", "ref.distinct_values"))
    return links.select(
        "relationship_key", F.col("ref.table_name").alias("left_table"), F.col("ref.column_name").alias("left_column"),
        F.col("table_name").alias("right_table"), F.col("column_name").alias("right_column"),
        F.lit(RELATIONSHIP_CONFIDENCE).alias("confidence"), F.col("ref.row_count").alias("left_row_count"), F.col("row_count").alias("right_row_count"),
        F.col("ref.distinct_values").alias("left_distinct"), F.col("distinct_values").alias("right_distinct"), "matching_values",
        (F.col("ref.distinct_values") - F.col("matching_values")).alias("left_unmatched"),
        (F.col("distinct_values") - F.col("matching_values")).alias("right_unmatched"),
        (s4.cast("double") / 10000).alias("validation_score"), _status(s4).alias("status"))


def _score(matches: Column, small: Column) -> Column:
    """Matches by the smaller side in 1/10000, half away from zero, 10000 at most."""
    return F.when(small == 0, F.lit(0).cast("long")).otherwise(
        F.least(F.lit(10000).cast("long"), F.call_function("div", matches * 20000 + small, small * 2)))


def _status(s4: Column) -> Column:
    return F.when(s4 >= int(VERIFIED * 10000), "verified").when(s4 >= int(POSSIBLE * 10000), "possible").otherwise("rejected")


# ---------------------------------------------------------------------- C9
def validate_relationships(pairs: Sequence[tuple]) -> DataFrame:
    """C9 for many candidates in ONE job: ``pairs`` is a list of
    ``(pair_id, left_df, left_col, right_df, right_col)``.  All key values
    are unioned as ``(pair, side, value)`` and grouped once by
    ``(pair, value)`` (map-side combined, so a hot value is collapsed per
    partition), then once by pair."""
    parts = []
    for pid, left, lcol, right, rcol in pairs:
        parts.append(left.select(F.lit(pid).alias("pair"), F.col(lcol).cast("string").alias("v"),
                                 F.lit(1).alias("s")))
        parts.append(right.select(F.lit(pid).alias("pair"), F.col(rcol).cast("string").alias("v"),
                                  F.lit(2).alias("s")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    per_value = rows.groupBy("pair", "v").agg(F.count_if(F.col("s") == 1).alias("nl"),
                                              F.count_if(F.col("s") == 2).alias("nr"))
    t = per_value.groupBy("pair").agg(
        F.coalesce(F.sum("nl"), F.lit(0)).cast("long").alias("left_row_count"),
        F.coalesce(F.sum("nr"), F.lit(0)).cast("long").alias("right_row_count"),
        F.count_if(F.col("v").isNotNull() & (F.col("nl") > 0)).alias("left_distinct"),
        F.count_if(F.col("v").isNotNull() & (F.col("nr") > 0)).alias("right_distinct"),
        F.count_if(F.col("v").isNotNull() & (F.col("nl") > 0) & (F.col("nr") > 0)).alias("matching_values"))
    s4 = _score(F.col("matching_values"), F.least("left_distinct", "right_distinct"))
    return t.select("pair", "left_row_count", "right_row_count", "left_distinct", "right_distinct",
                    "matching_values",
                    (F.col("left_distinct") - F.col("matching_values")).alias("left_unmatched"),
                    (F.col("right_distinct") - F.col("matching_values")).alias("right_unmatched"),
                    (s4.cast("double") / 10000).alias("validation_score"), _status(s4).alias("status"))


def validate_relationship(left: DataFrame, left_col: str, right: DataFrame, right_col: str,
                          pair_id: str = "pair") -> DataFrame:
    """C9 — value overlap of one candidate join: distinct non-null values
    each side, matches, ``score = matches / min(distinct)`` (4 decimals):
    verified >= 0.80, possible >= 0.50, else rejected; unmatched counts."""
    return validate_relationships([(pair_id, left, left_col, right, right_col)])


def estimate_relationships(pairs: Sequence[tuple], lg_k: int = 12) -> DataFrame:
    """C9 by sketches, for very large keys: per pair the estimated distinct values of both sides, matches and score.

    Each key column becomes one theta sketch of ``2 ** lg_k`` entries (32 KB at 12), merged on the way: no value
    is shuffled, and a stored sketch serves every pair that its column takes part in.  Distinct counts have a standard error of
    ``2 ** (-lg_k / 2)`` (1.6 %); ``score_error`` is three standard errors of the score, from the union's size."""
    parts = []
    for pid, left, lcol, right, rcol in pairs:
        parts.append(left.select(F.lit(pid).alias("pair"), F.col(lcol).cast("string").alias("v"), F.lit(1).alias("s")))
        parts.append(right.select(F.lit(pid).alias("pair"), F.col(rcol).cast("string").alias("v"), F.lit(2).alias("s")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sides = rows.where("v is not null").groupBy("pair").agg(
        *[F.theta_sketch_agg(F.when(F.col("s") == i, F.col("v")), lg_k).alias(n) for i, n in ((1, "_l"), (2, "_r"))])
    est = sides.select("pair", F.theta_sketch_estimate("_l").alias("left_distinct"), F.theta_sketch_estimate("_r").alias("right_distinct"),
                       F.theta_sketch_estimate(F.theta_intersection("_l", "_r")).alias("matching_values"),
                       F.theta_sketch_estimate(F.theta_union("_l", "_r", lg_k)).alias("_union"))
    small = F.greatest(F.least("left_distinct", "right_distinct"), F.lit(1)).cast("double")
    noise = 3 * F.sqrt(F.col("_union") * F.greatest("matching_values", F.lit(1)) / F.lit(float(2 ** lg_k)))
    return est.select("pair", "left_distinct", "right_distinct", "matching_values", F.least(F.lit(1.0), F.col("matching_values") / small).alias("score"),
                      F.when(F.col("_union") < 2 ** lg_k, F.lit(0.0)).otherwise(noise / small).alias("score_error"))


def screen_relationships(pairs: Sequence[tuple], lg_k: int = 12, least: float = POSSIBLE) -> DataFrame:
    """C9 in two steps: pairs whose estimated score can't reach ``least`` are left out, the others are matched exactly.

    Only the pairs' names and estimates are collected, one row per pair."""
    found = estimate_relationships(pairs, lg_k)
    alive = {r["pair"] for r in found.where(F.col("score") + F.col("score_error") >= least).select("pair").collect()}
    chosen = [p for p in pairs if p[0] in alive]
    return validate_relationships(chosen) if chosen else validate_relationships(pairs[:1]).where("false")
