"""Entity resolution of free-typed names against dimension members (H1-H5).

Requested names are a DataFrame ``(name, position)`` of any size; members
are the distinct values of the metrics table's dimensions, computed on the
executors.

Every tier is an equi-join on keys: the forms and tokens of a member, and for
"stands inside" and "similar" its grams.  A name looks under its rarest grams
only, as many as the tier needs to miss nothing, and what they find is checked
in full.  Similarity starts with small distances and is asked only for names
that no other tier finds (a few jobs, run when the operator is called).
Members are derived once, and neither side is broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelyard.functions.core import derived_once, strip_ws

# --- fixed values -----------------------------------------------------------
RESOLVE_DIMENSIONS = ("program_name", "campus_name", "state", "owner", "source", "main_source")
# Similar: alphanumeric forms of this length or more, at an edit distance of at most a third of the longer one.
SIMILAR_FROM, SIMILAR_SHARE = 4, 3
DIMENSION_ALIASES = {
    "main_source": "main_source", "source": "source", "sub_source": "sub_source",
    "channel": "source", "category": "main_source", "lead_type": "lead_type",
    "program_name": "program_name", "program": "program_name", "course": "program_name",
    "courses": "program_name", "campus_name": "campus_name", "campus": "campus_name",
    "state": "state", "owner": "owner", "counselor": "owner", "counsellor": "owner",
    "cluster": "cluster",
}
# ---------------------------------------------------------------------------


def alnum(c: str | Column) -> Column:
    """Lower-case and keep only ``[a-z0-9]``."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z0-9]", "")


# ---------------------------------------------------------------------- H4
def dimension_alias(word: str) -> str | None:
    """H4 — user word -> canonical column (None when unknown)."""
    return DIMENSION_ALIASES.get(word.lower().strip())


def alias_column(words: str | Column) -> Column:
    """H4 as an expression over a column of words (a literal map lookup)."""
    m = F.create_map(*[F.lit(x) for kv in DIMENSION_ALIASES.items() for x in kv])
    w = F.col(words) if isinstance(words, str) else words
    return m[F.lower(F.trim(w))]


# ---------------------------------------------------------------------- members
def distinct_members(metrics: DataFrame, dataset_id: str,
                     dims: Sequence[str] = RESOLVE_DIMENSIONS) -> DataFrame:
    """(dimension, member) pairs of one dataset, non-blank, one scan."""
    d = metrics.filter(F.col("dataset_id") == dataset_id)
    return (d.unpivot(ids=[], values=list(dims), variableColumnName="dimension",
                      valueColumnName="member")
            .filter(F.col("member").isNotNull() & (F.col("member") != "")).distinct())


# ---------------------------------------------------------------------- H1
def match_member(names: DataFrame, members: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """H1 — per (name, dimension): exact match, else upper-cased, else
    case-insensitive; all three imply equal lower-case keys, so this is one
    equi-join.  ``members`` needs ``dimension, member`` (plus any ``carry``
    columns, returned with the chosen member)."""
    n = names.select("name", "position", F.trim("name").alias("_clean"),
                     F.lower(F.trim("name")).alias("_k"))
    m = members.select("dimension", "member", *carry, F.lower("member").alias("_k"))
    j = n.join(m, "_k")
    tier = (F.when(F.col("member") == F.col("_clean"), 1)
            .when(F.col("member") == F.upper("_clean"), 2).otherwise(3))
    return (j.withColumn("tier", tier)
            .groupBy("name", "position", "dimension")
            .agg(F.min(F.struct("tier", "member", *carry)).alias("w"))
            .select("name", "position", "dimension", F.col("w.member").alias("member"),
                    F.col("w.tier").alias("tier"), *[F.col(f"w.{c}").alias(c) for c in carry]))


# ---------------------------------------------------------------------- H3
def choose_dimension(matched: DataFrame, names: DataFrame,
                     order: Sequence[str] = RESOLVE_DIMENSIONS) -> DataFrame:
    """H3 — the first dimension (in ``order``) in which all names match."""
    pref = F.create_map(*[x for i, d in enumerate(order) for x in (F.lit(d), F.lit(i))])
    n = names.select("name").distinct().agg(F.count(F.lit(1)).alias("_n"))
    return (matched.groupBy("dimension").agg(F.countDistinct("name").alias("_k"))
            .crossJoin(F.broadcast(n)).filter(F.col("_k") == F.col("_n"))
            .select("dimension", pref[F.col("dimension")].alias("_p"))
            .filter(F.col("_p").isNotNull())
            .agg(F.min_by("dimension", "_p").alias("dimension")))


# ---------------------------------------------------------------------- H2
def _grams(text: Column, size: int | Column) -> Column:
    """Distinct substrings of one size; none of a shorter text."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def _equal_hits(n: DataFrame, m: DataFrame) -> DataFrame:
    """Tiers 1-3 and 5: equal as is, lower-cased, alphanumeric; a token of the member equals the lower-cased name."""
    def key(kind: int, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("tier"), value.alias("key"))

    tokens = F.transform(F.filter(F.split("member", "[^a-zA-Z0-9]"), lambda t: t != ""), lambda t: F.lower(t))
    of_member = F.concat(F.array(key(1, F.col("member")), key(2, F.col("mlow")), key(3, F.col("mnorm"))),
                         F.transform(F.array_distinct(tokens), lambda t: key(5, t)))
    of_name = F.array(key(1, F.col("clean")), key(2, F.col("low")), key(3, F.col("norm")), key(5, F.col("low")))
    found = (m.select("dimension", "member", "mnorm", F.explode(of_member).alias("k")).select("dimension", "member", "mnorm", "k.*")
             .join(n.select("name", "norm", F.explode(of_name).alias("k")).select("name", "norm", "k.*"), ["tier", "key"]))
    return found.where((F.col("tier") != 3) | (F.col("norm") != "")).select("name", "norm", "dimension", "member", "mnorm", "tier")


def _inside_hits(n: DataFrame, m: DataFrame, tier: int, name_form: str, member_form: str) -> DataFrame:
    """Tiers 4 and 6: the name's form stands inside the member's.

    A name looks under the rarest of its grams of three letters (of all its letters, if there are fewer); a gram that
    no member has rules it out.  So a stem that all members share brings no pairs, as long as the name holds more."""
    text = F.col(name_form)
    wanted = n.where(text != "").select("name", "norm", text.alias("text"), F.explode(_grams(text, F.least(F.lit(3), F.length(text)))).alias("gram"))
    form = F.col(member_form)
    held = m.select("dimension", "member", "mnorm", form.alias("form"), F.explode(F.array_union(F.array_union(_grams(form, 3), _grams(form, 2)), _grams(form, 1))).alias("gram"))
    held = held.join(wanted.select("gram").distinct(), "gram", "left_semi")
    seen = held.groupBy("gram").agg(F.count(F.lit(1)).alias("members"))
    best = (wanted.join(seen, "gram", "left").groupBy("name", "norm", "text")
            .agg(F.count_if(F.col("members").isNull()).alias("absent"), F.min_by("gram", F.struct("members", "gram")).alias("gram")).where("absent = 0"))
    return (best.join(held, "gram").where(F.col("form").contains(F.col("text")))
            .select("name", "norm", "dimension", "member", "mnorm", F.lit(tier).alias("tier")))


def similar_candidates(rest: DataFrame, index: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """Pairs (name, norm, dimension, member, mnorm) that may lie within ``most`` edits: prefix filter on grams.

    An edit touches at most q grams of a text, so of any q * most + 1 grams one stands in every text within that
    distance: the rarest are looked up, together with each length that the distance allows."""
    long = F.length("norm")
    q = F.when(3 * most + 1 <= long - 2, F.lit(3)).otherwise(F.lit(2))
    grams = rest.select("name", "norm", q.alias("q"), F.explode(_grams(F.col("norm"), q)).alias("gram")).join(counts, ["q", "gram"], "left")
    rarest = Window.partitionBy("name", "norm").orderBy(F.coalesce("members", F.lit(0)), "gram")  # the grams of one name
    first = grams.withColumn("nth", F.row_number().over(rarest)).where((F.col("nth") <= F.col("q") * most + 1) & F.col("members").isNotNull())
    keys = first.select("name", "norm", "q", "gram", F.explode(F.sequence(F.greatest(F.lit(SIMILAR_FROM), long - most), F.greatest(F.lit(SIMILAR_FROM), long + most))).alias("mlen"))
    return keys.join(index, ["q", "gram", "mlen"]).select("name", "norm", "dimension", "member", "mnorm").distinct()


def _similar_hits(n: DataFrame, m: DataFrame) -> DataFrame:
    """Tier 7: the members at the least edit distance by the longer form, up to a third of it.

    Small distances come first (1, 2, 4, ...): a name whose best member can't be matched by any larger distance is
    done, so only names without a near member look under many grams."""
    index = derived_once(m.where(F.length("mnorm") >= SIMILAR_FROM).select(
        "dimension", "member", "mnorm", F.length("mnorm").alias("mlen"), F.explode(F.array(F.lit(2), F.lit(3))).alias("q"))
        .select("*", F.explode(_grams(F.col("mnorm"), F.col("q"))).alias("gram")))
    counts = index.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("members"))
    rest = derived_once(n.where(F.length("norm") >= SIMILAR_FROM).select("name", "norm"))
    out, most = None, 1
    while True:
        longest = rest.agg(F.max(F.length("norm"))).first()[0]
        if longest is None:
            break
        pairs = similar_candidates(rest, index, counts, most)
        distance, longer = F.levenshtein("mnorm", "norm", most), F.greatest(F.length("mnorm"), F.length("norm"))
        near = pairs.withColumn("distance", distance).where((F.col("distance") >= 0) & (F.col("distance") * SIMILAR_SHARE <= longer))
        near = derived_once(near.withColumn("share", F.floor(F.col("distance") * 1_000_000 / longer).cast("long")).drop("distance"))
        out = near if out is None else out.unionByName(near)
        if 2 * most >= longest:
            break
        best = near.groupBy("name").agg(F.min("share").alias("best"))
        beyond = F.floor((most + 1) * 1_000_000 / (F.length("norm") + most + 1))  # no larger distance has a smaller share
        rest = derived_once(rest.join(best, "name", "left").where((F.col("best").isNull() | (F.col("best") >= beyond)) & (F.length("norm") > 2 * most))
                            .select("name", "norm"))
        most *= 2
    empty = n.where("false").select("name", "norm").join(m.select("dimension", "member", "mnorm"), F.lit(False)).withColumn("share", F.lit(0).cast("long"))
    return (empty if out is None else out).withColumn("tier", F.lit(7))


def _tier_hits(names: DataFrame, members: DataFrame, fuzzy: bool) -> DataFrame:
    """One row per (name, dimension, member) that a tier finds: its first tier, the share of edits where that is 7,
    and whether the member starts with the name (tiers 4-6).  Similarity is asked only for names without another hit."""
    n = (names.select("name", strip_ws("name").alias("clean")).filter(F.col("clean") != "").distinct()
         .select("name", "clean", F.lower("clean").alias("low"), alnum("clean").alias("norm")))
    m = members.select("dimension", "member", F.lower("member").alias("mlow"), alnum("member").alias("mnorm"))
    n, m = derived_once(n), derived_once(m)  # every tier reads them
    hits = (_equal_hits(n, m).unionByName(_inside_hits(n, m, 4, "norm", "mnorm")).unionByName(_inside_hits(n, m, 6, "low", "mlow"))
            .withColumn("share", F.lit(0).cast("long")))
    if fuzzy:
        hits = derived_once(hits)
        hits = hits.unionByName(_similar_hits(n.join(hits.select("name").distinct(), "name", "left_anti"), m))
    prefix = F.col("tier").isin(4, 5, 6) & F.col("mnorm").startswith(F.col("norm"))
    return (hits.groupBy("name", "dimension", "member")
            .agg(F.min(F.struct("tier", "share")).alias("t"), F.min_by(prefix, F.col("tier")).alias("prefix"))
            .select("name", "dimension", "member", "t.tier", "t.share", "prefix"))


def resolve_members(names: DataFrame, members: DataFrame, fuzzy: bool = True,
                    candidates: bool = False) -> DataFrame:
    """H2 — resolve each requested name across the six dimensions.

    Tiers: exact, case-insensitive, equal alphanumeric form, that form inside
    the member's, a token of the member, the lower-cased name inside the member,
    and (``fuzzy``) the least edit distance of the alphanumeric forms up to a
    third of the longer one.  The first tier with a hit decides: one distinct
    candidate resolves, several are ambiguous (tier 4 prefers a unique prefix
    match).  Only counts and ``min`` winners are aggregated, never a list.

    Output per name: ``tier`` (1-7, null when nothing matched), ``resolved``,
    ``dimension``, ``value``, ``ambiguous`` and ``candidate_count``.  With
    ``candidates=True`` the deciding tier's candidates are returned instead,
    one row per (name, dimension, member).
    """
    hits = _tier_hits(names, members, fuzzy)
    if candidates:
        hits = derived_once(hits)
        first = hits.groupBy("name").agg(F.min(F.struct("tier", "share")).alias("f")).select("name", "f.*")
        return hits.join(first, ["name", "tier", "share"]).select("name", "tier", "dimension", "member")
    pair = F.struct("dimension", "member")
    tiers = hits.groupBy("name", "tier", "share").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.count_if(F.col("prefix")).alias("_np"), F.min(pair).alias("_one"),
        F.min(F.when(F.col("prefix"), pair)).alias("_pre"))
    first = tiers.groupBy("name").agg(F.min_by(
        F.struct("tier", "candidate_count", "_np", "_one", "_pre"), F.struct("tier", "share")).alias("f")).select("name", "f.*")
    pick = (F.when(F.col("candidate_count") == 1, F.col("_one"))
            .when((F.col("tier") == 4) & (F.col("_np") == 1), F.col("_pre")))
    found = F.col("tier").isNotNull()
    return names.select("name").join(first, "name", "left").select(
        "name", "tier", (found & pick.isNotNull()).alias("resolved"), pick.getField("dimension").alias("dimension"),
        pick.getField("member").alias("value"), (found & pick.isNull()).alias("ambiguous"),
        F.coalesce("candidate_count", F.lit(0)).cast("long").alias("candidate_count"))


# ---------------------------------------------------------------------- H5
def result_members(result: DataFrame, dim: str, rank_col: str = "rank") -> DataFrame:
    """H5 — distinct members of an earlier result in result order."""
    return (result.filter(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("member"))
            .agg(F.min(rank_col).alias("rank")).orderBy("rank", "member"))
