from pyspark.sql import functions as F

from conftest import metrics_df, rows
from funnelyard.operators import compare as C
from funnelyard.operators import entities as H


def _m(spark):
    return metrics_df(spark, [
        dict(dataset_id="d", program_name="B.E. CSE : CS201", campus_name="Main Campus", state="Kerala",
             source="Direct", cy_admission=5),
        dict(dataset_id="d", program_name="B.E. CSE : CS202", campus_name="North Campus", state="KERALA",
             source="Partner", cy_admission=3),
        dict(dataset_id="d", program_name="MBA", campus_name="main campus", state="Goa", source="Web",
             cy_admission=2)])


def _names(spark, vals):
    return spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "name string, position int")


def test_resolution_tiers(spark):
    mem = H.distinct_members(_m(spark), "d")
    r = {x["name"]: x for x in rows(H.resolve_members(
        _names(spark, ["Goa", "mba", "maincampus", "cs201", "B.E CSE", "Kerala", "keral", "zzz"]), mem))}
    assert (r["Goa"]["tier"], r["Goa"]["value"]) == (1, "Goa")
    assert (r["mba"]["tier"], r["mba"]["value"]) == (2, "MBA")
    assert r["maincampus"]["ambiguous"] and r["maincampus"]["tier"] == 3
    assert r["cs201"]["resolved"] and r["cs201"]["value"] == "B.E. CSE : CS201"
    assert r["B.E CSE"]["ambiguous"] and r["B.E CSE"]["candidate_count"] == 2
    cands = rows(H.resolve_members(_names(spark, ["B.E CSE"]), mem, candidates=True))
    assert sorted(c["member"] for c in cands) == ["B.E. CSE : CS201", "B.E. CSE : CS202"]
    assert (r["Kerala"]["tier"], r["Kerala"]["value"]) == (1, "Kerala")
    assert r["keral"]["tier"] in (4, 6)
    assert r["zzz"]["tier"] is None and not r["zzz"]["resolved"]


def test_similarity_tier_only_for_unresolved(spark):
    mem = H.distinct_members(_m(spark), "d")
    r = {x["name"]: x for x in rows(H.resolve_members(_names(spark, ["Kerla", "Goa"]), mem))}
    assert r["Kerla"]["tier"] == 7 and r["Kerla"]["ambiguous"]  # Kerala and KERALA tie
    assert r["Goa"]["tier"] == 1


def test_match_member_and_choose_dimension(spark):
    mem = H.distinct_members(_m(spark), "d")
    names = _names(spark, ["kerala", "goa"])
    m = {(x["name"], x["dimension"]): (x["member"], x["tier"]) for x in rows(H.match_member(names, mem))}
    # exact -> upper-cased -> case-insensitive: the upper-cased probe hits KERALA first
    assert m[("kerala", "state")] == ("KERALA", 2) and m[("goa", "state")] == ("Goa", 3)
    assert rows(H.choose_dimension(H.match_member(names, mem), names))[0]["dimension"] == "state"


def test_compare_members_shared_then_cross(spark):
    m = _m(spark)
    r = rows(C.compare_members(m, "d", _names(spark, ["direct", "WEB"]), "admission"))
    assert {(x["dimension"], x["member"], x["metric_value"]) for x in r} == {("source", "Direct", 5), ("source", "Web", 2)}
    r2 = rows(C.compare_members(m, "d", _names(spark, ["Goa", "Direct"]), "admission"))
    assert {x["dimension"] for x in r2} == {"state", "source"}


def test_alias():
    assert H.dimension_alias(" Counsellor ") == "owner" and H.dimension_alias("xyz") is None


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_query_matches_brute_force_on_small_fixture(spark):
    """The registered similarity query against plain Python over the sf0.001 members."""
    import re

    import __spark_entry__ as E
    from conftest import SF001
    from funnelyard.plans.q_entities import _FUZZY_NAMES
    from funnelyard.sources import bindings as B
    got = {r["name"]: r for r in rows(E.queries()["resolve_members_fuzzy"](spark, SF001))}
    mem = [(r["dimension"], r["member"]) for r in rows(H.distinct_members(B.metrics(spark, SF001), "ds2026"))]

    def norm(x):
        return re.sub(r"[^a-z0-9]", "", x.lower())
    tiers = set()
    for name in _FUZZY_NAMES:
        u = norm(name)
        best = {}
        for d, m in mem:
            v = norm(m)
            near = min(len(u), len(v)) >= 4 and 3 * _edits(u, v) <= max(len(u), len(v))
            tier = (1 if m == name else 2 if m.lower() == name.lower() else 3 if v == u else 4 if u in v
                    else 5 if name.lower() in [t.lower() for t in re.split(r"[^a-zA-Z0-9]", m) if t]
                    else 6 if name.lower() in m.lower() else 7 if near else None)
            if tier:
                best.setdefault((tier, _edits(u, v) * 10**6 // max(len(u), len(v)) if tier == 7 else 0), set()).add((d, m))
        tiers.add(got[name]["tier"])
        if not best:
            assert got[name]["tier"] is None
            continue
        first = min(best)
        assert got[name]["tier"] == first[0]
        assert got[name]["candidate_count"] == len(best[first])
        if len(best[first]) == 1:
            assert (got[name]["dimension"], got[name]["value"]) == next(iter(best[first]))
    assert 7 in tiers and None in tiers


def _edit(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_a_common_stem_brings_few_candidates(spark):
    members = [f"Counselor {i:04d}" for i in range(1000)]
    mem = spark.createDataFrame([("owner", m) for m in members], "dimension string, member string")
    asked = ["Counsellor 0042", "Counselor 99x7", "Counselor 0123", "unselor 0777", "conselor 0500x"]
    got = {r["name"]: r for r in rows(H.resolve_members(_names(spark, asked), mem))}

    def norm(x):
        return "".join(c for c in x.lower() if c.isalnum())
    for name in asked[:2] + asked[4:]:
        shares = {m: _edit(norm(name), norm(m)) * 1_000_000 // max(len(norm(name)), len(norm(m))) for m in members}
        best = min(shares.values())
        hits = [m for m in members if shares[m] == best]
        assert (got[name]["tier"], got[name]["candidate_count"]) == (7, len(hits)) and (len(hits) > 1 or got[name]["value"] == hits[0])
    assert got["Counselor 0123"]["tier"] == 1 and got["unselor 0777"]["value"] == "Counselor 0777"
    rest = spark.createDataFrame([("Counsellor 0042", norm("Counsellor 0042"))], "name string, norm string")
    m = mem.select("dimension", "member", H.alnum("member").alias("mnorm"))
    index = (m.select("*", F.length("mnorm").alias("mlen"), F.explode(F.array(F.lit(2), F.lit(3))).alias("q"))
             .select("*", F.explode(H._grams(F.col("mnorm"), F.col("q"))).alias("gram")))
    counts = index.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("members"))
    assert 1 <= H.similar_candidates(rest, index, counts, 1).count() <= 30


def test_similar_members_equal_brute_force(spark):
    import random
    rng = random.Random(9)
    members = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 12))) for _ in range(150)})
    asked = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 14))) for _ in range(120)})
    mem = spark.createDataFrame([("owner", m) for m in members], "dimension string, member string")
    got = {r["name"]: r for r in rows(H.resolve_members(_names(spark, asked), mem))}
    for name in asked:
        if any(name in m for m in members):
            assert got[name]["tier"] < 7
            continue
        shares = {m: d * 1_000_000 // max(len(m), len(name)) for m in members if min(len(m), len(name)) >= 4 and (d := _edit(m, name)) * 3 <= max(len(m), len(name))}
        best = [m for m, s in shares.items() if s == min(shares.values())]
        assert got[name]["candidate_count"] == len(best), name
        assert len(best) != 1 or got[name]["value"] == best[0]
