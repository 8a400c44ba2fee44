"""The corpus pipeline against the plain versions of its stages."""

import corpus_pipeline as C
import pytest
from brute import benchmark_words, contamination, drop_lines, near_components, words
from test_packing import check

from funnelyard.llm import quality
from funnelyard.llm.common import stage

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, work in C.STAGES:
        after = stage(work(spark, docs, SF), "test")
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_names_and_columns(spark, stages):
    assert [n for n, _ in C.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for name, (before, after) in stages.items():
        assert name == "best-fit packing" or after.dtypes == before.dtypes


def test_quality_keeps_the_rows_of_its_verdict_unchanged(spark, stages):
    before, after = stages["quality rules"]
    kept = {r.doc_id for r in quality.assess(before).where("kept").collect()}
    assert texts(after) == [t for t in texts(before) if t[0] in kept] and len(kept) < before.count()


def test_line_stage(spark, stages):
    before, after = stages["line dedup"]
    rows = before.select("doc_id", "source", "text").collect()
    expected = {i: "\n".join(x) for i, x in drop_lines([(r.doc_id, r.source, r.text.split("\n")) for r in rows])}
    got = after.collect()
    assert {r.doc_id: r.text for r in got} == expected and all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)
    assert any(expected[r.doc_id] != r.text for r in rows)


def test_near_copies_stage(spark, stages):
    before, after = stages["MinHash near-dedup"]
    rows = texts(before)
    chosen = {r[0] for r in near_components(rows, percent=C.PERCENT) if r[3]}
    assert texts(after) == [t for t in rows if t[0] in chosen or not words(t[1])] and after.count() < before.count()


def test_benchmark_stage(spark, stages):
    before, after = stages["benchmark decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {r[0] for r in contamination(texts(before), items) if r[2]}
    assert leaked and texts(after) == [t for t in texts(before) if t[0] not in leaked]
    assert all(len(benchmark_words(t)) >= 10 for d, t in texts(before) if d in leaked)


def test_packing_stage_and_run(spark, stages):
    before, after = stages["best-fit packing"]
    check(after.collect(), texts(before), 2048)
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, C.run(spark, SF).select(same).collect())) == sorted(map(tuple, after.select(same).collect()))


def test_odd_rows_go_through_every_stage(spark):
    rows = [(1, None, None, None, None), (None, "a b c d e f g h i j k l", "en", None, 3), (2, "", "en", "s", 0), (3, "x " * 9, "en", "s", 1),
            (4, " ".join(f"w{i}" for i in range(40)), None, "s", 7), (4, " ".join(f"w{i}" for i in range(40)), None, "s", 7),
            (5, " ".join(f"v{i}" for i in range(30_000)), "en", "s", 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, work in C.STAGES[1:]:
        assert work(spark, docs, SF).count() >= 5 or name == "MinHash near-dedup"
        assert work(spark, docs.limit(0), SF).count() == 0
    assert sorted(r.doc_id or 0 for r in C.near_copies(spark, docs, SF).collect()) == [0, 1, 2, 3, 4, 5]
    # 1 to 3 fail the base rules; the words of 5 are twice as long as those of the three others, which are its pool
    assert sorted(r.doc_id or 0 for r in C.quality_rules(spark, docs, SF).collect()) == [0, 4, 4]
    assert {r.doc_id: r.text for r in C.site_lines(spark, docs, SF).collect()}[1] is None
    assert C.quality_rules(spark, docs.limit(0), SF).count() == 0


def test_a_group_of_copies_keeps_one_full_text(spark):
    def text(k, n=120):
        return "\n".join(" ".join(f"w{k}x{i}x{j}" for j in range(10)) for i in range(n // 10))
    copy, near = text("copy"), text("near", 600)
    rows = [(i, copy) for i in range(10)] + [(10 + i, near.replace(f"wnearx{i}x4", f"e{i}")) for i in range(10)]
    rows += [(20 + i, "the site's own line\n" + text(i)) for i in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    clean = stage(C.site_lines(spark, docs, SF), "test")
    kept = {r.doc_id: r.text for r in C.near_copies(spark, clean, SF).collect()}
    expected = {0: copy, 10: dict(rows)[10]} | {20 + i: text(i) for i in range(10)}
    assert kept == expected


def test_columns_named_like_the_stages_own_stay_as_they_are(spark):
    lines = "the site's line\n" + "\n".join(" ".join(f"w{k}" for k in range(j, j + 30)) for j in range(3))
    names = ["t1", "t2", "k1", "k2", "n_lines", "kept_lines", "n_dropped", "row", "rep", "copies", "lines", "__lines", "__k1", "__rep", "component_id", "kept"]
    rows = [(i, f"{lines} u{i} v{i} " + " ".join(f"x{i}y{j}" for j in range(40)), "en", "s", 7, *[7777 + k for k in range(len(names))]) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} long" for n in names))
    for name, work in C.STAGES[:-1]:
        after = work(spark, docs, SF)
        assert after.dtypes == docs.dtypes, name
        assert all([r[n] for n in names] == [7777 + k for k in range(len(names))] for r in after.collect()), name
    assert C.pack_sequences(spark, docs, SF).count() >= 12


def test_near_copies_at_80_percent(spark):
    base = [f"w{i}" for i in range(300)]
    near = list(base)
    for i in (20, 80, 140, 200, 260):  # 25 of 296 shingles differ: similarity 0.844; two more edits: 0.79
        near[i] = f"e{i}"
    far = [f"f{i}" if i % 40 == 7 else w for i, w in enumerate(base)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate((base, near, far))], SCHEMA)
    assert sorted(r.doc_id for r in C.near_copies(spark, docs, SF).collect()) == [0, 2]
