"""Site-relative line frequency against brute force."""

import random

from brute import drop_lines
from pyspark.sql import functions as F

from funnelyard.llm import line_dedup as L
from funnelyard.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "id long, host string, lines array<string>"


def result(df, **settings):
    return sorted(((r.id, r.kept_lines) for r in L.drop_boilerplate(df, "host", "lines", ["id"], **settings).collect()), key=repr)


def test_query_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", L.url_host(F.col("url")), L.html_lines(F.col("html"))).collect()
    expected = {i: "\n".join(x) for i, x in drop_lines([tuple(p) for p in pages])}
    rows = QUERIES["op2_site_line_dedup"](spark, SF).collect()
    assert {r.page_id: r.text for r in rows} == expected and len(rows) == len(pages)
    assert sum(r.n_dropped for r in rows) == sum(len(p[2]) for p in pages) - sum(len(t.split("\n")) if t else 0 for t in expected.values()) > 0


def test_random_pages(spark):
    rng = random.Random(1)
    pages = [(i, rng.choice(["a", "b", "c", None]), [rng.choice(["x", " x ", "y", "", "  ", f"u{i}", f"v{i % 7}"]) for _ in range(rng.randint(0, 6))])
             for i in range(80)]
    pages += [(200 + i, "small", ["x"]) for i in range(9)]
    assert result(spark.createDataFrame(pages, SCHEMA)) == sorted(drop_lines(pages), key=repr)


def test_a_line_at_the_ratio_stays(spark):
    pages = [(i, "h", ["two"] if i < 2 else ["three"] if i < 5 else [f"u{i}"]) for i in range(20)]
    got = dict(result(spark.createDataFrame(pages, SCHEMA), max_ratio=0.1))
    assert got[0] == ["two"] and got[2] == []


def test_nulls_repeated_rows_and_clashing_columns(spark):
    pages = [(1, None, ["x", "x", "own"])] * 3 + [(None, None, ["x"])] * 9 + [(2, "h", None), (3, "h", []), (4, None, ["X"])]
    df = spark.createDataFrame(pages, SCHEMA).withColumns({"kept_lines": F.lit(1), "N_Lines": F.lit(2), "extra": F.lit(3)})
    out = L.drop_boilerplate(df, "host", "lines", ["id"], max_ratio=0.5)
    assert out.columns == ["id", "host", "lines", "extra", "kept_lines", "n_lines", "n_dropped"]
    rows = sorted(((r.id, r.kept_lines, r.n_lines, r.n_dropped) for r in out.collect()), key=repr)
    assert rows == sorted([(1, ["own"], 3, 2)] * 3 + [(None, [], 1, 1)] * 9 + [(2, [], 0, 0), (3, [], 0, 0), (4, ["X"], 1, 0)], key=repr)


def test_empty_table_and_a_long_page(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    pages = [(i, "h", ["menu"] + [f"l{i}-{k}" for k in range(5000 if i == 0 else 1)]) for i in range(12)]
    assert result(spark.createDataFrame(pages, SCHEMA)) == sorted(drop_lines(pages), key=repr)


def test_html_lines_and_hosts(spark):
    page = "<html><head><title>T &amp; t</title><style>p{}</style></head><BODY><p class=\"a\">one <b>two</b><br>three&nbsp;</p><!-- <p>no</p> --><script>x='<p>'</script><li>a&lt;b</li></body>"
    df = spark.createDataFrame([(page, "HTTP://u:p@Www.Ex.com:80/p?q"), (None, None), ("", "nonsense"), ("plain", "http://[x")], "html string, url string")
    rows = df.select(L.html_lines(F.col("html")).alias("l"), L.url_host(F.col("url")).alias("h")).collect()
    assert rows[0].l == ["T & t", "one two", "three", "a<b"] and rows[0].h == "www.ex.com"
    assert rows[1].l is None and rows[1].h is None and rows[2].l == [] and rows[2].h == "" and rows[3].l == ["plain"]
