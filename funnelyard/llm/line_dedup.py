"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a host if it stands on more than `max_ratio` of the host's pages; those lines
are dropped from the host's pages. Hosts with fewer than `min_pages` pages are left alone: on one page
every line has the ratio 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelyard.llm.common import drop_clashing, key128

#: Parts that a page's lines are dealt over when the boilerplate of a host is looked up.
SALTS = 16
_MILLION = 1_000_000

#: Markup that holds no text, tags that end a line, entities in the order they are resolved.
NO_TEXT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
LINE_TAGS = (r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|footer|form|h[1-6]|head|header|hr|html|li|main|nav"
             r"|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>")
ANY_TAG = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_lines(html: Column) -> Column:
    """The trimmed, non-empty text lines of a page, in order; null stays null."""
    text = F.regexp_replace(html, NO_TEXT, "\n")
    text = F.regexp_replace(text, LINE_TAGS, "\n")
    text = F.regexp_replace(text, ANY_TAG, "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(text, "[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty where there is none, null for null."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def drop_boilerplate(df: DataFrame, host_col: str, lines_col: str, key_cols: list[str],
                     max_ratio: float = 0.1, min_pages: int = 10, classes: DataFrame | None = None) -> DataFrame:
    """Adds `kept_lines` (array), `n_lines` and `n_dropped` to pages with an array of lines.

    Lines are compared without outer spaces; blank lines are neither counted nor dropped. A page counts
    once for a line however often it holds it, and loses every copy of it. `key_cols` tell the pages
    apart (with host and lines); repeated rows count as pages and get equal results. Null hosts are one
    host, null lines are no lines, an empty table stays empty; input columns named like the new ones
    are replaced. With `classes` (t1, t2, class), pages of a host whose columns t1 and t2 lead to an equal class count
    as one page, which holds the lines of all of them; a pair that isn't listed is a class of its own. The classes
    meet digests of lines only, equal pages combined first, never the pages themselves.

    Counting combines on the map side, so a line on a third of all pages costs no more than others. Only
    digests travel, in the lookup salted over SALTS parts, and each page gets its own dropped lines back.
    """
    share = round(max_ratio * _MILLION)  # compared as whole numbers: a line at the ratio stays
    df = drop_clashing(df, ["kept_lines", "n_lines", "n_dropped"])
    host = F.col(f"`{host_col}`")
    own = F.coalesce(F.col(f"`{lines_col}`"), F.expr("cast(array() as array<string>)"))
    k1, k2 = key128(*[F.col(f"`{c}`") for c in key_cols], host, own)
    pages = df.withColumns({"__k1": k1, "__k2": k2})

    shown = F.array_distinct(F.filter(F.transform(own, lambda x: F.trim(x)), lambda x: x != ""))
    by = ["t1", "t2"] if classes is not None else []
    line = pages.select("__k1", "__k2", host.alias("__host"), *by, F.explode(shown).alias("__line"))
    h1, h2 = key128(F.col("__host"), F.col("__line"))
    line = line.select("__k1", "__k2", "__host", *by, h1.alias("__h1"), h2.alias("__h2"))

    counted, shows = df.select(host.alias("__host"), *by), line
    if by:
        alone = F.struct(F.lit(None).cast("long").alias("class1"), F.col("t1").alias("class2"), F.col("t2").alias("class3"))
        known = classes.select("t1", "t2", F.struct("class.class1", "class.class2", F.lit(None).cast("long").alias("class3")).alias("__class"))

        def classed(rows: DataFrame) -> DataFrame:
            return rows.distinct().join(known, by, "left").withColumn("__class", F.coalesce("__class", alone))

        counted = classed(counted).select("__host", "__class").distinct()
        shows = classed(line.select("__host", "__h1", "__h2", *by)).groupBy("__h1", "__h2", "__class").agg(F.any_value("__host").alias("__host"))
    totals = counted.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages")).where(F.col("__pages") >= min_pages)
    counts = (shows.groupBy("__h1", "__h2").agg(F.any_value("__host").alias("__host"), F.count(F.lit(1)).alias("__n"))
              .where(F.col("__n") * _MILLION > share * min_pages))
    common = (counts.alias("c").join(totals.alias("t"), F.col("c.__host").eqNullSafe(F.col("t.__host")))
              .where(F.col("__n") * _MILLION > F.col("__pages") * share)
              .select("__h1", "__h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")))
    dropped = (line.withColumn("__salt", F.pmod(F.col("__k1"), F.lit(SALTS)).cast("int"))
               .join(common, ["__h1", "__h2", "__salt"], "left_semi")
               .groupBy("__k1", "__k2").agg(F.collect_set(F.struct("__h1", "__h2")).alias("__dropped")))

    def stays(x: Column) -> Column:
        a, b = key128(host, F.trim(x))
        return ~F.array_contains(F.col("__dropped"), F.struct(a.alias("__h1"), b.alias("__h2")))

    kept = F.when(F.col("__dropped").isNull(), own).otherwise(F.filter(own, stays))
    return (pages.join(dropped, ["__k1", "__k2"], "left").withColumn("kept_lines", kept)
            .withColumn("n_lines", F.size(own).cast("long")).withColumn("n_dropped", (F.size(own) - F.size("kept_lines")).cast("long"))
            .drop("__k1", "__k2", "__dropped"))
