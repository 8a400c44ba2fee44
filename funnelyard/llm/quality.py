"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Each document's transformed statistics form a vector. For every (language, source) the centre and
covariance of the tightest share of the documents are found by concentration steps (Rousseeuw and Van
Driessen, 1999) from a deterministic start (medians and median deviations, as in Hubert et al., 2012).
A document goes if its squared Mahalanobis distance is beyond a chi-square quantile.

A concentration step is one aggregation over all rows: distances are binned finely, and counts and
moments are summed for each group and bin with map-side combining; the bins up to the wanted share then
give the next estimate. So a group with a third of all rows costs no more than any other, and nothing
is sampled. The vectors are integers (1/SCALE units) and so are their moments: sums don't depend on the
order in which they are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelyard.llm.common import key128, stage
from funnelyard.llm.words import SPACES, byte_set, chunks, column_bytes, covered, digest_spans, find_words, releasing, whole, windows

#: Fixed values of the base rules: symbol characters `#*$%&|<>`, shortest text, window, percent of repeated words.
SYMBOLS = byte_set(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
MIN_WORDS, REPEAT_WINDOW, MAX_REPEATED = 10, 5, 20

SCALE = 1024
#: Least standard deviation of each statistic, in its own units: what never varies in a group gets no
#: infinite weight. In the order of `vector`.
FLOORS = (0.25, 0.03, 0.10, 0.05)
DIM = len(FLOORS)

_STATS = ("doc_id long, lang string, source string, k1 long, k2 long, n_words long, word_chars long, "
          "n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long")


def repeated_words(rows: np.ndarray, digests: np.ndarray, size: int) -> np.ndarray:
    """Whether each word lies in a run of `size` words that its row holds twice or more."""
    n = len(digests)
    at = np.flatnonzero(whole(rows, size))
    if not len(at):
        return np.zeros(n, bool)
    h, row = windows(digests, size)[at], rows[at]
    order = np.lexsort((h, row))
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return covered(at[twice], size, n)


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row of counts for each document; k1 and k2 digest (language, source, text)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                n = part.num_rows
                column = part.column(5)
                data, offsets = column_bytes(column)
                starts, ends, rows = find_words(data, offsets, SPACES)
                sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
                lines = [[x for x in (t or b"").split(b"\n") if x.strip()] for t in column.to_pylist()]
                repeated = repeated_words(rows, digest_spans(data, starts, ends), REPEAT_WINDOW)
                counts = (np.bincount(rows, minlength=n), sums(~SPACES[data] & ((data & 0xC0) != 0x80)), sums(SYMBOLS[data]),
                          [len(x) - len(set(x)) for x in lines], [len(x) for x in lines],
                          np.bincount(rows[repeated], minlength=n))
                yield pa.RecordBatch.from_arrays([*part.columns[:5], *[pa.array(c, pa.int64()) for c in counts]],
                                                 names=[c.split()[0] for c in _STATS.split(", ")])

    k1, k2 = key128(F.col(lang_col), F.col(source_col), F.col(text_col))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                       k1.alias("k1"), k2.alias("k2"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(releasing(scan), _STATS)


def vector() -> list[Column]:
    """The statistics in 1/SCALE units, each drawn towards a usual value so that short texts scatter no more than long ones.

    Mean word length (towards 5 over 50 words), symbols a word and repeated words a word (towards 0 over
    20 words), repeated lines a line (towards 0 over 5 lines).
    """
    n = F.col("n_words")
    parts = (((F.col("word_chars") + 250) / (n + 50)), F.col("n_symbols") / (n + 20),
             F.col("n_dup_lines") / (F.col("n_lines") + 5), F.col("n_repeat_words") / (n + 20))
    return [F.round(F.least(p, F.lit(1000.0)) * SCALE).cast("long").alias(f"x{i}") for i, p in enumerate(parts)]


def chi2_cdf(x: float, even: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(even // 2))


def chi2_quantile(share: float, even: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, even) < share else (lo, mid)
    return hi


def estimate(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and inverse covariance of the first bins that hold `share` of the rows (bins in order of distance).

    The covariance is scaled for the cut-off tails and gets the floors on its diagonal.
    """
    upto = int(np.searchsorted(np.cumsum(counts), math.ceil(share * counts.sum()))) + 1
    n = counts[:upto].sum()
    centre = sums[:upto].sum(axis=0) / n
    cov = products[:upto].sum(axis=0) / n - np.outer(centre, centre)
    inside = n / counts.sum()
    if inside < 1:
        cov *= inside / chi2_cdf(chi2_quantile(inside, DIM), DIM + 2)
    cov = cov + np.diag((np.array(FLOORS) * SCALE) ** 2)
    return centre, np.linalg.inv(cov)


_PARAMS = "g_lang string, g_source string, centre array<double>, inverse array<double>"
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def _next(share: float):
    def step(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        products = np.zeros((len(group), DIM, DIM))
        for i, j in _PAIRS:
            products[:, i, j] = products[:, j, i] = group[f"p{i}{j}"].astype(float)
        centre, inverse = estimate(group["n"].to_numpy(), group[[f"s{i}" for i in range(DIM)]].to_numpy(float), products, share)
        return pd.DataFrame({"g_lang": group["g_lang"].iloc[:1], "g_source": group["g_source"].iloc[:1],
                             "centre": [centre.tolist()], "inverse": [inverse.ravel().tolist()]})
    return step


def squared_distance() -> Column:
    """Squared Mahalanobis distance of x0... to `centre` under `inverse`."""
    d = [F.col(f"x{i}") - F.col("centre")[i] for i in range(DIM)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + d[i] * d[j] * F.col("inverse")[i * DIM + j] * (1.0 if i == j else 2.0)
    return total


def pool_table(stats: DataFrame, least: int) -> DataFrame:
    """(own_lang, own_source, g_lang, g_source): each language's and source's own group, or the pool `*` of its
    language, or of all, where fewer than `least` documents share it. Nulls are named by the empty string."""
    own = stats.select(F.coalesce("lang", F.lit("")).alias("own_lang"), F.coalesce("source", F.lit("")).alias("own_source"))
    own = own.groupBy("own_lang", "own_source").agg(F.count(F.lit(1)).alias("n"))
    pooled = own.withColumn("g_source", F.when(F.col("n") >= least, F.col("own_source")).otherwise(F.lit("*")))
    sizes = pooled.groupBy("own_lang", "g_source").agg(F.sum("n").alias("m"))
    return (pooled.join(sizes, ["own_lang", "g_source"])
            .select("own_lang", "own_source", F.when(F.col("m") >= least, F.col("own_lang")).otherwise(F.lit("*")).alias("g_lang"), "g_source"))


def in_pools(stats: DataFrame, pools: DataFrame) -> DataFrame:
    """Adds g_lang and g_source to the rows."""
    named = stats.withColumn("own_lang", F.coalesce("lang", F.lit(""))).withColumn("own_source", F.coalesce("source", F.lit("")))
    return named.join(pools, ["own_lang", "own_source"]).drop("own_lang", "own_source")


def assess(docs: DataFrame, share: float = 0.75, confidence: float = 0.9999, steps: int = 4, least_group: int = 50,
           id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each document: its counts, base_failed, distance2 (squared Mahalanobis) and kept.

    base_failed: under MIN_WORDS words, or more than MAX_REPEATED percent of the words repeated. The
    estimates are over the documents that pass the base rules. Repeated rows and ties get equal results;
    null and empty texts fail the base rules; an empty table gives no rows. Only the named columns are read.
    k1 and k2 digest (language, source, text), on which alone the verdict depends.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    stats = stage(document_stats(docs, id_col, text_col, lang_col, source_col).select("*", failed.alias("base_failed"), *vector()), "stats")
    pools = stage(pool_table(stats.where("not base_failed"), least_group), "pools")
    few = 200 * pools.count()  # bounds the bins of all groups, for the files that hold a row per group
    passed = stage(in_pools(stats.where("not base_failed"), pools).select("g_lang", "g_source", *[f"x{i}" for i in range(DIM)]), "vectors")
    group = ["g_lang", "g_source"]

    medians = stage(passed.groupBy(*group).agg(*[F.percentile(f"x{i}", 0.5).alias(f"m{i}") for i in range(DIM)]), "medians", few)
    spread = passed.join(medians, group).groupBy(*group, *[f"m{i}" for i in range(DIM)]).agg(
        *[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i in range(DIM)])
    variance = [F.pow(F.col(f"d{i}") * 1.4826, 2.0) + (FLOORS[i] * SCALE) ** 2 for i in range(DIM)]
    params = spread.select(*group, F.array(*[f"m{i}" for i in range(DIM)]).alias("centre"),
                           F.array(*[1 / variance[i] if i == j else F.lit(0.0) for i in range(DIM) for j in range(DIM)]).alias("inverse"))
    for _ in range(steps):
        binned = (passed.join(stage(params, "params", few), group)
                  .withColumn("bin", F.floor(F.log1p(F.greatest(squared_distance(), F.lit(0.0))) * 64)))
        sums = binned.groupBy(*group, "bin").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").cast("double").alias(f"s{i}") for i in range(DIM)],
            *[F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).cast("double").alias(f"p{i}{j}") for i, j in _PAIRS])
        params = sums.groupBy(*group).applyInPandas(_next(share), _PARAMS)
    limit = chi2_quantile(confidence, DIM)
    judged = in_pools(stats.where("not base_failed"), pools).join(stage(params, "params", few), group, "left")
    judged = judged.withColumn("distance2", squared_distance())
    columns = [c for c in stats.columns if not c.startswith("x")]
    rest = stats.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept"))
    return judged.select(*columns, "distance2", (F.col("distance2") <= limit).alias("kept")).union(rest)
