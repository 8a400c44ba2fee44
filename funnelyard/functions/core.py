"""Column-expression helpers shared by every operator.

All helpers return ``pyspark.sql.Column`` objects so they stay inside
whole-stage codegen; none of them is a Python UDF.

Rounding rule (used everywhere a percentage is reported): a percentage is
carried as an exact integer number of *hundredths*,

    pct_h(n, d) = sign(n) * ((|n| * 20000 + d) div (2 * d))      (d > 0)

which is ``n / d * 100`` rounded half away from zero to two decimals.  It is
turned into a double only at the very end (``hundredths / 100``), so a
difference of two rates is an exact integer difference and Spark and an
independent SQL engine agree bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Members treated as "no real value" by ranking / breakdown style operators
# (compared after trim + lower-case).
PLACEHOLDER_MEMBERS = (
    "", "none", "null", "n/a", "na", "unknown", "-", "none/unknown",
    "total", "grand total", "grand_total",
)
# Performance-flag thresholds (conversion in percent).
LOW_CONVERSION_PCT = 20
STRONG_CONVERSION_PCT = 50
# Label that makes a blank dimension selectable in the period workspace.
UNSPECIFIED = "Unspecified"
# ---------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(n: str | Column, d: str | Column) -> Column:
    """Integer division (SQL ``div``), exact on longs."""
    return F.call_function("div", col(n), col(d))


def pct_h(n: str | Column, d: str | Column) -> Column:
    """``n/d*100`` in hundredths, half away from zero; null when ``d == 0``."""
    n, d = col(n).cast("long"), col(d).cast("long")
    return F.when(d != 0, F.signum(n).cast("long") * idiv(F.abs(n) * 20000 + d, d * 2))


def from_h(h: str | Column) -> Column:
    """Hundredths (long) -> double with two decimals."""
    return col(h).cast("double") / 100


def pct(n: str | Column, d: str | Column, zero_div: str = "null") -> Column:
    """Rounded percentage as a double; ``zero_div`` is ``"null"`` or ``"zero"``."""
    v = from_h(pct_h(n, d))
    return F.coalesce(v, F.lit(0.0)) if zero_div == "zero" else v


def rate_h(n: str | Column, d: str | Column, zero_div: str = "zero") -> Column:
    """Conversion rate in hundredths; 0 (default) or null on a zero denominator."""
    h = pct_h(n, d)
    return F.coalesce(h, F.lit(0).cast("long")) if zero_div == "zero" else h


def growth(new: str | Column, old: str | Column) -> Column:
    """Growth ``(new-old)/old*100`` rounded; null when ``old == 0``."""
    return pct(col(new) - col(old), old)


def change_of_h(new_h: str | Column, old_h: str | Column) -> Column:
    """Difference of two hundredth-valued rates as a double (exact)."""
    return from_h(col(new_h) - col(old_h))


def lsum(c: str | Column) -> Column:
    """``coalesce(sum(c), 0)`` as long (never null, even over no rows)."""
    return F.coalesce(F.sum(col(c)), F.lit(0)).cast("long")


def trim_spaces(c: str | Column) -> Column:
    """SQL ``BTRIM`` semantics: strip spaces only."""
    return F.btrim(col(c), F.lit(" "))


def strip_ws(c: str | Column) -> Column:
    """Python ``str.strip()`` semantics: strip all leading/trailing whitespace."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def blank_label(c: str | Column, label: str = UNSPECIFIED) -> Column:
    """``COALESCE(NULLIF(BTRIM(c), ''), label)``."""
    return F.coalesce(F.nullif(trim_spaces(c), F.lit("")), F.lit(label))


def is_placeholder(c: str | Column) -> Column:
    """True for null or for members in :data:`PLACEHOLDER_MEMBERS`."""
    c = col(c)
    return c.isNull() | F.lower(F.trim(c)).isin(*PLACEHOLDER_MEMBERS)


def not_placeholder(cols: Iterable[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~is_placeholder(c)
    return cond


def flag_by_rate(leads: str | Column, rate_hundredths: str | Column) -> Column:
    """``high_leads_low_conversion`` below 20 % with leads, ``strong`` from 50 %."""
    r = col(rate_hundredths)
    return (F.when((col(leads) >= 1) & r.isNotNull() & (r < LOW_CONVERSION_PCT * 100),
                   F.lit("high_leads_low_conversion"))
            .when(r.isNotNull() & (r >= STRONG_CONVERSION_PCT * 100), F.lit("strong"))
            .otherwise(F.lit("normal")))


def flag_by_zero(leads: str | Column, admissions: str | Column,
                 rate_hundredths: str | Column) -> Column:
    """Detail-view flag: leads without any admission is the weak case."""
    r = col(rate_hundredths)
    return (F.when((col(leads) > 0) & (col(admissions) == 0), F.lit("high_leads_low_conversion"))
            .when(r.isNotNull() & (r >= STRONG_CONVERSION_PCT * 100), F.lit("strong"))
            .otherwise(F.lit("normal")))


def ci_equals(c: str | Column, value: str) -> Column:
    """Case-insensitive equality with a literal."""
    return F.lower(col(c)) == F.lit(value.lower())


def bounded_rows(df, limit: int, what: str = "rows") -> list:
    """Read a metadata result of a fixed size (the two datasets of a request,
    say) on the driver, to turn request parameters into static partition
    filters; never for data."""
    got = df.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"{what}: more than {limit} rows; refusing to read them on the driver")
    return got


def derived_once(df: DataFrame) -> DataFrame:
    """Checkpoint an aggregated result that several parts of a query read, so
    the rows behind it are scanned and joined once.  It goes to the shared
    checkpoint folder, which an executor's loss does not touch."""
    from funnelyard.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
