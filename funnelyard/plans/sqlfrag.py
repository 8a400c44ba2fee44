"""SQL text fragments for the oracle (DuckDB dialect) mirroring the
rounding rule of :mod:`funnelyard.functions.core`."""

from __future__ import annotations


def pct_h(n: str, d: str) -> str:
    """Hundredths of ``n/d*100`` half away from zero; NULL when d = 0."""
    return (f"(case when ({d}) = 0 then null else "
            f"cast(sign({n}) * ((abs({n}) * 20000 + ({d})) // (2 * ({d}))) as bigint) end)")


def pct(n: str, d: str) -> str:
    return f"(cast({pct_h(n, d)} as double) / 100)"


def rate_h(n: str, d: str) -> str:
    """Conversion in hundredths, 0 on a zero denominator."""
    return f"coalesce({pct_h(n, d)}, 0)"


def from_h(h: str) -> str:
    return f"(cast({h} as double) / 100)"


def lsum(x: str) -> str:
    return f"cast(coalesce(sum({x}), 0) as bigint)"


def blank(c: str, label: str = "Unspecified") -> str:
    return f"coalesce(nullif(trim({c}, ' '), ''), '{label}')"
