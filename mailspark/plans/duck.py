"""DuckDB text fragments used by the oracle SQL (mirrors of the Spark columns)."""

from __future__ import annotations


def ts(x: str) -> str:
    """TIMESTAMP of epoch seconds."""
    return f"make_timestamp(CAST({x} AS BIGINT) * 1000000)"


def epoch_text(x: str) -> str:
    """F11."""
    return f"strftime({ts(x)}, '%Y-%m-%d %H:%M:%S')"


def fixed_text(num: str, den: str, dec: int, suffix: str = "") -> str:
    """exact half-up rounding in integer arithmetic."""
    n, d = f"CAST({num} AS BIGINT)", f"CAST({den} AS BIGINT)"
    scale = 10 ** dec
    scaled = f"(({n}) * {2 * scale} + ({d})) // (2 * ({d}))"
    if dec == 0:
        return f"concat(CAST({scaled} AS VARCHAR), '{suffix}')"
    return (f"concat(CAST({scaled} // {scale} AS VARCHAR), '.', "
            f"lpad(CAST({scaled} % {scale} AS VARCHAR), {dec}, '0'), '{suffix}')")


def newest(date: str = "date_ts", prefix: str = "") -> str:
    return (f"{{'d': coalesce({date}, CAST(-9223372036854775807 - 1 AS BIGINT)), 'path': {prefix}path, "
            f"'mbox_offset': {prefix}mbox_offset}}")


def isum(x: str) -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


def count_if(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"
