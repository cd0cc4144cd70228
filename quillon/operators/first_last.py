"""First and last values by time, as aggregates that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _filled(x: str, order: Column, bound: Column | None, ts: str) -> Column:
    ok = F.col(x).isNotNull()
    if bound is not None:
        ok = ok & (F.col(ts) <= bound)
    return F.when(ok, order)


def _order(ts: str, ties: list[str]) -> Column:
    return F.struct(ts, *ties) if ties else F.col(ts)


def first(x: str, ts: str, ties: list[str] = []) -> Column:  # noqa: B006
    """Earliest non-null value."""
    return F.min_by(x, _filled(x, _order(ts, ties), None, ts))


def last(x: str, ts: str, bound: Column | None = None, ties: list[str] = []) -> Column:  # noqa: B006
    """Latest non-null value, at or before bound if one is given."""
    return F.max_by(x, _filled(x, _order(ts, ties), bound, ts))


def first_ts(x: str, ts: str) -> Column:
    return F.min(F.when(F.col(x).isNotNull(), F.col(ts)))


def last_ts(x: str, ts: str, bound: Column | None = None) -> Column:
    return F.max(_filled(x, F.col(ts), bound, ts))


def first_row(x: str, ts: str, ties: list[str] = []) -> Column:  # noqa: B006
    """Value of the earliest row, null or not."""
    return F.min_by(x, _order(ts, ties))


def last_row(x: str, ts: str, ties: list[str] = []) -> Column:  # noqa: B006
    return F.max_by(x, _order(ts, ties))


def first_row_ts(ts: str) -> Column:
    return F.min(ts)


def last_row_ts(ts: str) -> Column:
    return F.max(ts)


def expand_star(kind, df: DataFrame, ts: str, skip: list[str] = []) -> list[Column]:  # noqa: B006
    """kind(*): one aggregate a column, named kind(column)."""
    return [kind(c, ts).alias(f"{kind.__name__}({c})") for c in df.columns if c not in skip]
