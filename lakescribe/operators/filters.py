"""Equality filters as column predicates: no SQL text is put together, so nothing needs escaping."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def invalid_keys(filters: dict[str, Any], valid: Iterable[str]) -> list[str]:
    return sorted(set(filters) - set(valid))


def predicate(filters: dict[str, Any], valid: Iterable[str], columns: Iterable[str], strict_parity: bool = False) -> Column | None:
    """Conjunction of equalities on valid columns, None without any.

    Values None and unknown keys say nothing. ``strict_parity`` also passes over numbers, which are applied otherwise.
    """
    valid, columns = set(valid), set(columns)
    kinds = (str, bool) if strict_parity else (str, bool, int, float)
    out = None
    for k, v in filters.items():
        if k in valid and k in columns and isinstance(v, kinds):
            one = F.col(k) == F.lit(v)
            out = one if out is None else out & one
    return out


def filtered(df: DataFrame, filters: dict[str, Any], valid: Iterable[str], include_summaries: bool = True, strict_parity: bool = False) -> DataFrame:
    """Rows that meet the filters; summaries are left out, whatever the filters say of them, unless asked for."""
    filters = dict(filters)
    if not include_summaries and "is_summary" in df.columns:
        filters["is_summary"] = False
    where = predicate(filters, set(valid) | {"is_summary"}, df.columns, strict_parity)
    return df if where is None else df.filter(where)
