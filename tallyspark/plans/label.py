"""A short name of a query, for lists of what has been looked at."""

from __future__ import annotations

from tallyspark.functions.money import yen
from tallyspark.plans.query import ACCOUNTS, Name, Query, Range

#: Ministries that are named; fixed values.
NAMED, ACCOUNT_NAMES = 2, {"general": "一般会計", "special": "特別会計", "both": "一般+特別", "none": "区分なし"}


def named(prefix: str, name: Name | None) -> list[str]:
    return [f'{prefix}"{name.query.strip()}"'] if name and name.query.strip() else []


def ranged(prefix: str, r: Range) -> list[str]:
    if not r:
        return []
    if r.min is not None and r.max is not None:
        return [f"{prefix}{yen(r.min)}〜{yen(r.max)}"]
    return [f"{prefix}{yen(r.min)}以上" if r.min is not None else f"{prefix}{yen(r.max)}以下"]


def exploration_label(query: Query) -> str:
    """The year and what the filter asks for, joined by a middle dot; without a filter it says so. Counts are no part of it."""
    f, parts = query.filter, []
    if f.ministries:
        more = len(f.ministries) - NAMED
        parts.append("/".join(f.ministries[:NAMED]) + (f" 他{more}" if more > 0 else ""))
    parts += named("事業名", f.project_name)
    parts += named("支出先/再委託先" if f.recipient_name and f.recipient_name.include_subcontract else "支出先", f.recipient_name)
    parts += ranged("予算", f.budget) + ranged("受領額", f.spending)
    if f.accounts and len(f.accounts) < len(ACCOUNTS):
        parts.append("/".join(ACCOUNT_NAMES[a] for a in f.accounts))
    if f.min_depth is not None and f.min_depth >= 2:
        parts.append(f"再委託階層{f.min_depth}以上")
    elif f.has_redelegation:
        parts.append("再委託あり")
    return "・".join([x for x in (query.year,) if x] + (parts or ["フィルタなし"]))
