"""The structured query: typed, with defaults and checks; its short URL form; amounts in Japanese notation.

This is the driver's part of a query. What it yields is compiled into DataFrame operations by the operators package.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from decimal import Decimal
from urllib.parse import parse_qsl, urlencode

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

YEARS = ("2024", "2025")
ACCOUNTS = ("general", "special", "both", "none")
MOST = {"top_ministry": 37, "top_project": 300, "top_recipient": 300}
MAX_PATTERN = 128

# ---- amounts -------------------------------------------------------------------------------------------------------

_UNITS = {"兆": 10**12, "億": 10**8, "万": 10**4, "千": 10**3, "百": 100, "十": 10}
_FOLD = str.maketrans("０１２３４５６７８９－−‐．", "0123456789---.", "，,")
_NUMBER = re.compile(r"(\d+\.?\d*|\.\d+|[一二三四五六七八九])|([兆億万千百十])")


def parse_yen(text: str) -> float | None:
    """'1.26億', '４５６７万円', '一千二百億', '1兆2000億', '12億5千万', '-51000円' -> yen; None if it's no amount.

    Read from left to right: a number waits for its unit; 千, 百 and 十 go into the part below the next of 兆, 億 and 万, which closes it.
    A number without a unit counts as it is, but right after 兆 as 億.
    """
    body = "".join(text.translate(_FOLD).split())
    negative = body.startswith("-")
    body = body[negative:].removesuffix("円")
    total, part, number, last, at = Decimal(0), Decimal(0), None, None, 0
    for m in _NUMBER.finditer(body):
        if m.start() != at:
            return None
        at = m.end()
        if m[1]:
            if number is not None and m[1][0] in "0123456789.":
                return None
            number = Decimal("一二三四五六七八九".index(m[1]) + 1 if m[1] in "一二三四五六七八九" else m[1])
            continue
        unit = _UNITS[m[2]]
        if unit < 10_000:
            part, number = part + (1 if number is None else number) * unit, None
        elif number is None and not part:
            return None
        else:
            total, part, number, last = total + (part + (number or 0)) * unit, Decimal(0), None, m[2]
    if not body or at != len(body):
        return None
    total += (part + (number or 0)) * (_UNITS["億"] if last == "兆" else 1)
    value = -total if negative else total
    return int(value) if value == int(value) else float(value)


def short_yen(yen: float) -> str:
    """The shortest notation that parse_yen() reads back."""
    if yen > 0 and yen == int(yen):
        for unit in "兆億万":
            if yen % _UNITS[unit] == 0:
                return f"{int(yen) // _UNITS[unit]}{unit}"
    return str(int(yen) if yen == int(yen) else yen)


# ---- the query -----------------------------------------------------------------------------------------------------


def pattern_fault(pattern: str) -> str | None:
    """Why rlike() can't run the pattern: the JVM, which runs it, compiles it; without a session Python does."""
    try:
        if spark := SparkSession.getActiveSession():
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except (re.error, Py4JError, PySparkException) as e:
        return str(e).splitlines()[0]
    return None


@dataclass(frozen=True)
class Name:
    query: str
    regex: bool = False
    include_subcontract: bool = False

    @property
    def pattern(self) -> str:
        """For rlike(): a regular expression, or the literal text, in either case."""
        return f"(?iu){self.query if self.regex else re.escape(self.query)}"


@dataclass(frozen=True)
class Range:
    min: float | None = None
    max: float | None = None

    def __bool__(self) -> bool:
        return self.min is not None or self.max is not None


@dataclass(frozen=True)
class Filter:
    project_name: Name | None = None
    recipient_name: Name | None = None
    ministries: tuple[str, ...] = ()
    budget: Range = Range()
    spending: Range = Range()
    accounts: tuple[str, ...] = ACCOUNTS
    has_redelegation: bool = False
    min_depth: int | None = None

    @property
    def depth(self) -> int | None:
        """Least number of block levels asked for."""
        return self.min_depth if self.min_depth is not None else 2 if self.has_redelegation else None

    @property
    def by_account(self) -> bool:
        return set(self.accounts) != set(ACCOUNTS)

    @property
    def active(self) -> bool:
        return bool(self.project_name or self.recipient_name or self.ministries or self.budget or self.spending or self.by_account
                    or self.depth is not None)


@dataclass(frozen=True)
class View:
    top_ministry: int = 37
    top_project: int = 50
    top_recipient: int = 50
    pin_project: str | None = None
    pin_recipient: str | None = None
    pin_ministry: str | None = None
    focus: bool = False
    offset_target: str = "project"
    recipient_offset: int = 0
    project_offset: int = 0
    sort_by: str = "budget"
    show_agg_project: bool = True
    show_agg_recipient: bool = True
    scale_budget: bool = True


@dataclass(frozen=True)
class Query:
    year: str = "2024"
    filter: Filter = field(default_factory=Filter)
    view: View = field(default_factory=View)


def _number(v) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)


def resolve(raw: dict) -> tuple[Query, list[str]]:
    """A nested dict (camelCase keys, all optional) -> the query with defaults, and what is wrong with it."""
    errors: list[str] = []
    f, v = raw.get("filter") or {}, raw.get("view") or {}
    year = raw.get("year") or "2024"
    if year not in YEARS:
        errors.append(f"year: one of {', '.join(YEARS)}, not {year!r}")

    def name(key: str) -> Name | None:
        given = f.get(key) or {}
        text = given.get("query").strip() if isinstance(given.get("query"), str) else ""
        if not text:
            return None
        if given.get("regex") is True:
            if len(text) > MAX_PATTERN:
                errors.append(f"{key}: a pattern has {MAX_PATTERN} characters at most")
                return None
            if fault := pattern_fault(text):
                errors.append(f"{key}: bad pattern: {fault}")
                return None
        return Name(text, given.get("regex") is True, key == "recipientName" and given.get("includeSubcontract") is True)

    def limits(key: str) -> Range:
        ends = {}
        for end in ("min", "max"):
            x = (f.get(key) or {}).get(end)
            if x is not None and not _number(x):
                errors.append(f"{key}.{end}: a number of yen, not {x!r}")
                x = None
            ends[end] = x
        if None not in ends.values() and ends["min"] > ends["max"]:
            errors.append(f"{key}: min is above max")
        return Range(**ends)

    accounts = f.get("accountCategories")
    if unknown := [a for a in accounts or () if a not in ACCOUNTS]:
        errors.append(f"accountCategories: unknown {', '.join(map(str, unknown))}")
    sub = f.get("subcontract") or {}
    depth = sub.get("minDepth")
    if depth is not None and not (_number(depth) and math.floor(depth) >= 2):
        errors.append(f"subcontract.minDepth: a whole number from 2 on, not {depth!r}")
        depth = None

    def whole(key: str, default: int, low: int, high: float, of: dict = v) -> int:
        x = of.get(key)
        return max(low, min(int(high) if high < math.inf else math.floor(x), math.floor(x))) if _number(x) else default

    pin, offset = v.get("pin") or {}, v.get("offset") or {}
    return Query(
        year if year in YEARS else "2024",
        Filter(name("projectName"), name("recipientName"), tuple(dict.fromkeys(m for m in (str(x).strip() for x in f.get("ministries") or ()) if m)),
               limits("budget"), limits("spending"),
               ACCOUNTS if accounts is None else tuple(dict.fromkeys(a for a in accounts if a in ACCOUNTS)),
               sub.get("hasRedelegation") is True, None if depth is None else math.floor(depth)),
        View(whole("topMinistry", 37, 1, MOST["top_ministry"]), whole("topProject", 50, 1, MOST["top_project"]),
             whole("topRecipient", 50, 1, MOST["top_recipient"]), pin.get("projectId"), pin.get("recipientId"), pin.get("ministryName"),
             v.get("focusRelated") is True, "recipient" if offset.get("target") == "recipient" else "project",
             whole("recipient", 0, 0, math.inf, offset), whole("project", 0, 0, math.inf, offset),
             "spending" if v.get("projectSortBy") == "spending" else "budget",
             *(v.get(k) is not False for k in ("showAggProject", "showAggRecipient", "scaleBudgetToVisible"))),
    ), errors


# ---- short URL form ------------------------------------------------------------------------------------------------

#: View fields and their short keys.
_PINS = {"pp": "pin_project", "pr": "pin_recipient", "pm": "pin_ministry"}
_TOPS = {"tm": "top_ministry", "tp": "top_project", "tr": "top_recipient"}


def to_url(q: Query) -> str:
    """Defaults are left out, but for the year."""
    f, v, plain, out = q.filter, q.view, View(), []
    out += [(k, getattr(v, a)) for k, a in _PINS.items() if getattr(v, a)]
    out += [("ro", v.recipient_offset)] * (v.recipient_offset != 0) + [("ot", "r")] * (v.offset_target == "recipient")
    out += [("po", v.project_offset)] * (v.project_offset != 0)
    out += [(k, getattr(v, a)) for k, a in _TOPS.items() if getattr(v, a) != getattr(plain, a)]
    out += [("ar", 0)] * (not v.show_agg_recipient) + [("ap", 0)] * (not v.show_agg_project) + [("ps", "s")] * (v.sort_by == "spending")
    out += [("sb", 0)] * (not v.scale_budget) + [("fr", 1)] * v.focus + [("yr", q.year)] + [("fp", 1)] * f.active
    for key, n in (("fnp", f.project_name), ("fnr", f.recipient_name)):
        if n:
            out += [(key, n.query)] + [(key + "r", 1)] * n.regex + [(key + "s", 1)] * n.include_subcontract
    out += [("fm", m) for m in f.ministries]
    out += [(k, short_yen(x)) for k, x in (("fmb", f.budget.min), ("fxb", f.budget.max), ("fms", f.spending.min), ("fxs", f.spending.max)) if x is not None]
    if f.by_account:
        out.append(("ac", "".join(a[0] for a in ACCOUNTS if a in f.accounts)))
    out += [("fsd", f.min_depth)] if f.min_depth is not None else [("fsr", 1)] * f.has_redelegation
    return urlencode(out)


def from_url(text: str) -> dict:
    """The nested dict that resolve() takes."""
    pairs = parse_qsl(text.lstrip("?"), keep_blank_values=True)
    p: dict[str, str] = {}
    for k, x in pairs:
        p.setdefault(k, x)
    f: dict = {}
    v: dict = {}
    for key, field_name in (("fnp", "projectName"), ("fnr", "recipientName")):
        if p.get(key):
            f[field_name] = {"query": p[key], "regex": p.get(key + "r") == "1"}
    if f.get("recipientName") and p.get("fnrs") == "1":
        f["recipientName"]["includeSubcontract"] = True
    if names := [x.strip() for k, x in pairs if k == "fm" and x.strip()]:
        f["ministries"] = list(dict.fromkeys(names))
    for field_name, ends in (("budget", ("fmb", "fxb")), ("spending", ("fms", "fxs"))):
        low, high = (parse_yen(p[k]) if p.get(k) else None for k in ends)
        if low is not None or high is not None:
            f[field_name] = {"min": low, "max": high}
    if "ac" in p:
        f["accountCategories"] = [a for a in ACCOUNTS if a[0] in p["ac"]]

    def number(key: str) -> int | None:
        m = re.match(r"\s*([+-]?\d+)", p.get(key, ""))
        return int(m[1]) if m else None

    if number("fsd") is not None:
        f["subcontract"] = {"minDepth": number("fsd")}
    elif p.get("fsr") == "1":
        f["subcontract"] = {"hasRedelegation": True}
    v |= {k: n for k, n in (("topMinistry", number("tm")), ("topProject", number("tp")), ("topRecipient", number("tr"))) if n is not None}
    if any(p.get(k) for k in _PINS):
        v["pin"] = {"projectId": p.get("pp"), "recipientId": p.get("pr"), "ministryName": p.get("pm")}
    if p.get("fr") == "1":
        v["focusRelated"] = True
    offset = {k: n for k, n in (("recipient", number("ro")), ("project", number("po"))) if n is not None}
    if p.get("ot") in ("r", "p"):
        offset["target"] = {"r": "recipient", "p": "project"}[p["ot"]]
    if offset:
        v["offset"] = offset
    if p.get("ps") == "s":
        v["projectSortBy"] = "spending"
    v |= {k: False for s, k in (("ar", "showAggRecipient"), ("ap", "showAggProject"), ("sb", "scaleBudgetToVisible")) if p.get(s) == "0"}
    return ({"year": p["yr"]} if p.get("yr") in YEARS else {}) | ({"filter": f} if f else {}) | ({"view": v} if v else {})
