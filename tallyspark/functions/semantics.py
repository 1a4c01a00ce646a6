"""Scalar rules of the data model as Column expressions: rounding, amounts, names, keys, labels.

Everything is a built-in expression but nfkc() and excerpt(), for which Spark has none; those are Arrow UDFs.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- numbers -------------------------------------------------------------------------------------------------------


def half_up(x: Column, places: int = 0) -> Column:
    """Rounds halves towards plus infinity, on the binary value."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5).cast("double") / scale if places else F.floor(x + 0.5).cast("double")


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def weighted_available(values: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the values that aren't null; null if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v * F.lit(float(w)), F.lit(0.0)) for v, w in values])
    weight = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in values])
    return F.when(weight > 0, total / weight)


def amount(text: Column) -> Column:
    """Yen from text with thousands separators; what isn't a number is 0."""
    return F.coalesce(amount_or_null(text), F.lit(0).cast("long"))


def amount_or_null(text: Column) -> Column:
    """As amount(), but blank or no number is null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double").cast("long")


def scaled_amount(text: Column, unit: int = 1000) -> Column:
    """Budget books print thousands of yen, and a triangle before negative amounts."""
    body = F.regexp_replace(F.trim(text), "[,△▲\\s]", "").try_cast("double").cast("long") * unit
    return F.when(F.trim(text).rlike("^[△▲]"), -body).otherwise(body)


def flag(text: Column) -> Column:
    return F.upper(F.trim(text)) == "TRUE"


def diff_rate(base: Column, compare: Column, places: int = 4) -> Column:
    """(compare - base) / base; null when base is 0."""
    return half_up(F.try_divide((compare - base).cast("double"), base.cast("double")), places)


def change_rate(previous: Column, current: Column) -> Column:
    """(rate, is_new): null without a previous amount; new, and without a rate, from 0; else (current - previous) / previous, where a
    null current amount is 0."""
    rate = F.try_divide((F.coalesce(current, F.lit(0)) - previous).cast("double"), previous.cast("double"))
    return F.when(previous.isNotNull(), F.struct(rate.alias("rate"), (previous == 0).alias("is_new")))


def execution_rate(spent: Column, budget: Column, places: int = 3) -> Column:
    return F.when((budget > 0) & (spent > 0), half_up(spent.cast("double") / budget, places))


def years_running(year: int, start: Column) -> Column:
    return F.greatest(F.lit(1), F.lit(year) - start + 1)


# ---- text ----------------------------------------------------------------------------------------------------------


def nfkc(text: Column) -> Column:
    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    return normal(text)


def folded(text: Column) -> Column:
    # ASCII text is its own normal form, so Python only sees the rest
    plain = text.rlike("^[\\x00-\\x7F]*$")
    return F.when(plain, text).otherwise(nfkc(F.when(~plain, text)))


def normalize_query(text: Column) -> Column:
    """NFKC, lower case, no white space."""
    return F.regexp_replace(F.lower(folded(text)), "\\s+", "")


#: Short corporate forms and what they stand for.
CORPORATE_FORMS = (
    ("[(（]株[)）]|㈱", "株式会社"),
    ("[(（]有[)）]|㈲", "有限会社"),
    ("[(（]合[)）]", "合同会社"),
    ("[(（]財[)）]", "財団法人"),
    ("[(（]社[)）]", "社団法人"),
    ("[(（]独[)）]", "独立行政法人"),
)


def normalize_recipient_name(name: Column) -> Column:
    return reduce(lambda s, p: F.regexp_replace(s, *p), CORPORATE_FORMS, normalize_query(name))


def is_excluded_recipient(name: Column) -> Column:
    """Collective rows that are no recipient of their own. The names are fixed values."""
    return F.trim(folded(name)).isin("", "その他", "其他")


def is_dummy_number(number: Column) -> Column:
    return F.trim(number).rlike("^([0-9])\\1{12}$")


def is_valid_corporate_number(number: Column) -> Column:
    """13 digits, not all the same, whose first is 9 - (sum of the others, every second from the right doubled, mod 9)."""
    cn = F.trim(number)
    digit = lambda i: F.coalesce(F.substring(cn, i, 1).try_cast("int"), F.lit(0))
    total = reduce(lambda a, b: a + b, [digit(14 - n) * (1 if n % 2 else 2) for n in range(1, 13)])
    return F.coalesce(cn.rlike("^[0-9]{13}$") & ~is_dummy_number(cn) & (digit(1) == 9 - total % 9), F.lit(False))


def recipient_key(name: Column, number: Column) -> Column:
    return F.when(is_valid_corporate_number(number), F.trim(number)).otherwise(F.concat(F.lit("name:"), normalize_recipient_name(name)))


def excerpt_of(text: str, query: str, radius: int = 60, whole: int = 120) -> str:
    """Text around the first place where its normal form holds the normalized query; else its start."""
    chars, places = [], []
    for i, raw in enumerate(text):
        for c in unicodedata.normalize("NFKC", raw).lower():
            if not c.isspace():
                chars.append(c)
                places.append(i)
    at = "".join(chars).find(query)
    if at < 0 or not places:
        return text if len(text) <= whole else text[:whole] + "…"
    start = max(0, places[at] - radius)
    end = min(len(text), places[min(at + max(len(query), 1), len(places)) - 1] + 1 + radius)
    return ("…" if start else "") + text[start:end] + ("…" if end < len(text) else "")


def excerpt(text: Column, query: str) -> Column:
    """excerpt_of() as an Arrow UDF; query is normalized already."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else excerpt_of(t, query) for t in texts.to_pylist()], pa.string())

    return cut(text)


def terms(text: Column, stop: list[str] = ()) -> Column:
    """Distinct runs of 2-6 kanji or 3-10 katakana that aren't stop words. The ranges are fixed values."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("([一-龥]{2,6}|[ァ-ヶー]{3,10})"), 1))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found


def assembled(parts: list[Column], limit: int = 2000) -> Column:
    """Non-blank parts on lines of their own, slashes as spaces, cut to limit characters."""
    kept = F.filter(F.array(*parts), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.substring(F.replace(F.array_join(kept, "\n"), F.lit("/"), F.lit(" ")), 1, limit)


def text_key(*parts: Column, bits: int = 256) -> Column:
    """A digest of several columns, for folding equal rows before costly work."""
    joined = F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.sha1(joined) if bits == 160 else F.sha2(joined, bits)


# ---- labels --------------------------------------------------------------------------------------------------------


def account_category(has_general: Column, has_special: Column) -> Column:
    return (F.when(has_general & has_special, "both").when(has_general, "general").when(has_special, "special").otherwise("none"))


def account_label(category: Column) -> Column:
    return (F.when(category == "both", "一般会計+特別会計").when(category == "general", "一般会計").when(category == "special", "特別会計")
            .otherwise(""))


def bureau_leaf(path: Column) -> Column:
    return F.element_at(F.split(path, " / "), -1)


def org_path(levels: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*levels), lambda x: x.isNotNull() & (F.trim(x) != "")), " / ")


def flag_labels(flags: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))


def era_label(year: Column) -> Column:
    """Fiscal year in era notation, the first as 元."""
    n = lambda base: F.when(year == base + 1, "元").otherwise((year - base).cast("string"))
    return F.when(year >= 2019, F.concat(F.lit("令和"), n(2018), F.lit("年度"))).otherwise(F.concat(F.lit("平成"), n(1988), F.lit("年度")))


def format_yen(x: Column) -> Column:
    """Yen in tiers: 兆 with two places, 億 with none from 100 on and two below, 万, 円."""
    y = F.abs(x.cast("double"))
    sign = F.when(x < 0, "-").otherwise("")
    fixed = lambda v, p: F.regexp_replace(F.format_number(v, p), ",", "") if p else F.format_number(v, 0)
    body = (F.when(y >= 1e12, F.concat(fixed(y / 1e12, 2), F.lit("兆円"))).when(y >= 1e10, F.concat(fixed(y / 1e8, 0), F.lit("億円")))
            .when(y >= 1e8, F.concat(fixed(y / 1e8, 2), F.lit("億円"))).when(y >= 1e4, F.concat(fixed(y / 1e4, 0), F.lit("万円")))
            .otherwise(F.concat(fixed(y, 0), F.lit("円"))))
    return F.when(x.isNotNull(), F.concat(sign, body))


def opaque_level(name: Column, rules: list[tuple[str, str, int]]) -> Column:
    """Level of the first rule (pattern, exact|prefix|contains|regex, level) that a name meets, else 0."""
    tests = {"exact": lambda p: name == p, "prefix": lambda p: name.startswith(p) & (name != p),
             "contains": lambda p: name.contains(p) & (name != p), "regex": lambda p: name.rlike(p)}
    out = None
    for pattern, kind, level in rules:
        out = (F.when if out is None else out.when)(tests[kind](pattern), F.lit(level))
    return F.lit(0) if out is None else F.coalesce(out, F.lit(0))


#: Words of a flow's note that tell its kind.
NOTE_WORDS = {"reference": "参考", "transfer": "移替", "institutional": "融資|政府保証借入|利子補給"}


def note_kinds(note: Column) -> dict[str, Column]:
    """reference, transfer, institutional: what a note says of its flow; false without a note."""
    return {kind: F.coalesce(note.rlike(words), F.lit(False)) for kind, words in NOTE_WORDS.items()}
