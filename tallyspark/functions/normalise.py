"""The text normalisation of the released sheets, step by step, for columns. All but NFKC, which only texts beyond ASCII go through, is done on the JVM.

Of the first of the nine steps, a library's rules for Japanese prose, what is written out here is done: half-width forms (by NFKC), hyphens, repeated long vowel marks and blanks
between Japanese characters. Its tilde removal and its own tables aren't reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import semantics as S

#: Eras and the year before their first; hyphens and dashes that become one; the kana that a long vowel mark may follow.
ERAS = {"明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018}
HYPHENS = "˗‐‑‒–—―⁃⁻₋−﹣－─━"
KATAKANA = "ァ-ヺ"
ERA_YEAR = rf"({'|'.join(ERAS)})\s*(元|[0-9]{{1,2}})\s*年"


def era_to_year(text: Column) -> Column:
    """Years in era notation as years of the common era, all in one pass: what lies between them is kept."""
    base = F.create_map(*[F.lit(x) for pair in ERAS.items() for x in pair])

    def year(x: Column) -> Column:
        n = F.when(x["n"] == "元", F.lit(1)).otherwise(x["n"].try_cast("int"))
        return F.concat(F.coalesce(x["gap"], F.lit("")), F.coalesce(F.concat((F.element_at(base, x["era"]) + n).cast("string"), F.lit("年")), F.lit("")))

    pieces = F.arrays_zip(F.split(text, ERA_YEAR, -1).alias("gap"), F.regexp_extract_all(text, F.lit(ERA_YEAR), 1).alias("era"), F.regexp_extract_all(text, F.lit(ERA_YEAR), 2).alias("n"))
    return F.when(text.rlike(ERA_YEAR), F.array_join(F.transform(pieces, year), "")).otherwise(text)


def brackets(text: Column) -> Column:
    return F.translate(text, "（）［］｛｝〔〕", "()[]{}()")


def hyphens(text: Column) -> Column:
    return F.translate(text, HYPHENS, "-" * len(HYPHENS))


def hyphen_to_long_vowel(text: Column) -> Column:
    """A hyphen after a katakana is a long vowel mark."""
    return F.regexp_replace(text, rf"(?<=[{KATAKANA}])-", "ー")


def long_vowels(text: Column) -> Column:
    """Repeated long vowel marks after a katakana, blanks between them too, are one."""
    return F.regexp_replace(text, rf"(?<=[{KATAKANA}])(?:\s*ー)+", "ー")


def single_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def joined_japanese(text: Column) -> Column:
    """No blank between two Japanese characters."""
    kana = "ぁ-ヿ一-鿿"
    return F.regexp_replace(text, rf"(?<=[{kana}]) +(?=[{kana}])", "")


def normalised(text: Column) -> Column:
    """All steps in their order: NFKC (which makes digits of circled numbers, 0 to 50, too), era years, brackets, hyphens, long vowels, blanks. Null stays null."""
    for step in (S.folded, era_to_year, brackets, hyphens, hyphen_to_long_vowel, long_vowels, single_spaces, joined_japanese):
        text = step(text)
    return text
