"""Recipients across projects: keys, resolution against a register, the inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import semantics as S


def resolved_keys(rows: DataFrame, merged: DataFrame | None = None, supplement: DataFrame | None = None) -> DataFrame:
    """rows(name, number, ...) plus key. merged(norm, number, to) corrects pairs of a name and a valid number; supplement(norm, to) gives a
    number to names without a valid one. Else the key is the valid number, or name: and the normal form."""
    out = rows.withColumns({"norm": S.normalize_recipient_name(F.col("name")), "valid": S.is_valid_corporate_number(F.col("number"))})
    merge = supply = F.lit(None).cast("string")
    if merged is not None:
        out = out.join(merged.select("norm", F.col("number").alias("number"), F.col("to").alias("__merge")), ["norm", "number"], "left")
        merge = F.col("__merge")
    if supplement is not None:
        out = out.join(supplement.select("norm", F.col("to").alias("__supply")), "norm", "left")
        supply = F.col("__supply")
    key = F.when(F.col("valid"), F.coalesce(merge, F.trim("number"))).otherwise(F.coalesce(supply, F.concat(F.lit("name:"), "norm")))
    return out.withColumn("key", key).drop("__merge", "__supply", "valid", "norm")


def resolution(rows: DataFrame, register: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From register(number, name): (merged, supplement) for resolved_keys(). A name with several valid numbers is merged into the one whose
    register name it is, if that's one; a name without a valid number gets the one register entry of that name."""
    seen = rows.select("name", "number").distinct().withColumns(
        {"norm": S.normalize_recipient_name(F.col("name")), "valid": S.is_valid_corporate_number(F.col("number"))})
    official = register.select("number", S.normalize_recipient_name(F.col("name")).alias("norm"))
    true = seen.where("valid").select("norm", "number").distinct().join(official, ["norm", "number"])
    to = true.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("to")).where("n = 1").select("norm", "to")
    merged = seen.where("valid").select("norm", "number").distinct().join(to, "norm").where("number <> to")
    unique = official.groupBy("norm").agg(F.countDistinct("number").alias("n"), F.min("number").alias("to")).where("n = 1").select("norm", "to")
    return merged, seen.where("not valid").select("norm").distinct().join(unique, "norm")


def index(appearances: DataFrame) -> DataFrame:
    """appearances(key, name, pid, ministry, is_direct, amount) -> a row a key: totals apart for direct and subcontract, spellings
    by frequency (the first is the name), and ministries by size."""
    named = appearances.where(~S.is_excluded_recipient(F.col("name")))
    names = (named.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "name"))), lambda x: x["name"]).alias("aliases")))
    part = lambda c, d: F.sum(F.when(F.col("is_direct") == d, c).otherwise(0))
    sums = [part(F.col("amount"), True).alias("direct_amount"), part(F.lit(1), True).alias("direct_count"),
            part(F.col("amount"), False).alias("subcontract_amount"), part(F.lit(1), False).alias("subcontract_count")]
    by = by_ministry(named).withColumn("size", -(F.col("direct_amount") + F.col("subcontract_amount"))).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("size", "ministry", "direct_amount", "subcontract_amount", "project_count"))).alias("ministries"))
    return (named.groupBy("key").agg(*sums).join(names, "key").join(by, "key")
            .withColumns({"name": F.col("aliases")[0], "number": F.when(F.col("key").rlike("^[0-9]{13}$"), F.col("key")).otherwise("")}))


def by_ministry(appearances: DataFrame) -> DataFrame:
    return appearances.groupBy("key", "ministry").agg(
        F.sum(F.when(F.col("is_direct"), F.col("amount")).otherwise(0)).alias("direct_amount"),
        F.sum(F.when(~F.col("is_direct"), F.col("amount")).otherwise(0)).alias("subcontract_amount"),
        F.countDistinct("pid").alias("project_count"))


def representative_names(appearances: DataFrame) -> DataFrame:
    """The most frequent spelling of each key; the smallest on ties."""
    n = appearances.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("key").agg(F.min_by(F.struct("name", "n"), F.struct((-F.col("n")).alias("o"), "name")).alias("x")).select("key", "x.name", "x.n")


def find_key(wanted: DataFrame, entries: DataFrame, redirects: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted(asked) plus key: itself if it's an entry, else where it redirects to, else the entry with that spelling and the most appearances.
    entries(key), redirects(key, to), aliases(alias, key, n)."""
    best = aliases.groupBy(F.col("alias").alias("asked")).agg(F.max_by("key", F.struct("n", "key")).alias("__alias"))
    return (wanted.join(entries.select(F.col("key").alias("asked"), F.col("key").alias("__own")), "asked", "left")
            .join(redirects.select(F.col("key").alias("asked"), F.col("to").alias("__to")), "asked", "left").join(best, "asked", "left")
            .select("asked", F.coalesce("__own", "__to", "__alias").alias("key")))


def number_quality(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(name, number, amount): names with several numbers, numbers with several names, and sums of rows with bad numbers by kind."""
    filled = rows.where("trim(number) <> ''")
    per_name = filled.groupBy("name").agg(F.array_sort(F.collect_set("number")).alias("numbers")).where(F.size("numbers") >= 2)
    per_number = filled.groupBy("number").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") >= 2)
    kind = (F.when(S.is_dummy_number(F.col("number")), "dummy").when(~F.trim("number").rlike("^[0-9]{13}$"), "format")
            .when(~S.is_valid_corporate_number(F.col("number")), "check digit"))
    bad = filled.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return per_name, per_number, bad
