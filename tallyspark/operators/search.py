"""Text search over normalized text: names, aliases, and spending with an aggregate over all hits."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import semantics as S

#: Rows of a page at most; a fixed value.
MOST = 100


def normalized(query: str) -> str:
    return "".join(unicodedata.normalize("NFKC", query).lower().split())


def page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of an answer: limit rows from offset on, MOST at most."""
    return df.offset(offset).limit(min(limit, MOST))


def page_info(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row beside a page: total, how many rows there are in all, and next_offset, where the next page begins (null after the last)."""
    after = offset + min(limit, MOST)
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("next_offset", F.when(F.col("total") > after, F.lit(after)))


def with_normal(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_norm; done once, when rows are stored."""
    return rows.withColumns({f"{c}_norm": S.normalize_query(F.coalesce(F.col(c), F.lit(""))) for c in columns})


def search_projects(items: DataFrame, query: str, details: DataFrame | None = None, sort_by: str = "budget") -> DataFrame:
    """items(pid, name_norm, budget, spending) that hold the query in their name, or in details(pid, text_norm); matched_in says where."""
    q = normalized(query)
    if not q:
        return items.limit(0).withColumn("matched_in", F.lit("name"))
    hit = F.when(F.contains("name_norm", F.lit(q)), "name")
    if details is not None:
        items = items.join(details.where(F.contains("text_norm", F.lit(q))).select("pid", F.lit(True).alias("__d")).distinct(), "pid", "left")
        hit = hit.when(F.col("__d"), "details")
    return items.withColumn("matched_in", hit).where("matched_in is not null").drop("__d").orderBy(F.desc(sort_by), "pid")


def search_recipients(index: DataFrame, query: str) -> DataFrame:
    """index(key, aliases_norm, direct_amount, subcontract_amount) with the query in any spelling, by the larger amount."""
    q = normalized(query)
    hits = index.where(F.exists("aliases_norm", lambda a: F.contains(a, F.lit(q)))) if q else index.limit(0)
    return hits.orderBy(F.desc(F.greatest("direct_amount", "subcontract_amount")), "key")


def spending_hits(rows: DataFrame, query: str, excerpts: bool = True) -> DataFrame:
    """rows(pid, role, cc, role_norm, cc_norm, amount, depth) that hold the query (two characters at least) in the role, else in the contract."""
    q = normalized(query)
    if len(q) < 2:
        return rows.limit(0).withColumn("matched_in", F.lit("role"))
    at = F.when(F.contains("role_norm", F.lit(q)), "role").when(F.contains("cc_norm", F.lit(q)), "cc")
    hits = rows.withColumn("matched_in", at).where("matched_in is not null")
    if excerpts:
        hits = hits.withColumn("excerpt", S.excerpt(F.coalesce(F.when(F.col("matched_in") == "role", F.col("role")).otherwise(F.col("cc")), F.lit("")), q))
    return hits.orderBy(F.desc(F.coalesce("amount", F.lit(0))), "pid")


def spending_totals(hits: DataFrame) -> DataFrame:
    """One row over all hits; direct and subcontract amounts are never added up."""
    a = F.coalesce("amount", F.lit(0))
    return hits.agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("pid").alias("projects"),
                    F.coalesce(F.sum(F.when(F.col("depth") > 0, 0).otherwise(a)), F.lit(0)).alias("direct"),
                    F.coalesce(F.sum(F.when(F.col("depth") > 0, a)), F.lit(0)).alias("subcontract"))


def spending_projects(hits: DataFrame, n: int = 10) -> DataFrame:
    a = F.coalesce("amount", F.lit(0))
    by = hits.groupBy("pid").agg(F.sum(F.when(F.col("depth") > 0, 0).otherwise(a)).alias("direct"), F.sum(F.when(F.col("depth") > 0, a).otherwise(0)).alias("subcontract"))
    return by.orderBy(F.desc(F.col("direct") + F.col("subcontract")), "pid").limit(n)
