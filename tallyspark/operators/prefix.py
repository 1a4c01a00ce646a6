"""Running sums and ranks over rows of any number.

A window without a partition puts all rows into one task. Up to ONE_TASK rows, counted in a written table, that is what a task is for; beyond it the
rows are sorted into ranges, each range is summed by a task of its own, and what the ranges before it hold is added: two phases, the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.tables import held

#: Rows of a group that one task sorts.
ONE_TASK = 200_000


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = (), totals: bool = False, limit: int | None = None) -> DataFrame:
    """df plus, for each name in sums, the sum of that value over the rows up to and with each one, in order (unique within a group), in all or by groups;
    totals: also {name}_all, the whole group's sum. A null counts as nothing. limit: rows in all up to which one task sorts a group."""
    df = held(df.withColumns({f"__{k}": v for k, v in sums.items()}))
    whole = Window.partitionBy(*by)
    if df.count() <= (ONE_TASK if limit is None else limit):
        w = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumns({k: F.coalesce(F.sum(f"__{k}").over(w), F.lit(0)) for k in sums} | ({f"{k}_all": F.sum(f"__{k}").over(whole) for k in sums} if totals else {}))
        return out.drop(*[f"__{k}" for k in sums])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held(df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    # a row for each range and group
    parts = dealt.groupBy(*by, "__part").agg(*[F.sum(f"__{k}").alias(f"__t_{k}") for k in sums])
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(*by, "__part", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums],
                         *[F.sum(f"__t_{k}").over(whole).alias(f"{k}_all") for k in sums if totals])
    own = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({k: F.coalesce(F.sum(f"__{k}").over(own), F.lit(0)) for k in sums})
    # a group may be null
    match = [local[c].eqNullSafe(bases[c]) for c in by] + [local["__part"] == bases["__part"]]
    both = local.join(bases, match).select(*[local[c] for c in df.columns if c not in {f"__{k}" for k in sums}], *[(local[k] + bases[f"__b_{k}"]).alias(k) for k in sums],
                                           *[bases[f"{k}_all"] for k in sums if totals])
    return held(both)


def ranked(df: DataFrame, *order: Column, limit: int | None = None) -> DataFrame:
    """df plus rank, from 1 on, by an order without ties, and n, how many rows there are."""
    return running(df, list(order), {"rank": F.lit(1).cast("long")}, totals=True, limit=limit).withColumnRenamed("rank_all", "n")


def elements(df: DataFrame, value: str, places: dict[str, Column], by: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """A row (for each group): n, and {name: place as an expression of n} as elements, from 0 on, of the sorted values that aren't null. Rows are counted by value first."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = running(counted, [F.col("v")], {"upto": F.col("c")}, by, totals=True, limit=limit).withColumnRenamed("upto_all", "n")
    return upto.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > F.least(place, F.col("n") - 1), F.col("v"))).alias(name) for name, place in places.items()])
