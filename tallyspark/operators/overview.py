"""The budget book's overview: what each account takes in and spends in a year, transfers between accounts, and the flow from sources over accounts to uses.

rows(year, kind general|special|agency, side revenue|expenditure, account, sub_account, category, item, purpose, amount) are the book's lines. Totals and groups are
sums over them; nodes and links are made of one row a year and of the groups' largest names, so nothing but groups is sorted. A transfer whose sender is the
receiving account itself would be a cycle: it is a source of its own, marked as counted again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.operators.budget import account_summary
from tallyspark.tables import held

#: How the lines name taxes, transfers and receipts; codes of purposes.
TAX, MISC, FROM_OTHER, FROM_SUB, FROM_GENERAL, TRANSFER = "租税", "諸収入", "他会計より受入", "他勘定より受入", "一般会計より受入", "6"
RECEIPTS = ("特別会計受入金", "特別会計整理収入", "特別会計等負担金")
PURPOSES = {"1": "人件費", "2": "旅費", "3": "物件費", "4": "施設費", "5": "補助費・委託費", "6": "他会計へ繰入", "9": "その他"}
UNKNOWN_PURPOSE = "分類不明"
#: A source stands alone from this share on; so many do at most, of taxes fewer.
SHARE, MOST, MOST_TAXES = 0.01, 8, 6


def flagged(rows: DataFrame) -> DataFrame:
    """rows plus transfer_in, transfer_out, between_sub_accounts and from_special, by the lines' names and purposes."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    revenue = F.col("side") == "revenue"
    return rows.withColumns({
        "transfer_in": revenue & ((text("category") == FROM_OTHER) | F.contains(text("item"), F.lit(FROM_GENERAL))),
        "transfer_out": ~revenue & (text("purpose") == TRANSFER),
        "between_sub_accounts": revenue & (text("category") == FROM_SUB),
        "from_special": revenue & (F.col("kind") == "general") & reduce(lambda a, b: a | b, [text("item").endswith(x) for x in RECEIPTS])})


def totals(rows: DataFrame) -> DataFrame:
    """flagged rows -> a row a year of the sums that the overview has."""
    def s(name: str, test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("amount"))), F.lit(0)).alias(name)

    kind, revenue, special = F.col("kind"), F.col("side") == "revenue", F.col("kind") == "special"
    sums = [s(f"{k}_{side}", (kind == k) & (revenue if side == "revenue" else ~revenue)) for k in ("general", "special", "agency") for side in ("revenue", "expenditure")]
    sums += [s("general_to_other", (kind == "general") & F.col("transfer_out")), s("special_to_other", special & F.col("transfer_out")),
             s("received_by_special", special & F.col("transfer_in")), s("received_between_sub_accounts", special & F.col("between_sub_accounts")),
             s("special_to_general", F.col("from_special")), s("special_own", special & revenue & ~F.col("transfer_in") & ~F.col("between_sub_accounts"))]
    t = rows.groupBy("year").agg(*sums)
    t = t.withColumns({"general_net": F.col("general_expenditure") - F.col("general_to_other"), "special_net": F.col("special_expenditure") - F.col("special_to_other"),
                       "gross": F.col("general_expenditure") + F.col("special_expenditure") + F.col("agency_expenditure")})
    return t.withColumn("net", F.col("gross") - F.col("received_by_special") - F.col("received_between_sub_accounts"))


def groups(rows: DataFrame) -> DataFrame:
    """flagged rows -> year, list, name, amount: the sums by name of each list of the overview; lines without a name are in none."""
    kind, revenue = F.col("kind"), F.col("side") == "revenue"
    purpose = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PURPOSES.items() for x in p]), F.coalesce("purpose", F.lit(""))), F.lit(UNKNOWN_PURPOSE))
    own = ~F.col("transfer_in") & ~F.col("between_sub_accounts")
    lists = [("general.category", (kind == "general") & revenue, F.col("category")), ("general.taxes", (kind == "general") & revenue & (F.col("category") == TAX), F.col("item")),
             ("general.from_special", F.col("from_special"), F.col("item")), ("general.purpose", (kind == "general") & ~revenue, purpose),
             ("general.destination", (kind == "general") & F.col("transfer_out"), F.col("item")), ("special.category", (kind == "special") & revenue, F.col("category")),
             ("special.own", (kind == "special") & revenue & own, F.col("category")), ("special.purpose", (kind == "special") & ~revenue, purpose),
             ("special.destination", (kind == "special") & F.col("transfer_out"), F.col("item")), ("agency.category", (kind == "agency") & revenue, F.col("category")),
             ("agency.agency", (kind == "agency") & ~revenue, F.col("account"))]
    # a line is in several lists: an entry for each, summed before the shuffle
    entry = F.filter(F.array(*[F.struct(F.when(test, F.lit(n)).alias("list"), name.alias("name")) for n, test, name in lists]),
                     lambda x: x["list"].isNotNull() & (F.coalesce(x["name"], F.lit("")) != ""))
    return (rows.select("year", "amount", F.explode(entry).alias("e")).groupBy("year", F.col("e.list").alias("list"), F.col("e.name").alias("name"))
            .agg(F.sum("amount").alias("amount")))


def split(named: DataFrame, total: DataFrame, most: int = MOST) -> DataFrame:
    """named(year, name, amount), total(year, total) -> year, name (null: all others), amount: the largest names of at least SHARE of the total; amounts above zero only.
    The window is over a list's names."""
    rank = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("amount"), "name"))
    ranked = named.where("amount > 0").withColumn("rank", rank).join(total, "year")
    alone = (F.col("total") > 0) & (F.col("amount") / F.nullif("total", F.lit(0)) >= SHARE) & (F.col("rank") <= most)
    return ranked.groupBy("year", F.when(alone, F.col("name")).alias("name")).agg(F.sum("amount").alias("amount"))


def sources(g: DataFrame, t: DataFrame) -> DataFrame:
    """year, id, name, value, target of the sources that stand alone and of the others of each list."""
    of = lambda name: g.where(F.col("list") == name).select("year", "name", "amount")
    category, taxes = of("general.category"), of("general.taxes")
    # receipts from special accounts are a source of their own: they leave the categories first, those of an unknown one the miscellaneous
    known = category.select("year", F.col("name").alias("__c"))
    received = of("general.from_special").join(known.withColumn("name", F.col("__c")), ["year", "name"], "left")
    less = received.groupBy("year", F.coalesce("__c", F.lit(MISC)).alias("name")).agg(F.sum("amount").alias("less"))
    others = (category.where(F.col("name") != TAX).join(less, ["year", "name"], "left")
              .select("year", "name", F.greatest(F.col("amount") - F.coalesce("less", F.lit(0)), F.lit(0)).alias("amount")))
    whole = lambda c: t.select("year", F.col(c).alias("total"))
    tax_total = category.where(F.col("name") == TAX).select("year", F.col("amount").alias("total"))
    lists = [("src-tax-", "その他の租税", "", split(taxes, tax_total, MOST_TAXES), "account-general"),
             ("src-general-", "その他の歳入", "", split(others, whole("general_revenue")), "account-general"),
             ("src-special-", "その他の特会歳入", "（特会）", split(of("special.own"), whole("special_own")), "account-special")]
    return reduce(lambda a, b: a.unionByName(b), [s.select("year", F.concat(F.lit(prefix), F.coalesce("name", F.lit("other"))).alias("id"), F.coalesce(
        F.concat("name", F.lit(suffix)), F.lit(rest)).alias("name"), F.col("amount").alias("value"), F.lit(target).alias("target")) for prefix, rest, suffix, s, target in lists])


def fixed_nodes() -> list[tuple[str, str, str, Column, bool]]:
    """(id, name, type, value, whether it is there without a value) of the nodes that are no single source."""
    c = F.col
    agency = F.when(c("agency_expenditure") > 0, c("agency_expenditure"))
    return [
        ("src-from-special", "特別会計からの受入", "source", c("special_to_general"), False),
        ("src-agency", "政府関係機関の収入", "source", F.when(c("agency_expenditure") > 0, c("agency_revenue")), False),
        ("src-agency-shortfall", "政府関係機関の収入不足", "source", F.when(c("agency_expenditure") > 0, c("agency_expenditure") - c("agency_revenue")), False),
        ("account-general", "一般会計", "account", c("general_revenue"), True), ("account-special", "特別会計", "account", c("special_revenue"), True),
        ("account-agency", "政府関係機関", "account", agency, False),
        ("src-special-reentry", "特別会計間の繰入（再掲）", "transfer", c("received_by_special") - c("general_to_other"), False),
        ("src-subaccount-reentry", "勘定間の繰入（再掲）", "transfer", c("received_between_sub_accounts"), False),
        ("net-general", "一般会計の実支出", "net-expenditure", c("general_net"), True),
        ("surplus-general", "一般会計の歳入超過", "surplus", c("general_revenue") - c("general_expenditure"), False),
        ("transfer-special", "特別会計間の再繰入", "transfer", c("special_to_other"), False), ("net-special", "特別会計の実支出", "net-expenditure", c("special_net"), True),
        ("surplus-special", "特別会計の歳入超過", "surplus", c("special_revenue") - c("special_expenditure"), False),
        ("net-agency", "政府関係機関の支出", "net-expenditure", agency, False)]


#: Links of those nodes that aren't sources' own.
FLOWS = (("src-from-special", "account-general"), ("src-agency", "account-agency"), ("src-agency-shortfall", "account-agency"), ("src-special-reentry", "account-special"),
         ("src-subaccount-reentry", "account-special"), ("account-general", "net-general"), ("account-general", "surplus-general"), ("account-special", "transfer-special"),
         ("account-special", "net-special"), ("account-special", "surplus-special"), ("account-agency", "net-agency"))


def overview(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: year, id, name, type, value, is_deduction; links: year, source, target, value) of every year of the rows."""
    rows = flagged(rows)
    t, g = held(totals(rows)), held(groups(rows))
    own = held(sources(g, t))
    fixed = fixed_nodes()
    node = lambda i, name, kind, v, always: F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), F.lit(kind).alias("type"), v.cast("long").alias("value"), F.lit(always).alias("always"))
    made = t.select("year", F.explode(F.array(*[node(*x) for x in fixed])).alias("n")).select("year", "n.*").where("always or value > 0").drop("always")
    nodes = made.unionByName(own.select("year", "id", "name", F.lit("source").alias("type"), F.col("value").cast("long").alias("value")))
    nodes = nodes.withColumn("is_deduction", F.col("type") == "transfer")
    value = {i: v for i, _, _, v, _ in fixed}
    pairs = [(a, b, value[b] if a.startswith("account") else value[a]) for a, b in FLOWS] + [("account-general", "account-special", F.col("general_to_other"))]
    link = lambda a, b, v: F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), v.cast("long").alias("value"))
    links = t.select("year", F.explode(F.array(*[link(*x) for x in pairs])).alias("l")).select("year", "l.*")
    links = links.unionByName(own.select("year", F.col("id").alias("source"), "target", F.col("value").cast("long").alias("value"))).where("value > 0")
    return nodes, links


def balance(links: DataFrame) -> DataFrame:
    """year, id, inflow, outflow of each account: a sound overview has inflow = outflow where a year's accounts aren't in deficit."""
    ends = links.select("year", F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).cast("long").alias("i"), F.col("value").alias("o")),
                                                  F.struct(F.col("target").alias("id"), F.col("value").alias("i"), F.lit(0).cast("long").alias("o")))).alias("e"))
    return ends.where(F.col("e.id").startswith("account-")).groupBy("year", "e.id").agg(F.sum("e.i").alias("inflow"), F.sum("e.o").alias("outflow"))


def special_accounts(rows: DataFrame) -> DataFrame:
    """A row for each special account (see account_summary) of rows of one year."""
    own = flagged(rows).where("kind = 'special' and account <> ''")
    return account_summary(own.withColumn("sub_account", F.when((F.col("side") == "expenditure") & (F.col("sub_account") != ""), F.col("sub_account"))))
