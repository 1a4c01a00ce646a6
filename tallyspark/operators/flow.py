"""The flow graph: ministry -> project budget -> project spending -> recipient, as a nodes and an edges table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyspark.functions import semantics as S
from tallyspark.operators.prefix import ranked
from tallyspark.tables import held

NO_SPENDING = "r-no-spending"
NODE_COLUMNS = ("id", "name", "type", "value", "project_id", "ministry", "aggregated", "account_category", "subcontract_depth",
                "subcontract_recipients", "corporate_number", "corporate_numbers")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def cached(self) -> Graph:
        """For several queries over one graph: as written tables, in partitions of even size."""
        return Graph(*(held(x.hint("rebalance")) for x in (self.nodes, self.edges)))


def budget_summary(rows: DataFrame) -> DataFrame:
    """rows(pid, account, budget, executed) -> sums, execution rate in percent, account category, and the accounts' sums as an
    array in falling order."""
    by_account = rows.groupBy("pid", "account").agg(F.sum("budget").alias("budget"), F.sum("executed").alias("executed"))
    return (by_account.groupBy("pid").agg(
        F.sum("budget").alias("budget"), F.sum("executed").alias("executed"),
        S.account_category(F.bool_or(F.col("account") == "general"), F.bool_or(F.col("account") == "special")).alias("account_category"),
        F.sort_array(F.collect_list(F.struct("budget", "account", "executed")), asc=False).alias("accounts"))
        .withColumn("execution_rate", F.when(F.col("budget") > 0, F.col("executed").cast("double") / F.col("budget") * 100)))


def direct_rows(spending: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits spending(pid, block, ...) by links(pid, block, flag): a block is indirect if it's only ever flagged FALSE."""
    marked = links.groupBy("pid", "block").agg(F.bool_or("flag").alias("direct"), F.bool_or(~F.col("flag")).alias("indirect"))
    only = marked.where("indirect and not direct").select("pid", "block")
    return spending.join(only, ["pid", "block"], "left_anti"), spending.join(only, ["pid", "block"], "left_semi")


#: How a spending row is counted; the first that holds.
KINDS = ("no name", "no amount", "no block", "indirect", "direct")


def counted_rows(spending: DataFrame, projects: DataFrame, links: DataFrame) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """spending(pid, recipient, amount, block, ...) of the projects, each row with its kind, as a written table, and {kind: (rows, amount)}. The counts are
    observed while the table is written, so no second pass is made; blocks that links flag only FALSE are indirect."""
    marked = links.groupBy("pid", "block").agg(F.bool_or("flag").alias("direct"), F.bool_or(~F.col("flag")).alias("indirect"))
    only = marked.where("indirect and not direct").select("pid", "block", F.lit(True).alias("__only"))
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    own = spending.join(projects.select("pid").distinct(), "pid", "left_semi").join(only, ["pid", "block"], "left")
    kind = (F.when(text("recipient") == "", KINDS[0]).when(F.coalesce(F.col("amount"), F.lit(0)) <= 0, KINDS[1]).when(text("block") == "", KINDS[2])
            .when(F.col("__only"), KINDS[3]).otherwise(KINDS[4]))
    seen, rows = Observation(), own.withColumn("kind", kind).drop("__only")
    of = lambda k: F.col("kind") == k
    metrics = [x for i, k in enumerate(KINDS) for x in (F.count_if(of(k)).alias(f"n{i}"), F.coalesce(F.sum(F.when(of(k), F.col("amount"))), F.lit(0)).alias(f"s{i}"))]
    table = held(rows.observe(seen, *metrics))
    return table, {k: (seen.get[f"n{i}"], seen.get[f"s{i}"]) for i, k in enumerate(KINDS)}


def recipient_projects(spending: DataFrame) -> DataFrame:
    """What each recipient has of each project: recipient, pid, amount, numbers (its numbers there by amount, largest first)."""
    by_number = spending.groupBy("recipient", "pid", "number").agg(F.sum("amount").alias("amount"))
    named = F.struct(F.col("amount").alias("amount"), F.col("number").alias("number"))
    return by_number.groupBy("recipient", "pid").agg(F.sum("amount").alias("amount"), F.transform(F.sort_array(F.collect_list(
        F.when(F.coalesce("number", F.lit("")).rlike("^[0-9]{13}$"), named)), asc=False), lambda x: x["number"]).alias("numbers"))


def recipients_of(spending: DataFrame) -> DataFrame:
    """spending(pid, recipient, number, amount) -> a row for each recipient name: total, the number with the largest amount,
    how many numbers, and an id by its rank by total."""
    numbers = (spending.where("number is not null and number <> ''").groupBy("recipient", "number").agg(F.sum("amount").alias("amount"))
               .groupBy("recipient").agg(F.max_by("number", F.struct("amount", "number")).alias("corporate_number"),
                                         F.count(F.lit(1)).alias("corporate_numbers")))
    sums = spending.groupBy("recipient").agg(F.sum("amount").alias("total")).join(numbers, "recipient", "left")
    return ranked(sums, F.desc("total"), F.col("recipient")).withColumn("id", F.concat(F.lit("r-"), "rank")).drop("rank", "n")


def project_sums(projects: DataFrame, budgets: DataFrame, spending: DataFrame) -> DataFrame:
    """projects with their budget (0 where there is none, has_budget tells), account category and what they spent: all that a comparison of years needs."""
    spent = spending.where("amount > 0").groupBy("pid").agg(F.sum("amount").alias("spent"))
    p = projects.join(budgets.select("pid", "budget", "account_category"), "pid", "left").join(spent, "pid", "left")
    return p.withColumns({"has_budget": F.col("budget").isNotNull(), "budget": F.coalesce("budget", F.lit(0)), "spent": F.coalesce("spent", F.lit(0))})


def build_graph(projects: DataFrame, budgets: DataFrame, spending: DataFrame, subcontracts: DataFrame | None = None) -> Graph:
    """projects(pid, name, ministry), budgets(pid, budget, account_category), spending(pid, recipient, number, amount) of direct
    spending only, subcontracts(pid, depth, names). Projects are the universe: other rows of theirs are dropped."""
    # read four times below, and made of the largest tables
    spending = held(spending.where("amount > 0").join(projects.select("pid"), "pid", "left_semi"))
    p = project_sums(projects, budgets, spending)
    if subcontracts is not None:
        p = p.join(subcontracts.select("pid", F.col("depth").alias("subcontract_depth"), F.col("names").alias("subcontract_recipients")), "pid", "left")
    # each is read several times below
    p, recipients = held(p), recipients_of(spending)
    name = lambda prefix, c="pid": F.concat(F.lit(prefix), F.col(c))

    def nodes(df: DataFrame, **cols) -> DataFrame:
        types = {"value": "long", "project_id": "long", "aggregated": "boolean", "subcontract_depth": "int",
                 "subcontract_recipients": "array<string>", "corporate_numbers": "long"}
        return df.select(*[cols.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in NODE_COLUMNS])

    no, yes = F.lit(False), F.col("budget") > 0
    ministries = p.where("has_budget and trim(ministry) <> ''").groupBy("ministry").agg(F.sum("budget").alias("value"))
    unpaid = p.where("budget > 0 and spent = 0")
    all_nodes = [
        nodes(budgets.agg(F.sum("budget").alias("value")), id=F.lit("total"), name=F.lit("予算総計"), type=F.lit("total"),
              value=F.coalesce("value", F.lit(0)), aggregated=no),
        nodes(ministries, id=name("ministry-", "ministry"), name=F.col("ministry"), type=F.lit("ministry"), value=F.col("value"),
              ministry=F.col("ministry"), aggregated=no),
        nodes(p, id=name("project-budget-"), name=F.col("name"), type=F.lit("project-budget"), value=F.col("budget"), project_id=F.col("pid"),
              ministry=F.col("ministry"), aggregated=no, account_category=F.col("account_category"),
              **({c: F.col(c) for c in ("subcontract_depth", "subcontract_recipients")} if subcontracts is not None else {})),
        nodes(p, id=name("project-spending-"), name=F.col("name"), type=F.lit("project-spending"), value=F.col("spent"),
              project_id=F.col("pid"), ministry=F.col("ministry"), aggregated=no),
        nodes(recipients, id=F.col("id"), name=F.col("recipient"), type=F.lit("recipient"), value=F.col("total"), aggregated=no,
              corporate_number=F.col("corporate_number"), corporate_numbers=F.col("corporate_numbers")),
        nodes(unpaid.limit(1), id=F.lit(NO_SPENDING), name=F.lit("支出先なし"), type=F.lit("recipient"), value=F.lit(0), aggregated=no),
    ]
    flow = F.least("budget", "spent")
    edge = lambda df, a, b, v: df.select(a.alias("source"), b.alias("target"), v.cast("long").alias("value"))
    paid = spending.groupBy("pid", "recipient").agg(F.sum("amount").alias("amount")).join(recipients.select("recipient", "id"), "recipient")
    all_edges = [
        edge(ministries.where("value > 0"), F.lit("total"), name("ministry-", "ministry"), F.col("value")),
        edge(p.where(yes), name("ministry-", "ministry"), name("project-budget-"), F.col("budget")),
        edge(p.where(flow > 0), name("project-budget-"), name("project-spending-"), flow),
        edge(paid, name("project-spending-"), F.col("id"), F.col("amount")),
        edge(unpaid, name("project-spending-"), F.lit(NO_SPENDING), F.lit(0)),
    ]
    return Graph(_union(all_nodes), _union(all_edges))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def dangling_edges(graph: Graph) -> DataFrame:
    """Edges with an end that isn't a node; none in a sound graph."""
    ids = graph.nodes.select("id")
    missing = lambda end: graph.edges.join(ids, graph.edges[end] == ids["id"], "left_anti")
    return missing("source").unionByName(missing("target")).distinct()


def conservation(graph: Graph) -> DataFrame:
    """Project spending nodes whose edges to recipients don't sum to their value; none in a sound graph."""
    out = graph.edges.where(F.col("target").startswith("r-")).groupBy("source").agg(F.sum("value").alias("out"))
    s = graph.nodes.where("type = 'project-spending'").select("id", "value")
    return s.join(out, s["id"] == out["source"], "left").where(F.col("value") != F.coalesce("out", F.lit(0))).select("id", "value", "out")
