"""The engine's API over the tables of one or more years: what an application's routes call."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import semantics as S
from tallyspark.operators import blocks, budget, filters, outcomes, overview, pages, screening, search, shaping, summary, windows
from tallyspark.operators.flow import Graph
from tallyspark.plans.query import Query, from_url, resolve


#: Distinct projects whose scores a call may ask for.
MAX_PIDS = 300


class QueryError(ValueError):
    """The query is wrong; args[0] lists how."""


@dataclass
class Engine:
    """graphs by year; the other tables are optional and by their names in the operators."""

    graphs: dict[str, Graph]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def parse(query: dict | str) -> Query:
        q, errors = resolve(from_url(query) if isinstance(query, str) else query)
        if errors:
            raise QueryError(errors)
        return q

    def filtered(self, query: dict | str, year: str | None = None) -> Graph:
        q = self.parse(query)
        g = self.graphs[year or q.year]
        return filters.applied(g, filters.excluded(g, q.filter, [q.view.pin_project], self.tables.get("excluded_projects")))

    def query(self, query: dict | str) -> DataFrame:
        return summary.totals(self.filtered(query))

    def topn(self, query: dict | str) -> windows.Windowed:
        q = self.parse(query)
        g = self.filtered(query)
        return windows.windowed(g, windows.clamped(g, q.view), recipient_filter=bool(q.filter.recipient_name))

    def topn_order(self, query: dict | str) -> DataFrame:
        """id, place: the order of the projects in the answer of topn()."""
        q = self.parse(query)
        g = self.filtered(query)
        view = windows.clamped(g, q.view)
        return windows.display_order(windows.windowed(g, view, recipient_filter=bool(q.filter.recipient_name)), view)

    def topn_counts(self, query: dict | str) -> DataFrame:
        return windows.totals(self.topn(query))

    def compare(self, query: dict | str, base: str, compare: str) -> DataFrame:
        return summary.compare_projects(self.filtered(query, base), self.filtered(query, compare))

    def search_projects(self, text: str, limit: int = 20, offset: int = 0, details: bool = False, sort_by: str = "budget") -> DataFrame:
        return search.page(search.search_projects(self.tables["projects"], text, self.tables["details"] if details else None, sort_by), limit, offset)

    def search_recipients(self, text: str, limit: int = 20, offset: int = 0) -> DataFrame:
        return search.page(search.search_recipients(self.tables["recipients"], text), limit, offset)

    def search_spending(self, text: str, limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(hits of the page, totals over all hits, largest projects)."""
        hits = search.spending_hits(self.tables["spending"], text)
        return search.page(hits, limit, offset), search.spending_totals(hits), search.spending_projects(hits)

    def recipient(self, key: str) -> DataFrame:
        return self.tables["recipients"].where(F.col("key") == key)

    def subcontracts(self, pid: int) -> DataFrame:
        return self.tables["flows"].where(F.col("pid") == pid)

    def subcontract_chain(self, pid: int, n: int = 10) -> DataFrame:
        return blocks.chains(self.subcontracts(pid), self.tables["blocks"].where(F.col("pid") == pid), n)

    def scores(self, pids: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """(scores, requested pids that have none). With pids: those of the distinct ones, in their order; more than MAX_PIDS are refused."""
        s = self.tables["scores"]
        if pids is None:
            return s, s.select("pid").limit(0)
        wanted = list(dict.fromkeys(pids))
        if not wanted:
            raise QueryError(["pids: none given"])
        if len(wanted) > MAX_PIDS:
            raise QueryError([f"pids: {MAX_PIDS} at most ({len(wanted)} given)"])
        asked = F.broadcast(s.sparkSession.createDataFrame(list(enumerate(wanted)), "__place int, pid long"))  # MAX_PIDS rows
        found = s.join(asked, "pid")
        missing = asked.join(found.select("pid"), "pid", "left_anti").orderBy("__place").select("pid")
        return found.orderBy("__place").select(*s.columns), missing

    def score_projection(self, pids: list[int] | None = None) -> DataFrame:
        """The fields of scores that an answer needs, its texts cut."""
        light = shaping.score_projection(self.scores(pids)[0])
        return light.withColumn("effective_reason", shaping.clamped_text(F.col("effective_reason").cast("string")))

    def score_rows(self, pid: int) -> DataFrame:
        """What the score of a project is made of, a row for each spending row that was judged, the largest first."""
        rows = self.tables["score_rows"].where(F.col("pid") == pid)
        return rows.orderBy(F.desc("amount"), *[c for c in ("block", "name") if c in rows.columns])

    def execution_history(self, pid: int, years: int | None = None) -> DataFrame:
        """year, budget, executed, rate (null without a budget) of a project, in order; of the last years if a number is given. A year that is told more than once has its sums."""
        h = self.tables["executions"].where(F.col("pid") == pid).groupBy("year").agg(F.sum("budget").alias("budget"), F.sum("executed").alias("executed"))
        h = h.withColumn("rate", F.when(F.col("budget") > 0, F.col("executed").cast("double") / F.col("budget")))
        return h.orderBy("year") if years is None else h.orderBy(F.desc("year")).limit(years).orderBy("year")

    def policy(self, pid: int | None = None) -> DataFrame:
        """Always over the whole population; then one project of it."""
        p = screening.policy(self.tables["scores"])
        return p if pid is None else p.where(F.col("pid") == pid)

    def highlights(self, year: str | None = None, metric: str | None = None) -> dict[str, DataFrame]:
        """Of a year, by default the last one; spendingChange is against the year before and is missing where that has no graph. metric: this one's list alone."""
        if metric is not None and metric not in screening.METRICS:
            raise QueryError([f"metric: one of {', '.join(screening.METRICS)}"])
        s, stats, changes = self.tables["scores"], self.tables.get("recipient_stats"), None
        year = year or max(self.graphs, default=None)
        if year in self.graphs:
            now, prior = self.graphs[year], self.graphs.get(str(int(year) - 1))
            stats = screening.graph_stats(now, s) if stats is None else stats
            changes = None if prior is None else summary.spending_change(prior, now)
        lists = screening.highlights(s, stats, changes)
        return lists if metric is None else {k: v for k, v in lists.items() if k == metric}

    def project_map(self) -> DataFrame:
        """The points of the map with what is shown of their projects."""
        return pages.map_points(self.tables["map_points"], self.tables["scores"], self.policy())

    def detail(self, pid: int) -> DataFrame:
        return self.tables["details"].where(F.col("pid") == pid)

    def drill_down(self, year: str, node: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return outcomes.drill_down(self.graphs[year].nodes, self.graphs[year].edges, node)

    def hierarchy(self, budget_type: str, top: dict[str, int], per_column: int = 40) -> tuple[DataFrame, DataFrame]:
        return budget.hierarchy(self.tables["budget_items"].where(F.col("budget_type") == budget_type), top, per_column)

    def items(self, budget_type: str, text: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        """A budget's items, the largest first; text: those whose name or description holds it, whatever its width and case."""
        rows = self.tables["budget_items"].where(F.col("budget_type") == budget_type)
        if text is not None:
            held_in = [S.normalize_query(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "item", "description") if c in rows.columns]
            rows = rows.where(F.contains(F.concat_ws("\n", *held_in), F.lit(search.normalized(text))))
        key = [c for c in ("id", "name", "item") if c in rows.columns][:1]
        return search.page(rows.orderBy(F.desc("amount"), *key), limit, offset)

    def overview(self, year: int) -> tuple[DataFrame, DataFrame]:
        """(nodes, links) of a year's budget overview, see operators.overview."""
        return overview.overview(self.tables["budget_lines"].where(F.col("year") == year))

    def overview_accounts(self, year: int) -> DataFrame:
        return overview.special_accounts(self.tables["budget_lines"].where(F.col("year") == year))

    def history(self, identity: dict) -> DataFrame:
        return budget.history(self.tables["budget_items"], list(identity), identity)
