"""Items of the budget book's XML forms: standard (first budgets), revised (supplementary ones) and settlement (accounts).

A form is a grid of cells; what a row means depends on rows before it: a section is printed where it begins, a settlement's header comes again on each
page with other columns. Cells are found by Spark and stay with their document, which is a released file of a few pages; some documents at a time are columns of Arrow, sorted into places and rows, and each row takes its section and its columns from a row before it. Nothing is shuffled. Texts are joined over the
cells of a place, numbers are read from its first one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = r'(?s)<clm id="p\d+-\d+\.\d+-\d+\.\d+">.*?</clm>'
CDATA = r"(?s)CDATA\[(.*?)\]\]"
ERA_YEAR, REVISED_YEAR = r"^(令和|平成)(元|\d+)年度", r"^改(令和|平成)(元|\d+)年度"
REPORT = "歳出決算報告書"
#: Names of the codes of major expenses; fixed values.
MAJOR_EXPENSES = {
    "01": "社会保障関係費", "02": "年金給付費", "03": "医療給付費", "04": "介護給付費", "05": "少子化対策費", "06": "生活扶助等社会福祉費", "07": "保健衛生対策費",
    "08": "雇用労災対策費", "10": "文教及び科学振興費", "11": "義務教育費国庫負担金", "13": "科学技術振興費", "14": "文教施設費", "15": "教育振興助成費", "16": "育英事業費",
    "20": "国債費", "25": "恩給関係費", "31": "地方交付税交付金", "32": "地方特例交付金", "33": "地方譲与税譲与金", "35": "防衛関係費", "40": "公共事業関係費",
    "41": "治山治水対策事業費", "42": "道路整備事業費", "43": "港湾空港鉄道等整備事業費", "44": "住宅都市環境整備事業費", "45": "公園水道廃棄物処理等施設整備費",
    "46": "農林水産基盤整備事業費", "47": "社会資本総合整備事業費", "48": "推進費等", "49": "災害復旧等事業費", "50": "経済協力費", "60": "中小企業対策費",
    "63": "エネルギー対策費", "65": "食料安定供給関係費", "95": "その他の事項経費", "96": "中東情勢等対応予備費", "97": "復興加速化・福島再生予備費", "98": "予備費",
}
ITEM = ("section_code", "section_name", "major_code", "major_name", "name", "amount", "previous", "difference", "description", "current", "spent",
        "carried_over", "unused")


#: Cells that are taken apart at once, or one document's.
CELLS = 50_000
BLANKS = " \t\n\x0b\f\r\u3000"
TEXTS, PLACE = ("section_code", "section_name", "name", "major_code", "description"), r'^<clm id="p(?P<page>\d+)-(?P<row>\d+)\.\d+-(?P<col>\d+)\.(?P<sub>\d+)">'


def clean(c: str | Column) -> Column:
    """Without white space at the ends, ideographic too."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[\s　]+|[\s　]+$", "")


def number_of(first: Column, scale: int) -> Column:
    """A text's number in yen: thousands may be set apart, a triangle is a minus; null where it is none."""
    digits = F.translate(first, "△," + BLANKS, "")
    value = F.when(digits.rlike(r"^[0-9]+$"), digits.try_cast("long") * scale)
    return F.when(F.contains(first, F.lit("△")), -value).otherwise(value)


# ---- grids, in a task -------------------------------------------------------------------------------------------------------


def cell_texts(cells: pa.Array) -> pa.Array:
    """The CDATA of each cell, joined."""
    parts = pc.split_pattern(cells, "CDATA[")
    n, parts = pc.list_value_length(parts).to_numpy(), pc.list_flatten(parts)
    inner = np.ones(len(parts), bool)
    inner[np.cumsum(n) - n] = False  # what stands before a cell's first one
    halves = pc.split_pattern(parts.filter(pa.array(inner)), "]]", max_splits=1)
    if (pc.list_value_length(halves).to_numpy() < 2).any():  # not closed, or closed after another opens
        found = re.compile(CDATA)
        return pa.array(["".join(found.findall(c)) for c in cells.to_pylist()], cells.type)
    return joined(pc.list_element(halves, 0), np.append(0, np.cumsum(n - 1)))


def joined(texts: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The texts between two bounds each as one."""
    if len(texts) == len(bounds) - 1 and (np.diff(bounds) == 1).all():
        return texts
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), texts), "")


def whole_number(texts: pa.Array) -> np.ndarray:
    """Numbers, -1 where one is beyond an int."""
    if (pc.max(pc.binary_length(texts)).as_py() or 0) > 10:
        texts = pc.utf8_ltrim(texts, "0")
        texts = pc.if_else(pc.equal(texts, ""), "0", pc.if_else(pc.greater(pc.binary_length(texts), 10), "-1", texts))
    n = texts.cast(pa.int64()).to_numpy()
    return np.where(n < 1 << 31, n, -1)


def first_col(of: np.ndarray, col: np.ndarray, passes: pa.Array, n: int) -> np.ndarray:
    """The column of the first label that passes for each of n groups, -1 where none does."""
    at = np.flatnonzero(passes.to_numpy(zero_copy_only=False))
    group, i = np.unique(of[at], return_index=True)
    out = np.full(n, -1)
    out[group] = col[at[i]]
    return out


class Grid:
    """The cells of some documents (doc, cells, and head, those of its header element, where the form has one). Places are cells of one row and column: label, their texts joined, without
    blanks at the ends, first and sub, those of the first cell. Rows have doc (its number), page and row."""

    def __init__(self, texts: pa.Table):
        self.docs, self.n_docs = texts.column("doc").combine_chunks(), len(texts)
        if "head" in texts.column_names:
            cell, self.head_doc = self._flat(texts.column("head"))
            self.head_col, self.head_label = self._cells(cell)[2], pc.utf8_trim(cell_texts(cell), BLANKS)
        cell, doc = self._flat(texts.column("cells"))
        page, row, col, sub = self._cells(cell)
        order = np.lexsort((col, row, page, doc))
        page, row, col, doc, text = page[order], row[order], col[order], doc[order], cell_texts(cell)
        if (order[1:] < order[:-1]).any():
            text = text.take(pa.array(order))
        differs = lambda *v: np.append(np.ones(min(len(order), 1), bool), np.logical_or.reduce([x[1:] != x[:-1] for x in v])) if len(order) else np.zeros(0, bool)
        new_row = differs(doc, page, row)
        place, begin = np.flatnonzero(new_row | differs(col)), np.flatnonzero(new_row)
        self.doc, self.page, self.row, self.n = doc[begin], page[begin], row[begin], len(begin)
        self.of, self.col, self.sub = (np.cumsum(new_row) - 1)[place], col[place], sub[order][place]
        self.label, self.first = pc.utf8_trim(joined(text, np.append(place, len(order))), BLANKS), text.take(pa.array(place))
        self.key = self.of << 32 | (self.col + 1)

    @staticmethod
    def _flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        """(the elements, the number of the list of each)."""
        lists = lists.combine_chunks()
        return pc.list_flatten(lists), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())

    @staticmethod
    def _cells(cell: pa.Array) -> list[np.ndarray]:
        found = pc.extract_regex(cell, PLACE)
        return [whole_number(pc.struct_field(found, n)) for n in ("page", "row", "col", "sub")]

    def at(self, col: np.ndarray | int) -> np.ndarray:
        """Each row's place in a column, -1 where it has none."""
        want = np.arange(self.n) << 32 | (np.maximum(col, -1) + 1)
        i = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where((self.key[i] == want) & (col >= 0), i, -1)

    def told(self, place: np.ndarray, test: Callable[[pa.Array], pa.Array]) -> np.ndarray:
        """Whether a place is there and its label passes."""
        out, there = np.zeros(len(place), bool), np.flatnonzero(place >= 0)
        out[there] = test(self.label.take(pa.array(place[there]))).to_numpy(zero_copy_only=False)
        return out

    def last(self, begins: np.ndarray, within: np.ndarray) -> np.ndarray:
        """The last row so far that begins something, -1 where there is none within the same run of rows."""
        last = np.maximum.accumulate(np.where(begins, np.arange(self.n), -1))
        return np.where((last >= 0) & (within[last] == within), last, -1)

    def sections(self, able: np.ndarray, code: np.ndarray, name: np.ndarray, within: np.ndarray) -> dict[str, np.ndarray]:
        """The places of each row's section: it begins where there are a code and a name."""
        begins = able & self.told(code, is_number) & self.told(name, is_text)
        return self.taken(self.last(begins, within), section_code=code, section_name=name)

    def taken(self, row: np.ndarray, **places: np.ndarray) -> dict[str, np.ndarray]:
        """Other rows' places, -1 where there is no other row."""
        return {k: np.where(row >= 0, v[row], -1) for k, v in places.items()}

    def items(self, keep: np.ndarray, **places: np.ndarray) -> pa.Table:
        """The kept rows that have a name and an amount, with the texts of their places."""
        rows = np.flatnonzero(keep & (places["name"] >= 0) & (places["amount"] >= 0))
        number = lambda x: pa.array(x, pa.int32(), mask=x < 0)
        take = lambda k, i: (self.label if k in TEXTS else self.first).take(pa.array(i, mask=i < 0))
        return pa.table({"doc": self.docs.take(pa.array(self.doc[rows])), "page": number(self.page[rows]), "row": number(self.row[rows]), **{k: take(k, v[rows]) for k, v in places.items()}})


def is_text(label: pa.Array) -> pa.Array:
    return pc.not_equal(label, "")


def is_number(label: pa.Array) -> pa.Array:
    return pc.match_substring_regex(label, "^[0-9]+$")


def taken_apart(texts: DataFrame, take: Callable[[Grid], pa.Table], names: tuple[str, ...], header: bool = False) -> DataFrame:
    """texts(doc, text) -> doc, page, row and texts of names: what take makes of each document's grid."""
    found = lambda text: F.regexp_extract_all(text, F.lit(CELL), 0)
    heads = [found(F.regexp_extract("text", r"(?s)<header>(.*?)</header>", 1)).alias("head")] if header else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            n = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("cells")), 0).to_numpy())
            low = 0
            while low < len(t):
                high = max(low + 1, int(np.searchsorted(n, (n[low - 1] if low else 0) + CELLS, "right")))
                yield from take(Grid(t.slice(low, high - low))).to_batches()
                low = high

    place = [T.StructField(n, T.IntegerType()) for n in ("page", "row")]
    return texts.select("doc", *heads, found(F.col("text")).alias("cells")).mapInArrow(run, T.StructType([texts.schema["doc"], *place, *[T.StructField(n, T.StringType()) for n in names]]))


# ---- forms ------------------------------------------------------------------------------------------------------------------


def items(rows: DataFrame, scale: int) -> DataFrame:
    """The rows that have a name and an amount, as items; amounts of columns not given are null, texts empty."""
    numbers = ("amount", "previous", "difference", "current", "spent", "carried_over", "unused")
    out = {n: number_of(F.col(n), scale) if n in rows.columns else F.lit(None).cast("long") for n in numbers}
    out |= {n: F.coalesce(n, F.lit("")) if n in rows.columns else F.lit("") for n in TEXTS}
    names = F.create_map(*[F.lit(x) for pair in MAJOR_EXPENSES.items() for x in pair])
    found = rows.select("doc", "page", "row", *[v.alias(k) for k, v in out.items()]).where("name <> '' and amount is not null")
    return found.withColumn("major_name", F.coalesce(F.element_at(names, F.col("major_code")), F.lit(""))).select("doc", "page", "row", *ITEM)


def standard(texts: DataFrame, scale: int = 1000) -> DataFrame:
    """First and provisional budgets. Where two-digit codes stand under the label 事項 they are codes of major expenses, and names are in the next column."""

    def take(g: Grid) -> pa.Table:
        head = lambda test: first_col(g.head_doc, g.head_col, test(g.head_label), g.n_docs)
        named = lambda name: head(lambda x: pc.equal(x, name))
        last_year = named("前年度予算額")
        columns = {"amount": head(lambda x: pc.match_substring_regex(x, ERA_YEAR)), "previous": np.where(last_year >= 0, last_year, named("前年度")),
                   "difference": head(lambda x: pc.starts_with(x, "比較増")), "description": named("説明")}
        item = named("事項")[g.doc]
        able, own, beside = (item >= 0) & (columns["amount"][g.doc] >= 0), g.at(item), g.at(np.where(item >= 0, item + 1, -1))
        coded = np.zeros(g.n_docs, bool)
        coded[g.doc[able & g.told(own, lambda x: pc.match_substring_regex(x, "^[0-9]{2}$"))]] = True
        coded = coded[g.doc]
        # figures in the description use the same columns: a section is one only with a code and a name
        return g.items(able, **g.sections(able, g.at(item - 2), g.at(item - 1), g.doc), name=np.where(coded, beside, own), major_code=np.where(coded, own, -1),
                       **{k: g.at(v[g.doc]) for k, v in columns.items()})

    return items(taken_apart(texts, take, (*TEXTS[:4], "amount", "previous", "difference", "description"), header=True), scale)


def revised(texts: DataFrame, scale: int = 1000) -> DataFrame:
    """Supplementary budgets. Column 2 holds sections (sub 1) and items (sub 2), column 1 their codes; the row whose column 1 has 事項 names the amounts' columns."""

    def take(g: Grid) -> pa.Table:
        code, name = g.at(1), g.at(2)
        heads = np.flatnonzero(g.told(code, lambda x: pc.match_substring(x, "事項")))
        heads = heads[np.unique(g.doc[heads], return_index=True)[1]]  # a document's first one
        is_head = np.zeros(g.n, bool)
        is_head[heads] = True
        places = np.flatnonzero(is_head[g.of])
        label, of, col = g.label.take(pa.array(places)), g.doc[g.of[places]], g.col[places]
        tests = {"amount": lambda x: pc.match_substring_regex(x, REVISED_YEAR), "previous": lambda x: pc.match_substring(x, "成立予算額"),
                 "difference": lambda x: pc.match_substring(x, "差引額"), "description": lambda x: pc.equal(x, "説明")}
        columns = {k: first_col(of, col, test(label), g.n_docs) for k, test in tests.items()}
        able = (columns["amount"][g.doc] >= 0) & ~is_head & g.told(name, is_text)
        sub = np.where(name >= 0, g.sub[name], -1)
        return g.items(able & (sub == 2), **g.taken(g.last(able & (sub == 1), g.doc), section_code=code, section_name=name), name=name, major_code=code,
                       **{k: g.at(v[g.doc]) for k, v in columns.items()})

    return items(taken_apart(texts, take, (*TEXTS[:4], "amount", "previous", "difference", "description")), scale)


def settlement(texts: DataFrame, scale: int = 1) -> DataFrame:
    """Accounts. Header rows are part of the body and come again: each holds until the next and begins without a section; rows before the first
    one, and those whose name is a number, are summaries."""
    numbers = {"amount": "歳出予算額(円)", "current": "歳出予算現額(円)", "spent": "支出済歳出額(円)", "carried_over": "翌年度繰越額(円)", "unused": "差引額(円)"}

    def take(g: Grid) -> pa.Table:
        has = lambda n: np.bincount(g.of[pc.equal(g.label, n).to_numpy(zero_copy_only=False)], minlength=g.n) > 0
        is_head = has("事項") & has(numbers["spent"])
        places = np.flatnonzero(is_head[g.of])
        label = g.label.take(pa.array(places))
        block = g.last(is_head, g.doc)
        column = lambda n: np.where(block >= 0, first_col(g.of[places], g.col[places], pc.equal(label, n), g.n)[block], -1)
        item, able = column("事項"), (block >= 0) & ~is_head
        name = g.at(np.where(able, item + 1, -1))
        summary = g.told(name, lambda x: pc.match_substring_regex(x, "^[0-9,]+$"))
        return g.items(able & ~summary, **g.sections(able, g.at(item - 2), g.at(item - 1), block), name=name, major_code=g.at(item),
                       **{k: g.at(column(n)) for k, n in numbers.items()})

    return items(taken_apart(texts, take, (*TEXTS[:4], *numbers)), scale)


# ---- titles -----------------------------------------------------------------------------------------------------------------


def running_parts(text: str | Column) -> Column:
    """A running title's parts: they stand two or more blanks, or an ideographic one, apart."""
    title = F.regexp_extract(text, r"(?s)<running_title>\s*<!\[CDATA\[(.*?)\]\]>", 1)
    return F.filter(F.transform(F.split(clean(title), "[ \\t\u3000]{2,}|\u3000"), clean), lambda p: p != "")


def list_title(text: str | Column) -> Column:
    return clean(F.regexp_extract(text, r"(?s)<title_for_list>\s*<!\[CDATA\[(.*?)\]\]>", 1))


def scope(account: str | Column, parts: str | Column) -> Column:
    """(ministry, organization, special_account, sub_account, agency) of a running title's parts, by the kind of account (general, special, agency)."""
    account = F.col(account) if isinstance(account, str) else account
    own = F.filter(parts, lambda p: p != REPORT)
    part = lambda i: F.coalesce(F.get(own, F.lit(i)), F.lit(""))
    ministry, none = F.regexp_replace(part(0), "所管$", ""), F.lit("")
    general, special = account == "general", account == "special"
    return F.struct(F.when(general | special, ministry).otherwise(none).alias("ministry"),
                    F.when(general, F.when(part(1) != "", part(1)).otherwise(ministry)).otherwise(none).alias("organization"),  # none printed: the ministry's own
                    F.when(special, part(1)).otherwise(none).alias("special_account"),
                    F.when(special, part(2)).when(general, none).otherwise(part(1)).alias("sub_account"),
                    F.when(general | special, none).otherwise(part(0)).alias("agency"))


def is_form(layout: str, title: str, text: str | Column) -> Column:
    """Whether a page is of a form: accounts tell it in the running title, the others in the list's title."""
    return F.array_contains(running_parts(text), REPORT) if layout == "settlement" else list_title(text) == title


def item_key(account: str | Column, budget_type: str | Column) -> Column:
    """An item's key of what it is: items have no official ids. The row has scope's fields, section_code and name."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.concat_ws("|", as_col(account), as_col(budget_type), *["scope." + c for c in ("ministry", "organization", "special_account", "sub_account", "agency")], "section_code", "name")
