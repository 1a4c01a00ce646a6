"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in a normal form: lower case, white space collapsed. An item of n characters may be hit with up to
n // PER_ERROR errors (insertions, deletions, replacements). It's cut into that number plus one pieces; a passage within the
budget holds one piece unchanged, so an Aho-Corasick automaton over all pieces finds every place to look at, and Myers'
bit-parallel distance decides it there.

Defined results: a null or empty text and a null or blank item match nothing; an item that is shorter than PER_ERROR has no
budget and must occur unchanged; items with the same normal form are each reported; repeated rows of docs are each
reported; whole texts are searched. The items are cut into blocks of about BLOCK_ITEMS, files in the shared folder: the driver sees
their number only, a task holds one block, and each block costs a pass over docs. Columns of docs are kept by clean(); hits() reads
doc_id and text only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, publish, storage, table, written

PER_ERROR = 16
BLOCK_ITEMS = 20_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(n: int) -> int:
    return n // PER_ERROR


def pieces(item: str) -> list[tuple[int, int]]:
    """Borders of budget + 1 pieces of nearly equal length."""
    cuts = np.linspace(0, len(item), budget(len(item)) + 2).round().astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class Myers:
    """Smallest edit distance of a pattern to any substring of a text, and where that substring ends."""

    def __init__(self, pattern: str) -> None:
        self.n, self.peq = len(pattern), {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def __call__(self, text: str) -> tuple[int, int]:
        full, top = (1 << self.n) - 1, 1 << self.n - 1
        plus, minus, score, best, end = full, 0, self.n, self.n, 0
        get = self.peq.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | ~(xh | plus) & full
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            plus, minus = mh | ~(xv | ph) & full, ph & xv
            if score < best:
                best, end = score, j
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.myers: dict[int, Myers] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for a, b in pieces(t):
                places.setdefault(t[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def verify(self, k: int, text: str, start: int) -> tuple[int, int] | None:
        """(distance, end in text) of the best passage that may begin about start, if it's within the budget."""
        item = self.items[k][1]
        e = budget(len(item))
        low = max(0, start - e)
        if text.startswith(item, max(0, start)):
            return 0, max(0, start) + len(item)
        if k not in self.myers:
            self.myers[k] = Myers(item)
        distance, end = self.myers[k](text[low : start + len(item) + e])
        return (distance, low + end) if distance <= e else None

    def __call__(self, raw: str | None, first: bool = False) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of each item's best passage, leftmost on ties. first: stop at any."""
        text = normal(raw)
        if not text or not self.items:
            return []
        best: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for at, (n, where) in self.automaton.iter(text):
            for k, a in where:
                start = at + 1 - n - a
                if (k, start) in seen or k in best and best[k][0] == 0:
                    continue
                seen.add((k, start))
                if (hit := self.verify(k, text, start)) and (k not in best or hit < best[k]):
                    best[k] = hit
                    if first:
                        return [(self.items[k][0], *hit)]
        return sorted((self.items[k][0], *hit) for k, hit in best.items())


def item_blocks(benchmark: DataFrame, most: int = BLOCK_ITEMS) -> tuple[str, int]:
    """Writes the items to the shared folder, a file for each block of about so many, and returns the folder and the number of blocks."""
    spark, items = benchmark.sparkSession, benchmark.select("item_id", "text").where("text is not null")
    n = -(-items.count() // most)
    folder = fresh_path(spark, "items")
    store, at = storage(folder)
    store.create_dir(at, recursive=True)

    def keep(group: pa.Table) -> pa.Table:
        block, (store, at) = group.column("block")[0].as_py(), storage(folder)
        publish(store, at, f"{block}", json.dumps(sorted(zip(group.column("item_id").to_pylist(), group.column("text").to_pylist(), strict=True),
                                                         key=lambda x: (x[0] is not None, x))).encode())
        return pa.table({"block": pa.array([block], pa.int64())})

    if n:
        # items are dealt by their id and text, so that many rows of one id don't meet in one block
        written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).groupBy("block").applyInArrow(keep, "block long"), "blocks")
    return folder, n


def matcher(folder: str, block: int) -> Matcher:
    """Of the block's items, which a task reads from the shared folder; a block that no item fell into has no file."""
    from pyarrow import fs

    store, at = storage(folder)
    if store.get_file_info(f"{at}/{block}").type == fs.FileType.NotFound:
        return Matcher([])
    return Matcher([tuple(x) for x in json.loads(store.open_input_stream(f"{at}/{block}").read())])


def hits(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, distance, match_end (in the normal form): one row for each item that a document holds."""
    folder, n = item_blocks(benchmark, block_items)

    def search(block):
        def each(batches):
            match = matcher(folder, block)
            for batch in batches:
                out = [(d.as_py(), *h) for d, t in zip(batch.column(0), batch.column(1), strict=True) for h in match(t.as_py())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                                     names=["doc_id", "item_id", "distance", "match_end"])

        return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, item_id long, distance long, match_end long")

    found, *rest = [search(b) for b in range(max(n, 1))]
    for other in rest:
        found = found.unionByName(other)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs that hold no item, unchanged."""
    folder, n = item_blocks(benchmark, block_items)
    for block in range(n):

        def holds(texts, block=block):
            match = matcher(folder, block)
            for chunk in texts:
                yield pa.array([bool(match(t.as_py(), first=True)) for t in chunk], pa.bool_())

        docs = docs.where(~arrow_flag(holds)(F.col("text")))
    return docs


def arrow_flag(make):
    """A boolean Arrow UDF over an iterator of batches."""
    def flag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from make(batches)

    return F.arrow_udf(flag, "boolean")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
