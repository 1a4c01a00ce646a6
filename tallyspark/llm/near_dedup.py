"""MinHash near-dedup with bottom-k sketches from one hash function.

Each text's set of word shingles is hashed once; its sketch is the SKETCH smallest hashes (the whole set if that's smaller).
Texts with equal sets are one class. Inverted lists of the retained values give candidate pairs: values that one class alone
retains are dropped, and of the rest each class enters the lists of its rarest values only, as many as a partner at the
threshold can't miss all of (prefix filtering; certain while sets are small enough to be retained whole by any partner,
otherwise missed with a chance under 3e-7 for a pair exactly at the threshold). Pairs whose sizes, shared lists and
unlisted rests can't come to the threshold are dropped before any set is read. Overlaps in the lists choose each class's
best leader; pairs are filtered by the estimate of the union's sketch and then verified on the full sets. Rounds of such
stars join most of a group with a pair for each member, and lists within one component are dropped. What still lies in different
components within a list is then compared: in lists of up to SHORT classes pair by pair; longer lists are gathered under the
component that most of their classes are in, and the classes outside it are held against all in blocks, by inverted lists of the full sets.
So no link between components is lost, and a large group neither turns into rows of pairs nor lands in one task.

Defined results: a text without words (null, empty, blank) has an empty set and links with nothing; one with fewer words than a
shingle has one shingle, the whole sequence; rows that share a doc_id are one document; a row with a null doc_id links with
nothing, has a null component and is kept; an empty table gives an empty result. Words are cut at ASCII white space, and only
A-Z are lower-cased. Other columns are ignored. No list, group or set of the corpus reaches the driver.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_path, publish, shuffle_partitions, storage, table, written
from .components import components
from .suffix_dedup import (LAST, SHAPE, TOLD, borders, chunk_data, packed, packed_hashes, rows_of, split, unpacked, unpacked_hashes)

SKETCH = 512
PERCENT = 80
#: Standard deviations that overlaps and estimates may fall short by.
SIGMAS = 5.0
STAR_ROUNDS = 3
#: Class ids up to this number are broadcast to find their texts.
BROADCAST_IDS = 500_000
#: Documents of a pack.
PACK = 2048
#: Rows of a batch of full sets; lists up to this number of classes are compared pair by pair; shingles of a block, retained values of a range.
ROWS, SHORT, BLOCK, RANGE = 500, 16, 1 << 19, 1 << 20
#: Word hashes that a worker keeps.
CACHE = 200_000


class Shingler:
    """Sorted distinct 63-bit hashes of a text's word shingles."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def word(self, w: bytes) -> int:
        import xxhash

        if len(self.known) >= CACHE:
            self.known.clear()
        h = self.known[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.int64)
        known, word = self.known.get, self.word
        h = np.array([known(w) or word(w) for w in words], np.uint64)
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + len(out)]
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return np.unique((out ^ (out >> np.uint64(31))) >> np.uint64(1)).view(np.int64)


def least_overlap(n: np.ndarray, sketch: int, percent: int) -> np.ndarray:
    """Retained values that a set of n shingles shares with any partner at the threshold."""
    a, t = np.minimum(n, sketch), percent / 100
    certain = -(-a * percent // 100)
    likely = np.floor(a * t - SIGMAS * np.sqrt(a * t * (1 - t))).astype(np.int64)
    return np.maximum(np.where(n * 100 <= sketch * percent, certain, likely), 1)


def sketches(docs: DataFrame, width: int, sketch: int, folder: str) -> DataFrame:
    """pack, doc_id, n, sig (digest of the set) of each row; a file for each pack in the shared folder has its ids, set sizes, and the sketches
    one after the other."""

    def pack(batches):
        shingle, part, turn = Shingler(width), TaskContext.get().partitionId(), 0
        store, at = storage(folder)
        for batch in batches:
            for low in range(0, len(batch), PACK):
                own = batch.slice(low, PACK)
                sets = [shingle(t.as_py()) for t in own.column(1)]
                ids = own.column(0)
                n = np.array([len(s) for s in sets], np.int64)
                publish(store, at, f"{part << 24 | turn}", packed(
                    ids=np.array([LAST if i is None else i for i in ids.to_pylist()], np.int64), n=n,
                    sketch=np.concatenate([s[:sketch] for s in sets]) >> 15))  # 48 bits are kept
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part << 24 | turn)), ids, pa.array(n),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())], names=["pack", "doc_id", "n", "sig"])
                turn += 1

    store, at = storage(folder)
    store.create_dir(at, recursive=True)
    return written(docs.select("doc_id", "text").mapInArrow(pack, "pack long, doc_id long, n long, sig binary"), "sets")


def retained(packs: DataFrame, ranges: int, folder: str) -> DataFrame:
    """The inverted lists' ends: the values of each pack with their counts, packed by range."""

    def each(batches):
        for batch in batches:
            for chunk in batch.column("pack").to_pylist():
                values, n = np.unique(chunk_data(folder, chunk)["sketch"].view(np.uint64), return_counts=True)
                code = np.minimum(n, 255).astype(np.uint8)
                yield from rows_of([(TOLD, r, chunk, packed_hashes(values[a:b], code[a:b])) for r, a, b in borders(split(values, ranges))]).to_batches()

    return packs.mapInArrow(each, SHAPE)


def frequencies(group: pa.Table) -> pa.Table:
    """Tells each pack how often its values of a range occur, in the order in which it has sent them."""
    parts = [unpacked_hashes(x.as_py()) for x in group.column("data")]
    values, code = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, place = np.unique(values, return_inverse=True)
    total = np.bincount(place, code)[place].astype(np.uint32)
    ends, at = np.cumsum([len(v) for v, _ in parts]), group.column("place")[0].as_py()
    return rows_of([(TOLD, at, c, packed(n=total[end - len(v) : end]))
                    for c, (v, _), end in zip(group.column("chunk").to_pylist(), parts, ends.tolist(), strict=True)])


def rarest(group: pa.Table, sketch: int, percent: int, folder: str) -> pa.Table:
    """doc_id, value, rest: the lists that each document of a pack enters, and how many of its values that aren't alone come from there on
    in the order of rareness, so many at most it shares with a partner that has none of those before."""
    x = chunk_data(folder, group.column("chunk")[0].as_py())
    told = sorted(zip(group.column("place").to_pylist(), group.column("data"), strict=True), key=lambda t: t[0])
    value, often = np.unique(x["sketch"].view(np.uint64)), np.concatenate([unpacked(d.as_py())["n"] for _, d in told])
    kept = np.minimum(x["n"], sketch)
    doc, own = np.repeat(np.arange(len(kept)), kept), x["sketch"].view(np.uint64)
    often = often[np.searchsorted(value, own)]
    shared = often > 1
    doc, own, often = doc[shared], own[shared], often[shared]
    order = np.lexsort((own, often, doc))
    doc, own = doc[order], own[order]
    n = np.bincount(doc, minlength=len(kept))
    rest = n[doc] - np.arange(len(doc)) + np.repeat(np.cumsum(n) - n, n)
    enter = (rest >= least_overlap(x["n"], sketch, percent)[doc]) & (x["ids"][doc] != LAST)
    out = {"doc_id": x["ids"][doc[enter]], "value": own[enter].view(np.int64), "rest": rest[enter].astype(np.int32)}
    if len(np.unique(x["ids"])) < len(x["ids"]):  # a document that is repeated in the pack enters a list once
        by = np.lexsort(tuple(out.values()))
        out = {k: v[by] for k, v in out.items()}
        new = np.concatenate([[True], np.any([v[1:] != v[:-1] for v in out.values()], 0)])[: len(by)]
        out = {k: v[new] for k, v in out.items()}
    return pa.table(out)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def each(batches):
        shingle = Shingler(width)
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                own = batch.slice(low, ROWS)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([shingle(t.as_py()) for t in own.column(1)], pa.list_(pa.int64()))],
                                                 names=["cid", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(each, "cid long, shingles array<long>")


def alike(a: Column, b: Column, percent: int) -> Column:
    """Whether the set sizes n of two entries allow the threshold."""
    return (a["n"] * 100 >= b["n"] * percent) & (b["n"] * 100 >= a["n"] * percent)


def enough(a: Column, b: Column, shared: Column, sketch: int, percent: int) -> Column:
    """Whether two entries (n, rest) of the first list that both sets are in, of so many shared lists, allow the threshold: they share
    at most the lower rest in all, and at most their shared lists and what the longer unlisted rest has. Only sets that are retained
    whole are judged so."""
    need, t = (a["n"] + b["n"]) * percent / (100 + percent), percent / 100
    unlisted = F.greatest(*[F.when(n * 100 <= sketch * percent, F.ceil(n * percent / 100)).otherwise(F.ceil(n * t - SIGMAS * F.sqrt(n * t * (1 - t))))
                            for n in (a["n"], b["n"])])
    return (F.greatest(a["n"], b["n"]) > sketch) | (F.least(a["rest"], b["rest"]) >= need) & (shared + unlisted >= need)


def near(a: Column, b: Column, sketch: int, percent: int) -> Column:
    """Whether two sets, as sorted arrays, are near: for sets beyond the sketch the estimate from the union's sketch decides first,
    then the full sets."""
    t = percent / 100
    x, y = F.slice(a, 1, sketch), F.slice(b, 1, sketch)
    union = F.slice(F.sort_array(F.array_union(x, y)), 1, sketch)  # has SKETCH values where one of the sets has more
    hopeless = F.size(F.array_intersect(F.array_intersect(x, y), union)) < sketch * t - SIGMAS * (sketch * t * (1 - t)) ** 0.5
    exact = F.size(F.array_intersect(a, b)) * (100 + percent) >= (F.size(a) + F.size(b)) * percent
    return F.when(((F.size(a) > sketch) | (F.size(b) > sketch)) & hopeless, F.lit(False)).otherwise(exact)


def stored_block(group: pa.Table, folder: str) -> pa.Table:
    """Writes a block's sets to the shared folder; tells its name and whether it has members outside the head's component."""
    head, block = (group.column(c)[0].as_py() for c in ("head", "block"))
    sets, (store, at) = group.column("shingles").combine_chunks(), storage(folder)
    root = group.column("root").to_numpy()
    publish(store, at, f"{head}.{block}", packed(cid=group.column("cid").to_numpy(), root=root, n=sets.value_lengths().to_numpy(), shingles=sets.flatten().to_numpy()))
    return pa.table({"head": [head], "block": pa.array([block], pa.int32()), "probes": [bool((root != head).any())]})


class Block:
    """Inverted lists of a block's sets."""

    def __init__(self, x: dict) -> None:
        self.cid, self.root, self.n, self.shingles = (x[k] for k in ("cid", "root", "n", "shingles"))
        self.ends = np.cumsum(self.n)
        order = np.argsort(self.shingles, kind="stable")
        self.owner = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)[order]
        values = self.shingles[order]
        self.first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        self.values, self.lengths = values[self.first], np.diff(np.append(self.first, len(values)))

    def set_of(self, i: int) -> np.ndarray:
        return self.shingles[self.ends[i] - self.n[i] : self.ends[i]]

    def overlaps(self, own: np.ndarray) -> np.ndarray:
        """How many values of own each member has."""
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        at = at[self.values[at] == own]
        size = self.lengths[at]
        place = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owner[place], minlength=len(self.n))


def block_links(left: Block, right: Block, head: int, percent: int) -> list[tuple[int, int]]:
    """Links of left's members outside the head's component to right's members of other components; enough of them to tie together what
    they tie together."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for i in np.flatnonzero(left.root != head).tolist():
        n, root = left.n[i], left.root[i]
        right_sizes = (right.n * 100 >= n * percent) & (n * 100 >= right.n * percent) & (right.root != root)
        if not right_sizes.any():
            continue
        both = right.overlaps(left.set_of(i))
        for j in np.flatnonzero(right_sizes & (both * 100 >= (n + right.n - both) * percent)).tolist():
            x, y = top(int(root)), top(int(right.root[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((int(left.cid[i]), int(right.cid[j])))
    return out


def compared_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members(head, cid, n, root) -> links (a, b) between components. The members of a head are cut into blocks of some BLOCK
    shingles, files in the shared folder; a task reads two of them at a time and emits a link for each component that it ties."""
    spark, n = members.sparkSession, shuffle_partitions(members.sparkSession)
    folder = fresh_path(spark, "blocks")
    store, at = storage(folder)
    store.create_dir(at, recursive=True)
    sizes = members.groupBy("head").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = (members.join(sizes, "head").select("head", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"), "cid", "root")
             .join(sets, "cid"))
    blocks = written(dealt.groupBy("head", "block").applyInArrow(lambda g: stored_block(g, folder), "head long, block int, probes boolean"), "blocks")
    tasks = (blocks.where("probes").select("head", F.col("block").alias("left")).join(blocks.select("head", F.col("block").alias("right")), "head")
             .repartition(4 * n, "head", "left", "right"))

    def compare(batches):
        for batch in batches:
            left = kept = None
            for head, i, j in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kept != (head, i):
                    left, kept = Block(chunk_data(folder, f"{head}.{i}")), (head, i)
                links = block_links(left, left if i == j else Block(chunk_data(folder, f"{head}.{j}")), head, percent)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    links = written(tasks.mapInArrow(compare, "a long, b long"), "block-links")
    discard(blocks, folder)
    return links


def groups(docs: DataFrame, width: int, percent: int = PERCENT, sketch: int = SKETCH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: the smallest doc_id of the row's group."""
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    folder = fresh_path(spark, "sketches")
    feats = sketches(docs, width, sketch, folder)
    ranges = max(n, -(-(feats.agg(F.sum(F.least("n", F.lit(sketch)))).first()[0] or 0) // RANGE))
    packs = feats.select("pack").distinct().repartition(n, "pack")
    filled = feats.where("n > 0 and doc_id is not null")
    classes = filled.groupBy("sig").agg(F.min("doc_id").alias("cid"))
    members = written(filled.join(classes, "sig").select("doc_id", "n", "cid"), "members")
    told = retained(packs, ranges, folder).groupBy("place").applyInArrow(frequencies, SHAPE)
    entered = told.groupBy("chunk").applyInArrow(lambda g: rarest(g, sketch, percent, folder), "doc_id long, value long, rest int")
    firsts = members.where("doc_id = cid").select("doc_id", "n").distinct()  # one document stands for its class
    lists = written(entered.join(firsts.hint("merge"), "doc_id").select("value", F.col("doc_id").alias("cid"), "n", "rest"), "lists")
    # rows of one doc_id are tied whatever their texts
    spread = members.groupBy("doc_id").agg(F.min("cid").alias("b"), F.max("cid").alias("most")).where("b < most")
    edges = written(members.join(spread, "doc_id").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct(), "near-edges")
    # the table's files are in the shared folder too, not in the warehouse, which a session may have on a local disk
    roots, sets, name, place = None, None, f"near_dedup_sets_{uuid.uuid4().hex}", fresh_path(spark, "full-sets")

    def rooted() -> DataFrame:
        return lists.withColumn("root", F.col("cid")) if roots is None else (
            lists.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))

    def joined_up(new: DataFrame) -> None:
        """Components of the links so far and the new ones."""
        nonlocal edges, roots
        old = edges, roots
        found = written(edges.unionByName(new), "near-edges")
        roots = written(components(found), "near-roots")
        edges = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        discard(found, old[1], old[0] if old[1] is None else None)

    def verified(pairs: DataFrame) -> DataFrame:
        for end in "ab":
            pairs = pairs.join(sets.select(F.col("cid").alias(end), F.col("shingles").alias(f"set_{end}")), end)
        return pairs.where(near(F.col("set_a"), F.col("set_b"), sketch, percent)).select("a", "b")

    for turn in range(STAR_ROUNDS):
        placed = rooted()
        order = F.struct(F.xxhash64("root", F.lit(turn)), F.xxhash64("cid", F.lit(turn)))
        leads = placed.groupBy("value").agg(F.min_by(F.struct("cid", "n", "root", "rest"), order).alias("lead"), F.min("root").alias("low"),
                                            F.max("root").alias("high")).where("low < high").select("value", "lead")
        # a list within one component has no more to say, so what is left are the lists of two and more
        opened, old = written(placed.join(leads, "value"), "opened"), lists
        lists = opened.select("value", "cid", "n", "rest")
        if turn == 0:
            wanted = written(lists.select("cid").distinct(), "wanted")
            # beyond the limit both sides are shuffled; until then the texts stay where they are
            few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
            # bucketed by class, so that pairs come to the sets and not the sets to the pairs
            (full_sets(docs.join(few, docs["doc_id"] == few["cid"], "left_semi"), width).repartition(n, "cid").distinct()
             .write.bucketBy(n, "cid").sortBy("cid").format("parquet").option("compression", "none").option("path", place).saveAsTable(name))
            sets = spark.table(name)
            discard(wanted, old)
        else:
            discard(last)
        # a hint of what is worth a look: half the lists that a near pair shares have this lead
        mine = F.struct("n", "rest")
        pairs = (opened.where((F.col("root") != F.col("lead.root")) & alike(mine, F.col("lead"), percent))
                 .groupBy(F.col("cid").alias("a"), F.col("lead.cid").alias("b"))
                 .agg(F.count(F.lit(1)).alias("overlap"), F.max_by(mine, "rest").alias("x"), F.max_by("lead", "rest").alias("y"))
                 .where(enough(F.col("x"), F.col("y"), F.col("overlap") * 2, sketch, percent))
                 .groupBy("a").agg(F.max_by("b", F.struct("overlap", "b")).alias("b")))
        joined_up(verified(pairs))
        last = opened

    placed = rooted()
    counts = placed.groupBy("value", "root").agg(F.count(F.lit(1)).alias("rows"))
    heads = (counts.groupBy("value").agg(F.sum("rows").alias("size"), F.min_by("root", F.struct(-F.col("rows"), "root")).alias("head"),
                                         F.count(F.lit(1)).alias("roots")).where("roots > 1").select("value", "size", "head"))
    opened = written(placed.join(heads, "value"), "opened")
    short = opened.where(F.col("size") <= SHORT).select("value", F.struct("cid", "root", "n", "rest").alias("x"))
    x, y = F.col("x"), F.col("y")
    # a pair that also shares a long list is compared in its blocks
    pairs = (short.join(short.withColumnRenamed("x", "y"), "value")
             .where((x["cid"] < y["cid"]) & (x["root"] != y["root"]) & alike(x, y, percent))
             .groupBy(x["cid"].alias("a"), y["cid"].alias("b"))
             .agg(F.count(F.lit(1)).alias("shared"), F.max_by("x", x["rest"]).alias("x"), F.max_by("y", x["rest"]).alias("y"))
             .where(enough(x, y, F.col("shared"), sketch, percent)).select("a", "b"))
    # the lists of a large group have nearly the same members, and mostly one component: its members' rests are compared once, not in each
    rest = written(opened.where(F.col("size") > SHORT).groupBy("head", "cid").agg(F.max("n").alias("n"), F.min("root").alias("root")), "rest")
    links = compared_blocks(rest, sets, percent)
    joined_up(verified(pairs).unionByName(links))
    spark.sql(f"DROP TABLE {name}")
    discard(last, opened, rest, links, folder, place)
    grouped = (members.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
               .select("doc_id", F.coalesce("root", "cid").alias("component_id"), F.col("n").alias("n_shingles")))
    alone = feats.where("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("component_id"), F.col("n").alias("n_shingles"))
    return grouped.unionByName(alone)


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"), 2).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
