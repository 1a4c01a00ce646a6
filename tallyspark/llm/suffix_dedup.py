"""Suffix-array dedup: a sparse suffix array, sorted by a common-prefix-aware distributed merge sort.

Every byte covered by a WINDOW-byte string that also starts in a document with a smaller doc_id is removed. Only suffixes at
anchors are sorted: of each window's GRAM-byte strings the one with the least hash (the leftmost on ties) is its anchor, so
equal windows have equal anchors at equal offsets, and one in sixteen suffixes or so is enough to see every match.

1. Documents are packed into chunks, files in the shared folder. Each chunk sends the distinct hashes of its anchors, packed by hash
   range; those that one document alone has are dropped, and each chunk is told which remain.
2. Each chunk sorts the suffixes at these anchors in byte order, with as much of the text before them as their windows need, folds
   equal ones (keeping the smallest doc_id) and front-codes the sorted runs. Suffixes are dealt to ranges by a hash of the anchor's
   string, mixed anew: the least of many hashes is a small number, so the hash that chose the anchor would deal unevenly.
3. Each range merges its runs with a loser tree that keeps the known common prefix of each loser with the winner, so no
   byte of it is compared again. The lengths of common prefixes of neighbours in the merged order decide the matches: a window
   that starts o bytes before two anchors is the same if WINDOW - o bytes from the anchors on and o bytes before them are, and both
   are runs of neighbours whose common prefix is long enough, one in the merged order, one in that of the bytes before, read backwards.
   Anchors that are very frequent are replaced by their windows beforehand, so a frequent string with ever different surroundings
   doesn't gather in one place.
4. Chunks with such suffixes apply the answers.

Defined results: a null text is empty; a text shorter than WINDOW loses nothing; a null doc_id comes after all others; rows that
share a doc_id don't remove each other's bytes, and each gives a row; an empty table gives an empty result. Other columns
are ignored. Nothing is collected but the total size.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, publish, shuffle_partitions, storage, table, written

WINDOW, GRAM = 50, 16
SPAN = WINDOW - GRAM  # largest offset of an anchor in its window
KEY = WINDOW + SPAN
#: Text of a chunk, windows handled at once, text for each range of hashes (bytes).
CHUNK, STEP, RANGE = 2 << 20, 1 << 18, 4 << 20
#: Anchors that occur more often are replaced by their windows.
FREQUENT, MOST_FREQUENT = 2000, 64_000
#: Bytes of text up to which these hold (see `sizes`).
BASE = 256 << 20
LAST = 2**63 - 1
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def sizes(total: int) -> tuple[int, int, int]:
    """(text of a chunk, text of a range, occurrences of an anchor that are many) for so many bytes of text. Each chunk sends a row to each range, so beyond BASE
    both grow with the root of the text: the rows then grow as the text does, and not with its square."""
    more = max(1.0, total / BASE)
    return int(CHUNK * more**0.5), int(RANGE * more**0.5), int(min(FREQUENT * more, MOST_FREQUENT))


def packed(**arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def unpacked(data) -> dict:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def chunks(docs: DataFrame, chunk_bytes: int, folder: str) -> DataFrame:
    """chunk, size; a file for each chunk in the shared folder has its texts one after the other, their ids and lengths."""

    def pack(batches):
        part, turn, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        store, at = storage(folder)

        def row():
            publish(store, at, f"{part << 24 | turn}", packed(
                ids=np.array(ids, np.int64), lengths=np.array([len(t) for t in texts], np.int64), text=b"".join(texts)))
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | turn], pa.int64()), pa.array([size], pa.int64())], names=["chunk", "size"])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(LAST if i.as_py() is None else i.as_py())
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield row()
                    turn, ids, texts, size = turn + 1, [], [], 0
        if ids:
            yield row()

    store, at = storage(folder)
    store.create_dir(at, recursive=True)
    return written(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(pack, "chunk long, size long"), "chunks")


def chunk_data(folder: str, chunk) -> dict:
    store, at = storage(folder)
    return unpacked(store.open_input_stream(f"{at}/{chunk}").read())


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M3
    return h ^ (h >> np.uint64(29))


def rolled(a: np.ndarray, width: int) -> np.ndarray:
    """A hash of every width-byte string of a byte array, by doubling."""
    h, w, m = a.astype(np.uint64) * M1 + M2, 1, M2
    while 2 * w <= width:
        h, m, w = h[:-w] * m + h[w:], np.uint64(int(m) ** 2 % (1 << 64)), 2 * w
    if w < width:
        n = len(a) - width + 1
        h = h[:n] * M1 + h[width - w : width - w + n]
    return mixed(h)


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every window of so many values."""
    at, w = np.arange(len(h), dtype=np.int32), 1
    while w < width:
        s = min(w, width - w)
        right = h[s:] < h[:-s]
        at, h = np.where(right, at[s:], at[:-s]), np.where(right, h[s:], h[:-s])
        w += s
    return at


def anchors(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, least offset, largest offset, hash) of every anchor of a chunk; offsets are of the place in its windows."""
    found = []
    for low in range(0, max(len(text) - WINDOW + 1, 0), STEP):
        a = text[low : low + STEP + WINDOW - 1]
        h = rolled(a, GRAM)
        at = least_places(h, SPAN + 1)[: len(a) - WINDOW + 1]
        s = np.arange(len(at))
        ok = s + low + WINDOW <= ends[np.searchsorted(starts, s + low, "right") - 1]
        s, at = s[ok], at[ok]
        if not len(s):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1])]))
        last = np.append(new[1:], len(s)) - 1
        p = at[new]
        found.append((p + low, p - s[last], p - s[new], h[p]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    p, least, most, h = (np.concatenate(x) for x in zip(*found, strict=True))
    # an anchor whose windows lie in two steps comes twice
    new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return p[new], np.minimum.reduceat(least, new), np.maximum.reduceat(most, new), h[new]


class Chunk:
    def __init__(self, x: dict) -> None:
        self.ids, self.text = x["ids"], np.frombuffer(x["text"], np.uint8)
        self.ends = np.cumsum(x["lengths"])
        self.starts = self.ends - x["lengths"]
        # of empty texts that start where another does, the last one counts
        self.place, self.least, self.most, h = anchors(self.text, self.starts, self.ends)
        self.doc = np.searchsorted(self.starts, self.place, "right") - 1
        self.hash = mixed(h * M1 + M2) >> np.uint64(16)  # 48 bits are kept


def split(order: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each 48-bit hash."""
    return ((order >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def borders(of: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return list(zip(of[at].tolist(), at.tolist(), np.append(at[1:], len(of)).tolist(), strict=False))


SHAPE = "kind int, place long, chunk long, data binary"
ROW = pa.schema([("kind", pa.int32()), ("place", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])


def rows_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(ROW.names, r, strict=True)) for r in rows], ROW)


TOLD, TEXT, RUN, ANSWER = range(4)


def hashes_of(packs: DataFrame, ranges: int, folder: str) -> DataFrame:
    def each(batches):
        for batch in batches:
            for chunk in batch.column("chunk").to_pylist():
                c = Chunk(chunk_data(folder, chunk))
                order = np.lexsort((c.ids[c.doc], c.hash))
                h, d = c.hash[order], c.ids[c.doc][order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                last = np.append(first[1:], len(h)) - 1
                code = (level(last - first + 1) * 2 + (d[first] != d[last])).astype(np.uint8) if len(h) else np.zeros(0, np.uint8)
                h = h[first]
                out = [(TOLD, r, chunk, packed_hashes(h[a:b], code[a:b])) for r, a, b in borders(split(h, ranges))]
                yield from rows_of(out).to_batches()

    return packs.mapInArrow(each, SHAPE)


def level(n: np.ndarray) -> np.ndarray:
    """Counts in seven bits: up to 63 as they are, then in steps of a quarter of a power of two."""
    return np.where(n < 64, n, np.minimum(64 + np.floor(4 * np.log2(np.maximum(n, 64) / 64)), 127)).astype(np.int64)


def counted(code: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    code = code.astype(np.int64)
    return np.where(code < 64, code, 64 * 2.0 ** ((code - 64) / 4)).astype(np.int64)


def packed_hashes(h: np.ndarray, code: np.ndarray) -> bytes:
    return (h >> np.uint64(16)).astype("<u4").tobytes() + (h & np.uint64(0xFFFF)).astype("<u2").tobytes() + code.tobytes()


def unpacked_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 7
    high, low = np.frombuffer(data, "<u4", n), np.frombuffer(data, "<u2", n, 4 * n)
    return high.astype(np.uint64) << np.uint64(16) | low, np.frombuffer(data, np.uint8, n, 6 * n)


def shared_hashes(group: pa.Table, frequent: int) -> pa.Table:
    """Of a range's hashes, tells each chunk those that two documents have; code 1: very frequent."""
    owners = group.column("chunk").to_pylist()
    parts = [unpacked_hashes(x.as_py()) for x in group.column("data")]
    h, code = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    n = np.diff(np.append(first, len(h)))
    both = (n > 1) | (np.maximum.reduceat(code[order] & 1, first) > 0)
    often = np.add.reduceat(counted(code[order] >> 1), first) > frequent
    keep, hot = np.empty(len(h), bool), np.empty(len(h), np.uint8)
    keep[order], hot[order] = np.repeat(both, n), np.repeat(often, n)
    ends = np.cumsum([len(x) for x, _ in parts])
    out = []
    for c, (x, _), end in zip(owners, parts, ends.tolist(), strict=True):
        own = slice(end - len(x), end)
        if keep[own].any():
            out.append((TOLD, 0, c, packed_hashes(x[keep[own]], hot[own][keep[own]])))
    return rows_of(out)


class Run:
    """A front-coded sorted run, decoded key by key."""

    def __init__(self, x: dict) -> None:
        self.lcp, self.tails, self.at, self.i, self.key = x["lcp"].tolist(), x["tails"], 0, -1, b""

    def step(self) -> int:
        """Moves to the next key; returns its common prefix with the one before, or -1 at the end."""
        self.i += 1
        if self.i >= len(self.lcp):
            self.key = None
            return -1
        n = self.lcp[self.i]
        end = self.at + KEY - n
        self.key = self.key[:n] + self.tails[self.at : end]
        self.at = end
        return n


def merged(runs: list[Run]):
    """Yields (run, its place, key, common prefix with the key before) in the order of all keys.

    A loser tree: each inner node keeps the run that lost there and the length of its common prefix with the winner. As the
    next key of the winning run climbs, the longer known prefix with the last winner wins without a comparison; only equal
    ones are compared, and from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    known = [r.step() if r is not None else -1 for r in runs] + [-1] * (k - len(runs))
    # before the first winner nothing is known
    known = [min(x, 0) for x in known]
    loser = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser) of two runs; sets the loser's known prefix with the winner."""
        a, b = known[x], known[y]
        if a != b:
            return (x, y) if a > b else (y, x)
        if a < 0:
            return x, y
        p, q = runs[x].key, runs[y].key
        if p == q:
            known[y if x < y else x] = KEY
            return (x, y) if x < y else (y, x)
        rest = KEY - a
        diff = int.from_bytes(p[a:]) ^ int.from_bytes(q[a:])
        same = a + rest - (diff.bit_length() + 7) // 8
        if p[same] < q[same]:
            known[y] = same
            return x, y
        known[x] = same
        return y, x

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, lose = play(build(2 * node), build(2 * node + 1))
        loser[node] = lose
        return win

    win = build(1) if k > 1 else 0
    while known[win] >= 0:
        run = runs[win]
        yield win, run.i, run.key, known[win]
        known[win] = run.step()
        node = (win + k) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


def common(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row of bytes with the one before."""
    differs = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(differs.any(1), differs.argmax(1), rows.shape[1])])[: len(rows)]


def covered(lcp: np.ndarray, back: np.ndarray, doc: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For suffixes in byte order: a bit for each offset whose window also is in a smaller document.

    lcp: common prefix of each with the one before; back: rows of the SPAN bytes before it, read backwards.
    """
    order = np.argsort(back.view(f"S{SPAN}")[:, 0], kind="stable")
    same, behind = common(back[order]), np.empty(len(doc), np.int64)
    masks = np.zeros(len(doc), np.uint64)
    for o in range(SPAN + 1):
        own = np.flatnonzero((least <= o) & (o <= most))
        if len(own) < 2:
            continue
        behind[order] = np.cumsum(same < o)
        window = np.cumsum(lcp < WINDOW - o)[own] * (len(doc) + 1) + behind[own]
        by = np.lexsort((doc[own], window))
        own, window = own[by], window[by]
        first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        head = np.repeat(own[first], np.diff(np.append(first, len(own))))
        masks[own[doc[own] > doc[head]]] |= np.uint64(1 << o)
    return masks


#: Suffixes held against each other at once, if no group is larger.
MANY = 20_000


def answers(group: pa.Table) -> pa.Table:
    """Merges a range's runs; tells each chunk which windows of its suffixes are in smaller documents."""
    owners = group.column("chunk").to_pylist()
    more = [unpacked(x.as_py()) for x in group.column("data")]
    told: list[tuple[list, list]] = [([], []) for _ in owners]
    keys: list[bytes] = []
    who: list[tuple[int, int, int]] = []

    def settle():
        if not keys:
            return
        run, place, lcp = np.array(who, np.int64).T
        pick = lambda x: np.array([more[r][x][i] for r, i, _ in who], np.int64)
        back = np.ascontiguousarray(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY)[:, WINDOW:])
        masks = covered(lcp, back, pick("doc"), pick("least"), pick("most"))
        for r in np.unique(run[masks > 0]).tolist():
            own = (run == r) & (masks > 0)
            told[r][0].append(place[own] + more[r]["first"])
            told[r][1].append(masks[own])
        keys.clear(), who.clear()

    start = 0
    for r, i, key, lcp in merged([Run(x) for x in more]):
        if lcp < GRAM:  # a suffix that shares no anchor's string with a neighbour matches nothing
            if len(keys) - start == 1:
                keys.pop(), who.pop()
            start = len(keys)
            if start > MANY:
                settle()
                start = 0
        keys.append(key), who.append((r, i, lcp))
    settle()
    return rows_of([(ANSWER, 0, c, packed(entry=np.concatenate(e), mask=np.concatenate(m))) for c, (e, m) in zip(owners, told, strict=True) if e])


def summary(doc_id, text: np.ndarray, gone: np.ndarray) -> tuple:
    n = int(gone.sum())
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
    return doc_id, len(text), n, spans, hashlib.sha256(text[~gone].tobytes() if n else text.tobytes()).hexdigest()


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def results(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(RESULT.names, (None if r[0] == LAST else r[0], *r[1:]), strict=True)) for r in rows], RESULT)


def sorted_runs(group: pa.Table, ranges: int, folder: str) -> pa.Table:
    """A chunk's front-coded runs for each range. What is needed to apply the answers, and the results of documents that need none, go to its file."""
    kinds, data = group.column("kind").to_pylist(), group.column("data")
    chunk = group.column("chunk")[0].as_py()
    c = Chunk(chunk_data(folder, chunk))
    told = [unpacked_hashes(d.as_py()) for k, d in zip(kinds, data, strict=True) if k == TOLD]
    h, hot = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    order = np.argsort(h)
    h, hot = h[order], hot[order]
    at = np.searchsorted(h, c.hash)
    mine = np.flatnonzero((at < len(h)) & (h[np.minimum(at, len(h) - 1)] == c.hash)) if len(h) else np.zeros(0, np.int64)
    often = hot[at[mine]] > 0
    place, least, most, order, doc = (x[mine[~often]] for x in (c.place, c.least, c.most, c.hash, c.doc))
    if often.any():
        wide = mine[often]
        n = c.most[wide] - c.least[wide] + 1
        into = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s = np.repeat(c.place[wide] - c.most[wide], n) + into
        w = np.zeros(len(s), np.uint64)
        for j in range(WINDOW):
            w = w * M1 + c.text[s + j] + np.uint64(1)
        place, order = np.concatenate([place, s]), np.concatenate([order, mixed(w) >> np.uint64(16)])
        least, most = (np.concatenate([x, np.zeros(len(s), np.int64)]) for x in (least, most))
        doc = np.concatenate([doc, np.repeat(c.doc[wide], n)])
    ids = c.ids[doc]
    keys = np.zeros((len(place), KEY + 2), np.uint8)
    for j in range(WINDOW):
        use = j < WINDOW - least
        keys[use, j] = c.text[place[use] + j]
    for j in range(SPAN):
        use = j < most
        keys[use, WINDOW + j] = c.text[place[use] - 1 - j]
    keys[:, KEY], keys[:, KEY + 1] = least + 1, most + 1
    flat, into = keys.view(f"S{KEY + 2}")[:, 0] if len(keys) else np.zeros(0, f"S{KEY + 2}"), split(order, ranges)
    by = np.lexsort((ids, flat, into))
    flat, ids, place, least, most, keys, into = (x[by] for x in (flat, ids, place, least, most, keys, into))
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    entry = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(flat))))
    known = ids > ids[first][entry]  # a smaller document in this chunk has all their windows
    out = []
    head = keys[first][:, :KEY]
    for r, a, b in borders(into[first]):
        part = head[a:b]
        lcp = common(part).astype(np.uint8)
        tails = part[np.arange(KEY) >= lcp[:, None]].tobytes()
        out.append((RUN, r, chunk, packed(lcp=lcp, tails=tails, doc=ids[first[a:b]], least=least[first[a:b]].astype(np.uint8),
                                          most=most[first[a:b]].astype(np.uint8), first=a)))
    touched = np.zeros(len(c.ids), bool)
    touched[doc] = True
    done = [summary(i, t := c.text[a:b], np.zeros(len(t), bool)) for i, a, b, x in
            zip(c.ids.tolist(), c.starts.tolist(), c.ends.tolist(), touched, strict=True) if not x]
    store, at = storage(folder)
    publish(store, at, f"{chunk}.rest", packed(
        docs=np.flatnonzero(touched), known=np.stack([place[known] - most[known], place[known] - least[known]]).astype(np.int32),
        entry=entry[~known].astype(np.int32), place=place[~known].astype(np.int32), done=done))
    return rows_of(out)


def applied(group: pa.Table, folder: str) -> pa.Table:
    """The results of a chunk's documents."""
    chunk = group.column("chunk")[0].as_py()
    told = [unpacked(x.as_py()) for k, x in zip(group.column("kind").to_pylist(), group.column("data"), strict=True) if k == ANSWER]
    whole, c = chunk_data(folder, chunk), chunk_data(folder, f"{chunk}.rest")
    text, ends = np.frombuffer(whole["text"], np.uint8), np.cumsum(whole["lengths"])
    edge = np.zeros(len(text) + WINDOW + 1, np.int64)

    def remove(low, high):
        edge[:] += np.bincount(low, minlength=len(edge))
        edge[:] -= np.bincount(high + WINDOW, minlength=len(edge))

    remove(*c["known"])
    if told:
        entry, mask = (np.concatenate([x[k] for x in told]) for k in ("entry", "mask"))
        order = np.argsort(c["entry"], kind="stable")
        own, place = c["entry"][order], c["place"][order]
        low = np.searchsorted(own, entry, "left")
        n = np.searchsorted(own, entry, "right") - low
        at = place[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        mask = np.repeat(mask, n)
        starts = [at[(mask >> np.uint64(o)) & np.uint64(1) > 0] - o for o in range(SPAN + 1)]
        remove(np.concatenate(starts), np.concatenate(starts))
    gone = np.cumsum(edge[: len(text)]) > 0
    return results(c["done"] + [summary(i, text[b - n : b], gone[b - n : b]) for i, n, b in
                                zip(*(x[c["docs"]].tolist() for x in (whole["ids"], whole["lengths"], ends)), strict=True)])


def deduplicated(docs: DataFrame, chunk_bytes: int | None = None, frequent: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "texts")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunk, span, often = sizes(total)
    often = often if frequent is None else frequent
    packs = chunks(docs, chunk_bytes or chunk, folder)
    ranges = max(shuffle_partitions(spark), -(-total // span))
    shape = ", ".join(f"{f.name} {'string' if f.name == 'kept_sha256' else 'long'}" for f in RESULT)
    told = hashes_of(packs.repartition(ranges, "chunk"), ranges, folder).groupBy("place").applyInArrow(lambda g: shared_hashes(g, often), SHAPE)
    texts = packs.select(F.lit(TEXT).alias("kind"), F.lit(0).cast("long").alias("place"), "chunk", F.lit(b"").alias("data"))
    # what a chunk keeps for itself goes to a file beside its texts, so its runs are only ever in one shuffle; a chunk's work isn't told by the size of its
    # rows there, so the tasks are as many as the ranges
    runs = texts.unionByName(told).repartition(ranges, "chunk").groupBy("chunk").applyInArrow(lambda g: sorted_runs(g, ranges, folder), SHAPE)
    told = runs.repartition(ranges, "place").groupBy("place").applyInArrow(answers, SHAPE)
    return texts.unionByName(told).repartition(ranges, "chunk").groupBy("chunk").applyInArrow(lambda g: applied(g, folder), shape)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
