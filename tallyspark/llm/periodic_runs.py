"""Periodic runs of words, by branching tandem repeats in a suffix tree (Stoye and Gusfield).

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least max(LEAST, TIMES * q)
words. The suffix trees of a batch's documents are held as one suffix array with the lengths of common prefixes; its
intervals are the inner nodes. At a node of depth D only the leaves outside the largest child are visited (the smaller
half): leaf i and leaf i + D, or i - D, in one node but in different children are a branching tandem repeat. Each is rotated
to the left as far as it goes, and repeats that give the same stretch are merged under their smallest period.

Documents are read where they lie: no shuffle, no state between batches, nothing at the driver. A task holds BATCH words at
a time, or one longer text.

Defined results: a null, empty or blank text has no words, no run and the digests of nothing; a null doc_id is never
rewritten by `planted`; rows that repeat are judged alike, each on its own; an empty table gives an empty result. Words
are cut at ASCII white space and compared as they are. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

LEAST, TIMES = 6, 4
#: Words whose trees are built together.
BATCH = 1 << 17
SHAPE = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
KINDS = [pa.int64()] * 6 + [pa.string()] * 2


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word each of n words is, where the document is one of those to rewrite with a period; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


class SuffixTrees:
    """The suffix trees of several texts, given as one array of word codes that no two texts share; stop: the end of each word's text."""

    def __init__(self, codes: np.ndarray, stop: np.ndarray) -> None:
        self.codes, self.stop, n = codes, stop, len(codes)
        self.order = np.argsort(codes, kind="stable")
        head = np.concatenate([[True], codes[self.order[1:]] != codes[self.order[:-1]]]) if n else np.zeros(0, bool)
        levels, step = [], 1
        while True:
            first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
            rank = np.empty(n, np.int32)
            rank[self.order] = first
            levels.append(rank)
            alone = head & np.append(head[1:], True)
            slots = np.flatnonzero(~alone)  # only what isn't told apart yet is sorted again
            if not len(slots):
                break
            own = self.order[slots]
            ahead = own + step
            after = np.where(ahead < stop[own], rank[np.minimum(ahead, n - 1)], -1)
            key = rank[own].astype(np.int64) * (n + 1) + after + 1
            by = np.argsort(key, kind="stable")
            self.order[slots], key = own[by], key[by]
            head[slots[1:]] |= key[1:] != key[:-1]
            step *= 2
        self.rank = levels[-1]
        self.common = self.common_prefixes(levels)

    def common_prefixes(self, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each suffix has in common with the one before it in order; the levels tell whether 2^k words are equal."""
        common = np.zeros(len(self.order), np.int64)
        where = np.flatnonzero(levels[0][self.order[1:]] == levels[0][self.order[:-1]]) + 1 if len(self.order) else common
        a, b = self.order[where - 1], self.order[where]
        far_a, far_b, size, last = self.stop[a], self.stop[b], np.zeros(len(where), np.int64), len(self.order) - 1
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + size, b + size
            size += ((x < far_a) & (y < far_b) & (levels[k][np.minimum(x, last)] == levels[k][np.minimum(y, last)])) << k
        common[where] = size
        return common

    def nodes(self):
        """Depth, left and right end of each inner node, and those of its largest child."""
        out, stack = [], []
        inner = np.flatnonzero(self.common > 0)
        if not len(inner):
            return np.zeros((0, 5), np.int64)
        # a stretch of common prefixes ends where the next position isn't the one after it
        ends = np.append(np.diff(inner) > 1, True).tolist()
        for k, depth, end in zip(inner.tolist(), self.common[inner].tolist(), ends, strict=True):
            left, right = k - 1, k - 1
            while stack and stack[-1][0] > depth:
                d, low, x, y = stack.pop()
                if right - left > y - x:
                    x, y = left, right
                out.append((d, low, right, x, y))
                left = low
            if stack and stack[-1][0] == depth:
                if right - left > stack[-1][3] - stack[-1][2]:
                    stack[-1][2:] = left, right
            else:
                stack.append([depth, left, left, right])
            if end:
                left = right = k
                while stack:
                    d, low, x, y = stack.pop()
                    if right - left > y - x:
                        x, y = left, right
                    out.append((d, low, right, x, y))
                    left = low
        return np.array(out, np.int64)

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(i, D) of the branching tandem repeats: D words from i on, once more, and then another word."""
        found = []
        depth, left, right, big_left, big_right = self.nodes().T
        for low, size in ((left, big_left - left), (big_right + 1, right - big_right)):
            node = np.repeat(np.arange(len(depth)), size)
            p = self.order[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
            d, stop = depth[node], self.stop[p]
            for i, j in ((p, p + d), (p - d, p)):
                at = np.flatnonzero((i >= 0) & (j < stop) & (self.stop[i] == stop))
                other = self.rank[np.where(i == p, j, i)[at]]
                at = at[(other >= left[node[at]]) & (other <= right[node[at]])]
                x, y, n = i[at], j[at], d[at]
                after = y + n
                ends = after >= stop[at]
                ends[~ends] = self.codes[after[~ends]] != self.codes[y[~ends]]
                found.append(np.stack([x[ends], n[ends]], 1))
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return both[:, 0], both[:, 1]


def rotated(codes: np.ndarray, i: int, d: int, start: int) -> int:
    """Where the run of a repeat (i, d) begins: rotations to the left go on while the word before equals its like d further on."""
    width = 64
    while i > start:
        low = max(start, i - width)
        unlike = np.flatnonzero(codes[low:i] != codes[low + d : i + d])
        if len(unlike):
            return low + int(unlike[-1]) + 1
        i, width = low, width * 2
    return i


def maximal_runs(codes: np.ndarray, start: np.ndarray, stop: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of all texts in codes; start, stop: the ends of each word's text."""
    if not len(codes):
        return []
    i, d = SuffixTrees(codes, stop).branching_repeats()
    # a run that is long enough goes on to the left of its branching repeat: two or three words of it tell most others
    need = np.maximum(least, times * d) - 2 * d
    keep = i - need >= start[i]
    i, d, need = i[keep], d[keep], need[keep]
    same = np.all([codes[i - back] == codes[i - back + d] for back in (1, d, need)], axis=0)
    i, d = i[same], d[same]
    by = np.lexsort((d, i + 2 * d))
    out, end_now, known = [], -1, []
    for x, n, low in zip(i[by].tolist(), d[by].tolist(), start[i[by]].tolist(), strict=True):
        end = x + 2 * n
        if end != end_now:
            end_now, known = end, []
        if any(n % q == 0 and at <= x for at, q in known):
            continue  # the same stretch under a multiple of its period
        at = rotated(codes, x, n, low)
        known.append((at, n))
        if end - at >= max(least, times * n):
            out.append((at, end - at, n))
    return sorted(out, key=lambda r: (r[0], r[2]))


def described(doc_id, words: list[bytes], own: list[tuple[int, int, int]]) -> tuple:
    """The result's row of a text with such runs."""
    best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    if own:
        gone = np.zeros(len(words), bool)
        for at, n, q in own:
            gone[at + q : at + n] = True
        words = [words[k] for k in np.flatnonzero(~gone).tolist()]
    return (doc_id, len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in own).encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def runs_of_batch(texts: list[tuple[int | None, list[bytes]]], least: int, times: int) -> list[tuple]:
    """The rows of some texts, given as (doc_id, words)."""
    codes, sizes, seen = [], [], 0
    for _, words in texts:
        known: dict[bytes, int] = {}
        codes.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64) + seen)
        sizes.append(len(words))
        seen += len(known)
    ends = np.cumsum(sizes)
    stop = np.repeat(ends, sizes)
    start = np.repeat(ends - sizes, sizes)
    of_text: dict[int, list] = {}
    for at, n, q in maximal_runs(np.concatenate(codes), start, stop, least, times):
        of_text.setdefault(int(start[at]), []).append((at - int(start[at]), n, q))
    return [described(i, words, of_text.get(end - size, []) if size else [])
            for (i, words), end, size in zip(texts, ends.tolist(), sizes, strict=True)]


def periodic_runs(docs: DataFrame, rewrite=None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs(doc_id, text) -> n_runs, the run with the greatest exponent, digests of all runs and of the text in which each run keeps its first
    period. rewrite(doc_id, n) may name the original word that stands at each place."""

    def each(batches):
        for batch in batches:
            texts, held, out = [], 0, []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                at = rewrite(i, len(words)) if rewrite else None
                texts.append((i, words if at is None else [words[k] for k in at.tolist()]))
                held += len(words)
                if held >= BATCH:
                    out += runs_of_batch(texts, least, times)
                    texts, held = [], 0
            out += runs_of_batch(texts, least, times) if texts else []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)] if out else
                                             [pa.array([], k) for k in KINDS], names=[c.split()[0] for c in SHAPE.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(each, SHAPE)


def op12_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted)
