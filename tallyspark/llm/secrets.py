"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A maximal run of at least RUN characters of A-Z a-z 0-9 + / _ = - is opaque if a tiktoken vocabulary needs more than one
token for every RATIO characters of it, after known digests (hex of a usual length), UUIDs, all-digit and all-letter-of-
one-case identifiers (separators aside), and runs that overlap a fixed pattern's span are excluded. Prose and names, also in
mixed case, need fewer tokens, so nothing else is asked of a run without a digit.

A run that isn't opaque as a whole may hold an opaque part, such as a key after a path or a name: its pieces between / _ = -
are tested alone, and so are all stretches of whole tokens of at least RUN characters, for keys that have these characters
themselves; there separators count neither as characters nor as tokens, as names of short words have many. A stretch is cut
back to its short tokens and then widened to the pieces that it begins and ends in, without / _ = - around them; parts that overlap are one.

Positions are code points, ends exclusive. Defined results: a null or empty text has no spans; every row gives a row, so
repeated rows repeat; other columns are ignored. Long texts are scanned whole; a long run is tokenized in windows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table
from .token_files import tokenizer_path

RANKS = "byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
RUN, RATIO, WINDOW = 20, 2.0, 256
DIGESTS = {32, 40, 48, 56, 64, 96, 128}

SEPARATOR = re.compile(r"[:=]")
KEYWORD = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\Z", re.IGNORECASE | re.ASCII)
VALUE = re.compile(r"\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
UUID_INSIDE = re.compile(r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])")
BREAKS = "/_=-"
PIECE = re.compile(r"[^/_=-]+")
SEPARATORS = re.compile(r"[=_/+-]+")
#: Longest keyword and its quote.
REACH = 10

HEX_BIT, RUN_BIT = 1, 2
CLASSES = np.zeros(256, np.uint8)
for _c in b"0123456789abcdef":
    CLASSES[_c] |= HEX_BIT
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-":
    CLASSES[_c] |= RUN_BIT


def runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of true cells that are long enough."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def assignments(text: str) -> list[tuple[int, int]]:
    """The pattern's matches are found from their separator: every match has one, and only spaces, a quote and the keyword
    stand before it. A match also counts for the order if its value is too short."""
    found, at = [], 0
    for sep in SEPARATOR.finditer(text):
        k = sep.start()
        if k < at:
            continue
        end = k
        while end > at and text[end - 1] == " ":
            end -= 1
        low = max(at, end - REACH)
        key = KEYWORD.search(text[low:end])
        if not key:
            continue
        value = VALUE.match(text, k + 1)
        if not value:
            continue
        at = value.end()
        if len(value[1]) >= ASSIGN_LENGTH:
            found.append((low + key.start(), at))
    return found


class Ratio:
    """Characters a token of a string, under a tiktoken vocabulary."""

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def tokens(self, run: str) -> list[str]:
        piece = self.encoding.decode_single_token_bytes
        return [piece(t).decode("ascii") for i in range(0, len(run), WINDOW) for t in self.encoding.encode_ordinary(run[i : i + WINDOW])]

    def __call__(self, run: str) -> float:
        n = sum(len(self.encoding.encode_ordinary(run[i : i + WINDOW])) for i in range(0, len(run), WINDOW))
        return len(run) / n


def known(run: str) -> bool:
    """Digests, UUIDs, digits alone and letters of one case."""
    core = run.strip("=-_/+")
    if UUID.match(core) or len(core) in DIGESTS and re.fullmatch(r"[0-9a-fA-F]+", core):
        return True
    plain = SEPARATORS.sub("", core)
    return not plain or plain.isdigit() or plain.isalpha() and (plain.islower() or plain.isupper())


def opaque(run: str, ratio) -> bool:
    core = run.strip("=-_/+")
    return len(run) >= RUN and not known(run) and ratio(core if len(core) >= RUN else run) < RATIO


def stretches(run: str, ratio) -> list[tuple[int, int]]:
    """Unions of the shortest windows of whole tokens that have RUN characters and a low ratio, separators aside, at the edges
    of pieces."""
    tokens = ratio.tokens(run)
    sizes = np.array([len(t) for t in tokens])
    cores = np.array([len(SEPARATORS.sub("", t)) for t in tokens])
    edges, chars, n = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, cores, cores > 0))
    first = np.arange(len(sizes))
    last = np.searchsorted(edges, edges[:-1] + RUN)
    first, last = first[last <= len(sizes)], last[last <= len(sizes)]
    low = chars[last] - chars[first] < RATIO * (n[last] - n[first])
    marks = np.zeros(len(edges), int)
    np.add.at(marks, first[low], 1)
    np.add.at(marks, last[low], -1)
    out = []
    for i, j in runs(np.cumsum(marks)[:-1] > 0, 1):
        while edges[j] - edges[i + 1] >= RUN and cores[i] > RATIO:
            i += 1
        while edges[j - 1] - edges[i] >= RUN and cores[j - 1] > RATIO:
            j -= 1
        a, b = int(edges[i]), int(edges[j])
        while 0 < a and run[a] not in BREAKS and run[a - 1] not in BREAKS:
            a -= 1
        while b < len(run) and run[b - 1] not in BREAKS and run[b] not in BREAKS:
            b += 1
        while b - a > RUN and run[a] in BREAKS:
            a += 1
        while b - a > RUN and run[b - 1] in BREAKS:
            b -= 1
        out.append((a, b))
    return out


def opaque_parts(run: str, ratio) -> list[tuple[int, int]]:
    """The run as a whole if it's opaque, or its opaque parts in order, without known identifiers."""
    if opaque(run, ratio):
        return [(0, len(run))]
    pieces = [m.span() for m in PIECE.finditer(run) if m.end() - m.start() >= RUN]
    cut = merged([m.span() for m in UUID_INSIDE.finditer(run)] + [(a, b) for a, b in pieces if known(run[a:b])])
    found = [(a, b) for a, b in pieces if opaque(run[a:b], ratio)]
    at = 0
    for x, y in [*cut, (len(run), len(run))]:
        if x - at >= RUN:
            found += [(at + a, at + b) for a, b in stretches(run[at:x], ratio)]
        at = y
    return [(a, b) for a, b in merged(found) if not known(run[a:b])]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of spans that overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def scan(text: str | None, ratio) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans, in order."""
    if not text:
        return []
    kinds = CLASSES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    found = [(a, 0, b) for a, b in assignments(text)]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(a, 2, b) for a, b in runs(kinds & HEX_BIT > 0, HEX_LENGTH)]
    base = sorted(found)
    for a, b in runs(kinds & RUN_BIT > 0, RUN):
        if not any(x < b and a < y for x, _, y in base):
            found += [(a + x, 3, a + y) for x, y in opaque_parts(text[a:b], ratio)]
    return sorted(found)


def spans_of(docs: DataFrame, ranks: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id and its spans, as an array of (kind, start, end)."""

    def each(batches):
        ratio = Ratio(ranks)
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t.as_py(), ratio)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.struct(
                [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        each, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    found = spans_of(table(spark, sf_dir, "documents"), tokenizer_path(RANKS))
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
