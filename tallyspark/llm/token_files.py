"""Token-ID / binary output.

File format of a folder: shard-PPPPP-NNNNN.bin (partition, turn) holds the ids of all its documents as flat little-endian unsigned
integers (16 bits if the vocabulary fits, else 32); shard-PPPPP-NNNNN.idx holds 64-bit unsigned words: number of documents n, then n + 1
offsets (in ids, from the shard's start), then n document ids (two's complement). A shard ends with the document that brings it to
ROLL_IDS ids. manifest.json names the width and, for each shard, its base: the prefix sum of the ids in all shards before it.
Shards are in ascending doc_id order. A special token of the vocabulary that stands in a text gets its id, as the library has it.

Defined results: a null or empty text is the end id alone; rows that repeat a doc_id follow each other, ordered by text;
a null doc_id comes first and is kept as the smallest 64-bit integer in the files and null in results; an empty table gives
a folder without shards. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, publish, shuffle_partitions, storage, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Encoded pieces of one of the two generations that a worker keeps, and the bytes of text of a batch.
CACHE, BATCH = 150_000, 2 << 20
#: Ids of a shard, after which the next one begins.
ROLL_IDS = 1 << 26
NO_ID = -(2**63)
#: White space side by side; punctuation after a letter; what cuts pieces.
UNSAFE, TAIL, CUT = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}", r"(\p{L})([.,;:!?&$#*])", "\0"
#: Pieces that are encoded at once.
TOGETHER = 250


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes with a byte-level tokenizer of the tokenizers library, each distinct piece of a text once.

    The tokenizer's own pattern never lets a pre-token run over a space or line break that stands alone between two others, nor from
    a letter into the punctuation after it, so texts are cut there. A batch's pieces are numbered by Arrow, the distinct unknown ones are encoded as one text, whose ids are
    cut by the pieces' byte lengths, and NumPy puts the texts' ids together. Texts with white space side by side, with a special
    token of the vocabulary or with a null character are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values()) + (CUT,)
        # in a byte-level vocabulary a token has a character for each byte
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)])
        self.line = self.whole("\n")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def together(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that begin with a space or line break and don't end with white space."""
        ids = self.ids("".join(pieces))
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) for p in pieces]), "left") + 1
        data, cuts = ids.tobytes(), [0, *(ends * self.dtype.itemsize).tolist()]
        return [data[i:j] for i, j in zip(cuts, cuts[1:])]

    def learn(self, pieces: set[str]) -> None:
        known = self.known
        again = pieces.intersection(self.old)  # what the last generation used goes on from there
        known.update((p, self.old[p]) for p in again)
        pieces -= again
        odd = {p for p in pieces if not p or p[-1].isspace()}
        known.update((p, self.whole(p)) for p in odd)
        spaced = [p for p in pieces if p[:1] == " " and p not in odd]
        for i in range(0, len(spaced), TOGETHER):
            known.update(zip(spaced[i : i + TOGETHER], self.together(spaced[i : i + TOGETHER]), strict=True))
        # pieces without a space before them come after a line break here, which is a token of its own
        bare = [p for p in pieces if p[:1] != " " and p not in odd]
        for i in range(0, len(bare), TOGETHER):
            own = bare[i : i + TOGETHER]
            known.update((p, x[len(self.line) :]) for p, x in zip(own, self.together(["\n" + p for p in own]), strict=True))

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string array; none for a null."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, UNSAFE)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        cut = pc.replace_substring(pc.if_else(odd, "", texts), " ", CUT + " ")
        cut = pc.replace_substring_regex(pc.replace_substring(cut, "\n", f"{CUT}\n{CUT}"), TAIL, f"\\1{CUT}\\2")
        lists = pc.split_pattern(cut, CUT)
        numbered = lists.values.dictionary_encode()
        pieces, code = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        if new := set(pieces).difference(self.known):
            self.learn(new)
        coded = [self.known[p] for p in pieces]
        size = np.array([len(x) for x in coded], np.int64) // self.dtype.itemsize
        flat, first, n = np.frombuffer(b"".join(coded), self.dtype), np.cumsum(size) - size, size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy()].tolist()
        return [self.whole(t.as_py()) if x else ids[i:j].tobytes() for t, x, i, j in zip(texts, odd.to_pylist(), cuts, cuts[1:])]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of a string array of BATCH bytes or so, whole texts each."""
    turn = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy()) // BATCH
    cuts = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), len(texts)]
    return (texts.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, roll_ids: int = ROLL_IDS) -> dict:
    """Write docs(doc_id, text) into folder in ascending doc_id order; returns the manifest. Only a row per shard reaches the driver."""
    spark = docs.sparkSession

    def shard(batches):
        encode, parts, lengths, ids, size, turn = encoder(tokenizer), [], [], [], 0, 0
        end = np.array([end_id], encode.dtype).tobytes()
        part, (store, at) = TaskContext.get().partitionId(), storage(folder)

        def close():
            nonlocal parts, lengths, ids, size, turn
            name = f"shard-{part:05d}-{turn:05d}"
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
            publish(store, at, f"{name}.bin", b"".join(parts))
            publish(store, at, f"{name}.idx", np.array([len(ids)], "<u8").tobytes() + offsets.tobytes() + np.array(ids, "<i8").tobytes())
            row = pa.RecordBatch.from_pydict({"shard": pa.array([name]), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([size], pa.int64()),
                                              "width": pa.array([encode.dtype.itemsize], pa.int32())})
            parts, lengths, ids, size, turn = [], [], [], 0, turn + 1
            return row

        for batch in batches:
            coded = (x for own in slices(batch.column(1)) for x in encode.batch(own))
            for doc_id, data in zip(batch.column(0).to_pylist(), coded, strict=True):
                parts += data, end
                lengths.append(len(data) // encode.dtype.itemsize + 1)
                ids.append(NO_ID if doc_id is None else doc_id)
                size += lengths[-1]
                if size >= roll_ids:
                    yield close()
        if ids:
            yield close()

    store, at = storage(folder)
    store.create_dir(at, recursive=True)
    tie = F.xxhash64("text")
    rows = (docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), F.col("doc_id"), tie)
            .sortWithinPartitions(F.col("doc_id"), tie, F.col("text")).select("doc_id", "text")
            .mapInArrow(shard, "shard string, n_docs long, n_ids long, width int").collect())
    rows.sort(key=lambda r: r.shard)
    bases = np.cumsum([0, *[r.n_ids for r in rows]]).tolist()
    manifest = {"width": rows[0].width if rows else 2, "n_ids": bases[-1], "end_id": end_id,
                "shards": [{"shard": r.shard, "n_docs": r.n_docs, "n_ids": r.n_ids, "base": b}
                           for r, b in zip(rows, bases, strict=False)]}
    publish(store, at, "manifest.json", json.dumps(manifest).encode())
    return manifest


def open_shard(folder: str, shard: str, width: int):
    """(ids, offsets, doc_ids) of a shard: memory-mapped where the folder is local."""
    from pyarrow import fs

    store, at = storage(folder)
    name = f"{at}/{shard}"
    if isinstance(store, fs.LocalFileSystem):
        ids, index = (np.memmap(f"{name}.{x}", t, "r") for x, t in (("bin", f"<u{width}"), ("idx", "<u8")))
    else:
        ids, index = (np.frombuffer(store.open_input_stream(f"{name}.{x}").read(), t)
                      for x, t in (("bin", f"<u{width}"), ("idx", "<u8")))
    n = int(index[0])
    return ids, index[1 : n + 2], index[n + 2 :].view("<i8")


def read_tokens(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a folder, from its files."""
    store, at = storage(folder)
    manifest = json.loads(store.open_input_stream(f"{at}/manifest.json").read())
    width = manifest["width"]
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long"
    shards = [(s["shard"], s["base"]) for s in manifest["shards"]]
    if not shards:
        return spark.createDataFrame([], shape)

    def read(batches):
        for batch in batches:
            for shard, base in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids, offsets, doc_ids = open_shard(folder, shard, width)
                for low in range(0, len(doc_ids), 10_000):
                    own = doc_ids[low : low + 10_000]
                    at = offsets[low : low + 10_001].astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own, mask=own == NO_ID), "start": at[:-1] + base,
                                                      "n_tokens": np.diff(at), "ids_crc32": pa.array(crc, pa.int64())})

    return (spark.createDataFrame(shards, "shard string, base long").repartitionByRange(len(shards), "shard")
            .mapInArrow(read, shape))


def op5_tokens(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read_tokens(spark, folder)
