"""WARC: deterministic sharded writer and reader.

Records are range-sorted by page_id and digest and written as gzip members; a file is rolled when its compressed size reaches
roll_bytes. The ranges' borders are quantiles of the keys with the smallest hashes, so they hang on the rows and the number of ranges alone: the same
pages give the same files, however they are partitioned. Headers and SHA-256 digests are made anew from the payload. Of pages with equal payloads of at least
MIN_REVISIT bytes the smallest page_id is a response and the others are revisits without payload. Every file is written
under a temporary name and renamed; manifest.json lists the files that count, so what a lost task left is never read.

Defined results: a null html is an empty payload; a null page_id comes first and is always a response; of rows that repeat a page_id
each is judged by its own payload, so those with the smallest page_id of their payload are all responses (numbered in their record
ids) and no payload is ever left out; a null url is written as about:blank; an empty table gives a manifest without files.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_path, publish, shuffle_partitions, storage, table, written

MIN_REVISIT = 100
ROLL_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
LEVEL = 4
#: Records of a batch that is read; keys of the sample for each range.
ROWS, SAMPLE = 1000, 64


def record_id(page_id, sha: str, turn: int) -> str:
    """turn numbers the records of a page with equal payloads."""
    return f"<urn:page:{page_id if page_id is not None else ''}:{sha}:{turn}>"


def digest_value(hex_digest: str) -> str:
    """SHA-256 in base 32, as WARC files carry it."""
    return "sha256:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id, turn: int, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    sha = hashlib.sha256(payload).hexdigest()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha, turn)}",
             f"WARC-Date: {DATE}", "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank"),
             f"WARC-Payload-Digest: {digest_value(sha)}", f"WARC-Block-Digest: {digest_value(hashlib.sha256(body).hexdigest())}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha, 0)}"]
    raw = "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, LEVEL, mtime=0)


def key_of(page_id: str, digest: str) -> Column:
    """A string in the order of (page_id, digest), nulls first."""
    return F.concat(F.coalesce(F.lpad(F.hex(F.col(page_id).bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("")), digest)


def borders(keys: DataFrame, ranges: int) -> list[str]:
    """The first keys of all ranges but the first one, from a sample of SAMPLE keys for each."""
    sample = sorted(r.key for r in keys.distinct().orderBy(F.xxhash64("key"), "key").limit(ranges * SAMPLE).collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> dict:
    """Write pages(page_id, url, html) to folder; returns the manifest. Only a row per file and the sample of keys reach the driver."""
    spark, n = pages.sparkSession, shuffle_partitions(pages.sparkSession)
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    digests = (pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.length(payload).alias("size"))
               .where(F.col("size") >= MIN_REVISIT))
    first = (digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
             .where("first < last").select("digest", "first"))
    later = digests.join(first, "digest").where("page_id > first").select("page_id", "digest", "first").distinct()
    # the row of a page and payload with its role goes just before its records: so the payloads are shuffled once
    rows = (pages.select("page_id", "url", payload.alias("payload"), F.lit(None).cast("long").alias("first"), F.lit(1).alias("turn"),
                         F.sha2(payload, 256).alias("digest"))
            .unionByName(later.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
                                      "first", F.lit(0).alias("turn"), "digest"))
            .withColumn("key", key_of("page_id", "digest")))
    cuts = borders(rows.where("turn = 1").select("key"), n)

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        return pa.array([bisect_right(cuts, k) for k in keys.to_pylist()], pa.int32())

    rows = (rows.withColumn("range", range_of("key")).drop("key").repartitionByRange(n, "range")
            .sortWithinPartitions("range", "page_id", "digest", "turn", "url"))

    def write(batches):
        (store, at), now, own = storage(folder), None, 0
        files, parts, size, count, last, turn, refers = [], [], 0, 0, (), 0, None

        def close():
            nonlocal parts, size, count, own
            data, name = b"".join(parts), f"pages-{now:05d}-{own:05d}.warc.gz"
            own += 1
            publish(store, at, name, data)
            files.append((name, count, len(data), hashlib.sha256(data).hexdigest()))
            parts, size, count = [], 0, 0

        for batch in batches:
            for page_id, url, data, own_first, role, digest, place in zip(*[batch.column(i) for i in range(7)], strict=True):
                page_id, place = page_id.as_py(), place.as_py()
                if place != now:
                    if parts:
                        close()
                    now, own = place, 0
                if (page_id, digest.as_py()) != last:
                    last, turn, refers = (page_id, digest.as_py()), 0, None
                if role.as_py() == 0:
                    refers = own_first.as_py()
                    continue
                data = data.as_py()
                parts.append(record(page_id, turn, url.as_py(), data, refers))
                turn, size, count = turn + 1, size + len(parts[-1]), count + 1
                if size >= roll_bytes:
                    close()
        if parts:
            close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*files, strict=True)], names=["name", "n", "bytes", "sha256"])

    store, at = storage(folder)
    store.create_dir(at, recursive=True)
    made = rows.mapInArrow(write, "name string, n long, bytes long, sha256 string").collect()
    manifest = {"files": [r.asDict() for r in sorted(made, key=lambda r: r.name)]}
    publish(store, at, "manifest.json", json.dumps(manifest).encode())
    return manifest


def records(stream):
    """(headers, body) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers = {"version": line.strip().decode()}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8").partition(":")
            headers[key.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def page_of(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+):\w+:\d+>", value or "")
    return int(m[1]) if m else None


def read_records(spark, folder: str, payloads: bool = False) -> DataFrame:
    """Every record in the files that the manifest lists: record_id, refers_id, page_id, payload_bytes, payload_digest, record_type, refers_to,
    url, intact (its digests are right) and, if asked for, the payload that it carries."""
    store, at = storage(folder)
    names = [(f["name"],) for f in json.loads(store.open_input_stream(f"{at}/manifest.json").read())["files"]]
    shape = ("record_id string, refers_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
             "url string, intact boolean, payload binary")
    if not names:
        return spark.createDataFrame([], shape)
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in shape.split(", "))])

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = storage(folder)
                out = []
                with gzip.open(io.BufferedReader(store.open_input_file(f"{at}/{name}"), 1 << 20)) as stream:
                    for headers, body in records(stream):
                        http, _, payload = body.partition(b"\r\n\r\n")
                        revisit = headers["warc-type"] == "revisit"
                        length = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha256:")).hex()
                        whole = hashlib.sha256(body).digest() == base64.b32decode(headers["warc-block-digest"].removeprefix("sha256:"))
                        if not revisit:
                            whole &= hashlib.sha256(payload).hexdigest() == digest and len(payload) == length
                        refers = headers.get("warc-refers-to")
                        out.append((headers["warc-record-id"], refers, page_of(headers["warc-record-id"]), length, digest, headers["warc-type"],
                                    page_of(refers), headers["warc-target-uri"], whole, payload if payloads and not revisit else None))
                        if len(out) >= ROWS:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    return spark.createDataFrame(names, "name string").repartitionByRange(len(names), "name").mapInArrow(read, shape)


def read_warc(spark, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact of every record. A revisit is intact if the record that it
    refers to is in the archives, a response with the same payload digest and length."""
    found = written(read_records(spark, folder).drop("payload"), "warc-records")
    answer = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("payload_digest").alias("__digest"),
                                                            F.col("payload_bytes").alias("__bytes"), F.col("intact").alias("__whole"))
    revisits = found.where("record_type = 'revisit'").join(answer, "refers_id", "left").withColumn(
        "intact", F.col("intact") & F.coalesce((F.col("__digest") == F.col("payload_digest")) & (F.col("__bytes") == F.col("payload_bytes"))
                                               & F.col("__whole"), F.lit(False)))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact"]
    out = written(found.where("record_type = 'response'").select(names).unionByName(revisits.select(names)), "warc-pages")
    discard(found)
    return out


def op7_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    out = read_warc(spark, folder)
    discard(folder)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP7_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to, TRUE AS intact
FROM f"""
