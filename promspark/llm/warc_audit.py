"""Operator 8: WARC files and the fixity audit of their replicas by Merkle trees.

``write`` makes gzip-compressed WARC files of at most ``records_per_file``
records.  ``leaves`` reads the files of a replica and hashes every record
with its offset range.  ``levels`` hashes ``fanout`` neighbouring ranges into
one, level by level, to a root per file and then over the files to one root
per replica.  ``audit`` compares the roots of two replicas and descends only
into branches that differ, to the records that differ.

Each record names the SHA-256 of its payload, so the audit can tell which of
two copies is damaged.

Rules: a null payload is written as an empty one; a null URI is left out.
Repeated rows are records of their own.  Bytes that cannot be read as a record
(a broken stream or header) make one last leaf of the file's rest.  A record
or file that one replica lacks differs.  Files pair up by their number, which
both replicas of a table share.  An empty table has no files, no root and no
difference.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

RECORDS_PER_FILE, FANOUT = 2000, 16
FILES_PER_PART = 1 << 20  # Spark itself ends a task that opens more than 1,000,000 files
END = "\r\n"
FILE = re.compile(r"part-(\d+)-.*?(?:-c(\d+))?\.txt")
LEAF = "file_no bigint, idx bigint, start bigint, length bigint, record_id string, uri string, hash string, payload string, sound boolean"


def records(df: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", keep: list[str] = ()) -> DataFrame:
    """(record, payload_at, payload, columns to keep): WARC resource records as text, and the place (from 1)
    of the payload in them."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    target = F.regexp_replace(F.col(f"`{uri}`"), r"[\r\n]", "%20")
    head = F.concat(F.lit(f"WARC/1.0{END}WARC-Type: resource{END}WARC-Record-ID: <urn:{key}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.lit(f">{END}"),
                    F.coalesce(F.concat(F.lit("WARC-Target-URI: "), target, F.lit(END)), F.lit("")),
                    F.lit(f"WARC-Date: 2000-01-01T00:00:00Z{END}Content-Type: text/html; charset=utf-8{END}WARC-Payload-Digest: sha256:"), F.sha2(body, 256),
                    F.lit(f"{END}Content-Length: "), F.octet_length(body).cast("string"), F.lit(END + END))
    rows = df.select(head.alias("head"), body.alias("body"), *(F.col(f"`{c}`") for c in keep))
    return rows.select(F.concat("head", "body").alias("record"), (F.char_length("head") + 1).alias("payload_at"), F.col("body").alias("payload"), *keep)


def write(record: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a column of record texts; each record ends with two line ends."""
    record.write.options(lineSep=END + END, compression="gzip", maxRecordsPerFile=records_per_file, **{"zlib.compress.level": "BEST_SPEED"}).text(path)


def _inflated(data: bytes) -> tuple[bytes, bool]:
    """(bytes, whole): what a gzip stream holds, as far as it can be read."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        try:
            for k in range(0, len(data), 1 << 16):
                out.append(d.decompress(data[k:k + (1 << 16)]))
                if d.eof:
                    break
        except zlib.error:
            return b"".join(out), False
        if not d.eof:
            return b"".join(out), False
        data = d.unused_data + data[k + (1 << 16):]
    return b"".join(out), True


def _parsed(data: bytes, whole: bool) -> Iterator[tuple]:
    """(start, length, record id, URI, hash, payload hash, sound) of the records, in order."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        head = data[at:stop].decode("utf-8", "replace").split("\r\n") if stop > 0 and data.startswith(b"WARC/", at) else []
        fields = dict(x.split(": ", 1) for x in head[1:] if ": " in x)
        size = fields.get("Content-Length", "")
        end = stop + 4 + int(size) if size.isdigit() else -1
        if end < 0 or data[end:end + 4] != b"\r\n\r\n":
            break
        found = hashlib.sha256(memoryview(data)[stop + 4:end]).hexdigest()
        yield (at, end + 4 - at, fields.get("WARC-Record-ID"), fields.get("WARC-Target-URI"), hashlib.sha256(b"%d:" % at + data[at:end + 4]).hexdigest(),
               found, fields.get("WARC-Payload-Digest") == f"sha256:{found}")
        at = end + 4
    if at < len(data) or not whole:
        rest = data[at:]
        yield at, len(rest), None, None, hashlib.sha256(b"%d:%d:" % (at, whole) + rest).hexdigest(), None, False


def file_number(path: str) -> int:
    """The number of a file that Spark wrote: by its task, then by its place among the task's files."""
    part = FILE.search(path.rsplit("/", 1)[-1])
    place = int(part[2] or 0)
    if place >= FILES_PER_PART:
        raise ValueError(f"{path} is beyond the {FILES_PER_PART} files of a task")
    return int(part[1]) * FILES_PER_PART + place


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file_no", "idx", "start", "length", "record_id", "uri", "hash", "payload", "sound"]
    types = [pa.int64()] * 4 + [pa.string()] * 4 + [pa.bool_()]
    for batch in batches:
        for k in range(batch.num_rows):
            number = file_number(batch.column(0)[k].as_py())
            rows = [(number, i, *r) for i, r in enumerate(_parsed(*_inflated(batch.column(1)[k].as_buffer().to_pybytes())))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names=names)


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of a replica's files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return written(files.mapInArrow(_leaves, LEAF))


def levels(leaf: DataFrame, fanout: int = FANOUT) -> list[tuple[str, DataFrame]]:
    """The trees of the replicas in ``leaf`` (column ``side``): nodes (side, file_no, idx, hash) per level,
    leaves first, a root per replica last.  With each level stands the column whose neighbouring values
    were put together for it: ``idx`` up to a file's root, then ``file_no``."""
    most = leaf.agg(F.max("idx"), F.max("file_no")).first()
    nodes = leaf.select("side", "file_no", "idx", "hash")
    out = [("", nodes)]
    for column, last in (("idx", most[0] or 0), ("file_no", most[1] or 0)):
        place = F.struct("idx", "hash") if column == "idx" else F.struct("file_no", "hash")
        while last > 0:
            keys = [F.floor(F.col(c) / fanout).alias(c) if c == column else F.col(c) for c in ("file_no", "idx")]
            # a node's hash covers the places below it too, so that no two orders have one hash
            below = F.transform(F.array_sort(F.collect_list(place)), lambda x: F.concat_ws(":", x[column], x["hash"]))
            nodes = written(nodes.groupBy("side", *keys).agg(F.sha2(F.array_join(below, ","), 256).alias("hash")))
            out.append((column, nodes))
            last //= fanout
    return out


def roots(leaf: DataFrame, fanout: int = FANOUT) -> dict[str, str]:
    """The root hash of each replica."""
    return {r["side"]: r["hash"] for r in levels(leaf, fanout)[-1][1].collect()}


def _differing(nodes: DataFrame) -> DataFrame:
    """Places whose hash is not the same on both sides, or which one side lacks."""
    of = {s: F.max(F.when(F.col("side") == s, F.col("hash"))) for s in "ab"}
    return nodes.groupBy("file_no", "idx").agg(of["a"].alias("a"), of["b"].alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("file_no", "idx")


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The records in which two replicas (their leaves) differ: their place, what both replicas hold
    there, and which of them does not hold what its record says or lacks it (``a``, ``b``, ``both`` or
    ``neither``)."""
    leaf = written(a.withColumn("side", F.lit("a")).union(b.withColumn("side", F.lit("b"))))
    tree = levels(leaf, fanout)
    found = _differing(tree[-1][1])
    if not found.isEmpty():
        for k in range(len(tree) - 2, -1, -1):  # children of differing nodes only
            column, nodes = tree[k + 1][0], tree[k][1]
            up = found.select(F.col("file_no").alias("up_file"), F.col("idx").alias("up_idx"))
            parent = {c: F.floor(F.col(c) / fanout) if c == column else F.col(c) for c in ("file_no", "idx")}
            found = _differing(nodes.join(up, (parent["file_no"] == F.col("up_file")) & (parent["idx"] == F.col("up_idx")), "left_semi"))
            found = written(found) if k else found
    held = ("start", "length", "record_id", "uri", "payload", "sound")
    out = found
    for s in "ab":
        side = leaf.where(F.col("side") == s).select("file_no", "idx", *(F.col(c).alias(f"{c}_{s}") for c in held))
        out = out.join(side, ["file_no", "idx"], "left")
    bad_a, bad_b = (~F.coalesce(f"sound_{s}", F.lit(False)) for s in "ab")
    return out.withColumn("damaged", F.when(bad_a & bad_b, "both").when(bad_a, "a").when(bad_b, "b").otherwise("neither"))
