"""Deterministic sharded WARC writer and reader.

Records are sorted by page_id within shards that are ranges of page_id of about equal bytes; the
ranges follow from a histogram of the ids, whose heavy bins are split again until none is heavier than
a shard or it is a single id. So the same pages give the same shards whatever their ids look like, and
each shard has a task of its own. It rolls its files by compressed size, makes every header, length and
digest anew, and gives each record a gzip member of its own. A file gets its name only when it is
complete (it is written under a name of its attempt and renamed), and only files in the manifest, which
Spark commits last, belong to the archive: a lost executor's shard is written again with the same
bytes, and what failed attempts have left is removed at the end.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the largest page_id is a
response and the others are revisits without payload, which keep its length and digest in their headers.

Edge cases: a null html is an empty payload; rows that repeat a page_id and payload count as copies:
the first written is the response, if any is, and record ids stay unique; a null page_id is always a
response, dealt to the shards by its payload; line breaks in a url become %0D and %0A, a null url an empty target; an empty table gives no files and an empty result;
further columns are left out.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import cut, scratch

MIN_REVISIT = 1000
#: Compressed bytes after which a file is rolled, least payload bytes of a shard, and most shards.
FILE_BYTES, SHARD_BYTES, MAX_SHARDS = 1 << 20, 8 << 20, 1 << 16
#: Ranges of ids that the histogram tells apart at first, and into how many a heavy one is split.
BINS, SPLIT = 16384, 16
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str):
    """The file system and path of a folder that all executors share."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to=None, revisit: bool = False, copy: int = 0) -> bytes:
    """A WARC/1.1 record as one gzip member; copy: how many records of this page_id and payload precede it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}' + f':{copy}' * (copy > 0))}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, f'{refers_to}:{digest}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def shards(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """The least page_id of each shard after the first, for pages (page_id, bytes): ranges of about shard_bytes.

    A level of the histogram splits the bins that are too heavy; there are at most MAX_SHARDS of these,
    so that at most BINS + SPLIT * MAX_SHARDS sums come back at a time.
    """
    sizes = sizes.filter("page_id IS NOT NULL")
    edge = sizes.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).first()
    if edge.lo is None:
        return []
    width = max(1, -(-(edge.hi - edge.lo + 1) // BINS))
    found = lambda rows, lo: {r.lo: r.n for r in rows.groupBy(lo.alias("lo")).agg(F.sum("bytes").alias("n")).collect()}
    bins = found(sizes, F.expr(f"{edge.lo} + (page_id - {edge.lo}) DIV {width} * {width}").cast("long"))
    rows = sizes.select("page_id", "bytes", F.expr(f"{edge.lo} + (page_id - {edge.lo}) DIV {width} * {width}").cast("long").alias("bin"))
    while width > 1 and (heavy := [lo for lo, n in bins.items() if n > shard_bytes]):
        width = -(-width // SPLIT)
        these = sizes.sparkSession.createDataFrame([(x,) for x in heavy], "bin long")  # at most MAX_SHARDS rows
        rows = rows.join(F.broadcast(these), "bin").withColumn("bin", F.expr(f"bin + (page_id - bin) DIV {width} * {width}").cast("long"))
        for x in heavy:
            del bins[x]
        bins |= found(rows, F.col("bin"))
    out, total = [], 0
    for lo in sorted(bins):
        if total and total + bins[lo] > shard_bytes:
            out.append(lo)
            total = 0
        total += bins[lo]
    return out


def planned(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pages and revisit marks by shard and id, each mark before the rows that it is for."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sizes = cut(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size")))
    narrow = sizes.filter(f"size >= {MIN_REVISIT} AND page_id IS NOT NULL")
    largest = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marks = narrow.join(largest, "digest").select("page_id", "digest", "refers_to").distinct()
    weighed = sizes.select("page_id", (F.col("size") + 500).cast("long").alias("bytes"))
    total = weighed.agg(F.sum("bytes")).first()[0] or 0
    starts = shards(weighed, max(shard_bytes, -(-total // MAX_SHARDS)))
    n = len(starts) + 1
    edges, keys = np.array(starts, np.int64), np.array(own_partitions(pages.sparkSession, n), np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right").astype(np.int32))

    @F.pandas_udf("long")
    def key_of(shard: pd.Series) -> pd.Series:
        return pd.Series(keys[shard.to_numpy()])

    both = rows.select("page_id", "url", "html", F.sha1(F.col("html").cast("binary")).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.lit(0).alias("kind"), "refers_to")
    )
    both = both.withColumn("shard", F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")).otherwise(shard_of(F.coalesce("page_id", F.lit(0)).cast("long"))))
    return both.withColumn("_key", key_of("shard")).repartition(n, "_key").drop("_key").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")


def own_partitions(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions the least number that repartition() deals to it, so that no two shards meet in one."""
    spread = spark.range(40 * n + 200).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("key"))
    of = {r.p: r.key for r in spread.collect()}
    return [of.get(p, p) for p in range(n)]


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> str:
    """Writes the archive into a new folder; returns the manifest's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, state = None, {}
        done: list[tuple] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                fs.move(state["temp"], f"{root}/{state['name']}")
                done.append((state["name"], state["records"], state["bytes"], state["sum"].hexdigest()))
                out = None

        shard, roll, mark, last, copy = None, 0, (None, None, None), None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    mark = (row["page_id"], row["digest"], row["refers_to"])
                    continue
                if row["shard"] != shard:
                    close()
                    shard, roll = row["shard"], 0
                elif out is not None and state["bytes"] >= file_bytes:
                    close()
                    roll += 1
                if out is None:
                    name = f"shard-{shard:06d}-{roll:05d}.warc.gz"
                    state = {"name": name, "temp": f"{root}/.{name}.{uuid.uuid4().hex}.tmp", "records": 0, "bytes": 0, "sum": hashlib.sha1()}
                    out = fs.open_output_stream(state["temp"], compression=None)
                key = (row["page_id"], row["digest"])
                copy, last = copy + 1 if key == last else 0, key
                revisit = mark[:2] == key and (mark[2] != row["page_id"] or copy > 0)
                payload = row["html"].encode()
                raw = record(row["page_id"], row["url"], payload, row["digest"], len(payload), mark[2], revisit, copy)
                out.write(raw)
                state["records"] += 1
                state["bytes"] += len(raw)
                state["sum"].update(raw)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["file", "records", "bytes", "sha1"])

    manifest = f"{folder}/manifest"
    planned(pages, shard_bytes).mapInArrow(run, "file string, records long, bytes long, sha1 string").write.json(manifest)
    swept(folder)
    return manifest


def swept(folder: str) -> None:
    """Removes what attempts that did not end have left in a folder whose manifest is complete."""
    from pyarrow.fs import FileSelector

    fs, root = filesystem(folder)
    for file in fs.get_file_info(FileSelector(root, allow_not_found=True)):
        if file.base_name.startswith(".") and file.base_name.endswith(".tmp"):
            fs.delete_file(file.path)


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    raw = stream.read(1 << 20)
    while raw:
        grow, body = zlib.decompressobj(31), io.BytesIO()
        while not grow.eof:
            body.write(grow.decompress(raw))
            raw = grow.unused_data if grow.eof else stream.read(1 << 20)
            if not raw and not grow.eof:
                raise ValueError("the archive ends within a record")
        yield body.getvalue()
        raw = raw or stream.read(1 << 20)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and block; lengths and digests must hold."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def read(spark: SparkSession, folder: str, manifest: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the manifest's files: page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *(["payload"] if payloads else [])]
        for file in (f for b in batches for f in b.column("file").to_pylist()):
            rows = []
            with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                for headers, block in map(parse, members(stream)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length:")[2])
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    kind = headers["warc-type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"damaged payload {headers['warc-record-id']}")
                    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    rows.append((page and int(page), size, digest, kind, refers and int(refers), headers["warc-target-uri"], *([payload if kind == "response" else None] if payloads else [])))
                    if len(rows) >= (64 if payloads else 4096):
                        yield _batch(rows, names)
                        rows = []
            if rows:
                yield _batch(rows, names)

    files = spark.read.schema("file string, records long, bytes long, sha1 string").json(manifest)
    n = max(1, spark.sparkContext.defaultParallelism)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", payload binary" if payloads else "")
    return files.select("file").repartition(n, "file").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder, manifest).drop("url")


ORACLE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= {MIN_REVISIT} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT} AND page_id < top THEN top END AS refers_to FROM g"""
