"""A store of signed entries as a Spark data source: the runs of a review, and answers kept by key.

    store.register(spark)
    entries.write.format("signed_entries").option("secret", secret).mode("append").save(path)
    spark.read.format("signed_entries").option("secret", secret).load(path)

An entry is (kind, key, created_at, data); data is any text, usually JSON. None but data may be null: a write that
holds such an entry fails as a whole. The path must be one that all executors reach.

Writing has two phases. Each task writes one Parquet file of its own name below `data/<job>`; nothing reads it yet. The
driver then moves one list of the finished files into `commits`, and the whole job is seen at once. An aborted job
leaves no list, and its files are removed; so are those of tasks that ran twice. mode("overwrite") names the
lists that it replaces; readers that began before go on with the files they had.

Reading drops entries whose signature is not the secret's: altered, moved to another key, or written by somebody else. A
damaged file or list counts as no entries; an input or output error of the system raises, so that Spark tries again. With
option("refused", "true") the entries that are dropped are returned instead, for an audit.

The options kind, key, prefix (of key), since and until (since <= created_at < until, ISO times, UTC unless they say
otherwise) reach the lists, so that files whose bounds don't fit are not opened, and the Parquet row groups. They are
options and not pushed filters: Spark 4.1 keeps a Python source's pushed filters with the frame, and a second use of
the frame with other filters, a union or self join say, would lose rows. A frame reads the lists of its first action.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

NAME = "signed_entries"
SCHEMA = "kind string, key string, created_at timestamp, data string"
#: Bytes of files that one task reads.
TASK_BYTES = 64 * 1024 * 1024
_BOUNDED = ("kind", "key", "created_at")


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a path as Spark writes it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def signature(secret: bytes, *fields) -> str:
    """The HMAC of a list of texts, whole numbers and nulls; as JSON, so that no two lists are written alike."""
    return hmac.new(secret, json.dumps(fields, ensure_ascii=False).encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()


def _micros(value: datetime) -> int:
    moment = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    spent = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (spent.days * 86_400 + spent.seconds) * 1_000_000 + spent.microseconds


@dataclass
class _Files(ds.InputPartition):
    paths: list[str]


@dataclass
class _Written(ds.WriterCommitMessage):
    file: dict | None


@dataclass
class _Bounds:
    """What a reader is asked for: equal texts by column, a prefix of key, and since <= created_at < until in microseconds."""

    equal: dict[str, str]
    prefix: str | None
    since: int | None
    until: int | None

    def may_hold(self, bounds: dict) -> bool:
        """False only for a file that holds none of it, by the least and greatest values of its columns."""
        if any(not bounds[c][0] <= v <= bounds[c][1] for c, v in self.equal.items()):
            return False
        low, high = (v[: len(self.prefix or "")] for v in bounds["key"])
        first, last = bounds["created_at"]
        return (self.prefix is None or low <= self.prefix <= high) and (self.since is None or last >= self.since) and (self.until is None or first < self.until)

    def expression(self):
        import pyarrow as pa
        import pyarrow.compute as pc

        moment = lambda v: pa.scalar(v, pa.timestamp("us", "UTC"))
        found = [pc.field(c) == v for c, v in self.equal.items()]
        found += [] if self.prefix is None else [pc.starts_with(pc.field("key"), self.prefix)]
        found += [] if self.since is None else [pc.field("created_at") >= moment(self.since)]
        found += [] if self.until is None else [pc.field("created_at") < moment(self.until)]
        return functools.reduce(lambda x, y: x & y, found) if found else None


class SignedEntries(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        return SignedReader(self.options)

    def writer(self, schema, overwrite: bool) -> ds.DataSourceArrowWriter:
        if sorted(schema.names) != sorted(("kind", "key", "created_at", "data")):
            raise ValueError(f"entries have the columns kind, key, created_at and data, not {', '.join(schema.names)}")
        return SignedWriter(self.options, overwrite)


def _place(options) -> tuple[str, bytes]:
    if not options.get("path") or not options.get("secret"):
        raise ValueError("signed entries need a path and the option secret")
    return options["path"].rstrip("/"), options["secret"].encode()


def commits(path: str, secret: bytes) -> dict[str, dict]:
    """The lists that count, by name: signed by the secret and not replaced by another."""
    from pyarrow import fs as pfs

    fs, root = filesystem(path)
    found = {}
    for info in fs.get_file_info(pfs.FileSelector(f"{root}/commits", allow_not_found=True)):
        if not info.base_name.endswith(".json"):
            continue
        with fs.open_input_stream(info.path) as stream:
            text = stream.read()
        try:
            outer = json.loads(text)
            if hmac.compare_digest(outer["mac"], signature(secret, info.base_name, outer["body"])):
                found[info.base_name] = json.loads(outer["body"])
        except (ValueError, KeyError, TypeError):
            continue
    gone = {name for body in found.values() for name in body["replaces"]}
    return {name: body for name, body in found.items() if name not in gone}


class SignedReader(ds.DataSourceReader):
    def __init__(self, options):
        self.path, self.secret = _place(options)
        self.refused = str(options.get("refused", "false")).lower() == "true"
        moment = lambda name: _micros(datetime.fromisoformat(options[name])) if options.get(name) else None
        self.bounds = _Bounds({c: options[c] for c in ("kind", "key") if options.get(c) is not None}, options.get("prefix"), moment("since"), moment("until"))

    def partitions(self) -> list[_Files]:
        files = [f for body in commits(self.path, self.secret).values() for f in body["files"]]
        files = [f for f in files if self.bounds.may_hold(f["bounds"])]
        parts: list[_Files] = []
        held = TASK_BYTES
        for f in sorted(files, key=lambda f: f["name"]):
            if held + f["bytes"] > TASK_BYTES:
                parts.append(_Files([]))
                held = 0
            parts[-1].paths.append(f["name"])
            held += f["bytes"]
        return parts or [_Files([])]

    def read(self, partition: _Files):
        import pyarrow as pa
        import pyarrow.dataset as pds

        fs, root = filesystem(self.path)
        wanted = self.bounds.expression()
        for name in partition.paths:
            try:
                for batch in pds.dataset(f"{root}/{name}", filesystem=fs, format="parquet").to_batches(filter=wanted):
                    yield self._checked(batch)
            except pa.ArrowInvalid:
                continue  # not Parquet, or damaged
            except OSError as e:
                if e.errno is not None:
                    raise

    def _checked(self, batch):
        import pyarrow as pa

        micros = batch.column("created_at").cast(pa.int64()).to_pylist()
        columns = [batch.column(c).to_pylist() for c in ("kind", "key", "data", "mac")]
        good = [hmac.compare_digest(mac or "", signature(self.secret, kind, key, at, data)) for kind, key, data, mac, at in zip(*columns, micros)]
        return batch.filter(pa.array([g != self.refused for g in good], pa.bool_())).select(["kind", "key", "created_at", "data"])


class SignedWriter(ds.DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.secret = _place(options)
        self.job = uuid.uuid4().hex
        self.replaces = sorted(commits(self.path, self.secret)) if overwrite else []

    def write(self, iterator) -> _Written:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        fs, root = filesystem(self.path)
        name = f"data/{self.job}/{uuid.uuid4().hex}.parquet"
        stored = pa.schema([("kind", pa.string()), ("key", pa.string()), ("created_at", pa.timestamp("us", "UTC")), ("data", pa.string()), ("mac", pa.string())])
        out, bounds = None, {}
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if any(batch.column(batch.schema.get_field_index(c)).null_count for c in _BOUNDED):
                    raise ValueError("an entry without kind, key or created_at")
                table = pa.Table.from_batches([batch]).select(stored.names[:4]).cast(pa.schema(list(stored)[:4]))
                micros = table["created_at"].cast(pa.int64())
                macs = [signature(self.secret, *fields) for fields in zip(table["kind"].to_pylist(), table["key"].to_pylist(), micros.to_pylist(), table["data"].to_pylist())]
                if out is None:
                    fs.create_dir(f"{root}/data/{self.job}", recursive=True)
                    out = pq.ParquetWriter(f"{root}/{name}", stored, filesystem=fs, compression="zstd")
                out.write_table(table.append_column("mac", pa.array(macs, pa.string())))
                for column, values in (("kind", table["kind"]), ("key", table["key"]), ("created_at", micros)):
                    ends = pc.min_max(values).as_py()
                    low, high = bounds.get(column, (ends["min"], ends["max"]))
                    bounds[column] = (min(low, ends["min"]), max(high, ends["max"]))
        finally:
            if out is not None:
                out.close()
        if out is None:
            return _Written(None)
        return _Written({"name": name, "bytes": fs.get_file_info(f"{root}/{name}").size, "bounds": bounds})

    def commit(self, messages) -> None:
        from pyarrow import fs as pfs

        fs, root = filesystem(self.path)
        files = [m.file for m in messages if m is not None and m.file is not None]
        name = f"{self.job}.json"
        body = json.dumps({"files": files, "replaces": self.replaces})
        fs.create_dir(f"{root}/commits", recursive=True)
        with fs.open_output_stream(f"{root}/commits/{name}.tmp") as stream:
            stream.write(json.dumps({"body": body, "mac": signature(self.secret, name, body)}).encode())
        fs.move(f"{root}/commits/{name}.tmp", f"{root}/commits/{name}")
        kept = {f"{root}/{f['name']}" for f in files}
        for info in fs.get_file_info(pfs.FileSelector(f"{root}/data/{self.job}", allow_not_found=True)):
            if info.path not in kept:
                fs.delete_file(info.path)  # of a task that ran twice

    def abort(self, messages) -> None:
        from pyarrow import fs as pfs

        fs, root = filesystem(self.path)
        if fs.get_file_info(f"{root}/data/{self.job}").type != pfs.FileType.NotFound:
            fs.delete_dir(f"{root}/data/{self.job}")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(SignedEntries)


def write(entries: DataFrame, path: str, secret: str, mode: str = "append") -> None:
    """Adds entries in one commit; sorted inside each task, so that row groups have narrow bounds."""
    register(entries.sparkSession)
    rows = entries.select("kind", "key", "created_at", "data").sortWithinPartitions("kind", "created_at", "key")
    rows.write.format(NAME).option("secret", secret).mode(mode).save(path)


def read(spark: SparkSession, path: str, secret: str, **options: str) -> DataFrame:
    """The entries that the secret signed; options as above."""
    register(spark)
    return spark.read.format(NAME).options(secret=secret, **options).load(path)


def latest(entries: DataFrame) -> DataFrame:
    """One entry of each kind and key: the newest, of equally new ones that with the greatest data."""
    newest = entries.groupBy("kind", "key").agg(F.max(F.struct("created_at", "data")).alias("_e"))
    return newest.select("kind", "key", "_e.created_at", "_e.data")


def answered(wanted: DataFrame, path: str, secret: str, kind: str, make) -> DataFrame:
    """(key, data): the answers to all wanted keys. Those that the store lacks are made by make(rows) -> (key, data) and kept in it.

    wanted: key and whatever make needs. A repeated key is asked once, with any one of its rows; null keys have no
    answer. A refused entry is a missing one.
    """
    spark = wanted.sparkSession
    keys = wanted.filter("key IS NOT NULL").dropDuplicates(["key"])  # before any join, so that a key of many rows is one
    held = read(spark, path, secret, kind=kind).select("key")
    made = make(keys.join(held, "key", "left_anti"))
    write(made.select(F.lit(kind).alias("kind"), "key", F.current_timestamp().alias("created_at"), "data"), path, secret)
    return latest(read(spark, path, secret, kind=kind)).join(keys.select("key"), "key", "left_semi").select("key", "data")
