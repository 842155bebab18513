"""WARC archives as a Python data source, and pages written to and read from them.

``format("warc")`` writes one gzip member for each record, with the member's own
length in its header (the skip length extension), and rolls files at
``roll_bytes``. Every write task makes files of its own name and takes them away
if it fails; the commit on the driver publishes the names of the successful
attempts in a manifest of its own, so retried or lost tasks leave nothing that a
reader sees. A write in mode ``append`` adds a manifest to those that are there;
``overwrite`` takes away what was published before.

Reading plans one partition for each published file; without any manifest, for
each file of the folder (or the one file named) that ends in ``.warc`` or
``.warc.gz``, so archives from elsewhere can be read. Conditions on the record
type and other header columns are pushed into the reader: of each record only
the head is inflated and parsed first; a record that the conditions reject, or
whose payload isn't wanted (option ``payload=false``), is skipped by its length
without inflating or decoding the rest. Gzip members that don't state their length
are inflated to find the next record, but what isn't wanted isn't kept or decoded.
``payload_bytes`` is null where an archive doesn't state it.

Defined results of ``archive_pages``: null html is an empty payload; a null or
odd url is left out or escaped; a null page_id is kept (as null, never referred
to unless its whole group lacks ids); repeated rows are records of their own, and
all rows with the group's largest id are responses; extra columns are ignored;
an empty table gives an empty archive and result. Payloads are never cut.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from factloom.llm.common import materialize, scratch_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary"
)
#: Manifests are named ``_records-<write>.json``.
MANIFEST = "_records"
ENDINGS = (".warc", ".warc.gz")
#: Bytes of a file after which a writer begins another; bytes of a head that are inflated at first.
ROLL, HEAD = 64 << 20, 2048
#: Decoded bytes of a batch that a reader hands over.
BATCH_BYTES = 4 << 20
#: Groups of equal payloads up to which their table is broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 100_000

_HEADERS = {
    "WARC-Record-ID": "record_id",
    "WARC-Type": "record_type",
    "WARC-Target-URI": "target_uri",
    "WARC-Refers-To": "refers_to",
    "WARC-Payload-Digest": "payload_digest",
    "X-Payload-Length": "payload_bytes",
}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member that states its own length in the extra field ``sl``."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, whole, len(data))
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Files(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.roll, self.overwrite = options["path"], int(options.get("roll_bytes", ROLL)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        try:
            for batch in iterator:
                at = {f: batch.schema.get_field_index(f) for f in batch.schema.names}
                for i in range(batch.num_rows):
                    row = {f: batch.column(k)[i].as_py() for f, k in at.items()}
                    if out is None:
                        name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    size += out.write(member(_page_record(row)))
                    if size >= self.roll:
                        out.close()
                        files.append((name, size))
                        out = None
            if out is not None:
                out.close()
                files.append((name, size))
                out = None
        except BaseException:  # also where the task is killed
            if out is not None:
                out.close()
                files.append((name, size))
            for name, _ in files:
                fs.delete_file(f"{root}/{name}")
            raise
        return _Files(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        before = _manifests(fs, root) if self.overwrite else []
        gone = [name for m in before for name in _published(fs, m)]
        names = sorted(f for m in messages if m is not None for f in m.files)
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(names).encode())
        for name in (*before, *(f"{root}/{name}" for name in gone)):
            fs.delete_file(name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                fs.delete_file(f"{root}/{name}")


def _manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith(MANIFEST) and f.base_name.endswith(".json"))


def _published(fs: pafs.FileSystem, manifest: str) -> list[str]:
    with fs.open_input_stream(manifest) as f:
        return [name for name, _ in json.loads(f.read())]


def _page_record(row: dict) -> bytes:
    """A record of columns named as in SCHEMA, the digest in hex; a revisit holds the HTTP head alone."""
    payload = row["payload"] or b""
    headers = {"WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": "1970-01-01T00:00:00Z"}
    if row["target_uri"]:
        headers["WARC-Target-URI"] = quote(row["target_uri"], safe=":/?#[]@!$&'()*+,;=%~")
    if row["refers_to"] is not None:
        headers["WARC-Refers-To"] = f"<{row['refers_to']}>"
    if row["record_type"] == "revisit":
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    headers |= {
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}",
        "X-Payload-Length": str(row["payload_bytes"]),
        "Content-Type": "application/http; msgtype=response",
    }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    return record(headers, http.encode() + (b"" if row["record_type"] == "revisit" else payload))


class _File(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)


_TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what is said of single header columns; leaves the rest to Spark."""
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in _HEADERS.values() and type(f) in (*_TESTS, IsNull, IsNotNull):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [_File(root)]
        if manifests := _manifests(fs, root):
            return [_File(f"{root}/{name}") for m in manifests for name in _published(fs, m)]
        found = fs.get_file_info(pafs.FileSelector(root))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(ENDINGS)]

    def _wanted(self, head: dict) -> bool:
        for f in self.filters:
            x = head.get(f.attribute[0])
            if isinstance(f, IsNull):
                if x is not None:
                    return False
            elif x is None or not isinstance(f, IsNotNull) and not _TESTS[type(f)](x, getattr(f, "value", None)):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _File):  # an archive without files
            return
        fs, _ = _open(self.path)
        rows: list[dict] = []
        held = 0
        with fs.open_input_file(partition.value) as f:
            start = f.read(14)
            f.seek(0)
            take = records if start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == b"sl" else plain_records
            for head, body in take(f, self._wanted, self.payload):
                rows.append(head | {"payload": body})
                held += len(body or b"")
                if held >= BATCH_BYTES or len(rows) >= 5000:
                    yield _rows(rows)
                    rows, held = [], 0
        if rows:
            yield _rows(rows)


_ARROW = pa.schema(
    [(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in (x.split()[0] for x in SCHEMA.split(", "))]
)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _head_of(data: bytes) -> dict:
    raw = parse_head(data)
    raw = {k.lower(): v for k, v in raw.items()}  # names of headers may be written in any case
    head = {column: raw.get(name.lower()) for name, column in _HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if head[c] is not None:
            head[c] = head[c].strip("<>")
    if head["payload_digest"] is not None:
        head["payload_digest"] = head["payload_digest"].removeprefix("sha1:")
    head["payload_bytes"] = int(head["payload_bytes"]) if head["payload_bytes"] is not None else None
    return head


def records(f, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Heads, and payloads if asked for, of the wanted records of an open file; others are skipped over."""
    at, end = 0, f.size()
    while at < end:
        f.seek(at)
        data = f.read(HEAD)
        (extra,) = struct.unpack_from("<H", data, 10)
        if data[:4] != b"\x1f\x8b\x08\x04" or data[12:14] != b"sl":
            raise ValueError("the file has no skip lengths")
        whole, plain = struct.unpack_from("<II", data, 16)
        inflate = zlib.decompressobj(-15)
        text = inflate.decompress(data[12 + extra : whole - 8], HEAD)
        fed = min(len(data), whole - 8)
        while b"\r\n\r\n" not in text:
            more = inflate.unconsumed_tail or f.read(min(HEAD, whole - 8 - fed))
            if not inflate.unconsumed_tail:
                fed += len(more)
            if not more:
                raise ValueError("the record's head doesn't end")
            text += inflate.decompress(more, HEAD)
        cut = text.index(b"\r\n\r\n") + 4
        head = _head_of(text[:cut])
        if wanted(head):
            body = None
            if payload:
                rest = inflate.decompress(inflate.unconsumed_tail + f.read(whole - 8 - fed)) + inflate.flush()
                block = text[cut:] + rest
                if cut + len(block) != plain:
                    raise ValueError("the record is cut off")
                body = block[block.index(b"\r\n\r\n") + 4 : -4]
            yield head, body
        at += whole


class _Inflated:
    """What a file holds behind any number of gzip members, or as it is, read forward."""

    def __init__(self, f) -> None:
        self.f, self.data = f, bytearray()
        start = f.read(2)
        f.seek(0)
        self.inflate = zlib.decompressobj(31) if start == b"\x1f\x8b" else None

    def more(self) -> bool:
        """Whether there was anything left to take in."""
        raw = self.f.read(1 << 16)
        if not raw:
            return False
        if self.inflate is None:
            self.data += raw
            return True
        self.data += self.inflate.decompress(raw)
        while self.inflate.eof:
            rest = self.inflate.unused_data.lstrip(b"\0")
            self.inflate = zlib.decompressobj(31)
            if not rest:
                break
            self.data += self.inflate.decompress(rest)
        return True

    def head(self) -> bytes | None:
        """What stands up to the next empty line; None at the end."""
        seen = 0
        while True:
            while self.data[:2] == b"\r\n":
                del self.data[:2]
            end = self.data.find(b"\r\n\r\n", max(0, seen - 3))
            if end >= 0:
                out = bytes(self.data[: end + 4])
                del self.data[: end + 4]
                return out
            seen = len(self.data)
            if not self.more():
                if self.data.strip(b"\r\n\0"):
                    raise ValueError("the record's head doesn't end")
                return None

    def take(self, n: int, keep: bool) -> bytes:
        """The next ``n`` bytes, or nothing if they are passed over."""
        out = bytearray()
        while n:
            if not self.data and not self.more():
                raise ValueError("the record is cut off")
            part = min(n, len(self.data))
            if keep:
                out += self.data[:part]
            del self.data[:part]
            n -= part
        return bytes(out)


def plain_records(f, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """As ``records``, of an archive whose members don't state their length or that isn't packed."""
    data = _Inflated(f)
    while (text := data.head()) is not None:
        raw = {k.lower(): v for k, v in parse_head(text).items()}
        size = int(raw.get("content-length", 0))
        head = _head_of(text)
        if not wanted(head):
            data.take(size, False)
            continue
        block = data.take(size, payload)
        if not payload:
            yield head, None
        elif raw.get("content-type", "").startswith("application/http"):
            yield head, block.partition(b"\r\n\r\n")[2]
        else:
            yield head, block


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


_URN = "urn:page:"


def write_pages(pages: DataFrame, path: str, least: int = 0, mode: str = "append") -> None:
    """A record for each page; of equal payloads of at least ``least`` bytes the page with the largest id is kept."""
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    groups = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("sha")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha", "kept")
    )
    groups = materialize(groups, "payloads")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:  # checked: at most some 10 MB
        groups = F.broadcast(groups)
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")) & (F.col("payload_bytes") >= least)
    (
        rows.join(groups, "sha", "left")
        .select(
            F.concat(F.lit(_URN), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
            F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            "target_uri",
            F.when(revisit, F.concat(F.lit(_URN), F.col("kept").cast("string"))).alias("refers_to"),
            F.col("sha").alias("payload_digest"),
            "payload_bytes",
            F.when(~revisit, F.col("payload")).alias("payload"),
        )
        .write.format("warc")
        .mode(mode)
        .save(path)
    )


def archive_pages(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Write the pages' archives, read them back and report each page's record.

    Sizes and digests of responses are taken from the payloads that were read;
    a revisit, which has no payload, states those of the payload it refers to.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_pages(pages, path, least)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, states, bodies = (b.column(i).to_pylist() for i in (1, 2, 4))
            sizes = b.column(3).to_pylist()
            found = [d if k == "revisit" else digest(p) for k, d, p in zip(kinds, states, bodies, strict=True)]
            length = [n if k == "revisit" else len(p) for k, n, p in zip(kinds, sizes, bodies, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(length, pa.int64()), pa.array(found, pa.string()), b.column(1), b.column(5)],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    number = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3)).try_cast("long")
    return (
        read(spark, path)
        .select(
            number(F.col("record_id")).alias("page_id"),
            "record_type",
            "payload_digest",
            "payload_bytes",
            "payload",
            number(F.col("refers_to")).alias("refers_to"),
        )
        .mapInArrow(check, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    )
