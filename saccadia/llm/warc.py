"""WARC archives: written by Spark tasks, read back record by record.

Every record is a gzip member of its own. `WarcSource` is a Spark data source: a task writes
one archive into the folder, and a list of the archives of finished tasks is written last, so
what lost or repeated tasks leave behind is never read. Reading has one partition an archive
and is one pass: bytes come in small chunks, zlib unpacks them as they come and stops at a
member's end, Content-Length frames the block, and its payload is hashed (and only on request
kept) while it passes. Payloads that several pages share are stored once, the others are
revisit records, which are settled on narrow rows: no payload is shuffled more than once a
task and digest.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from saccadia.functions.tables import held, released, scratch
from saccadia.llm.common import fresh
from saccadia.operators.blocks import in_order, scan

CHUNK = 1 << 16
LIST = "archives.json"
#: Fixed names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
WRITTEN = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, offset long, error string"


def _uri(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(uri: str | None):
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _clean(value: str) -> str:
    """A header value in one line: control characters and non-ASCII characters are percent-encoded."""
    return "".join(c if " " <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record(page_id, url, kind: str, refers_to, size: int, digest: str, payload: bytes | None) -> bytes:
    """One record as a gzip member. The block is an HTTP response; a revisit has its head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = payload if kind == "response" else b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", _clean(url))] if url is not None else []
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to))] if kind == "revisit" else []
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(head) + len(body)))]
    top = "".join([VERSION + "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([packer.compress(top), packer.compress(head), packer.compress(body), packer.compress(b"\r\n\r\n"), packer.flush()])


class _Member:
    """The unpacked bytes of one gzip member, chunk by chunk, never more than CHUNK of them at once."""

    def __init__(self, source, rest: bytes):
        self.source, self.rest, self.read_bytes, self.plain = source, rest, 0, b""
        self.zip = zlib.decompressobj(31)

    def more(self) -> bool:
        while not self.zip.eof:
            got = self.rest or self.source.read(CHUNK)
            if not got:
                raise ValueError("the archive ends within a record")
            plain = self.zip.decompress(got, CHUNK)
            left = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
            self.read_bytes += len(got) - len(left)
            self.rest = left
            if plain:
                self.plain += plain
                return True
        return False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        """Bytes up to a mark, which is taken too."""
        while (at := self.plain.find(mark)) < 0:
            if len(self.plain) > most or not self.more():
                raise ValueError("a header doesn't end")
        out, self.plain = self.plain[:at], self.plain[at + len(mark) :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self.more():
                raise ValueError("a block is shorter than its Content-Length")
            part, self.plain = self.plain[:n], self.plain[n:]
            n -= len(part)
            yield part


def _fields(lines: list[str]) -> dict[str, str]:
    """Headers by lower-case name; a line that starts blank carries the one before on."""
    out, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        else:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _parsed(member: _Member, keep: bool) -> tuple:
    version, *lines = member.until(b"\r\n\r\n").decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record starts with {version[:20]!r}")
    top = _fields(lines)
    length, kind = int(top["content-length"]), top["warc-type"]
    if length < 0:
        raise ValueError("a negative Content-Length")
    block = member.exactly(length)
    size, sha, body = 0, hashlib.sha256(), []
    if top.get("content-type", "").startswith("application/http"):
        head = b""
        while b"\r\n\r\n" not in head:
            head += next(block, None) or _fail("a block without an HTTP head")
        head, _, first = head.partition(b"\r\n\r\n")
        declared = int(_fields(head.decode("latin-1").split("\r\n")[1:]).get("content-length", -1))
    else:
        first, declared = b"", -1
    for part in chain((first,), block):
        sha.update(part)
        size += len(part)
        body += [part] * keep
    if member.until(b"\r\n\r\n") or member.plain or member.more():
        raise ValueError("a block is longer than its Content-Length")
    told = top.get("warc-payload-digest", "")
    digest = told.removeprefix("sha256:")
    if kind != "revisit":
        if declared not in (-1, size):
            raise ValueError(f"the payload has {size} bytes, its head says {declared}")
        if told.startswith("sha256:") and digest != sha.hexdigest():
            raise ValueError("the payload doesn't have the digest of its header")
        digest = sha.hexdigest()
    elif declared < 0 or not told.startswith("sha256:"):
        raise ValueError("a revisit doesn't tell the size and digest of its payload")
    return _page(top.get("warc-record-id")), top.get("warc-target-uri"), kind, _page(top.get("warc-refers-to")), declared if kind == "revisit" else size, digest, b"".join(body) if keep and kind != "revisit" else None


def _fail(why: str):
    raise ValueError(why)


def records(source, keep: bool = False) -> Iterator[tuple]:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, offset, error) of each record.

    `source` has read(n). A broken record whose member can still be unpacked gives a row with
    its error, and reading goes on at the next member; where the member itself is broken, the
    row with the error is the archive's last.
    """
    at, rest = 0, b""
    while rest or (rest := source.read(CHUNK)):
        member = _Member(source, rest)
        try:
            row, error = _parsed(member, keep), None
        except (ValueError, KeyError, StopIteration, UnicodeDecodeError, zlib.error) as x:
            row, error = (None,) * 7, f"{type(x).__name__}: {x}"
            try:
                while member.more():
                    member.plain = b""
            except (ValueError, zlib.error):
                yield (*row, at, error)
                return
        yield (*row, at, error)
        at, rest = at + member.read_bytes, member.rest


class _Archive(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Done(WriterCommitMessage):
    def __init__(self, name: str, n: int):
        self.name, self.n = name, n


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.keep = options["path"], options.get("payload", "false").lower() == "true"

    def partitions(self):
        store, top = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{top}/{LIST}") as f:
            return [_Archive(x) for x in json.loads(f.read())] or [_Archive("")]

    def read(self, partition: _Archive):
        if not partition.name:
            return
        store, top = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        with store.open_input_stream(f"{top}/{partition.name}", compression=None) as f:
            for *values, offset, error in records(f, self.keep):
                rows.append((*values, partition.name, offset, error))
                held += len(values[6] or b"")
                if len(rows) >= 5_000 or held > 16 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string()]
    names = [x.split(" ")[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, top = fs.FileSystem.from_uri(self.path)
        store.create_dir(top, recursive=True)
        name, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{top}/{name}", compression=None) as f:
            for batch in iterator:
                for i in range(batch.num_rows):
                    f.write(record(*(c[i].as_py() for c in batch.columns)))
                n += batch.num_rows
        return _Done(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, top = fs.FileSystem.from_uri(self.path)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/{LIST}", compression=None) as f:
            f.write(json.dumps(sorted(m.name for m in messages if m is not None and m.n)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, top = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{top}/{m.name}")


class WarcSource(DataSource):
    """`format("warc")`: a folder of archives. Option payload=true returns the payloads too.

    The folder lies where all machines reach it, in a store that pyarrow knows. Each write
    replaces the list of what is read.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options)


def planned(pages: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows to write, the ordered table that they read): a response or revisit record for each page.

    Of the rows whose payloads (html in UTF-8, null: empty) are equal and of `least` bytes or
    more, the one of the smallest page_id, then url (nulls last in both) is the response. Of
    rows that are equal in all three, one is. Shorter payloads are all responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).select(
        "page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "payload"
    )
    kind = lambda x, refers_to: [F.lit(x).alias("record_type"), refers_to.alias("refers_to")]
    last = [F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url"]
    long, nothing = rows.filter(F.col("payload_bytes") >= least), F.lit(None).cast("long")
    # each payload once: the smallest row of a digest, found on both sides of the shuffle
    first = long.groupBy("payload_digest", "payload_bytes").agg(F.min(F.struct(*last, "payload")).alias("x")).select("x.page_id", "x.url", *kind("response", nothing), "payload_bytes", "payload_digest", "x.payload")
    # the others, narrow: in order of digest and row, all but a digest's first
    narrow = long.select("payload_digest", *last, "payload_bytes")
    keys = ["payload_digest", "no_id", "page_id", "no_url", "url"]
    ordered = in_order(narrow, keys, name="digests")
    marked = scan(ordered, ["payload_digest"], before=("lag", F.lit(1)), of=("first", F.col("page_id")))
    others = marked.filter("before is not null").select("page_id", "url", *kind("revisit", F.col("of")), "payload_bytes", "payload_digest", F.lit(None).cast("binary").alias("payload"))
    short = rows.filter(F.col("payload_bytes") < least).select("page_id", "url", *kind("response", nothing), "payload_bytes", "payload_digest", "payload")
    return short.unionByName(first).unionByName(others), ordered


def write_archives(pages: DataFrame, path: str, least: int = 100) -> None:
    """Pages as WARC archives in a folder, one a task, equal payloads once (see `planned`)."""
    pages.sparkSession.dataSource.register(WarcSource)
    rows, ordered = planned(pages, least)
    rows.write.format("warc").mode("append").save(path)
    released(ordered)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Rows of READ; `error` says what is wrong with a record, else it is null."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archived(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes pages to archives and returns what a pass over these finds: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null page_id or url is kept as none, and ranks last;
    repeated rows give a record each, of which one is the response where they are long
    enough; no rows give no rows; further columns are not read. A record that doesn't hold
    what its headers say is an error when the result is read.
    """
    path = held(pages.sparkSession, scratch(pages.sparkSession, "warc"))
    write_archives(pages, path, least)
    found = read_archives(pages.sparkSession, path)
    (bad,) = fresh(found, "bad")
    checked = found.withColumn(bad, F.when(F.col("error").isNotNull(), F.raise_error(F.concat("archive", F.lit(": "), "error"))))
    return checked.filter(F.col(bad).isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
