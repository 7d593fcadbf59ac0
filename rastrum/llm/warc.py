"""WARC archives with a two-level capture index.

Writing tasks put one gzip member per record into archive files in a folder that all
executors share and return a line per record: sort key, page, file, offset, length.
The key is the URL with its host's labels reversed, so captures of a site stand
together.  The lines are sorted over all tasks; each sorted part becomes a file of
compressed blocks and a sparse directory with the first key of each block.  Only a
line per part, the top level, reaches the driver.  A lookup bisects the top level,
the part's directory and the block, and then reads the record's bytes alone.

Files carry a fresh name per task attempt and count only once their line has been
written to the shared folder, so a task that runs again does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.common import cut, partitions_for, salted_join, shared_dir, written

MIN_REVISIT_BYTES = 1000
BLOCK_LINES = 1000
NO_PAGE = -(1 << 63)
#: The pages have no capture time.
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, page_id long, file string, offset long, length long"


def open_folder(uri: str):
    """The file system and the path in it of a folder given as URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def sort_key(url: str | None) -> str:
    """com,example,www)/path?query of a URL; what is no URL stays as it is, null is empty."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url or "", re.S)
    if not m:
        return one_line(url or "")
    return one_line(",".join(reversed(m[1].lower().split("."))) + (f":{m[2]}" if m[2] else "") + ")" + (m[3] or "/"))


def one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member; a revisit keeps the HTTP header, with the payload's length, but no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(["WARC/1.1", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> dict:
    """page_id, record_type, refers_to, payload_bytes, payload_digest (hex) and payload (None for revisits) of a member."""
    raw = zlib.decompress(member, 31)
    at = raw.index(b"\r\n\r\n") + 4
    head = dict(x.split(": ", 1) for x in raw[: at - 4].decode().split("\r\n")[1:])
    block = raw[at : at + int(head["Content-Length"])]
    body = block.index(b"\r\n\r\n") + 4
    http = dict(x.split(": ", 1) for x in block[: body - 4].decode().split("\r\n")[1:])
    number = lambda x: int(x.removeprefix("<urn:x-page:").removesuffix(">"))
    full = head["WARC-Type"] == "response"
    payload = block[body:] if full else None
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if full and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't have its digest")
    return {"page_id": number(head["WARC-Record-ID"]), "record_type": head["WARC-Type"], "refers_to": None if full else number(head["WARC-Refers-To"]), "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "payload": payload}


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload and refers_to: for payloads of at least `least` bytes that a larger page_id has too, the largest such page_id.

    Payloads are compared by SHA-1.  A null id refers to no page and none refers to
    it.  Rows that repeat the largest id are all responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8").alias("payload"))
    marks = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", F.sha1("payload").alias("digest"))
    equal = written(marks.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).where("n > 1"))
    revisits = salted_join(marks, equal, ["digest"], "n").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.withColumn("digest", F.sha1("payload")).join(revisits, ["page_id", "digest"], "left").drop("digest")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of with_revisits; returns the entries, ENTRY."""

    def run(batches):
        out = stream = None
        at, name = 0, f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            entries = []
            for k in range(0, batch.num_rows, 128):
                for row in batch.slice(k, 128).to_pylist():
                    if stream is None:
                        out, path = open_folder(folder)
                        out.create_dir(path, recursive=True)
                        stream = out.open_output_stream(f"{path}/{name}", compression=None)
                    page = NO_PAGE if row["page_id"] is None else row["page_id"]
                    member = record(page, row["url"], row["payload"], row["refers_to"])
                    stream.write(member)
                    entries.append({"key": sort_key(row["url"]), "page_id": page, "file": name, "offset": at, "length": len(member)})
                    at += len(member)
            yield from pa.Table.from_pylist(entries, ENTRY_ARROW).to_batches()
        if stream is not None:
            stream.close()

    return cut(rows.mapInArrow(run, ENTRY))


ENTRY_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_index(entries: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple]:
    """Sorts the entries into parts of compressed blocks; returns the top level: (first key, first page_id, part) per part, sorted."""

    def run(batches):
        blocks, directory, at, lines, first, low = None, [], 0, [], None, None
        name = uuid.uuid4().hex

        def flush():
            nonlocal at, lines
            packed = zlib.compress("\n".join(lines).encode())
            blocks.write(packed)
            directory.append(f"{first[0]}\t{first[1]}\t{at}\t{len(packed)}")
            at, lines = at + len(packed), []

        for batch in batches:
            for row in batch.to_pylist():
                if blocks is None:
                    files, path = open_folder(folder)
                    files.create_dir(path, recursive=True)
                    blocks = files.open_output_stream(f"{path}/{name}.blocks", compression=None)
                    low = (row["key"], row["page_id"])
                if not lines:
                    first = (row["key"], row["page_id"])
                lines.append("\t".join(map(str, row.values())))
                if len(lines) == block_lines:
                    flush()
        if blocks is not None:
            if lines:
                flush()
            blocks.close()
            with files.open_output_stream(f"{path}/{name}.directory", compression=None) as f:
                f.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_pylist([{"key": low[0], "page_id": low[1], "part": name}])

    ordered = entries.repartitionByRange(partitions_for(entries.sparkSession, ROW_BYTES * entries.count()), "key", "page_id").sortWithinPartitions("key", "page_id")
    top = cut(ordered.mapInArrow(run, "key string, page_id long, part string"))
    return sorted(tuple(r) for r in top.collect())


class Part:
    """One sorted part of the index; keeps the block that was read last."""

    def __init__(self, files, path: str, part: str):
        with files.open_input_stream(f"{path}/{part}.directory", compression=None) as f:
            lines = [x.split("\t") for x in f.read().decode().split("\n")]
        self.firsts = [(k, int(p)) for k, p, _, _ in lines]
        self.ranges = [(int(a), int(n)) for _, _, a, n in lines]
        self.file = files.open_input_file(f"{path}/{part}.blocks")
        self.number, self.lines = -1, []

    def block(self, number: int) -> list[tuple]:
        if number != self.number:
            at, n = self.ranges[number]
            rows = (x.split("\t") for x in zlib.decompress(self.file.read_at(n, at)).decode().split("\n"))
            self.lines = [(k, int(p), f, int(a), int(m)) for k, p, f, a, m in rows]
            self.number = number
        return self.lines

    def find(self, key: str, page_id: int):
        """All entries of a capture: the directory says where its block may begin."""
        number = max(0, bisect_left(self.firsts, (key, page_id)) - 1)
        while number < len(self.firsts) and self.firsts[number] <= (key, page_id):
            lines = self.block(number)
            for line in lines[bisect_left(lines, (key, page_id)) :]:
                if line[:2] != (key, page_id):
                    return
                yield line
            number += 1


RESULT = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
RESULT_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
OPEN_FILES = 64
#: What an entry and a record take, about, to deal them out.
ROW_BYTES, RECORD_BYTES = 200, 20_000


def read_captures(wanted: DataFrame, folder: str, top: list[tuple], payloads: bool = True) -> DataFrame:
    """The records of wanted captures (key, page_id), RESULT; a capture that the index lacks gives no row.

    Lookups are sorted, so that a task goes through neighbouring blocks.  The top
    level has a line per part of the index.  Captures asked for twice come once; an
    empty table gives an empty one, and so do null keys.  A record is read whole.
    """
    starts = [t[:2] for t in top]

    def run(batches):
        files, path = open_folder(folder)
        parts, archives = {}, {}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                found = []
                for row in batch.slice(k, 256).to_pylist():
                    key = (row["key"], row["page_id"])
                    number = bisect_right(starts, key) - 1
                    if number < 0:
                        continue
                    if number not in parts:
                        parts = {number: Part(files, path, top[number][2])}
                    for _, _, name, at, length in parts[number].find(*key):
                        if name not in archives:
                            if len(archives) >= OPEN_FILES:
                                archives.pop(next(iter(archives))).close()
                            archives[name] = files.open_input_file(f"{path}/{name}")
                        capture = parsed(archives[name].read_at(length, at))
                        if capture["page_id"] == NO_PAGE:
                            capture["page_id"] = None
                        if not payloads:
                            capture["payload"] = None
                        found.append(capture)
                yield from pa.Table.from_pylist(found, RESULT_ARROW).to_batches()

    asked = cut(wanted.select("key", "page_id").distinct())
    parts = partitions_for(wanted.sparkSession, RECORD_BYTES * asked.count())  # a lookup is small, but what it reads isn't
    return asked.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, RESULT)


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str, list[tuple]]:
    """Writes archives and index of pages (page_id, url, html); returns entries, folder and top level.

    Null html is an empty payload, a null url has the empty key, an empty table
    leaves no file.
    """
    folder = folder or new_folder(pages.sparkSession)
    entries = write_archives(with_revisits(pages), folder)
    return entries, folder, write_index(entries, folder)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
