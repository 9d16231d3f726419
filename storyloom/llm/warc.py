"""WARC archives with a two-level capture index.

Writing: every page is a gzip member of its own. Of pages with equal payloads of
at least ``least_bytes`` bytes the one with the smallest id is a ``response``
record, the others are ``revisit`` records that name it and carry no payload.
Tasks write their own archive files, so the payloads are not moved for that.

Index: lines of (reversed-host URL key, page id, file, offset, length) are sorted
by key, cut into blocks of ``BLOCK_LINES`` lines, and each block is compressed. A
part's sparse directory holds the first key and the place of every block; the root
holds one line per part. ``lookup`` finds the part in the root and the block in the
directory by binary search, then reads the block's byte range; ``read`` fetches
the captures by file and offset, joining neighbouring ranges to one read.

The archives lie in the shared folder the cluster names (``pyarrow.fs`` opens it
on any task). A failed attempt leaves files that no index line names.

Null html is an empty payload, a null URL has the key ``-``. Rows that repeat both
id and payload of a response are responses too, as are rows with a null id.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import stored
from storyloom.session import scratch

BLOCK_LINES, FILE_BYTES, READ_BYTES = 512, 256 << 20, 4 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::\d+)?([^#]*)"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: com,example)/a?b."""
    host, rest = F.lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)
    named = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(url.isNull(), "-").when(url.rlike(_URL), named).otherwise(url)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(folder: str):
    return fs.FileSystem.from_uri(folder)


def _record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record."""
    named = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = HTTP + payload if refers_to is None else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {named(page_id)}",
        "WARC-Date: 2020-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {named(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of one record (lower case) and its payload; the lengths and the digest are verified."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[:int(headers["content-length"])]
    if not first.startswith("WARC/") or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"not a whole WARC record: {first!r}")
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response" and headers["warc-payload-digest"] != "sha1:" + digest(payload):
        raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
    return headers, payload


def write(pages: DataFrame, least_bytes: int = 0) -> tuple[str, DataFrame]:
    """(folder, captures): archives of ``pages`` (page_id, url, html), and one line per record."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("content", F.sha2(F.col("html").cast("binary"), 256))
    first = own.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least_bytes)).groupBy("content").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("n"),
    ).where("n > 1").select("content", "first_id")
    # Written, so its size is known: sent to the pages when small, else both sides are dealt by content and hot ones split.
    role = own.join(stored(first, "warc-first"), "content", "left").select(
        "page_id", "url", url_key(F.col("url")).alias("url_key"), F.col("html").cast("binary").alias("payload"),
        F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("refers_to"),
    )

    def put(batches):
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            files, offsets, lengths = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))
            for page_id, url, payload, refers_to in zip(*columns):
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                data = _gzip(_record(page_id, url, payload, refers_to))
                out.write(data)
                files.append(name)
                offsets.append(offset)
                lengths.append(len(data))
                offset += len(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("url_key"), batch.column("page_id"), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["url_key", "page_id", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    return folder, stored(role.mapInArrow(put, "url_key string, page_id long, file string, offset long, length long"), "warc-captures")


def build_index(folder: str, captures: DataFrame) -> list:
    """Write sorted, compressed blocks and their directories to ``folder``; returns the root, one (first, last, name) per part.

    The root is as long as the index has parts, not as the captures are many.
    """
    def put(batches):
        system, path = _open(folder)
        name, held, directory, offset, first, last, out = uuid.uuid4().hex, [], [], 0, None, None, None

        def flush():
            nonlocal offset
            data = zlib.compress("\n".join(json.dumps(row) for row in held).encode(), 6)
            out.write(data)
            directory.append((held[0][0], offset, len(data)))
            offset += len(data)
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "file", "offset", "length"))):
                out = out or system.open_output_stream(f"{path}/{name}.cdx", compression=None)
                first, last = row[0] if first is None else first, row[0]
                held.append(row)
                if len(held) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if held:
            flush()
        out.close()
        with system.open_output_stream(f"{path}/{name}.dir") as sparse:
            sparse.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_pydict({"first": [first], "last": [last], "name": [name]})

    ordered = captures.repartitionByRange("url_key", "page_id", "file", "offset").sortWithinPartitions("url_key", "page_id", "file", "offset")
    return sorted(tuple(r) for r in ordered.mapInArrow(put, "first string, last string, name string").collect())


def lookup(keys: DataFrame, folder: str, root: list) -> DataFrame:
    """Captures (url_key, page_id, file, offset, length) of each ``url_key`` of ``keys``; keys without one give none."""
    held = keys.sparkSession.sparkContext.broadcast(root)

    def find(batches):
        system, path = _open(folder)
        parts, ends = held.value, [last for _, last, _ in held.value]
        directory, block = {}, {}  # the part and the block read last

        def lines(name, at, size):
            if (name, at) not in block:
                block.clear()
                with system.open_input_file(f"{path}/{name}.cdx") as file:
                    data = zlib.decompress(file.read_at(size, at))
                block[name, at] = [json.loads(line) for line in data.split(b"\n")]
            return block[name, at]

        def sent(rows):
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["url_key", "page_id", "file", "offset", "length"],
            )

        for batch in batches:
            rows = []
            for key in sorted(k for k in batch.column("url_key").to_pylist() if k is not None):
                for first, _, name in parts[bisect_left(ends, key):]:
                    if first > key:
                        break
                    if name not in directory:
                        directory.clear()
                        with system.open_input_stream(f"{path}/{name}.dir") as file:
                            directory[name] = json.loads(file.read())
                    firsts = [d[0] for d in directory[name]]
                    # The block before the first one that starts with the key may end with it.
                    for _, at, size in directory[name][max(0, bisect_left(firsts, key) - 1):bisect_right(firsts, key)]:
                        rows += [row for row in lines(name, at, size) if row[0] == key]
                        if len(rows) > 20 * BLOCK_LINES:
                            yield sent(rows)
                            rows = []
            yield sent(rows)

    near = keys.select("url_key").distinct().repartitionByRange("url_key").sortWithinPartitions("url_key")
    return near.mapInArrow(find, "url_key string, page_id long, file string, offset long, length long")


def read(captures: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of ``captures``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, and the payload unless it is not wanted.

    The payload of a revisit is null: it is the payload of the record it refers to.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if with_payload else "")

    def fetch(batches):
        system, path = _open(folder)
        number = lambda urn: int(urn[len("<urn:page:"):-1]) if urn and urn != "<urn:page:>" else None
        name, file = None, None
        for batch in batches:
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            out, at = [], 0
            while at < len(wanted):
                # Records that lie one after another in a file come with one range read.
                end, stop = at + 1, wanted[at][1] + wanted[at][2]
                while end < len(wanted) and wanted[end][0] == wanted[at][0] and wanted[end][1] == stop and stop - wanted[at][1] < READ_BYTES:
                    stop += wanted[end][2]
                    end += 1
                if name != wanted[at][0]:
                    if file is not None:
                        file.close()
                    name = wanted[at][0]
                    file = system.open_input_file(f"{path}/{name}")
                data, base = file.read_at(stop - wanted[at][1], wanted[at][1]), wanted[at][1]
                for _, offset, length in wanted[at:end]:
                    headers, payload = parse(zlib.decompress(data[offset - base:offset - base + length], 31))
                    kind = headers["warc-type"]
                    row = (
                        number(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, number(headers.get("warc-refers-to")),
                        int(headers["warc-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:"),
                    )
                    out.append(row + ((payload if kind == "response" else None),) * with_payload)
                at = end
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = list(zip(*out)) or [()] * (6 + with_payload)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in schema.split(", ")])

    return captures.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(fetch, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive ``pages``, index the archives, look every URL up and read the captures back."""
    folder, captures = write(pages)
    root = build_index(folder, captures)
    found = lookup(pages.select(url_key(F.col("url")).alias("url_key")), folder, root)
    return read(found, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
