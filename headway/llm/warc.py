"""WARC archives of pages with a two-level capture index.

Each page is a record: a response with its payload, or a revisit that refers to the response with the
same payload. Archives are files of gzip members, a member for each record. The index sorts captures by
their reversed-host URL key into gzip blocks; a sparse directory, at the end of each index file, has the
first and last key of each block with its place. A look-up finds the index files by their first and last
keys (a row for each partition, whatever the data), searches their directories, reads the blocks by their
ranges, searches these, and reads the records by their ranges. `search` does so for a table of keys: keys
are dealt by file and order, blocks and archives each to one task, so that each is opened once. A key that
many captures share is asked for once, and its blocks are dealt to as many tasks.

A null page is empty and a null url stands under its page_id. Of equal payloads the largest page_id is
the response (rows that share it are all responses); payloads of fewer than `least` bytes are all
responses; a null page_id counts as the smallest. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import files
from headway.llm.common import parts, shared_dir, stage, table

DATE = "1970-01-01T00:00:00Z"
ARCHIVE_BYTES = 64_000_000
BLOCK_LINES = 2000
_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
CAPTURES = "key string, page_id long, uri string, at long, size long"
PLACES = "key string, uri string, at long, size long"
DIRECTORY = "first_key string, last_key string, uri string, at long, size long, n long, dir_at long, dir_size long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def target(page_id: int | None, url: str | None) -> str:
    """The URL that a record stands under; blanks and control characters would end a header line."""
    import re

    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def url_key(url: str) -> str:
    """com,example,www)/path?query: the host reversed, without scheme, user, port or fragment."""
    from urllib.parse import urlsplit

    url = target(None, url)
    try:
        u = urlsplit(url)
        host = (u.hostname or "").rstrip(".")
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uuid(page_id: int | None) -> str:
    import uuid

    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uuid(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uuid(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    as_int = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": as_int("X-Page-Id"), "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": kind, "refers_to": as_int("X-Refers-To-Page-Id"), "payload": payload if kind == "response" else None}


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        from pyspark import TaskContext

        part, seq, body, size, rows = TaskContext.get().partitionId(), 0, [], 0, []

        def flush() -> pa.RecordBatch:
            uri = files.write(folder, f"{part:06d}-{seq:05d}.warc.gz", b"".join(body))
            cols = list(zip(*((k, p, uri, a, n) for k, p, a, n in rows)))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CAPTURE)], schema=_CAPTURE)

        for b in batches:
            for k in range(0, b.num_rows, 256):
                for page, url, html, response in zip(*(c.to_pylist() for c in b.slice(k, 256).columns)):
                    payload = html.encode("utf-8")
                    url = target(page, url)
                    member = gzip.compress(record(page, url, payload, response, response is not None), 6, mtime=0)
                    rows.append((url_key(url), page, size, len(member)))
                    body.append(member)
                    size += len(member)
                    if size >= archive_bytes:
                        yield flush()
                        seq, body, size, rows = seq + 1, [], 0, []
        if rows:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; returns key, page_id, uri, at, size of every capture."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("payload", F.sha1(F.encode("html", "UTF-8")))
    best = p.where(F.octet_length("html") >= least).groupBy("payload").agg(F.max("page_id").alias("response"))
    role = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    rows = p.join(best, "payload", "left").select("page_id", "url", "html", role.alias("response"))
    return stage(rows.mapInArrow(_write(folder, archive_bytes), CAPTURES))


def _blocks(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        from pyspark import TaskContext

        held, body, rows, at = [], [], [], 0
        name = f"{TaskContext.get().partitionId():06d}.idx"

        def close() -> None:
            nonlocal held, at
            member = gzip.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode(), 6, mtime=0)
            rows.append((held[0][0], held[-1][0], f"{folder}/{name}", at, len(member), len(held)))
            body.append(member)
            at, held = at + len(member), []

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                if len(held) >= lines:
                    close()
        if held:
            close()
        last = gzip.compress(json.dumps([[r[0], r[1], r[3], r[4]] for r in rows], ensure_ascii=False).encode(), 6, mtime=0)
        if rows:
            files.write(folder, name, b"".join([*body, last]))
        rows = [(*r, at, len(last)) for r in rows]
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["first_key", "last_key", "uri", "at", "size", "n", "dir_at", "dir_size"])

    return run


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the sorted blocks of captures, each file with its directory; returns the directories' rows, one for each block."""
    n = parts(captures.sparkSession)
    ordered = captures.select("key", "page_id", "uri", "at", "size").repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "uri", "at")
    return stage(ordered.mapInArrow(_blocks(folder, lines), DIRECTORY))


def captures_of(uri: str, at: int, size: int) -> list[list]:
    import gzip

    return [json.loads(x) for x in gzip.decompress(files.read(uri, at, size)).decode().split("\n")]


def _spans(first: list[str], last: list[str], key: str) -> range:
    """Which of the sorted stretches may hold the key: a key with many captures spans several."""
    from bisect import bisect_left, bisect_right

    return range(bisect_left(last, key), bisect_right(first, key))


def _placed(index_files: list[tuple]):
    """The index files that may hold each key, with their directories' places."""
    first, last = [f[0] for f in index_files], [f[1] for f in index_files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key, *index_files[k][2:]) for key in b.column(0).to_pylist() for k in _spans(first, last, key)]
            yield _places(rows)

    return run


def _places(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["key", "uri", "at", "size"])


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks that may hold each key, by binary search in its file's directory; keys come by file."""
    import gzip

    now, held, first, last = None, [], [], []
    for b in batches:
        rows = []
        for key, uri, at, size in zip(*(c.to_pylist() for c in b.columns)):
            if uri != now:
                now, held = uri, json.loads(gzip.decompress(files.read(uri, at, size)))
                first, last = [x[0] for x in held], [x[1] for x in held]
            rows += [(key, uri, *held[k][2:]) for k in _spans(first, last, key)]
        yield _places(rows)


def _captures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each key, by binary search in its block; keys come by block."""
    from bisect import bisect_left, bisect_right

    now, lines, keys = None, [], []
    for b in batches:
        rows = []
        for key, uri, at, size in zip(*(c.to_pylist() for c in b.columns)):
            if (uri, at) != now:
                now, lines = (uri, at), captures_of(uri, at, size)
                keys = [x[0] for x in lines]
            rows += lines[bisect_left(keys, key) : bisect_right(keys, key)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_CAPTURE)], schema=_CAPTURE)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of captures, by range; captures come by archive."""
    import gzip

    opened, now = None, None
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    for b in batches:
        for k in range(0, b.num_rows, 500):
            out = []
            for uri, at, size in zip(*(b.slice(k, 500).column(c).to_pylist() for c in ("uri", "at", "size"))):
                if uri != now:
                    opened, now = files.opened(uri), uri
                opened.seek(at)
                out.append(parsed(gzip.decompress(opened.read(size))))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types)], list(names))


def keys_of(pages: DataFrame) -> DataFrame:
    """key: the different keys that the pages stand under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(target(p, u)) for p, u in zip(*(c.to_pylist() for c in b.columns))], pa.string())], ["key"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "key string").distinct()


def search(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """key, page_id, uri, at, size of all captures of the keys; a key may be asked for once only."""
    n = parts(directory.sparkSession)
    ends = directory.groupBy("uri", "dir_at", "dir_size").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"))
    # an index file for each partition that wrote one
    index_files = sorted((r["first"], r["last"], r.uri, r.dir_at, r.dir_size) for r in ends.collect())
    placed = keys.mapInArrow(_placed(index_files), PLACES).repartitionByRange(n, "uri", "key").sortWithinPartitions("uri", "key")
    found = placed.mapInArrow(_blocks_of, PLACES).repartition(n, "uri", "at").sortWithinPartitions("uri", "at", "key")
    return found.mapInArrow(_captures_of, CAPTURES)


def read(captures: DataFrame) -> DataFrame:
    """The records of captures."""
    return captures.repartition(parts(captures.sparkSession), "uri").sortWithinPartitions("uri", "at").mapInArrow(_records, RECORDS)


def lookup(directory: DataFrame, url: str) -> list[dict]:
    """The records of one URL."""
    key = directory.sparkSession.range(1).select(F.lit(url_key(url)).alias("key"))
    return [r.asDict() for r in read(search(directory, key)).collect()]


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    pages = table(spark, sf_dir, "pages")
    directory = write_index(write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    return read(search(directory, keys_of(pages))).drop("payload")


QUERIES = {"op6_warc": op6_warc}
ORACLES: dict[str, str] = {}
