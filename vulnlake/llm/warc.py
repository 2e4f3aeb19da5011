"""WARC archives of pages, found again through a two-level capture index.

Archive: one WARC/1.1 record per page, each a gzip member of its own, so a record is read alone by offset and length. Of
records with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response, the others are
revisits that name it and hold no payload (their HTTP header keeps its length).

Index: capture keys (host labels reversed, then port, path and query) are sorted over all files. A file of the index is a
run of blocks, each of ``BLOCK_LINES`` lines and compressed alone, and at its end the sparse directory of its blocks' first
keys. A lookup searches the bounds of the files (one row per file), then one directory, by bisection, and reads only the
blocks in question by range; its lines give the records, which are read by range in their turn.

Spark deals out and sorts pages, index lines, lookups, blocks and records. Tasks hold one record, one block and one
directory (one line per ``BLOCK_LINES`` captures of a file) at a time. A file's name holds the attempt that wrote it, and
only files in tables that Spark has committed are read, so a repeated task leaves at most a file nobody names.

Edge cases. A null html is empty, and so are equal to each other. A null or unreadable url has the key made of what is there, null
the empty key and no target header. A null page_id is larger than any other. Rows repeated in full are records of their
own: one response, the others revisits of it. An empty table writes no archive and gives an empty result. Extra columns
are ignored. Control characters and blanks of a url are percent-encoded in headers and keys.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import ship, shared_folder, table, written
from vulnlake.llm.ordering import in_ranges, runs_of
from vulnlake.llm.registry import query
from vulnlake.llm.wavelet import store

BLOCK_LINES = 1_000
FILE_BYTES = 1 << 30
#: Records closer than this are read in one go.
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20
MAGIC = b"CIX1"
URN = "urn:capture"
UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f\u2028\u2029]")


def safe(url: str) -> str:
    return UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url)


def capture_key(url: str | None) -> str:
    """``com,example,www:8080)/path?query``; scheme, user and fragment are left out, addresses are not reversed."""
    if not url:
        return ""
    rest = safe(url.strip()).split("#", 1)[0]
    scheme, mark, after = rest.partition("://")
    rest = after if mark else rest
    cut = re.search(r"[/?]", rest)
    host, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    host = host.rpartition("@")[2].lower()
    name, colon, port = host.rpartition(":")
    if not (colon and port.isdigit()):
        name, port = host.rstrip(":"), ""
    if port == {"http": "80", "https": "443"}.get(scheme.lower()):
        port = ""
    name = name.rstrip(".")
    if not re.fullmatch(r"[\d.]+|\[.*\]", name):
        name = ",".join(reversed(name.split(".")))
    return f"{name}{':' + port if port else ''}){path if path[:1] == '/' else '/' + path}"


class Index(NamedTuple):
    """Folder of a data set of archives; ``bounds`` lists its index files with their first and last keys."""

    folder: str
    bounds: list[tuple[str, bytes, bytes]]


def header(lines: list[tuple[str, str | None]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode()


def record(name: str, url: str | None, kind: str, digest: str, size: int, refers: str | None, payload: bytes) -> bytes:
    """A record with its HTTP header; a revisit's payload is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = header([("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", None if url is None else safe(url)),
                   ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", refers and f"<{refers}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if refers else None),
                   ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))])
    return b"WARC/1.1\r\n" + head + b"\r\n" + body + b"\r\n\r\n"


def fields(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of a record or of an HTTP message, and what follows."""
    head, _, rest = block.partition(b"\r\n\r\n")
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x), rest


def parsed(raw: bytes) -> dict:
    """What a record says, checked against its own payload."""
    head, rest = fields(raw)
    http, payload = fields(rest[: int(head["Content-Length"])])
    digest, size, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"]), head["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    page = lambda urn: None if (x := urn.split(":")[2]) == "null" else int(x)
    return {"page_id": page(head["WARC-Record-ID"].strip("<>")), "url": head.get("WARC-Target-URI"), "payload": payload if kind == "response" else None, "payload_bytes": size,
            "payload_digest": digest, "record_type": kind, "refers_to": page(head["WARC-Refers-To"].strip("<>")) if kind == "revisit" else None}


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


ENTRY = "key string, page_id long, file string, at long, length long"
ENTRY_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])


def same_payloads(pages: DataFrame, least: int) -> DataFrame:
    """who, again, rep_id, rep_who: for each row's digest whether its payload has a response elsewhere, and whose; no payloads.

    Payloads are ordered by digest and page_id in ranges, so copies of one payload stay dealt out."""
    order = [F.col("sha"), F.col("page_id").asc_nulls_last(), F.col("who")]
    rows = in_ranges(pages.select("page_id", "who", "sha", "size"), order, order, ["page_id", "who", "sha", "size"], "warc-digests")
    heads = runs_of(rows, "sha").where("_before = 0").select("sha", "_part", F.col("_first").alias("_at"))
    first = rows.join(heads, ["sha", "_part", "_at"]).select("sha", F.col("page_id").alias("rep_id"), F.col("who").alias("rep_who"))
    ranges = rows.select("sha", "_part").distinct().join(first, "sha")
    told = rows.join(ranges, ["sha", "_part"]).select("who", (F.col("size") >= least).alias("dedup"), "rep_id", "rep_who").distinct()
    return written(told, "warc-decisions")


def write_archives(pages: DataFrame, folder: str, *, least: int = 0, level: int = 6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes an archive per task to ``folder``/archive; gives the entries (key, page_id, file, at, length) of all records.

    Pages are shuffled once, by the digest of the whole row, to meet the decision on their payload; equal rows follow each
    other there."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha2("html", 256))
    p = p.withColumn("who", F.sha2(F.concat_ws(" ", "page_id", F.lit("/"), F.concat(F.lit("="), "url"), F.lit("/"), "sha"), 256))
    told = same_payloads(p.withColumn("size", F.octet_length("html")), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = store(f"{folder}/archive")
        out, name, at, seq, last, copy, entries = None, "", 0, 0, None, 0, []
        try:
            for b in batches:
                cols = [b.column(c).to_pylist() for c in ("page_id", "url", "who", "dedup", "rep_id", "rep_who")]
                for page_id, url, who, dedup, rep_id, rep_who, html in zip(*cols, b.column("html")):
                    payload = html.as_buffer().to_pybytes()
                    copy, last = (copy + 1 if who == last else 0), who
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    urn = lambda page, row, k: f"{URN}:{'null' if page is None else page}:{row[:32]}:{k}"
                    again = dedup and (copy > 0 or who != rep_who)
                    raw = record(urn(page_id, who, copy), url, "revisit" if again else "response", digest, len(payload), urn(rep_id, rep_who, 0) if again else None, payload)
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = z.compress(raw) + z.flush()
                    if out is not None and at + len(data) > FILE_BYTES:
                        out.close()
                        out, at, seq = None, 0, seq + 1
                    if out is None:
                        name = f"{task.partitionId():06d}-{seq:04d}-{task.taskAttemptId()}.warc.gz"
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    entries.append((capture_key(url), page_id, name, at, len(data)))
                    at += len(data)
                    if len(entries) >= 10_000:
                        yield batch(entries, ENTRY_ARROW)
                        entries.clear()
        finally:
            if out is not None:
                out.close()
        if entries:
            yield batch(entries, ENTRY_ARROW)

    # Dealt out here and not by the join, which may be a broadcast or split a partition: equal rows have to meet.
    rows = p.select("page_id", "url", "who", "html").repartition("who").join(told, "who").sortWithinPartitions("who")
    return written(rows.mapInArrow(run, ENTRY), "warc-entries")


def write_index(entries: DataFrame, folder: str) -> Index:
    """Sorted index files with their directories; the driver keeps a name and two keys of each file (one per range)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = store(f"{folder}/index")
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.cix"
        out, at, lines, directory, last = None, 0, [], [], b""

        def flush() -> None:
            nonlocal out, at
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress(b"\n".join(lines), 6)
            out.write(data)
            directory.append((lines[0].split(b"\t", 1)[0].decode(), at, len(data)))
            at += len(data)
            lines.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ENTRY_ARROW.names)):
                lines.append("\t".join([row[0], json.dumps(row[1:])]).encode())
                last = row[0]
                if len(lines) >= BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(tail + struct.pack("<Q", len(tail)) + MAGIC)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([last])], ["file", "first", "last"])

    ordered = entries.repartitionByRange("key", F.col("page_id").asc_nulls_first(), "file", "at").sortWithinPartitions("key", F.col("page_id").asc_nulls_first(), "file", "at")
    files = written(ordered.mapInArrow(run, "file string, first string, last string"), "warc-index")
    return Index(folder, sorted(((r["file"], r["first"].encode(), r["last"].encode()) for r in files.collect()), key=lambda f: (f[1], f[2], f[0])))


def directory_of(fs, path: str) -> list[tuple[bytes, int, int]]:
    """(first key, offset, length) of a file's blocks, by two range reads at its end."""
    with fs.open_input_file(path) as f:
        size = f.size()
        length, magic = struct.unpack("<Q4s", f.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError(f"not a capture index: {path}")
        return [(k.encode(), at, n) for k, at, n in json.loads(zlib.decompress(f.read_at(length, size - 12 - length)))]


def blocks_for(directory: list[tuple[bytes, int, int]], key: bytes) -> range:
    """Blocks that can hold a key: from the last one that begins before it to the last one that begins with it."""
    firsts = [d[0] for d in directory]
    return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))


def captures(keys: DataFrame, index: Index) -> DataFrame:
    """Entries (key, page_id, file, at, length) of the captures with the given keys (one column, key; each once).

    Each key finds its blocks by bisection; then a row per (key, block) is dealt out by block, and a block is read once."""
    bounds, folder = index.bounds, index.folder

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(f"{folder}/index")
        firsts, held, known = [b[1] for b in bounds], None, []
        for b in batches:
            out = []
            for key in b.column("key").to_pylist():
                k = key.encode()
                # A key may fill several files; the file before the first that begins with it may end with it.
                for i in range(max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k)):
                    if bounds[i][2] < k:
                        continue
                    if held != i:
                        directory, held = directory_of(fs, f"{root}/{bounds[i][0]}"), i
                    out += [(key, bounds[i][0], *directory[j][1:]) for j in blocks_for(directory, k)]
            if out:
                yield batch(out, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(f"{folder}/index")
        held, lines, starts, name, f = None, [], [], None, None
        try:
            for b in batches:
                out = []
                for key, file, at, length in zip(*(b.column(c).to_pylist() for c in ("key", "block_file", "block_at", "block_length"))):
                    if (file, at) != held:
                        if file != name:
                            if f is not None:
                                f.close()
                            f, name = fs.open_input_file(f"{root}/{file}"), file
                        lines, held = zlib.decompress(f.read_at(length, at)).split(b"\n"), (file, at)
                        starts = [x.split(b"\t", 1)[0] for x in lines]
                    k = key.encode()
                    out += [(key, *json.loads(x.split(b"\t", 1)[1])) for x in lines[bisect.bisect_left(starts, k) : bisect.bisect_right(starts, k)]]
                    if len(out) >= 10_000:
                        yield batch(out, ENTRY_ARROW)
                        out = []
                if out:
                    yield batch(out, ENTRY_ARROW)
        finally:
            if f is not None:
                f.close()

    schema = pa.schema([("key", pa.string()), ("block_file", pa.string()), ("block_at", pa.int64()), ("block_length", pa.int64())])
    # Keys in order, so a task opens few directories.
    found = keys.select("key").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(search, "key string, block_file string, block_at long, block_length long")
    return found.repartition("block_file", "block_at").sortWithinPartitions("block_file", "block_at").mapInArrow(read, ENTRY)


RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def records(entries: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of entries, each read by its range; neighbours in a file are read together. ``payloads``: False leaves them null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(f"{folder}/archive")
        name, f, out, size = None, None, [], 0
        try:
            for b in batches:
                wanted = list(zip(b.column("file").to_pylist(), b.column("at").to_pylist(), b.column("length").to_pylist()))
                i = 0
                while i < len(wanted):
                    file, begin, length = wanted[i]
                    j, end = i + 1, begin + length
                    while j < len(wanted) and wanted[j][0] == file and begin <= wanted[j][1] <= end + GAP_BYTES and wanted[j][1] + wanted[j][2] - begin <= READ_BYTES:
                        end = max(end, wanted[j][1] + wanted[j][2])
                        j += 1
                    if file != name:
                        if f is not None:
                            f.close()
                        f, name = fs.open_input_file(f"{root}/{file}"), file
                    data = memoryview(f.read_at(end - begin, begin))
                    for _, at, n in wanted[i:j]:
                        r = parsed(zlib.decompress(data[at - begin : at - begin + n], 31))
                        size += r["payload_bytes"] if payloads else 0
                        out.append(tuple(r[c] if c != "payload" or payloads else None for c in RECORD_ARROW.names))
                        if size > READ_BYTES or len(out) >= 10_000:
                            yield batch(out, RECORD_ARROW)
                            out, size = [], 0
                    i = j
        finally:
            if f is not None:
                f.close()
        if out:
            yield batch(out, RECORD_ARROW)

    # Places of a file are dealt out by runs of 4 MB.
    dealt = entries.repartition("file", F.shiftright("at", 22)).sortWithinPartitions("file", "at")
    return dealt.mapInArrow(run, RECORD)


def keys_of(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct capture keys of urls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u) for u in b.column(0).to_pylist()], pa.string())], ["key"])

    return urls.select(F.col(url_col).cast("string")).distinct().mapInArrow(run, "key string").distinct()


def archive(pages: DataFrame, folder: str, *, least: int = 0) -> Index:
    return write_index(write_archives(pages, folder, least=least), folder)


B32 = """array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
  ((('0x' || substr({0}, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1]), '')"""
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') h, sha1(coalesce(html, '')) s FROM pages),
q AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) k, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST) f FROM p)
SELECT page_id, strlen(h) AS payload_bytes, {B32.format('s')} AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to FROM q"""


@query("op13_warc_index", SQL)
def op13_warc_index(spark: SparkSession, sf_dir):
    pages, folder = table(spark, sf_dir, "pages"), shared_folder(spark, "warc")
    index = archive(pages, folder)
    found = captures(keys_of(pages), index)
    return records(found, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ship(__name__)
