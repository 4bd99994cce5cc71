"""WARC archives with a two-level capture index.

Writing: every task writes its rows as gzip-compressed WARC records and
returns where each record lies. Equal payloads are stored once; the others
become revisit records that name the response. Indexing: the reversed-host
URL keys are range-partitioned and sorted, and every index file holds
compressed blocks of entries and, at its end, a sparse directory of the
blocks. Reading: binary search over files, directory and block, then one
range read of the record.

Files go to a folder that all executors share, under names that no other
attempt uses; an entry is known only if its task succeeded, so a lost
executor leaves unreferenced files at worst.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legation.llm.common import chunks, cut, text_of
from legation.llm.url_lists import url_host

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder name as Spark writes it."""
    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[len("file:") :]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def url_key(url: Column) -> Column:
    """Reversed host, a closing bracket, then path and query; empty for a null URL."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.array_join(F.reverse(F.split(url_host(url), r"\.")), ",")
    return F.concat(host, F.lit(")"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^#]*)", 1))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page: int | None, url: str, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    def name(of: int | None) -> str:
        return f"<{uuid.uuid5(_NAMESPACE, f'page:{of}').urn}>" if of is not None else f"<{uuid.uuid4().urn}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {date}"]
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head.append(f"WARC-Target-URI: {target}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(first)}", f"X-Refers-To-Page-Id: {first}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """(WARC headers, payload, payload length by the HTTP header) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    return headers, payload, length


_ENTRY = "key string, id long, file string, offset long, length long"


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "id", "file", "offset", "length"])


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    file_bytes: int = 256 << 20,
    level: int = 1,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """Write one record per row; returns the entries ``key, id, file, offset, length``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest id is the response, the others are revisits of it. Rows
    without an id are responses; rows that repeat the smallest id with the
    same payload are responses too. Null payloads and URLs are empty; other
    columns are ignored.
    """
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_of(payload_col).alias("payload"))
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    long_enough = source.filter((F.octet_length("payload") >= min_bytes) & F.col("id").isNotNull())
    repeated = long_enough.groupBy(digest.alias("digest")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    repeated = cut(repeated.filter("first < last").select("digest", "first"), narrow=True)
    if repeated.limit(broadcast_rows + 1).count() <= broadcast_rows:
        repeated = F.broadcast(repeated)  # some 10 MB at most; beyond that the join shuffles
    enough = F.octet_length("payload") >= min_bytes
    planned = source.join(repeated, enough & (digest == F.col("digest")), "left")
    rows = planned.select(
        "id", "payload", F.coalesce("url", F.lit("")).alias("url"), url_key(F.col("url")).alias("key"), "first"
    )
    target, base = filesystem(folder)
    target.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = filesystem(folder)
        out, file, offset = None, "", 0
        for batch in chunks(batches, "payload"):
            entries = []
            for page, payload, url, key, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    file, offset = f"capture-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{place}/{file}", compression=None)
                revisit = first is not None and page is not None and page != first
                record = gzip.compress(_record(page, url, payload.encode("utf-8", "replace"), first, revisit, date), level, mtime=0)
                out.write(record)
                entries.append((key, page, file, offset, len(record)))
                offset += len(record)
            yield _entry_batch(entries)
        if out is not None:
            out.close()

    return cut(rows.mapInArrow(run, _ENTRY))


def _sort_key(key: str, page: int | None) -> tuple:
    return key, page is None, page or 0


def build_index(entries: DataFrame, folder: str, block_entries: int = 1000) -> list[tuple]:
    """Write the index files; returns the top level, one row per file: first key, file, directory place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = filesystem(folder)
        file = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.idx"
        out, offset, directory, block = None, 0, [], []

        def flush() -> None:
            nonlocal out, offset
            if out is None:
                out = store.open_output_stream(f"{place}/{file}", compression=None)
            data = zlib.compress("\n".join(map(json.dumps, block)).encode(), 1)
            out.write(data)
            directory.append((block[0][0], block[0][1], offset, len(data)))
            offset += len(data)
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                block.append(row)
                if len(block) >= block_entries:
                    flush()
        if block:
            flush()
        if out is not None:
            data = zlib.compress(json.dumps(directory).encode(), 1)
            out.write(data)
            out.close()
            yield _entry_batch([(directory[0][0], directory[0][1], file, offset, len(data))])

    order = (F.col("key"), F.col("id").asc_nulls_last())
    files = entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _ENTRY)
    top = [tuple(row) for row in cut(files, narrow=True).collect()]  # a row per index file
    return sorted(top, key=lambda row: _sort_key(row[0], row[1]))


class IndexReader:
    """Binary search over index files, block directory and block; few blocks stay in memory."""

    def __init__(self, folder: str, top: list[tuple], keep: int = 8):
        self.store, self.place = filesystem(folder)
        self.top = top
        self.starts = [_sort_key(row[0], row[1]) for row in top]
        self.kept: OrderedDict = OrderedDict()
        self.keep = keep

    def _load(self, file: str, offset: int, length: int) -> tuple[list, list]:
        """(rows, their sort keys) of a directory or a block."""
        if (file, offset) not in self.kept:
            with self.store.open_input_file(f"{self.place}/{file}") as source:
                data = zlib.decompress(source.read_at(length, offset)).decode()
            rows = [json.loads(line) for line in data.split("\n")] if data[:2] != "[[" else json.loads(data)
            self.kept[file, offset] = rows, [_sort_key(row[0], row[1]) for row in rows]
            while len(self.kept) > self.keep:
                self.kept.popitem(last=False)
        self.kept.move_to_end((file, offset))
        return self.kept[file, offset]

    def find(self, key: str, page: int | None, whole_key: bool = False) -> Iterator[list]:
        """Entries of (key, page), or of every page under the key; equal entries are all returned."""
        low = (key,) if whole_key else _sort_key(key, page)
        for t in range(max(0, bisect.bisect_left(self.starts, low) - 1), len(self.top)):
            if self.starts[t][: len(low)] > low:
                return
            _, _, file, at, size = self.top[t]
            directory, firsts = self._load(file, at, size)
            for b in range(max(0, bisect.bisect_left(firsts, low) - 1), len(directory)):
                if firsts[b][: len(low)] > low:
                    return
                rows, keys = self._load(file, directory[b][2], directory[b][3])
                for i in range(bisect.bisect_left(keys, low), len(rows)):
                    if keys[i][: len(low)] > low:
                        return
                    yield rows[i]


def lookup(wanted: DataFrame, folder: str, top: list[tuple], whole_key: bool = False) -> DataFrame:
    """Entries of the wanted rows ``key, id`` (distinct; with ``whole_key`` the ids are not compared).

    Sorted lookups walk through the index once, so a block is read by one task
    about once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(folder, top)
        for batch in batches:
            rows = []
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [tuple(row) for row in reader.find(key, page, whole_key)]
            yield _entry_batch(rows)

    order = (F.col("key"), F.col("id").asc_nulls_last())
    return wanted.select("key", "id").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _ENTRY)


def read_records(entries: DataFrame, folder: str) -> DataFrame:
    """One row per entry, read from the archive: ``id, payload_bytes, payload_digest, record_type, refers_to``.

    The digest and length of a response are computed from the payload read;
    those of a revisit are the ones its record states.
    """
    schema = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = filesystem(folder)
        source, at = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns[2:])):
                if file != at:
                    if source is not None:
                        source.close()
                    source, at = store.open_input_file(f"{place}/{file}"), file
                headers, payload, stated = parse_record(gzip.decompress(source.read_at(length, offset)))
                page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), stated
                if headers["WARC-Type"] == "response":
                    digest, size = payload_digest(payload), len(payload)
                rows.append((int(page) if page else None, size, digest, headers["WARC-Type"], int(refers) if refers else None))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        if source is not None:
            source.close()

    order = ("file", "offset")
    placed = entries.select("key", "id", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **options) -> DataFrame:
    """Write the pages, index them, look every page up by URL key and id, and read its record back.

    One row per page: ``<id>, payload_bytes, payload_digest, record_type,
    refers_to``. An empty table writes nothing and gives no rows.
    """
    entries = write_archives(pages, folder, id_col, url_col, payload_col, **options)
    top = build_index(entries, folder)
    wanted = pages.select(url_key(F.col(url_col)).alias("key"), F.col(id_col).cast("long").alias("id")).distinct()
    return read_records(lookup(wanted, folder, top), folder).withColumnRenamed("id", id_col)
