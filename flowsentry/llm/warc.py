"""Web archives (WARC) with a two-level capture index, written and read by Spark tasks.

A folder holds

* `archive/*.warc.gz`  one gzip member per record: a response with its payload, or a revisit that only names the
  record whose payload is the same;
* `index/*.idx`        the captures of one range of keys, sorted by key and packed into compressed blocks of
  `BLOCK_LINES`; behind them the file's sparse directory (first key, offset and length of every block) and, in the
  last eight bytes, where that begins;
* `manifest`           Parquet, one row per index file: file, first_key, last_key, blocks, captures.

A key is the URL with its host reversed (`http://www.a.org/x?y` is `org,a,www)/x?y`), so that the captures of a
domain lie together. Wanted URLs are dealt to the index files whose key range holds them; there a binary search of the
directory names the blocks, a range read and a second binary search give the captures, and range reads of the archive
the records. Directories are read by the tasks that need them; the driver sees one row per index file.

Payloads are equal by length and SHA-256. Of equal payloads of at least `min_bytes` the record with the smallest id
is the response. The first of each group travels to its rows over salted keys, so that a group that holds a third of
all rows is split; files are named by task attempt and only those of committed attempts are in the index.

Defined results: null html is an empty payload; a null URL is an empty one with an empty key; null ids come last; of
rows that repeat id and payload one (that with the smallest URL) is the response. An empty table gives an
empty folder and empty results; other columns are ignored. Characters that would end a header line are escaped.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from base64 import b32encode
from bisect import bisect_left
from hashlib import sha1
from urllib.parse import quote, urlsplit
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import file_store, written

register_pickle_by_value(sys.modules[__name__])

#: Captures in a compressed block, bytes after which an archive file ends, bytes fetched by one range read.
BLOCK_LINES, FILE_BYTES, READ_BYTES = 2_000, 1 << 30, 8 << 20
#: Parts into which the rows of one group of equal payloads are dealt.
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, record_type string, file string, offset long, length long"
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "payload binary")


def url_key(url: str) -> str:
    """Reversed host, then path and query; scheme, user, default port and fragment do not count."""
    try:
        u = urlsplit(url)
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url.lower()
    if not host:
        return url.partition("#")[0]
    named = host if ":" in host or re.fullmatch(r"[\d.]+", host) else ",".join(reversed(host.split(".")))
    if port and port != {"http": 80, "https": 443}.get(u.scheme):
        named += f":{port}"
    return f"{named}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def digest_text(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def _header_text(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), value)


def _record_id(row_id, url: str, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'{row_id} {nth} {digest} {url}')}>"


def record(page_id, url: str, payload: bytes, digest: str, nth: int, first=None) -> bytes:
    """One uncompressed record; `first` is (id, url) of the response that a revisit names."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Target-URI: {_header_text(url)}",
            f"WARC-Date: {DATE}", f"WARC-Record-ID: {_record_id(page_id, url, digest, nth)}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if first:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(*first, digest, 1)}",
                 f"WARC-Refers-To-Target-URI: {_header_text(first[1])}"]
        head += [f"Refers-To-Page: {first[0]}"] if first[0] is not None else []
    head += [f"Page: {page_id}"] if page_id is not None else []
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """(page id, url, type, refers to, payload bytes, digest, payload) of one record, checked against its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    if not version.startswith("WARC/"):
        raise ValueError(f"no record: {version[:40]!r}")
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(fields[name]) if name in fields else None
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest_text(payload) != digest):
        raise ValueError(f"payload of page {fields.get('Page')} does not match its digest")
    return (number("Page"), fields["WARC-Target-URI"], kind, number("Refers-To-Page"), length, digest,
            payload if kind == "response" else None)


class _Archive:
    """Files of one task, opened when they are needed and ended at `FILE_BYTES`."""

    def __init__(self, folder: str):
        self.store, self.path = file_store(f"{folder}/archive")
        self.out, self.at, self.name = None, 0, None

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name, self.at = f"{uuid4().hex}.warc.gz", 0
            self.store.create_dir(self.path, recursive=True)
            self.out = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None)
        pack = zlib.compressobj(wbits=31)
        packed = pack.compress(data) + pack.flush()
        self.out.write(packed)
        found = (self.name, self.at, len(packed))
        self.at += len(packed)
        if self.at >= FILE_BYTES:
            self.close()
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _with_first(df: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """Rows with `first` (id and url of their group's response, null where they are alone) and `nth` of equal rows."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"),
                     F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("content", F.unhex(F.sha2("payload", 256)))
    shared = (rows.filter(F.octet_length("payload") >= min_bytes).groupBy("content")
              .agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "url")).alias("first"), F.count("*").alias("n"))
              .filter("n > 1").select("content", "first", F.explode(F.expr(f"sequence(0, {SALTS - 1})")).alias("salt")))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).repartition("content", "salt")
    equal = Window.partitionBy("content", "salt", "id", "url").orderBy("salt")
    return dealt.withColumn("nth", F.row_number().over(equal)).join(shared, ["content", "salt"], "left")


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0) -> DataFrame:
    """Write the records of `df`, then their index; returns the manifest."""
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
                        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def save(batches):
        archive = _Archive(folder)
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                page, url, payload, first = row["id"], row["url"], row["payload"], row["first"]
                first = first and (first["id"], first["url"])
                revisit = first is not None and ((page, url) != first or row["nth"] > 1)
                data = record(page, url, payload, digest_text(payload), row["nth"], first if revisit else None)
                found.append((url_key(url), page, "revisit" if revisit else "response", *archive.add(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)]
                                             if found else [pa.array([], t) for t in schema.types], schema=schema)
        archive.close()

    rows = _with_first(df, id_col, url_col, html_col, min_bytes).select("id", "url", "payload", "nth", "first")
    captures = written(rows.mapInArrow(save, CAPTURE), "captures")
    return write_index(captures, folder)


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures by key into index files; returns the manifest."""

    def pack(batches):
        store, path = file_store(f"{folder}/index")
        name, out, at, directory, lines, last, n = f"{uuid4().hex}.idx", None, 0, [], [], None, 0

        def block():
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode())
            out.write(data)
            directory[-1][1:] = [at, len(data)]
            at, lines = at + len(data), []

        for batch in batches:
            for key, *place in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                if not lines:
                    directory.append([key, 0, 0])
                lines.append(json.dumps([key, *place]))
                last, n = key, n + 1
                if len(lines) == BLOCK_LINES:
                    block()
        if out is not None:
            if lines:
                block()
            out.write(zlib.compress(json.dumps(directory).encode()) + at.to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "first_key": [directory[0][0]], "last_key": [last],
                                              "blocks": pa.array([len(directory)], pa.int64()),
                                              "captures": pa.array([n], pa.int64())})

    order = ["key", "page_id", "file", "offset"]
    dealt = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = dealt.select("key", "page_id", "record_type", "file", "offset", "length").mapInArrow(
        pack, "file string, first_key string, last_key string, blocks long, captures long")
    parts.write.parquet(f"{folder}/manifest")
    return parts.sparkSession.read.parquet(f"{folder}/manifest")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class _IndexFile:
    """The directory of an index file and the last block that was read."""

    def __init__(self, folder: str, name: str):
        store, path = file_store(f"{folder}/index")
        self.file = store.open_input_file(f"{path}/{name}")
        size = self.file.size()
        at = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.directory = json.loads(zlib.decompress(self.file.read_at(size - 8 - at, at)))
        self.firsts = [d[0] for d in self.directory]
        self.at, self.keys, self.lines = None, [], []

    def _load(self, i: int) -> None:
        if self.at != i:
            _, at, length = self.directory[i]
            self.lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(length, at)).split(b"\n")]
            self.at, self.keys = i, [x[0] for x in self.lines]

    def captures(self, key: str):
        """Lists of captures, one per block that holds the key."""
        i = max(0, bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            self._load(i)
            begin = bisect_left(self.keys, key)
            end = bisect_left(self.keys, key + "\x00", begin)
            if end > begin:
                yield self.lines[begin:end]
            i += 1


def find(spark: SparkSession, folder: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of every URL of `urls`, each once."""
    parts = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/manifest").select(
        "first_key", "last_key", "file").collect())  # one row per index file
    lasts = [p[1] for p in parts]

    def deal(batches):
        for batch in batches:
            keys, files = [], []
            for url in batch.column(0).to_pylist():
                key = url_key(url)
                i = bisect_left(lasts, key)
                while i < len(parts) and parts[i][0] <= key:
                    keys.append(key)
                    files.append(parts[i][2])
                    i += 1
            yield pa.RecordBatch.from_pydict({"index": pa.array(files, pa.string()), "key": pa.array(keys, pa.string())})

    def search(batches):
        name, index = None, None
        for batch in batches:
            for file, key in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    name, index = file, _IndexFile(folder, file)
                for hits in index.captures(key):
                    columns = list(zip(*hits))
                    yield pa.RecordBatch.from_pydict({
                        n: pa.array(columns[i], t) for i, (n, t) in enumerate((
                            ("key", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
                            ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())))})

    wanted = urls.select(F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url")).distinct()
    dealt = wanted.mapInArrow(deal, "index string, key string").distinct()
    # a key stands for blocks to read, so tasks go by their number and not by the keys' size
    return (dealt.repartitionByRange(_tasks(spark), "index", "key").sortWithinPartitions("index", "key")
            .select("index", "key").mapInArrow(search, CAPTURE))


def read_records(captures: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records at `captures`, by range reads in file order; a revisit's payload is null."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def runs(batches):
        """(file, offset, lengths) of neighbours that are read at once."""
        at = None
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if at and at[0] == file and at[1] + sum(at[2]) == offset and sum(at[2]) + length <= READ_BYTES:
                    at[2].append(length)
                    continue
                if at:
                    yield at
                at = (file, offset, [length])
        if at:
            yield at

    def load(batches):
        store, path = file_store(f"{folder}/archive")
        name, file = None, None
        for wanted, offset, lengths in runs(batches):
            if wanted != name:
                name, file = wanted, store.open_input_file(f"{path}/{wanted}")
            data, rows, begin = memoryview(file.read_at(sum(lengths), offset)), [], 0
            for n in lengths:
                found = parse(zlib.decompress(data[begin:begin + n], 31))
                rows.append(found if payload else (*found[:-1], None))
                begin += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    dealt = (captures.repartition(_tasks(captures.sparkSession), F.col("file"), F.floor(F.col("offset") / READ_BYTES))
             .sortWithinPartitions("file", "offset").select("file", "offset", "length"))
    return dealt.mapInArrow(load, RECORD)
