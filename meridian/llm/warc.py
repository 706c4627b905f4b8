"""WARC archives of pages: writing with revisit records, reading back, and one ordered index of all captures.

Equal payloads are found by digest: the smallest page_id of each is taken per task and then overall, and comes
back to the pages by a join on digest and salt, so that a payload that a third of the pages share is dealt over
many tasks. Each archive, once read back, is a run of captures sorted by URL key and time. The runs are dealt by
ranges of (key, time, page_id), and in each range a loser tree merges the parts of the runs that fall there: as they
stream by, parts of so many captures together are merged into a file in the shared folder, and those files at the end,
read a batch at a time, so that memory does not grow with a range.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import filesystem, shared_path, slices, written

#: Payload bytes from which equal payloads become revisits.
REVISIT_BYTES = 100
#: Tasks over which the pages of one digest are dealt.
SALTS = 64
#: Compressed bytes at which the next archive begins; captures aimed at in a range of the index, and merged in memory.
ARCHIVE_BYTES, RANGE_ROWS, MERGE_ROWS = 32 << 20, 250_000, 100_000
#: Captures of a batch.
_BATCH = 4096
GZIP_LEVEL = 4
_CHUNK = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RUN = "run string, seq long, urlkey string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, size long"
_RUN_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_RUN_NAMES = [f.split(" ")[0] for f in RUN.split(", ")]
INDEX = RUN.split(", ", 2)[2] + ", history int, place long"
_INDEX_TYPES, _INDEX_NAMES = [*_RUN_TYPES[2:], pa.int32(), pa.int64()], [*_RUN_NAMES[2:], "history", "place"]


def url_key(url: str) -> str:
    """Host labels in reverse, then path and query, lower case; what does not parse stands for itself."""
    try:
        u = urlsplit(url.strip())
        host = u.hostname or ""
    except ValueError:
        return url.lower()
    port = f":{u.netloc.rsplit(':', 1)[1]}" if u.netloc.rsplit(":", 1)[-1].isdigit() and ":" in u.netloc else ""
    return f"{','.join(reversed(host.split('.')))}{port}){u.path or '/'}{'?' + u.query if u.query else ''}".lower()


def default_time() -> Column:
    """A capture time for tables that have none: a second for each page_id from the start of 2024, within a year."""
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_622_400))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def with_first(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html, date) with payload_digest, size, and `first`: the smallest page_id of an equal
    payload of `least` bytes or more, null where the row is itself that page or its payload is smaller."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.withColumns({"payload_digest": F.sha2(html, 256), "size": F.octet_length(html).cast("long"), "__salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
    keys = rows.where(F.col("size") >= least).groupBy("payload_digest", "__salt").agg(F.min("page_id").alias("m"), F.count("*").alias("n"))
    firsts = keys.groupBy("payload_digest").agg(F.min("m").alias("first"), F.sum("n").alias("n"), F.collect_set("__salt").alias("salts")).where("n > 1")
    firsts = firsts.select("payload_digest", "first", F.explode("salts").alias("__salt"))
    joined = rows.join(firsts, ["payload_digest", "__salt"], "left")
    return joined.withColumn("first", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("__salt")


def record(page_id: int | None, url: str | None, date: str, digest: str, size: int, payload: bytes, first: int | None) -> bytes:
    """One record, uncompressed. A revisit has the HTTP header of its payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "!#$&'()*+,/:;=?@[]~%-._"


def write_archives(pages: DataFrame, folder: str | None = None, date: Column | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record, a gzip member of its own, for each row of pages(page_id, url, html): manifest (path, records).

    Null html is an empty payload; a null URL leaves the target out; of rows that share payload and smallest
    page_id each is a response. Archives get new names in each attempt, and the manifest names those of the
    attempt that counted, so a task may run again at any time.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    scheme = folder.split("://", 1)[0]
    rows = with_first(pages.select("page_id", "url", "html", (default_time() if date is None else date).alias("date")))
    rows = rows.select("page_id", "url", "date", "payload_digest", "size", F.when(F.col("first").isNull(), F.col("html")).alias("html"), "first")

    def run(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        sink, name, size, n, done = None, "", 0, 0, []
        for b in slices(batches, 256):
            for page, url, date_, digest, length, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sink is None:
                    name, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = fs.open_output_stream(name, compression=None)
                z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                member = z.compress(record(page, url, date_, digest, length, (html or "").encode(), first)) + z.flush()
                sink.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    sink.close()
                    done.append((f"{scheme}://{name}", n))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((f"{scheme}://{name}", n))
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return written(rows.mapInArrow(run, "path string, records long"), "warc-manifest")


def members(f) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, content) of the gzip members of an open file, each in memory by itself."""
    at, rest = 0, b""
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not rest:
                rest = f.read(_CHUNK)
                if not rest:
                    if used:
                        raise ValueError("the archive is cut short")
                    return
            parts.append(z.decompress(rest))
            used += len(rest) - len(z.unused_data)
            rest = z.unused_data
        yield at, used, b"".join(parts)
        at += used


def parse(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields by lower-case name, HTTP header and payload of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _page(urn: str | None) -> int | None:
    n = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(n) if n else None


def capture(path: str, offset: int, size: int, content: bytes) -> list:
    """A row of RUN but for its first two, from a record; a response's payload is checked against its digest."""
    fields, http, payload = parse(content)
    length = next(int(x.partition(b": ")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload at {offset} of {path} differs from its digest")
    url = fields.get("warc-target-uri")
    stamp = "".join(c for c in fields["warc-date"] if c.isdigit())
    return [url_key(url or ""), stamp, _page(fields["warc-record-id"]), url, length, digest, kind, _page(fields.get("warc-refers-to")), path, offset, size]


def _order(r: list) -> tuple:
    return r[0], r[1], r[2] is not None, r[2] or 0, r[8], r[9]


def read_runs(manifest: DataFrame) -> DataFrame:
    """The captures of a manifest's archives, those of each archive a sorted run; see RUN. A task reads one archive."""
    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count())

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_stream(name, compression=None) as f:
                    rows = sorted((capture(path, *m) for m in members(f)), key=_order)
                for at in range(0, len(rows), _BATCH):
                    part = [[path, at + i, *r] for i, r in enumerate(rows[at : at + _BATCH])]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _RUN_TYPES, strict=True)], names=_RUN_NAMES)

    return manifest.select("path").repartition(n, "path").mapInArrow(run, RUN)


def loser_tree(runs: list[Iterable[list]], key) -> Iterator[list]:
    """All rows of sorted runs in order: a tournament whose inner nodes keep the losers, one path replayed a row. Of each
    run one row is held."""
    k = len(runs)
    if not k:
        return
    done = (1,)
    rests = [iter(r) for r in runs]
    rows = [next(r, None) for r in rests]
    heads = [(0, key(r), i) if r is not None else done for i, r in enumerate(rows)]
    tree, winner = [-1] * k, -1
    for leaf in range(k):
        node, w = (leaf + k) // 2, leaf
        while node and w >= 0:
            if tree[node] < 0:
                tree[node], w = w, -1
            elif heads[tree[node]] < heads[w]:
                tree[node], w = w, tree[node]
            node //= 2
        if w >= 0:
            winner = w
    while heads[winner] != done:
        w = winner
        yield rows[w]
        rows[w] = next(rests[w], None)
        heads[w] = (0, key(rows[w]), w) if rows[w] is not None else done
        node = (w + k) // 2
        while node:
            if heads[tree[node]] < heads[w]:
                tree[node], w = w, tree[node]
            node //= 2
        winner = w


def _frames(rows: Iterable[list], types: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, _BATCH)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)


class Merger:
    """External merge of runs that come one after the other, in rows of RUN: what is held at MERGE_ROWS is merged into a
    file, itself a run; merged() gives all rows in order, but for their first two fields."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most
        self.fs, self.base = filesystem(folder)
        self.held: dict[str, list[list]] = {}
        self.n, self.files = 0, []

    def add(self, run: str, row: list) -> None:
        self.held.setdefault(run, []).append(row)
        self.n += 1
        if self.n >= self.most:
            self.spill()

    def spill(self) -> None:
        self.fs.create_dir(self.base, recursive=True)
        name = f"{self.base}/{uuid.uuid4().hex}.arrow"
        types, names = _RUN_TYPES[2:], _RUN_NAMES[2:]
        with self.fs.open_output_stream(name) as f, pa.ipc.new_stream(f, pa.schema(list(zip(names, types, strict=True)))) as out:
            for b in _frames(loser_tree(list(self.held.values()), _order), types, names):
                out.write_batch(b)
        self.files.append(name)
        self.held, self.n = {}, 0

    def _read(self, name: str) -> Iterator[list]:
        with self.fs.open_input_stream(name) as f:
            for b in pa.ipc.open_stream(f):
                yield from map(list, zip(*(c.to_pylist() for c in b.columns), strict=True))

    def merged(self) -> Iterator[list]:
        yield from loser_tree([*map(self._read, self.files), *self.held.values()], _order)
        for name in self.files:
            self.fs.delete_file(name)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures of written, sorted runs as one globally ordered history; see INDEX. `history` is the number of the
    range a row is in and `place` its place there: by them the order is read after any write or shuffle.

    Null URLs come first, null page_ids before others; captures that agree in key, time and page_id go by archive and
    offset, and repeated ones all stay. No runs give no rows.
    """
    spark = runs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    keys = ["urlkey", "timestamp", "page_id", "path", "offset"]
    folder, most = shared_path(spark, "warc-merges"), MERGE_ROWS

    def run(batches):
        merger, history = Merger(folder, most), 0
        for b in batches:
            for *r, history in zip(*(c.to_pylist() for c in b.columns), strict=True):
                merger.add(r[0], r[2:])
        rows = ([*r, history, place] for place, r in enumerate(merger.merged()))
        yield from _frames(rows, _INDEX_TYPES, _INDEX_NAMES)

    ranges = runs.repartitionByRange(n, *keys).sortWithinPartitions("run", "seq").withColumn("history", F.spark_partition_id())
    return ranges.mapInArrow(run, INDEX)


def index(manifest: DataFrame) -> DataFrame:
    """The merged index of a manifest's archives, a row for each record, whatever its URL, page_id or payload."""
    return merge_runs(written(read_runs(manifest), "warc-runs"))
