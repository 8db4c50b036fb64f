"""WARC archives with deduplicated payloads and a merged capture index.

Writing: of the captures with equal payloads (from ``minimum`` bytes on) the one
with the largest id becomes a response record, the others revisit records that
refer to it. Each task writes its records, one gzip member each, to an archive
of its own in the shared folder.

Reading: each task reads whole archives back, record by record by their stated
lengths, checks the digest of each payload it finds, and emits its captures as
runs sorted by URL key, timestamp and id, cut into blocks that each bear their
first key. The runs are dealt by key range, and each range reads its blocks in
the order of their first keys: what lies below the next block's first key can be
merged and given out before that block is read, so a merge holds at most one
block of each run beside what it is about to give out. Slices of the runs meet
in a loser tree, and the ranges in turn form one globally ordered history.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import attach, cut, shared_dir, ship, width

VERSION = b"WARC/1.1"
#: Runs are cut at so many captures, which bounds what one sort holds.
RUN_ROWS = 100_000
#: A merge holds about so many captures: as much again as are left over, and blocks are so short that one of each run stays within it.
MERGE_ROWS = 50_000
#: A capture without a date is dated by its id, in seconds after this.
EPOCH = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """The URL in sort-friendly form: host labels reversed, then path and query, lower-cased, no scheme or port."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")).lower()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(kind: str, record_id: str, uri: str, date: str, payload: bytes, headers: Iterable[tuple[str, str]] = ()) -> bytes:
    """One record: headers, an empty line, the block and two line ends."""
    lines = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + record_id.encode() + b">", b"WARC-Date: " + date.encode()]
    clean = uri.replace("\r", "%0D").replace("\n", "%0A")
    lines.append(b"WARC-Target-URI: " + clean.encode("utf-8"))
    lines.extend(f"{k}: {v}".encode() for k, v in headers)
    lines.append(b"Content-Length: %d" % len(payload))
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_records(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, compressed length, headers and block of each gzip member of a stream."""
    held, at = b"", 0
    while True:
        unpacker, out, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not held:
                held = stream.read(1 << 20)
                if not held:
                    if used:
                        raise ValueError("the archive ends within a record")
                    return
            out.append(unpacker.decompress(held))
            used += len(held) - len(unpacker.unused_data)
            held = unpacker.unused_data
        data = b"".join(out)
        head, _, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.decode().lower(): v.decode("utf-8") for k, v in (line.split(b": ", 1) for line in lines)}
        length = int(headers["content-length"])
        if rest[length:] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is not as long as it says")
        yield at, used, headers, rest[:length]
        at += used


class LoserTree:
    """Merges sorted runs: each step replays one path from a leaf to the root."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(len(runs), 1)
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        self.winner = -1
        for leaf in range(self.k):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        node, best = (leaf + self.k) // 2, leaf
        while node > 0:
            other = self.losers[node]
            if other == -1:
                self.losers[node] = best
                return
            if self._before(other, best):
                self.losers[node], best = best, other
            node //= 2
        self.winner = best

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._replay(self.winner)


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme: one without is on the default file system, which need not be a worker's own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    named = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + named[5:] if named.startswith("file:/") and not named.startswith("file://") else named


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share."""
    return pafs.FileSystem.from_uri(uri)


def deduplicated(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """Pages with record_type and refers_to: the largest id of each payload is its response.

    A third of all rows may share a payload. The groups are found by partial
    aggregation, and ``attach`` keeps the heavy ones out of the shuffled join.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("_row"),
        F.sha2(payload, 256).alias("_same"),
    )
    groups = rows.groupBy("_same").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("page_id", "_row")).alias("_top")).where("_n > 1")
    marked = attach(rows, cut(groups), "_same", "_n")
    top = F.col("_top")
    revisit = top.isNotNull() & (top["_row"] != F.col("_row")) & (F.octet_length("html") >= minimum)
    return marked.select(
        "page_id", "url", "html", "_row",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, top["page_id"]).alias("refers_to"),
        F.when(revisit, top["_row"]).alias("_refers_row"),
    )


def write_archives(pages: DataFrame, folder: str, records_per_archive: int = 20_000) -> DataFrame:
    """Write the pages' records; one row per archive: path and records.

    Archives are named per attempt, and only those of finished tasks are
    listed, so a lost executor or a second attempt leaves no record twice.
    """
    start = datetime.datetime.fromisoformat(EPOCH.replace("Z", "+00:00"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        out, path, n = None, "", 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    path = posixpath.join(root, f"capture-{uuid.uuid4().hex}.warc.gz")
                    out, n = files.open_output_stream(path, compression=None), 0
                page_id, url, html, row, kind, refers, refers_row = (batch.column(c)[i].as_py() for c in range(7))
                payload = html.encode("utf-8", "surrogatepass")
                date = (start + datetime.timedelta(seconds=(page_id or 0) % 2**32)).strftime("%Y-%m-%dT%H:%M:%SZ")
                more = [("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("X-Payload-Bytes", str(len(payload)))]
                more += [("X-Page-ID", str(page_id))] if page_id is not None else []
                if kind == "revisit":
                    more += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_row}:{'' if refers is None else refers}>")]
                out.write(_member(record(kind, f"urn:page:{row}:{'' if page_id is None else page_id}", url, date, b"" if kind == "revisit" else payload, more)))
                n += 1
                if n >= records_per_archive:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return cut(pages.mapInArrow(write, "path string, records bigint"))


CAPTURE = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, url_key string, captured string, archive string, position bigint, stored bigint"
CAPTURE_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    + [(c, pa.string()) for c in ("url", "url_key", "captured", "archive")]
    + [("position", pa.int64()), ("stored", pa.int64())]
)
#: The order of captures: URL key, timestamp, id, then place in the archives.
ORDER = ("url_key", "captured", "page_id", "archive", "position")


LEAD = "lead struct<url_key:string,captured:string,page_id:bigint,archive:string,position:bigint>"
LEAD_TYPE = pa.struct([(c, CAPTURE_SCHEMA.field(c).type) for c in ORDER])


def _order_key(row: dict) -> tuple:
    return (row["url_key"], row["captured"], -(2**63) if row["page_id"] is None else row["page_id"], row["archive"], row["position"])


def read_runs(archives: DataFrame, folder: str, run_rows: int = RUN_ROWS, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """Captures of the archives as locally sorted runs: the capture columns, run, step and lead, the first key of the row's block.

    Blocks are the shorter the more runs there will be; how many follows from
    the archives' record counts.
    """
    records = archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    block_rows = max(1, merge_rows // max(1, records // run_rows + archives.rdd.getNumPartitions()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(folder)
        held: list[dict] = []

        def run() -> Iterator[pa.RecordBatch]:
            held.sort(key=_order_key)
            name = uuid.uuid4().hex
            for at in range(0, len(held), 5000):
                part = held[at : at + 5000]
                leads = [held[i - i % block_rows] for i in range(at, at + len(part))]
                batch = pa.RecordBatch.from_pylist(part, schema=CAPTURE_SCHEMA)
                more = [pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array([{c: row[c] for c in ORDER} for row in leads], LEAD_TYPE)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "run", "step", "lead"])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for position, stored, head, block in read_records(stream):
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        kind = head["warc-type"]
                        if kind == "response" and (digest32(block) != digest or len(block) != int(head["x-payload-bytes"])):
                            raise ValueError(f"{path} at {position}: the payload does not match its digest")
                        refers = head.get("warc-refers-to", "<::>").strip("<>").rpartition(":")[2]
                        held.append({
                            "page_id": int(head["x-page-id"]) if "x-page-id" in head else None, "payload_bytes": int(head["x-payload-bytes"]), "payload_digest": digest,
                            "record_type": kind, "refers_to": int(refers) if refers else None, "url": head["warc-target-uri"], "url_key": url_key(head["warc-target-uri"]),
                            "captured": head["warc-date"], "archive": posixpath.basename(path), "position": position, "stored": stored,
                        })
                        if len(held) >= run_rows:
                            yield from run()
                            held = []
        if held:
            yield from run()

    return archives.mapInArrow(read, f"{CAPTURE}, run string, step bigint, {LEAD}")


def _keys(rows: pa.Table | pa.RecordBatch | pa.StructArray) -> list[tuple]:
    columns = [(rows.field(c) if isinstance(rows, pa.StructArray) else rows.column(c)).to_pylist() for c in ORDER]
    return [(a, b, -(2**63) if c is None else c, d, e) for a, b, c, d, e in zip(*columns, strict=True)]


def merged(batches: Iterable[pa.RecordBatch], merge_rows: int = MERGE_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows of runs, whose blocks come in the order of their first keys, in the order of their own.

    What lies below the next block's first key is merged by a loser tree and
    given out whenever ``merge_rows`` more rows are held than were left over.
    """
    held: list[pa.RecordBatch] = []
    n = left = 0

    def give(below: tuple | None) -> Iterator[pa.RecordBatch]:
        nonlocal held, n, left
        table = pa.Table.from_batches(held)
        keys, slices = _keys(table), {}
        for at, run in enumerate(table.column("run").to_pylist()):
            if below is None or keys[at] < below:
                slices.setdefault(run, []).append((keys[at], at))
        order = [at for _, at in LoserTree(list(slices.values()))]
        yield from table.take(pa.array(order, pa.int64())).drop_columns(["run", "step", "lead"]).combine_chunks().to_batches(max_chunksize=5000)
        if below is not None:
            rest = [at for at, key in enumerate(keys) if key >= below]
            held = table.take(pa.array(rest, pa.int64())).combine_chunks().to_batches()
            n = left = len(rest)

    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= left + merge_rows:
            yield from give(_keys(batch.column("lead").slice(0, 1))[0])
        held.append(batch)
        n += batch.num_rows
    if n:
        yield from give(None)


def merge_runs(runs: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """One history out of the runs: rows in the order of ORDER, over partitions in turn."""
    keys: list[Column] = [F.col(c).asc_nulls_first() for c in ORDER]
    leads: list[Column] = [F.col(f"lead.{c}").asc_nulls_first() for c in ORDER]
    dealt = runs.repartitionByRange(max(width(runs.sparkSession), 1), *keys).sortWithinPartitions(*leads, "run", "step")
    return dealt.mapInArrow(lambda batches: merged(batches, merge_rows), CAPTURE)


def archive_pages(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """Write all pages to archives, read them back and return the merged capture history.

    A null html is an empty payload and a null url an empty one; a page without
    id is dated by the epoch and ranks below all others. Of repeated rows one is
    the response. An empty table gives an empty history. Only the archives'
    names are gathered, as a table; payloads stay in the shared folder. The
    pages must be a stable scan, such as a written table.
    """
    ship(pages.sparkSession)
    folder = _qualified(pages.sparkSession, shared_dir(pages.sparkSession))
    archives = write_archives(deduplicated(pages, minimum), folder)
    return merge_runs(cut(read_runs(archives, folder)))
