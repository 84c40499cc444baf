"""Web archives: pages written as WARC records, read back, and their captures merged into one ordered index.

Archives are written by Spark's text writer with the records' own terminator (CR LF CR LF) as the line
separator, so that any file system Spark knows will do and a lost executor's files are written again by the commit
protocol. Each archive gives one locally sorted run of captures; the runs are dealt by ranges of (URL key, time, page)
and in each range a loser tree merges what the runs hold of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import parts_for, stored

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Shorter payloads are always stored.
LEAST_REVISIT = 100
#: (payload bytes below which, records in one archive at most): a reader holds one archive, 160 MB of payload or 16 large ones.
ARCHIVES = ((1 << 14, 10_000), (1 << 18, 640), (None, 16))
#: Captures in one range of the merged index, about: bounds what one merge holds.
RANGE = 250_000


def url_key(url: Column) -> Column:
    """Sort-friendly form: reversed lower-case host, then path and query; no scheme, port or fragment. Null stays null."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r"^.*@|:[0-9]*$", "")
    host = F.regexp_replace(F.lower(host), r"^www[0-9]*\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.lower(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)))


def archived(pages: DataFrame, path: str, scratch: str, page_id: str = "page_id", url: str = "url", payload: str = "html", captured_at: str | None = None) -> None:
    """Write one WARC record for each row of `pages` below `path`.

    The payload is the text in UTF-8 (null: empty). Of records with equal payloads of at least `LEAST_REVISIT` bytes,
    those with the smallest page id are responses (repeated rows of that page all are); the others are revisits
    without payload. A null page id never is the smallest and its record a response. Without `captured_at`, a
    page's capture time is its id in seconds after 2024-01-01. Columns of other names are left out. An empty table
    gives no records.
    """
    at = F.col(captured_at) if captured_at else F.timestamp_seconds(F.coalesce(F.col(page_id), F.lit(0)) + 1704067200)
    rows = pages.select(
        F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"), at.alias("at")
    ).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    # Only digests that occur more than once go to the join, by way of the shared folder: both of its sides then have an
    # exchange of their own, and Spark can split a digest that very many pages share.
    first = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").select(F.col("digest").alias("first_digest"), "first"), f"{scratch}/first")
    rows = rows.join(first, F.col("digest") == F.col("first_digest"), "left")
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    named = F.coalesce(F.col("id").cast("string"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    safe = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), named, F.lit(f">{CRLF}WARC-Date: "), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.when(safe.isNotNull(), F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), safe)).otherwise(F.lit("")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    )
    least = 0
    for below, records in ARCHIVES:
        some = rows.where((F.col("size") >= least) & (F.col("size") < below if below else F.lit(True)))
        some.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records).text(f"{path}/from-{least}")
        least = below


def _records(content: memoryview) -> Iterator[tuple]:
    """(offset, length, headers, HTTP header, payload) of each record, found by the lengths that it states."""
    whole, at = bytes(content), 0
    while at < len(whole):
        head = whole.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in whole[at:head].decode().split(CRLF)[1:])
        start = head + 4
        end = start + int(fields["Content-Length"])
        split = whole.index(b"\r\n\r\n", start, end) + 4
        yield at, end + 4 - at, fields, whole[start:split], whole[split:end]
        at = end + 4


CAPTURE = "run string, offset bigint, length bigint, record_type string, page_id bigint, refers_to bigint, url string, captured_at string, payload_digest string, payload_bytes bigint"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives below `path`, columns `CAPTURE`, with `payloads` also payload (binary).

    A response's digest and size are taken from the bytes read and must be those stated; a revisit's are stated,
    the size in the HTTP header that it keeps. A record that contradicts itself raises an error.
    """

    def number(text: str) -> int | None:
        return int(x) if (x := text.removeprefix("<urn:page:").removesuffix(">")) else None

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CAPTURE.split(", ")] + ["payload"] * payloads
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, length, fields, http, payload in _records(content.as_buffer()):
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(http.decode().rpartition("Content-Length: ")[2])
                    again = fields["WARC-Type"] == "revisit"
                    if not again and (hashlib.sha256(payload).hexdigest() != stated or len(payload) != size):
                        raise ValueError(f"{name}: the record at byte {at} isn't what its header says")
                    refers = number(fields["WARC-Refers-To"]) if again else None
                    rows.append((name, at, length, fields["WARC-Type"], number(fields["WARC-Record-ID"]), refers, fields.get("WARC-Target-URI"), fields["WARC-Date"], stated, size, payload)[: len(names)])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(work, CAPTURE + ", payload binary" * payloads)


class LoserTree:
    """Merges k sorted runs: each inner node keeps the loser of its match, so that a new key replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self.tree[node] < 0:  # the first to come waits for its opponent
                self.tree[node] = winner
                return
            if not self._wins(winner, self.tree[node]):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def merged_index(captures: DataFrame, scratch: str) -> DataFrame:
    """All captures in order of (url_key, captured_at, page_id), partition after partition.

    The sorted run of each archive is written to the shared folder. There are as many ranges as keep each near `RANGE`
    captures; a boundary is a whole key with the record's own place, which no two captures share, so that very common URLs
    and repeated captures spread over as many ranges as they need. A shuffle doesn't keep the order of what it moves: what a
    range has of each run is put in order by Spark (which spills), then the runs are merged by a loser tree. Null URLs have
    the empty key.
    """
    runs = captures.withColumn("url_key", F.coalesce(url_key(F.col("url")), F.lit("")))
    runs = runs.sortWithinPartitions("run", "url_key", "captured_at", "page_id")
    runs = stored(runs, f"{scratch}/runs")
    order = ["url_key", "captured_at", "page_id"]
    dealt = runs.repartitionByRange(parts_for(runs.count(), RANGE), *order, "run", "offset").sortWithinPartitions("run", *order)
    names = dealt.columns
    run_at, at = names.index("run"), [names.index(c) for c in order]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[tuple]] = []
        held, last = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in at), strict=True))
            for row, (name, key) in enumerate(zip(batch.column(run_at).to_pylist(), keys, strict=True)):
                if name != last:
                    runs.append([])
                    last = name
                runs[-1].append((key[0], key[1], -1 if key[2] is None else key[2], len(held), row))
            held.append(batch)
        if held:
            whole = pa.Table.from_batches(held)
            starts = [0]
            for batch in held:
                starts.append(starts[-1] + batch.num_rows)
            order = [starts[b] + row for _, _, _, b, row in LoserTree([iter(r) for r in runs])]
            yield from whole.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(work, dealt.schema)


def capture_histories(pages: DataFrame, scratch: str, **columns) -> DataFrame:
    """`pages` archived, read back and merged: a row for each record with its place, type and url_key."""
    archived(pages, f"{scratch}/archives", scratch, **columns)
    return merged_index(read_archives(pages.sparkSession, f"{scratch}/archives"), scratch)
