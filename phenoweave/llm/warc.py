"""WARC archives, and a capture index merged from locally sorted runs.

Records are written by Spark's text sink with gzip: a record is one value and its
closing blank lines are the line separator, so the unpacked files are plain WARC.
Archives are read back whole, one bounded file at a time, and parsed by
Content-Length; offsets are those of the unpacked archive. Each
archive yields a run of captures sorted by URL key and time. The runs are cut at
common key bounds, and every key range is merged from its slices by a loser tree
into a globally ordered index. Runs and index are tables in the shared folder.

Defined cases: a null payload is empty; a null URL has the empty URL key and no
target header; null ids are written as ``null`` and come last among equal
payloads; equal ids of one payload are all responses; an empty table gives an
empty index; line breaks in URLs are percent-encoded; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoweave.session import checkpoint_folder, durable

SALTS = 32  # parts of a group of equal payloads
LEAST_REVISIT = 1000  # bytes
ARCHIVE_BYTES = 8 << 20
CAPTURES_PER_RANGE = 50_000
CAPTURE = (
    "urlkey string, timestamp string, capture_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, archive string, offset long, length long"
)
HEADER = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")


def with_revisits(pages: DataFrame, key: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` as (id, url, time, payload, size, digest, refers_to): null for responses."""
    hashed = pages.withColumn("size", F.octet_length(payload).cast("long")).withColumn("digest", F.sha1(F.encode(payload, "UTF-8")))
    repeated = (
        hashed.filter(F.col("size") >= least).groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(key).alias("first_id")).filter("n > 1")
        .select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    # Equal payloads spread over the salts by their id.
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    joined = salted.join(repeated, ["digest", "salt"], "left").drop("salt")
    revisit = F.col("first_id").isNotNull() & ~F.col(key).eqNullSafe(F.col("first_id"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id")


def url_key(url):
    """Sortable key: host labels reversed, then path and query; lower case, without scheme, ``www.`` and fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "#.*$", ""), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?:]*)", 1), r"^www\d*\.", "")
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[^/?:]*(?::\d+)?", ""), r"(?<=.)/$", "")
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest)))


def records(revisited: DataFrame, key: str, url: str, time: str, payload: str) -> DataFrame:
    """One ``value`` per WARC record, without the closing blank lines."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    stamp = F.date_format(F.coalesce(F.col(time), F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    target = F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")
    )
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col(payload)))
    line = lambda header, value: F.concat(F.lit(header + ": "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col(key))),
        line("WARC-Date", stamp),
        F.when(target.isNull(), F.lit("")).otherwise(line("WARC-Target-URI", target)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return revisited.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", time: str = "time", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` into archives under ``path``.

    A task begins a new archive after as many records as make ``archive_bytes`` on
    average.
    """
    plain = pages.select(F.col(key).cast("long").alias(key), F.col(url).cast("string").alias(url), F.col(time).alias(time), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias(payload))
    mean = plain.agg(F.avg(F.octet_length(payload) + 600)).head()[0] or archive_bytes
    made = records(with_revisits(plain, key, payload), key, url, time, payload)
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, int(archive_bytes / mean))).text(path)


def parse_archive(data: memoryview) -> Iterator[tuple[dict, int, int, memoryview]]:
    """(headers, offset, length, content) of each record; the archive must be complete."""
    at, end = 0, len(data)
    while at < end:
        step = 4096
        while (stop := bytes(data[at : at + step]).find(b"\r\n\r\n")) < 0:
            if at + step >= end:
                raise ValueError(f"no header at {at}")
            step *= 4
        head = bytes(data[at : at + stop + 2])
        if not head.startswith(b"WARC/1."):
            raise ValueError(f"no record at {at}")
        headers = {k.decode().lower(): v.decode() for k, v in HEADER.findall(head)}
        begin = at + stop + 4
        after = begin + int(headers["content-length"])
        if bytes(data[after : after + 4]) != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end at {after}")
        yield headers, at, after + 4 - at, data[begin:after]
        at = after + 4


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives; those of one archive are a run sorted by URL key, time and id.

    Full payloads are hashed again and must match their headers.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    fields = "run string, place long, id_text string, url string, timestamp string, payload_bytes long, payload_digest string, record_type string, refers_text string, offset long, length long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda s: s[len("<urn:page:") : -1]
        names = [f.split(" ")[0] for f in fields.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, run = [], path.as_py().rsplit("/", 1)[-1]
                for headers, offset, length, block in parse_archive(memoryview(gzip.decompress(content.as_buffer()))):
                    cut = bytes(block[:4096]).find(b"\r\n\r\n") + 4
                    declared = int(re.search(rb"Content-Length: (\d+)", bytes(block[:cut]))[1])
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                    if kind == "response" and (hashlib.sha1(block[cut:]).hexdigest() != digest or len(block) - cut != declared):
                        raise ValueError(f"{run}: payload at {offset} differs from its header")
                    rows.append((run, len(rows), name(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-date"], declared, digest, kind, name(headers["warc-refers-to"]) if kind == "revisit" else None, offset, length))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("place", "payload_bytes", "offset", "length") else pa.string()) for c, n in zip(zip(*rows) if rows else [[]] * len(names), names)], names)

    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long")
    return files.mapInArrow(parse, fields).select(
        url_key(F.col("url")).alias("urlkey"), "timestamp", number("id_text").alias("capture_id"), "url", "payload_bytes", "payload_digest",
        "record_type", number("refers_text").alias("refers_to"), F.col("run").alias("archive"), "offset", "length",
    )


class LoserTree:
    """Merge of sorted runs: each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.losers = [-1] * self.k

    def _head(self, run: int):
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, run: int) -> int:
        """Matches from the leaf of ``run`` to the root; the overall winner."""
        node = (run + self.k) // 2
        while node >= 1:
            other = self.losers[node]
            if other < 0:  # while the tree is being built, the first comer waits
                self.losers[node] = run
                return -1
            if self._beats(other, run):
                self.losers[node], run = run, other
            node //= 2
        return run

    def __iter__(self) -> Iterator:
        winner = -1
        for run in range(self.k):
            last = self._play(run) if self.k > 1 else run
            winner = last if last >= 0 else winner
        while winner >= 0 and self._head(winner) is not None:
            yield self._head(winner)
            self.at[winner] += 1
            winner = self._play(winner) if self.k > 1 else winner


def merge_runs(captures: DataFrame, per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """The captures in global order of (urlkey, timestamp, capture_id), merged from their runs.

    ``captures`` come as written runs (sorted within each archive). A range holds
    about ``per_range`` captures; the id parts a URL key with very many captures.
    """
    ranges = max(1, math.ceil(captures.count() / per_range))
    order = [F.col("urlkey"), F.col("timestamp"), F.col("capture_id"), F.col("archive"), F.col("offset")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        column = {n: table.column(n).to_pylist() for n in ("urlkey", "timestamp", "capture_id", "archive", "offset", "place")}
        runs: dict[str, list] = {}
        low = -(1 << 63)
        for i, run in enumerate(column["archive"]):
            number = column["capture_id"][i]
            runs.setdefault(run, []).append((column["place"][i], (column["urlkey"][i], column["timestamp"][i], low if number is None else number, run, column["offset"][i], i)))
        slices = []
        for run in sorted(runs):
            runs[run].sort()  # the run's own order, as written
            slices.append([key for _, key in runs[run]])
        chosen = pa.array([key[-1] for key in LoserTree(slices)], pa.int64())
        yield from table.drop_columns(["place"]).take(chosen).to_batches(max_chunksize=10_000)

    schema = captures.drop("place").schema
    return captures.repartitionByRange(ranges, *order).mapInArrow(merge, schema)


def sorted_runs(captures: DataFrame) -> DataFrame:
    """Each archive's captures in order, with their place; an archive stays in one task."""
    keys = ["archive", "urlkey", "timestamp", "capture_id", "offset"]
    # binaryFile tasks hold whole archives, so sorting within tasks sorts each run.
    return captures.sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())


def capture_index(pages: DataFrame, key: str = "page_id", url: str = "url", time: str = "time", payload: str = "html") -> DataFrame:
    """Write ``pages`` as archives, read them back and merge their index."""
    spark = pages.sparkSession
    import uuid

    path = f"{checkpoint_folder(spark).rstrip('/')}/phenoweave/archives-{uuid.uuid4().hex}"
    write_archives(pages, path, key, url, time, payload)
    runs = durable(sorted_runs(read_runs(spark, path)), "capture-runs")
    return durable(merge_runs(runs), "capture-index")
