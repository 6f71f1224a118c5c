"""Web archives: pages as WARC records, and their index merged from locally sorted runs by a loser tree."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from bisect import bisect_left
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import number_rows, spread_of
from ..sources.staging import shared_dir, stage
from .common import read_table

# Fixed values of the WARC/1.1 format and of base32.
_VERSION = "WARC/1.1"
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Captures of a run that travel together.
BLOCK = 512
#: Keys a range looked at to place the boundaries of the ranges.
_SAMPLES = 256

CAPTURE = (
    "url_key string, captured string, record_id string, target string, page_id string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to string, file string, offset long, length long"
)
_FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary or text column in upper-case base32, in the JVM: five bytes give eight digits."""
    parts = [
        F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _record_id(*key) -> Column:
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in key])
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """One header line; nothing where the value is NULL. White space in the value is percent-encoded."""
    safe = value.cast("string")
    for raw, coded in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        safe = F.replace(safe, F.lit(raw), F.lit(coded))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
    date: Column | None = None, least: int = 0, archive_bytes: int = 32 << 20,
) -> None:
    """Write a WARC record per row as gzipped archives of about ``archive_bytes`` (uncompressed; more where records are uneven).

    The payload is the text in UTF-8 (NULL: empty). Of records with equal payloads of ``least`` bytes or more, the one
    with the largest page_id is a response and the others revisit it (NULL ids are the smallest; then the larger url and
    date; of rows equal in all of these any one). Shorter payloads are always responses. NULL ids and urls have no header line. The
    records are built in the JVM and written by Spark's text writer, whose commit protocol makes a lost task harmless;
    a group of equal payloads of any size is one row of a small table that meets the pages in a join, which Spark can split.
    An empty table leaves archives without records; other columns are not written.
    """
    spark = pages.sparkSession
    at = F.date_format(date if date is not None else F.timestamp_seconds(F.lit(0)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    keyed = pages.select(
        F.col(f"`{page_id}`").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(at, F.lit("1970-01-01T00:00:00Z")).alias("at"),
        base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size"), body.alias("body"),
    )
    own = ["page", "url", "at"]
    counted = stage(keyed.groupBy("digest", "size", *own).agg(F.count("*").alias("copies")), "captures")
    rows, held = counted.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0))).first()
    per_file = max(1, int(archive_bytes // (held / max(rows, 1) + 512)))
    groups = stage(
        counted.where(F.col("size") >= least).groupBy("digest", "size")
        .agg(F.max(F.struct(*own, "copies")).alias("best"), F.sum("copies").alias("n")).where("n > 1").drop("n"), "payloads",
    )
    joined = keyed.join(groups, ["digest", "size"], "left")
    best = F.col("best")
    first = F.lit(True)
    for c in own:
        first = first & F.col(c).eqNullSafe(best[c])
    joined = joined.withColumn("first", best.isNull() | first)
    if groups.where("best.copies > 1").limit(1).count():  # equal rows: all but one revisit
        equal = F.col("first") & best.isNotNull() & (best["copies"] > 1)
        apart = number_rows(joined.where(equal), ["digest", "size"], ["page"]).withColumn("first", F.col("position") == 1)
        joined = joined.where(~F.coalesce(equal, F.lit(False))).withColumn("position", F.lit(1).cast("long")).unionByName(apart.drop("group_rows"))
    else:
        joined = joined.withColumn("position", F.lit(1).cast("long"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _header("Content-Length", F.col("size")), F.lit("\r\n")
    )
    block = F.octet_length(http) + F.when(F.col("first"), F.col("size")).otherwise(0)
    again = F.when(F.col("first"), F.lit("")).otherwise(F.concat(
        _header("WARC-Profile", F.lit(_SAME_PAYLOAD)), _header("WARC-Refers-To", _record_id(best["page"], best["url"], best["at"], F.col("digest"), F.lit(1))),
        _header("WARC-Refers-To-Target-URI", best["url"]), _header("WARC-Refers-To-Date", best["at"]), _header("Refers-To-Page-ID", best["page"]),
    ))
    record = F.concat(
        F.lit(f"{_VERSION}\r\n"), _header("WARC-Type", F.when(F.col("first"), "response").otherwise("revisit")),
        _header("WARC-Record-ID", _record_id(F.col("page"), F.col("url"), F.col("at"), F.col("digest"), F.col("position"))),
        _header("WARC-Target-URI", F.col("url")), _header("WARC-Date", F.col("at")), _header("Page-ID", F.col("page")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), again,
        F.lit("Content-Type: application/http;msgtype=response\r\n"), _header("Content-Length", block), F.lit("\r\n"),
        http, F.when(F.col("first"), F.col("body")).otherwise(""),
    )
    writer = joined.select(record).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", per_file).text(path)


def url_key(url: str | None) -> str:
    """The url in sort-friendly form: host labels from the top down, then port, path and query. NULL gives ''."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    labels = host.removeprefix("www.").split(".")
    usual = {"http": 80, "https": 443}.get(parts.scheme)
    return ",".join(reversed(labels)) + (f":{port}" if port not in (None, usual) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def records(content: bytes, file: str):
    """(capture, payload) of every record of an archive, read front to back; a revisit has no payload.

    Offsets count uncompressed bytes. A payload that does not fit its digest or its length raises: the archive is damaged.
    """
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    offset = 0
    while (line := stream.readline()):
        if not line.strip():
            offset += len(line)
            continue
        if line.strip().decode("latin-1") != _VERSION:
            raise ValueError(f"{file}: no record at {offset}")
        head = _headers(stream)
        block = stream.read(size := int(head["content-length"]))
        if len(block) != size:
            raise ValueError(f"{file}: cut off at {offset}")
        after = stream.tell()
        inner = io.BytesIO(block)
        inner.readline()
        http = _headers(inner)
        payload, kind = block[inner.tell():], head["warc-type"]
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        expected = int(http["content-length"])
        if kind == "response" and (len(payload) != expected or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{file}: damaged payload at {offset}")
        target = head.get("warc-target-uri")
        stamp = head["warc-date"]
        yield (
            url_key(target), stamp, head["warc-record-id"], target, head.get("page-id"), kind, expected, digest,
            head.get("refers-to-page-id"), file, offset, after - offset,
        ), payload if kind == "response" else None
        offset = after


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """All records with their payload (binary; NULL for a revisit), in no order."""
    schema = f"{CAPTURE}, payload binary"
    names = [*_FIELDS, "payload"]

    def read(batches):
        types = _arrow_types() + [pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for capture, payload in records(content.as_py(), file.as_py()):
                    rows.append((*capture, payload))
                    held += len(payload or b"") + 512
                    if held > 8 << 20:
                        yield _columns(rows, names, types)
                        rows, held = [], 0
                if rows:
                    yield _columns(rows, names, types)

    return _archives(spark, path).mapInArrow(read, schema)


def _arrow_types() -> list[pa.DataType]:
    return [pa.int64() if f.endswith("long") else pa.string() for f in CAPTURE.split(", ")]


def _columns(rows, names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures per archive, in blocks of ``BLOCK``: (run, block, captures). Sorted by url key, time and record id."""
    def run(batches):
        types = _arrow_types()
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                name = file.as_py()
                found = sorted((c for c, _ in records(content.as_py(), name)), key=lambda c: c[:3])
                starts = list(range(0, len(found), BLOCK))
                if found:
                    captures = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], _FIELDS)
                    lists = pa.ListArray.from_arrays(pa.array([*starts, len(found)], pa.int32()), captures)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(starts)), pa.array(range(len(starts)), pa.int32()), lists], ["run", "block", "captures"]
                    )

    return _archives(spark, path).mapInArrow(run, f"run string, block int, captures array<struct<{CAPTURE.replace(' ', ':').replace(',:', ',')}>>")


class LoserTree:
    """The least of k keys, again and again: every inner node holds the loser of its match, so a new key for the last
    winner's leaf meets only the losers on its way up. A leaf that has run out has the key ``LAST``."""

    LAST = (1,)

    def __init__(self, keys: list[tuple]):
        self.keys, k = keys, len(keys)
        self.losers = [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if keys[a] <= keys[b] else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def replace(self, key: tuple) -> None:
        """Give the winner's leaf its next key and find the new winner."""
        keys, losers, leaf = self.keys, self.losers, self.winner
        keys[leaf] = key
        node = (leaf + len(keys)) >> 1
        while node:
            rival = losers[node]
            if keys[rival] < key:
                losers[node], leaf, key = leaf, rival, keys[rival]
            node >>= 1
        self.winner = leaf


def merged_blocks(blocks):
    """(block, place) in the order of all keys, from an iterator of (keys, block) that come by their first key; keys are sorted in a block.

    Blocks are taken in only when the least key in the tree reaches the first key of the next one, some at a time, so
    the tree holds what overlaps and not what is still to come.
    """
    blocks = iter(blocks)
    coming = next(blocks, None)
    active: list = []  # (keys, block, next place)
    while coming is not None or active:
        for _ in range(max(8, len(active) // 4)):
            if coming is not None:
                active.append([*coming, 0])
                coming = next(blocks, None)
        tree = LoserTree([keys[place] for keys, _, place in active])
        while (least := tree.keys[tree.winner]) != tree.LAST and (coming is None or least < coming[0][0]):
            run = active[tree.winner]
            keys, block, place = run
            yield block, place
            run[2] = place = place + 1
            tree.replace(keys[place] if place < len(keys) else tree.LAST)
        active = [run for run in active if run[2] < len(run[0])]


def _block_keys(captures: pa.StructArray) -> list[tuple]:
    return [(0, *k) for k in zip(*(captures.field(i).to_pylist() for i in range(3)))]


def capture_histories(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """All captures of ``runs`` in one order: the columns of ``CAPTURE`` with ``position`` (1, 2, … over everything) and ``part``.

    Key space is cut into ``ranges`` (default: the session's shuffle parallelism). Boundaries come from evenly spread keys of
    at most some ``_SAMPLES`` × ranges blocks and decide balance only; they hold url key, time and record id, so a url with a
    third of all captures is cut as well. Blocks are cut at the boundaries, dealt out by range, ordered by first key and
    merged by a loser tree, which keeps only overlapping blocks in memory. Partitions follow one another, so written files are in order.
    Captures equal in the whole key come in any order. No captures give an empty table.
    """
    runs = stage(runs, "runs")
    spark, ranges = runs.sparkSession, ranges or spread_of(runs)
    blocks, total = runs.agg(F.count("*"), F.coalesce(F.sum(F.size("captures")), F.lit(0))).first()
    step = max(1, blocks // (_SAMPLES * ranges))
    some = runs.where(F.pmod(F.xxhash64("run", "block"), F.lit(step)) == 0)
    spots = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.floor(q * F.size("captures") / 4).cast("int"))
    key = lambda c: F.struct(c["url_key"], c["captured"], c["record_id"])
    sample = sorted((0, *r) for r in some.select(F.inline(F.transform(F.array_distinct(spots), lambda i: key(F.get("captures", i))))).collect())
    edges = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    def cut(batches):
        for batch in batches:
            lists = batch.column(2)
            values, ends = lists.values, lists.offsets.to_pylist()
            keys = _block_keys(values)
            starts, parts, names = [], [], []
            for a, b, run in zip(ends, ends[1:], batch.column(0).to_pylist()):
                part = 0
                while a < b:
                    while part < len(edges) and edges[part] <= keys[a]:
                        part += 1
                    stop = bisect_left(keys, edges[part], a, b) if part < len(edges) else b
                    starts.append(a)
                    parts.append(part)
                    names.append(run)
                    a = stop
            if starts:
                first = values.take(pa.array(starts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(parts, pa.int32()), *(first.field(i) for i in range(3)), pa.array(names),
                    pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), values),
                ], ["part", "url_key", "captured", "record_id", "run", "captures"])

    kind = runs.schema["captures"].dataType.simpleString()
    pieces = runs.mapInArrow(cut, f"part int, url_key string, captured string, record_id string, run string, captures {kind}")
    sizes = {r.part: r.n for r in pieces.groupBy("part").agg(F.sum(F.size("captures")).alias("n")).collect()}
    before, held = {}, 0
    for part in range(len(edges) + 1):
        before[part] = held
        held += sizes.get(part, 0)
    names = [*_FIELDS, "part", "position"]

    def merge(batches):
        def rows():
            for batch in batches:
                lists = batch.column(1)
                ends = lists.offsets.to_pylist()
                for part, a, b in zip(batch.column(0).to_pylist(), ends, ends[1:]):
                    own = lists.values.slice(a, b - a)
                    yield part, _block_keys(own), own

        source = rows()
        waiting = next(source, None)
        while waiting is not None:
            part = waiting[0]

            def of_part():
                nonlocal waiting
                while waiting is not None and waiting[0] == part:
                    _, keys, block = waiting
                    waiting = next(source, None)
                    yield keys, block

            at, chosen, held = before[part], [], {}

            def flush():
                order = {k: i for i, k in enumerate(held)}
                firsts = np.cumsum([0, *(len(b) for b in held.values())])
                where = pa.array([int(firsts[order[k]]) + place for k, place in chosen])
                out = pa.concat_arrays(list(held.values())).take(where)
                n = len(chosen)
                return pa.RecordBatch.from_arrays(
                    [*out.flatten(), pa.array([part] * n, pa.int32()), pa.array(np.arange(at + 1, at + n + 1))], names
                )

            for block, place in merged_blocks(of_part()):
                held[id(block)] = block
                chosen.append((id(block), place))
                if len(chosen) == 8192:
                    yield flush()
                    at, chosen, held = at + len(chosen), [], {}
            if chosen:
                yield flush()

    dealt = pieces.repartitionByRange(len(edges) + 1, "part").sortWithinPartitions("part", "url_key", "captured", "record_id", "run")
    return dealt.select("part", "captures").mapInArrow(merge, f"{CAPTURE}, part int, position long")


def op13_archive_index(spark, sf_dir):
    """Every page written as a WARC record and found again through the merged index of the archives.

    The table has no capture times, so each page is dated by its id, one second apart.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path, date=F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0))))
    found = capture_histories(capture_runs(spark, path))
    kind = pages.schema["page_id"].dataType
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )
