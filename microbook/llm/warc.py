"""WARC archives written from pages and read back by their chain of record boundaries.

Reading does not trust the magic string: a payload may hold "WARC/1.1" followed by what looks like a header. Each task scans a
byte range for candidates and emits, for each, the offset of its successor. A record is real exactly if the chain of successors
that begins at offset 0 of its file reaches it. Chains are followed inside a range in the task that scanned it; between ranges
by pointer jumping: after k rounds 2^k ranges are crossed, so a file of any length takes a logarithmic number of joins. The
jumping tables hold only offsets that are some candidate's successor in another range, a few per range. What is not reached is
payload. Ranges are then read again from their verified entries on.
"""

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microbook.llm.files import attempt_name, create_folder, open_input, open_output
from microbook.llm.tables import dealt, new_folder, stored

VERSION = b"WARC/1.1\r\n"
REVISIT_FROM = 100
FILE_BYTES = 1 << 30
RANGE_BYTES = 16 << 20
#: Bytes read at first for a header; a longer one is read on to its end. The name of a field is never longer.
HEADER_BYTES = 1 << 16
_CUT = -2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = re.compile(r"<urn:page:(-?\d+|null)>")


def _uri(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else int(page_id)}>"


def _page_id(uri: str) -> int | None:
    found = _PAGE.fullmatch(uri)
    return int(found[1]) if found and found[1] != "null" else None


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def record(kind: str, page_id, url: str | None, digest: str, payload: bytes, refers_to=None) -> bytes:
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Target-URI: {_clean(url or 'about:blank')}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


class Header(NamedTuple):
    fields: dict[str, str]
    size: int  # bytes before the payload
    payload: int

    @property
    def whole(self) -> int:
        return self.size + self.payload + 4


def header_end(data: bytes, at: int) -> int:
    """Where the blank line after the header at `at` begins; -1 if there is no header, _CUT if `data` ends before that is known."""
    if not data.startswith(VERSION, at):
        return -1
    at += len(VERSION)
    while (stop := data.find(b"\r\n", at)) != at:
        if data.find(b":", at, min(at + HEADER_BYTES, len(data) if stop < 0 else stop)) < 0 and (stop >= 0 or len(data) - at >= HEADER_BYTES):
            return -1
        if stop < 0:
            return _CUT
        at = stop + 2
    return at - 2


def parse_header(data: bytes, at: int) -> Header | None:
    """The header that begins at `at`, or None if there is none."""
    end = header_end(data, at)
    if end < 0:
        return None
    fields = {}
    for line in data[at + len(VERSION) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit() or "warc-type" not in fields:
        return None
    return Header(fields, end + 4 - at, int(length))


def whole_header(data: bytes, at: int, left: int, read: Callable[[int], bytes]) -> Header | None:
    """parse_header, but a header that `data` cuts is read to its end; `left`: bytes of the file from `at` on, `read`: its first n."""
    while len(data) - at < left and header_end(data, at) == _CUT:
        data, at = read(min(left, max(HEADER_BYTES, 2 * (len(data) - at)))), 0
    return parse_header(data, at)


def candidates(data: bytes, base: int, upto: int, size: int | None = None, read: Callable[[int, int], bytes] | None = None) -> dict[int, int]:
    """Offset -> successor of all that looks like a record and begins in [base, upto); `data` begins at `base`.

    A record follows the blank line that ends the one before. So headers of candidates never overlap, and only the last can be cut;
    then the file, of `size` bytes, is read on by read(bytes, offset).
    """
    found, at = {}, data.find(VERSION)
    while 0 <= at < upto - base:
        left = len(data) - at if size is None else size - base - at
        follows = at < 4 or data.startswith(b"\r\n\r\n", at - 4)
        if follows and (header := whole_header(data, at, left, lambda n, at=at: read(n, base + at))):
            found[base + at] = base + at + header.whole
        at = data.find(VERSION, at + 1)
    return found


def exits(found: dict[int, int], upto: int) -> dict[int, int]:
    """Where the chain from each candidate first leaves the range; a chain that breaks inside it ends there."""
    out: dict[int, int] = {}
    for at in sorted(found, reverse=True):
        following = found[at]
        out[at] = out.get(following, -1) if following < upto else following
    return out


def record_plan(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """`pages` (page_id, url, html) with payload, digest, record_type and refers_to.

    Of equal payloads of at least `revisit_from` bytes, the smallest page_id is the response. Digests that occur more than once are
    found first, on narrow rows; only these are joined, so pages without a copy stay where they are if the list is small.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = F.length("payload") >= revisit_from
    groups = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = stored(groups.where("n > 1").select("digest", "first"), "warc-repeated")
    known = rows.join(repeated, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id") > F.col("first"))
    return known.select(
        "page_id",
        "url",
        "digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, folder: str, *, revisit_from: int = REVISIT_FROM, file_bytes: int = FILE_BYTES) -> DataFrame:
    """One record per row of `pages`; returns the stored manifest (path, bytes, records). Each task rolls files at `file_bytes`.

    NULL html is an empty payload, NULL url "about:blank". page_id identifies a record: rows that repeat one are written, and read, each.
    """
    create_folder(folder)

    def written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, out, path, size, n = TaskContext.get().partitionId(), None, "", 0, 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                if out is None:
                    path = attempt_name(folder, task, ".warc")
                    out, size, n = open_output(path), 0, 0
                page_id = None if pd.isna(row.page_id) else row.page_id
                data = record(row.record_type, page_id, row.url, row.digest, bytes(row.payload), None if pd.isna(row.refers_to) else row.refers_to)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})

    planned = record_plan(pages, revisit_from).withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("page_id", "refers_to")})
    return stored(planned.mapInPandas(written, "path string, bytes bigint, records bigint"), "warc-manifest")


def _ranges(manifest: DataFrame, range_bytes: int) -> DataFrame:
    """One row per byte range of each file: path, base, upto, bytes; dealt out evenly."""
    begins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint")))
    rows = manifest.where("bytes > 0").select("path", "bytes", begins.alias("base"))
    rows = rows.withColumn("upto", F.least(F.col("base") + range_bytes, F.col("bytes")))
    return dealt(rows)


def scan(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Candidates of all ranges with the offset at which their chain leaves the range: path, base, at, leaves."""

    def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                file = open_input(row.path)
                data = file.read_at(min(row.upto + HEADER_BYTES, row.bytes) - row.base, row.base)
                out = exits(candidates(data, row.base, row.upto, row.bytes, file.read_at), row.upto)
                yield pd.DataFrame({"path": row.path, "base": row.base, "at": list(out.keys()), "leaves": list(out.values())})

    return _ranges(manifest, range_bytes).mapInPandas(scanned, "path string, base bigint, at bigint, leaves bigint")


def reachable(found: DataFrame, most_ranges: int) -> DataFrame:
    """Entries of ranges on the chain from the start of each file, by pointer jumping: path, at."""
    ends = found.select("path", F.col("leaves").alias("at")).where("at >= 0").distinct()
    start = found.where("at = 0").select("path", "at")
    jumps = stored(found.join(ends.union(start).distinct(), ["path", "at"], "left_semi").select("path", "at", "leaves"), "warc-jumps")
    reached = stored(start, "warc-reached")
    hops = 1
    while hops < most_ranges:
        onward = reached.join(jumps, ["path", "at"]).select("path", F.col("leaves").alias("at"))
        reached = stored(reached.union(onward).distinct(), "warc-reached")
        second = jumps.select("path", F.col("at").alias("leaves"), F.col("leaves").alias("farther"))
        jumps = stored(jumps.join(second, ["path", "leaves"]).select("path", "at", F.col("farther").alias("leaves")), "warc-jumps")
        hops *= 2
    return reached


_RECORD = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, url string, at bigint, path string"


def read_warc(manifest: DataFrame, range_bytes: int = RANGE_BYTES, *, payloads: bool = False) -> DataFrame:
    """The real records: page_id, record_type, refers_to, payload_bytes, payload_digest (of the payload there), url, at, path.

    With `payloads` the payload itself comes too. A file whose chain breaks before its end is an error.
    """
    ranges_of = F.ceil(F.max("bytes") / range_bytes)
    most_ranges = manifest.agg(ranges_of).first()[0] or 0
    found = stored(scan(manifest, range_bytes), "warc-candidates")
    entry = reachable(found, most_ranges).withColumn("base", F.col("at") - F.col("at") % range_bytes)
    entries = entry.groupBy("path", "base").agg(F.min("at").alias("entry"))
    begun = entries.join(manifest, "path").select(
        "path", "entry", F.least(F.col("base") + range_bytes, F.col("bytes")).alias("upto"), "bytes"
    )
    begun = stored(begun, "warc-entries")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                file, at, rows = open_input(row.path), row.entry, []
                data = file.read_at(row.upto - at, at)
                while at < row.upto:
                    if len(data) < HEADER_BYTES and at + len(data) < row.bytes:
                        data = file.read_at(min(HEADER_BYTES, row.bytes - at), at)
                    header = whole_header(data, 0, row.bytes - at, lambda n, at=at: file.read_at(n, at))
                    if header is None or at + header.whole > row.bytes:
                        raise ValueError(f"{row.path} has no whole record at {at}")
                    if len(data) < header.whole:
                        data = file.read_at(header.whole, at)
                    body = data[header.size : header.size + header.payload]
                    of = header.fields
                    rows.append(
                        (_page_id(of.get("warc-record-id", "")), of["warc-type"], _page_id(of.get("warc-refers-to", "")), len(body),
                         hashlib.sha256(body).hexdigest(), of.get("warc-target-uri"), at, row.path, *([body] if payloads else []))
                    )
                    at, data = at + header.whole, data[header.whole :]
                frame_out = pd.DataFrame(rows, columns=names)
                yield frame_out.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = _RECORD + (", payload binary" if payloads else "")
    names = [part.split()[0] for part in schema.split(", ")]
    return dealt(begun).mapInPandas(read, schema)


def resolved(records: DataFrame) -> DataFrame:
    """Records with size and digest of the full payload: a revisit has those of the response that it refers to."""
    full = records.where("record_type = 'response' AND page_id IS NOT NULL").groupBy("page_id").agg(
        F.max(F.struct("payload_bytes", "payload_digest")).alias("full")
    )
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    referred = revisits.join(full.withColumnRenamed("page_id", "refers_to"), "refers_to", "left")
    referred = referred.select(*revisits.columns, "full.payload_bytes", "full.payload_digest")
    return records.where("record_type <> 'revisit'").unionByName(referred)


def check_complete(manifest: DataFrame, records: DataFrame) -> None:
    """An error if a file of the manifest did not give as many records as were written to it."""
    read = records.groupBy("path").agg(F.count(F.lit(1)).alias("read"))
    wrong = manifest.join(read, "path", "left").where(F.col("records") != F.coalesce("read", F.lit(0))).select("path", "records", "read")
    if differing := wrong.take(5):
        raise ValueError("records written and read differ: " + ", ".join(f"{r.path} {r.records} {r.read or 0}" for r in differing))


def round_trip(spark: SparkSession, pages: DataFrame, *, folder: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    manifest = write_warc(pages, folder or new_folder(spark, "warc"))
    records = stored(read_warc(manifest, range_bytes), "warc-records")
    check_complete(manifest, records)
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
