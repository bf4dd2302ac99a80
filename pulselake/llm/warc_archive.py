"""WARC archives of captures, read back, and their index merged to capture histories.

1. Captures with equal payloads are found by digest; the least capture is a ``response``, the others ``revisit`` it.
2. Each task sorts its captures by URL key and time and writes them as one archive: WARC 1.1 records, gzip over the whole
   file. Spark's own writer does it, so an archive of a lost or repeated task never shows up beside the other.
3. Archives are read back record by record along their Content-Length; payloads must have the digest in their header.
   The entries of an archive are a sorted run of the index.
4. Runs are merged externally: the range of (URL key, time, record) is cut at sampled splitters, each merging task gets
   its slice of every run and merges the slices with a loser tree. Parts follow each other in order, so the
   whole is one globally ordered history of captures, and a URL with very many captures spreads over several parts.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, removed_at_end, shared_folder, written

#: Bytes of payload in an archive, on average; Spark reads a file of up to 2 GiB whole.
ARCHIVE_BYTES = 32 << 20
#: Index entries that a task merges, on average.
MERGE_ENTRIES = 250_000
#: A digest that more than one in so many captures have is joined by broadcast: fewer than this many digests are so usual.
USUAL = 1_000

END = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ENTRY = (
    "archive string, position long, length long, page_id long, url string, captured long, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long"
)


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: twenty bits, four letters, at a time."""
    digits = F.sha1(F.encode(text, "utf-8"))
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the last to the first, then path and query; without scheme, port, fragment."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://|#.*", "")
    host = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*", 0), "^.*@|:[0-9]*$|^www[0-9]*[.]", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.regexp_extract(rest, "[/?](?s:.*)", 0))


def utc_text(seconds: Column) -> Column:
    """Seconds since 1970 as YYYY-MM-DDThh:mm:ssZ, whatever the session's time zone."""
    day, of_day = F.floor(seconds / 86_400).cast("int"), F.pmod(seconds, F.lit(86_400))
    clock = [F.lpad(x.cast("int").cast("string"), 2, "0") for x in (F.floor(of_day / 3600), F.pmod(F.floor(of_day / 60), F.lit(60)), F.pmod(of_day, F.lit(60)))]
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))


def captures(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """page_id, url (line ends as %0D, %0A), payload and captured (seconds since 1970, null as 0) of each row of ``pages``."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.replace(F.replace(F.col("url").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
        F.coalesce((F.lit(0) if captured is None else captured).cast("long"), F.lit(0)).alias("captured"),
    )


def with_firsts(given: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, int]:
    """``given`` with ``first``, the least page_id of a payload that occurs more than once, and the bytes of all payloads.

    Payloads are told apart by SHA-256. Digests that very many captures share come by broadcast, fewer than USUAL
    rows; the captures that have them are not dealt by digest.
    """
    key = F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256))
    size = F.sum(F.octet_length("payload")).alias("bytes")
    digests = written(given.groupBy(key.alias("key")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"), size), "digests")
    total, held = digests.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    repeated = digests.where("n > 1 AND key IS NOT NULL").select("key", "first", (F.col("n") * USUAL > total).alias("usual"))
    usual = repeated.where("usual").select("key", F.col("first").alias("usual_first"))
    others = repeated.where("NOT usual").select(F.col("key").alias("match"), F.col("first").alias("other_first"))
    known = given.withColumn("key", key).join(F.broadcast(usual), "key", "left")
    spread = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "captured").cast("string"))
    dealt = known.withColumn("match", F.when(F.col("usual_first").isNull() & F.col("key").isNotNull(), F.col("key")).otherwise(spread))
    archives = max(1, math.ceil(held / ARCHIVE_BYTES))
    first = F.coalesce("usual_first", "other_first").alias("first")
    return dealt.repartition(archives, "match").join(others, "match", "left").select(*given.columns, first), held


def _record(first: Column) -> Column:
    """The text of a record without the blank lines that end it, which the writer adds."""
    revisit = F.col("page_id").isNotNull() & (F.col("page_id") > first)
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))

    def page(number: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">"))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(END))

    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        header("WARC-Type", kind),
        header("WARC-Record-ID", page(F.col("page_id"))),
        F.coalesce(header("WARC-Target-URI", F.col("url")), F.lit("")),
        header("WARC-Date", utc_text(F.col("captured"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        F.when(revisit, F.concat(header("WARC-Refers-To", page(first)), header("WARC-Profile", F.lit(REVISIT)))).otherwise(F.lit("")),
        header("Content-Type", F.lit("application/http;msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )


def write_archives(given: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Write ``captures`` to archives in a new ``folder``, each sorted by URL key and time.

    Of equal payloads of at least ``least_bytes`` bytes the capture with the least page_id is the response, the others
    with a greater one revisit it; rows repeated with the least id are all responses, and so are rows without an id.
    No captures give archives without records.
    """
    rows, _ = with_firsts(given, least_bytes)
    ordered = rows.withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions("url_key", "captured", "page_id")
    ordered.select(_record(F.col("first")).alias("value")).write.option("lineSep", END + END).option("compression", "gzip").text(folder)


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in block.decode().split(END)[1:] if ": " in line)
    return {name.lower(): value for name, value in pairs}


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Place, length, header fields and block of each record of an archive, by Content-Length: a payload may hold anything."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        fields = _fields(data[at:head])
        end = head + 4 + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has another length than its header says")
        yield at, end + 4 - at, fields, data[head + 4 : end]
        at = end + 4


def _entry(archive: str, at: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    cut = block.index(b"\r\n\r\n") + 4
    payload, digest, kind = block[cut:], fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    size = int(_fields(block[:cut])["content-length"])
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{archive}: payload of the record at byte {at} differs from its header")
    date = np.datetime64(fields["warc-date"].removesuffix("Z"), "s").astype(np.int64)
    refers = _page(fields.get("warc-refers-to"))
    return archive, at, length, _page(fields["warc-record-id"]), fields.get("warc-target-uri"), int(date), size, digest, kind, refers


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index entry of every record in the archives of ``folder``, in the archives' order (ENTRY).

    ``position`` and ``length`` are bytes of the unpacked archive. A record whose length or payload differs from its
    header raises ValueError.
    """
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                packed, archive = content.as_py(), path.as_py()
                rows = [_entry(archive, *r) for r in records(gzip.decompress(packed) if packed[:2] == b"\x1f\x8b" else packed)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)

    importable(spark)
    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, ENTRY)


def merge_runs(keys: list[tuple], bounds: list[int]) -> Iterator[int]:
    """Row numbers of ``keys`` in order; run k, itself sorted, has the rows ``bounds[k]`` to ``bounds[k + 1]``.

    A loser tree: each inner node keeps the run that lost there, so the next row costs one comparison a level. Equal
    keys go by run.
    """
    runs = len(bounds) - 1
    at = list(bounds[:-1])

    def before(a: int, b: int) -> bool:
        """Whether run a's next row goes before that of run b; an ended run goes last."""
        if a >= runs or at[a] == bounds[a + 1]:
            return False
        if b >= runs or at[b] == bounds[b + 1]:
            return True
        x, y = keys[at[a]], keys[at[b]]
        return x < y or (x == y and a < b)

    leaves = 1
    while leaves < runs:
        leaves *= 2
    losers, winners = [0] * leaves, [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (b, a) if before(b, a) else (a, b)
    best = winners[1] if leaves > 1 else 0
    while best < runs and at[best] < bounds[best + 1]:
        yield at[best]
        at[best] += 1
        node = (best + leaves) // 2
        while node:
            if before(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def merged_history(entries: DataFrame, merge_entries: int = MERGE_ENTRIES) -> DataFrame:
    """``entries`` with their URL key, in order of (URL key, time, page_id) over all parts: the captures of each URL.

    No entries give no rows.
    """
    runs = written(entries.withColumn("url_key", url_key(F.col("url"))), "runs")
    parts = max(1, math.ceil(runs.count() / merge_entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one part: about merge_entries entries
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        archive = table["archive"].to_pylist()
        bounds = [k for k in range(len(archive)) if not k or archive[k] != archive[k - 1]] + [len(archive)]
        never = -(1 << 63)  # a null id sorts first, as in the archives
        ids = [never if i is None else i for i in table["page_id"].to_pylist()]
        keys = list(zip(map(str.encode, table["url_key"].to_pylist()), table["captured"].to_pylist(), ids, strict=True))
        order = pa.array(merge_runs(keys, bounds), pa.int64())
        yield from table.take(order).combine_chunks().to_batches(max_chunksize=10_000)

    spread = runs.repartitionByRange(parts, "url_key", "captured", "page_id", "archive", "position")
    return spread.sortWithinPartitions("archive", "position").mapInArrow(run, runs.schema)


def archived_pages(pages: DataFrame, captured: Column | None = None, least_bytes: int = 0) -> DataFrame:
    """One row per row of ``pages`` from its record in the merged index of archives that are written and read back.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, and archive, position, length, url, url_key,
    captured. A null html is an empty payload; a null url has no target in its record; a null page_id makes a response.
    Repeated rows have a record each. No pages give no rows.
    """
    folder = f"{shared_folder(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    removed_at_end(pages.sparkSession, folder)
    write_archives(captures(pages, captured), folder, least_bytes)
    return merged_history(read_archives(pages.sparkSession, folder))


def page_records(pages: DataFrame) -> DataFrame:
    """The columns of the query; pages have no time, so their ids stand for it."""
    return archived_pages(pages, F.col("page_id")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = " || ".join(f"substr('{BASE32}', (((('0x' || substr(h, {5 * k + 1}, 5))::INTEGER >> {s}) & 31) + 1)::BIGINT, 1)" for k in range(8) for s in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, strlen(x)::BIGINT AS payload_bytes, sha1(x) AS h, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""
