"""WARC records and a Merkle audit of their fixity.

Records lie in files, in ranges of bytes in order of offset. The leaves of a file's tree are its
records' hashes with their offsets and ends; a node above covers `FAN` consecutive nodes, and so a range of offsets, and hashes
their numbers, ranges and hashes in order. Ranges of bytes that can't be read as records are leaves too. Replicas agree if the roots do. Where roots differ only the children of the nodes that
differ are compared, level by level, down to the records that differ, or that one replica lacks.

Hashing the records is one pass over the bytes, where they lie; only hashes and lengths travel. A level is a
grouping on (file, number div FAN), which bounds every group by FAN rows, and is a FANth of the level below. Only
the levels' mismatching rows take part in the descent.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinspan.plans.scratch import bounded_batches, save
from twinspan.sources.tables import table

FAN = 16
#: Bytes of records, before which the layout ends a file.
FILE_BYTES = 4 << 20

CRLF = "\r\n"


def record_head(uri: Column, length: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """The header of a resource record with a body of `length` bytes, up to and with the blank line."""
    uuid = F.sha2(F.coalesce(uri, F.lit("")).cast("binary"), 256)
    lines = [F.lit("WARC/1.0"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:sha256:"), uuid, F.lit(">")), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(uri, F.lit(""))), F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, record): each page as the bytes of a WARC record; null html is an empty body, a null url an empty one.

    Repeated rows are records of their own; columns beside page_id, url and html are left alone.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.concat(record_head(F.col("url"), F.length(body)).cast("binary"), body, F.lit(CRLF + CRLF).cast("binary")).alias("record"))


_LENGTH = re.compile(rb"\r\ncontent-length[ \t]*:[ \t]*(\d+)[ \t]*(?=\r\n|\Z)", re.I)


def _record_end(data: bytes, at: int) -> tuple[int, int] | None:
    """Where the body of the record at a place starts and ends, or None if the record is broken."""
    head_end = data.find(b"\r\n\r\n", at)
    found = _LENGTH.search(data, at, head_end) if head_end >= 0 and data.startswith(b"WARC/", at) else None
    if not found:
        return None
    end = head_end + 4 + int(found[1])
    return (head_end + 4, end) if data.startswith(b"\r\n\r\n", end) else None


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of the records of a file, which together are all of its bytes.

    Names of headers are in lower case. A broken record, and whatever else is no record, reaches up to the next whole
    record; it has no headers and its bytes are the body.
    """
    at = 0
    while at < len(data):
        if place := _record_end(data, at):
            start, end = place
            lines = data[at : start - 4].decode("utf-8", "replace").split(CRLF)[1:]
            headers = {name.strip().lower(): value.strip() for name, colon, value in (x.partition(":") for x in lines) if colon}
            yield at, end + 4 - at, headers, data[start:end]
            at = end + 4
            continue
        after = data.find(b"WARC/", at + 1)
        while after >= 0 and not _record_end(data, after):
            after = data.find(b"WARC/", after + 1)
        end = after if after >= 0 else len(data)
        yield at, end - at, {}, data[at:end]
        at = end


def _plain(data: bytes) -> bytes:
    """A file's bytes without gzip; members that can't be read are kept as they are, up to the next that can."""
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error):
        pass
    out, at = [], 0
    while at < len(data):
        member = zlib.decompressobj(31)
        try:
            text = member.decompress(data[at:])
            whole = member.eof
        except zlib.error:
            whole = False
        if whole:
            out.append(text)
            at = len(data) - len(member.unused_data)
            continue
        after = data.find(b"\x1f\x8b\x08", at + 1)
        end = after if after >= 0 else len(data)
        out.append(data[at:end])
        at = end
    return b"".join(out)


def read_warc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, number, offset, length, uri, body, record) of all records of WARC files, gzipped or plain.

    record has the whole bytes, as `leaves` takes them; bytes that are no record have no uri, see `parse`. Offsets are of
    the file without gzip.

    A file is read whole by one task; files are meant to be of bounded size, as writers make them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = _plain(data)
                rows = [(path, i, at, n, h.get("warc-target-uri"), body, data[at : at + n]) for i, (at, n, h, body) in enumerate(parse(data))]
                names = ["file", "number", "offset", "length", "uri", "body", "record"]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "file string, number long, offset long, length long, uri string, body binary, record binary")


def laid_out(rows: DataFrame, order: list[str], file_bytes: int = FILE_BYTES) -> DataFrame:
    """Adds file, number and offset to narrow rows with `length`, as a writer would lay records of such lengths out.

    Rows are dealt to as many files as their bytes need, by a hash of all their columns, and lie in a file in the
    given order, ties by that hash; so a layout depends on the rows alone. Rows that repeat are told apart by a running
    number, so that they are dealt like others: each file is a bounded group. Input columns of these three names are replaced; an
    empty table gives no rows.
    """
    rows = rows.drop("file", "number", "offset", "_copy", "_times", "_at")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    total = rows.agg(F.sum("length")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_times"))
    copies = counted.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_copy"))
    copies = copies.withColumn("_at", F.xxhash64(*columns, "_copy")).withColumn("file", F.pmod("_at", F.lit(files)))
    w = Window.partitionBy("file").orderBy(*order, "_at")
    before = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return copies.select(*columns, "file", (F.row_number().over(w) - 1).cast("long").alias("number"), before.alias("offset"))


def leaves(rows: DataFrame) -> DataFrame:
    """Level 0 of the trees from rows (file, number, offset, length, record)."""
    return rows.select("file", "number", "offset", (F.col("offset") + F.col("length")).alias("end"), F.sha2("record", 256).alias("hash"))


def _above(level: DataFrame, fan: int) -> DataFrame:
    """The level over `level`, written: a node for each `fan` consecutive ones of a file."""
    children = F.array_sort(F.collect_list(F.struct("number", "offset", "end", "hash")))
    above = level.groupBy("file", F.floor(F.col("number") / fan).cast("long").alias("number"))
    nodes = above.agg(F.min("offset").alias("offset"), F.max("end").alias("end"), children.alias("children"))
    digest = F.sha2(F.concat_ws("|", F.transform("children", lambda c: F.concat_ws(":", c["number"].cast("string"), c["offset"].cast("string"), c["end"].cast("string"), c["hash"]))), 256)
    return save(nodes.select("file", "number", "offset", "end", digest.alias("hash")), "level")


def tree(level: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """All levels of the trees, records first, up to the one where each file has one node; each is written."""
    levels = [save(level, "level")]
    while (levels[-1].agg(F.max("number")).first()[0] or 0) > 0:
        levels.append(_above(levels[-1], fan))
    return levels


def audit(ours: DataFrame, theirs: DataFrame, fan: int = FAN) -> DataFrame:
    """(file, number, offset, length, hash, other_hash) of each record that differs between two replicas, in its bytes or its place.

    ours, theirs: (file, number, offset, end, hash) of the replicas' records. A record that a replica lacks
    has a null hash there, and the other's place. Equal replicas, or empty ones, give no rows. (file, number) tells a record, so rows
    without either take no part and no replica repeats one.
    """
    a, b = (tree(x.where("file is not null and number is not null"), fan) for x in (ours, theirs))
    for levels in (a, b):  # the smaller replica's roots are carried up, so that levels meet
        while len(levels) < max(len(a), len(b)):
            levels.append(_above(levels[-1], fan))
    differing = None
    for mine, other in zip(reversed(a), reversed(b), strict=True):
        if differing is not None:
            near = differing.select("file", F.col("number").alias("above"))
            mine, other = (x.join(near, (x["file"] == near["file"]) & (F.floor(x["number"] / fan) == near["above"]), "left_semi") for x in (mine, other))
        x = mine.select("file", "number", F.struct("offset", "end", "hash").alias("a"))
        y = other.select("file", "number", F.struct("offset", "end", "hash").alias("b"))
        differing = save(x.join(y, ["file", "number"], "full").where(~F.col("a").eqNullSafe(F.col("b"))), "differing")
        if differing.isEmpty():
            break
    place = F.coalesce("a", "b")
    return differing.select("file", "number", place["offset"].alias("offset"), (place["end"] - place["offset"]).alias("length"), F.col("a.hash").alias("hash"), F.col("b.hash").alias("other_hash"))


def damaged(record: Column, page: Column) -> Column:
    """A record as a replica for trials holds it: of one page in 97, by its hash, the body's last byte is another."""
    n = F.length(record)
    other = F.concat(F.substring(record, F.lit(1), n - 5), F.lit(b"\x00"), F.substring(record, n - 3, F.lit(4)))
    return F.when(F.pmod(F.xxhash64(F.lit(3), page), F.lit(97)) == 0, other).otherwise(record)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica that is damaged in known places."""
    theirs = F.sha2(damaged(F.col("record"), F.col("page_id")), 256).alias("theirs")
    hashed = records(table(spark, sf_dir, "pages")).select("page_id", F.length("record").cast("long").alias("length"), F.sha2("record", 256).alias("ours"), theirs)
    both = save(laid_out(hashed, ["page_id"]).withColumn("end", F.col("offset") + F.col("length")), "digests")
    found = audit(*(both.select("file", "number", "offset", "end", F.col(c).alias("hash")) for c in ("ours", "theirs")))
    return found.join(both.select("page_id", "file", "number"), ["file", "number"]).select("page_id", "file", "number", "offset", "length", "hash", "other_hash")
