"""FASTA and FASTQ files as a table of sequences."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.functions.labels import genome_label
from twinspan.plans.scratch import bounded_batches, exists, read_start

SCHEMA = "file_id int, genome string, seq string, comment string, record_no long, bases string, quality string"


def records(lines: Iterable[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, bases, quality) of each record of a file's lines, which are read once and in turn.

    A record starts at a line's > or @. Bases run to a line that starts with >, @ or +; after + comes as much
    quality as there are bases. A record whose quality is of another length ends the file.
    """
    lines = (x[:-1] if x.endswith("\r") else x for x in lines)
    line = next(lines, None)
    while line is not None:
        mark = re.search("[>@]", line)
        if not mark:
            line = next(lines, None)
            continue
        name, _, comment = re.sub(r"[ \t]", "\0", line[mark.end() :], count=1).partition("\0")
        parts = []
        while (line := next(lines, None)) is not None and line[:1] not in (">", "@", "+"):
            parts.append(line)
        bases, quality = "".join(parts), None
        if line is not None and line[:1] == "+":
            parts, length = [], 0
            line = next(lines, None)
            while line is not None and length < len(bases):
                parts.append(line)
                length += len(line)
                line = next(lines, None)
            if length != len(bases):
                return
            quality = "".join(parts)
        yield name, comment, bases, quality


def _whole(data: bytes) -> list[str]:
    """The lines of a file that is held whole."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    return data.decode("utf-8", "replace").removesuffix("\n").split("\n") if data else []


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): a file's lines, in order and in one partition, or the whole bytes of a file whose name doesn't tell how it is packed.

    Of a file that is split, the splits come in order, as they are of one size but for the last.
    """
    zipped = read_start(spark, path, 2) == b"\x1f\x8b"
    if zipped == path.endswith(".gz"):
        return spark.read.option("lineSep", "\n").text(path).select("value", F.lit(None).cast("binary").alias("content")).coalesce(1)
    return spark.read.format("binaryFile").load(path).select(F.lit(None).cast("string").alias("value"), "content")


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of the files in the order given; a file that isn't there is left out and keeps its number.

    A file, gzipped (also .bgz) or plain, is read line by line by one task, as records can't be told from within; it may be of any
    size, a record up to the 2 GB of a row. (A .bgz file, or one whose suffix doesn't fit, is held whole.) What follows works on
    pieces of sequences.
    """
    bounded_batches(spark)
    there = []
    for i, path in enumerate(paths):
        if exists(spark, path):
            there.append((i, path))
        else:
            print(f"[WARN] no such file: {path}")
    if not there:
        return spark.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["file_id", "genome", "seq", "comment", "record_no", "bases", "quality"]
        label: list = []

        def lines() -> Iterator[str]:
            for batch in batches:
                label[:] = [batch.column(c)[0].as_py() for c in ("file_id", "genome")] if batch.num_rows else label
                for value, data in zip(batch.column("value").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    yield from [value] if data is None else _whole(data)

        held: list[tuple] = []
        for n, (name, comment, bases, quality) in enumerate(records(lines())):
            held.append((*label, name, comment, n, bases, quality))
            if len(held) == 256 or sum(len(r[5]) for r in held) > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*held, strict=True), kinds, strict=True)], names)

    files = [_lines(spark, path).select(F.lit(i).alias("file_id"), genome_label(F.lit(path)).alias("genome"), "value", "content") for i, path in there]
    return reduce(DataFrame.unionByName, files).mapInArrow(run, SCHEMA)


def fasta_lines(name: str, bases: str, width: int = 80) -> str:
    """A record as text, wrapped."""
    return "".join([f">{name}\n", *(f"{bases[i : i + width]}\n" for i in range(0, len(bases), width))])
