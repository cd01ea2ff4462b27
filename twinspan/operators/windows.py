"""Sequences, their windows, and the windows' sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspan.functions import hashing
from twinspan.operators.numbering import running
from twinspan.params import Params
from twinspan.plans.scratch import bounded_batches, save

#: Windows of a piece of a sequence, which one row holds and one task sketches.
PIECE = 2048


def number_sequences(sequences: DataFrame, p: Params) -> DataFrame:
    """Sequences of a window's length or more, with seq_id, n_windows and the id of the first window.

    Numbers are dense, in the order of file and record. Written, for each later step reads few of its columns.
    """
    rows = save(sequences.where(F.length("bases") >= p.window).withColumn("len", F.length("bases").cast("long")), "sequences")
    count = F.floor((F.col("len") - p.window) / p.stride).cast("long") + 1
    narrow = rows.select("file_id", "record_no", count.alias("n_windows"), F.lit(1).alias("one"))
    narrow = running(narrow, "file_id", "record_no", "one", "seq_id")
    narrow = running(narrow, "file_id", "record_no", "n_windows", "first_window").drop("one")
    return rows.join(narrow, ["file_id", "record_no"])


def window_sketches(numbered: DataFrame, p: Params) -> DataFrame:
    """(window_id, seq_id, file_id, window_idx, valid_bases, sketch) of every window.

    Long sequences are cut into pieces that overlap so that each window lies in one; a piece's k-mers are
    hashed once, not once a window; the pieces are dealt to tasks anew, so that a long sequence is the work of many. A window with too few valid bases keeps its row and has an empty sketch.
    """
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_windows") - 1, F.lit(PIECE).cast("long")))
    pieces = numbered.select("seq_id", "file_id", "first_window", "n_windows", "bases", first.alias("at"))
    take = (F.least(F.lit(PIECE), F.col("n_windows") - F.col("at")) - 1) * p.stride + p.window
    pieces = pieces.select("seq_id", "file_id", "first_window", "at", F.substring("bases", (F.col("at") * p.stride + 1).cast("int"), take.cast("int")).alias("piece"))
    spark = numbered.sparkSession
    pieces = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq_id", "at")  # a number, for few bytes are much work
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("seq_id", "file_id", "first_window", "at")]
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for seq_id, file_id, first_window, at, piece in zip(*ids, batch.column("piece").to_pylist(), strict=True):
                found = list(hashing.sketches(piece.encode("latin-1", "replace"), p))
                idx = np.arange(at, at + len(found))
                mine = (idx + first_window, np.full(len(idx), seq_id, np.int64), np.full(len(idx), file_id, np.int32), idx.astype(np.int32), np.array([n for n, _ in found], np.int32))
                for column, values in zip(columns, mine, strict=False):
                    column.append(values)
                columns[5] += [s for _, s in found]
            if columns[0]:
                ends = np.concatenate(([0], np.cumsum([len(s) for s in columns[5]]))).astype(np.int32)
                sketches = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[5]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in columns[:5]), sketches], ["window_id", "seq_id", "file_id", "window_idx", "valid_bases", "sketch"])

    return pieces.mapInArrow(run, "window_id long, seq_id long, file_id int, window_idx int, valid_bases int, sketch array<bigint>")


def window_ids(numbered: DataFrame) -> DataFrame:
    """(window_id, seq_id, file_id, window_idx) of every window, without a look at the bases."""
    idx = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_windows") - 1))
    rows = numbered.select("first_window", "seq_id", "file_id", idx.alias("window_idx"))
    return rows.select((F.col("first_window") + F.col("window_idx")).alias("window_id"), "seq_id", "file_id", "window_idx")


def postings(windows: DataFrame) -> DataFrame:
    """(hash, window_id, seq_id, window_idx): a row for each hash of each window."""
    return windows.select(F.explode("sketch").alias("hash"), "window_id", "seq_id", "window_idx")


def hash_counts(rows: DataFrame) -> DataFrame:
    """(hash, n): how many windows have each hash."""
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


def windows_of_hash() -> Window:
    return Window.partitionBy("hash").orderBy("window_id")
