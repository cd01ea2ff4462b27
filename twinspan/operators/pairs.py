"""Similar pairs of windows: candidates by common hashes, tests of similarity and of collinear support."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.operators.windows import hash_counts, windows_of_hash
from twinspan.params import LOOKAHEAD, MAX_HASH_WINDOWS, MIN_SHARED, NEXT_WINDOWS, Params
from twinspan.plans.scratch import bounded_batches


def apart(seq_a: Column, idx_a: Column, seq_b: Column, idx_b: Column, p: Params) -> Column:
    """Whether two windows don't overlap; those of different sequences never do."""
    return (seq_a != seq_b) | (F.abs(idx_a - idx_b) * p.stride >= p.window)


def required(size_a: Column, size_b: Column, p: Params) -> Column:
    """Hashes that sketches of two sizes must have in common."""
    return F.greatest(F.lit(MIN_SHARED).cast("long"), F.ceil(F.greatest(size_a, size_b).cast("double") * F.lit(p.shared_rate)))


def raw_pairs(postings: DataFrame, p: Params) -> DataFrame:
    """(hash, wa, wb): in each hash's windows, if 2 to 16, each with the next two, unless they overlap.

    Counts with partial sums drop the hashes that everyone has before any group is put in order, so that
    all groups that are have at most 16 rows. An overlapping window uses up its turn.
    """
    few = hash_counts(postings).where(F.col("n").between(2, MAX_HASH_WINDOWS)).select("hash")
    rows = postings.join(few, "hash")
    nexts = F.array(*(F.lead(F.struct("window_id", "seq_id", "window_idx"), n).over(windows_of_hash()) for n in range(1, NEXT_WINDOWS + 1)))
    rows = rows.select("hash", "window_id", "seq_id", "window_idx", nexts.alias("nexts"))
    rows = rows.select("hash", "window_id", "seq_id", "window_idx", F.explode("nexts").alias("b")).where(F.col("b").isNotNull())
    rows = rows.where(apart(F.col("seq_id"), F.col("window_idx"), F.col("b.seq_id"), F.col("b.window_idx"), p))
    return rows.select("hash", F.col("window_id").alias("wa"), F.col("b.window_id").alias("wb"))


def candidate_pairs(postings: DataFrame, p: Params) -> DataFrame:
    """The distinct (wa, wb)."""
    return raw_pairs(postings, p).select("wa", "wb").distinct()


def similar_pairs(pairs: DataFrame, windows: DataFrame, p: Params) -> DataFrame:
    """(wa, wb, shared, score) of the pairs whose sketches have enough hashes in common."""
    side = lambda x: windows.select(F.col("window_id").alias(f"w{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "wa").join(side("b"), "wb")
    larger = F.greatest(F.size("sa"), F.size("sb")).cast("long")
    both = both.select("wa", "wb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"), larger.alias("larger"), required(F.size("sa"), F.size("sb"), p).alias("need"))
    return both.where("shared >= need").select("wa", "wb", "shared", F.expr("(shared * 255 + larger div 2) div larger").alias("score"))


def neighbourhoods(windows: DataFrame, ids: DataFrame) -> DataFrame:
    """(window_id, seq_id, near): for each of the ids the non-empty sketches, with their index, of up to 8 windows to either side.

    Ids of windows are dense, so the neighbours' ids are known and found by one join.
    """
    steps = F.explode(F.array(*(F.lit(i) for i in range(-LOOKAHEAD, LOOKAHEAD + 1) if i)))
    own = windows.select("window_id", "seq_id").join(ids, "window_id")
    wanted = own.select("window_id", "seq_id", steps.alias("step")).withColumn("near_id", F.col("window_id") + F.col("step"))
    near = windows.where(F.size("sketch") > 0).select(F.col("window_id").alias("near_id"), F.col("seq_id").alias("near_seq"), F.struct("window_idx", "sketch").alias("near"))
    found = wanted.join(near, (wanted["near_id"] == near["near_id"]) & (wanted["seq_id"] == near["near_seq"]))
    return found.groupBy("window_id", "seq_id").agg(F.collect_list("near").alias("near"))  # 16 at most


def supported(idx_a: list, sketch_a: list, idx_b: list, sketch_b: list, same_seq: bool, p: Params) -> bool:
    """Whether some window of the one and some of the other neighbourhood are similar and don't overlap."""
    size_a, size_b = np.array([len(s) for s in sketch_a]), np.array([len(s) for s in sketch_b])
    hash_a, hash_b = np.concatenate(sketch_a), np.concatenate(sketch_b)
    of_a, of_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
    order = np.argsort(hash_b, kind="stable")
    low, high = np.searchsorted(hash_b[order], hash_a, "left"), np.searchsorted(hash_b[order], hash_a, "right")
    n = high - low
    if not n.any():
        return False
    at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    shared = np.bincount(np.repeat(of_a, n) * len(size_b) + of_b[order][at], minlength=len(size_a) * len(size_b)).reshape(len(size_a), len(size_b))
    need = np.maximum(MIN_SHARED, np.ceil(np.maximum.outer(size_a, size_b) * p.shared_rate))
    ok = shared >= need
    if same_seq:
        ok &= np.abs(np.subtract.outer(np.array(idx_a), np.array(idx_b))) * p.stride >= p.window
    return bool(ok.any())


def collinear_pairs(pairs: DataFrame, windows: DataFrame, p: Params) -> DataFrame:
    """The pairs near which another pair of windows, one on either side, is similar too."""
    ids = pairs.select(F.col("wa").alias("window_id")).union(pairs.select("wb")).distinct()
    near = neighbourhoods(windows, ids)
    side = lambda x: near.select(F.col("window_id").alias(f"w{x}"), F.col("seq_id").alias(f"q{x}"), F.col("near").alias(f"n{x}"))
    both = pairs.join(side("a"), "wa").join(side("b"), "wb").select(*pairs.columns, (F.col("qa") == F.col("qb")).alias("same_seq"), "na", "nb")
    columns = pairs.columns
    bounded_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in ("na", "nb"):
                column = batch.column(c)
                rows, flat = column.offsets.to_numpy(), column.values
                idx, sketch = flat.field("window_idx").to_numpy(zero_copy_only=False), flat.field("sketch")
                cut, hashes = sketch.offsets.to_numpy(), sketch.values.to_numpy(zero_copy_only=False)
                sides.append((rows, idx, cut, hashes))
            keep = []
            for r, same in enumerate(batch.column("same_seq").to_pylist()):
                (ia, sa), (ib, sb) = ((idx[rows[r] : rows[r + 1]], [hashes[cut[j] : cut[j + 1]] for j in range(rows[r], rows[r + 1])]) for rows, idx, cut, hashes in sides)
                keep.append(supported(ia, sa, ib, sb, same, p))
            yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, pairs.schema)
