"""Regions of flagged windows, their partners, clusters and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspan.operators.components import connected_components
from twinspan.operators.numbering import numbered, running
from twinspan.params import LOOKAHEAD, MIN_REGION, Params


def flagged_windows(pairs: DataFrame) -> DataFrame:
    """(window_id): every window of an accepted pair."""
    return pairs.select(F.col("wa").alias("window_id")).union(pairs.select("wb")).distinct()


def window_regions(flagged: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, seq_id, file_id, window_idx, region_id): flagged windows of a sequence at most 8 apart are one region.

    Region numbers are dense in the order of windows, from 0: islands are numbered within each sequence, and
    sequences start where those before them end.
    """
    rows = flagged.join(windows.select("window_id", "seq_id", "file_id", "window_idx"), "window_id")
    w = Window.partitionBy("seq_id").orderBy("window_idx")
    starts = F.coalesce((F.col("window_idx") - F.lag("window_idx").over(w) > LOOKAHEAD).cast("int"), F.lit(1))
    rows = rows.withColumn("starts", starts).withColumn("island", F.sum("starts").over(w))
    counts = running(rows.groupBy("file_id", "seq_id").agg(F.sum("starts").alias("islands")), "file_id", "seq_id", "islands", "before").select("seq_id", "before")
    return rows.join(counts, "seq_id").select("window_id", "seq_id", "file_id", "window_idx", (F.col("before") + F.col("island") - 1).cast("long").alias("region_id"))


def regions(members: DataFrame, p: Params) -> DataFrame:
    """(region_id, seq_id, file_id, start, end) from rows of `window_regions`."""
    start, end = F.min("window_idx").cast("long") * p.stride, F.max("window_idx").cast("long") * p.stride + p.window
    return members.groupBy("region_id", "seq_id", "file_id").agg(start.alias("start"), end.alias("end"))


def region_edges(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(ra, rb, score): accepted pairs of windows as pairs of regions; ra = rb within one region."""
    of = lambda w, r: members.select(F.col("window_id").alias(w), F.col("region_id").alias(r))
    return pairs.join(of("wa", "ra"), "wa").join(of("wb", "rb"), "wb").select("ra", "rb", "score")


def best_partners(edges: DataFrame) -> DataFrame:
    """(region_id, partner_id, score, is_internal): each region's best partner, the smallest on a tie.

    A region with edges within itself alone has no partner and is internal.
    """
    both = edges.select(F.col("ra").alias("region_id"), F.col("rb").alias("other"), "score").union(edges.where("ra <> rb").select("rb", "ra", "score"))
    best = F.max(F.when(F.col("other") != F.col("region_id"), F.struct("score", (-F.col("other")).alias("minus"))))
    found = both.groupBy("region_id").agg(best.alias("best"))
    return found.select("region_id", (-F.col("best.minus")).alias("partner_id"), F.col("best.score").alias("score"), F.col("best").isNull().alias("is_internal"))


def clusters(rows: DataFrame, partners: DataFrame) -> DataFrame:
    """Adds component (the smallest region of those that best partners connect), cluster_id and is_internal to regions.

    Clusters are numbered from 1 by their smallest region.
    """
    linked = connected_components(partners.where("partner_id is not null").select(F.col("region_id").alias("u"), F.col("partner_id").alias("v")))
    linked = linked.select(F.col("node").alias("region_id"), "component")
    found = rows.join(partners.select("region_id", "is_internal"), "region_id", "left").join(linked, "region_id", "left")
    found = found.withColumn("component", F.coalesce("component", "region_id")).withColumn("is_internal", F.coalesce("is_internal", F.lit(False)))
    ids = numbered(found.where("component = region_id").select("component"), ["component"], "cluster_id", 1)
    return found.join(ids, "component")


def enough_copies(rows: DataFrame, p: Params) -> DataFrame:
    """Regions of clusters with enough regions in the file; with 2 asked for, an internal one alone is enough."""
    if p.copies <= 1:
        return rows
    n = F.count(F.lit(1)).over(Window.partitionBy("cluster_id", "file_id"))
    kept = n >= p.copies
    if p.copies == 2:
        kept |= (n == 1) & F.col("is_internal")
    return rows.withColumn("kept", kept).where("kept").drop("kept")


def bed(rows: DataFrame, sequences: DataFrame, p: Params) -> DataFrame:
    """(chrom, start, end, cluster_id) in the order of cluster, file, sequence and place; chrom is genome-sequence."""
    names = sequences.select("seq_id", F.concat_ws("-", "genome", "seq").alias("chrom"))
    long = rows.where(F.col("end") - F.col("start") >= min(p.window, MIN_REGION)).join(names, "seq_id")
    return long.orderBy("cluster_id", "file_id", "seq_id", "start", "end").select("chrom", "start", "end", F.col("cluster_id").cast("int").alias("cluster_id"))
