"""Intervals of chromosomes: merging, overlap joins, and measures of one set against another.

Overlap joins meet on chromosome and bin: each interval has a row for each bin of `BIN` bases that it
touches, so that a join compares near intervals only, whatever their number. A match found in several bins
is counted once: by distinct ids, or, for summed overlaps, in the one bin where the overlap starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 14
#: Bases of a range whose intervals one task puts in order.
RANGE = 1 << 22


def _bins(start: Column, end: Column) -> Column:
    """The bins of [start, end], both ends counted, so that intervals that only touch meet too."""
    low = F.floor(F.least(start, end) / BIN)
    return F.explode(F.sequence(low, F.floor(F.greatest(start, end) / BIN)))


def merge(intervals: DataFrame) -> DataFrame:
    """(chrom, start, end): intervals that overlap or touch made one, by chromosome.

    Intervals are put in order within ranges of `RANGE` bases, each a task's; what a range needs of those before it,
    how far they reach and where their last island starts, are one row for each range, and only these are put in order by chromosome.
    """
    rows = intervals.select("chrom", "start", "end", F.floor(F.col("start") / RANGE).alias("range"))
    near = Window.partitionBy("chrom", "range").orderBy("start", "end")
    earlier = Window.partitionBy("chrom").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("chrom", "range").agg(F.max("end").alias("far")).withColumn("before", F.max("far").over(earlier)).drop("far")
    rows = rows.join(ranges, ["chrom", "range"])
    reach = F.greatest("before", F.max("end").over(near.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("first", F.when(F.coalesce(F.col("start") > reach, F.lit(True)), F.col("start")))
    lasts = rows.groupBy("chrom", "range").agg(F.max("first").alias("last")).withColumn("open", F.max("last").over(earlier)).drop("last")
    island = F.coalesce(F.max("first").over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("open"))
    rows = rows.join(lasts, ["chrom", "range"]).withColumn("island", island)
    return rows.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def overlap(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """One row: is_bp, the bases that two merged sets have in common."""
    a = pred.select("chrom", "start", "end", _bins(F.col("start"), F.col("end")).alias("bin"))
    b = ref.select("chrom", F.col("start").alias("start_b"), F.col("end").alias("end_b"), _bins(F.col("start"), F.col("end")).alias("bin"))
    both = a.join(b, ["chrom", "bin"]).where("start < end_b and start_b < end").withColumn("from", F.greatest("start", "start_b"))
    both = both.where(F.floor(F.col("from") / BIN) == F.col("bin"))
    return both.agg(F.coalesce(F.sum(F.least("end", "end_b") - F.col("from")), F.lit(0)).cast("long").alias("is_bp"))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole).cast("double")).otherwise(F.lit(0.0))


def _f1() -> Column:
    return F.when(F.col("recall") + F.col("precision") > 0, F.lit(2.0) * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(F.lit(0.0))


def bp_metrics(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """One row of measures by bases: pred_bp, ref_bp, is_bp, pred_unique_bp, ref_unique_bp, recall, precision, f1, jaccard."""
    a, b = merge(pred), merge(ref)
    total = lambda x, name: x.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias(name))
    row = total(a, "pred_bp").crossJoin(total(b, "ref_bp")).crossJoin(overlap(a, b))  # of one row each
    row = row.withColumn("recall", _share("is_bp", "ref_bp")).withColumn("precision", _share("is_bp", "pred_bp")).withColumn("f1", _f1())
    row = row.withColumn("union_bp", F.col("pred_bp") + F.col("ref_bp") - F.col("is_bp")).withColumn("jaccard", _share("is_bp", "union_bp"))
    unique = (F.col("pred_bp") - F.col("is_bp")).alias("pred_unique_bp"), (F.col("ref_bp") - F.col("is_bp")).alias("ref_unique_bp")
    return row.select("pred_bp", "ref_bp", "is_bp", *unique, "recall", "precision", "f1", "jaccard")


def covered(rows: DataFrame, others: DataFrame, fraction: float = 0.5) -> DataFrame:
    """The rows of which one interval of `others` covers a share of at least `fraction`; empty ones never match."""
    a = rows.withColumn("bin", _bins(F.col("start"), F.col("end")))
    b = others.select(F.col("chrom").alias("chrom_b"), F.col("start").alias("start_b"), F.col("end").alias("end_b"), _bins(F.col("start"), F.col("end")).alias("bin_b"))
    shared = F.least("end", "end_b") - F.greatest("start", "start_b")
    on = (F.col("chrom") == F.col("chrom_b")) & (F.col("bin") == F.col("bin_b")) & (F.col("end") > F.col("start")) & (F.col("end_b") > F.col("start"))
    on &= F.greatest(shared, F.lit(0)).cast("double") / F.when(F.col("end") > F.col("start"), F.col("end") - F.col("start")).cast("double") >= fraction
    return a.join(b, on, "left_semi").drop("bin").distinct()


def fragment_metrics(pred: DataFrame, ref: DataFrame, fraction: float = 0.5) -> DataFrame:
    """One row of measures by intervals, which must be distinct: recall, precision, f1, tp, fp, fn, total_ref, total_pred."""
    count = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    pred, ref = pred.select("chrom", "start", "end"), ref.select("chrom", "start", "end")
    row = count(ref, "total_ref").crossJoin(count(pred, "total_pred")).crossJoin(count(covered(ref, pred, fraction), "tp")).crossJoin(count(covered(pred, ref, fraction), "matched"))
    return _measures(row)


def _measures(row: DataFrame) -> DataFrame:
    row = row.withColumn("recall", _share("tp", "total_ref")).withColumn("precision", _share("matched", "total_pred")).withColumn("f1", _f1())
    return row.select("recall", "precision", "f1", "tp", (F.col("total_pred") - F.col("matched")).alias("fp"), (F.col("total_ref") - F.col("tp")).alias("fn"), "total_ref", "total_pred")


def cluster_pairs(members: DataFrame, order: list[str], use_subclusters: bool = True) -> DataFrame:
    """(cluster_id, c1, s1, e1, c2, s2, e2): each two members of a cluster, in the given order, that don't overlap.

    Members of one subcluster, other than "0", don't pair if asked for.
    """
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))
    sub = F.col("subcluster") if "subcluster" in members.columns else F.lit("0")
    rows = members.select("cluster_id", "chrom", "start", "end", sub.alias("sub"), nth.alias("nth"))
    a = rows.select("cluster_id", *(F.col(c).alias(f"{c}_a") for c in ("chrom", "start", "end", "sub", "nth")))
    both = a.join(rows, "cluster_id").where("nth_a < nth").where(~((F.col("chrom_a") == F.col("chrom")) & (F.greatest("start_a", "start") < F.least("end_a", "end"))))
    if use_subclusters:
        both = both.where("not (sub_a = sub and sub <> '0')")
    return both.select("cluster_id", *(F.col(f"{c}_a").alias(f"{c[0]}1") for c in ("chrom", "start", "end")), *(F.col(c).alias(f"{c[0]}2") for c in ("chrom", "start", "end")))


def pair_lines(members: DataFrame, order: list[str]) -> DataFrame:
    """Nine columns for each ordered two members of a cluster: the first's place, the second as text, and fixed fields."""
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))
    rows = members.select("cluster_id", "chrom", "start", "end", nth.alias("nth"))
    other = rows.select("cluster_id", F.col("nth").alias("nth_b"), F.format_string("%s:%s-%s", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("name"))
    both = rows.join(other, "cluster_id").where("nth <> nth_b")
    return both.select("chrom", "start", "end", "name", F.lit("0").alias("score"), F.lit("+").alias("strand"), F.col("start").alias("thick_start"), F.col("end").alias("thick_end"), F.lit("139,139,139").alias("rgb"))


def _ordered(pairs: DataFrame, name: str) -> DataFrame:
    """Distinct pairs with how often each is there, the chromosome of less name first; within one chromosome they stay as they are."""
    first = F.col("c1") <= F.col("c2")
    swap = lambda x: (F.when(first, F.col(f"{x}1")).otherwise(F.col(f"{x}2")), F.when(first, F.col(f"{x}2")).otherwise(F.col(f"{x}1")))
    parts = [c.alias(f"{name}{x}{n}") for x in "cse" for n, c in zip((1, 2), swap(x), strict=True)]
    names = [f"{name}{x}{n}" for x in "cse" for n in (1, 2)]
    return pairs.select(*parts).groupBy(*names).agg(F.count(F.lit(1)).alias(f"{name}n")).withColumn(f"{name}pair", F.struct(*names))


def matched_pairs(ref: DataFrame, target: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(rpair, rn, tpair, tn), distinct pairs and how often each is there: pairs of intervals that cover each other to the threshold on both sides, straight or crosswise.

    They are compared only if their first intervals overlap; pairs of empty intervals never match.
    """
    r, t = _ordered(ref, "r"), _ordered(target, "t")
    r = r.where("re1 > rs1 and re2 > rs2").withColumn("bin", _bins(F.col("rs1"), F.col("re1")))
    t = t.where("te1 > ts1 and te2 > ts2").withColumn("bin", _bins(F.col("ts1"), F.col("te1")))

    def cover(i: int, j: int) -> Column:
        shared = F.greatest(F.least(f"re{i}", f"te{j}") - F.greatest(f"rs{i}", f"ts{j}"), F.lit(0)).cast("double")
        return (shared / (F.col(f"re{i}") - F.col(f"rs{i}")) >= threshold) & (shared / (F.col(f"te{j}") - F.col(f"ts{j}")) >= threshold)

    both = r.join(t, [r["rc1"] == t["tc1"], r["rc2"] == t["tc2"], r["bin"] == t["bin"]]).where("ts1 < re1 and te1 > rs1")
    return both.where((cover(1, 1) & cover(2, 2)) | (cover(1, 2) & cover(2, 1))).select("rpair", "rn", "tpair", "tn").distinct()


def pair_metrics(ref: DataFrame, target: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of measures by pairs; with no pairs on one side all shares are 0."""
    found = matched_pairs(ref, target, threshold)
    hit = lambda x, name: found.select(f"{x}pair", f"{x}n").distinct().agg(F.coalesce(F.sum(f"{x}n"), F.lit(0)).alias(name))
    count = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    return _measures(count(ref, "total_ref").crossJoin(count(target, "total_pred")).crossJoin(hit("r", "tp")).crossJoin(hit("t", "matched")))
