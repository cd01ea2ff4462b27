"""Calls measured against a truth: comparison of two files, seeded simulation, sweeps of parameters."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.operators import intervals
from twinspan.params import Params
from twinspan.plans.duplications import run
from twinspan.plans.scratch import delete, root, write_bytes
from twinspan.sources import bed
from twinspan.sources.fasta import fasta_lines

METRICS = ("Recall_bp", "Precision_bp", "F1_bp", "Recall_frag", "Precision_frag", "F1_frag", "Recall_pair", "Precision_pair", "F1_pair")
# What the sweeps try unless told otherwise.
SWEEPS = {"k": (11, 13, 15, 17, 19, 21, 23, 25), "scale": (4, 8, 16, 32, 64, 128, 256), "window": (128, 256, 512, 1024, 2048, 4096, 8192), "step": (64, 128, 256, 341, 512, 768, 1024)}


def compare(spark: SparkSession, ours: str, theirs: str, exclude_mitochondrial: bool = True) -> tuple[DataFrame, DataFrame]:
    """Measures by bases and by intervals of the calls in one file against those in another."""
    pred, ref = (bed.normalised_intervals(spark, x, exclude_mitochondrial) for x in (ours, theirs))
    return intervals.bp_metrics(pred, ref), intervals.fragment_metrics(pred, ref)


def report(ours: str, theirs: str, bp: DataFrame, fragments: DataFrame) -> str:
    """The measures of `compare` as text."""
    b, f = bp.first().asDict(), fragments.first().asDict()
    names = {"pred_bp": "called bases", "ref_bp": "reference bases", "is_bp": "bases in common", "pred_unique_bp": "called alone", "ref_unique_bp": "reference alone"}
    lines = [f"calls:     {ours}", f"reference: {theirs}", "by bases", *(f"  {v:<22}{b[k]:>14,} ({b[k] / 1e6:.2f} Mb)" for k, v in names.items())]
    lines += [f"  {k:<22}{100 * b[k]:>13.2f}%" for k in ("recall", "precision", "f1")] + [f"  {'jaccard':<22}{b['jaccard']:>14.6f}", "by fragments"]
    lines += [f"  {k:<22}{f[k]:>14,}" for k in ("tp", "fp", "fn", "total_ref", "total_pred")] + [f"  {k:<22}{100 * f[k]:>13.2f}%" for k in ("recall", "precision", "f1")]
    return "\n".join(lines)


Interval = tuple[str, int, int]


@dataclass
class Truth:
    path: str
    pairs: list[tuple[Interval, Interval]]
    intervals: list[Interval]

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        places = spark.createDataFrame(self.intervals, "chrom string, start long, end long")
        return places, spark.createDataFrame([(*a, *b) for a, b in self.pairs], "c1 string, s1 long, e1 long, c2 string, s2 long, e2 long")


def simulate(path: str, sizes: dict[str, int], copies: int = 100, shortest: int = 1000, longest: int = 10_000, ortholog_rate: float = 0.0, flank: int = 500, seed: int = 1, spark: SparkSession | None = None) -> Truth:
    """Writes random chromosomes with copied stretches that don't overlap, and tells where they are.

    An ortholog's copy takes its flanks along, and a third place has the stretch without them; the third
    pairs with either, the first two don't. All stretches are drawn first and dealt to chromosomes that have room; what is free of a
    chromosome is then shared out at random as the gaps around its stretches. Stretches without room are left out.
    spark: writes to any file system that Spark knows, else to a local one.
    """
    draw = np.random.default_rng(seed)
    letters = lambda n: draw.choice(np.frombuffer(b"ACGT", np.uint8), n).tobytes()
    room = dict(sizes)
    held: dict[str, list[tuple[int, int, bytes, int]]] = {c: [] for c in sizes}  # event, place, bases, flank
    events = 0
    for length in draw.integers(shortest, longest + 1, copies).tolist():
        three = len(sizes) >= 3 and draw.random() < ortholog_rate
        margins = (flank, flank, 0) if three else (0, 0)
        left, dealt = dict(room), []
        for margin in margins:
            fits = [c for c in sizes if left[c] > length + 2 * margin]
            if not fits:
                break
            weight = np.array([left[c] for c in fits], float)
            dealt.append(fits[int(draw.choice(len(fits), p=weight / weight.sum()))])
            left[dealt[-1]] -= length + 2 * margin
        if len(dealt) < len(margins):
            continue
        room = left
        bases = letters(length + 2 * margins[0])
        for place, (chrom, margin) in enumerate(zip(dealt, margins, strict=True)):
            held[chrom].append((events, place, bases if margin == margins[0] else bases[flank:-flank], margin))
        events += 1

    found: dict[tuple[int, int], Interval] = {}
    lines = []
    for chrom, stretches in held.items():
        cuts = np.sort(draw.integers(0, room[chrom] + 1, len(stretches))).tolist()
        parts, at = [], 0
        for i, cut, before in zip(draw.permutation(len(stretches)).tolist(), cuts, [0, *cuts], strict=False):
            event, place, bases, margin = stretches[i]
            parts += [letters(cut - before), bases]
            start = at + cut - before
            at = start + len(bases)
            found[event, place] = (chrom, start + margin, at - margin)
        parts.append(letters(sizes[chrom] - at))
        lines.append(fasta_lines(chrom, b"".join(parts).decode()))
    text = "".join(lines).encode()
    if spark:
        write_bytes(spark, path, text)
    else:
        with open(path, "wb") as out:
            out.write(text)
    pairs = [(found[e, a], found[e, b]) for e in range(events) for a, b in (((0, 2), (1, 2)) if (e, 2) in found else ((0, 1),))]
    return Truth(path, pairs, sorted({x for pair in pairs for x in pair}))


def evaluate(spark: SparkSession, tool: str, path: str, truth: Truth, seconds: float, paired: bool = False) -> dict:
    """One caller's measures. paired: its file has pairs of intervals and not clusters."""
    places, pairs = truth.frames(spark)
    called = bed.parse_intervals(spark, path)
    found = bed.parse_pairs(spark, path) if paired else intervals.cluster_pairs(bed.cluster_members(spark, path), ["line_no"])
    rows = {"bp": intervals.bp_metrics(called, places), "frag": intervals.fragment_metrics(called, places), "pair": intervals.pair_metrics(pairs, found.select(pairs.columns))}
    out: dict = {"Tool": tool}
    for name, frame in rows.items():
        row = frame.first()
        out |= {f"{label}_{name}": row[column] for label, column in (("Recall", "recall"), ("Precision", "precision"), ("F1", "f1"))}
        count = row["total_pred"] if name == "pair" else 0
    return out | {"Pairs_Count": count, "Time(s)": seconds}


def _peak_mb(spark: SparkSession, anew: bool = False) -> float:
    """The driver's most memory in the JVM's pools, since it was last asked for anew, in MB; in local mode that is all there is."""
    pools = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    total = sum(x.getPeakUsage().getUsed() for x in pools)
    for x in pools if anew else ():
        x.resetPeakUsage()
    return total / 1e6


def timed_run(spark: SparkSession, truth: Truth, p: Params) -> dict:
    """Searches a simulated genome and measures what is found; parameters, seconds and memory beside the measures."""
    prefix = f"{root(spark)}/twinspan/{uuid.uuid4().hex}"
    _peak_mb(spark, anew=True)
    began = time.perf_counter()
    run(spark, [truth.path], prefix, p)
    seconds, memory = time.perf_counter() - began, _peak_mb(spark)
    row = evaluate(spark, "twinspan", f"{prefix}.dup.bed", truth, seconds)
    delete(spark, f"{prefix}.dup.bed")
    return row | {"kmer": p.k, "window_size": p.window, "step_size": p.stride, "scale": p.scale, "Memory(MB)": memory}


def sweep(spark: SparkSession, parameter: str, values: Iterable[int] | None = None, genome_sizes: Iterable[int] = (10_000_000, 20_000_000), reps: int = 3, p: Params | None = None, out_csv: str | None = None, copies: int | None = None, seed: int = 1, ortholog_rate: float = 0.0) -> DataFrame:
    """Results of all values of one parameter (k, scale, window or step), genome sizes and repetitions; written as CSV if asked for."""
    base, rows = p or Params(), []
    for size in genome_sizes:
        for rep in range(reps):
            path = f"{root(spark)}/twinspan/{uuid.uuid4().hex}.fa"
            truth = simulate(path, {f"chr{c}": size // 5 for c in range(1, 6)}, copies or max(10, size // 1_000_000), ortholog_rate=ortholog_rate, seed=seed + rep, spark=spark)
            rows += [timed_run(spark, truth, replace(base, **{parameter: v})) | {"GenomeSize": size, "Rep": rep + 1} for v in values or SWEEPS[parameter]]
            delete(spark, path)
    found = spark.createDataFrame(rows)
    if out_csv:
        found.coalesce(1).write.mode("overwrite").option("header", True).csv(out_csv)
    return found


def group_means(results: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The mean of each column by group."""
    return results.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns))


def melted(results: DataFrame, keys: list[str], columns: dict[str, str], name: str = "Metric", value: str = "Score") -> DataFrame:
    """A row for each of the columns, under the label that `columns` gives it."""
    label = reduce(lambda c, kv: c.when(F.col(name) == kv[0], F.lit(kv[1])), columns.items(), F.when(F.lit(False), F.lit("")))
    return results.unpivot(keys, list(columns), name, value).withColumn(name, label)
