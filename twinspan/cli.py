"""Command line: search, compare, simulate and convert."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from twinspan.operators.intervals import pair_lines
from twinspan.params import Params
from twinspan.plans import evaluation
from twinspan.plans.duplications import run
from twinspan.plans.scratch import exists, size
from twinspan.sources import bed


COMMANDS = ("search", "compare", "simulate", "convert")


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):  # noqa: ANN201
        self.print_usage(sys.stderr)
        print(f"[ERROR] {message}", file=sys.stderr)
        raise SystemExit(1)


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="twinspan", description="Duplicated regions in collections of sequences")
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)

    search = commands.add_parser("search", help="find duplicated regions in FASTA or FASTQ files")
    search.add_argument("-k", type=int, default=17, help="k-mer length")
    search.add_argument("-s", dest="scale", type=int, default=16, help="keep one k-mer hash of this many")
    search.add_argument("-w", dest="window", type=int, default=1024, help="window in bases")
    search.add_argument("-t", dest="step", type=int, default=0, help="step in bases (0: a third of the window)")
    search.add_argument("-b", dest="min_bases", type=int, default=0, help="valid bases a window needs (0: a quarter)")
    search.add_argument("-c", dest="copies", type=int, default=2, help="copies within a genome (1: the whole map)")
    search.add_argument("-m", dest="masked", action="store_true", help="lower-case bases are not valid")
    search.add_argument("-o", dest="prefix", default="twinspan", help="prefix of the output")
    search.add_argument("-p", dest="threads", type=int, default=8, help="threads in local mode")
    search.add_argument("files", nargs="+")

    compare = commands.add_parser("compare", help="measure calls against reference calls")
    compare.add_argument("--calls", required=True)
    compare.add_argument("--reference", required=True)
    compare.add_argument("--include-chrm", action="store_true")

    simulate = commands.add_parser("simulate", help="search simulated genomes, over one value or several of a parameter")
    # The parameters that can be swept, and the defaults.
    simulate.add_argument("--sweep-param", choices=["none", "kmer", "scale", "window", "step", "all"], default="none")
    simulate.add_argument("--genome-sizes", type=int, nargs="+", default=[10_000_000, 20_000_000])
    simulate.add_argument("--genome-size", type=int)
    simulate.add_argument("--reps", "-N", type=int, default=3)
    simulate.add_argument("--num-dups", type=int)
    for flag, name, default in (("-k", "kmer", 17), ("-w", "window-size", 1024), ("-t", "step-size", 0), ("-s", "scale", 16)):
        simulate.add_argument(f"--{name}", flag, type=int, default=default)
    simulate.add_argument("--ortholog-rate", type=float, default=0.0, help="share of the copies that are three, one without flanks")
    simulate.add_argument("--no-plot", action="store_true", help="accepted; no plots are made")
    for name in ("kmers", "scales", "window-sizes", "step-sizes"):
        simulate.add_argument(f"--{name}", type=int, nargs="+")
    simulate.add_argument("--threads", "-p", type=int, default=8)
    simulate.add_argument("--out-csv", default="sim_results.csv")

    convert = commands.add_parser("convert", help="clusters of regions as lines of pairs")
    convert.add_argument("input")
    convert.add_argument("output", nargs="?")
    return top


def session(threads: int = 8) -> SparkSession:
    """The running session, or what spark-submit configures, or local mode."""
    builder = SparkSession.builder.appName("twinspan").config("spark.sql.session.timeZone", "UTC")
    if "SPARK_MASTER" not in os.environ and not SparkSession.getActiveSession():
        builder = builder.master(f"local[{max(1, threads)}]")
    return builder.getOrCreate()


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    top = parser()
    if not arguments:
        top.print_usage(sys.stderr)
        return 1
    if {"-h", "--help"} & {*arguments}:  # wherever it stands, even as an option's value
        arguments = [x for x in arguments[:1] if x in COMMANDS] + ["-h"]
    found = top.parse_args(arguments)
    try:
        return _run(found)
    except ValueError as wrong:
        print(f"[ERROR] {wrong}", file=sys.stderr)
        return 1


def _missing(spark: SparkSession, *paths: str) -> bool:
    missing = [x for x in paths if not exists(spark, x)]
    for x in missing:
        print(f"[ERROR] no such file: {x}", file=sys.stderr)
    return bool(missing)


def _run(found: argparse.Namespace) -> int:
    if found.command == "search":
        p = Params(found.k, found.scale, found.window, found.step, found.min_bases, found.copies, found.masked)
        spark = session(found.threads)
        print(f"[INFO] searching {len(found.files)} files: k {p.k}, scale {p.scale}, window {p.window}, step {p.stride}, copies {p.copies}", file=sys.stderr)
        began = time.perf_counter()
        count = run(spark, found.files, found.prefix, p)
        out = f"{found.prefix}.dup.bed"
        told = f"{count} regions, {size(spark, out)} bytes in {out}" if count else "nothing found, nothing written"
        print(f"[INFO] {told}; {time.perf_counter() - began:.1f} s", file=sys.stderr)
    elif found.command == "compare":
        if _missing(session(), found.calls, found.reference):
            return 1
        print(evaluation.report(found.calls, found.reference, *evaluation.compare(session(), found.calls, found.reference, not found.include_chrm)))
    elif found.command == "simulate":
        spark, p = session(found.threads), Params(found.kmer, found.scale, found.window_size, found.step_size)
        values = {"kmer": ("k", found.kmers), "scale": ("scale", found.scales), "window": ("window", found.window_sizes), "step": ("step", found.step_sizes)}
        chosen = {"none": {"none": ("k", [found.kmer])}, "all": values}.get(found.sweep_param) or {found.sweep_param: values[found.sweep_param]}
        for name, (parameter, tried) in chosen.items():
            out = found.out_csv if len(chosen) == 1 else f"{found.out_csv.removesuffix('.csv')}_{name}.csv"
            rows = evaluation.sweep(spark, parameter, tried, [found.genome_size] if found.genome_size else found.genome_sizes, found.reps, p, out, found.num_dups, ortholog_rate=found.ortholog_rate)
            evaluation.group_means(rows, ["Tool", "GenomeSize"] if name == "none" else [{"k": "kmer", "scale": "scale", "window": "window_size", "step": "step_size"}[parameter]], [*evaluation.METRICS, "Time(s)", "Memory(MB)"]).show(100, False)
    else:
        spark = session()
        if _missing(spark, found.input):
            return 1
        out = found.output or (f"{found.input.removesuffix('.dup.bed')}_SD.bed" if found.input.endswith(".dup.bed") else f"{found.input}.sedef.bed")
        bed.write_pair_lines(pair_lines(bed.tab_members(spark, found.input), ["line_no"]), out)
        print(f"[INFO] written: {out}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
