"""BED and BEDPE files as tables of intervals and of pairs of intervals; and their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.functions.labels import accession_label, chrom_label
from twinspan.plans.scratch import exists, free, save, write_lines


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """(p, line_no): the fields, parted by white space, of lines that are neither comments nor blank. No file: none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "p array<string>, line_no long")
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim(F.regexp_replace("value", r"\s+", " ")) != ""))
    return lines.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("p"), F.monotonically_increasing_id().alias("line_no"))


def _int(field: Column) -> Column:
    return field.try_cast("bigint")


def _interval(i: int, number: Callable[[Column], Column] = _int) -> Column:
    at = lambda k: F.get("p", F.lit(i + k))
    return F.struct(chrom_label(at(0)).alias("chrom"), number(at(1)).alias("start"), number(at(2)).alias("end"))


def _must_be_int(field: Column) -> Column:
    """A whole number; anything else ends the reading with an error."""
    return F.when(_int(field).isNull(), F.raise_error(F.concat(F.lit("not a whole number: "), F.coalesce(field, F.lit("")))).cast("bigint")).otherwise(_int(field))


def parse_intervals(spark: SparkSession, path: str) -> DataFrame:
    """The distinct intervals of a BED or BEDPE file.

    The first three fields are one, if the latter two are whole numbers; fields four to six, if there, another.
    """
    rows = _fields(spark, path)
    both = F.when(F.size("p") >= 6, F.array(_interval(0), _interval(3))).when(F.size("p") >= 3, F.array(_interval(0))).otherwise(F.array().cast("array<struct<chrom:string,start:bigint,end:bigint>>"))
    return rows.select(F.explode(both).alias("i")).select("i.*").where("start is not null and end is not null").distinct()


def normalised_intervals(spark: SparkSession, path: str, exclude_mitochondrial: bool = True) -> DataFrame:
    """The distinct intervals with accessions as chromosomes, chrM left out if asked for."""
    rows = parse_intervals(spark, path).withColumn("chrom", accession_label(chrom_label(F.col("chrom"))))
    return (rows.where("chrom <> 'chrM'") if exclude_mitochondrial else rows).distinct()


def cluster_members(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, chrom, start, end, subcluster, line_no) of a file of four or five fields; a start or end that is no number is an error."""
    rows = _fields(spark, path).where(F.size("p") >= 4)
    return rows.select(F.get("p", F.lit(3)).alias("cluster_id"), _interval(0, _must_be_int).alias("i"), F.coalesce(F.get("p", F.lit(4)), F.lit("0")).alias("subcluster"), "line_no").select("cluster_id", "i.*", "subcluster", "line_no")


def parse_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(c1, s1, e1, c2, s2, e2) of a BEDPE file; rows in which one of the four numbers is none are left out."""
    rows = _fields(spark, path).where(F.size("p") >= 6).select(_interval(0).alias("a"), _interval(3).alias("b"))
    rows = rows.select(*(F.col(f"{x}.{c}").alias(f"{c[0]}{n}") for n, x in ((1, "a"), (2, "b")) for c in ("chrom", "start", "end")))
    return rows.where("s1 is not null and e1 is not null and s2 is not null and e2 is not null")


def tab_members(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, chrom, start, end, line_no) of a file parted by tabs alone, all fields text."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    rows = lines.select(F.split(F.trim("value"), "\t").alias("p"), F.monotonically_increasing_id().alias("line_no")).where(F.size("p") >= 4)
    at = lambda k: F.get("p", F.lit(k))
    return rows.select(at(3).alias("cluster_id"), accession_label(chrom_label(at(0))).alias("chrom"), at(1).alias("start"), at(2).alias("end"), "line_no")


def write_bed(rows: DataFrame, prefix: str) -> int:
    """Writes (chrom, start, end, cluster_id), in their order, to the file <prefix>.dup.bed, and tells how many; no file if there are none.

    One file with a header line, as the format has it: what is reported is small beside what was searched.
    """
    rows = save(rows, "bed")
    count = rows.count()
    if count:
        lines = rows.select(F.concat_ws("\t", "chrom", "start", "end", "cluster_id").alias("value"), F.monotonically_increasing_id().alias("nth"))
        header = rows.sparkSession.createDataFrame([("#chrom\tstart\tend\tcluster_id", -1)], "value string, nth long")
        write_lines(header.unionAll(lines).repartition(1).sortWithinPartitions("nth").select("value"), f"{prefix}.dup.bed")
    free(rows)
    return count


def write_pair_lines(rows: DataFrame, path: str) -> None:
    """Writes the rows of `pair_lines` as a file of text parted by tabs."""
    write_lines(rows.select(F.concat_ws("\t", *rows.columns).alias("value")).repartition(1), path)
