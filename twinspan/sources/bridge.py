"""Sequences and intervals made from tables of other things, the same way in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinspan.sources.tables import table

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
BASES = "ACGTACGTACGTACGTACGTACGTACacgtacgtacgtacgtacgtacgtacNNNNNNNNNN"


def document_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, genome, seq, record_no, bases): each document a sequence, each source a genome's file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # Names of files alone meet in one task, as they would on a command line.
    nth = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1  # null comes last, as in DuckDB
    files = docs.select("source").distinct().select(F.col("source").alias("name"), nth.alias("file_id"))
    bases = F.translate(F.regexp_replace("text", "[^A-Za-z0-9]", ""), LETTERS, BASES)
    rows = docs.select(F.col("source").alias("genome"), F.col("doc_id").cast("string").alias("seq"), F.col("doc_id").alias("record_no"), bases.alias("bases"))
    return rows.join(files, F.col("genome").eqNullSafe(F.col("name"))).select("file_id", "genome", "seq", "record_no", "bases")


def line_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, start, end, cluster_id, pred) from line items: odd line numbers are predicted, even ones the reference."""
    start = F.col("l_partkey") * 100 + F.col("l_linenumber") * 7
    chrom = F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return rows.select(
        chrom.alias("chrom"), start.cast("long").alias("start"), (start + F.col("l_quantity").cast("long") * 20).cast("long").alias("end"),
        F.col("l_orderkey").alias("cluster_id"), (F.col("l_linenumber") % 2 == 1).alias("pred"),
    )
