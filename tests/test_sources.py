from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from twinspan.functions import labels
from twinspan.operators import intervals
from twinspan.params import Params
from twinspan.plans.duplications import run
from twinspan.sources import bed
from twinspan.sources.fasta import _whole, fasta_lines, read_sequences, records


def test_records():
    text = b"junk\n>a first one\r\nACGT\r\nAC\r\n>b\n\n>c\nGG\n@q more\nACGT\n+\n!!@!\n>d\nTT\n"
    assert list(records(_whole(text))) == [("a", "first one", "ACGTAC", None), ("b", "", "", None), ("c", "", "GG", None), ("q", "more", "ACGT", "!!@!"), ("d", "", "TT", None)]


def test_a_bad_record_ends_the_file():
    assert [r[0] for r in records(_whole(b">a\nAC\n@q\nACGT\n+\n!!!!!!\n>b\nAC\n"))] == ["a"]
    assert list(records(_whole(b""))) == []


def test_files_keep_their_number(spark, tmp_path):
    (tmp_path / "x.fa").write_text(fasta_lines("s1", "ACGT" * 30) + fasta_lines("s2", ""))
    (tmp_path / "y.fna.gz").write_bytes(gzip.compress(b">t\nAAA\n"))
    (tmp_path / "z.fq.bgz").write_bytes(gzip.compress(b"@u\nAC\n+\n!!\n"))
    paths = [str(tmp_path / n) for n in ("x.fa", "none.fa", "y.fna.gz", "z.fq.bgz")]
    rows = read_sequences(spark, paths).orderBy("file_id", "record_no").collect()
    assert [(r.file_id, r.genome, r.seq, r.record_no, len(r.bases), r.quality) for r in rows] == [(0, "x", "s1", 0, 120, None), (0, "x", "s2", 1, 0, None), (2, "y", "t", 0, 3, None), (3, "z", "u", 0, 2, "!!")]
    assert read_sequences(spark, [paths[1]]).count() == 0


def test_a_file_of_many_splits(spark, tmp_path):
    """Lines of several splits and many batches come in order; a file's name need not tell how it is packed."""
    import random

    rng = random.Random(3)
    bases = {f"s{i}": "".join(rng.choices("ACGT", k=rng.randint(0, 60_000))) for i in range(40)}
    text = "".join(fasta_lines(k, v) for k, v in bases.items())
    (tmp_path / "x.fa").write_text(text)
    (tmp_path / "y.fa.gz").write_text(text)
    (tmp_path / "z.fa").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "w.fa.gz").write_bytes(gzip.compress(text.encode()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert spark.read.text(str(tmp_path / "x.fa")).rdd.getNumPartitions() > 5
        rows = read_sequences(spark, [str(tmp_path / n) for n in ("x.fa", "y.fa.gz", "z.fa", "w.fa.gz")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for i, genome in enumerate("xyzw"):
        assert [(r.genome, r.seq, r.bases) for r in rows if r.file_id == i] == [(genome, k, v) for k, v in bases.items()]


def test_labels(spark):
    names = {"/d/x.fna.gz": "x", "x.fa.bgz": "x", "x.tar.gz": "x.tar", "a.b.fasta": "a.b", "/p.d/noext": "noext", "x.gz.fa": "x.gz"}
    rows = spark.createDataFrame([(k,) for k in names], "p string").select("p", labels.genome_label(F.col("p")).alias("g")).collect()
    assert {r.p: r.g for r in rows} == names
    chroms = {"t2t-NC_060925.1": ("NC_060925.1", "chr1"), "chr1-x": ("chr1-x", "chr1-x"), "a-b-c": ("c", "c"), "NC_012920.1": ("NC_012920.1", "chrM"), "x-": ("", "")}
    rows = spark.createDataFrame([(k,) for k in chroms], "p string").select("p", labels.chrom_label(F.col("p")).alias("c"), labels.accession_label(labels.chrom_label(F.col("p"))).alias("a")).collect()
    assert {r.p: (r.c, r.a) for r in rows} == chroms
    assert len(labels.ACCESSIONS) == 25


def test_interval_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#x\n\ng-c1 0 10 7\ng-c1\t0\t10\t8\nc2 5 x\nc3 1 2 h-c4 3 4\nc5 1 2 c6 x 9\nshort 1\n")
    rows = {tuple(r) for r in bed.parse_intervals(spark, str(tmp_path / "a.bed")).collect()}
    assert rows == {("c1", 0, 10), ("c3", 1, 2), ("c4", 3, 4), ("c5", 1, 2)}
    assert [tuple(r) for r in bed.parse_pairs(spark, str(tmp_path / "a.bed")).collect()] == [("c3", 1, 2, "c4", 3, 4)]
    assert bed.parse_intervals(spark, str(tmp_path / "none.bed")).count() == 0
    (tmp_path / "m.bed").write_text("h-NC_060925.1 1 2\nNC_012920.1 3 4\n")
    assert [tuple(r) for r in bed.normalised_intervals(spark, str(tmp_path / "m.bed")).collect()] == [("chr1", 1, 2)]
    assert bed.normalised_intervals(spark, str(tmp_path / "m.bed"), False).count() == 2


def test_cluster_files(spark, tmp_path):
    path = tmp_path / "c.bed"
    path.write_text("#h\na-c1\t0\t10\t1\nb-c1\t5\t9\t1\nb-c2\t0\t4\t1\nc3\t0\t1\t2\n")
    pairs = intervals.cluster_pairs(bed.cluster_members(spark, str(path)), ["line_no"]).collect()
    assert {tuple(r)[1:] for r in pairs} == {("c1", 0, 10, "c2", 0, 4), ("c1", 5, 9, "c2", 0, 4)}
    path.write_text("c1 0 10 1 7\nc2 0 10 1 7\nc3 0 10 1 0\nc4 0 10 1 0\n")
    assert intervals.cluster_pairs(bed.cluster_members(spark, str(path)), ["line_no"]).count() == 5
    assert intervals.cluster_pairs(bed.cluster_members(spark, str(path)), ["line_no"], False).count() == 6
    path.write_text("c1 0 10 1\nc2 x 10 1\n")
    with pytest.raises(Exception, match="not a whole number: x"):
        bed.cluster_members(spark, str(path)).collect()
    path.write_text("c1\t0\t10\t1\nc1\t0\t10\t1\n")
    lines = intervals.pair_lines(bed.tab_members(spark, str(path)), ["line_no"])
    assert [tuple(r) for r in lines.collect()] == [("c1", "0", "10", "c1:0-10", "0", "+", "0", "10", "139,139,139")] * 2
    bed.write_pair_lines(lines, str(tmp_path / "out"))
    assert (tmp_path / "out").read_text().splitlines()[0] == "c1\t0\t10\tc1:0-10\t0\t+\t0\t10\t139,139,139"


def test_nothing_found_writes_nothing(spark, tmp_path):
    (tmp_path / "x.fa").write_text(fasta_lines("s", "A" * 100))
    assert not run(spark, [str(tmp_path / "x.fa")], str(tmp_path / "out"), Params())
    assert not (tmp_path / "out.dup.bed").exists()


def test_documents_without_a_source(spark, tmp_path):
    import duckdb

    from twinspan.plans import catalogue
    from twinspan.sources.tables import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    docs.withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("source"))).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("seq_projection", "windows"):
        found = con.sql(catalogue.ORACLE_SQL[name])
        frame = catalogue.QUERIES[name](spark, str(tmp_path)).select(*found.columns)
        rows = sorted(map(repr, (tuple(r) for r in frame.collect())))
        assert rows == sorted(map(repr, found.fetchall())) and rows


def test_a_long_sequence_is_the_work_of_many_tasks(spark):
    from twinspan.operators.windows import number_sequences, window_sketches
    from twinspan.params import Params

    rows = spark.createDataFrame([(0, "g", "s", 0, "ACGTTGCA" * 400_000)], "file_id int, genome string, seq string, record_no long, bases string")
    found = window_sketches(number_sequences(rows, Params()), Params())
    tasks = found.select(F.spark_partition_id().alias("t"), "window_id").groupBy("t").count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == (3_200_000 - 1024) // 341 + 1


def test_record_files(spark):
    from twinspan.sources.records import article_files, record_files

    one = '{"files": [{"links": {"content": "u1", "self": "u2"}, "key": "a"}, {"links": {"self": "u3"}, "filename": "b"}, {"download_url": "u4", "key": ""}, {"key": "c"}]}'
    rows = spark.createDataFrame([(one,), ("{}",), ("no json",), (None,)], "j string")
    assert [tuple(r) for r in rows.select(F.inline(record_files(F.col("j")))).collect()] == [("u1", "a"), ("u3", "b")]
    two = '[{"download_url": "u1", "name": "a"}, {"download_url": "", "name": "b"}, {"name": "c"}]'
    rows = spark.createDataFrame([(two,), ("[]",), (None,)], "j string")
    assert [tuple(r) for r in rows.select(F.inline(article_files(F.col("j")))).collect()] == [("u1", "a")]
