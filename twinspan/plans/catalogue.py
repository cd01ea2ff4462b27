"""The queries by name, and DuckDB SQL with the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.functions import labels
from twinspan.operators import intervals, pairs, regions, windows
from twinspan.params import Params
from twinspan.plans import oracle
from twinspan.plans.duplications import Search
from twinspan.plans.evaluation import group_means, melted
from twinspan.plans.scratch import keep, root
from twinspan.sources import bed
from twinspan.sources.bridge import document_sequences, line_intervals
from twinspan.sources.records import record_files
from twinspan.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Windows of more k-mers than a sketch may have.
CAPPED = Params(window=4096, scale=1)
DEFAULT, MAP, THREE, MASKED = Params(), Params(min_copies=1), Params(min_copies=3), Params(masked=True)
#: A shorter k-mer, at which the share of the larger sketch decides what is similar, and not the least number.
SHORT = Params(k=11)


def _search(make: Callable[[Search], DataFrame], p: Params = DEFAULT) -> Query:
    return lambda spark, sf_dir: make(Search(document_sequences(spark, sf_dir), p))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = line_intervals(spark, sf_dir)
    return tuple(rows.where(x).select("chrom", "start", "end").distinct() for x in ("pred", "not pred"))


ORDER = ["chrom", "start", "end"]


def _members(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return line_intervals(spark, sf_dir).where(where).select("cluster_id", *ORDER).distinct()


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names like those of genomes' sequences, made from the tables: with hyphens, prefixes and accessions."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    chrom = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("chr"), F.col("p_partkey") % 23, F.lit("-x")))
    chrom = chrom.when(F.col("p_partkey") % 7 < 5, F.concat(F.lit("t2t-"), F.col("p_brand"), F.lit("-NC_0609"), F.col("p_partkey") % 26 + 24, F.lit(".1"))).otherwise(F.col("p_brand"))
    return part.select("p_partkey", chrom.alias("name"))


_LABELS_SQL = """select p_partkey, case when p_partkey % 7 = 0 then 'chr' || (p_partkey % 23) || '-x'
  when p_partkey % 7 < 5 then 't2t-' || p_brand || '-NC_0609' || (p_partkey % 26 + 24) || '.1' else p_brand end as name from part"""
_CHROM_SQL = "case when contains(name, '-') and not starts_with(name, 'chr') then regexp_extract(name, '([^-]*)$', 1) else name end"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, PATH_ENDS))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    path = F.concat(F.lit("/data/"), "s_name", F.element_at(ends, (F.col("s_suppkey") % len(PATH_ENDS) + 1).cast("int")))
    return rows.select("s_suppkey", path.alias("path")).select("s_suppkey", "path", labels.genome_label(F.col("path")).alias("genome"))


PATH_ENDS = (".fa", ".fna.gz", ".fasta", ".fa.bgz", ".tar.gz", ".v1.fastq", ".fq.gz", "", ".txt")


def _hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", links.alias("href"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By host, as by module of a dry run: links queued, those that look like sequences or archives, and the verdict."""
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("module"), "url")
    queued = rows.select("module", F.explode(F.array("url", F.concat("url", F.lit("/genome.fa.gz")))).alias("item"))
    queued = queued.where(~(F.endswith("item", F.lit("genome.fa.gz")) & F.col("item").contains("?")))
    found = queued.groupBy("module").agg(F.count(F.lit(1)).alias("total"), F.count_if(labels.is_fasta(F.col("item"))).alias("matched"))
    return found.withColumn("status", F.when(F.col("matched") == 0, "FAIL").otherwise("PASS"))


def _copies_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "user_id", "value")


def _text(lines: DataFrame, name: str) -> str:
    """The path of a folder of text, of rows of one column."""
    path = f"{root(lines.sparkSession)}/twinspan/{uuid.uuid4().hex}-{name}"
    lines.write.text(path)
    keep(lines.sparkSession, path)
    return path


def _bed_text(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Line items as lines of a file of intervals: BED, BEDPE, comments, blank lines, and lines whose end is no number."""
    rows = line_intervals(spark, sf_dir).withColumn("kind", F.col("start") % 5)
    own = F.concat(F.lit("g-"), "chrom"), F.col("start").cast("string"), F.col("end").cast("string")
    other = F.lit("chr9"), (F.col("start") + 50).cast("string"), (F.col("end") + 50).cast("string")
    line = F.when(F.col("kind") < 2, F.concat_ws("\t", *own, F.col("cluster_id").cast("string"))).when(F.col("kind") == 2, F.concat_ws("  ", *own, *other))
    line = line.when(F.col("kind") == 3, F.concat_ws(" ", *own[:2], F.lit("x"), *other)).otherwise(F.when(F.col("start") % 2 == 0, F.concat(F.lit("#"), own[0])).otherwise(F.lit(" \t")))
    return _text(rows.select(line.alias("value")), name)


_BED_TEXT_SQL = """with t as (select 'chr' || (l_suppkey % 5 + 1) as chrom, l_partkey * 100 + l_linenumber * 7 as start, l_partkey * 100 + l_linenumber * 7 + cast(l_quantity as bigint) * 20 as "end" from lineitem)"""


def _cluster_text(spark: SparkSession, sf_dir: str, name: str, accessions: bool = False) -> str:
    """The clusters of line items as lines parted by tabs."""
    names = F.array(*map(F.lit, labels.ACCESSIONS))
    chrom = F.concat(F.lit("t2t-"), F.element_at(names, (F.col("cluster_id") % len(labels.ACCESSIONS) + 1).cast("int"))) if accessions else F.concat(F.lit("g-"), "chrom")
    rows = _members(spark, sf_dir).select(F.concat_ws("\t", chrom, "start", "end", "cluster_id").alias("value"))
    return _text(rows, name)


_ACCESSION_SQL = "[" + ", ".join(f"'{x}'" for x in labels.ACCESSIONS) + "]"


def _pair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of clusters' members, written as lines and read again."""
    members = bed.tab_members(spark, _cluster_text(spark, sf_dir, "tabs")).drop("line_no").distinct()
    path = f"{root(spark)}/twinspan/{uuid.uuid4().hex}-lines"
    bed.write_pair_lines(intervals.pair_lines(members, ORDER), path)
    keep(spark, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, name) of the files that answers made from the pages list; every third entry lacks a name."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    name = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("f"), "page_id"))
    entry = F.struct(F.struct(F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("content"), F.concat("url", F.lit("?self")).alias("self")).alias("links"), name.alias("key"))
    answers = rows.select("page_id", F.to_json(F.struct(F.array(entry, entry).alias("files"))).alias("answer"))
    return answers.select("page_id", F.inline(record_files(F.col("answer"))))


def _shapes(s: Search) -> DataFrame:
    return s.windows.select("window_id", "seq_id", "file_id", F.col("window_idx").cast("long").alias("window_idx"), F.col("valid_bases").cast("long").alias("valid_bases"))


def _sketch_sizes(s: Search) -> DataFrame:
    return s.windows.select("window_id", F.size("sketch").cast("long").alias("n"), F.aggregate("sketch", F.lit(0).cast("long"), lambda a, x: a + x).alias("hash_sum"))


QUERIES: dict[str, Query] = {
    "seq_projection": lambda spark, d: windows.number_sequences(document_sequences(spark, d), DEFAULT).select("file_id", "genome", "seq", "seq_id", "len", "n_windows", F.md5("bases").alias("bases_md5")),
    "basename_labels": _paths,
    "windows": _search(lambda s: windows.window_ids(s.numbered)),
    "valid_bases": _search(lambda s: _shapes(s).select("window_id", "valid_bases"), MASKED),
    "kmer_hashes": _search(lambda s: s.postings.select("hash", "window_id")),
    "sketch_sizes": _search(_sketch_sizes),
    "masked_sketch_sizes": _search(_sketch_sizes, MASKED),
    "capped_sketch_sizes": _search(_sketch_sizes, CAPPED),
    "hash_frequency": _search(lambda s: windows.hash_counts(s.postings).groupBy("n").agg(F.count(F.lit(1)).alias("hashes"))),
    "raw_pairs": _search(lambda s: pairs.raw_pairs(s.postings, s.p)),
    "candidate_pairs": _search(lambda s: s.candidates),
    "pair_similarity": _search(lambda s: s.similar),
    "pair_similarity_k11": _search(lambda s: s.similar, SHORT),
    "collinear_pairs": _search(lambda s: s.accepted),
    "flagged_windows": _search(lambda s: regions.flagged_windows(s.accepted)),
    "regions": _search(lambda s: s.regions),
    "region_edges": _search(lambda s: regions.region_edges(s.accepted, s.members)),
    "best_partner": _search(lambda s: s.partners),
    "components": _search(lambda s: s.clusters.select("region_id", "component")),
    "clusters": _search(lambda s: s.clusters.select("region_id", "file_id", "cluster_id", "is_internal")),
    "dup_bed_c1": _search(lambda s: s.bed, MAP),
    "dup_bed_c2": _search(lambda s: s.bed),
    "dup_bed_c3": _search(lambda s: s.bed, THREE),
    "interval_merge": lambda spark, d: intervals.merge(_sides(spark, d)[0]),
    "interval_overlap": lambda spark, d: intervals.overlap(*(intervals.merge(x) for x in _sides(spark, d))),
    "covered_intervals": lambda spark, d: intervals.covered(*_sides(spark, d)),
    "bp_metrics": lambda spark, d: intervals.bp_metrics(*_sides(spark, d)),
    "fragment_metrics": lambda spark, d: intervals.fragment_metrics(*_sides(spark, d)),
    "cluster_pairs": lambda spark, d: intervals.cluster_pairs(_members(spark, d), ORDER),
    "pair_metrics": lambda spark, d: intervals.pair_metrics(*(intervals.cluster_pairs(_members(spark, d, x), ORDER) for x in ("not pred", "pred"))),
    "bed9_pairs": lambda spark, d: intervals.pair_lines(_members(spark, d), ORDER),
    "chrom_normalize": lambda spark, d: _labels(spark, d).select("p_partkey", labels.chrom_label(F.col("name")).alias("label")),
    "accession_map": lambda spark, d: _labels(spark, d).select("p_partkey", labels.accession_label(labels.chrom_label(F.col("name"))).alias("label")),
    "metric_group_mean": lambda spark, d: group_means(_copies_table(spark, d).withColumn("value", F.floor(F.col("value") * 100).cast("long")), ["event_type"], ["user_id", "value"]),
    "metric_unpivot": lambda spark, d: melted(table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("Recall_bp"), F.col("p_size").cast("double").alias("Precision_bp")), ["p_partkey"], {"Recall_bp": "Recall", "Precision_bp": "Precision"}),
    "href_extract": _hrefs,
    "fasta_classifier_summary": _classified,
    "bed_intervals": lambda spark, d: bed.parse_intervals(spark, _bed_text(spark, d, "bed")),
    "bedpe_pairs": lambda spark, d: bed.parse_pairs(spark, _bed_text(spark, d, "bedpe")),
    "cluster_bed_pairs": lambda spark, d: intervals.cluster_pairs(bed.cluster_members(spark, _cluster_text(spark, d, "clusters")).drop("line_no").distinct(), ORDER),
    "normalised_intervals": lambda spark, d: bed.normalised_intervals(spark, _cluster_text(spark, d, "accessions", accessions=True)),
    "pair_lines_text": _pair_text,
    "record_files": _answers,
}


def _chain(p: Params, upto: str, select: str) -> str:
    return f"{oracle.searched(p, upto)} {select}"


_ENDS_SQL = "[" + ", ".join(f"'{x}'" for x in PATH_ENDS) + "]"
_SIZES_SQL = "select v.window_id, count(p.hash) as n, cast(coalesce(sum(p.hash), 0) as bigint) as hash_sum from valids v left join postings p on p.window_id = v.window_id group by v.window_id"
_BED_SQL = 'select chrom, start, "end", cluster_id from bed'

ORACLE_SQL: dict[str, str] = {
    "seq_projection": _chain(DEFAULT, "firsts", "select file_id, genome, cast(doc_id as varchar) as seq, seq_id, cast(length(bases) as bigint) as len, n_windows, md5(bases) as bases_md5 from firsts"),
    "basename_labels": f"""with x as (select s_suppkey, '/data/' || s_name || {_ENDS_SQL}[s_suppkey % {len(PATH_ENDS)} + 1] as path from supplier)
select s_suppkey, path, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.(gz|bgz)$', ''), '\\.(fa|fna|fasta|fastq|fq)$', '') as genome from x""",
    "windows": _chain(DEFAULT, "valids", "select window_id, seq_id, file_id, window_idx from valids"),
    "valid_bases": _chain(MASKED, "valids", "select window_id, cast(valid_bases as bigint) as valid_bases from valids"),
    "kmer_hashes": _chain(DEFAULT, "postings", "select hash, window_id from postings"),
    "sketch_sizes": _chain(DEFAULT, "postings", _SIZES_SQL),
    "masked_sketch_sizes": _chain(MASKED, "postings", _SIZES_SQL),
    "capped_sketch_sizes": _chain(CAPPED, "postings", _SIZES_SQL),
    "hash_frequency": _chain(DEFAULT, "hash_n", "select n, count(*) as hashes from hash_n group by n"),
    "raw_pairs": _chain(DEFAULT, "raw", "select hash, wa, wb from raw"),
    "candidate_pairs": _chain(DEFAULT, "cand", "select wa, wb from cand"),
    "pair_similarity": _chain(DEFAULT, "sim", "select wa, wb, shared, score from sim"),
    "pair_similarity_k11": _chain(SHORT, "sim", "select wa, wb, shared, score from sim"),
    "collinear_pairs": _chain(DEFAULT, "accepted", "select wa, wb, shared, score from accepted"),
    "flagged_windows": _chain(DEFAULT, "flagged", "select window_id from flagged"),
    "regions": _chain(DEFAULT, "regs", 'select region_id, seq_id, file_id, start, "end" from regs'),
    "region_edges": _chain(DEFAULT, "edges", "select ra, rb, score from edges"),
    "best_partner": _chain(DEFAULT, "partners", "select region_id, partner_id, score, is_internal from partners"),
    "components": _chain(DEFAULT, "comps", "select region_id, component from comps"),
    "clusters": _chain(DEFAULT, "clustered", "select region_id, file_id, cluster_id, is_internal from clustered"),
    "dup_bed_c1": _chain(MAP, "bed", _BED_SQL),
    "dup_bed_c2": _chain(DEFAULT, "bed", _BED_SQL),
    "dup_bed_c3": _chain(THREE, "bed", _BED_SQL),
    "interval_merge": oracle.INTERVALS + oracle.merged("pm", "p") + ' select chrom, start, "end" from pm',
    "interval_overlap": oracle.INTERVALS + oracle.merged("pm", "p") + oracle.merged("rm", "r") + """ select cast(coalesce(sum(least(a."end", b."end") - greatest(a.start, b.start)), 0) as bigint) as is_bp
from pm a join rm b on a.chrom = b.chrom and a.start < b."end" and b.start < a."end" """,
    "covered_intervals": oracle.INTERVALS + """ select chrom, start, "end" from p a where a."end" > a.start and exists (select 1 from r b where a.chrom = b.chrom and b."end" > a.start
  and greatest(least(a."end", b."end") - greatest(a.start, b.start), 0)::double / (a."end" - a.start)::double >= 0.5)""",
    "bp_metrics": oracle.BP_METRICS,
    "fragment_metrics": oracle.FRAGMENT_METRICS,
    "cluster_pairs": oracle.CLUSTER_PAIRS,
    "pair_metrics": oracle.PAIR_METRICS,
    "bed9_pairs": oracle.BED9_PAIRS,
    "chrom_normalize": f"select p_partkey, {_CHROM_SQL} as label from ({_LABELS_SQL})",
    "accession_map": f"select p_partkey, {oracle.ACCESSION_CASES} as label from (select p_partkey, {_CHROM_SQL} as label from ({_LABELS_SQL}))",
    "metric_group_mean": "select event_type, avg(user_id) as user_id, avg(cast(floor(value * 100) as bigint)) as value from events group by event_type",
    "metric_unpivot": """select p_partkey, 'Recall' as "Metric", p_retailprice as "Score" from part where p_retailprice is not null
union all select p_partkey, 'Precision', p_size::double from part""",
    "href_extract": """select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href from pages""",
    "fasta_classifier_summary": f"""with rows as (select regexp_extract(url, '^https?://([^/]+)', 1) as module, url from pages),
queued as (select module, url as item from rows union all select module, url || '/genome.fa.gz' from rows where not contains(url, '?')),
f as (select module, count(*) as total, count(*) filter (where regexp_matches(item, '{labels.FASTA_PATTERN}')) as matched from queued group by module)
select module, total, matched, case when matched = 0 then 'FAIL' else 'PASS' end as status from f""",
    "bed_intervals": f"""{_BED_TEXT_SQL} select distinct chrom, start, "end" from t where start % 5 < 3 union select 'chr9', start + 50, "end" + 50 from t where start % 5 in (2, 3)""",
    "bedpe_pairs": f"""{_BED_TEXT_SQL} select chrom as c1, start as s1, "end" as e1, 'chr9' as c2, start + 50 as s2, "end" + 50 as e2 from t where start % 5 = 2""",
    "cluster_bed_pairs": f"select cast(cluster_id as varchar) as cluster_id, c1, s1, e1, c2, s2, e2 from ({oracle.CLUSTER_PAIRS})",
    "normalised_intervals": f"""{oracle.PAIRS}, x as (select distinct {_ACCESSION_SQL}[cluster_id % {len(labels.ACCESSIONS)} + 1] as label, start, "end" from mem)
select distinct {oracle.ACCESSION_CASES} as chrom, start, "end" from x where label <> 'NC_012920.1'""",
    "pair_lines_text": f"select concat_ws(chr(9), chrom, start, \"end\", name, score, strand, thick_start, thick_end, rgb) as line from ({oracle.BED9_PAIRS})",
    "record_files": """select page_id, case when page_id % 2 = 0 then url else url || '?self' end as url, 'f' || page_id as name from pages, range(2) where page_id % 3 <> 0""",
}
