"""Names of genomes, sequences and chromosomes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accessions of human chromosomes.
ACCESSIONS = {f"NC_0609{24 + n}.1": f"chr{n}" for n in range(1, 23)} | {"NC_060947.1": "chrX", "NC_060948.1": "chrY", "NC_012920.1": "chrM"}


# Fixed value: the pattern of names and commands of sequence files and archives.
FASTA_PATTERN = r"\.(fa|fasta|fna|gfa)(\.gz)?(\s|$)|chromosome\.fa|genome\.fa|\.tar\.gz|\.tgz|\.zip|-A"


def genome_label(path: Column) -> Column:
    """A file's name without folder, without one compression suffix, then without one sequence suffix; 255 characters at most."""
    name = F.substring(F.regexp_extract(path, r"([^/]*)$", 1), 1, 255)
    return F.regexp_replace(F.regexp_replace(name, r"\.(gz|bgz)$", ""), r"\.(fa|fna|fasta|fastq|fq)$", "")


def chrom_label(name: Column) -> Column:
    """What follows the last hyphen, unless the name starts with chr."""
    return F.when(F.contains(name, F.lit("-")) & ~F.startswith(name, F.lit("chr")), F.regexp_extract(name, r"([^-]*)$", 1)).otherwise(name)


def accession_label(name: Column) -> Column:
    """The chromosome that an accession stands for, other names as they are; 25 pairs, so a literal map."""
    pairs = [F.lit(x) for kv in ACCESSIONS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), name)


def is_fasta(text: Column) -> Column:
    """Whether a file name or download command looks like one of sequences or an archive of them."""
    return text.rlike(FASTA_PATTERN)
