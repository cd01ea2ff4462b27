"""The whole search for duplicated regions, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from twinspan.operators import pairs as pairing
from twinspan.operators import regions as grouping
from twinspan.operators import windows as cutting
from twinspan.params import Params
from twinspan.plans.scratch import save
from twinspan.sources.bed import write_bed
from twinspan.sources.fasta import read_sequences


@dataclass
class Search:
    """The stages of one search, each made when first asked for. What several stages read is written once."""

    sequences: DataFrame
    p: Params

    def _once(self, name: str, make) -> DataFrame:  # noqa: ANN001
        made = self.__dict__.setdefault("_made", {})
        if name not in made:
            made[name] = make()
        return made[name]

    @property
    def numbered(self) -> DataFrame:
        return self._once("numbered", lambda: cutting.number_sequences(self.sequences, self.p))

    @property
    def windows(self) -> DataFrame:
        return self._once("windows", lambda: save(cutting.window_sketches(self.numbered, self.p), "windows"))

    @property
    def postings(self) -> DataFrame:
        return self._once("postings", lambda: cutting.postings(self.windows))

    @property
    def candidates(self) -> DataFrame:
        return self._once("candidates", lambda: pairing.candidate_pairs(self.postings, self.p))

    @property
    def similar(self) -> DataFrame:
        return self._once("similar", lambda: save(pairing.similar_pairs(self.candidates, self.windows, self.p), "similar"))

    @property
    def accepted(self) -> DataFrame:
        """The duplication map: windows as nodes, similar pairs with collinear support as edges."""
        return self._once("accepted", lambda: save(pairing.collinear_pairs(self.similar, self.windows, self.p), "accepted"))

    @property
    def members(self) -> DataFrame:
        return self._once("members", lambda: save(grouping.window_regions(grouping.flagged_windows(self.accepted), self.windows), "members"))

    @property
    def regions(self) -> DataFrame:
        return self._once("regions", lambda: grouping.regions(self.members, self.p))

    @property
    def partners(self) -> DataFrame:
        return self._once("partners", lambda: save(grouping.best_partners(grouping.region_edges(self.accepted, self.members)), "partners"))

    @property
    def clusters(self) -> DataFrame:
        return self._once("clusters", lambda: grouping.clusters(self.regions, self.partners))

    @property
    def bed(self) -> DataFrame:
        return grouping.bed(grouping.enough_copies(self.clusters, self.p), self.numbered, self.p)


def find_duplications(sequences: DataFrame, p: Params | None = None) -> DataFrame:
    """(chrom, start, end, cluster_id) of the duplicated regions of a table of sequences."""
    return Search(sequences, p or Params()).bed


def run(spark: SparkSession, paths: list[str], prefix: str, p: Params | None = None) -> int:
    """Searches sequence files and writes <prefix>.dup.bed; how many regions there are. Nothing is written if there are none."""
    return write_bed(find_duplications(read_sequences(spark, paths), p), prefix)
