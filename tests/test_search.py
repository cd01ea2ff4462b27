from __future__ import annotations

import pytest

from twinspan.operators import pairs, regions
from twinspan.params import Params
from twinspan.plans.duplications import Search

P = Params()


def _postings(spark, groups: dict[int, list[tuple[int, int, int]]]):
    return spark.createDataFrame([(h, *w) for h, ws in groups.items() for w in ws], "hash long, window_id long, seq_id long, window_idx int")


def test_next_two_and_overlap(spark):
    one = [(i, 0, i) for i in (10, 11, 12, 500, 501, 502)]
    found = pairs.raw_pairs(_postings(spark, {1: one}), P).collect()
    assert {(r.wa, r.wb) for r in found} == {(11, 500), (12, 500), (12, 501)}


def test_groups_beyond_16_give_nothing(spark):
    of = lambda n: [(100 * i, i, 0) for i in range(n)]
    found = pairs.raw_pairs(_postings(spark, {1: of(16), 2: of(17), 3: of(1)}), P).collect()
    assert {r.hash for r in found} == {1} and len(found) == 15 + 14


def _windows(spark, sketches: dict[tuple[int, int], list[int]], lengths: dict[int, int]):
    first, at = {}, 0
    for s, n in lengths.items():
        first[s], at = at, at + n
    rows = [(first[s] + i, s, 0, i, 1000, sorted(sketches.get((s, i), []))) for s, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "window_id long, seq_id long, file_id int, window_idx int, valid_bases int, sketch array<bigint>")


def test_similarity_and_score(spark):
    same = list(range(63))
    w = _windows(spark, {(0, 0): same, (1, 0): same, (2, 0): [*range(3), *range(100, 160)], (3, 0): [1, 2], (4, 0): [0, 1, 2, *range(5000, 7045)]}, dict.fromkeys(range(5), 1))
    found = pairs.similar_pairs(spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "wa long, wb long"), w, P).collect()
    assert {(r.wa, r.wb, r.shared, r.score) for r in found} == {(0, 1, 63, 255), (0, 2, 3, 12)}
    assert pairs.similar_pairs(spark.createDataFrame([(0, 4)], "wa long, wb long"), w, P).count() == 0  # 47 are needed


def test_collinear_support(spark):
    s = lambda base: list(range(base, base + 20))
    pair = spark.createDataFrame([(0, 20, 20, 255)], "wa long, wb long, shared long, score long")

    def kept(sketches, lengths=None):
        return pairs.collinear_pairs(pair, _windows(spark, sketches, lengths or {0: 20, 1: 20}), P).count()

    assert kept({(0, 0): s(0), (1, 0): s(0)}) == 0
    assert kept({(0, 0): s(0), (1, 0): s(0), (0, 3): s(50), (1, 5): s(50)}) == 1  # not candidates themselves, and with a gap
    assert kept({(0, 0): s(0), (1, 0): s(0), (0, 9): s(50), (1, 1): s(50)}) == 0  # too far
    assert kept({(0, 0): s(0), (1, 0): s(0), (0, 3): s(50), (1, 5): s(68)}) == 0  # two hashes in common
    swap = spark.createDataFrame([(0, 5, 20, 255)], "wa long, wb long, shared long, score long")
    assert pairs.collinear_pairs(swap, _windows(spark, {(0, 0): s(0), (0, 5): s(0)}, {0: 30}), P).count() == 1  # supports itself, swapped


def _edges(spark, rows):
    return spark.createDataFrame(rows, "ra long, rb long, score long")


def _clustered(spark, edges, files):
    rows = spark.createDataFrame([(i, i, f, 0, 2000) for i, f in enumerate(files)], "region_id long, seq_id long, file_id int, start long, end long")
    return regions.clusters(rows, regions.best_partners(_edges(spark, edges)))


def test_partners(spark):
    best = lambda e: {r.region_id: (r.partner_id, r.is_internal) for r in regions.best_partners(_edges(spark, e)).collect()}
    assert best([(0, 1, 200), (0, 2, 200), (1, 2, 100)]) == {0: (1, False), 1: (0, False), 2: (0, False)}
    assert best([(0, 0, 255), (0, 1, 0)]) == {0: (1, False), 1: (0, False)}
    assert best([(0, 0, 255)]) == {0: (None, True)}


def test_clusters_follow_best_partners_only(spark):
    rows = _clustered(spark, [(0, 1, 250), (2, 3, 250), (1, 2, 100)], [0] * 4).collect()
    assert {r.region_id: r.cluster_id for r in rows} == {0: 1, 1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize(("copies", "kept"), [(1, {0, 1, 2, 3}), (2, {0, 1, 3}), (3, set())])
def test_copies_count_per_file(spark, copies, kept):
    rows = _clustered(spark, [(0, 1, 9), (0, 2, 9), (3, 3, 5)], [0, 0, 1, 0])
    assert {r.region_id for r in regions.enough_copies(rows, Params(min_copies=copies)).collect()} == kept


def test_cluster_numbers_keep_gaps(spark):
    rows = regions.enough_copies(_clustered(spark, [(0, 1, 9), (2, 3, 9)], [0, 1, 0, 0]), P).collect()
    assert {r.cluster_id for r in rows} == {2}


def test_islands(spark):
    w = _windows(spark, {}, {0: 30, 1: 5, 2: 5})
    flagged = spark.createDataFrame([(i,) for i in (0, 8, 17, 30, 31, 36)], "window_id long")
    members = regions.window_regions(flagged, w)
    found = {tuple(r) for r in regions.regions(members, P).select("region_id", "seq_id", "start", "end").collect()}
    assert found == {(0, 0, 0, 8 * 341 + 1024), (1, 0, 17 * 341, 17 * 341 + 1024), (2, 1, 0, 341 + 1024), (3, 2, 341, 341 + 1024)}


def test_short_sequences_have_no_number_and_windows_none_of_the_tail(spark):
    rows = [(0, "g", f"s{n}", i, "ACGT" * 400, n) for i, n in enumerate((1023, 1024, 1364, 1365))]
    seqs = spark.createDataFrame([(f, g, s, i, b[:n]) for f, g, s, i, b, n in rows], "file_id int, genome string, seq string, record_no long, bases string")
    found = Search(seqs, P).numbered.orderBy("seq_id").collect()
    assert [(r.seq, r.seq_id, r.n_windows, r.first_window) for r in found] == [("s1024", 0, 1, 0), ("s1364", 1, 1, 1), ("s1365", 2, 2, 2)]


def test_no_sequences(spark):
    seqs = spark.createDataFrame([], "file_id int, genome string, seq string, record_no long, bases string")
    assert Search(seqs, P).bed.count() == 0


def test_result_does_not_depend_on_partitions(spark):
    from twinspan.sources.bridge import document_sequences

    seqs = document_sequences(spark, "/root/testdata/sf0.001")
    once = {tuple(r) for r in Search(seqs, Params(min_copies=1)).bed.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        again = {tuple(r) for r in Search(seqs.repartition(7), Params(min_copies=1)).bed.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert once == again and len(once) == 39
