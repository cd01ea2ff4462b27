from __future__ import annotations

import pytest

from twinspan.operators import intervals

PRED = [("chr1", 0, 100), ("chr1", 50, 150), ("chr1", 150, 200), ("chr1", 300, 310), ("chr2", 0, 10), ("chr3", 5, 5)]
REF = [("chr1", 90, 160), ("chr1", 290, 400), ("chr2", 0, 30), ("chr4", 0, 10)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start long, end long")


def test_merge(spark):
    assert {tuple(r) for r in intervals.merge(_frame(spark, PRED)).collect()} == {("chr1", 0, 200), ("chr1", 300, 310), ("chr2", 0, 10), ("chr3", 5, 5)}
    assert intervals.merge(_frame(spark, [])).count() == 0


def test_bases(spark):
    row = intervals.bp_metrics(_frame(spark, PRED), _frame(spark, REF)).first()
    assert (row.pred_bp, row.ref_bp, row.is_bp, row.recall, row.precision, row.jaccard) == (220, 220, 90, 90 / 220, 90 / 220, 90 / 350)
    empty = intervals.bp_metrics(_frame(spark, []), _frame(spark, REF)).first()
    assert (empty.pred_bp, empty.recall, empty.precision, empty.f1, empty.jaccard) == (0, 0.0, 0.0, 0.0, 0.0)


def test_overlap_across_bins(spark):
    a, b = [("c", 0, 100_000), ("c", 200_000, 300_000)], [("c", 50_000, 250_000)]
    assert intervals.overlap(_frame(spark, a), _frame(spark, b)).first().is_bp == 100_000


def test_fragments(spark):
    row = intervals.fragment_metrics(_frame(spark, PRED), _frame(spark, REF)).first()
    assert (row.tp, row.fn, row.fp, row.total_ref, row.total_pred, row.recall, row.precision) == (1, 3, 3, 4, 6, 0.25, 0.5)
    assert row.f1 == pytest.approx(1 / 3)


def test_pairs(spark):
    frame = lambda rows: spark.createDataFrame([(*a, *b) for a, b in rows], "c1 string, s1 long, e1 long, c2 string, s2 long, e2 long")
    ref = [(("chr1", 0, 100), ("chr2", 0, 100)), (("chr1", 1000, 1100), ("chr1", 5000, 5100)), (("chr1", 0, 100), ("chr2", 80, 180))]
    target = [(("chr2", 10, 110), ("chr1", 0, 100)), (("chr1", 0, 100), ("chr2", 60, 160)), (("chr1", 5000, 5100), ("chr1", 1000, 1100)), (("chr1", 80, 180), ("chr2", 0, 100))]
    row = intervals.pair_metrics(frame(ref), frame(target)).first()
    assert (row.tp, row.fn, row.fp, row.recall, row.precision) == (2, 1, 1, 2 / 3, 3 / 4)
    assert row.f1 == pytest.approx(12 / 17)
    none = intervals.pair_metrics(frame(ref), frame([])).first()
    assert (none.tp, none.fp, none.fn, none.recall, none.f1) == (0, 0, 3, 0.0, 0.0)
    twice = intervals.pair_metrics(frame(ref[:1] * 2), frame(target)).first()
    assert (twice.tp, twice.total_ref) == (2, 2)
