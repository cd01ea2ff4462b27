from __future__ import annotations

import pytest

from twinspan.cli import main, parser
from twinspan.sources.fasta import fasta_lines


def test_errors_end_with_1_and_help_with_0():
    assert main([]) == 1
    for arguments, code in ((["search"], 1), (["search", "-x", "a.fa"], 1), (["search", "-k"], 1), (["-h"], 0), (["search", "-h"], 0), (["search", "a.fa", "-o", "-h"], 0), (["nothing"], 1)):
        with pytest.raises(SystemExit) as end:
            main(arguments)
        assert end.value.code == code


def test_missing_files_and_bad_parameters_end_with_1(spark):
    assert main(["compare", "--calls", "/none", "--reference", "/none"]) == 1
    assert main(["convert", "/none.bed"]) == 1
    assert main(["search", "-w", "2", "a.fa"]) == 1


def test_options_may_follow_files():
    found = parser().parse_args(["search", "a.fa", "b.fa", "-c", "1", "-m"])
    assert (found.files, found.copies, found.masked, found.k, found.window, found.prefix) == (["a.fa", "b.fa"], 1, True, 17, 1024, "twinspan")


def test_search_compare_convert(spark, tmp_path, capsys):
    import random

    rng = random.Random(1)
    unit, other = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (6000, 9000))
    (tmp_path / "g.fa").write_text(fasta_lines("s", unit + other + unit))
    assert main(["search", str(tmp_path / "g.fa"), "-o", str(tmp_path / "out")]) == 0
    calls = tmp_path / "out.dup.bed"
    rows = calls.read_text().splitlines()
    assert rows[0] == "#chrom\tstart\tend\tcluster_id" and len(rows) == 3 and all(r.startswith("g-s\t") and r.endswith("\t1") for r in rows[1:])
    assert f"2 regions, {calls.stat().st_size} bytes" in capsys.readouterr().err
    assert main(["convert", str(calls)]) == 0
    assert len((tmp_path / "out_SD.bed").read_text().splitlines()) == 2
    (tmp_path / "calls.bed").write_text(calls.read_text())
    assert main(["convert", str(tmp_path / "calls.bed")]) == 0 and (tmp_path / "calls.bed.sedef.bed").is_file()
    assert main(["compare", "--calls", str(calls), "--reference", str(tmp_path / "calls.bed")]) == 0
    assert "1.000000" in capsys.readouterr().out
