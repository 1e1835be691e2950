"""The command line on drawn and given instances, and what its checker finds."""

import pytest

from scorenet import cli
from tests import instances


DRAWN = [("stp", instances.weighted(300, 700, 2)), ("pcst", instances.prizes(120, 240, 3))]


@pytest.mark.parametrize(("kind", "source"), [*DRAWN, *instances.given()])
def test_solve_and_check(spark, tmp_path, kind, source):
    """By drawn trees and exactly, with the time that a search has at most; the checker takes both."""
    at, out = tmp_path / "in.stp", str(tmp_path / "out")
    at.write_text(source if "\n" in source else open(source).read())
    for more in (["-mc", "3", "-p", "-hubs"], ["-t", "5", "-p"]):
        assert cli.main(["solve", f"-{kind}", str(at), "-o", out, "-v", "0", *more]) == 0
        assert cli.main(["check", f"-{kind}", str(at), "-s", out]) == 0
        lines = open(out).read().split("\n")
        assert lines[0] == "SECTION Comment" and 'Name "in"' in lines and "SECTION Run" in lines and "SECTION Finalsolution" in lines


def test_faults(spark, tmp_path):
    at = tmp_path / "a.stp"
    at.write_text("33D32945 STP\nSECTION Graph\nNodes 4\nEdges 3\nE 1 2\nE 2 3\nE 3 4\nEnd\nSECTION Terminals\nTerminals 4\nT 1 4\nT 2 -1\nT 3 4\nT 4 -2\nEnd\nEOF\n")
    out = tmp_path / "s"
    assert cli.main(["solve", "-stp", str(at), "-o", str(out), "-v", "0"]) == 0
    assert "Primal 7" in out.read_text() and cli.main(["check", "-stp", str(at), "-s", str(out)]) == 0
    for text in ("V 1\nV 3", "V 1\nV 9", "V 1\nV 2\nV 3\nE 1 2\nE 1 3"):
        out.write_text(f"SECTION Finalsolution\n{text}\nEnd\n")
        assert cli.main(["check", "-stp", str(at), "-s", str(out)]) == 1
    assert cli.main(["solve", "-stp", str(at), "-r", "zz"]) == 1
    assert cli.main(["solve"]) == 1


def test_other_commands(spark, tmp_path, capsys):
    (tmp_path / "n").write_text("a 0.001\nb 0.9\nc 0.002\n")
    (tmp_path / "e").write_text("a b\nb c\n")
    files = ["-n", str(tmp_path / "n"), "-e", str(tmp_path / "e"), "-tau", "0.05"]
    for kind in ("graphviz", "nodes", "edges", "stp", "lgf"):
        assert cli.main(["print", "-kind", kind, "-p", *files]) == 0
    said = capsys.readouterr().out
    assert "a (pp) b\t0." in said and "@nodes" in said and "graph G {" in said
    assert cli.main(["print", "-kind", "nodes", "-p", *files]) == 0
    by_tau = capsys.readouterr().out
    assert cli.main(["print", "-kind", "nodes", "-p", *files[:-2], "-fdr", "0.05"]) == 0
    assert capsys.readouterr().out == by_tau  # without a mixture the rate is the threshold
    assert cli.main(["print", "-kind", "nodes", "-p", *files[:-2], "-fdr", "0.05", "-a", "0.5"]) == 1
    assert cli.main(["pvalue", "-times", "3", *files]) == 0
    (tmp_path / "x.dat").write_text("node 2\nn x y w\n0 1 1 5\n1 2 2 -3\nlink 1\nl a b\n0 0 1\n")
    assert cli.main(["convert", str(tmp_path / "x.dat")]) == 0
    assert "E 1 2" in capsys.readouterr().out
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "r1").write_text('SECTION Comment\nName "x"\nProblem "MWCS"\nEnd\nSECTION Run\nThreads 1\nTime 2.5\nPrimal 7\nEnd\n')
    assert cli.main(["runs", str(tmp_path / "logs")]) == 0
    assert capsys.readouterr().out.strip().endswith(',"x","MWCS",,1,2.5,,7')
