import re

import pytest

from scorenet.plans import solve
from scorenet.sources import text, writers
from tests import instances


def lines(df):
    return [r.value for r in df.orderBy("part", "key").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_labels(spark, tmp_path, end):
    (tmp_path / "n").write_bytes(end.join(["# c", "a 5", "b -1", "c 5", "b 9"]).encode())
    (tmp_path / "e").write_bytes(end.join(["a b x", "c b", "a a", "a zz", "b a"]).encode())
    g = text.read_labels(spark, str(tmp_path / "n"), str(tmp_path / "e"))
    assert sorted((r.label, r.score) for r in g.nodes.collect()) == [("a", 5.0), ("b", -1.0), ("c", 5.0)]
    assert g.edges.count() == 2
    assert solve.solve(g).bounds.first().score == 9.0


def test_malformed(spark, tmp_path):
    (tmp_path / "n").write_text("a nan1\n")
    (tmp_path / "e").write_text("")
    with pytest.raises(Exception, match="malformed"):
        text.read_labels(spark, str(tmp_path / "n"), str(tmp_path / "e")).nodes.collect()


def test_stp_round_trip_and_pcst(spark, tmp_path):
    (tmp_path / "a.stp").write_text('33D32945 STP\nSECTION Comment\nName "x"\nEnd\nSECTION Graph\nNodes 2\nEdges 1\nE 1 2 3\nEnd\nSECTION Terminals\nTerminals 2\nTP 1 10\nTP 2 4\nEnd\nEOF\n')
    g, prizes = text.read_stp_pcst(spark, str(tmp_path / "a.stp"))
    got = solve.solve(g, reduce=False)
    assert (got.bounds.first().score, prizes - got.bounds.first().score) == (11.0, 3.0)
    assert lines(writers.solution(g, got.ids)) == ["SECTION Finalsolution", "Vertices 2", "V 1", "V 2", "Edges 1", "E 1 2", "End"]
    (tmp_path / "b.stp").write_text("\n".join(lines(writers.stp(g))))
    back = text.read_stp(spark, str(tmp_path / "b.stp"))
    assert (back.nodes.count(), back.edges.count()) == (3, 2)
    assert lines(writers.module_table(g, g.nodes, got.ids))[-1] == "#total score\t11.0"


def test_first_of_repeated_labels_and_splits(spark, tmp_path):
    (tmp_path / "n").write_text("".join(f"n{i % 300} {i}\n" for i in range(900)))
    (tmp_path / "e").write_text("".join(f"n{i} n{i + 1}\n" for i in range(299)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        g = text.read_labels(spark, str(tmp_path / "n"), str(tmp_path / "e"))
        assert {r.label: r.score for r in g.nodes.collect()} == {f"n{i}": float(i) for i in range(300)}
        assert g.edges.count() == 299
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_shared_folder():
    from scorenet.storage import is_local

    assert is_local("local[8]") and is_local("local") and not is_local("local-cluster[2,1,900]") and not is_local("spark://x:7077")


def test_drawing_and_tables(spark):
    toy, three = text.toy_graphs(spark)
    drawn = lines(writers.graphviz(toy, toy.nodes.where("id in (4, 6, 7)").select("id")))
    assert drawn[0] == "graph G {" and '\t6 [label="6\\n-15.0",shape=box]' in drawn and "\t4 -- 6" in drawn and "\t1 -- 2" not in drawn
    got = solve.solve_tables(three.nodes.select("id", "score"), three.edges)
    assert {r.id: r.in_solution for r in got.collect()} == {1: True, 2: True, 3: True}
    assert lines(writers.solution_lines(three, three.nodes.select("id"), 9.0))[0] == "// Score: 9"
    assert len(lines(writers.rows_as_lines(toy.nodes, "label", "score", "pval"))) == 8


def test_numbered(spark):
    from scorenet.operators.ranking import numbered

    got = numbered(spark.range(500).selectExpr("id * 7919 % 500 as x", "id"), "x").collect()
    assert sorted((r.x, r.k) for r in got) == [(i, i + 1) for i in range(500)]
    assert numbered(spark.range(0), "id").count() == 0


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_section_files_in_many_splits(spark, tmp_path, end):
    """Tables of files read by many tasks are those of a plain parser of the whole text."""
    whole = {"a": instances.weighted(120, 300, 2), "b": instances.prizes(60, 150, 3)}
    dat = ["node 3", "n x y w", *(f"{k} 1 1 {k - 40}" for k in range(90)), "link 2", "l a b", *(f"{k} {k} {k + 1}" for k in range(89))]
    (tmp_path / "c").write_bytes(end.join(dat).encode())
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for name, data in whole.items():
            (tmp_path / name).write_bytes(data.replace("\n", end).encode())
            x = instances.parse_stp(data)
            n, edges, ends, roots = text.stp_tables(spark, str(tmp_path / name))
            assert n == x["n"] and {r.id: r.weight for r in ends.collect()} == x["terminals"] and [r.id for r in roots.collect()] == x["roots"]
            assert sorted((r.u, r.v, r.cost) for r in edges.collect()) == sorted(x["edges"])
        g = text.read_dat(spark, str(tmp_path / "c"))
        assert {r.id: r.score for r in g.nodes.collect()} == {k + 1: k - 40.0 for k in range(90)} and g.edges.count() == 89
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    good = whole["a"]
    for bad in (good.replace("33D32945", "x"), re.sub(r"Edges \d+", "Edges 7", good), good.replace("\nE ", "\nE 9999 1\nE ", 1), good.replace("\nT 1 ", "\nT 1 x", 1)):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(ValueError):
            text.read_stp(spark, str(tmp_path / "bad"))
    (tmp_path / "c").write_text("\n".join(dat[:3] + dat[4:]))
    with pytest.raises(ValueError, match="out of turn"):
        text.read_dat(spark, str(tmp_path / "c"))
    (tmp_path / "s").write_text("SECTION Finalsolution\nV 1\nE 1 2\nEnd\n")
    with pytest.raises(ValueError, match="unknown vertex"):
        text.read_solution(spark, str(tmp_path / "s"))
