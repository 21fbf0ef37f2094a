import pytest

from motifloom import Graph, Pattern, count
from motifloom.sources import edges as sources
from motifloom.sources import sinks
from motifloom.streaming.deltas import CHANGE, RunningCount


def write(path, text):
    path.write_text(text)
    return str(path)


def test_snap(spark, tmp_path):
    path = write(tmp_path / "snap.txt", "# head\n\n1\t2\n2 3\r\n3 1 extra\nbad line\n4\n 5 6 \n")
    assert sorted(map(tuple, sources.read_snap(spark, path).collect())) == [(1, 2), (2, 3), (3, 1), (5, 6)]
    with pytest.raises(Exception, match="not an edge"):
        sources.read_snap(spark, path, "FAILFAST").collect()
    assert count(Graph.from_snap(spark, path), Pattern.clique(3)) == 1


def test_snap_with_counts(spark, tmp_path):
    good = "# a\n# b\n# Nodes: 3 Edges: 2\n# FromNodeId ToNodeId\n1 2\n2 3\n"
    assert sources.read_snap_checked(spark, write(tmp_path / "a", good)).count() == 2
    for bad in (good.replace("Edges: 2", "Edges: 3"), good + "2 1\n", "1 2\n"):
        with pytest.raises(ValueError):
            sources.read_snap_checked(spark, write(tmp_path / "b", bad))


def test_round_trips(spark, tmp_path):
    g = Graph.complete(spark, 6).with_labels(sources.random_labels(spark.range(6).toDF("id"), 3))
    g.save(str(tmp_path / "g"))
    back = Graph.load(spark, str(tmp_path / "g"))
    assert back.edges.count() == 30 and back.vertices().count() == 6
    sinks.write_meta(g, str(tmp_path / "meta"))
    assert sources.read_meta(spark, str(tmp_path / "meta")) == {"NUM_VERTEX": 6, "NUM_EDGE": 30, "NUM_TRIANGLE": 120, "MAX_DEGREE": 5, "MAX_OFFSET": 5, "MAX_TRIANGLE": 10}
    sinks.write_snap(g.edges, str(tmp_path / "snap"))
    assert count(Graph.from_snap(spark, str(tmp_path / "snap")), Pattern.clique(4)) == 15
    sinks.write_labelled_text(g, str(tmp_path / "daf"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "daf")).collect()]
    assert lines[0] == "t 0 6" and len(lines) == 1 + 6 + 15


def test_bucketed_table(spark):
    spark.sql("DROP TABLE IF EXISTS adjacency_test")
    Graph.complete(spark, 5).save_bucketed("adjacency_test", 4)
    assert spark.table("adjacency_test").count() == 5
    spark.sql("DROP TABLE adjacency_test")


def test_changes(spark, tmp_path):
    batch = sources.read_changes(spark, write(tmp_path / "c", "3\n1 2 1\n2 1 0\n5 4 0\n7 7 1\n"))
    assert sorted(map(tuple, batch.collect())) == [(1, 2, 1), (4, 5, 0)]
    pairs = spark.createDataFrame([(2, 1), (4, 5), (8, 9)], "a long, b long")
    assert sorted(map(tuple, sources.change_of(batch, pairs).collect())) == [(2, 1, 1), (4, 5, -1), (8, 9, 0)]


def test_splits(spark):
    e = Graph.complete(spark, 40).edges
    parts = sources.split_for_updates(e)
    assert parts["start"].count() + parts["add"].count() == 780
    assert parts["del"].join(parts["start"], ["src", "dst"], "left_anti").count() == 0
    batches = sources.split_batches(e, 60, 3)
    assert batches.count() == 780 and {r[0] for r in batches.select("batch").distinct().collect()} == {0, 1, 2, 3}


def test_densify(spark):
    e = sources.symmetric(spark.createDataFrame([(100, 7), (7, 55)], "src long, dst long"))
    assert sorted(map(tuple, sources.densify(e).collect())) == [(0, 1), (0, 2), (1, 0), (2, 0)]


def test_speedups(spark):
    rows = [("a", "g", "p1", "edge", 10.0, 5), ("b", "g", "p1", "edge", 4.0, 5), ("b", "g", "p1", "edge", 6.0, 5), ("a", "g", "p2", "edge", None, None), ("b", "g", "p2", "edge", 1.0, 2), ("a", "g", "p3", "edge", 1.0, 2)]
    runs = spark.createDataFrame(rows, "system string, graph string, query string, qtype string, seconds double, result long")
    out = {r["query"]: (r["speedup"], r["state"]) for r in sinks.speedups(runs, "a", "b").collect()}
    assert out == {"p1": (2.0, "ok"), "p2": (None, "out of time"), "p3": (None, "not available")}


def test_running_count(spark, tmp_path):
    tri = Pattern.clique(3)
    run = RunningCount(spark, str(tmp_path / "state"), tri)
    run.start(Graph.from_edges(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")))
    folder = tmp_path / "in"
    folder.mkdir()
    for k, text in enumerate(["1,3,1\n", "3,4,1\n2,4,1\n", "1,2,0\n"]):
        write(folder / f"{k}.csv", text)
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).csv(str(folder))
        run.attach(stream, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    counts = [r["n"] for r in run.counts().orderBy("epoch").collect()]
    assert counts == [0, 1, 2, 1]
    run.process(spark.createDataFrame([(1, 2, 1)], CHANGE), 2)  # an epoch that comes again changes nothing
    assert [r["n"] for r in run.counts().orderBy("epoch").collect()] == counts


def test_running_count_compacts(spark, tmp_path):
    """Edges are written anew every few epochs, what they hold goes, and counts go on, vertex-induced and labelled too."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)], "id long, label int")
    p = Pattern.of(3, [(0, 1), (1, 2)]).with_labels((0, 1, 0))
    run = RunningCount(spark, str(tmp_path / "state"), p, induced="vertex", labels=labels, compact_every=3)
    pairs = {(1, 2), (2, 3), (3, 4)}
    graph = lambda: Graph.from_edges(spark.createDataFrame(sorted(pairs), "src long, dst long"), labels=labels)
    run.start(graph())
    want = [count(graph(), p, induced="vertex")]
    for k, (a, b, add) in enumerate([(4, 5, 1), (2, 4, 1), (1, 2, 0), (5, 6, 1), (1, 2, 1), (2, 4, 0), (6, 7, 1)]):
        run.process(spark.createDataFrame([(a, b, add)], CHANGE), k)
        pairs = pairs | {(a, b)} if add else pairs - {(a, b)}
        want.append(count(graph(), p, induced="vertex"))
    assert [r["n"] for r in run.counts().orderBy("epoch").collect()] == want
    assert len(list((tmp_path / "state" / "edges").glob("epoch=*"))) == 1
    assert len(list((tmp_path / "state" / "changes").glob("epoch=*"))) <= 3
