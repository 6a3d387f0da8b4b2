from collections import deque

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph as gr
from millrace.operators.ranking import numbered
from millrace.plans import graphs


def kahn(nodes, edges):
    out = {n: set() for n in nodes}
    for a, b in edges:
        out[a].add(b)
    left = {n: len(out[n]) for n in nodes}
    queue, order = deque(sorted(n for n in nodes if not left[n])), []
    while queue:
        n = queue.popleft()
        order.append(n)
        for m in sorted(m for m in nodes if n in out[m]):
            left[m] -= 1
            if not left[m]:
                queue.append(m)
    return order + sorted(set(nodes) - set(order))


EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("e", "a"), ("q", "z"), ("b", "k")]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def names(spark, items, column="node"):
    return spark.createDataFrame([(i,) for i in items], f"{column} string")


@pytest.mark.parametrize("small", [50_000, 0])
def test_order_is_that_of_a_queue(spark, monkeypatch, small):
    monkeypatch.setattr(gr, "SMALL_LEVEL", small)
    nodes = sorted({n for e in EDGES for n in e} | {"alone"})
    got = {r["rank"]: r.node for r in gr.topological(frame(spark, EDGES), names(spark, nodes)).collect()}
    assert [got[i] for i in range(len(nodes))] == kahn(nodes, EDGES)


def test_order_of_part_graph_with_cycles(spark, sf):
    edges = [tuple(r) for r in graphs.cyclic_edges(spark, sf).distinct().collect()]
    nodes = [r.rel for r in graphs.part_files(spark, sf).collect()]
    rows = sorted((r["rank"], r.node) for r in graphs.topo_rank_with_cycles(spark, sf).collect())
    assert [n for _, n in rows] == kahn(nodes, edges)


def test_closures(spark):
    g = frame(spark, EDGES)
    reach = {r.node: r.depth for r in gr.closure(g, names(spark, ["e", "nowhere"])).collect()}
    assert reach == {"e": 0, "nowhere": 0, "a": 1, "b": 2, "c": 2, "d": 3, "k": 3}
    assert {r.node for r in gr.affected(g, names(spark, ["x"])).collect()} == {"x", "y", "z", "q"}
    assert gr.reachable(g, names(spark, ["e"], "rel"), "unknown").count() == 0


def test_entries(spark):
    g, files = frame(spark, EDGES), names(spark, ["a", "b", "c", "d", "k", "x"], "rel")
    chosen = {r.rel: (r.reachable, r.documented) for r in gr.select_files(g, files, "b").collect()}
    assert chosen["d"] == (True, True) and chosen["x"] == (False, False)
    assert all(r.documented for r in gr.select_files(g, files, "b", scope="all").collect())
    assert all(r.reachable for r in gr.select_files(g, files, "missing").collect())
    with pytest.raises(ValueError):
        gr.select_files(g, files, "missing", explicit=True)


def test_closed_subset(spark):
    rows = [("f", "a", ["b", "c"], True), ("f", "b", [], True), ("f", "c", [], False), ("f", "d", ["b"], True), ("f", "e", ["gone"], True), ("f", "top", ["a"], True), ("g", "c", [], True)]
    nodes = spark.createDataFrame(rows, "rel string, node_id string, child_ids array<string>, valid boolean")
    assert {(r.rel, r.node_id) for r in gr.closed_subset(nodes).collect()} == {("f", "b"), ("f", "d"), ("g", "c")}


def test_closed_subset_computes_its_nodes_once(spark):
    rows = [("f", f"l{i}", [], i != 7) for i in range(20)] + [("f", f"g{g}", [f"l{g * 10 + i}" for i in range(10)], True) for g in (0, 1)] + [("f", "top", ["g0", "g1"], True)]
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    nodes = spark.createDataFrame(rows, "rel string, node_id string, child_ids array<string>, valid boolean")
    kept = {r.node_id for r in gr.closed_subset(nodes.mapInArrow(passed, nodes.schema)).collect()}
    assert kept == {r[1] for r in rows} - {"l7", "g0", "top"} and seen.value == len(rows)


def test_numbering(spark):
    rows = numbered(spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(7), "k", start=5).collect()
    assert sorted((r["rank"], r.k) for r in rows) == [(i + 5, i) for i in range(1000)]
    assert numbered(spark.range(0), "id").count() == 0


